"""Operator 5: token ids in Re-Pair compressed blocks.

Every text is encoded, ends with an end id, and documents lie in ascending doc_id order.
A block holds whole documents, about block_ids ids, as a grammar of its own: frequent
pairs of ids are replaced by nonterminals again and again until none is left that occurs
`least` times (a rule for a rarer pair takes more room than it saves), so the stored
sequence is short; with each rule stands the number of ids it expands to, by which any range of ids
is found and decoded without the rest.

File format: Parquet, a row for each block, columns
  shard int, block int      place in the order (shard, then block)
  ids_before long           ids of the same shard before this block
  n_ids long                ids in this block
  doc_ids binary            int64 each, little-endian, as all integers here
  doc_lengths binary        uint32 each: ids of each document, with its end id
  base int                  the first nonterminal; smaller symbols are ids
  rules binary              uint32 pairs: left and right symbol of each nonterminal
  expansions binary         uint32 each: ids that each nonterminal expands to
  sequence binary           the symbols, uint16 (wide = false) or uint32
  wide boolean
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy, whole_texts
from .tokens import encoded

#: Half of the words that the tokenizer's table holds. At 90,000 one word in nine of 12,000
#: documents was asked of the library, two in five of them met before.
PIECES = 300_000
BLOCK_SCHEMA = (
    "shard int, block int, ids_before long, n_ids long, doc_ids binary, doc_lengths binary, "
    "base int, rules binary, expansions binary, sequence binary, wide boolean"
)
_BLOCK_ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("doc_lengths", pa.binary()), ("base", pa.int32()), ("rules", pa.binary()), ("expansions", pa.binary()), ("sequence", pa.binary()), ("wide", pa.bool_())]
)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)


def compress(ids: np.ndarray, least: int = 16, bits: int = 18):
    """The grammar of an id sequence: (base, rules, expansions, sequence), in which no
    pair is left that occurs `least` times without overlapping itself.

    Rounds replace many pairs at once: of two occurrences that overlap the one of the more
    frequent pair is taken, so the most frequent pair of all is replaced wherever it
    stands, and a pair that has fewer than `least` occurrences to itself waits for the
    next round. Counts are carried on, not made anew: only places whose pair was frequent
    in the last round, or has a symbol that it made, are looked at again, since no other
    pair's count can have grown."""
    seq = ids.astype(np.int32)
    base = int(seq.max()) + 1 if len(seq) else 0
    rules: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    spans = np.ones(base, np.int64)
    live = np.ones(len(seq), bool)  # the pair that begins here may be frequent
    while len(seq) > 1:
        live[-1] = False
        at = np.flatnonzero(live)
        key = (seq[at].astype(np.int64) << 32) | seq[at + 1]
        slot = _slots(key, bits)
        maybe = (np.bincount(slot, minlength=1 << bits) >= least)[slot]
        live[at[~maybe]] = False
        at, key = at[maybe], key[maybe]
        if not len(at):
            break
        # of a run of one pair every second place counts
        follows = np.zeros(len(at), bool)
        follows[1:] = (key[1:] == key[:-1]) & (at[1:] == at[:-1] + 1)
        starts = np.flatnonzero(~follows)
        counted = (np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))) % 2 == 0
        at, key = at[counted], key[counted]
        pairs, n = np.unique(key, return_counts=True)
        pairs, n = pairs[n >= least], n[n >= least]
        if not len(pairs):
            break
        # which pair stands at each place: by a table, and by search where two pairs share a slot
        table = np.zeros(1 << bits, np.int32)
        table[_slots(pairs, bits)] = np.arange(len(pairs), dtype=np.int32)
        which = table[_slots(key, bits)]
        other = np.flatnonzero(pairs[which] != key)
        which[other] = np.minimum(np.searchsorted(pairs, key[other]), len(pairs) - 1)
        frequent = pairs[which] == key
        live[at[~frequent]] = False
        at, which = at[frequent], which[frequent]
        rank = np.empty(len(pairs), np.int32)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(pairs), dtype=np.int32)
        r, overlap = rank[which], np.diff(at) == 1
        first = np.ones(len(at), bool)
        first[1:] &= ~overlap | (r[1:] < r[:-1])
        first[:-1] &= ~overlap | (r[:-1] < r[1:])
        at, which = at[first], which[first]
        enough = np.bincount(which, minlength=len(pairs)) >= least
        made = pairs[enough]
        code = np.full(len(pairs), -1, np.int64)
        code[enough] = len(spans) + np.arange(len(made))
        at, code = at[enough[which]], code[which[enough[which]]]
        rules.append(np.stack([made >> 32, made & 0xFFFFFFFF], 1))
        spans = np.concatenate([spans, spans[rules[-1][:, 0]] + spans[rules[-1][:, 1]]])
        seq[at] = code
        left = np.ones(len(seq), bool)
        left[at + 1] = False
        seq, live = seq[left], live[left]
        new = at - np.arange(len(at))  # each replaced pair before it took one place
        live[new] = True
        live[np.maximum(new - 1, 0)] = True
    return base, np.concatenate(rules).astype("<u4"), spans[base:].astype("<u4"), seq


class Block:
    """Random access into one stored block."""

    def __init__(self, row: dict):
        self.base = row["base"]
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64)
        self.expansions = np.frombuffer(row["expansions"], "<u4").astype(np.int64)
        self.sequence = np.frombuffer(row["sequence"], "<u4" if row["wide"] else "<u2")
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.doc_ends = np.cumsum(np.frombuffer(row["doc_lengths"], "<u4"), dtype=np.int64)
        spans = np.ones(self.base + len(self.expansions), np.int64)
        spans[self.base :] = self.expansions
        self._spans = spans
        self.ends = np.cumsum(spans[self.sequence])
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def _expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """All symbols' expansions in one array, and where each begins."""
        if self._flat is None:
            begin = np.concatenate([[0], np.cumsum(self._spans)[:-1]])
            flat = np.zeros(int(self._spans.sum()), np.uint32)
            flat[: self.base] = np.arange(self.base)
            for k, (a, b) in enumerate(self.rules):
                at, n, m = begin[self.base + k], self._spans[a], self._spans[b]
                flat[at : at + n] = flat[begin[a] : begin[a] + n]
                flat[at + n : at + n + m] = flat[begin[b] : begin[b] + m]
            self._flat = flat, begin
        return self._flat

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from start to stop; only the symbols that cover them are expanded."""
        total = int(self.ends[-1]) if len(self.ends) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        part = self.sequence[i:j].astype(np.int64)
        flat, begin = self._expanded()
        n = self._spans[part]
        ends = np.cumsum(n)
        out = flat[np.repeat(begin[part] - (ends - n), n) + np.arange(ends[-1])]
        skip = start - (int(self.ends[i - 1]) if i else 0)
        return out[skip : skip + stop - start]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.doc_ends[k - 1]) if k else 0, int(self.doc_ends[k]))


def blocks(docs: DataFrame, tokenizer: str, end_id: int = 0, block_ids: int = 500_000, least: int = 16) -> DataFrame:
    """The blocks of docs (doc_id, text), in shards by ranges of doc_id.

    Null text counts as empty: the end id alone. A null doc_id is stored as the smallest
    integer. Repeated doc_ids are documents of their own, in the order of their texts'
    hashes. A document is never cut, so a very long one makes a larger block."""

    def encode(batches):
        from pyspark import TaskContext

        shard, block, before = TaskContext.get().partitionId(), 0, 0
        end = np.uint32(end_id).astype("<u4").tobytes()
        doc_ids: list[int] = []
        parts: list[bytes] = []
        size = 0

        def full():
            nonlocal block, before
            ids = np.frombuffer(b"".join(parts), "<u4")
            base, rules, expansions, seq = compress(ids, least)
            wide = base + len(rules) > 1 << 16
            row = (shard, block, before, len(ids), np.array(doc_ids, "<i8").tobytes(), np.array([len(p) // 4 for p in parts], "<u4").tobytes(), base, rules.tobytes(), expansions.tobytes(), seq.astype("<u4" if wide else "<u2").tobytes(), wide)
            block, before = block + 1, before + len(ids)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _BLOCK_ARROW.types, strict=True)], schema=_BLOCK_ARROW)

        for doc_id, ids in encoded(batches, tokenizer, pieces=PIECES):
            doc_ids.append(-(1 << 63) if doc_id is None else doc_id)
            parts.append(ids + end)
            size += len(ids) // 4 + 1
            if size >= block_ids:
                yield full()
                doc_ids, parts, size = [], [], 0
        if parts:
            yield full()

    order = ["doc_id", F.xxhash64("text")]
    ranged = whole_texts(docs).select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(tidy(encode), BLOCK_SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Writes the blocks as files under path."""
    blocks(docs, tokenizer, **options).write.option("compression", "zstd").parquet(path)


def documents(files: DataFrame) -> DataFrame:
    """Each document of stored blocks, decoded: doc_id, start (ids of all before it),
    n_tokens, ids_crc32. Only a total for each shard (a task's output) meets on the driver."""
    spark = files.sparkSession
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    starts, so_far = [], 0
    for row in sorted(totals):
        starts.append((row["shard"], so_far))
        so_far += row["n"]
    begin = F.broadcast(spark.createDataFrame(starts, "shard int, shard_start long"))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                ids = block.ids().astype("<u4").tobytes()
                ends = block.doc_ends
                lengths = np.diff(ends, prepend=0)
                crcs = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids), pa.array(row["shard_start"] + row["ids_before"] + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], schema=out)

    found = files.join(begin, "shard").mapInArrow(tidy(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-(1 << 63)), F.col("doc_id")))


def written(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the files in the shared folder and gives the documents read back from them."""
    return documents(stored(blocks(docs, tokenizer), "repair"))
