"""Operator 1: benchmark decontamination with a distributed positional inverted index.

build() stores the postings of all training words: documents are laid end to end in
segments of about segment_words words (documents are never cut), with an empty place
between two, and each segment stores for each of its words the places where it stands.
A segment is a unit of work and of recovery; nothing is gathered over all documents but
the words' counts, and of those only the query's words.

search() takes phrases as tuples of words. For each it starts from the corpus-rarest
word's list, shifts lists by the word's offset in the phrase and intersects, next rarest
first, so common words' lists are only opened where the rare ones agree. near() finds
places where all words of a set stand within a span.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, give_back, stored, tidy, whole_texts

INDEX = "segment long, word binary, n long, places binary, doc_ids binary, starts binary"
_INDEX = pa.schema([("segment", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("places", pa.binary()), ("doc_ids", pa.binary()), ("starts", pa.binary())])


def words(text: str | bytes | None) -> list[bytes]:
    """Lower-cased words: runs of digits, ASCII letters and non-ASCII characters."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(ALNUM).split()


class _Codes(dict):
    """word -> code, in the order in which words are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _narrow(gaps: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words' gaps between places, counts[i] > 0 of word i, in the smallest of 1, 2 or 4
    bytes that holds all of a word, after a byte that tells: bytes of all words, and where
    each word's begin (and the last one's end)."""
    firsts = np.cumsum(counts) - counts
    most = np.maximum.reduceat(gaps, firsts) if len(counts) else gaps
    width = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    begin = np.concatenate([[0], np.cumsum(1 + width * counts)])
    out = np.empty(begin[-1], np.uint8)
    out[begin[:-1]] = width
    each = np.repeat(width, counts)
    at = np.repeat(begin[:-1] + 1 - width * firsts, counts) + each * np.arange(len(gaps))
    for w in (1, 2, 4):
        mine = np.flatnonzero(each == w)
        out[at[mine][:, None] + np.arange(w)] = gaps[mine].astype(f"<u{w}").view(np.uint8).reshape(-1, w)
    return out, begin


def _binaries(data: np.ndarray, begin: np.ndarray) -> pa.Array:
    """An Arrow array of the stretches of data between neighbours of begin."""
    offsets = pa.py_buffer((begin - begin[0]).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, offsets, pa.py_buffer(data[begin[0] : begin[-1]].tobytes())])


def _by_code(flat: np.ndarray) -> np.ndarray:
    """The stable order of int32 codes, by their halves: of 16 bits numpy sorts by digits."""
    order = np.argsort((flat & 0xFFFF).astype(np.uint16), kind="stable")
    if len(flat) and int(flat.max()) >> 16:
        order = order[np.argsort((flat >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def _places(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{data[0]}", offset=1), dtype=np.int64)


def _segment(segment: int, doc_ids: list[int], starts: list[int], ids: list[np.ndarray], total: int, vocabulary: list[bytes]):
    """Index rows of a segment: one for each word, and one (word null) for the documents."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    at = np.concatenate([np.arange(s, s + len(x), dtype=np.int64) for s, x in zip(starts, ids, strict=True)]) if ids else np.zeros(0, np.int64)
    at = at[_by_code(flat)]
    counts = np.bincount(flat, minlength=len(vocabulary))  # each word stands somewhere
    gaps = np.diff(at, prepend=0)
    firsts = np.cumsum(counts) - counts
    gaps[firsts] = at[firsts]
    data, begin = _narrow(gaps, counts)
    n = len(vocabulary)
    bounds = np.array([*starts, total], "<i8").tobytes()
    missing = [x is None for x in doc_ids]
    keys = np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes() + np.array(missing, "u1").tobytes()
    for lo in range(0, n, 20_000):
        k = min(n, lo + 20_000) - lo
        yield pa.RecordBatch.from_arrays([pa.array([segment] * k, pa.int64()), pa.array(vocabulary[lo : lo + k], pa.binary()), pa.array(counts[lo : lo + k]), _binaries(data, begin[lo : lo + k + 1]), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], schema=_INDEX)
    yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.nulls(1, pa.binary()), pa.array([len(doc_ids)], pa.int64()), pa.nulls(1, pa.binary()), pa.array([keys], pa.binary()), pa.array([bounds], pa.binary())], schema=_INDEX)


def build(docs: DataFrame, segment_words: int = 1_000_000) -> DataFrame:
    """The stored index of docs (doc_id, text). Null or wordless texts have a document entry only."""

    def index(batches):
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        doc_ids, starts, ids, total = [], [], [], 0
        codes = _Codes()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                found = words(text.as_py())
                doc_ids.append(doc_id)
                starts.append(total)
                ids.append(np.fromiter(map(codes.__getitem__, found), np.int32, len(found)))
                total += len(found) + 1
                if total >= segment_words:
                    yield from _segment(segment, doc_ids, starts, ids, total, list(codes))
                    segment, doc_ids, starts, ids, total, codes = segment + 1, [], [], [], 0, _Codes()
        if doc_ids:
            yield from _segment(segment, doc_ids, starts, ids, total, list(codes))

    return stored(whole_texts(docs).select("doc_id", "text").mapInArrow(tidy(index), INDEX), "index")


def phrases_of(text: str | bytes | None, window: int) -> list[tuple[bytes, ...]]:
    """All runs of `window` words of one text, as windows() has them; of fewer words, but not none, the one phrase of all."""
    found = words(text)
    if not found:
        return []
    return list(dict.fromkeys(tuple(found[i : i + window]) for i in range(max(1, len(found) - window + 1))))


def _intersect(phrase: tuple[bytes, ...], order: list[int], lists) -> np.ndarray:
    """First places of the phrase: offset-adjusted lists, from the rarest word on."""
    at = lists(phrase[order[0]]) - order[0]
    for k in order[1:]:
        if not len(at):
            break
        other = lists(phrase[k])
        if not len(other):
            return other
        i = np.searchsorted(other, at + k)
        i[i == len(other)] = 0
        at = at[other[i] == at + k]
    return at


SPANS = "segment long, place long, doc_id long, n_words long, hits binary, n_hit long, items array<long>"


def search(index: DataFrame, items: list[tuple[int, list[tuple[bytes, ...]]]]) -> DataFrame:
    """A row for each document: segment and place (where the index has it), doc_id, n_words,
    hits (int32 pairs: first word and word after the last of each hit run, ascending, not
    overlapping), n_hit (words in them) and items, ascending.

    items: (item_id, phrases as tuples of words). They are held by the driver and every
    task, so their number is the caller's to bound (contamination() deals them in blocks)."""
    phrases: dict[tuple[bytes, ...], list[int]] = {}
    for item_id, its in items:
        for p in its:
            phrases.setdefault(p, []).append(item_id)
    return _found(index, phrases)


def _found(index: DataFrame, phrases: dict[tuple[bytes, ...], list[int]]) -> DataFrame:
    spark = index.sparkSession
    vocabulary = spark.createDataFrame([(bytearray(w),) for w in {w for p in phrases for w in p}], "word binary")
    needed = index.filter("word IS NOT NULL").join(F.broadcast(vocabulary), "word", "left_semi")
    counts = {bytes(r["word"]): r["n"] for r in needed.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    plan = [(p, sorted(range(len(p)), key=lambda k: (counts.get(p[k], 0), k)), sorted(set(who))) for p, who in phrases.items() if all(w in counts for w in p)]
    by_anchor: dict[bytes, list] = {}
    for p, order, who in plan:
        by_anchor.setdefault(p[order[0]], []).append((p, order, who))
    shared = spark.sparkContext.broadcast(by_anchor)
    out = pa.schema([("segment", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.binary()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64()))])

    def match(table: pa.Table) -> pa.Table:
        try:
            return matched(table)
        finally:
            give_back()

    def matched(table: pa.Table) -> pa.Table:
        stored_lists, cache, documents = {}, {}, None
        for word, places, keys, starts, segment in zip(*(table.column(c).to_pylist() for c in ("word", "places", "doc_ids", "starts", "segment")), strict=True):
            if word is None:
                documents = keys, np.frombuffer(starts, "<i8"), segment
            else:
                stored_lists[word] = places
        keys, bounds, segment = documents
        n = len(bounds) - 1

        def lists(word: bytes) -> np.ndarray:
            if word not in cache:
                cache[word] = _places(stored_lists[word]) if word in stored_lists else np.zeros(0, np.int64)
            return cache[word]

        found: list[set[int]] = [set() for _ in range(n)]
        hit = np.zeros(int(bounds[-1]) + 1, np.int32)
        for anchor in by_anchor_of(shared, stored_lists):
            for phrase, order, who in shared.value[anchor]:
                at = _intersect(phrase, order, lists)
                if len(at):
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + len(phrase), -1)
                    for d in np.unique(np.searchsorted(bounds, at, "right") - 1).tolist():
                        found[d].update(who)
        covered = np.concatenate([[0], (np.cumsum(hit) > 0).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(covered))
        first, last = edge[::2], edge[1::2]
        # runs end at the latest in the empty place before the next document
        owner = np.searchsorted(bounds, first, "right") - 1
        runs = np.stack([first - bounds[owner], last - bounds[owner]], 1).astype("<i4")
        cuts = np.searchsorted(owner, np.arange(n + 1))
        n_hit = np.diff(np.concatenate([[0], np.cumsum(last - first)])[cuts])
        ids = np.frombuffer(keys, "<i8", n)
        null = np.frombuffer(keys, "u1", offset=8 * n).astype(bool)
        return pa.Table.from_arrays([pa.array(np.full(n, segment)), pa.array(np.arange(n)), pa.array(ids, mask=null), pa.array(np.diff(bounds) - 1), pa.array([runs[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()), pa.array(n_hit), pa.array([sorted(f) for f in found], pa.list_(pa.int64()))], schema=out)

    rows = index.filter("word IS NULL").unionByName(needed)
    return rows.groupBy("segment").applyInArrow(match, SPANS)


def by_anchor_of(shared, stored_lists) -> list[bytes]:
    """The rarest words that this segment has, out of whichever set is smaller."""
    anchors = shared.value
    return [w for w in anchors if w in stored_lists] if len(anchors) <= len(stored_lists) else [w for w in stored_lists if w in anchors]


def near(index: DataFrame, query: list[bytes], span: int) -> DataFrame:
    """Proximity: documents where all words of the query (any order) stand within `span`
    consecutive words: doc_id, first (the first place of the leftmost such stretch)."""
    spark = index.sparkSession
    wanted = list(dict.fromkeys(query))
    needed = index.filter("word IS NOT NULL").join(F.broadcast(spark.createDataFrame([(bytearray(w),) for w in wanted], "word binary")), "word", "left_semi")
    out = pa.schema([("doc_id", pa.int64()), ("first", pa.int64())])

    def match(table: pa.Table) -> pa.Table:
        lists, documents = {}, None
        for word, places, keys, starts in zip(*(table.column(c).to_pylist() for c in ("word", "places", "doc_ids", "starts")), strict=True):
            if word is None:
                documents = keys, np.frombuffer(starts, "<i8")
            else:
                lists[word] = _places(places)
        keys, bounds = documents
        n, hits = len(bounds) - 1, {}
        if len(lists) == len(wanted):
            # a stretch can begin at any place of a query word; the others must follow within span
            begins = np.sort(np.concatenate(list(lists.values())))
            end = begins
            for places in lists.values():
                i = np.searchsorted(places, begins)
                nxt = np.append(places, np.iinfo(np.int64).max // 2)[i]
                end = np.maximum(end, nxt)
            owner = np.searchsorted(bounds, begins, "right") - 1
            good = (end - begins < span) & (end < bounds[owner + 1] - 1)
            for d, at in zip(owner[good].tolist(), begins[good].tolist(), strict=True):
                hits.setdefault(d, at - int(bounds[d]))
        ids = np.frombuffer(keys, "<i8", n)
        null = np.frombuffer(keys, "u1", offset=8 * n)
        return pa.Table.from_arrays([pa.array([None if null[d] else int(ids[d]) for d in hits], pa.int64()), pa.array(list(hits.values()), pa.int64())], schema=out)

    rows = index.filter("word IS NULL").unionByName(needed)
    return rows.groupBy("segment").applyInArrow(match, "doc_id long, first long")


_UPPER = "".join(map(chr, range(65, 91)))


def windows(items: DataFrame, window: int) -> DataFrame:
    """phrase (array of words), who: the distinct phrases_of() the texts of items (item_id,
    item_text), each with the items that have it."""
    lower = F.translate("item_text", _UPPER, _UPPER.lower())
    said = items.select("item_id", F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)).alias("w")).filter(F.size("w") > 0)
    firsts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    each = said.select("item_id", "w", F.explode(firsts).alias("at")).select("item_id", F.slice("w", F.col("at"), F.lit(window)).alias("phrase"))
    return each.groupBy("phrase").agg(F.collect_set("item_id").alias("who"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.05, block_phrases: int = 200_000) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, n_items, items (ascending item_ids),
    hits (as in search()), contaminated: n_hit > 0 and n_hit >= share * n_words.

    The benchmark's phrases are made in Spark and searched for in blocks of about
    block_phrases, so what the driver and a task hold of it does not grow with it; a
    document's hits are united over the blocks. Null or wordless texts and items have no
    hits. Repeated rows are judged each; of repeated item_ids the texts' windows count for
    that item; items without an id are left out."""
    index = build(docs)
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).filter("item_id IS NOT NULL AND item_text IS NOT NULL")
    phrases = windows(tests, window)
    phrases = stored(phrases.select("phrase", F.array_sort("who").alias("who"), F.xxhash64("phrase").alias("lot")), "phrases")
    n_blocks = max(1, -(-phrases.count() // block_phrases))
    found = None
    for k in range(n_blocks):
        part = phrases.filter(F.pmod("lot", F.lit(n_blocks)) == k) if n_blocks > 1 else phrases
        word = lru_cache(None)(str.encode)  # one copy of a word that stands in many phrases
        block = _found(index, {tuple(map(word, r["phrase"])): r["who"] for r in part.toLocalIterator()})
        if n_blocks > 1:
            block = stored(block, "hits")
        found = block if found is None else found.unionByName(block)
    judged = ((F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(share) * F.col("n_words"))).alias("contaminated")
    columns = ["doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "hits", judged]
    if n_blocks == 1:  # nothing to unite, and no second Python worker for a task
        return found.select(*columns)
    found = found.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("hits").alias("all_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    @F.pandas_udf("struct<hits: binary, n_hit: long>")
    def united(all_hits):
        import pandas as pd

        hits, counts = [], []
        for parts in all_hits:
            runs = sorted(map(tuple, np.frombuffer(b"".join(parts), "<i4").reshape(-1, 2).tolist()))
            out: list[list[int]] = []
            for a, b in runs:
                if out and a <= out[-1][1]:
                    out[-1][1] = max(b, out[-1][1])
                else:
                    out.append([a, b])
            hits.append(np.array(out, "<i4").tobytes())
            counts.append(sum(b - a for a, b in out))
        return pd.DataFrame({"hits": hits, "n_hit": counts})

    done = found.withColumn("u", united("all_hits"))
    return done.select("doc_id", "n_words", "u.n_hit", "items", "u.hits").select(*columns)
