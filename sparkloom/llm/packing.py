"""Operator 3: best-fit packing by hierarchical residual packing.

Documents become token ids; one longer than a sequence is cut into pieces. Pieces are
dealt at random into groups; each group packs its own by best fit, largest first. Bins
that are nearly full are final there. All others go up as items: fan_in groups' bins (as
many groups as it takes for group_items items each) are packed in the next best-fit
round, and so on until one group is left, or a round that could not have fewer groups
joins less than one bin in a hundred. Bins are then final as they are, so no piece is
lost, and no task holds more than about group_items items.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy, whole_texts
from .tokens import encoded

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit, largest first: each item's bin and offset, and each bin's fill.

    Among the open bins the item goes to one with the least room that holds it. Bins are
    kept by their room; a bit mask of the rooms in use finds the least in a few steps."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    fills: list[int] = []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        n = sizes[i]
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        room -= n
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins, offsets, fills


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of docs (doc_id, text): null text counts as empty and has the end id alone."""

    def cut(batches):
        end = np.uint32(end_id).astype("<u4").tobytes()
        rows: list[tuple] = []
        for doc_id, ids in encoded(batches, tokenizer):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _PIECES.types, strict=True)], schema=_PIECES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _PIECES.types, strict=True)], schema=_PIECES)

    return whole_texts(docs).select("doc_id", "text").mapInArrow(tidy(cut), PIECES)


def _packer(level: int, capacity: int, slack: int):
    """Packs one group's items (size); adds bin, at, up (the bin isn't nearly full) and fill."""

    def pack(table: pa.Table) -> pa.Table:
        bins, offsets, fills = best_fit(table.column("size").to_pylist(), capacity)
        fill, bins_, group = np.array(fills, np.int64), np.array(bins, np.int64), table.column("g")[0].as_py()
        keep = table.drop_columns(["g", "size"])
        keep = keep.append_column("bin", pa.array((np.int64(level) << 58) + (np.int64(group) << 26) + bins_))
        keep = keep.append_column("at", pa.array(np.array(offsets, np.int64)))
        return keep.append_column("up", pa.array((fill < capacity - slack)[bins_])).append_column("fill", pa.array(fill[bins_]))

    return pack


def pack(items: DataFrame, capacity: int = 2048, group_items: int = 100_000, slack: int = 8, fan_in: int = 8) -> DataFrame:
    """items with a column length (1 to capacity): adds sequence_id and offset. No other
    column may be named size, g, bin, at, up or fill."""
    n = items.count()
    groups = max(1, -(-n // group_items))
    names = items.columns
    dealt = items.withColumn("size", F.col("length")).withColumn("g", F.pmod(F.xxhash64(*names), F.lit(groups)).cast("int"))
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema) + ", bin long, at long, up boolean, fill long"
    packed = dealt.groupBy("g").applyInArrow(_packer(0, capacity, slack), out)
    if groups == 1:
        return packed.select(*names, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    packed = stored(packed, "packed")

    def underfull(rows: DataFrame) -> tuple[DataFrame, int]:
        bins = rows.filter("up").select("bin", F.col("fill").alias("size")).distinct()
        return bins, bins.count()

    moved = None  # bin of the first round -> its bin so far, and its place there
    open_bins, n_open = underfull(packed)
    level = 0
    while groups > 1 and n_open > 1:
        level, fewer = level + 1, max(-(-groups // fan_in), -(-n_open // group_items))
        dealt = open_bins.withColumn("g", F.pmod(F.xxhash64(F.lit(level), "bin"), F.lit(fewer)).cast("int")).withColumnRenamed("bin", "was")
        step = stored(dealt.groupBy("g").applyInArrow(_packer(level, capacity, slack), "was long, bin long, at long, up boolean, fill long"), "merged")
        if moved is None:
            moved = step.select(F.col("was").alias("bin0"), F.col("bin").alias("last"), F.col("at").alias("base"))
        else:
            on = step.select(F.col("was").alias("last"), F.col("bin").alias("next"), F.col("at").alias("more"))
            moved = moved.join(on, "last", "left").select("bin0", F.coalesce("next", "last").alias("last"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        before = n_open
        open_bins, n_open = underfull(step)
        if fewer >= groups and n_open > 0.99 * before:
            break
        groups = fewer
    if moved is None:
        return packed.select(*names, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    rest = packed.filter("NOT up").select(*names, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    carried = packed.filter("up").join(moved.withColumnRenamed("bin0", "bin"), "bin")
    return rest.unionByName(carried.select(*names, F.col("last").alias("sequence_id"), (F.col("at") + F.col("base")).alias("offset")))


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, **options) -> DataFrame:
    """The pieces of docs, packed: PIECES with sequence_id and offset.

    Repeated rows are pieces of their own. No document gives no row."""
    return pack(stored(pieces(docs, tokenizer, capacity), "pieces"), capacity, **options)
