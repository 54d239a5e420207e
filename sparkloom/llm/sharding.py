"""Operator 10: sharding by vector bin packing.

Rows with equal texts form a group with a vector (bytes, tokens, rows). Groups, largest
first, go each to the bin where the dot product of its vector with the residual
capacity is highest. The groups are dealt at random into parts; each part fills its own
n_shards bins, and the bins of the parts are the groups of the next level, until one
part is left: its bins are the shards. Equal texts stay in one shard, but for a group
that is too large for any: one with more than 1/n_shards of all bytes, tokens or rows is
split into chunks of about an eighth of that, placed one by one, so a hot text never needs
a task or more than its share of a shard. There are at most 3 n_shards such groups, the
only thing that is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

VECTOR = ("bytes", "tokens", "rows")
_KEY = ["k", "size", "text_crc32", "chunk"]


def place(vectors: np.ndarray, n_bins: int) -> np.ndarray:
    """Each vector's bin. Components are taken as shares of their totals."""
    total = np.maximum(vectors.sum(0), 1e-9)
    share = vectors / total
    room = np.full((n_bins, vectors.shape[1]), 1.0 / n_bins)
    out = np.zeros(len(vectors), np.int32)
    for i in np.argsort(-share.max(1), kind="stable").tolist():
        v = share[i]
        out[i] = b = int(np.argmax(room @ v))
        room[b] -= v
    return out


def rows_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) without the texts: size is the UTF-8 bytes plus 1. Null and
    empty text are two groups of size 1."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(
        docs["doc_id"].alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.xxhash64(docs["text"]).alias("k"),
        F.monotonically_increasing_id().alias("rid"),
    )


def _level(units: DataFrame, parts: int, n_bins: int) -> DataFrame:
    """units (unit, bytes, tokens, rows): adds up (the id of the part's bin)."""

    def fill(table: pa.Table) -> pa.Table:
        vectors = np.stack([table.column(c).to_numpy().astype(float) for c in VECTOR], 1)
        bins = place(vectors, n_bins).astype(np.int64) + table.column("p")[0].as_py() * n_bins
        return pa.table({"unit": table.column("unit"), **{c: table.column(c) for c in VECTOR}, "up": pa.array(bins)})

    dealt = units.withColumn("p", F.pmod(F.xxhash64("unit"), F.lit(parts)))
    return dealt.groupBy("p").applyInArrow(fill, "unit long, bytes long, tokens long, rows long, up long")


def sharded(docs: DataFrame, n_shards: int = 16, part_groups: int = 100_000, block_rows: int = 200_000) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, size, text_crc32, law (`bytes`: the
    shards' sizes are near equal), shard, slot (gapless from 0 in each shard) and
    grown_shard (null: not for this law). Repeated rows and doc_ids are rows of their
    own; of no rows come none."""
    rows = stored(rows_of(docs), "rows")
    key3 = ["k", "size", "text_crc32"]
    groups = rows.groupBy(key3).agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    n, total_bytes, total_tokens, n_groups = groups.agg(F.sum("rows"), F.sum("bytes"), F.sum("tokens"), F.count("*")).first()
    limit = n_shards
    share = F.greatest(*[F.col(c) * F.lit(limit) / F.lit(max(t or 0, 1)) for c, t in zip(VECTOR, (total_bytes, total_tokens, n), strict=True)])
    large = groups.filter((share > 1) & (F.col("rows") > 1)).select(*key3, F.ceil(8 * share).cast("long").alias("chunks"))
    chunk = F.coalesce(F.pmod(F.xxhash64("rid"), F.col("chunks")), F.lit(0).cast("long"))
    rows = rows.join(F.broadcast(large), key3, "left").withColumn("chunk", chunk).drop("chunks")
    rows = rows.withColumn("unit", F.xxhash64(*_KEY))
    units = rows.groupBy("unit").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    parts = max(1, -(-n_groups // part_groups))
    moved = None
    while True:
        step = stored(_level(units, parts, n_shards), "bins")
        now = step.select("unit", "up")
        moved = now if moved is None else moved.join(now.select(F.col("unit").alias("up"), F.col("up").alias("next")), "up").select("unit", F.col("next").alias("up"))
        if parts == 1:
            break
        units = step.groupBy(F.col("up").alias("unit")).agg(*[F.sum(c).alias(c) for c in VECTOR])
        parts = max(1, -(-(parts * n_shards) // part_groups))
    placed = rows.join(moved, "unit").select("doc_id", "size", "text_crc32", "rid", F.col("up").cast("int").alias("shard"))
    blocks = max(1, -(-(n or 0) // (n_shards * block_rows)))
    placed = placed.withColumn("b", F.pmod(F.xxhash64("rid"), F.lit(blocks)))
    counts = placed.groupBy("shard", "b").agg(F.count("*").alias("c"))
    before = counts.select("shard", "b", (F.sum("c").over(Window.partitionBy("shard").orderBy("b")) - F.col("c")).alias("before"))
    slot = F.row_number().over(Window.partitionBy("shard", "b").orderBy("rid")) - 1
    slotted = placed.withColumn("slot", slot.cast("long")).join(before, ["shard", "b"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
