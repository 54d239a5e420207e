"""Operator 2: approximate nearest neighbours by cross-polytope hashing.

Vectors become unit vectors in which the nearest in angle is the largest inner product: a
data vector is divided by the largest norm of its band and filled up by one more
component, a query is normalised. Bands hold norms that differ by less than STEP, so that
the filling stays small beside the vector; a table of equal norms is one band. In each of
`tables` tables a fast pseudo-rotation (three rounds of random signs and a Hadamard
transform) turns them, and a vector falls into the bucket of its nearest signed axis. A
query looks into `probes` buckets for each band, those of all bands where the product of
norm and nearness to the signed axis is largest (bands of large norms are so looked into
more deeply than those of small ones), and all found there are scored on the original vectors in double precision. A query that
finds fewer than k is scored against all rows, in blocks. All this is alike for tables of
every size.

Equal vectors are one class, which keeps its least ids only: as many as a query can
return, and one more, since ties go to smaller ids. So a vector that a third of all rows
share costs no more than any other. Buckets are dealt in blocks of at most block_rows
classes and queries; each block gives a query's best only, which is exact, as the best
of all are among the bests of the blocks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy


STEP, BANDS = 0.85, 16  # the last band has all smaller norms


@lru_cache(8)
def _signs(dims: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (tables, 3, dims))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; the last axis is a power of two."""
    n, h = x.shape[-1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(-1, n // (2 * h), 2, h)
        a, b = y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]
        x = np.stack([a, b], 2).reshape(-1, n)
        h *= 2
    return x / np.float32(np.sqrt(n))


def rotated(x: np.ndarray, table: int, tables: int, seed: int = 5) -> np.ndarray:
    """Rows after the table's pseudo-rotation, with zeros up to a power of two."""
    dims = 1 << max(1, x.shape[1] - 1).bit_length()
    x = np.pad(x.astype(np.float32), ((0, 0), (0, dims - x.shape[1])))
    for signs in _signs(dims, tables, seed)[table]:
        x = _hadamard(x * signs)
    return x


def axes(x: np.ndarray, most: int) -> np.ndarray:
    """The `most` nearest signed axes of each row, nearest first: 2 k or 2 k + 1 (negative)."""
    both = np.stack([x, -x], 2).reshape(len(x), -1)
    most = min(most, both.shape[1])
    part = np.argpartition(-both, most - 1, 1)[:, :most]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(both, part, 1), 1, kind="stable"), 1)


def probed(x: np.ndarray, tops: dict[int, float], probes: int) -> np.ndarray:
    """Of each rotated query the buckets (band * buckets + signed axis) to look into: `probes`
    for each band, dealt among the bands (band: largest norm) by norm times nearness."""
    both = np.stack([x, -x], 2).reshape(len(x), -1)
    bands, buckets = sorted(tops), both.shape[1]
    promise = np.hstack([both * tops[k] for k in bands])
    most = min(probes, buckets) * len(bands)
    part = np.argpartition(-promise, most - 1, 1)[:, :most]
    return np.array(bands)[part // buckets] * buckets + part % buckets


def _matrix(column, dims: int) -> np.ndarray:
    """Doubles of a column of arrays, filled with zeros to dims."""
    rows = [np.asarray(v, np.float64) for v in column.to_pylist()]
    return np.stack([np.pad(v, (0, dims - len(v))) for v in rows]) if rows else np.zeros((0, dims))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of the rows that take part: no null, nothing but
    finite components, not all zero."""
    e = F.col("embedding")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(e, lambda x: x != 0)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return v.filter(F.col("vec_id").isNotNull() & e.isNotNull()).filter(good & some)


def search(vectors: DataFrame, is_query, k: int = 20, tables: int = 8, probes: int = 28, block_rows: int = 8192) -> DataFrame:
    """For each row of vectors (vec_id, embedding) that fulfils is_query: its k nearest
    other rows found, as query_id, rank (from 1), vec_id, score (inner product).

    Rows that usable() leaves out take no part. Repeated vec_ids are one row each; a
    query never finds rows of its own id. A query has fewer than k rows only if there are no
    more others."""
    rows = usable(vectors).withColumns({"k1": F.xxhash64("embedding"), "k2": F.hash("embedding")})
    first = Window.partitionBy("k1", "k2").orderBy("vec_id")
    least = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    classes = least.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.filter(is_query).select("vec_id", "k1", "k2")
    own = asked.select("k1", "k2").distinct().withColumn("asked", F.lit(True))
    classes = classes.join(own, ["k1", "k2"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    classes = stored(classes.withColumn("c", F.xxhash64("k1", "k2")), "classes")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    n, longest, dims = classes.agg(F.count("*"), F.max(norm), F.max(F.size("embedding"))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    buckets = 2 * (1 << max(1, dims).bit_length())  # of the vectors with one component more
    band = F.least(F.floor(F.log(norm / F.lit(longest)) / F.lit(float(np.log(STEP)))).cast("int"), F.lit(BANDS - 1))
    tops = {r["band"]: r["top"] for r in classes.groupBy(band.alias("band")).agg(F.max(norm).alias("top")).collect()}
    posting = pa.schema([("t", pa.int32()), ("bucket", pa.int32()), ("query", pa.bool_()), ("c", pa.int64()), ("least", pa.int64()), ("v", pa.binary())])

    def post(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                x = _matrix(b.column("embedding"), dims)
                c, least, ask = b.column("c").to_numpy(), b.column("least").to_numpy(), np.array(b.column("asked").to_pylist())
                raw = np.array([v.tobytes() for v in x], object)
                size = np.linalg.norm(x, axis=1, keepdims=True)
                own = b.column("band").to_numpy()
                top = np.array([tops[k] for k in own.tolist()])[:, None]
                data = np.hstack([x / top, np.sqrt(np.maximum(0, 1 - (size / top) ** 2))])
                query = np.hstack([x / size, np.zeros((len(x), 1))])[ask]
                for t in range(tables):
                    at = axes(rotated(data, t, tables), 1)[:, 0] + own * buckets
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(at.astype(np.int32)), pa.array(np.zeros(len(x), bool)), pa.array(c), pa.array(least), pa.array(raw, pa.binary())], schema=posting)
                    if len(query):
                        near = probed(rotated(query, t, tables), tops, probes)
                        m = near.shape[1]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(near.size, t, np.int32)), pa.array(near.ravel().astype(np.int32)), pa.array(np.ones(near.size, bool)), pa.array(np.repeat(c[ask], m)), pa.array(np.repeat(least[ask], m)), pa.array(np.repeat(raw[ask], m), pa.binary())], schema=posting)

    posted = classes.select("c", F.col("ids")[0].alias("least"), "asked", "embedding", band.alias("band")).mapInArrow(tidy(post), "t int, bucket int, query boolean, c long, least long, v binary")
    def in_blocks(posted: DataFrame, blocks: DataFrame) -> DataFrame:
        """posted, dealt: each block of a bucket's queries meets each block of its data."""
        spread = F.when(F.col("query"), F.sequence(F.lit(0), F.col("nd") - 1)).otherwise(F.sequence(F.lit(0), F.col("nq") - 1))
        dealt = posted.join(F.broadcast(blocks), ["t", "bucket"]).withColumn("other", F.explode(spread))
        qb = F.when(F.col("query"), F.pmod(F.xxhash64("c"), F.col("nq"))).otherwise(F.col("other"))
        db = F.when(F.col("query"), F.col("other")).otherwise(F.pmod(F.xxhash64("c"), F.col("nd")))
        return dealt.select("t", "bucket", qb.alias("qb"), db.alias("db"), "query", "c", "least", "v")

    # one row for a bucket: tables * buckets * bands of them at most
    blocks = posted.groupBy("t", "bucket").agg(F.ceil(F.count_if("query") / block_rows).alias("nq"), F.ceil(F.count_if(~F.col("query")) / block_rows).alias("nd"))
    dealt = in_blocks(posted, blocks.filter("nq > 0 AND nd > 0"))
    found = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("score", pa.float64()), ("least", pa.int64())])

    def best(table: pa.Table) -> pa.Table:
        ask = np.array(table.column("query").to_pylist(), bool)
        c, least = table.column("c").to_numpy(), table.column("least").to_numpy()
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), "<f8").reshape(len(ask), dims)
        q, d = np.flatnonzero(ask), np.flatnonzero(~ask)
        out = [[], [], [], []]
        for lo in range(0, len(q) if len(d) else 0, 256):
            part = q[lo : lo + 256]
            s = x[part] @ x[d].T
            m = min(k + 1, len(d))
            # all at least as good as the m-th, so that ties are decided by the ids
            edge = np.partition(s, len(d) - m, 1)[:, len(d) - m]
            i, j = np.nonzero(s >= edge[:, None])
            order = np.lexsort((least[d[j]], -s[i, j], i))
            i, j = i[order], j[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[rank < m], j[rank < m]
            for col, add in zip(out, (c[part[i]], c[d[j]], s[i, j], least[d[j]]), strict=True):
                col.append(add)
        return pa.Table.from_arrays([pa.array(np.concatenate(col) if col else [], t) for col, t in zip(out, found.types, strict=True)], schema=found)

    result, top = "q long, c long, score double, least long", Window.partitionBy("q").orderBy(F.desc("score"), "least")

    def bests(dealt: DataFrame) -> DataFrame:
        pairs = dealt.groupBy("t", "bucket", "qb", "db").applyInArrow(best, result)
        pairs = pairs.groupBy("q", "c").agg(F.max("score").alias("score"), F.first("least").alias("least"))
        return pairs.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k + 1).select("q", "c", "score")

    pairs = stored(bests(dealt), "nearest")
    # a query's own class may hold no other row, so k + 1 ids are enough
    enough = pairs.join(classes.select("c", F.size("ids").alias("n")), "c").groupBy("q").agg(F.sum("n").alias("n")).filter(F.col("n") > k).select("q")
    short = stored(classes.filter("asked").select(F.col("c").alias("q")).join(enough, "q", "left_anti"), "short")
    n_short = short.count()
    if n_short:
        once = posted.filter("t = 0")
        ask = once.filter("query").join(short.select(F.col("q").alias("c")), "c", "left_semi").dropDuplicates(["c"])
        every = once.filter("NOT query").unionByName(ask).withColumns({"t": F.lit(-1), "bucket": F.lit(0)})
        all_blocks = vectors.sparkSession.createDataFrame([(-1, 0, -(-n_short // block_rows), -(-n // block_rows))], "t int, bucket int, nq long, nd long")
        pairs = pairs.join(short, "q", "left_anti").unionByName(bests(in_blocks(every, all_blocks)))
    ids = pairs.join(classes.select("c", "ids"), "c").groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "c", "ids"))).alias("near"))
    each = F.array_sort(F.flatten(F.transform("near", lambda y: F.transform(y["ids"], lambda i: F.struct(y["s"].alias("s"), i.alias("id"))))))
    answers = asked.withColumn("q", F.xxhash64("k1", "k2")).join(ids.select("q", each.alias("near")), "q")
    others = F.slice(F.filter("near", lambda y: y["id"] != F.col("vec_id")), 1, k)
    rows = answers.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("p", "y"))
    return rows.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("y.id").alias("vec_id"), (-F.col("y.s")).alias("score"))
