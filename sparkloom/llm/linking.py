"""Connected components, and components of the confirmed pairs among rows that share a
key. DataFrame operations only; links and components never come to the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """v, comp of all ends of edges (a, b): comp is the least id reachable.

    Union-find as alternating stars: every vertex hangs its larger neighbours (large
    star), then its smaller ones and itself (small star), under the least it knows. A
    vertex of many edges meets partial minima before a shuffle. Ends when all are stars,
    each vertex under one root, after about log(vertices) rounds."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = stored(small.filter("u <> v").distinct(), "stars")
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("under"), F.lit(0).alias("over")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("under"), F.lit(1).alias("over")))
        if ends.groupBy("x").agg(F.sum("under").alias("under"), F.max("over").alias("over")).filter("under + over > 1").isEmpty():
            break
    roots = e.select(F.col("v").alias("v"), F.col("v").alias("comp"))
    return e.select(F.col("u").alias("v"), F.col("v").alias("comp")).unionByName(roots).distinct()


def linked(postings: DataFrame, confirm: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame], near: Callable[[Column, Column], Column] | None = None, rounds: int = 2, hubs: int = 1, known: DataFrame | None = None) -> DataFrame:
    """v, comp of the rows in components of at least two, where rows of postings (key, v
    and, for near, x, a struct that tells about v) that share a key and pass near() and
    confirm() are linked. Links (a, b) in known, of these rows or others, hold without them.

    near takes two x and must hold for every link; it is the condition of the joins, so
    pairs that fail it are never made. confirm takes pairs (a, b), a < b, and gives the
    links. First, in some rounds, each row is paired with `hubs` rows of each of its keys,
    which joins most of a large group at the cost of its size. Then finish gets the rows
    (key, v, x, comp) of the keys that still have several components, and gives links
    (a, b) that connect all that are linked, so no link between components is lost."""
    labels = tested = None

    def labelled() -> DataFrame:
        if labels is None:
            return postings.withColumn("comp", F.col("v"))
        return postings.join(labels, "v", "left").withColumn("comp", F.coalesce("comp", "v"))

    def joined(links: DataFrame) -> DataFrame:
        """The components with the links added: those so far are stars of few rounds."""
        before = known if labels is None else labels.select(F.col("v").alias("a"), F.col("comp").alias("b"))
        return components(links if before is None else links.unionByName(before))

    about = ["v", "comp"] + ["x"] * (near is not None)
    for k in range(rounds):
        p = labelled()
        hub = [F.min_by(F.struct(*about), F.xxhash64(F.lit(k * hubs + j), "v")) for j in range(hubs)]
        keys = p.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.array(*hub).alias("hubs")).filter("lo <> hi")
        keys = keys.select("key", F.explode(F.array_distinct("hubs")).alias("hub"))
        ok = (F.col("l.key") == F.col("r.key")) & (F.col("l.comp") != F.col("r.hub.comp"))
        ok = ok if near is None else ok & near(F.col("l.x"), F.col("r.hub.x"))
        pairs = p.alias("l").join(keys.alias("r"), ok).select(F.least("l.v", "r.hub.v").alias("a"), F.greatest("l.v", "r.hub.v").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        labels = joined(stored(confirm(pairs).select("a", "b"), "links"))
    p = labelled()
    keys = p.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    open_ = stored(p.join(keys, "key"), "open")
    if not open_.isEmpty():
        labels = joined(stored(finish(open_).select("a", "b"), "links"))
    if labels is None and known is not None:
        return components(known)
    if labels is None:
        return postings.select("v", F.col("v").alias("comp")).limit(0)
    return labels
