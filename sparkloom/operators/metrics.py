"""Service metrics: histograms, quantiles, rates, sessions, batches, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import settled

#: Upper bounds of the duration buckets, in seconds.
BOUNDS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0]


def histogram(events: DataFrame, by: str, value: str, bounds: list[float] = BOUNDS) -> DataFrame:
    """by, le, n: how many values are at most le (null: any). One pass, one small shuffle."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_{k}") for k, b in enumerate(bounds)]
    wide = events.groupBy(by).agg(*counts, F.count(value).alias("_all"))
    pairs = [F.struct(F.lit(b).alias("le"), F.col(f"_{k}").alias("n")) for k, b in enumerate(bounds)]
    return wide.select(by, F.explode(F.array(*pairs, F.struct(F.lit(None).cast("double").alias("le"), F.col("_all").alias("n")))).alias("b")).select(by, "b.*")


def quantile(hist: DataFrame, by: str, q: float) -> DataFrame:
    """Linear interpolation within the bucket that holds the quantile; values beyond the
    last bound give that bound."""
    order = Window.partitionBy(by).orderBy(F.col("le").asc_nulls_last())
    total = F.max("n").over(Window.partitionBy(by))
    h = hist.withColumns({"_lo": F.coalesce(F.lag("le").over(order), F.lit(0.0)), "_below": F.coalesce(F.lag("n").over(order), F.lit(0)), "_want": total * q})
    first = h.filter((F.col("n") >= F.col("_want")) & (F.col("n") > 0)).groupBy(by).agg(F.min_by(F.struct("le", "n", "_lo", "_below", "_want"), F.coalesce("le", F.lit(float("inf")))).alias("h"))
    inside = F.col("h._lo") + (F.col("h.le") - F.col("h._lo")) * (F.col("h._want") - F.col("h._below")) / F.nullif(F.col("h.n") - F.col("h._below"), F.lit(0))
    return first.select(by, F.round(F.when(F.col("h.le").isNull(), F.col("h._lo")).otherwise(inside), 6).alias("value"))


def error_rates(events: DataFrame, failed, seconds: int = 300) -> DataFrame:
    """A row for each window of time: start (epoch seconds), requests, errors, rates."""
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000)) * seconds
    g = events.groupBy(start.cast("long").alias("start")).agg(F.count("*").alias("requests"), F.count_if(failed).alias("errors"))
    return g.withColumns({"per_second": F.round(F.col("requests") / seconds, 6), "error_rate": F.round(F.col("errors") / F.col("requests"), 6)})


def sessions(events: DataFrame, by: str, gap_seconds: int) -> DataFrame:
    """by, session (from 1), first_us, last_us, n: a new one after more than the gap."""
    order = Window.partitionBy(by).orderBy("_t")
    e = events.withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    new = F.when(F.col("_t") - F.lag("_t").over(order) <= gap_seconds * 1_000_000, 0).otherwise(1)
    e = e.withColumn("_new", new).withColumn("session", F.sum("_new").over(order).cast("int"))
    return e.groupBy(by, "session").agg(F.min("_t").alias("first_us"), F.max("_t").alias("last_us"), F.count("*").alias("n"))


def gaps(events: DataFrame, by: str, longer_than: int) -> DataFrame:
    """by, event_id, gap_s of events that come more than longer_than seconds after the last."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events.withColumn("gap_us", t - F.lag(t).over(Window.partitionBy(by).orderBy(t)))
    return e.filter(F.col("gap_us") > longer_than * 1_000_000).select(by, "event_id", F.round(F.col("gap_us") / 1e6, 3).alias("gap_s"))


def least_recent(events: DataFrame, by, keep: int) -> DataFrame:
    """slot, last_us, evicted: all but the `keep` slots used last."""
    used = events.groupBy(by.alias("slot")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_us"))
    return _numbered(used, [F.desc("last_us"), F.col("slot")]).withColumn("evicted", F.col("_n") >= keep).drop("_n")


def batches(requests: DataFrame, order: list, length: str, size: int) -> DataFrame:
    """Batches of `size` in the order: n, longest, total length and padding of each.

    The order runs over all requests; they are range-sorted and numbered by partition
    counts, not in one task."""
    numbered = _numbered(requests, order)
    g = numbered.groupBy(F.floor(F.col("_n") / size).cast("long").alias("batch")).agg(F.count("*").alias("n"), F.max(length).alias("longest"), F.sum(length).alias("total"))
    return g.withColumn("padding", F.col("n") * F.col("longest") - F.col("total"))


def _numbered(rows: DataFrame, order: list) -> DataFrame:
    """Adds _n, the place from 0 in the order. Only one count a partition meets in a window."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    ranged = settled(ranged).withColumn("_i", F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)).drop("_m")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"))
    return ranged.join(F.broadcast(before), "_p").withColumn("_n", F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")


def outcomes(requests: DataFrame, by, failed) -> DataFrame:
    return requests.groupBy(by.alias("batch")).agg(F.count("*").alias("n"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"))


def consensus(votes: DataFrame, by: str) -> DataFrame:
    """votes (by, a, b, arbiter, truth): two voters answer, and an arbiter where they differ
    (or one is silent). For each `by` the questions, how many were arbitrated, the share of
    agreement, and how often the final answer is right: over all, and where they agreed."""
    agreed = F.coalesce(F.col("a") == F.col("b"), F.lit(False))
    judged = votes.withColumns({"agreed": agreed, "right": F.coalesce(F.when(agreed, F.col("a")).otherwise(F.col("arbiter")) == F.col("truth"), F.lit(False)).cast("double")})
    share = {"consensus_rate": F.col("agreed").cast("double"), "accuracy": F.col("right"), "accuracy_agreed": F.when(F.col("agreed"), F.col("right"))}
    return judged.groupBy(by).agg(F.count("*").alias("questions"), F.count_if(~F.col("agreed")).alias("arbitrated"), *[F.round(F.avg(c), 6).alias(n) for n, c in share.items()])


def results_in_order(items: DataFrame, batch: str, order: str, result: Column, problem: Column) -> DataFrame:
    """A row for each batch: its items' results in order, each by itself: a problem (not
    null) makes that item an error and leaves the others as they are."""
    one = F.struct(F.col(order), problem.isNull().alias("ok"), F.when(problem.isNull(), result).alias("result"), problem.alias("error"))
    found = items.groupBy(batch).agg(F.array_sort(F.collect_list(one)).alias("results"))
    failed = F.size(F.filter("results", lambda r: ~r["ok"]))
    return found.select(batch, "results", (F.size("results") - failed).alias("succeeded"), failed.alias("failed"))


def accepted(requests: DataFrame, size: Column, most: int) -> DataFrame:
    """requests with status: 413 for a batch of more than `most`, 400 for an empty one, else 200."""
    n = F.coalesce(size, F.lit(0))
    return requests.withColumn("status", F.when(n > most, 413).when(n <= 0, 400).otherwise(200))


def exposition(counts: DataFrame, name: str, label: str, value: str) -> DataFrame:
    """Metric lines in text form: name{label="..."} value."""
    return counts.select(F.concat(F.lit(name + "{" + label + '="'), F.col(label), F.lit('"} '), F.col(value).cast("string")).alias("line"))
