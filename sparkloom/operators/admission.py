"""Who may be served: sliding-window limits, keys, checks in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hits_in_window(requests: DataFrame, client: str, micros: Column, order: str, window_us: int, counted: Column | None = None) -> DataFrame:
    """Adds hits: requests of the client less than the window old, up to and with this one
    in the order (time, order). Only rows where counted holds are hits.

    Rejected requests stay hits, so the count needs no recursion: a range frame, less the
    requests of the same instant that come later."""
    one = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    r = requests.withColumns({"_t": micros, "_one": one})
    within = Window.partitionBy(client).orderBy("_t").rangeBetween(-(window_us - 1), 0)
    later = Window.partitionBy(client, "_t").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    hits = F.sum("_one").over(within) - F.coalesce(F.sum("_one").over(later), F.lit(0))
    return r.withColumn("hits", (hits if window_us > 0 else F.col("_one")).cast("long")).drop("_t", "_one")


def limited(requests: DataFrame, client: str, micros: Column, order: str, window_us: int, most: int) -> DataFrame:
    """hits and allowed (hits <= most)."""
    return hits_in_window(requests, client, micros, order, window_us).withColumn("allowed", F.col("hits") <= most)


def authorised(requests: DataFrame, keys: DataFrame, any_keys: bool = True) -> DataFrame:
    """requests (auth_header, query_key) with allowed. A Bearer header decides alone;
    the query's key only counts without one. Without configured keys all are allowed."""
    if not any_keys:
        return requests.withColumn("allowed", F.lit(True))
    bearer = F.coalesce(F.startswith("auth_header", F.lit("Bearer ")), F.lit(False))
    used = F.when(bearer, F.expr("substring(auth_header, 8)")).otherwise(F.coalesce("query_key", F.lit("")))
    known = keys.select(F.col("key").alias("_used")).distinct().withColumn("_ok", F.lit(True))
    return requests.withColumn("_used", used).join(known, "_used", "left").withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_used", "_ok")


def validated(requests: DataFrame, client: str, micros: Column, order: str, max_chars: int = 50_000, window_us: int = 60_000_000, most: int = 30) -> DataFrame:
    """requests (authorised, valid_json, n_messages, total_chars, ready) with status, the
    first check that fails: 401, 400, 429, 503, else 200. What fails before the limit is
    no hit."""
    reaches = F.col("authorised") & F.col("valid_json") & (F.col("n_messages") > 0) & (F.col("total_chars") <= max_chars)
    r = hits_in_window(requests, client, micros, order, window_us, reaches)
    status = (
        F.when(~F.col("authorised"), 401)
        .when(~F.col("valid_json") | (F.col("n_messages") <= 0) | (F.col("total_chars") > max_chars), 400)
        .when(F.col("hits") > most, 429)
        .when(~F.col("ready"), 503)
        .otherwise(200)
    )
    return r.withColumn("status", status)
