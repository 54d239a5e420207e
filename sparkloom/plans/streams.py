"""Streaming queries, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.plans.serving import _RATE as RATE
from sparkloom.plans.text import _LINES as LINES
from sparkloom.streaming import feeds


def stream_loop_feed(spark, sf_dir):
    rows = feeds.fragments_of(feeds.source(spark, sf_dir, "documents").withColumn("turn", F.lit(0)), "doc_id", "turn")
    return feeds.run_to_end(feeds.detect(rows), "loop-feed")


def stream_rate_limit(spark, sf_dir):
    e = feeds.source(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return feeds.revised_to_end(feeds.admit(e, 3_600_000_000, 2), "rate-limit", ["client", "id"])


def stream_windowed_counts(spark, sf_dir):
    return feeds.counts_to_end(feeds.windowed_counts(feeds.source(spark, sf_dir, "events"), late=None), "windowed-counts")


QUERIES = {f.__name__: f for f in (stream_loop_feed, stream_rate_limit, stream_windowed_counts)}

#: Each stream gives what the same operator gives in one batch.
ORACLE_SQL = {
    "stream_loop_feed": f"WITH {LINES} SELECT doc_id AS key, 0 AS seq, arg_min(line, pos) AS line, arg_min(match_count, pos) AS match_count, 'escape' AS action FROM h GROUP BY doc_id",
    "stream_rate_limit": f"SELECT user_id AS client, event_id AS id, hits, hits <= 2 AS allowed FROM ({RATE})",
    "stream_windowed_counts": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
