"""Batch results and two-vote consensus on small cases."""

from pyspark.sql import functions as F

from sparkloom.operators import metrics


def test_results_keep_their_order_and_faults_stay_alone(spark):
    rows = [(1, 2, "c", None), (1, 0, "a", None), (1, 1, "b", "too long"), (2, 0, None, "empty")]
    df = spark.createDataFrame(rows, "batch long, place long, text string, fault string")
    got = {r["batch"]: r for r in metrics.results_in_order(df, "batch", "place", F.upper("text"), F.col("fault")).collect()}
    assert [(x["place"], x["ok"], x["result"], x["error"]) for x in got[1]["results"]] == [(0, True, "A", None), (1, False, None, "too long"), (2, True, "C", None)]
    assert (got[1]["succeeded"], got[1]["failed"], got[2]["succeeded"], got[2]["failed"]) == (2, 1, 0, 1)
    sizes = spark.createDataFrame([(None,), (0,), (3,), (4,)], "n int")
    assert [r["status"] for r in metrics.accepted(sizes, F.col("n"), 3).orderBy("n").collect()] == [400, 400, 200, 413]


def test_consensus(spark):
    votes = [("x", 1, 1, 0, 1), ("x", 1, 0, 0, 0), ("x", None, 1, 1, 0), ("y", 0, 0, 1, 1)]
    df = spark.createDataFrame(votes, "lang string, a int, b int, arbiter int, truth int")
    got = {r["lang"]: tuple(r)[1:] for r in metrics.consensus(df, "lang").collect()}
    assert got == {"x": (3, 2, 0.333333, 0.666667, 1.0), "y": (1, 0, 1.0, 0.0, 0.0)}


def test_eviction_over_partitions(spark):
    events = spark.range(1000).select((F.col("id") % 97).alias("user_id"), F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"))
    got = metrics.least_recent(events, F.col("user_id"), 10).collect()
    newest = sorted(got, key=lambda r: (-r["last_us"], r["slot"]))
    assert len(got) == 97 and [r["evicted"] for r in newest] == [False] * 10 + [True] * 87
