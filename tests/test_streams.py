"""Streams run to their end against the same operators in one batch, whatever the files."""

import pytest
from oracle import differences, duck
from pyspark.sql import functions as F

from sparkloom import catalog
from sparkloom.operators import repetition
from sparkloom.streaming import feeds
from sparkloom.streaming.feeds import Feed

SF = "/root/testdata/sf0.001"
STREAMS = ["stream_loop_feed", "stream_rate_limit", "stream_windowed_counts"]


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """Events and documents in nine files, rows dealt without regard to time."""
    sf = tmp_path_factory.mktemp("sf")
    for name, key in (("events", "event_id"), ("documents", "doc_id")):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        for k in range(9):
            rows.filter(F.pmod(F.xxhash64(key), F.lit(9)) == k).coalesce(1).write.mode("append").parquet(str(sf / f"{name}.parquet"))
    return str(sf)


@pytest.mark.parametrize("name", STREAMS)
def test_equals_the_batch_over_one_and_many_files(spark, many_files, name):
    con = duck(SF)
    for sf in (SF, many_files):
        assert differences(catalog.QUERIES[name](spark, sf), con, catalog.ORACLE_SQL[name]) == ""


def test_late_requests_and_state(spark, tmp_path):
    rows = [(1, k, 10 * k) for k in range(20)]
    for part in (rows[10:], rows[:5], rows[5:10]):
        spark.createDataFrame(part, "client long, id long, us long").coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    for name, late in (("all", None), ("few", 30)):
        stream = spark.readStream.schema("client long, id long, us long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r"))
        got = {r["id"]: r["hits"] for r in feeds.revised_to_end(feeds.admit(stream, 25, 2, late), name, ["client", "id"]).collect()}
        if late is None:
            assert got == {k: min(k + 1, 3) for k in range(20)}
        else:  # what is more than 30 behind is left out, the others are answered
            assert set(range(17, 20)) <= set(got) and all(h <= 3 for h in got.values())


SENTENCE = "Let me check the configuration file before we restart server"


def test_feed_resets(spark):
    feed = Feed()
    assert any([feed.push(f"{SENTENCE}\n") for _ in range(5)])
    feed.reset()
    assert not any([feed.push(f"{SENTENCE}\n") for _ in range(2)]) and feed.rest == ""
    again = Feed(rest="a\nb", sets=[[1, 2]], stopped=False)
    assert again.rest == "a\nb" and list(again.ring) == [{1, 2}]


def test_feed_words_are_the_columns_words(spark):
    texts = ["  The quick brown fox, THE end of it \t", "　x yy zz yy", "a an the", "", "\x85 padded line here \x85"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    from sparkloom.functions.text import strip, stripped_words, word_set

    got = {r["k"]: (r["s"], r["n"]) for r in df.select("k", strip(F.col("t")).alias("s"), F.size(word_set(strip(F.col("t")))).alias("n")).collect()}
    assert {k: (stripped_words(t)[0], len(stripped_words(t)[1])) for k, t in enumerate(texts)} == got
    assert repetition.eligible_lines(df, "k", "t").count() == 1
