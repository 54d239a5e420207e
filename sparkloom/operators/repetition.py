"""Repetition in generated text: lines like many of the lines before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import jaccard, similar, strip, word_set


def eligible_lines(texts: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 20) -> DataFrame:
    """key, pos, line, words: stripped lines of at least least_chars characters whose word
    set isn't empty. Others take no place in a window. The last line counts without an end.
    Lines and sets pass through a generator, so each is made once however often it is used."""
    lines = texts.select(key, F.posexplode(F.transform(F.split(text, "\n"), strip)).alias("pos", "line")).filter(F.length("line") >= least_chars)
    return lines.select(key, "pos", "line", F.explode(F.array(word_set(F.col("line")))).alias("words")).filter(F.size("words") > 0)


def match_counts(lines: DataFrame, key: str = "doc_id", window: int = 20, similarity: float = 0.7) -> DataFrame:
    """Adds match_count: how many of the `window` lines before (0: all) are similar.

    A line's count depends on the lines alone, not on verdicts, so one window suffices;
    texts are independent, so it is spread by text."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(-window if window else Window.unboundedPreceding, -1)
    seen = lines.withColumn("seen", F.collect_list("words").over(before))
    return seen.withColumn("match_count", F.size(F.filter("seen", lambda h: similar(h, F.col("words"), similarity)))).drop("seen")


def detections(lines: DataFrame, key: str = "doc_id", window: int = 20, threshold: int = 3, similarity: float = 0.7, action: str = "escape") -> DataFrame:
    """key, pos, line, match_count, threshold, action of lines that trigger; for `stop`
    only the first of each text, since nothing is read after it."""
    hits = match_counts(lines, key, window, similarity).filter(F.col("match_count") >= threshold)
    if action == "stop":
        hits = hits.groupBy(key).agg(F.min_by(F.struct("pos", "line", "match_count"), "pos").alias("h")).select(key, "h.*")
    return hits.select(key, "pos", "line", "match_count", F.lit(threshold).alias("threshold"), F.lit(action).alias("action"))


def verdicts(texts: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each text: loop, and the first triggering line (null without)."""
    hits = detections(eligible_lines(texts, key, text), key, **options)
    first = hits.groupBy(key).agg(F.min("pos").alias("first_pos"), F.min_by("line", "pos").alias("first_line"), F.count("*").alias("n_hits"))
    return texts.select(key).join(first, key, "left").select(key, F.col("first_pos").isNotNull().alias("loop"), "first_pos", "first_line", F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"))


def adjacent_similarity(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, similarity with the eligible line before."""
    before = Window.partitionBy(key).orderBy("pos")
    pairs = lines.withColumn("last", F.lag("words").over(before)).filter("last IS NOT NULL")
    return pairs.select(key, "pos", F.round(jaccard(F.col("last"), F.col("words")), 6).alias("similarity"))
