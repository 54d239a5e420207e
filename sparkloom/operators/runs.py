"""Benchmark logs: parsing, statistics of runs, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import strip

#: The words that mark a finished prefill and a finished run in the logs.
PREFILL_DONE, RUN_DONE = "完成", "生成完成"


def until_done(lines: DataFrame, run: str = "run_id", order: str = "lineno", marker: str = RUN_DONE) -> DataFrame:
    """Lines of each run up to its first completion line."""
    done = F.min(F.when(F.contains("line", F.lit(marker)), F.col(order))).over(Window.partitionBy(run))
    return lines.withColumn("_done", done).filter(F.col("_done").isNull() | (F.col(order) <= F.col("_done"))).drop("_done")


def steps(lines: DataFrame, run: str = "run_id") -> DataFrame:
    """run, step, token, step_ms, r0_ms, tok_s of the step lines; absent numbers are 0.

    The logs' tok/s is a running average, so a mean of it is a mean of running averages."""
    s = lines.withColumn("l", strip(F.col("line"))).filter(F.startswith("l", F.lit("Step")) & F.contains("l", F.lit("tok/s")))
    part = F.split("l", r"\|")

    def number(pattern: str, k: int) -> Column:
        found = F.regexp_extract(F.get(part, F.lit(k)), pattern, 1)
        return F.coalesce(F.nullif(found, F.lit("")).cast("double"), F.lit(0.0))

    token = F.regexp_replace(strip(F.regexp_extract(F.get(part, F.lit(0)), r"^[^:]*:(.*)$", 1)), "^['\"]+|['\"]+$", "")
    return s.select(run, F.regexp_extract("l", r"^Step (\d+)", 1).cast("int").alias("step"), token.alias("token"), (number(r"(?:^|\s)step=([\d.]+)", 1) * 1000).alias("step_ms"), (number(r"(?:^|\s)r0=([\d.]+)", 1) * 1000).alias("r0_ms"), number(r"([\d.]+)", 2).alias("tok_s"))


def prefill(lines: DataFrame, run: str = "run_id", order: str = "lineno", marker: str = PREFILL_DONE) -> DataFrame:
    """run, prefill_s: the last prefill line with a time."""
    p = lines.filter(F.contains("line", F.lit("Prefill")) & F.contains("line", F.lit(marker)))
    p = p.withColumn("v", F.regexp_extract("line", r"\((\d+\.?\d*)s\)", 1)).filter("v <> ''")
    return p.groupBy(run).agg(F.max_by("v", order).cast("double").alias("prefill_s"))


def run_stats(step_rows: DataFrame, run: str = "run_id") -> DataFrame:
    """Mean, least, most and sample deviation (0 of one step), and tokens: steps plus one."""
    return step_rows.groupBy(run).agg(
        F.round(F.avg("tok_s"), 6).alias("avg_tok_s"), F.min("tok_s").alias("min_tok_s"), F.max("tok_s").alias("max_tok_s"),
        F.round(F.coalesce(F.stddev_samp("tok_s"), F.lit(0.0)), 6).alias("stddev_tok_s"), F.round(F.avg("step_ms"), 6).alias("avg_step_ms"), (F.count("*") + 1).alias("output_tokens"),
    )


def summary(stats: DataFrame) -> DataFrame:
    """Statistics of the runs' averages, not of all steps."""
    a = F.col("avg_tok_s")
    return stats.agg(F.count("*").alias("runs"), F.round(F.avg(a), 5).alias("mean"), F.round(F.min(a), 5).alias("least"), F.round(F.max(a), 5).alias("most"), F.round(F.coalesce(F.stddev_samp(a), F.lit(0.0)), 5).alias("deviation"))


def transport(host: Column) -> Column:
    return F.when(F.startswith(host, F.lit("169.254.")), "thunderbolt").otherwise("wifi")


def draft_metrics(runs: DataFrame, block: int = 16) -> DataFrame:
    """runs (run_id, accepted array, prefill_s, decode_s): draft_time_s is the prefill's and
    verify_time_s the decoding's time, as the fields have always been filled."""
    mean = F.aggregate("accepted", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("accepted"), F.lit(0))
    return runs.select("run_id", F.round(mean / block, 6).alias("acceptance_rate"), F.aggregate("accepted", F.lit(0), lambda a, x: a + x.cast("int")).alias("draft_tokens"), F.col("prefill_s").alias("draft_time_s"), F.col("decode_s").alias("verify_time_s"))


def draft_summary(runs: DataFrame, by: str) -> DataFrame:
    """runs (tokens, time_s, ar, memory_gb): avg_tps is the mean of the runs' ratios."""
    return runs.groupBy(by).agg(F.avg("tokens").alias("avg_tokens"), F.avg("time_s").alias("avg_time_s"), F.avg(F.col("tokens") / F.nullif("time_s", F.lit(0.0))).alias("avg_tps"), F.avg("ar").alias("avg_ar"), F.max("memory_gb").alias("max_memory_gb"))


def gates(summaries: DataFrame, total_gb: float = 48.0, reserved_gb: float = 20.0, spare_gb: float = 1.5, most_ms: float = 150.0, least_ar: float = 0.6) -> DataFrame:
    memory = (F.lit(total_gb - reserved_gb) - F.col("max_memory_gb")) >= spare_gb
    latency = F.col("avg_time_s") / F.col("avg_tokens") * 1000 < most_ms
    accepted = F.col("avg_ar") >= least_ar
    return summaries.withColumns({"memory_ok": memory, "latency_ok": latency, "ar_ok": accepted, "all_ok": memory & latency & accepted})
