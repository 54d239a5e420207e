"""What fits where, and which model serves what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def memory_guard(models: DataFrame, hardware: DataFrame, safety: float = 0.85, reserve_gb: float = 4.0, overhead_gb: float = 2.0) -> DataFrame:
    """models (model, mode, size_gb, draft_size_gb) on hardware (node, ram_gb): needed,
    usable and fits. Machines of 48 and 32 GB and more have shares of their own. Both
    sides are registries of a few rows."""
    share = F.when(F.col("ram_gb") >= 48, 0.60).when(F.col("ram_gb") >= 32, 0.70).otherwise(safety)
    usable = F.col("ram_gb") * share - reserve_gb - overhead_gb
    needed = F.when(F.col("mode") == "pipeline", F.col("size_gb") / 2).when(F.col("mode") == "dflash", F.col("size_gb") + F.coalesce("draft_size_gb", F.lit(1.0))).otherwise(F.col("size_gb"))
    return models.join(F.broadcast(hardware), F.lit(True)).select("model", "mode", "node", F.round(needed, 6).alias("needed_gb"), F.round(usable, 6).alias("usable_gb"), (needed <= usable).alias("fits"))


def validated_modes(requests: DataFrame, models: DataFrame) -> DataFrame:
    """requests (req, model, mode) with outcome: ok, unknown model or unsupported mode."""
    r = requests.join(F.broadcast(models.select("model", "modes")), "model", "left")
    outcome = F.when(F.col("modes").isNull(), "unknown model").when(~F.array_contains("modes", F.col("mode")), "unsupported mode").otherwise("ok")
    return r.select("req", "model", "mode", outcome.alias("outcome"))


def chosen(columns: list[str], literal: str):
    """The first that is neither null nor empty, else the literal."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(literal))


def routed(requests: DataFrame, routes: DataFrame, default_model: str, intent: str = "intent") -> DataFrame:
    """requests with the model of their intent, or the default. routes is a small registry."""
    return requests.join(F.broadcast(routes), intent, "left").withColumn("model", F.coalesce("model", F.lit(default_model)))


def backend(mode: Column, llama: bool = True) -> Column:
    """The backend of a configured mode: unknown and missing modes are served standalone,
    and without the llama library its mode is an error."""
    missing = F.raise_error(F.lit("the llama library is not installed")).cast("string")
    named = F.when(mode == "dflash", "draft").when(mode == "pipeline", "pipeline").when(mode == "llama", F.lit("llama") if llama else missing)
    return named.otherwise("standalone")
