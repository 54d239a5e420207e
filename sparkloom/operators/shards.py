"""Dividing layers among devices, and which weights each of them reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def even_split(plans: DataFrame) -> DataFrame:
    """plans (plan, n_layers, world): plan, rank, start_layer, end_layer (not included).
    The first n mod world ranks have one more; ntile divides in just this way."""
    layers = plans.select("plan", "n_layers", "world", F.explode(F.sequence(F.lit(0), F.col("world") - 1)).alias("rank"))
    base, extra = F.floor(F.col("n_layers") / F.col("world")), F.col("n_layers") % F.col("world")
    start = F.col("rank") * base + F.least("rank", extra)
    size = base + F.when(F.col("rank") < extra, 1).otherwise(0)
    return layers.select("plan", "rank", start.cast("int").alias("start_layer"), (start + size).cast("int").alias("end_layer"))


def weighted_split(devices: DataFrame) -> DataFrame:
    """devices (plan, n_layers, rank, mem): shares by memory, rounded half to even, at least
    one; the last takes what is left, be it none or less."""
    plan = Window.partitionBy("plan")
    share = F.greatest(F.lit(1), F.bround(F.col("n_layers") * F.col("mem") / F.sum("mem").over(plan)).cast("int"))
    d = devices.withColumns({"_n": share, "_last": F.max("rank").over(plan)})
    before = Window.partitionBy("plan").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0))
    d = d.withColumn("start_layer", start.cast("int"))
    end = F.when(F.col("rank") == F.col("_last"), F.col("n_layers")).otherwise(F.col("start_layer") + F.col("_n"))
    return d.select("plan", "rank", "start_layer", end.cast("int").alias("end_layer"))


def flags(shards: DataFrame, n_layers: Column) -> DataFrame:
    return shards.withColumns({"is_first": F.col("start_layer") == 0, "is_last": F.col("end_layer") == n_layers, "n_local_layers": F.col("end_layer") - F.col("start_layer")})


#: How checkpoints spell a layer's prefix, and weights outside the layers.
LAYER_PREFIXES = ["model.layers.", "language_model.model.layers.", "model.h.", "transformer.h."]
FIRST_RANK = ["language_model.model.embed_tokens", "model.embed_tokens", "model.wte"]
OTHER_RANKS = ["language_model.model.norm", "language_model.lm_head", "model.norm", "model.ln_f", "lm_head"]


def layer_number(key: Column) -> Column:
    """The number after a part `layers`; null without one."""
    return F.expr(f"try_cast({_extract(key)} AS INT)")


def _extract(key: Column) -> str:
    return r"regexp_extract(key, '(?:^|\\.)layers\\.(\\d+)', 1)"


def pruned_weights(weights: DataFrame, shards: DataFrame) -> DataFrame:
    """weights (key, nbytes) that each shard (rank, start_layer, end_layer) reads. The
    patterns are a few hundred rows at most (layers times spellings), so they are broadcast."""
    layer = F.explode(F.sequence(F.col("start_layer"), F.col("end_layer") - 1)).alias("layer")
    own = shards.filter("end_layer > start_layer").select("rank", layer)
    spelt = own.select("rank", F.explode(F.array(*[F.concat(F.lit(p), F.col("layer"), F.lit(".")) for p in LAYER_PREFIXES])).alias("pattern"))
    first, others = F.array(*[F.lit(p) for p in FIRST_RANK]), F.array(*[F.lit(p) for p in OTHER_RANKS])
    loose = shards.select("rank", F.explode(F.when(F.col("rank") == 0, first).otherwise(others)).alias("pattern"))
    patterns = F.broadcast(spelt.unionByName(loose).withColumnRenamed("rank", "_rank"))
    hits = weights.join(patterns, F.contains("key", F.col("pattern"))).select(F.col("_rank").alias("rank"), "key", "nbytes").distinct()
    return hits.withColumn("layer", layer_number(F.col("key")))


def load_report(pruned: DataFrame) -> DataFrame:
    return pruned.groupBy("rank").agg(F.count("*").alias("n_tensors"), F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"), F.round(F.sum("nbytes") / F.lit(float(1 << 30)), 6).alias("gb"))


def cache_folder(model_id: Column) -> Column:
    return F.concat(F.lit("models--"), F.replace(model_id, F.lit("/"), F.lit("--")))


def resolved(snapshots: DataFrame, refs: DataFrame) -> DataFrame:
    """snapshots (model, path, mtime), refs (model, ref): the named snapshot, else the newest."""
    newest = snapshots.groupBy("model").agg(F.max_by("path", "mtime").alias("newest"))
    return newest.join(refs, "model", "left").select("model", F.coalesce("ref", "newest").alias("path"))
