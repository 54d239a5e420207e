"""Top-k, penalties, softmax, nucleus and draws over logits in long form (id, tok, logit)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_form(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return vectors.select(key, F.posexplode(vector).alias("tok", "logit")).withColumn("logit", F.col("logit").cast("double"))


def top_k(logits: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """The k highest, ties to the smaller token, with rk from 1. The rank limit is pushed
    below the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("logit"), "tok")
    return logits.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k)


def greedy(logits: DataFrame, key: str = "vec_id") -> DataFrame:
    """The highest token, ties to the smaller."""
    return logits.groupBy(key).agg(F.max_by("tok", F.struct("logit", -F.col("tok"))).alias("tok"))


def dense(top: DataFrame, ids: DataFrame, size: int, key: str = "vec_id", fill: float = -1e9) -> DataFrame:
    """All tokens of each id, with the fill value where the top-k has none."""
    every = ids.select(key).select(key, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("tok"))
    return every.join(top.select(key, "tok", "logit"), [key, "tok"], "left").withColumn("logit", F.coalesce("logit", F.lit(fill)))


def penalised(logits: DataFrame, recent: DataFrame, penalty: float, key: str = "vec_id") -> DataFrame:
    """logit / penalty for tokens among the recent (key, tok), if penalty > 1. Negative
    logits rise, as the rule divides them too."""
    if penalty <= 1:
        return logits
    seen = recent.select(key, "tok").distinct().withColumn("_seen", F.lit(True))
    return logits.join(seen, [key, "tok"], "left").withColumn("logit", F.when(F.col("_seen"), F.col("logit") / penalty).otherwise(F.col("logit"))).drop("_seen")


def softmax(logits: DataFrame, temperature: float = 1.0, key: str = "vec_id") -> DataFrame:
    """Adds p. Temperature must not be 0: that is greedy()."""
    own = Window.partitionBy(key)
    x = logits.withColumn("_x", F.col("logit") / temperature)
    x = x.withColumn("_e", F.exp(F.col("_x") - F.max("_x").over(own)))
    return x.withColumn("p", F.col("_e") / F.sum("_e").over(own)).drop("_x", "_e")


def nucleus(probabilities: DataFrame, top_p: float, key: str = "vec_id") -> DataFrame:
    """Keeps tokens, most likely first, while what came before is less than top_p; p of
    the kept add up to 1 again."""
    order = Window.partitionBy(key).orderBy(F.desc("p"), "tok").rowsBetween(Window.unboundedPreceding, 0)
    kept = probabilities.withColumn("_before", F.sum("p").over(order) - F.col("p")).filter(F.col("_before") < top_p)
    return kept.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(key))).drop("_before")


def draw(logits: DataFrame, seed: int, temperature: float = 1.0, top_p: float = 1.0, key: str = "vec_id", floor: float = 1e-10) -> DataFrame:
    """One token for each id: the largest of log(p + floor) plus Gumbel noise from a hash of
    (seed, id, tok), so the same seed gives the same draw. Temperature 0 is greedy."""
    if temperature == 0:
        return greedy(logits, key)
    p = softmax(logits, temperature, key)
    if top_p < 1:
        kept = nucleus(p, top_p, key).select(key, "tok", F.col("p").alias("_q"))
        p = p.join(kept, [key, "tok"], "left").withColumn("p", F.coalesce("_q", F.lit(0.0))).drop("_q")
    u = (F.pmod(F.xxhash64(F.lit(seed), key, "tok"), F.lit(1 << 53)) + F.lit(0.5)) / float(1 << 53)
    noisy = p.withColumn("_g", F.log(F.col("p") + floor) - F.log(-F.log(u)))
    return noisy.groupBy(key).agg(F.max_by("tok", "_g").alias("tok"))
