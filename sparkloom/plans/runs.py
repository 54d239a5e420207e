"""Queries over shards, weights and benchmark logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import runs, shards
from sparkloom.sources.tables import table, values

EVEN = "(1, 48, 5), (2, 48, 2), (3, 7, 3), (4, 2, 3), (5, 100, 7)"
DEVICES = "(1, 48, 0, 16.0D), (1, 48, 1, 8.0D), (1, 48, 2, 8.0D), (2, 5, 0, 1.0D), (2, 5, 1, 1.0D), (3, 7, 0, 1.0D), (3, 7, 1, 1.0D), (4, 2, 0, 1.0D), (4, 2, 1, 1.0D), (4, 2, 2, 1.0D), (5, 24, 0, 0.0D), (5, 24, 1, 16.0D)"
SHARDS = "(0, 0, 25), (1, 25, 48)"
PARTS = "('input_layernorm.weight', 7680), ('self_attn.q_proj.weight', 7864320), ('self_attn.k_proj.weight', 3932160), ('self_attn.v_proj.weight', 3932160), ('self_attn.o_proj.weight', 7864320), ('mlp.gate_proj.weight', 29491200), ('mlp.up_proj.weight', 29491200), ('mlp.down_proj.weight', 29491200)"
LOOSE = "('language_model.model.embed_tokens.weight', 503447040), ('language_model.model.norm.weight', 7680), ('language_model.lm_head.weight', 503447040), ('vision_tower.patch.weight', 1000), ('model.h.3.attn.weight', 5000), ('transformer.h.30.attn.weight', 6000)"
SNAPSHOTS = "('org/a', 's1', 10), ('org/a', 's2', 20), ('org/b', 's3', 5), ('org/b', 's4', 4)"
REFS = "('org/a', 's1')"
HOSTS = "('169.254.149.29'), ('192.168.1.11'), ('169.25.4.1')"


def split_even(spark, sf_dir):
    return shards.even_split(values(spark, EVEN, "plan, n_layers, world"))


def split_memory_weighted(spark, sf_dir):
    return shards.weighted_split(values(spark, DEVICES, "plan, n_layers, rank, mem"))


def shard_flags(spark, sf_dir):
    return shards.flags(values(spark, SHARDS, "rank, start_layer, end_layer"), F.lit(48))


def _weights(spark):
    layers = spark.range(48).crossJoin(F.broadcast(values(spark, PARTS, "part, nbytes")))
    own = layers.select(F.concat(F.lit("language_model.model.layers."), "id", F.lit("."), "part").alias("key"), F.col("nbytes").cast("long").alias("nbytes"))
    return own.unionByName(values(spark, LOOSE, "key, nbytes").withColumn("nbytes", F.col("nbytes").cast("long")))


def shard_weight_prune(spark, sf_dir):
    return shards.pruned_weights(_weights(spark), values(spark, SHARDS, "rank, start_layer, end_layer"))


def shard_load_report(spark, sf_dir):
    return shards.load_report(shard_weight_prune(spark, sf_dir))


def snapshot_resolve(spark, sf_dir):
    r = shards.resolved(values(spark, SNAPSHOTS, "model, path, mtime"), values(spark, REFS, "model, ref"))
    return r.withColumn("folder", shards.cache_folder(F.col("model")))


def _log(spark, sf_dir):
    """Log lines made from events: a run for each user, in order of event_id."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")

    def digits(c, n):
        return F.lpad(c.cast("string"), n, "0")

    step = F.concat(F.lit("   Step "), i % 1000, F.lit(": ' t"), i % 17, F.lit("' | r0=0."), i % 10, F.lit("s step="), i % 3, F.lit("."), digits(i * 7 % 1000, 3), F.lit("s | "), i % 40, F.lit("."), digits(i * 13 % 100, 2), F.lit(" tok/s"))
    line = F.when(i % 97 == 11, F.concat(F.lit("Prefill 完成 ("), i % 9, F.lit(".5s)"))).when(i % 401 == 400, F.lit("生成完成")).when(i % 53 == 1, F.lit("loading")).otherwise(step)
    return e.select(F.col("user_id").alias("run_id"), i.alias("lineno"), line.alias("line"))


def step_log_parse(spark, sf_dir):
    s = runs.steps(runs.until_done(_log(spark, sf_dir)))
    return s.withColumns({"step_ms": F.round("step_ms", 3), "r0_ms": F.round("r0_ms", 3)})


def prefill_times(spark, sf_dir):
    return runs.prefill(runs.until_done(_log(spark, sf_dir)))


def run_stats(spark, sf_dir):
    return runs.run_stats(step_log_parse(spark, sf_dir))


def run_summary(spark, sf_dir):
    return runs.summary(run_stats(spark, sf_dir))


def last_rate(spark, sf_dir):
    """The last step's rate of each run, as the shell report gives it."""
    lines = runs.until_done(_log(spark, sf_dir)).filter("line LIKE '%tok/s%'")
    return lines.groupBy("run_id").agg(F.max_by(F.regexp_extract("line", r"([\d.]+) tok/s", 1), "lineno").cast("double").alias("last_tok_s"))


def transport_label(spark, sf_dir):
    return values(spark, HOSTS, "host").withColumn("transport", runs.transport(F.col("host")))


def _drafts(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_type", (i % 100 + 1).cast("double").alias("tokens"), ((i % 50 + 1) / 8).alias("time_s"), ((i % 10) / 10).alias("ar"), (i % 29).cast("double").alias("memory_gb"))


def draft_summary(spark, sf_dir):
    s = runs.draft_summary(_drafts(spark, sf_dir), "event_type")
    return s.select("event_type", *[F.round(c, 6).alias(c) for c in ("avg_tokens", "avg_time_s", "avg_tps", "avg_ar", "max_memory_gb")])


def acceptance_gates(spark, sf_dir):
    return runs.gates(runs.draft_summary(_drafts(spark, sf_dir), "event_type"), least_ar=0.45).select("event_type", "memory_ok", "latency_ok", "ar_ok", "all_ok")


def draft_metrics(spark, sf_dir):
    i = F.col("event_id")
    accepted = F.array(i % 16 + 1, i * 3 % 16 + 1, i * 5 % 16 + 1)
    return runs.draft_metrics(table(spark, sf_dir, "events").select(i.alias("run_id"), accepted.alias("accepted"), (i % 9).cast("double").alias("prefill_s"), (i % 31).cast("double").alias("decode_s")))


QUERIES = {f.__name__: f for f in (split_even, split_memory_weighted, shard_flags, shard_weight_prune, shard_load_report, snapshot_resolve, step_log_parse, prefill_times, run_stats, run_summary, last_rate, transport_label, draft_summary, acceptance_gates, draft_metrics)}

_D = DEVICES.replace("D)", "::DOUBLE)")
_PRUNE = f"""sh(rank, s, e) AS (VALUES {SHARDS}), pt(part, nbytes) AS (VALUES {PARTS}), lo(key, nbytes) AS (VALUES {LOOSE}),
 w AS (SELECT 'language_model.model.layers.' || i || '.' || part AS key, nbytes FROM range(48) g(i), pt UNION ALL SELECT key, nbytes FROM lo),
 p AS (SELECT rank, x || i || '.' AS pattern FROM sh, range(48) g(i), (VALUES ('model.layers.'), ('language_model.model.layers.'), ('model.h.'), ('transformer.h.')) q(x) WHERE i >= s AND i < e
   UNION ALL SELECT 0, unnest(['language_model.model.embed_tokens', 'model.embed_tokens', 'model.wte']) UNION ALL SELECT 1, unnest(['language_model.model.norm', 'language_model.lm_head', 'model.norm', 'model.ln_f', 'lm_head'])),
 k AS (SELECT DISTINCT rank, key, nbytes::BIGINT AS nbytes, try_cast(regexp_extract(key, '(?:^|\\.)layers\\.(\\d+)', 1) AS INT) AS layer FROM w JOIN p ON contains(key, pattern))"""
_LOG = """lg AS (SELECT user_id AS run_id, event_id AS lineno, CASE WHEN event_id % 97 = 11 THEN 'Prefill 完成 (' || event_id % 9 || '.5s)' WHEN event_id % 401 = 400 THEN '生成完成' WHEN event_id % 53 = 1 THEN 'loading'
  ELSE '   Step ' || event_id % 1000 || ': '' t' || event_id % 17 || ''' | r0=0.' || event_id % 10 || 's step=' || event_id % 3 || '.' || lpad((event_id * 7 % 1000)::VARCHAR, 3, '0') || 's | ' || event_id % 40 || '.' || lpad((event_id * 13 % 100)::VARCHAR, 2, '0') || ' tok/s' END AS line FROM events),
 dn AS (SELECT run_id, min(lineno) AS d FROM lg WHERE contains(line, '生成完成') GROUP BY 1), ll AS (SELECT lg.* FROM lg LEFT JOIN dn USING (run_id) WHERE d IS NULL OR lineno <= d),
 st AS (SELECT run_id, regexp_extract(line, 'Step (\\d+)', 1)::INT AS step, regexp_extract(line, '''(.*)'' \\|', 1) AS token, round(regexp_extract(line, 'step=([\\d.]+)', 1)::DOUBLE * 1000, 3) AS step_ms, round(regexp_extract(line, 'r0=([\\d.]+)', 1)::DOUBLE * 1000, 3) AS r0_ms, regexp_extract(line, '([\\d.]+) tok/s', 1)::DOUBLE AS tok_s FROM ll WHERE contains(line, 'tok/s'))"""
_STATS = f"{_LOG}, rs AS (SELECT run_id, round(avg(tok_s), 6) AS avg_tok_s, min(tok_s) AS min_tok_s, max(tok_s) AS max_tok_s, round(coalesce(stddev_samp(tok_s), 0), 6) AS stddev_tok_s, round(avg(step_ms), 6) AS avg_step_ms, count(*) + 1 AS output_tokens FROM st GROUP BY run_id)"
_DRAFT = "ds AS (SELECT event_type, avg(tokens) AS avg_tokens, avg(time_s) AS avg_time_s, avg(tokens / time_s) AS avg_tps, avg(ar) AS avg_ar, max(memory_gb) AS max_memory_gb FROM (SELECT event_type, (event_id % 100 + 1)::DOUBLE AS tokens, (event_id % 50 + 1)::DOUBLE / 8 AS time_s, (event_id % 10)::DOUBLE / 10 AS ar, (event_id % 29)::DOUBLE AS memory_gb FROM events) GROUP BY 1)"

ORACLE_SQL = {
    "split_even": f"WITH p(plan, n, w) AS (VALUES {EVEN}), l AS (SELECT plan, n, w, unnest(range(n)) AS layer FROM p), t AS (SELECT plan, layer, ntile(w) OVER (PARTITION BY plan ORDER BY layer) AS k FROM (SELECT l.*, l.w AS ww FROM l)) SELECT p.plan, r.rank::INT AS rank, (coalesce(min(layer), max(n)))::INT AS start_layer, (coalesce(max(layer) + 1, max(n)))::INT AS end_layer FROM p, LATERAL (SELECT unnest(range(p.w)) AS rank) r LEFT JOIN t ON t.plan = p.plan AND t.k = r.rank + 1 GROUP BY 1, 2",
    "split_memory_weighted": f"WITH d(plan, n, rank, mem) AS (VALUES {_D}), s AS (SELECT *, greatest(1, round_even(n * mem / sum(mem) OVER (PARTITION BY plan), 0)::INT) AS c, max(rank) OVER (PARTITION BY plan) AS last FROM d), a AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY plan ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM s) SELECT plan, rank, start AS start_layer, (CASE WHEN rank = last THEN n ELSE start + c END)::INT AS end_layer FROM a",
    "shard_flags": f"WITH s(rank, start_layer, end_layer) AS (VALUES {SHARDS}) SELECT *, start_layer = 0 AS is_first, end_layer = 48 AS is_last, end_layer - start_layer AS n_local_layers FROM s",
    "shard_weight_prune": f"WITH {_PRUNE} SELECT * FROM k",
    "shard_load_report": f"WITH {_PRUNE} SELECT rank, count(*) AS n_tensors, (SELECT string_agg(layer::VARCHAR, ',' ORDER BY layer) FROM (SELECT DISTINCT layer FROM k x WHERE x.rank = k.rank AND layer IS NOT NULL)) AS layers, round(sum(nbytes)::DOUBLE / 1073741824, 6) AS gb FROM k GROUP BY rank",
    "snapshot_resolve": f"WITH s(model, path, mtime) AS (VALUES {SNAPSHOTS}), r(model, ref) AS (VALUES {REFS}) SELECT s.model, coalesce(max(ref), arg_max(path, mtime)) AS path, 'models--' || replace(s.model, '/', '--') AS folder FROM s LEFT JOIN r USING (model) GROUP BY s.model",
    "step_log_parse": f"WITH {_LOG} SELECT * FROM st",
    "prefill_times": f"WITH {_LOG} SELECT run_id, arg_max(regexp_extract(line, '\\((\\d+\\.?\\d*)s\\)', 1), lineno)::DOUBLE AS prefill_s FROM ll WHERE contains(line, 'Prefill') GROUP BY 1",
    "run_stats": f"WITH {_STATS} SELECT * FROM rs",
    "run_summary": f"WITH {_STATS} SELECT count(*) AS runs, round(avg(avg_tok_s), 5) AS mean, round(min(avg_tok_s), 5) AS least, round(max(avg_tok_s), 5) AS most, round(coalesce(stddev_samp(avg_tok_s), 0), 5) AS deviation FROM rs",
    "last_rate": f"WITH {_LOG} SELECT run_id, arg_max(regexp_extract(line, '([\\d.]+) tok/s', 1), lineno)::DOUBLE AS last_tok_s FROM ll WHERE contains(line, 'tok/s') GROUP BY 1",
    "transport_label": f"WITH h(host) AS (VALUES {HOSTS}) SELECT host, CASE WHEN starts_with(host, '169.254.') THEN 'thunderbolt' ELSE 'wifi' END AS transport FROM h",
    "draft_summary": f"WITH {_DRAFT} SELECT event_type, round(avg_tokens, 6) AS avg_tokens, round(avg_time_s, 6) AS avg_time_s, round(avg_tps, 6) AS avg_tps, round(avg_ar, 6) AS avg_ar, round(max_memory_gb, 6) AS max_memory_gb FROM ds",
    "acceptance_gates": f"WITH {_DRAFT} SELECT event_type, 28.0 - max_memory_gb >= 1.5 AS memory_ok, avg_time_s / avg_tokens * 1000 < 150 AS latency_ok, avg_ar >= 0.45 AS ar_ok, 28.0 - max_memory_gb >= 1.5 AND avg_time_s / avg_tokens * 1000 < 150 AND avg_ar >= 0.45 AS all_ok FROM ds",
    "draft_metrics": "SELECT event_id AS run_id, round((event_id % 16 + 1 + event_id * 3 % 16 + 1 + event_id * 5 % 16 + 1)::DOUBLE / 3 / 16, 6) AS acceptance_rate, (event_id % 16 + 1 + event_id * 3 % 16 + 1 + event_id * 5 % 16 + 1)::INT AS draft_tokens, (event_id % 9)::DOUBLE AS draft_time_s, (event_id % 31)::DOUBLE AS verify_time_s FROM events",
}
