"""Queries over requests, metrics, registries and routes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import admission, capacity, metrics
from sparkloom.sources.tables import table, values

MODELS = "('small-4b', 'standalone', 7.5D, 1.2D, 11.0D), ('small-4b', 'dflash', 7.5D, 1.2D, 40.0D), ('mid-12b', 'standalone', 7.1D, NULL, 4.0D), ('mid-12b', 'pipeline', 7.1D, NULL, 8.0D), ('mid-8b', 'pipeline', 15.0D, NULL, 6.0D)"
_MODEL_COLUMNS = "model, mode, size_gb, draft_size_gb, tok_s"
HARDWARE = "('r0', 16.0D), ('r1', 16.0D), ('mid', 32.0D), ('large', 48.0D)"
MODE_REQUESTS = "(1, 'small-4b', 'dflash'), (2, 'small-4b', 'pipeline'), (3, 'mid-8b', 'pipeline'), (4, 'unknown', 'standalone')"
AUTH = "(1, 'Bearer good', CAST(NULL AS STRING)), (2, 'Bearer bad', 'good'), (3, NULL, 'good'), (4, NULL, NULL), (5, 'Basic good', 'other'), (6, '', 'other')"
KEYS = "('good'), ('other')"
ROUTES = "('view', 'coder-30b', 0.25D, 16384), ('click', 'general-30b', 0.5D, 8192), ('purchase', 'writer-30b', 0.8D, 4096), ('signup', 'embedder', CAST(NULL AS DOUBLE), CAST(NULL AS INT))"
DEFAULT_MODEL = "general-30b"


def _sql(rows: str) -> str:
    """VALUES in the oracle's spelling: doubles without the letter D."""
    import re

    return re.sub(r"(\d)D\b", r"\1::DOUBLE", rows).replace("AS STRING", "AS VARCHAR")


def _micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def rate_limit_verdicts(spark, sf_dir):
    r = admission.limited(table(spark, sf_dir, "events"), "user_id", _micros(), "event_id", 3_600_000_000, 2)
    return r.select("event_id", "user_id", "hits", "allowed")


def rate_limit_by_client(spark, sf_dir):
    return rate_limit_verdicts(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(~F.col("allowed")).alias("rejected"))


def request_validation(spark, sf_dir):
    r = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("total_chars"))
    c = F.col("conv_id")
    r = r.select("conv_id", (c % 5).alias("client"), (c * 1_000_000).alias("us"), (c % 10 != 3).alias("authorised"), (c % 13 != 5).alias("valid_json"), F.when(c % 17 == 4, 0).otherwise(F.col("n")).alias("n_messages"), "total_chars", (c % 7 != 2).alias("ready"))
    return admission.validated(r, "client", F.col("us"), "conv_id", max_chars=2000, window_us=30_000_000, most=3).select("conv_id", "client", "hits", "status")


def auth_outcomes(spark, sf_dir):
    return admission.authorised(values(spark, AUTH, "req, auth_header, query_key"), values(spark, KEYS, "key")).select("req", "allowed")


def model_listing(spark, sf_dir):
    m = values(spark, MODELS, _MODEL_COLUMNS)
    return m.groupBy(F.col("model").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes")).withColumns({"object": F.lit("model"), "owned_by": F.lit("local")})


def health_status(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") >= 0, "ok").otherwise("loading").alias("status"))


def throughput(spark, sf_dir):
    from sparkloom.operators.prompts import throughput as rate

    return table(spark, sf_dir, "events").select("event_id", F.round(rate(F.col("event_id") % 500, F.col("value") / 1000), 4).alias("tok_s"))


def memory_guard(spark, sf_dir):
    return capacity.memory_guard(values(spark, MODELS, _MODEL_COLUMNS), values(spark, HARDWARE, "node, ram_gb"))


def mode_validation(spark, sf_dir):
    m = values(spark, MODELS, _MODEL_COLUMNS).groupBy("model").agg(F.collect_set("mode").alias("modes"))
    return capacity.validated_modes(values(spark, MODE_REQUESTS, "req, model, mode"), m)


def model_modes(spark, sf_dir):
    return values(spark, MODELS, _MODEL_COLUMNS).filter("tok_s IS NOT NULL").select("model", "mode", "size_gb", "tok_s")


def config_fallback(spark, sf_dir):
    i = F.col("event_id")
    given = F.when(i % 3 == 0, F.col("event_type")).when(i % 3 == 1, F.lit(""))
    rows = table(spark, sf_dir, "events").select(i, given.alias("cli"), F.when(i % 2 == 0, "pipeline").otherwise("").alias("configured"))
    return rows.select("event_id", capacity.chosen(["cli", "configured"], "standalone").alias("mode"))


def backend_dispatch(spark, sf_dir):
    modes = F.array(*map(F.lit, ("dflash", "pipeline", "llama", "standalone", "other", None)))
    e = table(spark, sf_dir, "events").withColumn("mode", F.get(modes, (F.col("event_id") % 6).cast("int")))
    return e.select("event_id", "mode", capacity.backend(F.col("mode")).alias("backend"))


def intent_routing(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "intent")
    return capacity.routed(e, values(spark, ROUTES, "intent, model, temperature, num_ctx"), DEFAULT_MODEL).groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("clients"))


def request_histogram(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events"), "event_type", "value")


def histogram_quantile(spark, sf_dir):
    return metrics.quantile(request_histogram(spark, sf_dir), "event_type", 0.95)


def metrics_exposition(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return metrics.exposition(n, "inference_requests_total", "event_type", "n")


def error_rate_5m(spark, sf_dir):
    return metrics.error_rates(table(spark, sf_dir, "events"), F.col("event_type") == "error")


def idle_sessions(spark, sf_dir):
    return metrics.sessions(table(spark, sf_dir, "events"), "user_id", 6 * 3600)


def heartbeat_gaps(spark, sf_dir):
    return metrics.gaps(table(spark, sf_dir, "events"), "user_id", 24 * 3600)


def lru_eviction(spark, sf_dir):
    return metrics.least_recent(table(spark, sf_dir, "events"), F.col("user_id") % 11, 4)


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("len"))


def batch_padding(spark, sf_dir):
    return metrics.batches(_requests(spark, sf_dir), ["conv_id", "turn"], "len", 7)


def batch_padding_by_length(spark, sf_dir):
    return metrics.batches(_requests(spark, sf_dir), ["len", "conv_id", "turn"], "len", 7)


def batch_outcomes(spark, sf_dir):
    return metrics.outcomes(table(spark, sf_dir, "events"), F.floor(F.col("event_id") / 32).cast("long"), F.col("event_type") == "error")


def consensus_vote(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    i = F.col("doc_id")
    votes = table(spark, sf_dir, "labels").join(d, "doc_id").select("lang", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"), (i % 3 % 2).cast("int").alias("arbiter"), (i % 2).cast("int").alias("truth"))
    return metrics.consensus(votes, "lang")


_RATE = "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS hits FROM events"
_HIST = "WITH b(le) AS (VALUES (0.1::DOUBLE), (0.5), (1.0), (2.0), (5.0), (10.0), (30.0), (60.0), (120.0), (NULL)) , hist AS (SELECT event_type, b.le, count(*) FILTER (b.le IS NULL OR value <= b.le) AS n FROM events, b GROUP BY ALL)"
_BATCH = "SELECT batch, count(*) AS n, max(len) AS longest, sum(len)::BIGINT AS total, (count(*) * max(len) - sum(len))::BIGINT AS padding FROM (SELECT length(text) AS len, (row_number() OVER (ORDER BY {}) - 1) // 7 AS batch FROM conversations) GROUP BY batch"

QUERIES = {f.__name__: f for f in (rate_limit_verdicts, rate_limit_by_client, request_validation, auth_outcomes, model_listing, health_status, throughput, memory_guard, mode_validation, model_modes, config_fallback, backend_dispatch, intent_routing, request_histogram, histogram_quantile, metrics_exposition, error_rate_5m, idle_sessions, heartbeat_gaps, lru_eviction, batch_padding, batch_padding_by_length, batch_outcomes, consensus_vote)}

ORACLE_SQL = {
    "rate_limit_verdicts": f"SELECT *, hits <= 2 AS allowed FROM ({_RATE})",
    "rate_limit_by_client": f"SELECT user_id, count(*) AS requests, count(*) FILTER (hits > 2) AS rejected FROM ({_RATE}) GROUP BY user_id",
    "request_validation": """WITH c AS (SELECT conv_id, conv_id % 5 AS client, conv_id % 10 <> 3 AS a, conv_id % 13 <> 5 AS j, CASE WHEN conv_id % 17 = 4 THEN 0 ELSE count(*) END AS n, sum(length(text)) AS chars, conv_id % 7 <> 2 AS ready FROM conversations GROUP BY conv_id),
 k AS (SELECT *, a AND j AND n > 0 AND chars <= 2000 AS reaches FROM c),
 h AS (SELECT *, sum(CASE WHEN reaches THEN 1 ELSE 0 END) OVER (PARTITION BY client ORDER BY conv_id RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)::BIGINT AS hits FROM k)
 SELECT conv_id, client, hits, CASE WHEN NOT a THEN 401 WHEN NOT j OR n <= 0 OR chars > 2000 THEN 400 WHEN hits > 3 THEN 429 WHEN NOT ready THEN 503 ELSE 200 END AS status FROM h""",
    "auth_outcomes": f"WITH r(req, h, q) AS (VALUES {_sql(AUTH)}), k(key) AS (VALUES {KEYS}) SELECT req, CASE WHEN starts_with(coalesce(h, ''), 'Bearer ') THEN substr(h, 8) ELSE coalesce(q, '') END IN (SELECT key FROM k) AS allowed FROM r",
    "model_listing": f"WITH m({_MODEL_COLUMNS}) AS (VALUES {_sql(MODELS)}) SELECT model AS id, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes, 'model' AS object, 'local' AS owned_by FROM m GROUP BY model",
    "health_status": "SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN 'ok' ELSE 'loading' END AS status FROM supplier",
    "throughput": "SELECT event_id, round((event_id % 500) / greatest(value / 1000, 0.001::DOUBLE), 4) AS tok_s FROM events",
    "memory_guard": f"WITH m({_MODEL_COLUMNS}) AS (VALUES {_sql(MODELS)}), h(node, ram_gb) AS (VALUES {_sql(HARDWARE)}), g AS (SELECT model, mode, node, CASE mode WHEN 'pipeline' THEN size_gb / 2 WHEN 'dflash' THEN size_gb + coalesce(draft_size_gb, 1.0) ELSE size_gb END AS needed, ram_gb * CASE WHEN ram_gb >= 48 THEN 0.60::DOUBLE WHEN ram_gb >= 32 THEN 0.70::DOUBLE ELSE 0.85::DOUBLE END - 4.0::DOUBLE - 2.0::DOUBLE AS usable FROM m, h) SELECT model, mode, node, round(needed, 6) AS needed_gb, round(usable, 6) AS usable_gb, needed <= usable AS fits FROM g",
    "mode_validation": f"WITH m({_MODEL_COLUMNS}) AS (VALUES {_sql(MODELS)}), r(req, model, mode) AS (VALUES {MODE_REQUESTS}) SELECT req, model, mode, CASE WHEN model NOT IN (SELECT model FROM m) THEN 'unknown model' WHEN (model, mode) NOT IN (SELECT (model, mode) FROM m) THEN 'unsupported mode' ELSE 'ok' END AS outcome FROM r",
    "model_modes": f"WITH m({_MODEL_COLUMNS}) AS (VALUES {_sql(MODELS)}) SELECT model, mode, size_gb, tok_s FROM m",
    "backend_dispatch": "WITH m AS (SELECT event_id, ['dflash', 'pipeline', 'llama', 'standalone', 'other', NULL][event_id % 6 + 1] AS mode FROM events) SELECT event_id, mode, CASE WHEN mode = 'dflash' THEN 'draft' WHEN mode IN ('pipeline', 'llama') THEN mode ELSE 'standalone' END AS backend FROM m",
    "config_fallback": "SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_type <> '' THEN event_type WHEN event_id % 2 = 0 THEN 'pipeline' ELSE 'standalone' END AS mode FROM events",
    "intent_routing": f"WITH r(intent, model, temperature, num_ctx) AS (VALUES {_sql(ROUTES)}) SELECT coalesce(r.model, '{DEFAULT_MODEL}') AS model, count(*) AS n, count(DISTINCT user_id) AS clients FROM events e LEFT JOIN r ON r.intent = e.event_type GROUP BY 1",
    "request_histogram": f"{_HIST} SELECT * FROM hist",
    "histogram_quantile": f"{_HIST}, o AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY event_type) * 0.95::DOUBLE AS want FROM hist WINDOW w AS (PARTITION BY event_type ORDER BY le NULLS LAST)), f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le NULLS LAST) AS r FROM o WHERE n >= want AND n > 0) SELECT event_type, round(CASE WHEN le IS NULL THEN lo ELSE lo + (le - lo) * (want - below) / (n - below) END, 6) AS value FROM f WHERE r = 1",
    "metrics_exposition": """SELECT 'inference_requests_total{event_type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""",
    "error_rate_5m": "WITH w AS (SELECT (epoch_us(ts) // 300000000 * 300)::BIGINT AS start, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1) SELECT *, round(requests::DOUBLE / 300, 6) AS per_second, round(errors::DOUBLE / requests, 6) AS error_rate FROM w",
    "idle_sessions": "WITH t AS (SELECT user_id, epoch_us(ts) AS t FROM events), n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 21600000000 THEN 0 ELSE 1 END AS new FROM t), s AS (SELECT user_id, t, (sum(new) OVER (PARTITION BY user_id ORDER BY t))::INT AS session FROM n) SELECT user_id, session, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM s GROUP BY user_id, session",
    "heartbeat_gaps": "WITH g AS (SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) SELECT user_id, event_id, round(gap / 1e6, 3) AS gap_s FROM g WHERE gap > 86400000000",
    "lru_eviction": "SELECT slot, last_us, row_number() OVER (ORDER BY last_us DESC, slot) > 4 AS evicted FROM (SELECT user_id % 11 AS slot, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1)",
    "batch_padding": _BATCH.format("conv_id, turn"),
    "batch_padding_by_length": _BATCH.format("length(text), conv_id, turn"),
    "batch_outcomes": "SELECT event_id // 32 AS batch, count(*) AS n, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1",
    "consensus_vote": """WITH v AS (SELECT lang, quality AS a, 1 - toxic AS b, (doc_id % 3 % 2)::INT AS c, (doc_id % 2)::INT AS t FROM labels JOIN documents USING (doc_id)),
 f AS (SELECT *, a = b AS agreed, CASE WHEN a = b THEN a ELSE c END AS final FROM v)
 SELECT lang, count(*) AS questions, count(*) FILTER (NOT agreed) AS arbitrated, round(avg(CASE WHEN agreed THEN 1.0 ELSE 0.0 END), 6) AS consensus_rate, round(avg(CASE WHEN final = t THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN agreed THEN CASE WHEN final = t THEN 1.0 ELSE 0.0 END END), 6) AS accuracy_agreed FROM f GROUP BY lang""",
}
