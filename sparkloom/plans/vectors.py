"""Queries over logits, hidden states and frames, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import vectors as V
from sparkloom.operators import frames, selection, transformer
from sparkloom.sources.tables import table


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _logits(spark, sf_dir):
    return selection.long_form(_embeddings(spark, sf_dir))


def topk_logits(spark, sf_dir):
    return selection.top_k(_logits(spark, sf_dir), 16).select("vec_id", "rk", "tok", "logit")


def greedy_token(spark, sf_dir):
    return selection.greedy(_logits(spark, sf_dir))


def _recent(spark, sf_dir):
    return _logits(spark, sf_dir).filter("tok % 7 = vec_id % 7").select("vec_id", "tok")


def repetition_penalty(spark, sf_dir):
    top = selection.top_k(_logits(spark, sf_dir), 16)
    return selection.penalised(top, _recent(spark, sf_dir), 1.3).select("vec_id", "tok", F.round("logit", 6).alias("logit"))


def softmax_temperature(spark, sf_dir):
    p = selection.softmax(selection.top_k(_logits(spark, sf_dir), 16), 0.8)
    return p.select("vec_id", "tok", F.round("p", 6).alias("p"))


def nucleus_filter(spark, sf_dir):
    p = selection.softmax(selection.top_k(_logits(spark, sf_dir), 16), 0.8)
    return selection.nucleus(p, 0.9).select("vec_id", "tok", F.round("p", 6).alias("p"))


def topk_densify(spark, sf_dir):
    return selection.dense(selection.top_k(_logits(spark, sf_dir), 16), _embeddings(spark, sf_dir), 64)


def categorical_gumbel(spark, sf_dir):
    return selection.draw(selection.top_k(_logits(spark, sf_dir), 16), seed=7, temperature=0.8, top_p=0.9)


def full_logits_draw(spark, sf_dir):
    return selection.draw(_logits(spark, sf_dir), seed=7, temperature=0.8, top_p=0.95)


def _x():
    return V.doubles(F.col("embedding"))


def _ramp(step: str):
    """0, step, 2 step, … modulo 8, as long as the vector."""
    return F.expr(f"transform(sequence(0, size(embedding) - 1), i -> (i % 8) * {step})")


def _values(df, out, key="vec_id"):
    return df.select(key, F.posexplode(out).alias("idx", "val")).withColumn("val", F.round("val", 6) + F.lit(0.0))


def rms_norm(spark, sf_dir):
    return _values(_embeddings(spark, sf_dir), V.rms_norm(_x(), _ramp("0.1D")))


def clip_residual(spark, sf_dir):
    big = F.transform(_x(), lambda a: a * 400000)
    return _values(_embeddings(spark, sf_dir), V.clipped_sum(big, F.reverse(big)))


def gelu_gate(spark, sf_dir):
    return _values(_embeddings(spark, sf_dir), V.gated(F.transform(_x(), lambda a: a * 8), F.reverse(_x())))


def rope_rotate(spark, sf_dir):
    e = _embeddings(spark, sf_dir).withColumns({"layer": F.col("vec_id") % 6, "position": F.col("vec_id") % 32})
    return _values(e, V.rope(_x(), F.col("position").cast("double"), V.rope_base(F.col("layer")), 64))


def _packed(spark, sf_dir):
    """A row of 64 weights for each vector: eight packed words, four groups of 16."""
    e, v = _embeddings(spark, sf_dir), F.col("vec_id")
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: ((v * 8 + j) * 2654435761 + 12345) % 4294967296)
    scales = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda g: ((v + g) % 7 + 1) * F.lit(0.25))
    biases = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda g: ((v + g * 2) % 5) * F.lit(-0.5))
    return e.select("vec_id", V.dequantized(words, scales, biases).alias("w"))


def dequantize_4bit(spark, sf_dir):
    return _packed(spark, sf_dir).select("vec_id", F.posexplode("w").alias("idx", "val"))


def _weights(spark, sf_dir):
    return _packed(spark, sf_dir).select(F.col("vec_id").alias("out"), "w")


def quantized_linear(spark, sf_dir):
    x = _embeddings(spark, sf_dir).select("vec_id", _x().alias("x"))
    return transformer.linear(x, _weights(spark, sf_dir), "vec_id").select("vec_id", "out", (F.round("val", 6) + F.lit(0.0)).alias("val"))


def final_head_topk(spark, sf_dir):
    x = _embeddings(spark, sf_dir).select("vec_id", V.rms_norm(_x(), _ramp("0.1D")).alias("x"))
    logits = transformer.linear(x, _weights(spark, sf_dir), "vec_id", top=3).select("vec_id", F.col("out").alias("tok"), F.round("val", 6).alias("logit"))
    return selection.top_k(logits, 3)


def embed_scale(spark, sf_dir):
    tokens = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 500).cast("long").alias("token"))
    e = transformer.embedded(tokens, _embeddings(spark, sf_dir), 3840)
    return e.select("conv_id", "turn", F.round(F.col("v")[0], 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _heads(spark, sf_dir, n=None):
    h = transformer.heads_of(_embeddings(spark, sf_dir), "vec_id", _x(), 16)
    h = h.select(F.floor(F.col("vec_id") / 8).cast("long").alias("seq"), F.col("vec_id").alias("pos"), "head", "dim", "val")
    return h if n is None else h.filter(F.col("head") < n)


def head_reshape(spark, sf_dir):
    return _heads(spark, sf_dir)


def kv_repeat(spark, sf_dir):
    return transformer.repeated_heads(_heads(spark, sf_dir, 2), 2).select("pos", "head", "dim", "val")


def attention_scores(spark, sf_dir):
    kv = transformer.repeated_heads(_heads(spark, sf_dir, 2), 2)
    a = transformer.attention(_heads(spark, sf_dir), kv, kv, 16**-0.5)
    return a.select("pos", "head", "dim", (F.round("val", 6) + F.lit(0.0)).alias("val"))


def kv_cache_append(spark, sf_dir):
    steps = _embeddings(spark, sf_dir).select(F.floor(F.col("vec_id") / 8).cast("long").alias("seq"), "vec_id")
    return transformer.cache_append(steps, "seq", "vec_id", "vec_id").select("vec_id", F.size("cache").alias("length"), F.array_join("cache", ",").alias("cache"))


def transformer_layer(spark, sf_dir):
    x, r = _x(), _ramp("0.1D")
    out = transformer.residual_stream(x, {"post_attention": r, "post_feedforward": r}, F.reverse(x), F.transform(x, lambda a: a * 8), F.reverse(x))
    return _values(_embeddings(spark, sf_dir), out)


def cosine_neighbors(spark, sf_dir):
    e = _embeddings(spark, sf_dir).select("vec_id", _x().alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    c = e.join(nxt, "vec_id").withColumn("cosine", V.cosine(F.col("v"), F.col("w")))
    return c.select("vec_id", F.round("cosine", 6).alias("cosine"), (F.col("cosine") > 0.1).alias("matches"))


def _frame_rows(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", (F.col("vec_id") % 2).alias("rank"), (F.col("vec_id") % 8 + 1).alias("code"), F.array(F.lit(1).cast("long"), F.col("vec_id") % 5 + 1, F.size("embedding").cast("long")).alias("shape"))


def frame_header(spark, sf_dir):
    return _frame_rows(spark, sf_dir).select("vec_id", frames.header_hex(F.col("rank"), F.col("code"), F.col("shape")).alias("header"))


def frame_size(spark, sf_dir):
    return _frame_rows(spark, sf_dir).select("vec_id", frames.frame_bytes(F.col("code"), F.col("shape")).cast("long").alias("bytes"))


def frame_latency(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3).cast("double").alias("sent"), (F.col("event_id") % 7).cast("double").alias("received"))
    return e.select("event_id", frames.latency_ms(F.col("sent"), F.col("received")).alias("latency_ms"))


def endpoint_stats(spark, sf_dir):
    f = frame_size(spark, sf_dir)
    return f.groupBy((F.col("vec_id") % 4).alias("endpoint")).agg(F.count("*").alias("received"), F.sum("bytes").alias("bytes"), F.count_if(F.col("bytes") > 1000).alias("large"))


def frame_roundtrip(spark, sf_dir):
    return frames.roundtrip(_embeddings(spark, sf_dir), "vec_id", "embedding", 1).select("vec_id", F.col("frame_bytes").cast("long").alias("frame_bytes"), "same_shape", "max_difference")


def frame_roundtrip_half(spark, sf_dir):
    r = frames.roundtrip(_embeddings(spark, sf_dir), "vec_id", "embedding", 2)
    return r.select("vec_id", F.col("frame_bytes").cast("long").alias("frame_bytes"), "same_shape", (F.col("max_difference") < 0.01).alias("close"))


QUERIES = {f.__name__: f for f in (topk_logits, greedy_token, repetition_penalty, softmax_temperature, nucleus_filter, topk_densify, categorical_gumbel, full_logits_draw, rms_norm, clip_residual, gelu_gate, rope_rotate, dequantize_4bit, quantized_linear, final_head_topk, embed_scale, head_reshape, kv_repeat, attention_scores, kv_cache_append, transformer_layer, cosine_neighbors, frame_header, frame_size, frame_latency, endpoint_stats, frame_roundtrip, frame_roundtrip_half)}

_L = "e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS logit, (generate_subscripts(embedding, 1) - 1)::INT AS tok FROM embeddings)"
_TOP = f"{_L}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, tok)::INT AS rk FROM e), t AS (SELECT * FROM r WHERE rk <= 16)"
_SOFT = f"{_TOP}, x AS (SELECT vec_id, tok, exp(logit / 0.8::DOUBLE - max(logit / 0.8::DOUBLE) OVER (PARTITION BY vec_id)) AS ex FROM t), s AS (SELECT vec_id, tok, ex / sum(ex) OVER (PARTITION BY vec_id) AS p FROM x)"
_V = "v AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS idx, unnest(embedding)::DOUBLE AS val, len(embedding) AS n FROM embeddings)"
_NORM = f"{_V}, q AS (SELECT vec_id, sqrt(sum(val * val) / max(n) + 1e-6) AS s FROM v GROUP BY vec_id), y AS (SELECT vec_id, idx, val / s * (1 + (idx % 8) * 0.1::DOUBLE) AS val FROM v JOIN q USING (vec_id))"
_W = "nib AS (SELECT vec_id, (j * 8 + i)::INT AS idx, (((vec_id * 8 + j) * 2654435761 + 12345) % 4294967296 >> (i * 4)) & 15 AS q, ((vec_id + j // 2) % 7 + 1) * 0.25::DOUBLE AS scale, ((vec_id + j // 2 * 2) % 5) * -0.5::DOUBLE AS bias FROM embeddings, range(8) a(j), range(8) g(i))"
_H = f"{_V}, h AS (SELECT vec_id // 8 AS seq, vec_id AS pos, (idx // 16)::INT AS head, (idx % 16)::INT AS dim, val FROM v)"
_GELU = "0.5::DOUBLE * g * (1 + tanh(sqrt(2 / pi()) * (g + 0.044715::DOUBLE * g * g * g)))"
_F = "f AS (SELECT vec_id, vec_id % 2 AS rank, vec_id % 8 + 1 AS code, vec_id % 5 + 1 AS d, len(embedding) AS n FROM embeddings), z AS (SELECT vec_id, 28 + d * n * CASE code WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 4 WHEN 5 THEN 2 ELSE 1 END AS bytes FROM f)"

ORACLE_SQL = {
    "topk_logits": f"WITH {_TOP} SELECT vec_id, rk, tok, logit FROM t",
    "greedy_token": f"WITH {_TOP} SELECT vec_id, tok FROM r WHERE rk = 1",
    "repetition_penalty": f"WITH {_TOP} SELECT vec_id, tok, round(CASE WHEN tok % 7 = vec_id % 7 THEN logit / 1.3::DOUBLE ELSE logit END, 6) AS logit FROM t",
    "softmax_temperature": f"WITH {_SOFT} SELECT vec_id, tok, round(p, 6) AS p FROM s",
    "nucleus_filter": f"WITH {_SOFT}, c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, tok ROWS UNBOUNDED PRECEDING) - p AS before FROM s), k AS (SELECT * FROM c WHERE before < 0.9::DOUBLE) SELECT vec_id, tok, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS p FROM k",
    "topk_densify": f"WITH {_TOP} SELECT e.vec_id, e.tok, coalesce(t.logit, -1e9::DOUBLE) AS logit FROM e LEFT JOIN t ON e.vec_id = t.vec_id AND e.tok = t.tok",
    "rms_norm": f"WITH {_NORM} SELECT vec_id, idx, round(val, 6) + 0.0::DOUBLE AS val FROM y",
    "clip_residual": f"WITH {_V} SELECT a.vec_id, a.idx, round(greatest(least(a.val * 400000 + b.val * 400000, 65504.0::DOUBLE), -65504.0::DOUBLE), 6) + 0.0::DOUBLE AS val FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.idx = a.n - 1 - a.idx",
    "gelu_gate": f"WITH {_V}, w AS (SELECT a.vec_id, a.idx, a.val * 8 AS g, b.val AS u FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.idx = a.n - 1 - a.idx) SELECT vec_id, idx, round({_GELU} * u, 6) + 0.0::DOUBLE AS val FROM w",
    "rope_rotate": f"WITH {_V}, a AS (SELECT vec_id, idx, val, idx % 32 AS k, vec_id % 32 * pow(CASE WHEN (vec_id % 6 + 1) % 6 = 0 THEN 1e6::DOUBLE ELSE 1e4::DOUBLE END, -2.0::DOUBLE * (idx % 32) / 64) AS t FROM v) SELECT a.vec_id, a.idx, round(CASE WHEN a.idx < 32 THEN a.val * cos(a.t) - b.val * sin(a.t) ELSE b.val * sin(a.t) + a.val * cos(a.t) END, 6) + 0.0::DOUBLE AS val FROM a JOIN a b ON a.vec_id = b.vec_id AND b.idx = (a.idx + 32) % 64",
    "dequantize_4bit": f"WITH {_W} SELECT vec_id, idx, q * scale + bias AS val FROM nib",
    "quantized_linear": f"WITH {_V}, {_W} SELECT v.vec_id, nib.vec_id AS out, round(sum(val * (q * scale + bias)), 6) + 0.0::DOUBLE AS val FROM v JOIN nib ON nib.idx = v.idx GROUP BY 1, 2",
    "final_head_topk": f"WITH {_NORM}, {_W}, lg AS (SELECT y.vec_id, nib.vec_id AS tok, round(sum(val * (q * scale + bias)), 6) AS logit FROM y JOIN nib ON nib.idx = y.idx GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, tok)::INT AS rk FROM lg) SELECT * FROM r WHERE rk <= 3",
    "embed_scale": "WITH t AS (SELECT conv_id, turn, length(text) % 500 AS token FROM conversations), s AS (SELECT conv_id, turn, list_transform(embedding, lambda x: x::DOUBLE * sqrt(3840.0::DOUBLE)) AS v FROM t JOIN embeddings ON vec_id = token) SELECT conv_id, turn, round(v[1], 6) AS first, round(list_sum(v), 4) AS total FROM s",
    "head_reshape": f"WITH {_H} SELECT * FROM h",
    "kv_repeat": f"WITH {_H} SELECT pos, (head * 2 + r)::INT AS head, dim, val FROM h, range(2) g(r) WHERE head < 2",
    "attention_scores": f"WITH {_H}, kv AS (SELECT seq, pos, (head * 2 + r)::INT AS head, dim, val FROM h, range(2) g(r) WHERE head < 2), sc AS (SELECT h.seq, h.pos, kv.pos AS at, h.head, sum(h.val * kv.val) * 0.25::DOUBLE AS s FROM h JOIN kv ON h.seq = kv.seq AND h.head = kv.head AND h.dim = kv.dim GROUP BY ALL), ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY pos, head)) AS x FROM sc), pr AS (SELECT *, x / sum(x) OVER (PARTITION BY pos, head) AS p FROM ex) SELECT pr.pos, pr.head, kv.dim, round(sum(p * kv.val), 6) + 0.0::DOUBLE AS val FROM pr JOIN kv ON kv.seq = pr.seq AND kv.head = pr.head AND kv.pos = pr.at GROUP BY 1, 2, 3",
    "kv_cache_append": "SELECT vec_id, (count(*) OVER w)::INT AS length, string_agg(vec_id::VARCHAR, ',') OVER w AS cache FROM embeddings WINDOW w AS (PARTITION BY vec_id // 8 ORDER BY vec_id ROWS UNBOUNDED PRECEDING)",
    "transformer_layer": f"WITH {_V}, b AS (SELECT a.vec_id, a.idx, a.val AS x, r.val AS y, a.n FROM v a JOIN v r ON a.vec_id = r.vec_id AND r.idx = a.n - 1 - a.idx), s1 AS (SELECT vec_id, sqrt(sum(y * y) / max(n) + 1e-6) AS s FROM b GROUP BY 1), h AS (SELECT b.*, greatest(least(x + y / s * (1 + (idx % 8) * 0.1::DOUBLE), 65504.0::DOUBLE), -65504.0::DOUBLE) AS hv, x * 8 AS g FROM b JOIN s1 USING (vec_id)), m AS (SELECT *, {_GELU} * y AS gu FROM h), s2 AS (SELECT vec_id, sqrt(sum(gu * gu) / max(n) + 1e-6) AS s FROM m GROUP BY 1) SELECT vec_id, idx, round(greatest(least(hv + gu / s * (1 + (idx % 8) * 0.1::DOUBLE), 65504.0::DOUBLE), -65504.0::DOUBLE), 6) + 0.0::DOUBLE AS val FROM m JOIN s2 USING (vec_id)",
    "cosine_neighbors": f"WITH {_V}, c AS (SELECT a.vec_id, sum(a.val * b.val) / (sqrt(sum(a.val * a.val)) * sqrt(sum(b.val * b.val))) AS c FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 AND a.idx = b.idx GROUP BY 1) SELECT vec_id, round(c, 6) AS cosine, c > 0.1 AS matches FROM c",
    "frame_header": f"WITH {_F} SELECT vec_id, '48505054' || printf('%08X', rank) || '00000003' || printf('%08X', code) || '00000001' || printf('%08X', d) || printf('%08X', n) AS header FROM f",
    "frame_size": f"WITH {_F} SELECT vec_id, bytes FROM z",
    "frame_latency": "SELECT event_id, CASE WHEN event_id % 3 > 0 AND event_id % 7 > 0 THEN (event_id % 7 - event_id % 3) * 1000.0::DOUBLE ELSE -1.0::DOUBLE END AS latency_ms FROM events",
    "endpoint_stats": f"WITH {_F} SELECT vec_id % 4 AS endpoint, count(*) AS received, sum(bytes)::BIGINT AS bytes, count(*) FILTER (bytes > 1000) AS large FROM z GROUP BY 1",
    "frame_roundtrip": "SELECT vec_id, (24 + 4 * len(embedding))::BIGINT AS frame_bytes, TRUE AS same_shape, 0.0::DOUBLE AS max_difference FROM embeddings",
    "frame_roundtrip_half": "SELECT vec_id, (24 + 2 * len(embedding))::BIGINT AS frame_bytes, TRUE AS same_shape, TRUE AS close FROM embeddings",
}
