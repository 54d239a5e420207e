"""Queries over generated text and messages, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions.text import STOP_WORDS
from sparkloom.operators import prompts, repetition
from sparkloom.sources.tables import table

_LINES = f"""
 l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents),
 s AS (SELECT doc_id, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM l),
 t AS (SELECT doc_id, pos, line, list_distinct(list_filter(string_split_regex(lower(line), '\\s+'), lambda w: length(w) > 1 AND NOT list_contains({STOP_WORDS!r}, w))) AS words FROM s WHERE length(line) >= 20),
 e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM t WHERE len(words) > 0),
 m AS (SELECT a.doc_id, a.pos, a.line, count(b.rn) AS match_count FROM e a LEFT JOIN e b ON a.doc_id = b.doc_id AND b.rn BETWEEN a.rn - 20 AND a.rn - 1
   AND len(list_intersect(a.words, b.words)) >= 0.7::DOUBLE * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) GROUP BY a.doc_id, a.pos, a.line),
 h AS (SELECT * FROM m WHERE match_count >= 3)
"""


def loop_match_counts(spark, sf_dir):
    lines = repetition.eligible_lines(table(spark, sf_dir, "documents"))
    return repetition.match_counts(lines).select("doc_id", "pos", F.col("match_count").cast("long").alias("match_count"))


def loop_detect_posthoc(spark, sf_dir):
    return repetition.verdicts(table(spark, sf_dir, "documents"))


def loop_stop_first(spark, sf_dir):
    lines = repetition.eligible_lines(table(spark, sf_dir, "documents"))
    return repetition.detections(lines, action="stop").select("doc_id", "pos", "line", "threshold", "action")


def loop_warn_all(spark, sf_dir):
    lines = repetition.eligible_lines(table(spark, sf_dir, "documents"))
    return repetition.detections(lines, action="warn").select("doc_id", "pos", "threshold", "action")


def line_jaccard_adjacent(spark, sf_dir):
    return repetition.adjacent_similarity(repetition.eligible_lines(table(spark, sf_dir, "documents")))


def prompt_assembly_roles(spark, sf_dir):
    return prompts.with_roles(table(spark, sf_dir, "conversations"))


def prompt_assembly_plain(spark, sf_dir):
    return prompts.plain(table(spark, sf_dir, "conversations"))


def no_think_suffix(spark, sf_dir):
    model = F.when(F.col("conv_id") % 2 == 0, "qwen3-4b").otherwise("gemma-3-12b")
    return prompts.last_message(table(spark, sf_dir, "conversations"), model)


def content_length(spark, sf_dir):
    return prompts.lengths(table(spark, sf_dir, "conversations"))


def sse_chunks(spark, sf_dir):
    answers = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return prompts.chunks(answers, ["conv_id", "turn"])


def history_flatten(spark, sf_dir):
    """A conversation's user messages, but the last, with the answer that follows at once;
    the last is the new message."""
    next_turn = Window.partitionBy("conv_id").orderBy("turn")
    answer = F.when(F.lead("role").over(next_turn) == "assistant", F.lead("text").over(next_turn))
    users = table(spark, sf_dir, "conversations").withColumn("answer", answer).filter("role = 'user'")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("user"), F.col("answer").alias("assistant"))))
    chats = users.groupBy("conv_id").agg(turns.alias("turns"))
    chats = chats.select("conv_id", F.slice("turns", F.lit(1), F.size("turns") - 1).alias("history"), F.element_at("turns", -1)["user"].alias("message"))
    return prompts.flattened(chats, "conv_id")


def response_envelope(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.select(F.concat(F.lit("r-"), F.col("event_id")).alias("request_id"), F.lit("m").alias("model"), F.col("event_type").alias("text"), (F.col("event_id") % 100).alias("tokens"), (F.col("event_id") % 37).cast("double").alias("tok_s"), (F.col("event_id") % 2).cast("double").alias("ar"), (F.col("event_id") % 11).cast("double").alias("time_s"))
    return prompts.envelope(r)


_ENVELOPE = """SELECT 'r-' || event_id AS request_id,
 '{"id":"r-' || event_id || '","object":"chat.completion","model":"m","choices":[{"index":0,"message":{"role":"assistant","content":"' || event_type || '"},"finish_reason":"stop"}],"usage":{"completion_tokens":' || (event_id % 100) || '},"timing":{"tok_s":' || (event_id % 37) || '.0,' || CASE WHEN event_id % 2 = 0 THEN '' ELSE '"acceptance_rate":1.0,' END || '"time_s":' || (event_id % 11) || '.0}}' AS body
FROM events"""

QUERIES = {f.__name__: f for f in (loop_match_counts, loop_detect_posthoc, loop_stop_first, loop_warn_all, line_jaccard_adjacent, prompt_assembly_roles, prompt_assembly_plain, no_think_suffix, content_length, sse_chunks, response_envelope, history_flatten)}

ORACLE_SQL = {
    "history_flatten": """WITH c AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 u AS (SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AS newest FROM c WHERE role = 'user'),
 m AS (SELECT conv_id, turn, 0 AS k, 'user' AS role, text AS content FROM u UNION ALL SELECT conv_id, turn, 1, 'assistant', next_text FROM u WHERE NOT newest AND next_role = 'assistant' AND coalesce(next_text, '') <> '')
 SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1)::INT AS idx, role, content FROM m""",
    "loop_match_counts": f"WITH {_LINES} SELECT doc_id, pos, match_count FROM m",
    "loop_detect_posthoc": f"WITH {_LINES}, f AS (SELECT doc_id, min(pos) AS first_pos, arg_min(line, pos) AS first_line, count(*) AS n_hits FROM h GROUP BY doc_id) SELECT d.doc_id, f.first_pos IS NOT NULL AS loop, f.first_pos, f.first_line, coalesce(f.n_hits, 0) AS n_hits FROM documents d LEFT JOIN f USING (doc_id)",
    "loop_stop_first": f"WITH {_LINES} SELECT doc_id, min(pos) AS pos, arg_min(line, pos) AS line, 3 AS threshold, 'stop' AS action FROM h GROUP BY doc_id",
    "loop_warn_all": f"WITH {_LINES} SELECT doc_id, pos, 3 AS threshold, 'warn' AS action FROM h",
    "line_jaccard_adjacent": f"WITH {_LINES} SELECT a.doc_id, a.pos, round(len(list_intersect(a.words, b.words))::DOUBLE / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))), 6) AS similarity FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.rn = a.rn - 1",
    "prompt_assembly_roles": "SELECT conv_id, string_agg(CASE role WHEN 'system' THEN 'System: ' || text WHEN 'assistant' THEN 'Assistant: ' || text ELSE text END, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id",
    "prompt_assembly_plain": "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id",
    "no_think_suffix": "WITH l AS (SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text, CASE WHEN conv_id % 2 = 0 THEN 'qwen3-4b' ELSE 'gemma-3-12b' END AS model FROM conversations GROUP BY conv_id) SELECT conv_id, model, role, CASE WHEN contains(lower(model), 'qwen3') AND role = 'user' THEN regexp_replace(text, '\\s+$', '') || ' /no_think' ELSE text END AS text FROM l",
    "content_length": "SELECT conv_id, count(*) AS n_messages, sum(length(text))::BIGINT AS total_chars FROM conversations GROUP BY conv_id",
    "sse_chunks": "WITH a AS (SELECT conv_id, turn, string_split(text, ' ') AS p FROM conversations WHERE role = 'assistant'), c AS (SELECT conv_id, turn, generate_subscripts(p, 1) - 1 AS idx, unnest(p) AS x FROM a) SELECT conv_id, turn, idx, CASE WHEN idx > 0 THEN ' ' || x ELSE x END AS delta, NULL::VARCHAR AS finish_reason FROM c UNION ALL SELECT conv_id, turn, len(p), '', 'stop' FROM a UNION ALL SELECT conv_id, turn, len(p) + 1, '[DONE]', NULL FROM a",
    "response_envelope": _ENVELOPE,
}
