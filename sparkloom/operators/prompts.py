"""Prompts from message lists, and answers as chunks and envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import rstrip


def _joined(messages: DataFrame, key: str, order: str, piece: Column) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("s"))))
    return messages.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["s"]), "\n").alias("prompt"))


def with_roles(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """System and assistant messages with their role in front, others as they are."""
    label = F.when(F.col("role") == "system", F.concat(F.lit("System: "), "text")).when(F.col("role") == "assistant", F.concat(F.lit("Assistant: "), "text")).otherwise(F.col("text"))
    return _joined(messages, key, order, label)


def plain(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    return _joined(messages, key, order, F.col("text"))


def last_message(messages: DataFrame, model: Column, thinking: bool = False, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, model, role, text of the last message; for models of the qwen3 family without
    thinking a user's last message gets the suffix that switches it off."""
    last = messages.groupBy(key).agg(F.max_by("role", order).alias("role"), F.max_by("text", order).alias("text")).withColumn("model", model)
    off = F.contains(F.lower("model"), F.lit("qwen3")) & F.lit(not thinking) & (F.col("role") == "user")
    return last.select(key, "model", "role", F.when(off, F.concat(rstrip(F.col("text")), F.lit(" /no_think"))).otherwise(F.col("text")).alias("text"))


def flattened(chats: DataFrame, key: str, history: str = "history", message: str = "message") -> DataFrame:
    """key, idx, role, content: a chat's history (an array of structs user, assistant) and
    its new message as one list of messages. An exchange without answer has no assistant."""
    said = F.flatten(F.transform(history, lambda x: F.array(F.struct(F.lit("user").alias("role"), x["user"].alias("content")), F.struct(F.lit("assistant").alias("role"), x["assistant"].alias("content")))))
    kept = F.filter(said, lambda m: (m["role"] == "user") | (F.coalesce(m["content"], F.lit("")) != ""))
    every = F.concat(kept, F.array(F.struct(F.lit("user").alias("role"), F.col(message).alias("content"))))
    return chats.select(key, F.posexplode(every).alias("idx", "m")).select(key, "idx", "m.role", "m.content")


def lengths(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    return messages.groupBy(key).agg(F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("total_chars"))


def chunks(answers: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, idx, delta, finish_reason: a row for each piece between single blanks (from
    the second on with its blank), then one with the reason, then the end mark."""
    parts = F.split(F.col(text), " ")
    n = F.size(parts)
    rows = F.transform(parts, lambda x, i: F.struct(i.alias("idx"), F.when(i > 0, F.concat(F.lit(" "), x)).otherwise(x).alias("delta"), F.lit(None).cast("string").alias("finish_reason")))
    ends = F.array(F.struct(n.alias("idx"), F.lit("").alias("delta"), F.lit("stop").alias("finish_reason")), F.struct((n + 1).alias("idx"), F.lit("[DONE]").alias("delta"), F.lit(None).cast("string").alias("finish_reason")))
    return answers.select(*keys, F.explode(F.concat(rows, ends)).alias("c")).select(*keys, "c.*")


def envelope(results: DataFrame) -> DataFrame:
    """results (request_id, model, text, tokens, tok_s, ar, time_s) as JSON responses:
    tok_s to 1 decimal, ar to 3 (null if 0), time_s to 2."""
    message = F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason"))
    extra = F.struct(F.round("tok_s", 1).alias("tok_s"), F.when(F.col("ar") != 0, F.round("ar", 3)).alias("acceptance_rate"), F.round("time_s", 2).alias("time_s"))
    usage = F.struct(F.col("tokens").alias("completion_tokens"))
    body = F.struct(F.col("request_id").alias("id"), F.lit("chat.completion").alias("object"), "model", F.array(choice).alias("choices"), usage.alias("usage"), extra.alias("timing"))
    return results.select("request_id", F.to_json(body).alias("body"))


def throughput(tokens: Column, elapsed: Column) -> Column:
    return tokens / F.greatest(elapsed, F.lit(0.001))
