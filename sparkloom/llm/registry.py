"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, langid, lines, near_duplicates, neighbours, packing, repair, sharding, toxicity
from .common import read_table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(ids.cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")
    )


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_documents(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.grouped(read_table(spark, sf_dir, "documents"))


def op5_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.written(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicated(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", "text")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(read_table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(read_table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_neighbours": op2_neighbours,
    "op3_packing": op3_packing,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_repair": op5_repair,
    "op6_toxicity": op6_toxicity,
    "op7_lines": op7_lines,
    "op8_language": op8_language,
    "op9_main_text": op9_main_text,
    "op10_sharding": op10_sharding,
}
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANKED = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"

#: Operators 1 and 4 are exact, so SQL can say what they return; the others choose, fit or
#: write files, and are tested otherwise.
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 bl AS (SELECT item_id, w, least(13, len(w)) AS l FROM b WHERE len(w) > 0),
 bw AS (SELECT DISTINCT item_id, l, array_to_string(list_slice(w, i, i + l - 1), ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM bl)),
 ls AS (SELECT DISTINCT l FROM bw), x AS (SELECT doc_id, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS p FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)),
 h AS (SELECT x.doc_id, x.i, x.l, bw.item_id FROM x JOIN bw ON x.l = bw.l AND x.p = bw.p),
 c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS k FROM h) GROUP BY doc_id),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
 SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op4_near_duplicates": f"""WITH RECURSIVE d AS (SELECT doc_id, {_BLANKED} AS w FROM documents), g AS (SELECT doc_id, w, least(5, len(w)) AS l FROM d WHERE len(w) > 0),
 s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + l - 1), ' ') AS h FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM g)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
 f AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
 r(v, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT f.y, r.c FROM r JOIN f ON f.x = r.v)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id""",
}
