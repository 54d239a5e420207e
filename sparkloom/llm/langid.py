"""Operator 8: language identification by nearest centroids.

A text's vector counts the 1- to 3-grams of its lower-cased words (with a mark at each
end), hashed to `dims` places, weighted by inverse document frequency and normalised.
Each language has several centroids, found by spherical k-means over a bounded sample
of labelled texts; a text gets the language of the centroid with the largest cosine.
A text farther from its centroid than nearly all labelled texts of the language are from
theirs (the REJECT quantile of their cosines) is marked as rejected.

Fitting bound: at most `per_language` documents a language, those with the smallest hashes
of doc_id; their ids are chosen without the texts. Scoring covers whole texts of all rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, tidy, whole_texts

_WORD = re.compile(r"[^\W\d_]+")
DIMS = 1 << 14
REJECT = 0.005
SALTS = 64


class Grams:
    """Words to the hashed places of their n-grams, as uint16 bytes, with a bounded memo."""

    def __init__(self, most: int = 300_000):
        self.memo: dict[str, bytes] = {}
        self.most = most

    def of(self, word: str) -> bytes:
        marked = f"_{word}_"
        data = marked.encode("utf-32-le")
        grams = [zlib.crc32(data[i : i + 4 * n]) & (DIMS - 1) for n in (1, 2, 3) for i in range(4 if n == 1 else 0, len(data) - 4 * n + (0 if n == 1 else 1), 4)]
        return np.array(grams, "<u2").tobytes()

    def text(self, text: str | None) -> np.ndarray | None:
        """The places of all n-grams of the text, or None if it has no letter."""
        words = _WORD.findall((text or "").lower())
        if not words or not any(w.isalpha() for w in words) and not any(c.isalpha() for w in words for c in w):
            return None
        memo = self.memo
        new = set(words).difference(memo)
        if len(memo) + len(new) > self.most:
            memo = self.memo = {w: memo[w] for w in set(words) if w in memo}
        extra = {}
        for w in new:
            (memo if len(w) <= 40 else extra)[w] = self.of(w)
        return np.frombuffer(b"".join([memo[w] if w in memo else extra[w] for w in words] if extra else map(memo.__getitem__, words)), "<u2")


@dataclass
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray  # a row each, normalised
    reject: dict[str, float]  # the least cosine that a text of the language may have

    def cosines(self, grams: list[np.ndarray]) -> np.ndarray:
        tf = np.stack([np.bincount(g, minlength=DIMS) for g in grams]) * self.idf
        return (tf @ self.centroids.T) / np.linalg.norm(tf, axis=1, keepdims=True)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first starts."""
    centres = [x.mean(0) / max(np.linalg.norm(x.mean(0)), 1e-12)]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.argmin(np.max(x @ np.stack(centres).T, 1))])
    c = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        new = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
    sizes = np.bincount(np.argmax(x @ c.T, 1), minlength=len(c))
    return c[sizes >= max(1, len(x) // 50)]


def fit(labelled: DataFrame, per_language: int = 400, clusters: int = 3) -> Model | None:
    """From labelled (doc_id, text, lang; null labels and texts don't count); None if nothing
    is left. Rows with the same doc_id and label count once, by the least of their texts."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    lot = F.xxhash64(F.lit(8), "doc_id")
    # first the least of each language and salt, so that no language is ranked in one task
    ids = rows.select("lang", "doc_id", lot.alias("lot"), F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(SALTS)).alias("salt")).distinct()
    for part in (["lang", "salt"], ["lang"]):
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*part).orderBy("lot", "doc_id"))).filter(F.col("r") <= per_language)
    chosen = F.broadcast(ids.select(F.col("lang").alias("of"), F.col("doc_id").alias("id")))
    texts = rows.join(chosen, (F.col("lang") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sample = texts.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text").collect()
    grams, by_language = Grams(), {}
    for row in sorted(sample):
        if (g := grams.text(row["text"])) is not None:
            by_language.setdefault(row["lang"], []).append(np.bincount(g, minlength=DIMS).astype(np.float32))
    if not by_language:
        return None
    every = np.concatenate([np.stack(v) for v in by_language.values()])
    idf = np.log((1 + len(every)) / (1 + (every > 0).sum(0))) + 1
    languages, centroids, reject = [], [], {}
    for language, counts in sorted(by_language.items()):
        x = np.stack(counts) * idf
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = _clusters(x, clusters)
        reject[language] = float(np.quantile((x @ c.T).max(1), REJECT))
        languages += [language] * len(c)
        centroids.append(c)
    return Model(languages, idf, np.concatenate(centroids), reject)


def predict(docs: DataFrame, model: Model | None, reject: float | None = None) -> DataFrame:
    """doc_id, lang_pred, score (best cosine, 0 to 1), rejected (score below `reject`; by
    default below what the model has learned for the language).

    Null text or one without letters: `und` with score 0, rejected; so is every row if
    there is no model. Repeated rows are predicted each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def score(batches):
        grams, m = Grams(), shared.value
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            langs, scores = ["und"] * len(ids), [0.0] * len(ids)
            held: list[tuple[int, np.ndarray]] = []

            def flush(held=held, langs=langs, scores=scores):
                if held:
                    for (i, _), row in zip(held, m.cosines([g for _, g in held]), strict=True):
                        best = int(np.argmax(row))
                        langs[i], scores[i] = m.languages[best], float(min(1.0, max(0.0, row[best])))
                    held.clear()

            for i, text in enumerate(texts):
                if m is not None and (g := grams.text(text.as_py())) is not None:
                    held.append((i, g))
                    if len(held) == 64:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays([ids, pa.array(langs), pa.array(scores), pa.array([x == "und" or s < (m.reject.get(x, 0.0) if reject is None else reject) for x, s in zip(langs, scores, strict=True)])], schema=out)

    return whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(score), "doc_id long, lang_pred string, score double, rejected boolean")


def identified(docs: DataFrame, **options) -> DataFrame:
    """Fits on the rows of docs (doc_id, text, lang) that are not held out, and predicts all:
    doc_id, held_out (false for a null doc_id), lang_pred, score, rejected; a row for each
    row of docs, `und` for null texts and those without letters, none for no rows."""
    found = predict(docs, fit(docs.filter(~held_out()), **options))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
