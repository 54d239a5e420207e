"""Operator 6: toxicity by a support vector machine with a subsequence string kernel.

The kernel of two words sums, over all sequences of three symbols, the products of their
weights: a sequence counts lambda^(stretch it lies in) wherever it occurs, gaps allowed,
so `i-d-i-o-t` and `idxiot` stay near `idiot`. Letters and digits are symbols; other
characters only widen gaps. Kernels are normalised.

A sentence is as toxic as its most toxic word (multiple instances): training starts with
the words that stand in clearly more toxic than other texts, and then again takes from
each toxic sentence the word that scores highest. Landmarks (those words and a sample of others) give a Nystroem map, in
which a linear machine with squared hinge loss is fitted by Newton steps. As the kernel
has finitely many features, the fitted function is one weight for each sequence of three
symbols, which scores a word without touching landmarks. Platt's sigmoid over a text's highest
scores and its length makes a probability.

Fitting bound: at most `per_class` labelled rows of each class, those with the smallest
hashes of doc_id. Scoring covers all words of whole texts of all rows.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, give_back, held_out, mix64, tidy, whole_texts

SYMBOLS = 64  # 0: no symbol; 1-26 letters; 27-36 digits; 37-61 other letters, hashed; 62, 63: a word's ends
LAMBDA = 0.6
LONGEST = 14  # longer words are scored by windows of this length
RANKS = (1, 2, 3, 5, 8)  # of a text's words, highest first
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_ENDS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…–—“”‘’«»¡¿"
_SENTENCE = re.compile(r"[.!?\n]+")
_ASCII = np.zeros(128, np.int64)
_ASCII[97:123] = np.arange(1, 27)
_ASCII[48:58] = np.arange(27, 37)


def units(text: str | None) -> list[str]:
    """Lower-cased words between blanks, and runs of single characters as one word more."""
    low = (text or "").lower()
    spaced = _SPACED.findall(low) if " " in low else []
    return low.split() + spaced


def _symbols(words: list[str], length: int) -> np.ndarray:
    """Rows of symbols for words of one length."""
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length).astype(np.int64)
    other = 37 + (mix64(code.astype(np.uint64)) % np.uint64(25)).astype(np.int64)
    inner = np.where(code < 128, _ASCII[np.minimum(code, 127)], np.where(code > 0xBF, other, 0))
    return np.pad(inner, ((0, 0), (1, 1)), constant_values=((0, 0), (62, 63)))


@lru_cache(64)
def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """All places of three symbols in a word of this length, and their weights."""
    at = np.array(list(combinations(range(length), 3)), np.int64).reshape(-1, 3)
    return at, LAMBDA ** (at[:, 2] - at[:, 0] + 1.0)


def features(words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence codes and normalised weights of words of one length, a row each. A row
    has equal codes side by side; the norm takes their sum."""
    s = _symbols(words, length)
    at, weight = _triples(length + 2)
    a, b, c = s[:, at[:, 0]], s[:, at[:, 1]], s[:, at[:, 2]]
    w = weight * ((a > 0) & (b > 0) & (c > 0))
    code = (a * SYMBOLS + b) * SYMBOLS + c
    order = np.argsort(code, 1)
    code, w = np.take_along_axis(code, order, 1), np.take_along_axis(w, order, 1)
    last = np.ones(code.shape, bool)
    last[:, :-1] = code[:, 1:] != code[:, :-1]
    run = np.cumsum(w, 1)
    # sums of equal codes, at the last of each: differences of the running sum
    flat = np.where(last, run, 0.0)
    before = np.maximum.accumulate(np.where(last, run, 0.0), 1)
    before = np.concatenate([np.zeros((len(flat), 1)), before[:, :-1]], 1)
    sums = np.where(last, run - before, 0.0)
    norm = np.sqrt((sums**2).sum(1, keepdims=True))
    return code, sums / np.maximum(norm, 1e-12)


def _windows(word: str) -> list[str]:
    """The word without punctuation at its ends, in parts of at most LONGEST characters."""
    word = word.strip(_ENDS)
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def word_scores(words: list[str], table: np.ndarray) -> np.ndarray:
    """The fitted function of each word: the largest of its windows."""
    flat, owner = [], []
    for k, word in enumerate(words):
        for part in _windows(word):
            flat.append(part)
            owner.append(k)
    lengths = np.array([len(x) for x in flat], np.int64)
    got = np.zeros(len(flat))
    for n in np.unique(lengths).tolist():
        if n >= 3:
            at = np.flatnonzero(lengths == n)
            for lo in range(0, len(at), 512):
                part = at[lo : lo + 512]
                code, w = features([flat[i] for i in part.tolist()], n)
                got[part] = (table[code] * w).sum(1)
    out = np.full(len(words), -np.inf)
    np.maximum.at(out, np.array(owner, np.int64), got)
    return out


def dense(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised features of words up to LONGEST as triplets: row, code, weight."""
    rows, codes, weights = [], [], []
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths[lengths >= 3]).tolist() if len(words) else ():
        at = np.flatnonzero(lengths == n)
        code, w = features([words[i] for i in at.tolist()], n)
        i, j = np.nonzero(w)
        rows.append(at[i])
        codes.append(code[i, j])
        weights.append(w[i, j])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, codes, weights))


def kernel(xs: list[str], ys: list[str]) -> np.ndarray:
    """The normalised kernel of all pairs."""
    rj, cj, wj = dense(ys)
    used, column = np.unique(cj.astype(np.int64), return_inverse=True)
    y = np.zeros((len(ys), len(used)), np.float32)
    y[rj, column] = wj
    out = np.zeros((len(xs), len(ys)), np.float32)
    for lo in range(0, len(xs), 256):
        ri, ci, wi = dense(xs[lo : lo + 256])
        at = np.minimum(np.searchsorted(used, ci), max(0, len(used) - 1))
        held = used[at] == ci if len(used) else np.zeros(len(ci), bool)
        x = np.zeros((len(xs[lo : lo + 256]), len(used)), np.float32)
        x[ri[held], at[held]] = wi[held]
        out[lo : lo + 256] = x @ y.T
    return out


@dataclass
class Model:
    table: np.ndarray  # a weight for each sequence of three symbols
    bias: float  # of the machine: a word's margin is its score plus bias
    weights: np.ndarray  # of a text's measures, and the offset last

    def probability(self, measures: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(np.clip(-(measures @ self.weights[:-1] + self.weights[-1]), -50, 50)))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> np.ndarray:
    """Linear machine with squared hinge loss; the last weight is the offset."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(15):
        on = y * (x @ w) < 1
        h, g = ridge.copy(), np.zeros(x.shape[1])
        for lo in range(0, len(x), 2048):
            m = on[lo : lo + 2048]
            part = x[lo : lo + 2048][m]
            a = (part * (c * weight[lo : lo + 2048][m])[:, None]).T
            h += a @ part
            g += a @ y[lo : lo + 2048][m]
        new = np.linalg.solve(h, g)
        if np.abs(new - w).max() < 1e-6:
            return new
        w = 0.5 * w + 0.5 * new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Platt's sigmoid of several margins: logistic regression by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, r = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    r[-1, -1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + r, x.T @ (p - y) + r @ w)
        w = w - np.clip(step, -2, 2)
    return w


def _copies(texts: list[str]) -> list[int]:
    """A number for each text, equal for copies: by the least hashes of its 4-word runs."""
    seen: dict[int, int] = {}
    out = []
    for k, text in enumerate(texts):
        w = text.lower().split()
        h = mix64(np.array([hash_of(" ".join(w[i : i + 4])) for i in range(max(1, len(w) - 3))], np.uint64))
        marks = [int(mix64(h ^ np.uint64(c)).min()) for c in range(1, 7)]
        mine = next((seen[m] for m in marks if m in seen), k)
        seen |= dict.fromkeys(marks, mine)
        out.append(mine)
    return out


def hash_of(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


def fit(labelled: DataFrame, landmarks: int = 192, negatives: int = 8_000, rounds: int = 3) -> Model | None:
    """From labelled (doc_id, text, toxic 0/1), a bounded sample that comes to the driver;
    null labels and texts don't count. Without rows of both classes the result is None.
    Copies of a text count once."""
    usable = labelled.select("doc_id", "text", "toxic").filter("toxic IN (0, 1) AND text IS NOT NULL")
    rows = [tuple(r) for r in sorted(usable.collect(), key=lambda r: (r["toxic"], r["doc_id"], r["text"]))]
    own, kept = set(), []
    for (_, text, y), group in zip(rows, _copies([r[1] for r in rows]), strict=True):
        if (group, y) not in own:
            own.add((group, y))
            kept.append((text, y))
    n1, n0 = sum(y for _, y in kept), sum(1 - y for _, y in kept)
    if not n1 or not n0:
        return None
    # toxic sentences as bags of words; for association, in how many texts a word stands
    held = [Counter(), Counter()]
    for text, y in kept:
        held[y].update({sys.intern(p) for u in set(units(text)) for p in _windows(u)})
    rate = {}
    for w, a in held[1].items():
        b = held[0][w]
        p = (a + b) / (n1 + n0)
        if len(w) >= 3 and a >= max(4, 0.01 * n1) and a * n0 > 4 * b * n1:
            rate[w] = (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    telling = [w for w, z in sorted(rate.items(), key=lambda x: (-x[1], x[0])) if z > 5]
    if not telling:
        return Model(np.zeros(SYMBOLS**3), -9.0, np.array([0.0] * (len(RANKS) + 1) + [np.log((n1 + 1) / (n0 + 1))]))
    clean = sorted((w for w in held[0] if len(w) >= 3 and w not in rate), key=lambda w: (hash_of(w), w))
    held.clear()
    others = clean[:negatives]
    marks = list(dict.fromkeys(telling[: landmarks // 2] + others))[:landmarks]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    sentences = [list(dict.fromkeys(p for u in units(s) for p in _windows(u) if len(p) >= 3)) for (text, y) in kept if y for s in _SENTENCE.split(text)]
    flat = sorted({p for s in sentences for p in s})
    witnesses, hard = set(telling), set()
    for _ in range(rounds):
        positive, negative = sorted(witnesses), sorted(set(others) | hard)
        x = kernel(positive + negative, marks) @ root
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        weight = np.where(y > 0, 1 / len(positive), 1 / len(negative)) * 1000
        w = _machine(x, y, weight)
        beta = root @ w[:-1]
        table = np.zeros(SYMBOLS**3)
        row, code, value = dense(marks)
        np.add.at(table, code.astype(np.int64), beta[row] * value)
        # the words of clean texts that score highest are negatives of the next round
        s = np.concatenate([word_scores(clean[lo : lo + 20_000], table) for lo in range(0, len(clean), 20_000)])
        hard |= {clean[i] for i in np.argsort(-s)[: negatives // 4].tolist()}
        # and the highest word of each toxic sentence is a positive, if it is telling
        score = dict(zip(flat, word_scores(flat, table), strict=True))
        top = {max(s, key=lambda p: (score[p], p)) for s in sentences if s}
        witnesses |= {p for p in top if score[p] + w[-1] > 0 and rate.get(p, 0) > 4}
    measures = np.concatenate([_measures([t for t, _ in kept[lo : lo + 128]], table, float(w[-1]), memo, most=60_000) for memo in [{}] for lo in range(0, len(kept), 128)])
    return Model(table, float(w[-1]), _logistic(measures, np.array([y for _, y in kept])))


def _measures(texts: list[str | None], table: np.ndarray, bias: float, memo: dict[str, float], most: int = 100_000) -> np.ndarray:
    """A row for each text: its distinct words' highest margins, by RANKS, from 0 (-1 and
    below, or fewer words) to 1 (1 and above), and the logarithm of the number of words
    over 50. The memo keeps frequent words."""
    split = [set(units(t)) for t in texts]
    new = set().union(*split)
    if len(memo) > most:
        kept = {w: memo[w] for w in new if w in memo}
        memo.clear()
        memo.update(kept)
    new = sorted(new.difference(memo))
    memo.update(zip(new, word_scores(new, table).tolist(), strict=True))
    out = np.zeros((len(texts), len(RANKS) + 1))
    for row, words in zip(out, split, strict=True):
        top = np.fromiter(map(memo.__getitem__, words), float, len(words))
        if len(top) > RANKS[-1]:
            top = np.partition(top, len(top) - RANKS[-1])[-RANKS[-1] :]
        top = np.sort(top)[::-1]
        for k, r in enumerate(RANKS):
            row[k] = min(1.0, max(0.0, (top[r - 1] + bias + 1) / 2)) if r <= len(top) else 0.0
        row[-1] = np.log(max(50, len(words)) / 50)
    return out


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1). Null and empty texts get the score of no evidence; without
    a model every row gets 0. Repeated rows are scored each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def rate(batches):
        memo: dict[str, float] = {}
        for batch in batches:
            n = batch.num_rows
            texts = batch.column("text")
            got = np.zeros(n)
            for lo in range(0, n, 128) if shared.value is not None else ():
                m = shared.value
                got[lo : lo + 128] = m.probability(_measures(texts.slice(lo, 128).to_pylist(), m.table, m.bias, memo))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], schema=out)

    return whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(rate), "doc_id long, score double")


def keep_below(docs: DataFrame, model: Model | None, threshold: float) -> DataFrame:
    """The rows of docs, all columns, whose own text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        memo: dict[str, float] = {}
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            texts = batch.column("text")
            for lo in range(0, batch.num_rows, 128) if shared.value is not None else ():
                m = shared.value
                good[lo : lo + 128] = m.probability(_measures(texts.slice(lo, 128).to_pylist(), m.table, m.bias, memo)) < threshold
            yield batch.filter(pa.array(good))

    return whole_texts(docs).mapInArrow(tidy(keep), docs.schema)


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = 2000, **options) -> Model | None:
    """The model of labelled rows that are not held out: of each class those `per_class`
    labels with the smallest hashes of doc_id. A doc_id with both labels counts as toxic, of
    its texts the least is learned from. Only their ids are broadcast and only their texts
    leave the documents' place. None if there are no such rows."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = [bounded_sample(marks.filter(F.col("toxic") == y), per_class) for y in (0, 1)]
    chosen = F.broadcast(sample[0].unionByName(sample[1]).withColumnRenamed("doc_id", "_id"))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"))
    model = fit(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), **options)
    give_back()  # the driver's memory, too
    return model


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from `threshold` on), a row for each row of docs
    (doc_id, text, any others), repeated ones too; held_out is false for a null doc_id, and a
    null text is scored as an empty one. Without labels every score is 0."""
    found = score(docs, fitted(docs, labels, **options))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
