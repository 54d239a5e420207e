"""Operator 4: near-duplicate documents by a signature-coordinate inverted join.

A document's set has its distinct runs of five words; MinHash gives it COORDINATES
values. Documents with equal sets are one class. Each class is posted under the pairs of
its first POSTED coordinates and their values. Lists are merged by prefix and skip: pairs
that only one class has are dropped, a class that has fewer than `posted_matches` left
can't have a partner, and of the others only the rarest (all but posted_matches - 1) need
merging, since two classes with enough meetings meet there. The collisions in the lists
that are skipped, and under the coordinates that aren't posted, are counted on signatures
of four bits a coordinate, which the merge carries along: pairs with fewer than `matches`
collisions, or set sizes that rule a link out, are never made. Candidates are confirmed on
the full sets.

For two sets with similarity 0.85 the chance of fewer than 16 collisions in 32 is below
2e-6, that of fewer than 91 in 128 (with chance collisions of four bits) about 1e-5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mix64, stored, tidy, whole_texts
from .linking import components, linked


class Words(dict):
    """word -> its place in `hashes`; asked for new words it hashes them."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.hashes, self.n, self.most = np.zeros(1 << 12, np.uint64), 0, most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if self.n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[self.n] = xxhash.xxh64_intdigest(word)
        self[word] = self.n
        self.n += 1
        return self.n - 1

    def of(self, words: list[bytes]) -> np.ndarray:
        if self.n > self.most:
            self.clear()
            self.n = 0
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.hashes[at]


def shingles(text: bytes | None, memo: Words, size: int = 5) -> np.ndarray:
    """64-bit hashes, ascending, of the distinct runs of `size` words; of fewer words, but
    not none, of the one run of all."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = memo.of(words)
    n = min(size, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return np.unique(out)


def signature(s: np.ndarray, coordinates: int) -> np.ndarray:
    """The least of the set's hashes under each of `coordinates` mixings, as int32."""
    factors = mix64(np.arange(1, coordinates + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 4096):
        part = s[lo : lo + 4096]
        x = part[None, :] * factors[:, None]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, x.min(1))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


COORDINATES, POSTED = 128, 32


def packed(sig: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, 16 coordinates in an int64."""
    nibbles = (sig.view(np.uint32) & np.uint32(15)).astype(np.uint64).reshape(-1, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64).view(np.int64)


def collisions(x: Column, y: Column) -> Column:
    """How many coordinates of two packed signatures (s0, s1, …) agree."""
    differ = F.lit(0)
    for k in range(COORDINATES // 16):
        d = x[f"s{k}"].bitwiseXOR(y[f"s{k}"])
        d = d.bitwiseOR(F.shiftright(d, 1))
        d = d.bitwiseOR(F.shiftright(d, 2))
        differ = differ + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return F.lit(COORDINATES) - differ


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("signature", pa.list_(pa.int32())), ("sketch", pa.list_(pa.int64()))])


def signed(docs: DataFrame, size: int = 5) -> DataFrame:
    """For each row: doc_id, n_shingles, two 64-bit sums that stand for the set, the
    posted coordinates, and the packed signature."""

    def sign(batches):
        memo = Words()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            n, s1, s2, sig, sketch = [], [], [], [], []
            for text in texts:
                s = shingles(text.as_py(), memo, size)
                n.append(len(s))
                s1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                s2.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)))
                full = signature(s, COORDINATES)
                sig.append(full[:POSTED])
                sketch.append(packed(full))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.list_(pa.int32())), pa.array(sketch, pa.list_(pa.int64()))], schema=_SIGNED)

    return whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(sign), "doc_id long, n_shingles long, s1 long, s2 long, signature array<int>, sketch array<long>")


def prefixes(classes: DataFrame, matches: int) -> DataFrame:
    """key, v: the postings to merge of classes (v, signature)."""
    posts = classes.select("v", F.posexplode("signature").alias("i", "value")).select("v", F.xxhash64("i", "value").alias("key"))
    counts = posts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = posts.join(counts, "key")
    lists = shared.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("l")).filter(F.size("l") >= matches)
    return lists.select("v", F.explode(F.slice("l", F.lit(1), F.size("l") - (matches - 1))).alias("x")).select(F.col("x.key").alias("key"), "v")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, size: int = 5, group_pairs: int = 500, broadcast_ids: int = 1_000_000) -> DataFrame:
    """The pairs (a, b) whose full sets fulfil 100 * intersection >= percent * union.

    texts: v, text. Pairs are dealt in groups of about group_pairs, a frequent b over
    several, so no task holds all partners of one text. The ids of the texts wanted are
    broadcast if they are at most broadcast_ids; else they are joined by a shuffle."""
    n = pairs.count()
    groups = max(1, -(-n // group_pairs))
    load = pairs.groupBy("b").agg(F.ceil(F.count("*") / group_pairs).alias("parts"))
    dealt = pairs.join(load, "b").withColumn("g", F.pmod(F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("parts"))), F.lit(groups)))
    dealt = stored(dealt.select("a", "b", "g"), "dealt")
    wanted = dealt.select(F.col("a").alias("v")).unionByName(dealt.select(F.col("b").alias("v"))).distinct()
    if 2 * n <= broadcast_ids or wanted.count() <= broadcast_ids:
        wanted = F.broadcast(wanted)
    held = stored(texts.join(wanted, "v", "left_semi"), "texts")
    left = dealt.join(held.withColumnRenamed("v", "a"), "a").select("g", "a", "b", "text").toDF("ga", "a", "b", "text")
    right = dealt.select("g", F.col("b").alias("v")).distinct().join(held, "v").select("g", "v", "text").toDF("gb", "v", "own")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(xs: pa.Table, ys: pa.Table) -> pa.Table:
        memo, good = Words(), ([], [])
        sets: dict[int, list] = {}  # a repeated id has several texts
        for v, text in zip(ys.column("v").to_pylist(), ys.column("own").cast(pa.binary()), strict=True):
            sets.setdefault(v, []).append(text)
        rows = sorted(zip(xs.column("b").to_pylist(), xs.column("a").to_pylist(), xs.column("text").cast(pa.binary()), strict=True), key=lambda r: r[:2])
        last, own = None, None
        for b, a, text in rows:
            if b != last:
                last, own = b, [shingles(t.as_py(), memo, size) for t in sets[b]]
            s = shingles(text.as_py(), memo, size)
            for o in own:
                both = len(np.intersect1d(s, o, assume_unique=True))
                if both and 100 * both >= percent * (len(s) + len(o) - both):
                    good[0].append(a)
                    good[1].append(b)
                    break
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in good], schema=out)

    return left.groupBy("ga").cogroup(right.groupBy("gb")).applyInArrow(verify, "a long, b long")


def _spanning(rows: list[tuple], sets: dict[int, list[np.ndarray]], percent: int, dense_from: int = 12) -> list[tuple[int, int]]:
    """Links among rows (v, comp, block) of one key and pair of blocks, enough to connect
    all that are linked: pairs in one component, or of the same block where two meet, are
    left out, and what a link has joined isn't compared again."""
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            parent[c] = parent.get(parent[c], parent[c])
            c = parent[c]
        return c

    blocks = {b for _, _, b in rows}
    flat = [(v, c, b, s) for v, c, b in rows for s in sets[v]]
    n = np.array([len(s) for *_, s in flat], np.int64)
    out = []

    def join(i: int, j: int) -> None:
        a, b = root(flat[i][1]), root(flat[j][1])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((flat[i][0], flat[j][0]))

    if len(flat) < dense_from:
        for i in range(len(flat)):
            for j in range(i + 1, len(flat)):
                if root(flat[i][1]) == root(flat[j][1]) or (len(blocks) > 1 and flat[i][2] == flat[j][2]) or 100 * min(n[i], n[j]) < percent * max(n[i], n[j]):
                    continue
                both = len(np.intersect1d(flat[i][3], flat[j][3], assume_unique=True))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    join(i, j)
        return out
    # all intersections at once: a product of 0/1 matrices over the shingles that several have
    every, inverse, counts = np.unique(np.concatenate([s for *_, s in flat]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(flat)), n)
    shared = counts[inverse] > 1
    column = np.cumsum(counts > 1) - 1
    code = column[inverse[shared]]
    width = int((counts > 1).sum())
    both = np.zeros((len(flat), len(flat)), np.float32)
    for lo in range(0, width, 2048):
        m = np.zeros((len(flat), min(2048, width - lo)), np.float32)
        pick = (code >= lo) & (code < lo + 2048)
        m[owner[shared][pick], code[pick] - lo] = 1
        both += m @ m.T
    near = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    for i, j in np.argwhere(np.triu(near, 1)).tolist():
        join(i, j)
    return out


def last_links(open_: DataFrame, texts: DataFrame, percent: int, size: int = 5, block_rows: int = 1024, group_rows: int = 2048, broadcast_ids: int = 1_000_000) -> DataFrame:
    """Links (a, b) between components among rows (key, v, comp, x) that share a key,
    enough to connect all that are linked.

    A key's rows are dealt in blocks; each pair of blocks is a unit of work, and units are
    packed in groups of about group_rows. A task holds the texts of its groups' rows and
    gives links only, never pairs."""
    sizes = open_.groupBy("key").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("nb"))
    own = open_.drop("x").join(sizes, "key").withColumn("b", F.pmod(F.xxhash64("v"), F.col("nb")).cast("int"))
    units = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("key", "v", "comp", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    units = stored(units, "units")
    groups = max(1, -(-units.count() // group_rows))
    wanted = units.select("v").distinct()
    if wanted.count() <= broadcast_ids:
        wanted = F.broadcast(wanted)
    held = stored(texts.join(wanted, "v", "left_semi"), "texts")
    dealt = units.withColumn("g", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups))).join(held, "v")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(table: pa.Table) -> pa.Table:
        memo, sets, own = Words(), {}, {}
        cols = [table.column(c).to_pylist() for c in ("key", "i", "j", "v", "comp", "b")]
        for key, i, j, v, comp, b, text in zip(*cols, table.column("text").cast(pa.binary()), strict=True):
            unit = own.setdefault((key, i, j), {})
            if v not in unit or v not in sets:
                sets.setdefault(v, [shingles(text.as_py(), memo, size)])
            else:  # a repeated doc_id with another text
                s = shingles(text.as_py(), memo, size)
                if not any(np.array_equal(s, t) for t in sets[v]):
                    sets[v].append(s)
            unit[v] = (v, comp, b)
        links = {tuple(sorted(x)) for unit in own.values() for x in _spanning(list(unit.values()), sets, percent)}
        a, b = zip(*sorted(links), strict=True) if links else ((), ())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    return dealt.groupBy("g").applyInArrow(verify, "a long, b long").distinct()


def grouped(docs: DataFrame, percent: int = 85, posted_matches: int = 16, matches: int = 91, size: int = 5) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Null texts and texts without words have no shingles and no links. Repeated doc_ids
    are one vertex, linked by any of their texts. A null doc_id has the component of its
    class, or null, and is never kept unless it is alone of its text. The two counts of
    matches are for percent = 85; a lower one needs lower counts."""
    rows = stored(signed(docs, size), "signed")
    firsts = [F.first(c).alias(c) for c in ("signature", "sketch")]
    classes = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("v"), *firsts)
    classes = stored(classes, "classes")
    own = rows.join(classes.select("n_shingles", "s1", "s2", "v"), ["n_shingles", "s1", "s2"], "left").withColumn("v", F.coalesce("v", "doc_id"))
    own = stored(own.select("doc_id", "n_shingles", "v"), "own")
    about = F.struct(F.col("n_shingles").alias("n"), *[F.col("sketch")[k].alias(f"s{k}") for k in range(COORDINATES // 16)])
    postings = stored(prefixes(classes, posted_matches).join(classes.select("v", about.alias("x")), "v"), "postings")

    def near(x: Column, y: Column) -> Column:
        return (F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent) & (collisions(x, y) >= matches)

    texts = docs.select(F.col("doc_id").cast("long").alias("v"), "text")
    labels = linked(postings, lambda pairs: confirmed(pairs, texts, percent, size).distinct(), lambda rows: last_links(rows, texts, percent, size), near)
    # repeated doc_ids with different texts join their classes
    several = own.groupBy("doc_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo <> hi")
    if not several.isEmpty():
        split = own.join(several.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("v").alias("b"))
        more = labels.select(F.col("v").alias("a"), F.col("comp").alias("b")).unionByName(split)
        labels = components(more)
        own = own.withColumn("v", F.coalesce("doc_id", "v"))
    found = own.join(labels, "v", "left").withColumn("component_id", F.coalesce("comp", "v"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

