"""Operators 4 and 7 against brute force, and on odd rows."""

import hashlib
import random
import re

import pytest

pytest.importorskip("sparkloom.llm")
from pyspark.sql import functions as F

from sparkloom.llm import common, lines, linking, near_duplicates, registry

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, comp long"


def brute_sets(docs):
    out = {}
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(docs, percent=85):
    sets = brute_sets(docs)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def copies(n_base=40):
    base = [f"w{k}" for k in range(n_base)]
    near = [*base[:-1], "other"]
    far = [*base[: n_base // 2], *[f"v{k}" for k in range(n_base // 2)]]
    rows = [(10, " ".join(base)), (11, " ".join(base).upper()), (12, " ".join(near)), (13, " ".join(far)), (5, " ".join([*near[:-2], "x", "other"]))]
    rows += [(20, None), (21, ""), (22, "  \n"), (23, "one two"), (24, "one  two"), (25, "one"), (26, "long " * 20_000)]
    rows += [(100 + k, " ".join([*base, *[f"z{j}" for j in range(k)]])) for k in range(12)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


def test_components_contract(spark):
    rows = copies()
    got = near_duplicates.grouped(frame(spark, rows)).collect()
    want, sets = brute_components(rows), brute_sets(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s[0]) for i, s in sets.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_components([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {r["doc_id"]: r["component_id"] for r in registry.op4_near_duplicates(spark, SF).collect()} == want
    assert len(set(want.values())) < len(want)


def test_repeated_and_null_ids(spark):
    rows = [*copies(), (10, "quite another text of seven words here"), (30, "quite another text of seven words here"), (10, " ".join(f"w{k}" for k in range(40)))]
    got = near_duplicates.grouped(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows)
    null = near_duplicates.grouped(frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (None, "alone it is here now yes")])).collect()
    assert sorted(map(str, null)) == sorted(map(str, null)) and len(null) == 3
    assert near_duplicates.grouped(frame(spark, rows).limit(0)).count() == 0


def test_blocks_of_a_hot_key(spark):
    rows = copies()
    texts = frame(spark, rows).selectExpr("doc_id AS v", "text")
    open_ = texts.selectExpr("1L AS key", "v", "v AS comp", "struct(1 AS none) AS x").filter("v NOT IN (20, 21, 22)")
    want = brute_components([r for r in rows if r[0] not in (20, 21, 22)])
    for block_rows in (2, 5, 1000):
        links = near_duplicates.last_links(open_, texts, 85, block_rows=block_rows, group_rows=7)
        found = {r["v"]: r["comp"] for r in linking.components(links).collect()}
        assert {i: found.get(i, i) for i in want} == want


def test_union_find(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 50), (50, 70), (70, 100), (5, 5)]
    got = {r["v"]: r["comp"] for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 50: 50, 70: 50, 100: 50}
    assert linking.components(spark.createDataFrame([], "a long, b long")).count() == 0


LINE = "the quick brown fox jumps over the lazy dog near the river bank while twenty birds sing loudly today"


def test_lines(spark):
    docs = [
        (1, f"first line of the document here\n{LINE}\nshort\n"),
        (2, f"short\n  {LINE.upper()} \nsomething else altogether, quite new"),
        (3, f"{LINE.replace('twenty', 'thirty')}\nshort\nlast words of the third document"),
        (4, None), (5, ""), (6, "\n\n"), (7, f"{LINE}\n{LINE}"),
        (8, "word " * 5000), (8, "word " * 5000),
    ]
    got = lines.deduplicated(frame(spark, docs)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(docs) and set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "comp", "n_lines", "n_dropped"}
    assert by[1]["text"] == docs[0][1] and by[1]["n_dropped"] == 0
    assert by[2]["text"] == "short\nsomething else altogether, quite new" and by[2]["n_dropped"] == 1
    assert by[3]["text"] == "short\nlast words of the third document"
    assert by[4]["text"] is None and by[4]["n_lines"] == 0 and by[5]["text"] == "" and by[6]["text"] == "\n\n"
    assert by[7]["text"] == "" and by[7]["n_dropped"] == 2
    assert [r["text"] for r in got if r["doc_id"] == 8] == ["word " * 5000] * 2
    assert lines.deduplicated(frame(spark, docs).limit(0)).count() == 0


def shingled(line, gram=12):
    """The shingles that begin at a word or lie inside one, found character by character."""
    out = set()
    for i, c in enumerate(line):
        if not c.isspace() and (i == 0 or line[i - 1].isspace() or len(line[i : i + gram].split()) == 1 == len(line[i : i + gram]) // gram and not any(map(str.isspace, line[i : i + gram]))):
            out.add(line[i : i + gram])
    return out


def brute_lines(docs, similarity=0.7, min_chars=20):
    """(doc_id, place) of the lines that go, by the exact similarity of all pairs; docs in
    ascending order of doc_id, none twice."""
    places, sets = [], []
    for i, t in docs:
        for pos, line in enumerate((t or "").split("\n")):
            s = line.lower().strip(" \t\r")
            if len(s) >= min_chars:
                places.append((i, pos))
                sets.append(shingled(s))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}  # lines of similarity 0.7 share a shingle: only such are compared
    for k, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    for a, b in {(a, b) for h in holders.values() for n, b in enumerate(h) for a in h[:n]}:
        both = len(sets[a] & sets[b])
        if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {places[k] for k in range(len(sets)) if root(k) != k}


def test_shingles_step_over_what_has_none():
    """The pattern finds what each place tried alone finds, characters beyond 16 bits
    included, and takes each word without shingles inside it in one step."""
    rng = random.Random(4)
    lines_ = ["".join(rng.choices(["a", "b", "-", " ", "  ", "\t", "é", "\U0001f600", "x" * 11, "y" * 12, "z" * 13, "q" * 40], k=rng.randrange(1, 30))).strip() for _ in range(500)]
    for gram, least in ((12, 1), (24, 24)):
        pattern = re.compile(lines.shingle_pattern(gram, least))
        for line in lines_:
            want = {line[i : i + gram] for i in range(len(line)) if not line[i].isspace() and (i == 0 or line[i - 1].isspace()) and len(line) - i >= least}
            want |= {w[i : i + gram] for w in line.split() for i in range(len(w) - gram + 1)}
            assert {m[1] for m in pattern.finditer(line)} == want
    assert [m.span() for m in re.finditer(lines.shingle_pattern(12, 1), "one two  three")] == [(0, 4), (4, 9), (9, 14)]


def test_shingles_of_characters_beyond_16_bits(spark):
    line = "\U0001f600" * 20
    assert spark.createDataFrame([(line,)], "norm string").select(F.size(lines.shingles(F.col("norm"), 12))).first()[0] == len(shingled(line)) == 1


def gone(docs):
    return {(r["doc_id"], p) for r in lines.dropped(docs).collect() for p in r["drop"]}


def test_lines_find_what_brute_force_finds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = brute_lines(sorted(tuple(r) for r in docs.collect()))
    got = gone(docs)
    assert len(want) > 50 and len(got & want) >= 0.99 * len(want) and not got - want


def test_what_stays_open_is_compared_in_blocks(spark):
    """One key for all lines, no links yet: all components must come from the last step."""
    rng = random.Random(5)
    base = [rng.randbytes(60).hex() for _ in range(4)]
    texts = [b[: rng.randrange(90, 120)] + rng.randbytes(rng.choice([2, 8, 40])).hex() for b in base for _ in range(12)]
    frame_ = spark.createDataFrame(list(enumerate(texts)), "v long, norm string")
    sets = frame_.select("v", lines.shingles(F.col("norm"), 12).alias("s"))
    open_ = frame_.selectExpr("7L AS key", "v", "v AS comp").union(frame_.selectExpr("v % 2 + 8", "v", "v"))
    want = {p for p in brute_lines([(k, t) for k, t in enumerate(texts)])}
    for block in (300, 1500, 10**6):
        links = lines.open_links(open_, sets, 0.7, block)
        comp = {r["v"]: r["comp"] for r in linking.components(links).collect()}
        assert {(v, 0) for v, c in comp.items() if v != c} == want and links.count() < len(texts) ** 2 / 4


def test_lines_without_blanks(spark):
    site = "https://www.example.com/"
    urls = [f"{site}{hashlib.sha256(bytes([k])).hexdigest()}" for k in range(4)]
    han = "".join(chr(0x4E00 + 37 * k) for k in range(80))
    other = "".join(chr(0x4E00 + 41 * k + 7) for k in range(60))
    docs = [
        (1, "\n".join(urls)), (2, han), (3, f"{han[:2]}\u3042{han[3:]}"), (4, han[:24] + other),
        (5, f"see {site}{'a1b2c3' * 3}x{'q' * 30}"), (6, f"see {site}{''.join(map(chr, range(97, 123)))}"),
    ]
    by = {r["doc_id"]: r for r in lines.deduplicated(frame(spark, docs)).collect()}
    assert {i: by[i]["n_dropped"] for i in by} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0}
    assert by[1]["text"] == docs[0][1] and by[4]["text"] == docs[3][1]


def test_lines_of_each_length(spark):
    """Lines with a word replaced, inserted or deleted, against the exact similarity of their sets."""
    rng, texts, pairs = random.Random(3), [], {}
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    for top in [24, 24, 24, 24, 32, 48, 80, 120] * 300:
        line = []
        while len(" ".join(line)) < top - 4:
            line.append(rng.choice(words))
        at, how = rng.randrange(len(line)), rng.randrange(3)
        other = line[:at] + ([rng.choice(words)] if how == 0 else [rng.choice(words), line[at]] if how == 1 else []) + line[at + 1 :]
        a, b = " ".join(line), " ".join(other)
        sets = [shingled(s) for s in (a, b)]
        if min(len(a), len(b)) >= 20 and len(sets[0] & sets[1]) >= 0.7 * len(sets[0] | sets[1]):
            pairs.setdefault(top, []).append((len(texts), len(texts) + 1))
            texts += [a, b]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.deduplicated(frame(spark, list(enumerate(texts)))).collect()}
    recall = {top: sum(got[a] + got[b] for a, b in p) / len(p) for top, p in pairs.items()}
    assert set(recall) == {24, 32, 48, 80, 120} and min(map(len, pairs.values())) >= 20
    assert min(recall.values()) >= 0.98, recall


def test_columns_of_any_name(spark):
    names = ["_id", "_d", "_h", "_th", "_drop", "id", "th", "drop", "row", "h", "d", "v", "comp", "n_lines", "n_dropped", "key"]
    docs = frame(spark, [(1, f"{LINE}\nx"), (2, f"{LINE}\ny"), (2, f"{LINE}\ny"), (None, None)]).select("doc_id", "text", *[F.lit(f"own {c}").alias(c) for c in names])
    rows = lines.deduplicated(docs).collect()
    assert len(rows) == 4 and all(r[c] == f"own {c}" for r in rows for c in names)
    assert sorted((str(r["doc_id"]), str(r["text"]), r["n_lines_"], r["n_dropped_"]) for r in rows) == [("1", f"{LINE}\nx", 2, 0), ("2", "y", 2, 1), ("2", "y", 2, 1), ("None", "None", 0, 0)]
    kept = common.joined_ids(docs, docs.filter("doc_id = 2").select("doc_id").distinct(), "left_anti").collect()
    assert len(kept) == 2 and near_duplicates.grouped(docs).count() == 4  # a null doc_id joins nothing


def test_lines_around_the_bands_kinds(spark):
    """Near copies whose lengths lie about LONG and LONG over the similarity, of words with
    and without a sampled first letter, and with words longer than a shingle."""
    rng, texts, pairs = random.Random(8), [], 0
    for letters in ("abcdefghijklmnopqrstuvwxyz", "bcdfg"):
        for top in [150, 160, 170, 220, 230, 300] * 20:
            line = []
            while len(" ".join(line)) < top:
                line.append("".join(rng.choices(letters, k=rng.choice([3, 5, 7, 30]))))
            at = rng.randrange(len(line) // 2)
            other = [*line[:at], *line[at + 1 :], *["abc xyz"] * rng.randrange(2)]
            sets = [shingled(" ".join(s)) for s in (line, other)]
            if len(sets[0] & sets[1]) >= 0.7 * len(sets[0] | sets[1]):
                pairs += 1
                texts += [" ".join(line), " ".join(other)]
    got = sum(r["n_dropped"] for r in lines.deduplicated(frame(spark, list(enumerate(texts)))).collect())
    assert pairs > 100 and got >= 0.98 * pairs


def test_lines_with_a_passage_in_common_are_not_compared_in_pairs(spark):
    """Lines that share one shingle with many, and little else, leave before any pair is made."""
    shared = spark.createDataFrame([(1, v) for v in range(200)] + [(2, 300), (2, 301)], "key long, v long")
    rng = random.Random(1)
    own = {v: sorted({7, *(rng.getrandbits(60) for _ in range(15))}) for v in range(200)}
    own |= {300: list(range(10, 26)), 301: list(range(14, 30))}
    sketches = spark.createDataFrame([(v, (s, 40)) for v, s in own.items()], "v long, x struct<s: array<long>, n: int>")
    assert {r["v"] for r in lines.likely(shared, sketches, 0.7).collect()} == {300, 301}


def test_shared_bands_are_found_without_sorting_all(spark, monkeypatch):
    signed = spark.createDataFrame([(1, [5, 6]), (1, [5, 6]), (2, [6, 7]), (3, [8]), (3, [8]), (4, [6, 9]), (5, None)], "v long, bands array<long>")
    assert sorted(map(tuple, lines.shared_bands(signed).collect())) == [(6, 1), (6, 2), (6, 4)]
    monkeypatch.setattr(lines, "stored", lambda df, name: df)
    assert "Window" not in lines.shared_bands(signed)._jdf.queryExecution().optimizedPlan().toString()


def test_lines_alone_in_a_band_are_compared_in_all_pairs(spark):
    """Bands of two and three lines give their pairs, those of more stay rows; extreme hashes."""
    lo, hi = -(1 << 63), (1 << 63) - 1
    keys = {1: [5, lo], 2: [lo, 7, hi], 3: [7, hi], 4: [1, 2, 3, 4]}
    shared = spark.createDataFrame([(k, v) for k, vs in keys.items() for v in vs], "key long, v long")
    pairs, many = lines.few_and_many(shared)
    assert sorted(map(tuple, pairs.collect())) == [(lo, 5), (lo, 7), (lo, hi), (7, hi)]
    assert sorted(map(tuple, many.select("key", "v").collect())) == [(4, v) for v in keys[4]]


def test_known_links_hold_where_no_key_is_shared(spark):
    postings = spark.createDataFrame([], "key long, v long")
    known = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    found = linking.linked(postings, lambda pairs: pairs, lambda rows: rows.select("v", "v").toDF("a", "b"), known=known)
    assert {r["v"]: r["comp"] for r in found.collect()} == {1: 1, 2: 1, 3: 1}


def test_sampled_starts_are_a_table_and_not_ranges():
    """The class has each character by itself, and is the one of the ranges before."""
    assert "-" not in lines._START
    now, before = re.compile(lines._START), re.compile("[^b-df-hj-np-tv-z ]")
    assert all(bool(now.match(chr(c))) == bool(before.match(chr(c))) for c in range(0x20000))
