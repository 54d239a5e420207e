"""Operators 1, 3 and 5 against brute force, on the smallest tables and on odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("sparkloom.llm")
import public_tokenizers
from sparkloom.llm import decontaminate, packing, registry, repair, tokens
from sparkloom.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "A b\tc\n\nd  e ", "x" * 5000, "<|endoftext|> z", "\x1c\x00 é ñ 日本  語", "word " * 3000, "I'm 12,5 don't.", "nb sp", "-" * 200]


def odd_docs(spark):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(ODD)] + [(3, "a", "en", "s", 1), (None, "null id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, start long")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_encodes_as_the_library(name):
    e = Encoder(public_tokenizers.path(name), pieces=50)
    texts = [t or "" for t in ODD] * 2
    for _ in range(2):
        want = [np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert e.encode(texts) == want


def test_table_cuts_and_encodes_as_the_library(monkeypatch):
    """Texts of all kinds of characters side by side, with a table that begins anew and one that doesn't."""
    rng = np.random.default_rng(6)
    kinds = ["a", "s", "t", "re", "ve", "m", "ll", "d", "'", "'s", "'re", " ", "  ", "\n", "\t", "\r", "é", "×", "÷", "ª", "²", "1", "9", ".", "--", "—", "€", "x" * 30, "Zebra", "\xad"]
    texts = ["".join(rng.choice(kinds, n)) for n in rng.integers(0, 30, 3000)] + [t or "" for t in ODD]
    whole = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = whole.direct(texts)
    monkeypatch.setattr(Encoder, "MANY", 5000)
    for e in (whole, Encoder(public_tokenizers.path("byte_bpe_50k.json"), pieces=20)):
        assert e.encode(texts) == want and e.encode(texts[::-1]) == want[::-1]
    monkeypatch.setattr(Encoder, "LONG", 10)
    assert whole.encode(texts) == want


def test_new_words_go_to_the_library_together():
    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    asked, learn = [], e.table.learn
    e.table.learn = lambda pieces: asked.append(len(pieces)) or learn(pieces)
    texts = [" ".join(f"w{k:x}q" for k in range(i, i + 500)) for i in range(10)]
    assert e.encode(texts) == e.direct(texts) and e.encode(texts) == e.direct(texts) and len(asked) == 1
    assert _fits(merges=[["Ā", "a"]]) is False and _fits(ignore_merges=True) is False and _fits() is True


def _fits(**model):
    return tokens._Table.fits({"model": {"vocab": dict.fromkeys(tokens._BYTES.values()), "merges": [["a", "b"]], **model}})


def ids_of(text, name):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_repair_round_trip(spark):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, int), np.array([7]), np.full(1001, 3), rng.integers(0, 5, 5000), np.tile([1, 2, 3, 2], 700)):
        base, rules, expansions, seq = repair.compress(ids, least=2)
        row = {"base": base, "rules": rules.tobytes(), "expansions": expansions.tobytes(), "sequence": seq.astype("<u4").tobytes(), "wide": True, "doc_ids": b"", "doc_lengths": b""}
        block = repair.Block(row)
        assert block.ids().tolist() == ids.tolist()
        for a, b in rng.integers(0, len(ids) + 1, (20, 2)).tolist():
            assert block.ids(a, b).tolist() == ids[a:b].tolist()
    assert len(repair.compress(np.tile([1, 2, 3, 2], 700), least=2)[3]) < 60


def test_grammars_go_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(4)
    cases = [rng.integers(0, k, n).astype("<u4") for k in (1, 2, 5, 40) for n in (0, 1, 2, 3, 700, 5000)] + [np.tile(rng.integers(0, 9, 50), 40).astype("<u4")]
    for ids in cases:
        for least in (2, 16):
            base, rules, expansions, seq = repair.compress(ids, least=least)
            expanded = [[x] for x in range(base)]
            for a, b in rules.tolist():
                expanded.append(expanded[a] + expanded[b])
            assert [y for x in seq.tolist() for y in expanded[x]] == ids.tolist()
            assert [len(x) for x in expanded[base:]] == expansions.tolist()
            counts, last = {}, {}
            for i, pair in enumerate(zip(seq[:-1].tolist(), seq[1:].tolist())):
                if last.get(pair) != i - 1:  # doesn't overlap the one counted before
                    counts[pair], last[pair] = counts.get(pair, 0) + 1, i
            assert max(counts.values(), default=0) < least


def test_repair_files(spark):
    docs = odd_docs(spark)
    got = repair.written(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = sorted(((d if d is not None else -(1 << 63)), t or "") for d, t, *_ in docs.collect())
    assert len(got) == len(want)
    start = 0
    for row in sorted(got, key=lambda r: r["start"]):
        ids = [ids_of(t, "byte_bpe_50k.json") for d, t in want if d == (row["doc_id"] if row["doc_id"] is not None else -(1 << 63))]
        assert row["start"] == start and (row["n_tokens"], row["ids_crc32"]) in [(len(x), zlib.crc32(x.tobytes())) for x in ids]
        start += row["n_tokens"]
    assert repair.written(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def check_packing(got, capacity):
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for its in bins.values():
        at = 0
        for offset, n in sorted(its):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    docs = odd_docs(spark)
    got = packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=64).collect()
    n = check_packing(got, 64)
    lengths = sorted(len(ids_of(t, "word_bpe_49k.json")) for _, t, *_ in docs.collect())
    total = sum(lengths)
    assert sum(r["length"] for r in got) == total and n <= -(-total // 64) + 1
    for r in got:
        assert r["start"] == 64 * r["piece"]
    assert packing.packed_documents(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing_rounds(spark):
    rng = np.random.default_rng(3)
    sizes = np.concatenate([rng.integers(1, 2049, 3000), np.full(500, 1100), np.full(500, 900)]).tolist()
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "id long, length long")
    got = packing.pack(items, group_items=200, fan_in=4).collect()
    assert sorted(r["id"] for r in got) == list(range(len(sizes)))
    n = check_packing(got, 2048)
    _, _, alone = packing.best_fit(sizes, 2048)
    assert n <= 1.04 * len(alone) + 2  # small groups cost some; one group of them all would not


def brute_contamination(docs, items, window=13):
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    phrases = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = {len(p) for p in phrases}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if who := phrases.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= who
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination_query(spark):
    got = registry.op1_decontaminate(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    want = brute_contamination(docs, items)
    assert sorted(map(tuple, got), key=str) == want and any(w[5] for w in want)


def test_contamination_odd_rows_and_blocks(spark):
    docs = odd_docs(spark).union(spark.createDataFrame([(90, "b c d e b c d e. B, c", "", "", 0), (91, "c d", "", "", 0), (92, "d", "", "", 0)], "doc_id long, text string, lang string, source string, start long"))
    bench = spark.createDataFrame([(1, "c D e b"), (1, "b c"), (2, ""), (3, None), (10, "d"), (None, "c d")], "item_id long, text string")
    want = brute_contamination([(r[0], r[1]) for r in docs.collect()], [tuple(r) for r in bench.collect() if r[0] is not None], 3)
    for block_phrases in (1 << 20, 2):
        got = decontaminate.contamination(docs, bench, window=3, block_phrases=block_phrases)
        rows = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest(), r["contaminated"]) for r in got.collect()]
        assert sorted(rows, key=str) == want
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x a y b"), (2, "b a"), (3, "a x x x b"), (4, None), (5, "a")], "doc_id long, text string")
    index = decontaminate.build(docs, segment_words=3)
    assert {tuple(r) for r in decontaminate.near(index, [b"a", b"b"], 3).collect()} == {(1, 1), (2, 0)}


def test_all_underfull_bins_go_up(spark):
    """Halves that a group has no partners for meet others in the next rounds."""
    lengths = [1300] * 300 + [748] * 300
    items = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length long")
    got = packing.pack(items, group_items=60, fan_in=2).collect()
    fills = {}
    for r in got:
        fills.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(got) == 600 and len(fills) <= 315  # 300 is best
    same = packing.pack(items.filter("length = 1300"), group_items=60, fan_in=2)  # nothing fits: rounds end
    assert same.select("sequence_id").distinct().count() == 300


def test_windows_are_the_phrases_of_each_text(spark):
    texts = [None, "", "..", "One two", "A-b c1 É日 x" * 9, "\x7fa\x80b " * 20, "same words here " * 30, "İstanbul STRASSE ſ K"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, item_text string")
    want = {}
    for i, t in enumerate(texts):
        for p in decontaminate.phrases_of(t, 13):
            want.setdefault(p, set()).add(i)
    got = {tuple(w.encode() for w in r["phrase"]): set(r["who"]) for r in decontaminate.windows(items.filter("item_text IS NOT NULL"), 13).collect()}
    assert got == want


def test_one_block_of_phrases_takes_one_python_worker_a_task(spark):
    """Nothing is united then: the search gives n_hit, and no second function runs in its tasks."""
    docs = spark.createDataFrame([(1, "a b c x a b c b c"), (2, "x"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c"), (2, "b c x")], "item_id long, text string")
    one, many = (decontaminate.contamination(docs, bench, window=2, block_phrases=n) for n in (1 << 20, 1))
    assert "EvalPython" not in one._jdf.queryExecution().toString()
    assert sorted(one.select("doc_id", "n_hit", "hits").collect()) == sorted(many.select("doc_id", "n_hit", "hits").collect())
    assert {r["doc_id"]: r["n_hit"] for r in one.collect()} == {1: 9, 2: 0, 3: 0}


def test_gaps_of_all_words_are_packed_at_once():
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 1 << bits, rng.integers(1, 40)) for bits in (3, 8, 9, 16, 17, 31) for _ in range(20)]
    words += [np.array([x]) for x in (0, 255, 256, 65_535, 65_536, (1 << 32) - 1)]
    data, begin = decontaminate._narrow(np.concatenate(words), np.array([len(w) for w in words]))
    for w, packed in zip(words, decontaminate._binaries(data, begin[:]).to_pylist(), strict=True):
        width = 1 if w.max() < 1 << 8 else 2 if w.max() < 1 << 16 else 4
        assert packed == bytes([width]) + w.astype(f"<u{width}").tobytes()
        assert (decontaminate._places(packed) == np.cumsum(w)).all()
    none, begin = decontaminate._narrow(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(none) == 0 and begin.tolist() == [0]


def test_codes_are_ordered_by_their_halves():
    rng = np.random.default_rng(6)
    for most in (1, 300, 1 << 16, 1 << 20):
        flat = rng.integers(0, most, 5000).astype(np.int32)
        assert (decontaminate._by_code(flat) == np.argsort(flat, kind="stable")).all()


def test_op5_keeps_more_words_than_packing():
    path = public_tokenizers.path("byte_bpe_50k.json")
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b"]})
    asked = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tokens, "encoder", lambda path, pieces=90_000: asked.append(pieces) or Encoder(path, pieces))
        list(tokens.encoded([batch], path))
        list(tokens.encoded([batch], path, pieces=repair.PIECES))
    assert asked == [90_000, 300_000]
    assert tokens.encoder(path, 123).memo.most == 123 and tokens.encoder(path).memo.most == 90_000
