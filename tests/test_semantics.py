"""Small cases of each operator's rules, and comparisons with plain sequential models."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import vectors as V
from sparkloom.operators import admission, capacity, frames, metrics, prompts, repetition, runs, selection, shards
from sparkloom.sources import tables
from sparkloom.streaming.feeds import Feed

few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
SENTENCE = "Let me check the configuration file before we restart server"


def verdicts(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in repetition.verdicts(df, **options).collect()}


def test_repetition_cases(spark):
    plain = "\n".join(f"completely {a} {b} {c} statement number" for a, b, c in zip("alpha beta gamma delta omega".split(), "red blue green black white".split(), "one two three four five".split(), strict=True))
    v = verdicts(spark, [plain, "\n".join([SENTENCE] * 4), "short line\n" * 20, SENTENCE + "\n" + "the and of is are was were be\n" * 9, "\n".join([SENTENCE] * 3), None, "", f"\t{SENTENCE}\r\n" * 4])
    assert [v[k]["loop"] for k in range(8)] == [False, True, False, False, False, False, False, True]
    assert v[1]["first_pos"] == 3 and v[1]["n_hits"] == 1  # the last line has no end and counts


def test_repetition_window_and_actions(spark):
    filler = [f"{a} unrelated words fill this place" for a in ("apple", "berry", "cherry", "damson", "elder", "fig")]
    unique = [" ".join(f"{w}{k}" for w in f.split()) for k, f in enumerate(filler)]
    text = "\n".join([SENTENCE, *unique[:2], SENTENCE, *unique[2:4], SENTENCE, *unique[4:], SENTENCE])
    assert not verdicts(spark, [text], window=3)[0]["loop"] and verdicts(spark, [text], window=0)[0]["loop"]
    lines = repetition.eligible_lines(spark.createDataFrame([(1, "\n".join([SENTENCE] * 6))], "doc_id long, text string"))
    assert repetition.detections(lines, action="stop").count() == 1 and repetition.detections(lines, action="warn").count() == 3


@few
@given(st.lists(st.sampled_from([SENTENCE, SENTENCE.replace("server", "client"), "another quite different line of words", "tiny", "the of and to is are was were"]), max_size=25), st.sampled_from([0, 2, 20]))
def test_repetition_equals_the_feed(spark, lines, window):
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    got = {r["pos"] for r in repetition.detections(repetition.eligible_lines(df), window=window).collect()}
    feed = Feed(window=window)
    assert got == {k for k, line in enumerate(lines) if feed.push(line + "\n")}


def test_feed_rules():
    feed = Feed()
    assert [bool(feed.push(f"{SENTENCE}\n")) for _ in range(4)] == [False, False, False, True]
    chunked = Feed()
    assert any([chunked.push(part) for part in (f"{SENTENCE}\n" * 4).replace(" ", " |").split("|")])
    assert not any(Feed().push(SENTENCE) for _ in range(9))  # no line ends, nothing to check
    both = Feed()
    first = both.push(f"{SENTENCE}\n" * 5)
    assert first and both.push("") and not both.push("")  # one detection a fragment, the rest waits
    stop = Feed(action="stop")
    stop.push(f"{SENTENCE}\n" * 4)
    assert stop.stopped and stop.push(f"{SENTENCE}\n") is None


@few
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40)), max_size=30), st.integers(0, 12), st.integers(1, 4))
def test_rate_limit_equals_a_loop(spark, hits, window, most):
    rows = [(c, t, k) for k, (c, t) in enumerate(hits)]
    want, kept = {}, {}
    for c, t, k in sorted(rows, key=lambda r: (r[1], r[2])):
        kept[c] = [x for x in kept.get(c, []) if t - x < window] + [t]
        want[k] = len(kept[c]) <= most
    df = spark.createDataFrame(rows, "client long, t long, k long")
    assert {r["k"]: r["allowed"] for r in admission.limited(df, "client", F.col("t"), "k", window, most).collect()} == want


def test_selection(spark):
    logits = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0), (1, 2, -1.0), (1, 3, 5.0), (2, 0, 0.0)], "vec_id long, tok int, logit double")
    assert {(r["vec_id"], r["tok"]) for r in selection.top_k(logits, 2).collect()} == {(1, 3), (1, 0), (2, 0)}
    assert {(r["vec_id"], r["tok"]) for r in selection.greedy(logits.filter("tok < 3")).collect()} == {(1, 0), (2, 0)}
    kept = selection.nucleus(selection.softmax(logits), 0.5).filter("vec_id = 1").collect()
    assert [(r["tok"], r["p"]) for r in kept] == [(3, 1.0)]  # the first alone exceeds top_p
    seen = spark.createDataFrame([(1, 2), (1, 2)], "vec_id long, tok int")
    assert selection.penalised(logits, seen, 2.0).filter("tok = 2").first()["logit"] == -0.5
    assert selection.penalised(logits, seen, 1.0).filter("tok = 2").first()["logit"] == -1.0
    draws = [selection.draw(logits, s, 0.7, 0.9).filter("vec_id = 1").first()["tok"] for s in range(8)]
    assert set(draws) <= {0, 1, 3} and draws == [selection.draw(logits, s, 0.7, 0.9).filter("vec_id = 1").first()["tok"] for s in range(8)]
    assert selection.dense(selection.top_k(logits, 1), spark.createDataFrame([(1,), (2,)], "vec_id long"), 6).count() == 12


def test_vectors(spark):
    df = spark.createDataFrame([([2.0] * 8, [0.0] * 8, [65000.0, -65000.0, 1.0], [1000.0, -1000.0, 1.0], 0xFEDCBA98)], "x array<double>, w array<double>, a array<double>, b array<double>, q long")
    r = df.select(V.rms_norm(F.col("x"), F.col("w")).alias("n"), V.clipped_sum(F.col("a"), F.col("b")).alias("c"), V.plain_sum(F.col("a"), F.col("b")).alias("p"), V.nibbles(F.col("q")).alias("q"), V.cosine(F.col("x"), F.col("x")).alias("s"), V.rope(F.col("x"), F.lit(0.0), F.lit(1e4), 8).alias("r")).first()
    assert r["n"] == pytest.approx([1.0] * 8, abs=1e-6) and r["c"] == [65504.0, -65504.0, 2.0] and r["p"] == [66000.0, -66000.0, 2.0]
    assert r["q"] == [8, 9, 10, 11, 12, 13, 14, 15] and r["s"] == pytest.approx(1) and r["r"] == [2.0] * 8


def test_frames():
    rng = np.random.default_rng(0)
    x = rng.normal(size=24).astype("float32")
    f = frames.encode_frame(0, [2, 3, 4], 1, x)
    assert len(f) == 124 and frames.decode_frame(f)[1] == [2, 3, 4] and np.array_equal(frames.decode_frame(f)[3], x)
    h = frames.encode_frame(1, [1, 5], 2, x[:5])
    assert len(h) == 34 and np.abs(frames.decode_frame(h)[3] - x[:5]).max() < 0.01
    with pytest.raises(ValueError):
        frames.encode_frame(0, [1], 99, [1])
    with pytest.raises(ValueError):
        frames.decode_frame(f[:-1])
    with pytest.raises(ValueError):
        frames.decode_frame(b"\0" * 40)
    unknown = f[:12] + (99).to_bytes(4, "big") + f[16:]
    assert frames.decode_frame(unknown, strict=False)[2] == 99
    with pytest.raises(ValueError):
        frames.decode_frame(unknown)


@few
@given(st.integers(1, 60), st.lists(st.sampled_from([0.0, 1.0, 2.0, 8.0, 16.0]), min_size=1, max_size=5).filter(lambda m: sum(m) > 0))
def test_weighted_split_equals_a_loop(spark, n, memory):
    start, want = 0, []
    for k, m in enumerate(memory):
        size = n - start if k == len(memory) - 1 else max(1, round(n * m / sum(memory)))
        want.append((k, start, start + size))
        start += size
    df = spark.createDataFrame([(1, n, k, m) for k, m in enumerate(memory)], "plan int, n_layers int, rank int, mem double")
    assert sorted((r["rank"], r["start_layer"], r["end_layer"]) for r in shards.weighted_split(df).collect()) == want


def test_even_split(spark):
    df = spark.createDataFrame([(1, 48, 5)], "plan int, n_layers int, world int")
    assert sorted((r["start_layer"], r["end_layer"]) for r in shards.even_split(df).collect()) == [(0, 10), (10, 20), (20, 30), (30, 39), (39, 48)]


def test_runs(spark):
    lines = ["   Step 1: ' a' | r0=0.1s step=0.125s | 8.00 tok/s", "Prefill 完成 (1.5s)", "noise", "Step 2: 'b|c", "Step 3: 'd' | r0=0.0s step=0.2s | 6.00 tok/s", "生成完成", "Step 4: 'e' | r0=0.0s step=0.2s | 1.00 tok/s"]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "run_id int, lineno int, line string")
    kept = runs.until_done(df)
    s = runs.run_stats(runs.steps(kept)).first()
    assert (s["avg_tok_s"], s["output_tokens"]) == (7.0, 3) and runs.prefill(kept).first()["prefill_s"] == 1.5
    one = runs.run_stats(runs.steps(df.limit(1))).first()
    assert one["stddev_tok_s"] == 0.0 and one["avg_step_ms"] == 125.0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("models: {a: {size_gb: 7.8}}\n")
    assert '"size_gb": 7.8' in tables.yaml_file(spark, str(tmp_path / "c.yaml")).first()["content"]
    assert tables.yaml_file(spark, str(tmp_path / "none.yaml")).first()["content"] == "{}"
    assert tables.overlay({"a": 1, "b": 2}, {"b": 3, "c": None}) == {"a": 1, "b": 3}
    df = spark.createDataFrame([(1, 2.345)], "k int, v double")
    tables.write_csv(df, str(tmp_path / "csv"), {"v": 2})
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["v"] in ("2.35", "2.34")
    tables.write_json(df, str(tmp_path / "json"))
    tables.write_text(df, "v", str(tmp_path / "text"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1 and tables.log_lines(spark, str(tmp_path / "text")).count() >= 1
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "Big-Model.gguf").write_bytes(b"x")
    assert tables.model_files(spark, [str(tmp_path / "m")], "*.gguf", "big-model").count() == 1


def test_prompts_and_batches(spark):
    m = spark.createDataFrame([(1, 0, "system", "s"), (1, 2, "assistant", "a b"), (1, 1, "user", "u "), (2, 0, "user", "hi \n")], "conv_id long, turn long, role string, text string")
    assert prompts.with_roles(m).filter("conv_id = 1").first()["prompt"] == "System: s\nu \nAssistant: a b"
    assert prompts.last_message(m, F.lit("Qwen3-4B")).filter("conv_id = 2").first()["text"] == "hi /no_think"
    c = prompts.chunks(m.filter("role = 'assistant'"), ["conv_id"]).orderBy("idx").collect()
    assert [r["delta"] for r in c] == ["a", " b", "", "[DONE]"]
    b = metrics.batches(m.select("conv_id", "turn", F.length("text").alias("len")), ["conv_id", "turn"], "len", 3).orderBy("batch").collect()
    assert [(r["n"], r["longest"], r["padding"]) for r in b] == [(3, 3, 3), (1, 4, 0)]
    routed = capacity.routed(spark.createDataFrame([("x",), ("y",)], "intent string"), spark.createDataFrame([("x", "m1")], "intent string, model string"), "m0")
    assert {r["model"] for r in routed.collect()} == {"m0", "m1"}
