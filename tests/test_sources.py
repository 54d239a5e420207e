"""Sources and sinks over files written here."""

import json

from pyspark.sql import functions as F

from sparkloom.sources import tables


def test_tensor_manifest(spark, tmp_path):
    header = json.dumps({"__metadata__": {"format": "pt"}, "a.weight": {"dtype": "U32", "shape": [4, 8], "data_offsets": [0, 128]}, "a.scales": {"dtype": "F16", "shape": [4, 1], "data_offsets": [128, 136]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(len(header).to_bytes(8, "little") + header + bytes(136))
    (tmp_path / "other.bin").write_bytes(b"x")
    got = {r["tensor"]: tuple(r) for r in tables.tensor_manifest(spark, str(tmp_path)).collect()}
    at = 8 + len(header)
    assert got == {"a.weight": ("m.safetensors", "a.weight", "U32", [4, 8], at, 128), "a.scales": ("m.safetensors", "a.scales", "F16", [4, 1], at + 128, 8)}
    assert tables.tensor_manifest(spark, str(tmp_path / "none")).count() == 0


def test_audit_lines_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, what string").withColumn("ts", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    for _ in range(2):
        tables.write_audit(rows, str(tmp_path / "audit"))
    back = spark.read.json(str(tmp_path / "audit"))
    assert back.count() == 4 and {str(r["day"]) for r in back.collect()} == {"2024-01-02"}


def test_requests_and_json_document(spark, tmp_path):
    lines = spark.createDataFrame([('{"model": "m", "n": 2}',), ("{",), (None,)], "body string")
    got = tables.requests_of(lines, "model string, n int").collect()
    assert got[0]["request"]["model"] == "m" and [r["valid_json"] for r in got] == [True, False, False]
    (tmp_path / "d.json").write_text('{\n "a": [1, 2]\n}')
    assert tables.json_document(spark, str(tmp_path / "d.json")).first()["a"] == [1, 2]
