"""Sources and sinks: parquet tables, inline rows, YAML and JSON files, logs, frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """Rows written as SQL VALUES."""
    return spark.sql(f"SELECT * FROM (VALUES {rows}) AS t({columns})")


def yaml_file(spark: SparkSession, path: str) -> DataFrame:
    """One row: path and the file's content as JSON; {} if it is missing or empty."""
    import json
    from pathlib import Path

    import yaml

    found = Path(path)
    content = (yaml.safe_load(found.read_text()) if found.exists() else None) or {}
    return spark.createDataFrame([(path, json.dumps(content, default=str))], "path string, content string")


def overlay(base: dict, *more: dict) -> dict:
    """Later maps win, key by key; None leaves what was there."""
    out = dict(base)
    for m in more:
        out |= {k: v for k, v in m.items() if v is not None}
    return out


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, lineno (from 0), line of text logs."""
    lines = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return lines.select("file", F.posexplode(F.split("value", "\n")).alias("lineno", "line"))


def model_files(spark: SparkSession, folders: list[str], pattern: str, name: str) -> DataFrame:
    """Files below the folders whose path holds name in any case: the first folder's win."""
    found = None
    for k, folder in enumerate(folders):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
        part = files.select("path", "length", F.lit(k).alias("priority"))
        found = part if found is None else found.unionByName(part)
    return found.filter(F.contains(F.lower("path"), F.lit(name.lower()))).orderBy("priority", "path").limit(1)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, decimals: dict[str, int]) -> None:
    """CSV with a header and fixed decimals."""
    shaped = df.select(*[F.format_string(f"%.{decimals[c]}f", F.col(c)).alias(c) if c in decimals else F.col(c) for c in df.columns])
    shaped.write.mode("overwrite").csv(path, header=True)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_audit(df: DataFrame, path: str) -> None:
    """Appends rows as lines of JSON, below a folder for each day of their `ts`."""
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def requests_of(lines: DataFrame, schema: str, column: str = "body") -> DataFrame:
    """lines with request (a struct of the schema, null where the body is no such JSON) and valid_json."""
    return lines.withColumn("request", F.from_json(column, schema)).withColumn("valid_json", F.expr(f"try_parse_json(`{column}`) IS NOT NULL"))


def tensor_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """file, tensor, dtype, shape, start, nbytes of the safetensors files in a folder. Only
    their headers are read: eight bytes that give a length, and JSON of that length."""
    import json

    jvm, rows = spark.sparkContext._jvm, []
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(where) if fs.exists(where) else ():
        name = status.getPath().getName()
        if not name.endswith(".safetensors"):
            continue
        stream = fs.open(status.getPath())
        try:
            size = int.from_bytes(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, 8)), "little")
            header = json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)))
        finally:
            stream.close()
        for tensor, about in header.items():
            if tensor != "__metadata__":
                start, end = about["data_offsets"]
                rows.append((name, tensor, about["dtype"], [int(n) for n in about["shape"]], 8 + size + start, end - start))
    return spark.createDataFrame(rows, "file string, tensor string, dtype string, shape array<long>, start long, nbytes long")
