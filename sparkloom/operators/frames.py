"""Binary tensor frames: a big-endian header of magic, rank, number of dimensions and
type code, the shape, then the body in the machine's byte order."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format: the magic number, and type codes with bytes in the body
#: (code 3, bfloat16, travels as float32).
MAGIC = 0x48505054
TYPES = {1: ("float32", 4), 2: ("float16", 2), 3: ("float32", 4), 4: ("int32", 4), 5: ("int16", 2), 6: ("int8", 1), 7: ("uint8", 1), 8: ("bool", 1)}


def u32(c: Column) -> Column:
    return F.lpad(F.hex(c.cast("long")), 8, "0")


def header_hex(rank: Column, code: Column, shape: Column) -> Column:
    """The header and shape as hexadecimal digits."""
    return F.concat(F.lit(f"{MAGIC:08X}"), u32(rank), u32(F.size(shape)), u32(code), F.array_join(F.transform(shape, u32), ""))


def frame_bytes(code: Column, shape: Column) -> Column:
    """Bytes of the whole frame; null for an unknown type."""
    size = F.lit(None).cast("int")
    for k, (_, n) in TYPES.items():
        size = F.when(code == k, n).otherwise(size)
    return F.lit(16) + 4 * F.size(shape) + F.aggregate(shape, F.lit(1), lambda a, b: a * b.cast("int")) * size


def latency_ms(sent: Column, received: Column) -> Column:
    """-1 unless both times are set."""
    return F.when((sent > 0) & (received > 0), (received - sent) * 1000).otherwise(F.lit(-1.0))


def encode_frame(rank: int, shape, code: int, values) -> bytes:
    if code not in TYPES:
        raise ValueError(f"unknown type code {code}")
    head = struct.pack(f">4I{len(shape)}I", MAGIC, rank, len(shape), code, *shape)
    return head + np.asarray(values).astype(TYPES[code][0]).tobytes()


def decode_frame(data: bytes, strict: bool = True) -> tuple[int, list[int], int, np.ndarray]:
    """rank, shape, code, values. An unknown code is an error, or float32 if not strict."""
    magic, rank, ndim, code = struct.unpack_from(">4I", data)
    if magic != MAGIC:
        raise ValueError("bad magic")
    if code not in TYPES and strict:
        raise ValueError(f"unknown type code {code}")
    shape = list(struct.unpack_from(f">{ndim}I", data, 16))
    name, size = TYPES.get(code, ("float32", 4))
    body = data[16 + 4 * ndim :]
    if len(body) != int(np.prod(shape)) * size:
        raise ValueError("body length differs from the shape")
    return rank, shape, code, np.frombuffer(body, name)


@F.pandas_udf(T.BinaryType())
def encoded(rank: pd.Series, shape: pd.Series, code: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([encode_frame(r, list(s), c, v) for r, s, c, v in zip(rank, shape, code, values, strict=True)])


_FRAME = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("code", T.IntegerType()), T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])


@F.pandas_udf(_FRAME)
def decoded(frames: pd.Series) -> pd.DataFrame:
    rows = []
    for data in frames:
        try:
            r, s, c, v = decode_frame(bytes(data))
            rows.append((r, s, c, v.astype(float).tolist(), None))
        except (ValueError, struct.error) as e:
            rows.append((None, None, None, None, str(e)))
    return pd.DataFrame(rows, columns=["rank", "shape", "code", "values", "error"])


def roundtrip(vectors: DataFrame, key: str, vector: str, code: int) -> DataFrame:
    """key, ok shape, the largest difference after encoding and decoding."""
    x = vectors.select(key, F.col(vector).cast("array<double>").alias("x"))
    x = x.withColumn("f", encoded(F.lit(0), F.array(F.lit(1), F.size("x")), F.lit(code), F.col("x"))).withColumn("d", decoded("f"))
    gap = F.array_max(F.zip_with("x", "d.values", lambda a, b: F.abs(a - b)))
    return x.select(key, F.octet_length("f").alias("frame_bytes"), (F.col("d.shape") == F.array(F.lit(1), F.size("x"))).alias("same_shape"), gap.alias("max_difference"))
