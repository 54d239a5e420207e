"""The engine's own queries by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import runs, serving, streams, substrate, text, vectors

_PARTS = (text, serving, vectors, runs, substrate, streams)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for p in _PARTS for k, v in p.ORACLE_SQL.items()}
