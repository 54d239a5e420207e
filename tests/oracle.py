"""Compares a query with its SQL on the same parquet files."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4)
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list | tuple):
        return tuple(map(_plain, x))
    return x if x is None or isinstance(x, bool | int | str | bytes) else (round(float(x), 4) if type(x).__name__ == "Decimal" else x)


def rows_of_spark(df):
    order = sorted(df.columns)
    return order, [tuple(_plain(r[c]) for c in order) for r in df.collect()]


def rows_of_sql(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    at = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in at], [tuple(_plain(r[k]) for k in at) for r in rel.fetchall()]


def differences(df, con, sql) -> str:
    """Empty if names and rows agree, in any order."""
    names, got = rows_of_spark(df)
    want_names, want = rows_of_sql(con, sql)
    if names != want_names:
        return f"columns {names} and {want_names}"
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    if got == want:
        return ""
    a, b = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
    return f"{len(got)} and {len(want)} rows; only here {a}; only there {b}"
