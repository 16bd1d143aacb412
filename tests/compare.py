"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd

TABLES = "/root/testdata/sf0.001"


def norm(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, dict):
        return "{" + ",".join(norm(x) for x in v.values()) + "}"
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(pd.Timestamp(v)) if isinstance(v, pd.Timestamp) else str(v)


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    got, want = df.collect(), con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    a = sorted(tuple(norm(r[df.columns.index(c)]) for c in names) for r in got)
    b = sorted(tuple(norm(r[want.columns.index(c)]) for c in names) for r in want.fetchall())
    assert a == b
