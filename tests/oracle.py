"""Holds a query against its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return str(v)


def assert_same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(sql)
    columns = sorted(want.columns)
    assert columns == sorted(df.columns)
    order = [want.columns.index(c) for c in columns]
    expected = sorted(tuple(norm(r[i]) for i in order) for r in want.fetchall())
    assert sorted(tuple(norm(r[c]) for c in columns) for r in df.collect()) == expected
