"""Holds a query's rows against DuckDB's on the same parquet files."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pandas as pd

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else p / '*.parquet'}'")
    return con


def _cell(x: object) -> str:
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else f"{x:.6g}"
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(_cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def compare(spark, query, sql: str) -> None:
    got, want = query(spark, str(DATA)).toPandas(), connection().sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
