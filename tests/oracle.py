"""Runs a query and its SQL side by side."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
needs_data = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are absent")


def connection(path: Path = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        at = path / f"{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if at.is_dir() else ''}'")
    return con


def plain(value: object) -> str:
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def rows(columns: list[str], data: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def assert_same(df: DataFrame, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    wanted = con.sql(sql)
    assert sorted(df.columns) == sorted(wanted.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(wanted.columns, wanted.fetchall())
