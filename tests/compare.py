"""Run a query on Spark and its SQL on DuckDB, and compare rows."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _sorted_rows(rows, order) -> list[tuple]:
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def _by_name(names) -> list[int]:
    return sorted(range(len(names)), key=lambda i: names[i])


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Same column names, same multiset of rows; returns the number of rows."""
    cursor = con.execute(sql)
    expected_names = [d[0] for d in cursor.description]
    expected = _sorted_rows(cursor.fetchall(), _by_name(expected_names))
    assert sorted(df.columns) == sorted(expected_names)
    actual = _sorted_rows(df.collect(), _by_name(df.columns))
    assert len(actual) == len(expected)
    for got, want in zip(actual, expected, strict=True):
        assert got == want
    return len(actual)
