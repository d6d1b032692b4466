"""Comparison of query results with SQL, as sets of rows."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    return int(value) if not isinstance(value, (bytes, bytearray, datetime.date)) else str(value)


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def connection(directory: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(directory).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return c


def compare(spark, name: str, query, sql: str, directory: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """(Spark's columns, SQL's columns, Spark's rows, SQL's rows), columns sorted by name, rows sorted."""
    df = query(spark, directory)
    ours = rows_of(df.columns, df.collect())
    result = connection(directory).execute(sql)
    columns = [x[0] for x in result.description]
    return sorted(df.columns), sorted(columns), ours, rows_of(columns, result.fetchall())
