"""Compares queries with their SQL in DuckDB, as multisets of rows with columns sorted by name."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

DATA = Path("/root/testdata/sf0.001")


def _plain(x: object) -> object:
    if x is None or isinstance(x, (bool, str, bytes)):
        return x
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    return round(float(x), 5) + 0.0


def _rows(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark: SparkSession, query, sql: str, data: Path = DATA) -> str:
    """Empty if both give the same rows."""
    con = duckdb.connect()
    for p in data.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    df = query(spark, str(data))
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours, theirs = _rows(df.columns, df.collect()), _rows(names, cur.fetchall())
    if ours == theirs:
        return "" if ours else "both are empty"
    a, b = ours - theirs, theirs - ours
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only here {list(a)[:3]}; only there {list(b)[:3]}"
