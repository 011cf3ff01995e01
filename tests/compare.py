"""Runs a registered query in Spark and its SQL in DuckDB over the same tables, and compares all values."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def views(at: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{at}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return int(x) if isinstance(x, bool) else str(x) if hasattr(x, "isoformat") else x


def rows_of(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def rows_of_sql(con, sql: str) -> tuple[list[str], Counter]:
    got = con.execute(sql)
    have = [c[0] for c in got.description]
    order = sorted(range(len(have)), key=lambda i: have[i])
    return [have[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def differences(df, con, sql: str) -> str:
    """What differs, or nothing."""
    (names, spark), (other, duck) = rows_of(df), rows_of_sql(con, sql)
    if names != other:
        return f"columns {names} and {other}"
    if spark != duck:
        return f"{sum(spark.values())} rows and {sum(duck.values())}; only in Spark: {list((spark - duck).items())[:3]}; only in SQL: {list((duck - spark).items())[:3]}"
    return ""
