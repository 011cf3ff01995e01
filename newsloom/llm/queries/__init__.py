"""The registered queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, classifiers, contamination, copies, encoding, lines, vectors, words

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (archives, classifiers, contamination, copies, encoding, lines, vectors, words)


def queries() -> dict[str, Query]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
