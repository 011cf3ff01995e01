"""The registered queries of the library and their SQL, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import article_queries, gate_queries, item_queries, queue_queries, source_queries, stream_queries

MODULES = (item_queries, article_queries, gate_queries, queue_queries, source_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
