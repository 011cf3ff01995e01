"""Queries of documents against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import near_dup
from ..common import table


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.linked(table(spark, sf_dir, "documents"))


QUERIES = {"op10_near_dup": op10_near_dup}
