"""Queries that learn from the table labels and score documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import quality, toxicity
from ..common import table


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality": op2_quality, "op7_toxicity": op7_toxicity}
