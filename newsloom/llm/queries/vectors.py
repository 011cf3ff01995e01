"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import ann, whitening
from ..common import table


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_ann": op8_ann, "op12_whitening": op12_whitening}
