"""Queries over subword ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bpe, lm, packing, token_counts
from ..common import table


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after redaction; the edited text's digest stands for the text."""
    done = token_counts.edited_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op1_token_counts": op1_token_counts, "op3_byte_bpe": op3_byte_bpe, "op5_lm_scores": op5_lm_scores, "op11_packing": op11_packing}
