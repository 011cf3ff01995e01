"""Operational metrics of runs, sends and the ledger."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


def success(rows: DataFrame, source: str, ok, now: datetime, hours: int = 24) -> DataFrame:
    """source, n and rate of success within the last hours."""
    since = F.lit(now - timedelta(hours=hours)).cast("timestamp_ntz")
    return rows.where(F.col("ts") >= since).groupBy(source).agg(F.count("*").alias("n"), F.round(F.count_if(ok) / F.count("*"), 6).alias("rate"))


def silent(rows: DataFrame, sources: DataFrame, source: str, now: datetime, minutes: int = 10) -> DataFrame:
    """Sources of which nothing was collected in the last minutes, with their last time; those that never gave any too."""
    last = rows.where(F.col("ts") <= F.lit(now).cast("timestamp_ntz")).groupBy(source).agg(F.max("ts").alias("last"))
    quiet = F.col("last").isNull() | (F.col("last") < F.lit(now - timedelta(minutes=minutes)).cast("timestamp_ntz"))
    return sources.select(source).distinct().join(last, source, "left").where(quiet)


def availability(rows: DataFrame, first: datetime, last: datetime, p: Params = DEFAULT) -> DataFrame:
    """days, minutes_up and share: of the clock's slots of outage_minutes between first and last, those with a row."""
    width = 60 * p.outage_minutes
    slot = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - int((first - datetime(1970, 1, 1)).total_seconds())) / width)
    total = int((last - first).total_seconds() // width)
    up = rows.where((F.col("ts") >= F.lit(first).cast("timestamp_ntz")) & (F.col("ts") < F.lit(last).cast("timestamp_ntz"))).select(slot.alias("slot")).distinct()
    return up.agg(F.count("*").alias("up"), F.round(F.count("*") / total, 6).alias("share")).withColumn("slots", F.lit(total).cast("long"))


def top_hits(ledger: DataFrame, n: int = 10) -> DataFrame:
    """What keeps coming back."""
    return ledger.orderBy(F.desc("hits"), "url").limit(n)


def request_identity(log: DataFrame) -> DataFrame:
    """Runs whose requests aren't one for each source and one for each new item."""
    return log.withColumn("expected", F.col("sources") + F.col("new_count")).where(F.col("http_request_count") != F.col("expected"))
