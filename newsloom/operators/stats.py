"""Outlet statistics, merged news, reports and operational metrics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TONES = ("positive", "neutral", "negative", "unrated")


def outlet_stats(articles: DataFrame, as_of: date, windows: tuple[int, ...] = (7, 30, 365)) -> DataFrame:
    """Per outlet: mentions in each trailing window and tones, from one partial aggregation."""
    age = F.datediff(F.lit(as_of), F.col("published_on"))
    counts = [F.count_if((age >= 0) & (age < d)).alias(f"d{d}") for d in windows]
    return articles.groupBy("press").agg(*counts, *[F.count_if(F.col("tone") == t).alias(t) for t in TONES])


def colour(positive: Column, negative: Column, least: float = 0.6) -> Column:
    """The tone that leads by more than `least` of the rated ones, else neutral; none without any."""
    rated = positive + negative
    return F.when(rated == 0, "none").when(F.abs(positive - negative) / rated <= least, "neutral").when(positive > negative, "positive").otherwise("negative")


def ranked(stats: DataFrame) -> DataFrame:
    """By year, month, week, each descending; equal ones share a rank. Outlets are a small dimension."""
    return stats.withColumn("rank", F.rank().over(Window.orderBy(F.desc("d365"), F.desc("d30"), F.desc("d7"))).cast("long"))


def merged_news(articles: DataFrame, items: DataFrame, category: str, n: int, agency: str = "") -> DataFrame:
    """The newest of a category's articles and of policy items together, at most n (1 to 120); with an agency, those that
    have it in their column agency."""
    n = min(max(n, 1), 120)
    if agency:
        articles, items = (x.where(F.col("agency") == agency) for x in (articles, items))
    a = articles.where(F.col("category") == category).select(F.lit("article").alias("kind"), "id", F.col("published_on").alias("day"))
    b = items.select(F.lit("item").alias("kind"), "id", F.col("collected_on").alias("day"))
    return a.unionByName(b).orderBy(F.desc("day"), "kind", "id").limit(n)


def sessions(events: DataFrame, user: str, ts: str, gap_seconds: int) -> DataFrame:
    """user, start, end, n of runs of events with no gap of gap_seconds or more."""
    return events.groupBy(user, F.session_window(ts, f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("last")).select(user, F.col("w.start").alias("first"), "last", "n")


def party_of(roster: DataFrame) -> DataFrame:
    """name to party; a name of several parties has none."""
    return roster.groupBy("name").agg(F.when(F.min("party") == F.max("party"), F.min("party")).otherwise("").alias("party"))
