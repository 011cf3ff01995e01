"""The gate: what of a feed is new, fresh and relevant; and the ledger of what isn't.

Only a row's number and url are shuffled: whether a row is relevant is decided before, where its body is, and whoever
needs bodies joins them to the survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params

STAGES = ("empty", "repeated", "stored", "ledger", "off_topic", "kept")


def staged(raw: DataFrame, store: DataFrame, ledger: DataFrame, relevant: Column, seq: str = "seq", url: str = "url", trusted: Column | None = None) -> DataFrame:
    """seq, url and stage of each row of raw: empty, repeated (in this run), stored, ledger, off_topic or kept. Trusted
    rows are relevant whatever they hold. Of rows with one url, that with the least seq counts.

    Rows without a url never meet; of a url's rows an aggregation finds the first, so that a url that a third of all rows
    has is no task of its own."""
    passes = F.coalesce(relevant, F.lit(False))
    if trusted is not None:
        passes = passes | F.coalesce(trusted, F.lit(False))
    rows = raw.select(F.col(seq).alias("seq"), F.col(url).alias("url"), passes.alias("passes"))
    empty = rows.where(F.coalesce("url", F.lit("")) == "").select("seq", "url", F.lit("empty").alias("stage"))
    rows = rows.where(F.coalesce("url", F.lit("")) != "")
    known = store.select(F.col(url).alias("url"), F.lit("stored").alias("known")).union(ledger.select(F.col(url).alias("url"), F.lit("ledger").alias("known")))
    first = rows.groupBy("url").agg(F.min("seq").alias("first")).join(known.groupBy("url").agg(F.max("known").alias("known")), "url", "left")
    stage = F.when(F.col("seq") > F.col("first"), "repeated").when(F.col("known").isNotNull(), F.col("known")).when(~F.col("passes"), "off_topic").otherwise("kept")
    done = rows.join(first, "url").select("seq", "url", stage.alias("stage")).unionByName(empty)
    return done.withColumnsRenamed({"seq": seq, "url": url})


def probe(title: Column, law: Column, body: Column, p: Params = DEFAULT) -> Column:
    """What relevance looks at: title, law and the start of the body."""
    return F.concat_ws("\n", title, law, F.substring(body, 1, p.probe))


def rechecked(rows: DataFrame, relevant: Column, trusted: Column | None = None) -> DataFrame:
    """Survivors after their details were fetched: stage off_topic for those that no longer are relevant."""
    passes = F.coalesce(relevant, F.lit(False))
    if trusted is not None:
        passes = passes | F.coalesce(trusted, F.lit(False))
    return rows.withColumn("stage", F.when(passes, "kept").otherwise("off_topic"))


def fresh_route(age_hours: Column, p: Params = DEFAULT) -> Column:
    """notify up to 6 hours, backfill up to 72, then stale; without a time no_pubdate."""
    return F.when(age_hours.isNull(), "no_pubdate").when(age_hours <= p.fresh_hours, "notify").when(age_hours <= p.stale_hours, "backfill").otherwise("stale")


def rejections(rows: DataFrame, url: str = "url", seq: str = "seq") -> DataFrame:
    """url, reason and seen of the rows that the ledger takes or counts again: off topic, stale, without a date, and those
    that it knows."""
    return rows.where(F.col("stage").isin("off_topic", "ledger", "stale", "no_pubdate")).select(url, F.col("stage").alias("reason"), F.col(seq).alias("seen"))


def routed(rows: DataFrame, age_hours: Column, p: Params = DEFAULT) -> DataFrame:
    """Survivors by age: stage notify or backfill for those to store, stale or no_pubdate for the ledger."""
    return rows.withColumn("stage", F.when(F.col("stage") == "kept", fresh_route(age_hours, p)).otherwise(F.col("stage")))


def split_overflow(rows: DataFrame, order: list[Column], cap: int) -> tuple[DataFrame, DataFrame]:
    """The first `cap` rows by the order, and the others, which come again in a later run. The order must end with a
    unique column, seq."""
    now = rows.orderBy(*order).limit(cap)
    return now, rows.join(now.select("seq"), "seq", "left_anti")


def recent(store: DataFrame, collected: str, now, p: Params = DEFAULT) -> DataFrame:
    """The store's last 72 hours: a cache that may stand before the whole store, never in its place."""
    return store.where(F.col(collected) >= F.lit(now) - F.make_interval(hours=F.lit(p.stale_hours)))


def with_aliases(store: DataFrame, url: str = "url", aliases: str = "aliases") -> DataFrame:
    """Every url that the store knows, aliases included."""
    return store.select(F.explode(F.array_union(F.array(url), F.coalesce(aliases, F.array()))).alias(url)).distinct()


def gathered_aliases(rows: DataFrame, canonical: str, url: str) -> DataFrame:
    """canonical and aliases: every other url under which it came."""
    return rows.groupBy(canonical).agg(F.array_sort(F.collect_set(url)).alias("aliases"))
