"""The gate as a stream: each micro-batch is compared with all that is known at that moment, read by buckets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import gate
from ..params import DEFAULT, Params
from ..storage import fresh_path
from .known_urls import KnownUrls, of_articles
from .windows import distinct_within

#: The batch under which what was known before the stream is kept.
BEFORE = -1


def stored(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows under path that batches wrote (those before one of them); an absent table is empty."""
    try:
        rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], f"{schema}, batch bigint")
    return rows if before is None else rows.where(F.col("batch") < before)


def gated(raw: DataFrame, store: DataFrame, store_path: str, ledger_path: str, relevant: Column, checkpoint: str, seq: str = "seq", url: str = "url", ts: str = "", p: Params = DEFAULT, known: KnownUrls | None = None, **more) -> StreamingQuery:
    """Starts the gate over the stream raw, with all that is there at the start, then stops by itself.

    Rows that pass are appended under store_path, each turning away under ledger_path with its reason, known urls of the
    ledger included, so that hits() counts them again; both are folders by batch, which a repeated batch overwrites, so
    that each row is written once. store: what was known before (url, and aliases, if it has them); it is laid out by
    buckets once, before the first batch. known: the table of known urls (default: beside the store). ts: a time column,
    where urls that came within the stale hours are to be left out before; they aren't counted as hits then. more: as for
    routed().
    """
    if ts:  # a cache of the last hours before the store; what it lets through meets the store all the same
        raw = distinct_within(raw, ts, url, hours=p.stale_hours)
    known = known or KnownUrls(f"{store_path}-known")
    if known.read(raw.sparkSession).where(F.col("batch") == BEFORE).isEmpty():
        known.remember(of_articles(store, url), BEFORE)
    return routed(raw, known, store_path, ledger_path, relevant, checkpoint, seq, url, p=p, **more)


def routed(raw: DataFrame, known: KnownUrls, kept_path: str, ledger_path: str, relevant: Column, checkpoint: str, seq: str = "seq", url: str = "url", age_hours: Column | None = None, canonical: str = "", trusted: Column | None = None, most: int | None = None, p: Params = DEFAULT) -> StreamingQuery:
    """The gate over a stream, against a table of known urls that already holds what was known before.

    Each batch reads the buckets of its own urls and adds to the table what it decided: rows that it keeps, aliases, and
    the ledger's. age_hours: rows that pass are routed by age to notify or backfill, or to the ledger as stale or
    no_pubdate (freshness). canonical: a column with the url that a row's url leads to (null: none other); of rows with one
    canonical url the first is kept, the others, and those whose canonical url is known, are remembered as its aliases.
    trusted: rows that are relevant whatever they hold. most: a batch's further rows are kept as `deferred`, by seq: their
    columns but for large ones are the caller's to fill when drained() gives them out.

    Written by batch, under kept_path: the rows kept, with `stage` (kept, notify, backfill or deferred); under ledger_path:
    url, reason, seen of those turned away. Rows of null or empty urls are in neither.
    """
    work = fresh_path(raw.sparkSession, "gate-work")  # tables of one batch, which the next one replaces

    def step(batch: DataFrame, number: int) -> None:
        def put(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{work}/{name}")
            return batch.sparkSession.read.schema(df.schema).parquet(f"{work}/{name}")

        # narrow: a row's number, url, canonical url and what is decided where its body is
        passes = F.coalesce(relevant, F.lit(False)) if trusted is None else F.coalesce(relevant, F.lit(False)) | F.coalesce(trusted, F.lit(False))
        leads = F.coalesce(F.nullif(F.col(canonical), F.lit("")), F.col(url)) if canonical else F.col(url)
        age = F.lit(0.0) if age_hours is None else age_hours.cast("double")
        rows = put(batch.select(F.col(seq).alias("seq"), F.col(url).alias("url"), leads.alias("leads"), passes.alias("passes"), age.alias("age")), "rows")
        asked = rows.select("url").unionByName(rows.select(F.col("leads").alias("url")))
        found = put(known.among(asked, number).select("url", "why", "article"), "found")
        in_store, in_ledger = found.where(F.col("why").isin("stored", "alias")), found.where(~F.col("why").isin("stored", "alias"))
        staged = gate.staged(rows, in_store.select("url"), in_ledger.select("url"), F.col("passes"))
        if age_hours is not None:
            staged = gate.routed(staged.join(rows.select("seq", "age"), "seq"), F.col("age"), p).drop("age")
        staged = staged.join(rows.select("seq", "leads"), "seq")
        passed = F.col("stage").isin("kept", "notify", "backfill")
        if canonical:
            first = staged.where(passed).groupBy("leads").agg(F.min("seq").alias("first"))
            article = in_store.groupBy(F.col("url").alias("leads")).agg(F.min("article").alias("article"))
            staged = staged.join(first, "leads", "left").join(article, "leads", "left")
            other = F.col("article").isNotNull() | (F.col("seq") > F.col("first"))
            staged = staged.withColumn("stage", F.when(passed & other, "alias").otherwise(F.col("stage")))
        else:
            staged = staged.withColumn("article", F.lit(None).cast("string"))
        if most is not None:
            staged = put(staged, "aliased")
            now = staged.where(passed).orderBy("seq").limit(most).select("seq", F.lit(True).alias("now"))
            staged = staged.join(now, "seq", "left").withColumn("stage", F.when(passed & F.col("now").isNull(), "deferred").otherwise(F.col("stage"))).drop("now")
        staged = put(staged, "staged")
        kept = staged.where(F.col("stage").isin("kept", "notify", "backfill", "deferred"))
        # bodies are shuffled only of rows that can be kept
        batch.where(passes & (F.coalesce(url, F.lit("")) != "")).drop("stage").join(kept.select(F.col("seq").alias(seq), "stage"), seq).write.mode("overwrite").parquet(f"{kept_path}/batch={number}")
        gate.rejections(staged).write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")
        article = F.coalesce("article", "leads")
        seen = F.col("seq").cast("long").alias("seen")
        new = kept.select("url", F.lit("stored").alias("why"), "leads", seen)
        new = new.unionByName(kept.where("leads <> url").select(F.col("leads").alias("url"), F.lit("stored").alias("why"), "leads", seen))
        new = new.unionByName(staged.where((F.col("stage") == "alias") & (F.col("url") != article)).select("url", F.lit("alias").alias("why"), article.alias("leads"), seen))
        new = new.unionByName(staged.where(F.col("stage").isin("off_topic", "stale", "no_pubdate")).select("url", F.col("stage").alias("why"), "leads", seen))
        known.remember(new.withColumnRenamed("leads", "article"), number)

    return raw.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(deferred: DataFrame, done: DataFrame, order: list[Column], p: Params = DEFAULT, seq: str = "seq") -> DataFrame:
    """What a run takes of the deferred rows: those that no run has taken (done), the first by the order, at most a run's
    share. Whoever takes them fetches their bodies and asks gate.rechecked() whether they are still relevant."""
    return deferred.join(done.select(seq), seq, "left_anti").orderBy(*order).limit(p.drained)


def hits(spark: SparkSession, ledger_path: str, url_type: str = "string", seq_type: str = "bigint") -> DataFrame:
    """url, reason (of the first sighting), first_seen and hits of what the stream turned away."""
    rows = stored(spark, ledger_path, f"url {url_type}, reason string, seen {seq_type}")
    return rows.groupBy("url").agg(F.min_by("reason", F.struct("seen", "reason")).alias("reason"), F.min("seen").alias("first_seen"), F.count("*").alias("hits"))
