"""Writes on immutable tables: each gives the table as it is afterwards (or the rows to append)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def new_rows(batch: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Insert or skip: one row for each key that the target lacks; also what 'returning' would give."""
    return batch.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def counted(ledger: DataFrame, sightings: DataFrame, key: str = "url") -> DataFrame:
    """key, reason (of the first sighting), first_seen, hits after the sightings."""
    both = ledger.select(key, "reason", "first_seen", "hits").union(sightings.select(key, "reason", F.col("seen").alias("first_seen"), F.lit(1).cast("long").alias("hits")))
    return both.groupBy(key).agg(F.min_by("reason", F.struct("first_seen", "reason")).alias("reason"), F.min("first_seen").alias("first_seen"), F.sum("hits").alias("hits"))


def last_write(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def seeded(table: DataFrame, seeds: DataFrame, key: str, column: str) -> DataFrame:
    """Seeds added; the column of those that are there follows the seed. inserted tells the new ones."""
    s = seeds.select(key, F.col(column).alias("seed"), F.lit(True).alias("in_seeds"))
    t = table.select(key, column, F.lit(True).alias("in_table"))
    return t.join(s, key, "full_outer").select(key, F.coalesce("seed", column).alias(column), F.col("in_table").isNull().alias("inserted"))


def filled(table: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """The column filled where it's null; of several values for a key, the least."""
    one = values.groupBy(key).agg(F.min(column).alias("new"))
    return table.join(one, key, "left").withColumn(column, F.coalesce(column, "new")).drop("new")


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def kept_until(rows: DataFrame, day: str, as_of, days: dict[str, int], kind: str) -> DataFrame:
    """Retention: rows of each kind up to its number of days; kinds without one stay."""
    limit = F.create_map(*[F.lit(x) for pair in days.items() for x in pair])
    age = F.datediff(F.lit(as_of), F.col(day))
    return rows.where(F.coalesce(age <= F.try_element_at(limit, F.col(kind)), F.lit(True)))


def without_old_bodies(rows: DataFrame, day: str, analysed: Column, as_of, days: int) -> DataFrame:
    """Bodies go once their article is analysed, or is older than `days`; the articles stay."""
    gone = F.coalesce(analysed, F.lit(False)) | F.coalesce(F.datediff(F.lit(as_of), F.col(day)) > days, F.lit(False))
    return rows.withColumn("body", F.when(~gone, F.col("body")))


def run_log(stages: DataFrame, run_at, source_type: str, requests: int, duration_ms: int, error: str | None = None) -> DataFrame:
    """One row for a run: what the gate saw, what is new, what it had seen before, and what the run cost."""
    count = lambda *names: F.count_if(F.col("stage").isin(*names))
    return stages.agg(F.count("*").alias("fetched_count"), count("kept").alias("new_count"), count("repeated").alias("dup_count"), count("stored", "ledger").alias("skipped_seen_count")).select(
        F.lit(run_at).alias("run_at"), F.lit(source_type).alias("source_type"), "fetched_count", "new_count", "dup_count", "skipped_seen_count",
        F.lit(requests).cast("long").alias("http_request_count"), F.lit(duration_ms).cast("long").alias("duration_ms"), F.lit(error).cast("string").alias("error"),
    )


#: What a run's row counts of the gate's stages, as metrics of whatever the stages pass through.
COUNTS = {"fetched_count": (), "new_count": ("kept", "notify", "backfill"), "dup_count": ("repeated",), "skipped_seen_count": ("stored", "ledger")}


def stage_counts() -> list[Column]:
    return [(F.count_if(F.col("stage").isin(*names)) if names else F.count(F.lit(1))).alias(name) for name, names in COUNTS.items()]


def logged_write(stages: DataFrame, path: str, run_at, source_type: str, requests: int, duration_ms: int) -> DataFrame:
    """Writes the stages under path and gives the run's row, which the same job counted on the way."""
    seen = Observation(f"run of {source_type}")
    stages.observe(seen, *stage_counts()).write.mode("overwrite").parquet(path)
    return run_rows(stages.sparkSession, [(run_at, source_type, *(seen.get[c] for c in COUNTS), requests, duration_ms, None)])


def run_rows(spark, rows: list[tuple]) -> DataFrame:
    """Rows of the log of runs; there are few in a run."""
    return spark.createDataFrame(rows, f"run_at timestamp, source_type string, {', '.join(f'{c} bigint' for c in COUNTS)}, http_request_count bigint, duration_ms bigint, error string")


class RunLog(StreamingQueryListener):
    """A row for each batch of the streams that observe their stages under a name (`stages.observe(name, *stage_counts())`):
    its time, counts and duration, and an error's text for a stream that fails. Add it with spark.streams.addListener()."""

    def __init__(self, name: str, source_type: str):
        self.name, self.source_type, self.rows = name, source_type, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            at = datetime.fromisoformat(event.progress.timestamp.replace("Z", "+00:00"))
            self.rows.append((at, self.source_type, *(getattr(seen, c) for c in COUNTS), 0, int(event.progress.durationMs.get("triggerExecution", 0)), None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.rows.append((datetime.now(), self.source_type, *(None for _ in COUNTS), 0, 0, str(event.exception)[:500]))
