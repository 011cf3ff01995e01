"""Rollups, dedup and outage state over streams. Watermarks bound state; late rows are routed by age, never dropped by
the gate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..params import DEFAULT, Params


def daily_counts(rows: DataFrame, ts: str, *keys: str, late: str = "3 days") -> DataFrame:
    """day, keys, n by tumbling calendar days."""
    day = F.window(F.col(ts), "1 day")
    return rows.withWatermark(ts, late).groupBy(day.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), *keys, "n")


def sessions(rows: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "3 days") -> DataFrame:
    """user, first, n of runs of a user's rows without a gap."""
    w = F.session_window(F.col(ts), gap)
    return rows.withWatermark(ts, late).groupBy(w.alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("first"), "n")


def distinct_within(rows: DataFrame, ts: str, *keys: str, hours: int = 72) -> DataFrame:
    """The first row of each key within the hours. A cache: rows that it lets through again still meet the store."""
    return rows.withWatermark(ts, f"{hours} hours").dropDuplicatesWithinWatermark(list(keys))


def outages(rows: DataFrame, ts: str, source: str, p: Params = DEFAULT) -> DataFrame:
    """source, ts, quiet of each run: whether it is a source's first or follows a gap of outage_minutes or more. The
    state is one time a source."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t for batch in batches for t in batch["ts"].dropna())
        quiet = []
        for t in times:
            quiet.append(last is None or (t.timestamp() - last) >= 60 * p.outage_minutes)
            last = max(t.timestamp(), last or t.timestamp())
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"source": [key[0]] * len(times), "ts": pd.Series(times, dtype="datetime64[ns]"), "quiet": pd.Series(quiet, dtype=bool)})

    kind = rows.schema[source].dataType.simpleString()
    picked = rows.select(F.col(source).alias("source"), F.col(ts).alias("ts"))
    return picked.groupBy("source").applyInPandasWithState(run, f"source {kind}, ts timestamp, quiet boolean", "last double", "append", GroupStateTimeout.NoTimeout)


def into_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs the stream over all that is there and leaves its result under path: the whole of it (complete, whose state
    isn't evicted), or one folder for each batch (append, update); a repeated batch overwrites its own. Of an update
    stream, newest() reads the result."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    return rows.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(updates: DataFrame, *keys: str) -> DataFrame:
    """The last version of each key among the updates (with their batch) of a stream."""
    others = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("x")).select(*keys, "x.*")
