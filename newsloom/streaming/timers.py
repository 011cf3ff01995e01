"""Running state with event-time timers: what is sent when, what is tried again, and what has gone quiet.

Rows may come out of order, within the watermark's delay, and in any number of batches. So a key's rows wait in its state
until the watermark has passed them, which a timer tells, and are then taken in order: results depend on the rows alone,
not on how they were cut into batches, nor on restarts. Timers of rows that never come are handled alike: a key's clock
stands where the watermark stands. What a key still waits for is all that its state holds; it goes when nothing is left.

Keys are dealt by hash to BUCKETS, and rows are packed before they reach the state: what a batch costs goes by buckets and
packs, not by keys or calls a row. A bucket that a timer wakes is read whole.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..params import DEFAULT, Params

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 4096
#: Rows of a result that are handed over at a time, of one value of the state, and that are packed at a time.
ROWS, HELD, GATHERED = 100_000, 50_000, 1 << 18
#: Of each row, beside its key: its time in milliseconds, its id, and what its order or outcome needs.
COLUMNS = {"at": "int64", "id": "int64", "score": "float64", "ok": "bool"}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which such state needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class InOrder(StatefulProcessor):
    """Holds a bucket's rows until the watermark has passed them, then hands them over by key, in order of time, and id."""

    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "n bigint", "rows binary")  # a list is read whole by each append to it
        self.kept = handle.getValueState("kept", "keys binary")  # of each key: what is kept, and when to come again

    def wake(self, at: int | None, gone: int | None = None) -> None:
        """Sees to a timer at that time or before it; those up to `gone` have had their turn, though they are still listed."""
        if at is not None and not any(t <= at for t in self.handle.listTimers() if gone is None or t > gone):
            self.handle.registerTimer(int(at))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, now = None, timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            for least, part in zip(batch["first"].tolist(), batch["rows"].tolist()):
                if least < now:  # what comes later than the watermark's delay doesn't count
                    names, codes, *columns = pickle.loads(part)
                    some = columns[0] >= now
                    self.hold(names, codes[some], *(c[some] for c in columns))
                    if not some.any():
                        continue
                    least = int(columns[0][some].min())
                else:
                    self.held.updateValue((uuid.uuid4().int >> 66,), (part,))
                first = least if first is None else min(first, least)
        self.wake(first)
        yield pd.DataFrame(columns=list(self.columns))

    def hold(self, names: list, codes: np.ndarray, *columns: np.ndarray) -> None:
        """Adds rows to the state: their keys' names, which of these is each row's, and COLUMNS."""
        for start in range(0, len(codes), HELD):
            some = slice(start, start + HELD)
            self.held.updateValue((uuid.uuid4().int >> 66,), (pickle.dumps([names, codes[some].astype(np.int32), *(c[some] for c in columns)]),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        parts = [pickle.loads(r[0]) for r in self.held.values()]
        had, number = self.kept.exists(), {}
        kept = pickle.loads(self.kept.get()[0]) if had else {}
        for part in parts:
            part[0] = np.array([number.setdefault(n, len(number)) for n in part.pop(0)], np.int32)[part[0]]
        names, some = list(number), bool(parts)
        codes, *rows = [np.concatenate([part.pop(0) for part in parts]) if some else np.zeros(0, kind) for kind in ("int32", *COLUMNS.values())]
        due = np.flatnonzero(rows[0] <= now)
        due = due[np.lexsort((rows[1][due], rows[0][due], codes[due]))]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(codes[due])) + 1, [len(due)])) if len(due) else np.zeros(1, int)
        turns = {names[codes[due[a]]]: due[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())}
        turns |= {k: due[:0] for k, (_, at) in kept.items() if at is not None and at <= now and k not in turns}
        later = np.flatnonzero(rows[0] > now)
        first = [int(rows[0][later].min())] if len(later) else []
        if some:
            self.held.clear()
            self.hold(names, codes[later], *(r[later] for r in rows))
        out = []
        for k, at in turns.items():
            found, left, keep, again = self.turn([rows[c][at] for c in (1, 0, 2, 3)], kept.pop(k, (None, None))[0], now)
            if isinstance(found, list):
                out += [(k, *r) for r in found]
            else:  # a tuple of columns
                for start in range(0, len(found[0]), ROWS):
                    part = [c[start : start + ROWS] for c in found]
                    yield pd.DataFrame(dict(zip(self.columns, [np.full(len(part[0]), k, object), *part])))
            if len(left) and len(left[0]):
                i, t, score, ok = left
                self.hold([k], np.zeros(len(i), np.int32), t, i, score, ok)
            if keep is not None or again is not None:
                kept[k] = keep, again
            if len(out) >= ROWS:
                yield from self.frames(out)
                out = []
        if kept:
            self.kept.update((pickle.dumps(kept),))
        elif had:
            self.kept.clear()
        for t in list(self.handle.listTimers()):
            if t <= now and t != expiredTimerInfo.getExpiryTimeInMs():
                self.handle.deleteTimer(t)
        self.wake(min(first + [at for _, at in kept.values() if at is not None], default=None), now)
        yield from self.frames(out)

    def frames(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        for start in range(0, len(out) or 1, ROWS):
            yield pd.DataFrame(out[start : start + ROWS], columns=list(self.columns))

    def turn(self, due: list[np.ndarray], kept: tuple | None, now: int) -> tuple:
        """advance() of columns; who has many rows of a key gives out columns and holds on to columns."""
        return self.advance(list(zip(*(c.tolist() for c in due))), kept, now)

    def advance(self, due: list[tuple], kept: tuple | None, now: int) -> tuple[list[tuple], list[tuple], tuple | None, int | None]:
        """Of one key, from the rows (id, at, score, ok) that are due, what was kept and the time: rows to give out, rows to
        hold on to (columns), what to keep, and when to come again if no row does."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Paced(InOrder):
    """A channel's messages in rounds. A round starts at a multiple of its length and takes the highest scores of what has
    come by then (ties: the earlier, then the lesser id), `per_round` at most; what is left waits for the next. A send keeps
    the spacing from the one before it, and a minute from that `per_minute` sends ago."""

    columns = ("channel", "id", "at", "round", "turn", "sent")

    def __init__(self, round_ms: int, p: Params):
        self.round_ms, self.p = round_ms, p

    def advance(self, due, kept, now):
        out, back, keep, wake = self.turn([np.array([r[c] for r in due], kind) for c, kind in enumerate(("int64", "int64", "float64", "bool"))], kept, now)
        return list(zip(*(c.tolist() for c in out))), list(zip(*(c.tolist() for c in back))), keep, wake

    def turn(self, due, kept, now):
        following, recent = (kept[0], [int(t) for t in kept[1].split(",") if t]) if kept else (0, [])
        step, most = self.round_ms, self.p.per_round
        i, at, score, _ = due
        order = np.lexsort((i, at, -score))  # a row's rank is its place here: the lower goes first
        first = np.maximum(-(-at[order] // step) * step, following)  # the round that each rank can go in at first
        by = np.argsort(first, kind="stable")  # the ranks that come with a round are a run
        rounds, counts = np.unique(first, return_counts=True)
        ends = np.cumsum(counts).tolist()
        rounds, runs, heap, waiting, taken, starts = rounds.tolist(), [], [], 0, [], []
        for n, start in enumerate(rounds):
            if start > now:
                break
            run = by[ends[n] - int(counts[n]) : ends[n]]
            runs.append(run)
            heapq.heappush(heap, (int(run[0]), len(runs) - 1, 0))
            waiting += len(run)
            last = min(now, rounds[n + 1] - 1) if n + 1 < len(rounds) else now
            go = min(waiting, ((last - start) // step + 1) * most)  # in the rounds until more come
            if 8 * go >= waiting:
                rest = np.sort(np.concatenate([runs[r][p:] for _, r, p in heap]))
                taken.append(rest[:go])
                runs = [rest[go:]]
                heap = [(int(rest[go]), 0, 0)] if go < waiting else []
            else:
                some = []
                for _ in range(go):
                    rank, r, p = heap[0]
                    some.append(rank)
                    if p + 1 < len(runs[r]):
                        heapq.heapreplace(heap, (int(runs[r][p + 1]), r, p + 1))
                    else:
                        heapq.heappop(heap)
                taken.append(np.array(some, np.int64))
            waiting -= go
            starts.append(start + np.arange(go) // most * step)
            following = start + -(-go // most) * step
        none = [np.zeros(0, np.int64)]
        turns = np.concatenate([np.arange(len(x)) % most + 1 for x in taken] or none).astype(np.int32)
        taken, starts = np.concatenate(taken or none), np.concatenate(starts or none)
        sent = self.spaced(starts, recent)
        recent = [*recent, *sent[-self.p.per_minute :].tolist()][-self.p.per_minute :]
        gone, left = order[taken], np.ones(len(order), bool)
        out = i[gone], at[gone], starts, turns, sent
        left[gone] = False
        back = [c[left] for c in due]
        some = len(back[0])
        wake = max(following, -(-int(back[1].min()) // step) * step) if some else following + 60_001
        if not some and following + 60_000 < now:  # nothing that could hold a later send back
            return out, back, None, None
        return out, back, (following, ",".join(map(str, recent))), wake

    def spaced(self, starts: np.ndarray, recent: list[int]) -> np.ndarray:
        """When sends of rounds that start then are made, after those of before."""
        spacing, most, out = int(1000 * self.p.spacing_seconds), self.p.per_minute, []
        for n in range(0, len(starts), ROWS):
            part = starts[n : n + ROWS]
            steps = np.arange(len(part)) * spacing
            sent = np.maximum.accumulate(part - steps)
            sent = (np.maximum(sent, recent[-1] + spacing) if recent else sent) + steps
            every = np.concatenate([np.array(recent, np.int64), sent])
            if (every[most:] - every[:-most] < 60_000).any():  # the minute's limit holds some back
                times = list(recent)
                for start in part.tolist():
                    times.append(max([start, *(t + spacing for t in times[-1:]), *([times[-most] + 60_000] if len(times) >= most else [])]))
                every = np.array(times, np.int64)
                sent = every[len(recent) :]
            recent = every[-most:].tolist()
            out.append(sent)
        return np.concatenate(out or [np.zeros(0, np.int64)])


class Tried(InOrder):
    """A message's attempts: sent once one worked; failed when one more than the retries didn't, or when nobody tries again
    in time. What comes after that is ignored, as long as the outcome is remembered."""

    columns = ("message", "at", "tries", "state")

    def __init__(self, patience_ms: int, remember_ms: int, p: Params):
        self.patience, self.remember, self.p = patience_ms, remember_ms, p

    def advance(self, due, kept, now):
        tries, last, over = kept or (0, 0, False)
        out = []
        for at, ok in [*((r[1], r[3]) for r in due), (now, None)]:
            if over and at - last > self.remember:
                tries, over = 0, False
            if tries and not over and at - last > self.patience:
                last, over = last + self.patience, True
                out.append((last, tries, "failed"))
            if ok is not None and not over:
                tries, last = tries + 1, at
                over = ok or tries > self.p.retries
                out.append((at, tries, "sent" if ok else "failed" if over else "retry"))
        if not tries or (over and now - last > self.remember):
            return out, [], None, None
        return out, [], (tries, last, over), last + (self.remember if over else self.patience) + 1


class Quiet(InOrder):
    """When a source falls silent: a row when its last one is older than the limit, and one when it is back."""

    columns = ("source", "at", "stale")

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def advance(self, due, kept, now):
        last, out = (kept[0] if kept else None), []
        for at in (r[1] for r in due):
            if last is not None and at - last > self.limit:
                out.append((last + self.limit, True))
                last = None
            if last is None:
                out.append((at, False))
            last = at
        if last is not None and now - last > self.limit:
            out.append((last + self.limit, True))
            last = None
        return out, [], None if last is None else (last,), None if last is None else last + self.limit + 1


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, first (the least time) and rows, as the state holds them, of some rows at a time. A clock's rows end here."""
    gathered, n = [], 0

    def packs() -> pa.RecordBatch:
        table = pa.Table.from_batches(gathered).combine_chunks()
        bucket = table.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        bucket, key = bucket[order], pc.dictionary_encode(table.column("key").chunk(0), null_encoding="encode")
        codes, names = key.indices.to_numpy(zero_copy_only=False)[order], key.dictionary.to_pylist()
        if table.column("at").null_count:
            raise ValueError("a row has no time")
        columns = [table.column(c).to_numpy().astype(kind)[order] for c, kind in COLUMNS.items()]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])).tolist()
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            mine, local = np.unique(codes[a:b], return_inverse=True)
            out.append(pickle.dumps([[names[k] for k in mine.tolist()], local.astype(np.int32), *(c[a:b] for c in columns)]))
        first = np.minimum.reduceat(columns[0], cuts[:-1])
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int64()), pa.array(first), pa.array(out, pa.binary())], ["bucket", "first", "rows"])

    for batch in batches:
        batch = batch.filter(batch.column("id").is_valid())
        if batch.num_rows:
            gathered.append(batch)
            n += batch.num_rows
        if n >= GATHERED:
            yield packs()
            gathered, n = [], 0
    if gathered:
        yield packs()


def _keyed(rows: DataFrame, key: Column, id_col: str, ts: str, score: Column, ok: Column, late: str):
    at = F.unix_millis("ts").alias("at")
    rows = rows.select(key.alias("key"), F.col(id_col).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("ts"), score.cast("double").alias("score"), ok.alias("ok")).withWatermark("ts", late)
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket")
    return rows.select(bucket, "key", "id", at, "score", "ok").mapInArrow(_packed, "bucket bigint, first bigint, rows binary").groupBy("bucket")


def sends(rows: DataFrame, channel: str, ts: str, score: str, id_col: str = "id", round_seconds: float = 60, late: str = "1 minute", p: Params = DEFAULT) -> DataFrame:
    """channel, id, at, round, turn, sent (times in milliseconds) of queued messages, as Paced sends them. A channel is one
    key: its pace is what holds it back. Rows without an id only move the clock; null scores come last."""
    kind = rows.schema[channel].dataType.simpleString()
    found = _keyed(rows, F.col(channel), id_col, ts, F.coalesce(score, F.lit(float("-inf"))), F.lit(True), late)
    return found.transformWithStateInPandas(Paced(int(1000 * round_seconds), p), f"channel {kind}, id bigint, at bigint, round bigint, turn int, sent bigint", "Append", "EventTime")


def tries(rows: DataFrame, message: str, ts: str, ok: str, id_col: str = "id", patience_minutes: float = 60, remember_days: float = 30, late: str = "1 minute", p: Params = DEFAULT) -> DataFrame:
    """message, at (milliseconds), tries and state of each attempt that counts, and of messages that nobody tries again. An
    attempt whose outcome is null didn't work."""
    kind = rows.schema[message].dataType.simpleString()
    found = _keyed(rows, F.col(message), id_col, ts, F.lit(0.0), F.coalesce(ok, F.lit(False)), late)
    done = Tried(int(60_000 * patience_minutes), int(86_400_000 * remember_days), p)
    return found.transformWithStateInPandas(done, f"message {kind}, at bigint, tries int, state string", "Append", "EventTime")


def silences(rows: DataFrame, source: str, ts: str, minutes: float, id_col: str = "id", late: str = "1 minute") -> DataFrame:
    """source, at (milliseconds), stale: when each source's last row had become older than the minutes, and when it was
    back; the first row of a source is a return."""
    kind = rows.schema[source].dataType.simpleString()
    found = _keyed(rows, F.col(source), id_col, ts, F.lit(0.0), F.lit(True), late)
    return found.transformWithStateInPandas(Quiet(int(60_000 * minutes)), f"source {kind}, at bigint, stale boolean", "Append", "EventTime")
