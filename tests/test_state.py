"""State of streams: known urls by buckets, sends, retries and silences by timers, over one and several batches."""

from __future__ import annotations

import random
import re
import time
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.params import Params
from newsloom.streaming import gate_stream, timers, windows
from newsloom.streaming.known_urls import KnownUrls, of_articles

START = datetime(2024, 3, 1)


def known_rows(spark, urls, why="stored"):
    return spark.createDataFrame([(u, why, u, i) for i, u in enumerate(urls)], "url string, why string, article string, seen long")


def test_a_batch_reads_the_buckets_of_its_urls(spark, tmp_path):
    known = KnownUrls(f"{tmp_path}/known", 16)
    asked = spark.createDataFrame([("u7",), ("",), (None,)], "url string")
    assert known.among(asked).collect() == []  # there is no table yet
    for batch in range(10):  # ten times the history
        known.remember(known_rows(spark, [f"u{k}" for k in range(50 * batch, 50 * batch + 50)]), batch)
        found = known.among(asked)
        assert [r.url for r in found.collect()] == ["u7"]
        buckets = {re.search(r"bucket=(\d+)", f)[1] for f in found.inputFiles()}
        assert len(buckets) == 1 and len(found.inputFiles()) <= batch + 1
    assert len(known.read(spark).inputFiles()) > 100
    small = known.compacted(spark, f"{tmp_path}/compacted", 8)
    assert small.read(spark).count() == 500 and len(small.read(spark).inputFiles()) == 8 and [r.url for r in small.among(asked).collect()] == ["u7"]


def test_a_repeated_batch_sees_what_it_saw(spark, tmp_path):
    known = KnownUrls(f"{tmp_path}/known", 4)
    known.remember(known_rows(spark, ["a", "a", "", None]), 0)
    for _ in range(2):
        asked = spark.createDataFrame([("a",), ("b",)], "url string")
        assert [r.url for r in known.among(asked, 1).collect()] == ["a"]
        known.remember(known_rows(spark, ["b"]), 1)
    assert sorted(r.url for r in known.read(spark).collect()) == ["a", "b"]


def test_aliases_of_articles(spark):
    store = spark.createDataFrame([("a", ["x", "y"]), ("b", None)], "url string, aliases array<string>")
    assert sorted((r.url, r.why, r.article) for r in of_articles(store).collect()) == [("a", "stored", "a"), ("b", "stored", "b"), ("x", "alias", "a"), ("y", "alias", "a")]


@pytest.mark.parametrize("files", [1, 4])
def test_routes_over_batches(spark, tmp_path, files):
    """url, where it leads, age and text: the first of what leads to one url is kept, and later batches know it all."""
    rows = [(0, "a", "A", 1, "good"), (1, "b", "A", 1, "good"), (2, "c", None, 50, "good"), (3, "d", None, 90, "good"), (4, "e", None, None, "good"), (5, "f", None, 1, "bad"), (6, "", None, 1, "good"), (7, None, "A", 1, "good")]
    again = [(10 + k, *r[1:]) for k, r in enumerate(rows)] + [(20, "A", None, 1, "good"), (21, "k1", None, 1, "good"), (22, "g", "k2", 1, "good"), (23, "h", None, 1, "good"), (24, "h", None, 1, "good")]
    frame = spark.createDataFrame([(*r, "mine") for r in rows + again], "seq long, url string, leads string, age long, body string, stage string")
    for k in range(files):
        frame.where(F.floor(F.col("seq") * files / 25) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/raw")
    known = KnownUrls(f"{tmp_path}/known", 8)
    known.remember(of_articles(spark.createDataFrame([("k1", ["k2"])], "url string, aliases array<string>")), gate_stream.BEFORE)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/raw")
    for _ in range(2):
        gate_stream.routed(stream, known, f"{tmp_path}/kept", f"{tmp_path}/ledger", F.col("body") == "good", f"{tmp_path}/state", age_hours=F.col("age"), canonical="leads").awaitTermination()
        kept = spark.read.parquet(f"{tmp_path}/kept")
        assert sorted((r.url, r.stage, r.seq) for r in kept.collect()) == [("a", "notify", 0), ("c", "backfill", 2), ("h", "notify", 23)]
    assert {(r.url, r.why, r.article) for r in known.read(spark).where("batch >= 0").collect()} == {
        ("a", "stored", "A"), ("A", "stored", "A"), ("b", "alias", "A"), ("c", "stored", "c"), ("h", "stored", "h"), ("g", "alias", "k1"), ("d", "stale", "d"), ("e", "no_pubdate", "e"), ("f", "off_topic", "f"),
    }
    assert {r.url: r.reason for r in gate_stream.hits(spark, f"{tmp_path}/ledger").collect()} == {"d": "stale", "e": "no_pubdate", "f": "off_topic"}


def test_what_a_run_cannot_take_is_deferred_and_drained(spark, tmp_path):
    frame = spark.createDataFrame([(k, f"u{k}", "good") for k in range(9)], "seq long, url string, body string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/raw")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/raw")
    gate_stream.routed(stream, KnownUrls(f"{tmp_path}/known", 4), f"{tmp_path}/kept", f"{tmp_path}/ledger", F.lit(True), f"{tmp_path}/state", most=4).awaitTermination()
    kept = spark.read.parquet(f"{tmp_path}/kept")
    deferred = kept.where("stage = 'deferred'")
    assert sorted(r.seq for r in kept.where("stage = 'kept'").collect()) == [0, 1, 2, 3]
    p = Params(drained=3)
    first = gate_stream.drained(deferred, deferred.where("false"), [F.col("seq")], p)
    assert [r.seq for r in first.collect()] == [4, 5, 6] and [r.seq for r in gate_stream.drained(deferred, first, [F.col("seq")], p).collect()] == [7, 8]


ROWS = "event_id long, topic string, ts timestamp, score double, ok boolean"


def end_of(spark, tmp_path, make, events, files: int, stops: int = 1, held=("held", "kept")):
    """The stream's result over files of events in order, the stream being started `stops` times on the way, then a clock's
    row; and how many rows of state are left."""
    parts = [events[len(events) * k // files : len(events) * (k + 1) // files] for k in range(files)]
    raw, out, state = f"{tmp_path}/raw", f"{tmp_path}/out", f"{tmp_path}/state"
    spark.createDataFrame([], ROWS).write.parquet(raw)
    rows = make(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(raw))
    with timers.rocksdb(spark):
        for run in range(stops):
            for part in parts[files * run // stops : files * (run + 1) // stops]:
                spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(raw)
            windows.into_table(rows, out, state, "append").awaitTermination()
        spark.createDataFrame([(None, None, datetime(2100, 1, 1), None, None)], ROWS).coalesce(1).write.mode("append").parquet(raw)
        windows.into_table(rows, out, state, "append").awaitTermination()
        reader = lambda: spark.read.format("statestore")
        left = reader().load(state).count() if held is None else sum(reader().option("stateVarName", name).load(state).count() for name in held)
    return [tuple(r) for r in spark.read.schema(rows.schema).parquet(out).select(*rows.columns).collect()], left


def ms(t: datetime) -> int:
    return int((t - datetime(1970, 1, 1)).total_seconds() * 1000)


def events_of(seed: int, n: int, seconds: float):
    rng, t, out = random.Random(seed), START, []
    for i in range(n):
        t += timedelta(milliseconds=int(1000 * rng.expovariate(1 / seconds)))
        out.append((i, rng.choice("xyy"), t, float(rng.randint(0, 3)), rng.random() < 0.2))
    for _ in range(n // 4):  # out of order, within the delay
        k = rng.randrange(n - 1)
        out[k], out[k + 1] = out[k + 1], out[k]
    return out


def paced(events, round_s: float, p: Params):
    """Second by second what a sender would do, without state or timers."""
    found = []
    for topic in {e[1] for e in events}:
        left = sorted(((ms(e[2]), -e[3], e[0]) for e in events if e[1] == topic))
        start, sent = 0, []
        step = int(1000 * round_s)
        while left:
            start = max(start, -(-left[0][0] // step) * step) if not [x for x in left if x[0] <= start] else start
            here = sorted([x for x in left if x[0] <= start], key=lambda x: (x[1], x[0], x[2]))[: p.per_round]
            for turn, x in enumerate(here, 1):
                at = max([start, *(t + int(1000 * p.spacing_seconds) for t in sent[-1:]), *(t + 60000 for t in sent[-p.per_minute :][:1] if len(sent) >= p.per_minute)])
                sent.append(at)
                found.append((topic, x[2], x[0], start, turn, at))
                left.remove(x)
            start += step
    return sorted(found)


@pytest.mark.parametrize(("files", "stops"), [(1, 1), (5, 1), (6, 3)])
def test_sends(spark, tmp_path, files, stops):
    p, events = Params(per_minute=5, per_round=3, spacing_seconds=4.5), events_of(1, 150, 6)
    found, left = end_of(spark, tmp_path, lambda rows: timers.sends(rows, "topic", "ts", "score", "event_id", 20, "2 minutes", p), events, files, stops)
    assert sorted(found) == paced(events, 20, p) and left == 0
    by = defaultdict(list)
    for topic, *_, at in sorted(found, key=lambda r: r[-1]):
        by[topic].append(at)
    assert all(b - a >= 4500 for t in by.values() for a, b in zip(t, t[1:])) and all(b - a >= 60000 for t in by.values() for a, b in zip(t, t[5:]))


@pytest.mark.parametrize(("files", "stops"), [(1, 1), (5, 2)])
def test_tries(spark, tmp_path, files, stops):
    p, events = Params(retries=3), [(i, f"{t}{i // 9}", *rest) for i, t, *rest in events_of(2, 200, 60)]
    found, left = end_of(spark, tmp_path, lambda rows: timers.tries(rows, "topic", "ts", "ok", "event_id", 4, 30, "10 minutes", p), events, files, stops)
    want, by = [], defaultdict(list)
    for e in sorted(events, key=lambda e: (e[2], e[0])):
        by[e[1]].append((ms(e[2]), e[4]))
    for message, tries in by.items():
        for n, (at, ok) in enumerate(tries, 1):
            over = ok or n > 3
            want.append((message, at, n, "sent" if ok else "failed" if over else "retry"))
            if over:
                break
            if n == len(tries) or tries[n][0] - at > 240_000:
                want.append((message, at + 240_000, n, "failed"))
                break
    assert sorted(found) == sorted(want) and {"sent", "failed", "retry"} == {r[3] for r in found} and left == 0


@pytest.mark.parametrize(("files", "stops"), [(1, 1), (5, 2)])
def test_silences(spark, tmp_path, files, stops):
    events = events_of(3, 120, 60)
    found, left = end_of(spark, tmp_path, lambda rows: timers.silences(rows, "topic", "ts", 3, "event_id", "10 minutes"), events, files, stops)
    want = []
    for topic in "xy":
        times = sorted(ms(e[2]) for e in events if e[1] == topic)
        want.append((topic, times[0], False))
        for a, b in zip(times, [*times[1:], 1 << 60]):
            if b - a > 180_000:
                want += [(topic, a + 180_000, True)] + [(topic, b, False)] * (b < 1 << 60)
    assert sorted(found) == sorted(want) and left == 0


def test_sessions_leave_no_state(spark, tmp_path):
    events = events_of(4, 100, 600)
    found, left = end_of(spark, tmp_path, lambda rows: windows.sessions(rows, "ts", "topic", "20 minutes", "1 hour"), events, 4, held=None)
    n = defaultdict(int)
    for topic, _, k in found:
        n[topic] += k
    assert {t: k for t, k in n.items() if t} == {t: sum(e[1] == t for e in events) for t in "xy"} and left <= 1  # the clock's own


def test_a_backlog_of_sends_takes_no_square_of_its_length():
    """Of a channel whose messages all wait, each round takes its share without going over the rest."""
    rows = [(i, 1000, float(i % 7), True) for i in range(200_000)]
    start = time.perf_counter()
    out, back, kept, wake = timers.Paced(20_000, Params(per_round=12)).advance(rows, None, 1 << 60)
    assert time.perf_counter() - start < 30
    assert len(out) == 200_000 and not back and kept is None and wake is None
    assert [r[0] for r in out[:12]] == list(range(6, 84, 7))[:12] and out[12][2] == out[0][2] + 20_000


def test_timers_of_keys_share_a_bucket(spark, tmp_path, monkeypatch):
    """Many messages, of numbers too large for floats, in one bucket, over several batches."""
    monkeypatch.setattr(timers, "BUCKETS", 1)
    events = [(i, str(2**53 + 1 + i // 3), START + timedelta(seconds=i), 0.0, i % 3 == 2) for i in range(90)]
    found, left = end_of(spark, tmp_path, lambda rows: timers.tries(rows.withColumn("topic", F.col("topic").cast("long")), "topic", "ts", "ok", "event_id", 4, 30, "10 minutes"), events, 3)
    assert sorted(found) == sorted((2**53 + 1 + i // 3, ms(START + timedelta(seconds=i)), i % 3 + 1, "sent" if i % 3 == 2 else "retry") for i in range(90)) and left == 0


def test_sends_that_wait_for_centuries_come_out(spark, small):
    """Rounds of ten years: the last messages of the events go long after 2100."""
    from newsloom.plans import stream_queries

    found = stream_queries._to_the_end(spark, small, lambda rows: timers.sends(rows, "topic", "ts", "score", "event_id", 3650 * 86400), "slow").collect()
    events = spark.read.parquet(f"{small}/events.parquet").count()
    assert len({r.id for r in found}) == len(found) == events and max(r["round"] for r in found) > ms(datetime(2150, 1, 1))


def test_rows_are_packed_by_bucket():
    import pickle

    import pyarrow as pa

    rows = [(b, k, i, 1000 - i, 0.0, True) for i, (b, k) in enumerate([(1, 2**53 + 1), (2, None), (1, 5), (1, 2**53 + 1), (2, None)])] + [(1, None, None, 9, 0.0, True)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], ["bucket", "key", "id", "at", "score", "ok"])
    (packs,) = timers._packed(iter([batch.slice(0, 2), batch.slice(2)]))
    held = {r["bucket"]: (r["first"], *pickle.loads(r["rows"])) for r in packs.to_pylist()}
    assert {b: (first, [names[c] for c in codes], ids.tolist()) for b, (first, names, codes, at, ids, score, ok) in held.items()} == {
        1: (997, [2**53 + 1, 5, 2**53 + 1], [0, 2, 3]), 2: (996, [None, None], [1, 4]),
    }
