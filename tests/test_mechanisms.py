"""Dictionaries, snapshots of sources, and logs of runs that the writing job counts."""

from __future__ import annotations

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from newsloom.operators import dictionaries, scorer, sinks
from newsloom.sources import snapshots

TERMS = "term_id long, term string"


@pytest.mark.parametrize(("literals", "most_bytes"), [(50, 1 << 20), (0, 1 << 20), (0, 40)])
def test_terms_of_texts(spark, literals, most_bytes):
    texts = ["abcabd", "", None, "xx한글xx", "Abc", "aaa" * 50_000 + "needle"]
    terms = [(1, "abc"), (2, "bca"), (3, "abcabd"), (4, "한글"), (5, ""), (6, None), (7, "abc"), (8, "needle"), (None, "x"), (9, "aa"), (9, "bd"), (10, "z|z.")]
    rows = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "id long, text string, term_ids string")
    found = dictionaries.with_terms(rows, spark.createDataFrame(terms, TERMS), literals=literals, most_bytes=most_bytes)
    want = [sorted({i for i, t in terms if i and t and t in (text or "")}) for text in texts]
    assert [r.term_ids for r in found.orderBy("id").collect()] == want and found.columns == ["id", "text", "term_ids"]
    assert dictionaries.with_terms(rows, spark.createDataFrame([], TERMS), literals=literals).where(F.size("term_ids") > 0).isEmpty()


def test_time_does_not_grow_with_terms():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    text = " ".join(word() for _ in range(100_000))
    took = []
    for n in (100, 10_000):
        found = dictionaries.automaton([(i, word()) for i in range(n)])
        start = time.process_time()
        dictionaries.held(found, text)
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0]


@pytest.fixture
def folder(tmp_path):
    """Three sources: one of two snapshots, one of which a snapshot is broken, one without any."""
    files = {"good=1": {}, "source=a b": {"1.json": [{"title": "t1", "link": "l1"}, {"title": "t2", "published": 3}], "2.json": [{"title": "t3"}]}, "source=c": {"1.json": [{"title": "t4"}], "2.json": "{no", "3.json": [{"link": "l5"}]}, "source=d": {}}
    for source, names in files.items():
        os.makedirs(f"{tmp_path}/feeds/{source}")
        for name, items in names.items():
            with open(f"{tmp_path}/feeds/{source}/{name}", "w") as f:
                f.write(items if isinstance(items, str) else "\n".join(map(json.dumps, items)))
    return f"{tmp_path}/feeds"


def test_snapshots(spark, folder):
    rows = snapshots.load(spark, folder)
    found = sorted((r.source, r.snapshot, r.seq or 0, r.title or r.link or "", bool(r.error)) for r in rows.collect())
    assert found == [("a b", "1.json", 0, "t1", False), ("a b", "1.json", 1, "t2", False), ("a b", "2.json", 0, "t3", False), ("c", "1.json", 0, "t4", False), ("c", "2.json", 0, "", True), ("c", "3.json", 0, "l5", False)]
    assert rows.rdd.getNumPartitions() == 5 and rows.where("source = 'a b'").rdd.getNumPartitions() == 2  # others aren't touched
    assert {r.published for r in rows.where("source = 'a b'").collect()} == {None, "3"}
    assert snapshots.load(spark, f"file://{folder}").count() == 6


def test_polls_of_snapshots(spark, folder, tmp_path):
    def run():
        query = snapshots.stream(spark, folder).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
        query.stop()
        return sorted((r.source, r.snapshot, r.seq or 0, bool(r.error)) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = run()
    assert first == [("a b", "1.json", 0, False), ("a b", "1.json", 1, False), ("a b", "2.json", 0, False), ("c", "1.json", 0, False), ("c", "2.json", 0, True), ("c", "3.json", 0, False)]
    with open(f"{folder}/source=d/9.json", "w") as f:
        f.write('{"title": "late"}')
    assert run() == [*first, ("d", "9.json", 0, False)]  # after a restart


def test_logs_of_runs(spark, tmp_path):
    stages = spark.createDataFrame([("kept",), ("notify",), ("repeated",), ("stored",), ("ledger",), ("off_topic",)], "stage string")
    row = sinks.logged_write(stages, f"{tmp_path}/stages", None, "pages", 2, 5).first()
    assert (row.fetched_count, row.new_count, row.dup_count, row.skipped_seen_count, row.http_request_count) == (6, 2, 1, 2, 2)
    assert spark.read.parquet(f"{tmp_path}/stages").count() == 6
    log = sinks.RunLog("gate", "pages")
    spark.streams.addListener(log)
    try:
        for k in range(2):
            stages.limit(3 + k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/raw")
        seen = spark.readStream.schema(stages.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/raw").observe("gate", *sinks.stage_counts())
        seen.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if len([r for r in log.rows if r[2]]) == 2:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    rows = [r for r in sinks.run_rows(spark, log.rows).collect() if r.fetched_count]
    assert sorted(r.fetched_count for r in rows) == [3, 4] and sum(r.new_count for r in rows) == 4


def test_a_budget_of_summaries(spark):
    rows = spark.createDataFrame([(k, f"t{k}" if k != 4 else None, "body" if k % 2 else None, 10 - k) for k in range(8)], "id long, title string, body string, score int")

    def ask(some: list[dict]) -> list[str]:
        if any(r["id"] == 3 for r in some):
            raise RuntimeError("no answer")
        return [""] if some == [{"id": 5, "title": "t5", "text": "body"}] else [r["text"].upper() for r in some]

    found = {r.id: (r.path, r.summary) for r in scorer.budgeted(rows, ask, 6, [F.desc("score"), F.col("id")], workers=1).collect()}
    assert found == {0: ("snippet", "T0"), 1: ("model", "BODY"), 2: ("snippet", "T2"), 3: ("fallback", "t3"), 4: ("fallback", ""), 5: ("fallback", "t5"), 6: ("waiting", None), 7: ("waiting", None)}
    assert {r.path for r in scorer.budgeted(rows, ask, 0, [F.col("id")]).collect()} == {"waiting"}
    assert scorer.budgeted(rows.where("false"), ask, 5, [F.col("id")]).collect() == []


def test_a_card_splits_its_summary_once(spark):
    """However often the lines are used."""
    from newsloom.functions import bills

    names = ("summary", "title", "law", "start", "end", "published", "status", "rationale")
    rows = spark.createDataFrame([("A. B. C. D.", "t", "", None, None, "", "", ""), (None, "t", "law", None, None, "", "", "")], ", ".join(f"{n} string" for n in names))
    found = rows.select(bills.card_lines(*[rows[n] for n in names], "none yet").alias("lines"))
    assert [r.lines for r in found.collect()][0] == ["A.", "B.", "C. D."]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_a_large_dictionary_stays_in_its_table(spark, monkeypatch):
    """Its terms are not collected, and a filter that lets nearly all pass makes no difference; terms of all lengths."""
    monkeypatch.setattr(dictionaries, "MOST_BITS", 1 << 10, raising=False)
    monkeypatch.setattr(dictionaries, "BYTES", 200, raising=False)
    rng = random.Random(7)
    word = lambda most: "".join(rng.choices("ab한é", k=rng.randint(1, most)))
    terms = list({word(40) for _ in range(800)} | {word(5) for _ in range(200)})
    texts = [" ".join([word(30), *rng.sample(terms, rng.randint(0, 6))]) for _ in range(60)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame(list(enumerate(terms)), TERMS)
    sent = []
    real = spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or real(value))
    found = dictionaries.with_terms(rows, table, literals=0, most_bytes=1000)
    got = {r.id: (r.text, r.term_ids) for r in found.collect()}
    assert got == {i: (t, [k for k, term in enumerate(terms) if t and term in t]) for i, t in enumerate(texts)}
    assert all(not isinstance(x, list) for x in sent)
    assert dictionaries.with_terms(rows, table, literals=0, most_bytes=1000, keep_text=False).columns == ["id", "term_ids"]
