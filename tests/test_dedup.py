"""Duplicates against brute force on small tables."""

from __future__ import annotations

from datetime import date, timedelta

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions.text import title_key
from newsloom.operators import dedup
from newsloom.plans import catalogue


def test_near_vectors_of_neighbouring_days(spark):
    at = "/root/testdata/sf0.1"
    name = "dup_vector_days"
    found = catalogue.queries()[name](spark, at)
    assert found.where("a % 30 <> b % 30").count() > 0
    assert not compare.differences(found, compare.views(at), catalogue.oracle_sql()[name])


@pytest.mark.parametrize("size", [4, 1000])
def test_near_vectors_in_blocks(spark, size):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (60, 4))
    v[7] = v[8] = v[9]
    v[11] = 0
    days = [date(2024, 1, 1) + timedelta(int(k)) for k in rng.integers(0, 5, 60)]
    rows = spark.createDataFrame([(i, days[i], v[i].tolist()) for i in range(60)] + [(99, days[0], None)], "id long, day date, embedding array<double>")
    unit = v / np.maximum(np.sqrt((v * v).sum(1)), 1e-9)[:, None]
    near = unit @ unit.T
    truth = {(i, j) for i in range(60) for j in range(i + 1, 60) if near[i, j] >= 0.5 and abs((days[i] - days[j]).days) <= 1}
    got = [(r.a, r.b) for r in dedup.near_vectors_within(rows, 0.5, 1, size=size).collect()]
    assert len(got) == len(set(got)) and set(got) == truth


def test_near_titles_of_all_languages_and_lengths(spark, small):
    from newsloom.sources.fixtures import view

    rows = view(spark, small, "articles").select("id", "category", "published_on", title_key(F.split_part("body", F.lit("\n"), F.lit(1))).alias("k")).collect()
    grams = {r.id: {r.k[i : i + 3] for i in range(max(1, len(r.k) - 2))} for r in rows}
    day, lang = {r.id: r.published_on for r in rows}, {r.id: r.category for r in rows}
    truth = {}
    for a in grams:
        for b in grams:
            if a < b and abs((day[a] - day[b]).days) <= 1 and (c := len(grams[a] & grams[b]) / len(grams[a] | grams[b])) >= 0.9:
                truth[a, b] = round(c, 6)
    got = {(r.a, r.b): r.similarity for r in catalogue.queries()["dup_title_all"](spark, small).collect()}
    assert got == truth and any(lang[a] != "en" for a, _ in truth)


def test_titles_longer_than_a_prefix(spark, small):
    got = {len(r.k) for r in catalogue.queries()["title_whole_form"](spark, small).collect()}
    assert max(got) > 80


def test_titles_alike_share_a_part(spark):
    """At the bound and around it, for sizes on both sides of bands."""
    rng = np.random.default_rng(3)
    ends = dedup.bands(0.9, 4000)
    for size in (1, 2, 9, 10, 11, 40, 250, 999):
        for _ in range(20):
            g = rng.choice(1 << 40, 2 * size, replace=False).astype(np.uint64)
            most = int(np.floor(size / 0.9 + 1e-9))
            n = rng.integers(size, most + 1)
            both = int(np.ceil(0.9 / 1.9 * (size + n) - 1e-9))
            x, y = np.sort(g[:size]), np.sort(np.concatenate([g[size - both : size], g[size : size + n - both]]))
            at = [int(np.searchsorted(ends, len(s))) for s in (x, y)]
            assert at[1] in (at[0], at[0] + 1)
            a, b = (dedup.signatures(s, s, at[1], int(ends[at[1]]), 0.9) for s in (x, y))
            assert (a == b).any() and len(a) == len(b)


def test_keys_of_common_grams_meet_rarely(spark, tmp_path, monkeypatch):
    """Texts of one small vocabulary share their grams, yet few of their pairs are compared."""
    rng = np.random.default_rng(4)
    words = ["".join(w) for w in rng.choice(list("aeinorst"), (60, 4))]
    keys = spark.createDataFrame([("".join(rng.choice(words, 60)), k) for k in range(400)], "key string, k long")
    rows = keys.select("k", F.lit(date(2024, 1, 1)).alias("day"))
    made = {}
    real = dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name: made.setdefault(name, real(df, name)))
    assert dedup.alike_keys(keys, rows, 0.9, 1).count() == 0
    parts = made["title-parts"].select("k", F.explode("own").alias("part"))
    pairs = parts.join(parts.withColumnRenamed("k", "j"), "part").where("j < k").select("j", "k").distinct().count()
    assert pairs < 400 * 399 / 2 / 100


def test_copies_are_paired_in_blocks(spark, monkeypatch):
    """Many copies over days and some near titles: each pair once, made by tasks of like size, and no table sent whole."""
    monkeypatch.setattr(dedup, "BLOCK", 7, raising=False)
    monkeypatch.setattr(dedup, "PAIRS", 500, raising=False)
    first = date(2024, 1, 1)
    words = "the annual report of the council on water and roads in the northern province".split()
    titles = [" ".join(words)] * 150 + [" ".join(words) + "s"] * 20 + [" ".join(reversed(words))] * 3 + ["a title of its own", None]
    raw = [(k, t, first + timedelta(k % 4)) for k, t in enumerate(titles)] + [(0, titles[0], first), (None, titles[0], first)]
    rows = spark.createDataFrame(raw, "id long, title string, day date")
    found = dedup.near_titles(rows, 0.9, 1)
    got = sorted((r.a, r.b) for r in found.select("a", "b").collect())
    kind = {t: max(i, 1) for i, t in enumerate(dict.fromkeys(titles))}  # the first two are near
    some = [r for r in raw if r[0] is not None and r[1] is not None]
    assert got == sorted((x[0], y[0]) for x in some for y in some if x[0] < y[0] and kind[x[1]] == kind[y[1]] and abs((x[2] - y[2]).days) <= 1)
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 4 and max(tasks) < len(got) / 3
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
