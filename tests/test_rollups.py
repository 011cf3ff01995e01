"""Merged sketches against exact values."""

from __future__ import annotations

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from newsloom.operators import rollups

AS_OF = date(2024, 3, 31)


def test_windows_of_merged_days(spark):
    rng = random.Random(2)
    rows = [(AS_OF - timedelta(rng.randrange(60)), rng.choice("ab"), rng.expovariate(1 / 300), rng.randrange(3000)) for _ in range(20_000)] + [(AS_OF, "a", None, None), (AS_OF, "c", None, None), (AS_OF + timedelta(1), "a", 9e9, 1)]
    frame = spark.createDataFrame(rows, "day date, source string, latency double, receiver long")
    rollup = rollups.daily(frame, "day", F.col("latency"), F.col("receiver"), "source")
    assert rollup.count() <= 60 * 3 + 1
    found = {(r.days, r.source): r for r in rollups.windowed(rollup, "day", AS_OF, (7, 30), {"p50": 0.5, "p90": 0.9}, "source").collect()}
    assert set(found) == {(d, s) for d in (7, 30) for s in "abc"}
    for (days, source), r in found.items():
        mine = [x for x in rows if x[1] == source and 0 <= (AS_OF - x[0]).days < days]
        values, who = sorted(x[2] for x in mine if x[2] is not None), {x[3] for x in mine if x[3] is not None}
        assert r.n == len(mine) and abs(r.distinct - len(who)) <= max(1, rollups.DISTINCT_ERROR * len(who))
        for share, got in ((0.5, r.p50), (0.9, r.p90)):
            assert (got is None) == (not values)
            if values:
                assert abs(sum(v <= got for v in values) / len(values) - share) <= rollups.RANK_ERROR + 1 / len(values)


def test_exact_quantiles(spark):
    frame = spark.createDataFrame([("a", v) for v in (1, 1, 1, 2, 5, None)] + [("b", 7), ("c", None)], "k string, v int")
    for share, want in ((0.5, {"a": 1, "b": 7}), (0.8, {"a": 2, "b": 7}), (0.81, {"a": 5, "b": 7}), (1.0, {"a": 5, "b": 7})):
        assert {r.k: r.quantile for r in rollups.exact_quantiles(frame, "v", share, "k").collect()} == want


def test_no_rows(spark):
    frame = spark.createDataFrame([], "day date, source string, latency double, receiver long")
    assert rollups.windowed(rollups.daily(frame, "day", F.col("latency"), F.col("receiver"), "source"), "day", AS_OF, (7,), {"p90": 0.9}, "source").collect() == []
