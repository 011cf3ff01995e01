"""Vector links and running clusters against brute force."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, timedelta

import numpy as np
import pytest

from newsloom.operators import dedup, running_clusters
from newsloom.operators.components import components
from newsloom.operators.vector_links import layout, near_vector_links, spanning


def groups_of(nodes, links) -> dict:
    top = {n: n for n in nodes}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def vectors(n: int, dim: int = 24):
    """Chains and stars of near vectors among far ones, copies on many days among them."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(n // 4, dim))
    v = np.concatenate([base, base + 0.3 * rng.normal(size=base.shape), base + 0.5 * rng.normal(size=base.shape), np.repeat(base[:3], n // 12, 0)])
    return v, [date(2024, 1, 1) + timedelta(int(k)) for k in rng.integers(0, 12, len(v))]


@pytest.mark.parametrize(("cell", "block"), [(512, 2048), (8, 4)])
def test_vector_groups(spark, cell, block):
    v, days = vectors(360)
    rows = [(i, d, x.tolist()) for i, (x, d) in enumerate(zip(v, days))] + [(900, None, v[0].tolist()), (901, days[0], None), (902, days[0], [0.0] * 24), (903, days[0], [1.0]), (904, days[0], [float("nan")] * 24), (None, days[0], v[0].tolist())]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "id long, day date, embedding array<double>, cell string")
    links = [(r.a, r.b) for r in near_vector_links(frame, 0.92, 1, cell=cell, block=block).collect()]
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    near = unit @ unit.T
    true = {(i, j) for i in range(len(v)) for j in range(i) if near[i, j] >= 0.92 and abs((days[i] - days[j]).days) <= 1}
    assert {(max(a, b), min(a, b)) for a, b in links} <= true and len(links) < 40 * len(v)
    want, got = groups_of(range(len(v)), true), groups_of(range(len(v)), links)
    assert got == want and len(set(want.values())) < len(v)


def test_no_vectors(spark):
    assert near_vector_links(spark.createDataFrame([], "id long, day date, embedding array<double>"), 0.9, 1).collect() == []


def test_what_is_compared_grows_slower_than_the_pairs():
    """Expected comparisons of vectors that aren't alike: pairs of a cell, times tables."""
    cost = [n * n / 2 ** layout(n, 0.92, 1e-6)[0] * layout(n, 0.92, 1e-6)[1] for n in (10**4, 10**6, 10**8)]
    assert cost[1] / cost[0] < 100**1.4 and cost[2] / cost[1] < 100**1.4
    for n in (100, 10**5, 10**8):
        planes, tables = layout(n, 0.92, 1e-6)
        assert (1 - (1 - np.arccos(0.92) / np.pi) ** planes) ** tables <= 1e-6


def test_spanning_links_join_what_all_join():
    rng = np.random.default_rng(1)
    i, j = rng.integers(0, 40, 60), rng.integers(0, 40, 60)
    keep = spanning(40, i, j)
    assert groups_of(range(40), zip(i[keep].tolist(), j[keep].tolist())) == groups_of(range(40), zip(i.tolist(), j.tolist()))
    assert keep.sum() == 40 - len(set(groups_of(range(40), zip(i.tolist(), j.tolist())).values()))


def test_spanned_pairs_have_the_components_of_all(spark):
    v, days = vectors(200)
    frame = spark.createDataFrame([(i, d, x.tolist()) for i, (x, d) in enumerate(zip(v, days))], "id long, day date, embedding array<double>")
    every, some = (dedup.near_vectors_within(frame, 0.6, 1, size=64, span=span) for span in (False, True))
    a, b = (sorted(map(tuple, components(x.select("a", "b")).collect())) for x in (every, some))
    assert a == b and some.count() < every.count()


def test_five_runs_are_one(spark):
    rng = random.Random(3)
    ids = list(range(80))
    links = [(a, b) for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(45)) if a != b] + [(5, 1000), (1000, 70), (999, 3)]
    rows = [(i, rng.choice(["p", "q", "r"]), rng.choice([None, "", "text"]), date(2024, 1, rng.randint(1, 9)), f"u{i}") for i in ids]
    frame = spark.createDataFrame(rows, "id long, press string, body string, published_on date, url string")
    outlets = spark.createDataFrame([("p", 2), ("q", 1)], "press string, tier int")
    new = running_clusters.of_articles(frame, outlets)
    run_of = {i: rng.randrange(5) for i in ids}
    labels = None
    for run in range(5):
        mine = [i for i in ids if run_of[i] == run]
        due = [(a, b) for a, b in links if max(run_of.get(a, 0), run_of.get(b, 0)) == run]
        labels = running_clusters.extended(labels, new.where(new.id.isin(mine)), spark.createDataFrame(due, "a long, b long"))
    once = running_clusters.extended(None, new, spark.createDataFrame(links, "a long, b long"))
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, once.collect()))
    top, members = groups_of([*ids, 999, 1000], links), defaultdict(list)
    for i in ids:
        members[top[i]].append(i)
    tier = {"p": 2, "q": 1, "r": 9}
    for r in running_clusters.with_aliases(labels).collect():
        group = members[top[r.id]]
        one = min(group, key=lambda i: (tier[rows[i][1]], not rows[i][2], rows[i][3], i))
        assert r.grp == min(group) and r.is_representative == (r.id == one)
        assert r.aliases == (sorted(f"u{i}" for i in group if i != one) if r.id == one else [])


def test_vector_links_have_the_components_of_all_pairs(spark, monkeypatch):
    """Also where a day has several blocks, days lack neighbours, most vectors are in one group, and some ids repeat; and
    what all of a large group leaves to compare is what it doesn't hold."""
    rng = np.random.default_rng(3)
    heart = rng.normal(size=8)
    rows = [(i, date(2024, 1, 1 + [0, 1, 2, 3, 9][i % 5]), [float(x) for x in (heart + 0.4 * rng.normal(size=8) if i % 9 else rng.normal(size=8))]) for i in range(700)]
    rows += [(5, date(2024, 1, 2), rows[8][2]), (900, date(2024, 1, 1), [0.0] * 8), (901, date(2024, 1, 1), None), (902, None, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "id long, day date, embedding array<double>")
    met = []
    whole = dedup._near_of_blocks
    monkeypatch.setattr(dedup, "_near_of_blocks", lambda left, *rest, **how: met.append(left.count()) or whole(left, *rest, **how))
    for least, days in ((0.75, 1), (0.97, 1)):
        every = dedup.near_vectors_within(frame, least, days, size=64)
        met.clear()
        some = dedup.vector_links(frame, least, days, size=64)
        of = lambda links: groups_of(range(903), [(r.a, r.b) for r in links.collect()])
        assert of(every) == of(some)
        if least == 0.75:
            assert met[1] < met[0] / 2
