"""Whitening against numpy in double precision."""

from __future__ import annotations

import math

import numpy as np
import pytest

from newsloom.llm import whitening
from newsloom.llm.queries import vectors


def plain(rows, most=32):
    """id -> (deviation, whitened up to sign), the shares, n."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(0)
    dev = ((n * x - sums) ** 2).sum(1)
    centred = ((n * x - sums) / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:most]
    order = [k for k in order if e[k] > 1e-11 * e.max()]
    return dev.tolist(), centred @ u[:, order] / np.sqrt(e[order]), e[order] / e.sum(), n


def test_a_whole_table(spark, small):
    data = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    dev, white, share, n = plain([(r.vec_id, r.embedding) for r in data])
    found = vectors.op12_whitening(spark, small).collect()
    assert len(found) == n * len(share)
    at = {r.vec_id: i for i, r in enumerate(data)}
    got = np.zeros_like(white)
    for r in found:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == dev[at[r.vec_id]] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
    sign = np.sign((got * white).sum(0))
    assert np.abs(got * sign - white).max() < 1e-6
    assert np.abs(got.T @ got / n - np.eye(len(share))).max() < 1e-9


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (2, [3.0, 1.0]), (None, [0.0, 5.5]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0]), (10, [0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, n int, x int")
    found = whitening.whiten(frame).collect()
    assert sorted({r.vec_id or 0 for r in found}) == [0, 1, 2, 10] and len(found) == 5 * 2 and {r.n for r in found} == {5}
    assert [r.deviation for r in found if r.vec_id == 2 and r.component == 1] == [plain([r for r in rows[:4]] + [rows[-1]])[0][1]] * 2


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_without_variance_there_are_no_rows(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_directions_without_variance_have_no_component(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0, float(i * i % 11)]) for i in range(50)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in found} == {1, 2} and {r.identity_error < 1e-6 for r in found} == {True}
    assert sum(r.explained for r in found if r.vec_id == 0) == pytest.approx(1, abs=1e-9)


def test_large_entries(spark):
    rows = [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 3.0]), (4, [1.0, 4.0])]
    found = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found[1, 1].deviation is None and found[3, 1].deviation is not None
    assert found[1, 1].explained == pytest.approx(1) and abs(found[1, 1].whitened) == pytest.approx(math.sqrt(2))


def test_exact_beyond_a_long():
    x = np.array([[1 << 50, 1], [5, 7]], dtype=np.int64)
    sums = np.array([int(x[:, 0].sum()), 8], dtype=object)
    for n in (2, 10**6):
        _, exact = whitening.centred(x, n, sums)
        assert exact == [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
