"""Inner product search against brute force, and archives by exact round trips."""

from __future__ import annotations

import hashlib
import struct

import compare
import numpy as np
import pytest
import zstandard

from newsloom.llm import ann, warc
from newsloom.llm.queries import archives, vectors


def brute(rows, k=20):
    good = {i: np.array(v, dtype=float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good.items():
        if q % 20 == 0:
            near = sorted((-float((v * w).sum()), i) for i, w in good.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def by_query(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_search_of_the_whole_table(spark):
    at = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    truth, got = brute(rows), by_query(vectors.QUERIES["op8_ann"](spark, at))
    assert got.keys() == truth.keys()
    x = {i: np.array(v, dtype=float) for i, v in rows if v}
    for q, near in got.items():
        assert len(near) == len(truth[q]) and near == sorted(near, key=lambda r: (-r[1], r[0]))
        assert all(np.isclose(s, (x[q] * x[i]).sum(), rtol=1e-12) for i, s in near)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in near}) / len(near) for q, near in truth.items()])
    assert recall >= 0.9


def test_search_by_codes_alone_in_many_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (v * rng.uniform(0.5, 2)).tolist()) for i, v in enumerate(rng.normal(size=(2000, 32)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    truth, got = brute(rows), by_query(ann.search(df, block=500, query_block=30, rerank=64))
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in near}) / 20 for q, near in truth.items()])
    assert recall >= 0.9


def test_search_of_odd_tables(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(0, one), (20, one), (1, one), (2, [0.0] * 3), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [float("nan")] * 3), (7, [float("inf"), 1.0, 1.0]), (8, [-1.0, 0.0, 0.0]), (9, [1.0]), (None, one), (10, one), (10, one)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    got = by_query(ann.search(df))
    assert got == {0: [(1, 14.0), (10, 14.0), (20, 14.0), (8, -1.0)], 20: [(0, 14.0), (1, 14.0), (10, 14.0), (8, -1.0)]}
    assert ann.search(df.limit(0)).count() == 0


def test_hot_vectors_are_whole(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0, 0.0, 0.0]) for i in range(300)] + [(300 + i, [0.5, 0.1 * i, 0.0, 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = by_query(ann.search(df))
    assert got[300] == [(i, s) for i, s in brute([(r.vec_id, r.embedding) for r in df.collect()])[300]]
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[280]] == list(range(20))


# --- archives --------------------------------------------------------------------------------------------------------


def test_archives_query_same_as_sql(spark, small):
    assert not compare.differences(archives.QUERIES["op9_warc_zstd"](spark, small), compare.views(small), archives.ORACLES["op9_warc_zstd"])


def test_payloads_come_back(spark, tmp_path):
    texts = [None, "", "x" * 99, "y" * 100, "y" * 100, "line\r\n\r\nline " * 20, "Größe 東京 🎉" * 50, "z" * 3_000_000]
    pages = spark.createDataFrame([(i, f"http://h/{i}", t, 1) for i, t in enumerate(texts)], "page_id long, url string, html string, digest int")
    folder = f"file://{tmp_path}/archive"
    manifest = warc.write_archives(warc.plan_records(pages), folder, warc.train_dictionary(pages), archive_bytes=1000)
    got = {int(r.page_id): r for r in warc.read_archives(spark, folder, manifest).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        body = (t or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].url) == (len(body), hashlib.sha256(body).hexdigest(), f"http://h/{i}")
        if i == 4:
            assert (got[i].record_type, got[i].refers_to, got[i].payload) == ("revisit", "3", None)
        else:
            assert (got[i].record_type, got[i].refers_to, bytes(got[i].payload)) == ("response", None, body)


def test_pages_of_odd_tables(spark):
    long = "w" * 200
    pages = spark.createDataFrame([(None, None, long), (2, None, long), (1, "a\r\nb: c", long), (1, None, long), (3, None, None)], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == [(0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None)]
    assert warc.round_trip(pages.limit(0)).count() == 0


def frame(raw, words=b""):
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None).compress(raw)


GOOD = warc.record(1, "http://a", b"body", hashlib.sha256(b"body").hexdigest(), None)


def test_a_compressed_dictionary_is_read():
    words = b"some words that serve as a dictionary " * 20
    data = warc.head(zstandard.ZstdCompressor().compress(words)) + frame(GOOD, words)
    assert [r["payload"] for r in warc.read_records(data)] == [b"body"]


@pytest.mark.parametrize(
    "data",
    [
        b"",
        frame(GOOD),  # no dictionary frame
        struct.pack("<II", warc.DICT_FRAME, 99) + b"short",
        warc.head(b"") + frame(GOOD)[:-3],
        warc.head(b"") + frame(GOOD) + b"junk",
        warc.head(b"") + frame(GOOD.replace(b"body", b"bodY")),
        warc.head(b"") + frame(GOOD + b"more"),
        warc.head(b"") + frame(GOOD.replace(b"X-Payload-Length: 4", b"X-Payload-Length: 5")),
        warc.head(b"") + frame(GOOD.replace(b"WARC-Date", b"WARC-Data")),
        warc.head(b"") + frame(GOOD.replace(b"WARC/1.1", b"WARK/1.1")),
    ],
)
def test_broken_archives_are_told(data):
    with pytest.raises((warc.BadArchive, struct.error)):
        list(warc.read_records(data))
