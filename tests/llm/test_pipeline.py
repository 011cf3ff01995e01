"""The pipeline's stages against brute force on a small table, one by one and together."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken  # noqa: F401  the encoding is compared with it in test_encoding
from pyspark.sql import functions as F

from newsloom.llm import bpe, decontaminate, quality, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, __n long, spans string"


def sentence(rng, n):
    return " ".join(rng.choice(("ba", "du", "mo", "ri", "sel", "tan", "vor", "wil")) + rng.choice(("n", "s", "t", "")) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark: good texts, junk, copies, shared lines, passages, odd rows."""
    rng = random.Random(3)
    at = str(tmp_path_factory.mktemp("pipe"))
    items = [(k, sentence(rng, 60)) for k in range(3)] + [(7, None), (8, "")]
    shared = "This very line stands in many documents"
    texts = []
    for k in range(60):
        lines = [sentence(rng, 12) for _ in range(rng.randint(2, 12))]
        if k % 4 == 0:
            lines.insert(1, f"  {shared if k % 8 else shared.upper()}\t")
        if k % 10 == 3:
            lines.append(items[k % 3][1])
        if k % 10 == 7:  # a passage in a text so long that it stays
            lines = [sentence(rng, 1500), items[k % 3][1], sentence(rng, 20)]
        texts.append("\n".join(lines))
    texts += [t.replace("ba", "ba", 1) for t in texts[10:16]] + [texts[20] + " Again.", texts[21].upper()]
    junk = ["$$$ %%% " * rng.randint(5, 60) + "\n" + "!!! ||| 123 " * 20 for _ in range(20)]
    rows = [(k, t, "en", "s", len(t), 5, "x") for k, t in enumerate(texts + junk)]
    rows += [(100, None, None, None, None, None, None), (101, "", "en", "s", 0, None, None), (None, "Nobody's text stands here.", "en", "s", 26, None, None), (3, texts[3], "en", "s", len(texts[3]), None, None), (5, "Another text of five stands here.", "en", "s", 33, None, None)]
    labels = [(k, int(k < len(texts)), 0) for k in range(len(texts) + len(junk))] + [(100, 0, None), (None, 1, 0), (2, 1, 0)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def documents(spark, at):
    return spark.read.parquet(f"{at}/documents.parquet")


def test_quality_keeps_what_plain_numpy_keeps(spark, tables):
    docs = documents(spark, tables)
    got = plain(stage("quality")(spark, docs, tables))
    labels = [tuple(r) for r in spark.read.parquet(f"{tables}/labels.parquet").collect()]
    judge = discriminant([tuple(r)[:2] for r in docs.collect()], {i: y for i, y, _ in labels if i is not None})
    assert got == sorted((tuple(r) for r in docs.collect() if judge(r.text) >= 0.3), key=str)
    assert 40 < len(got) < docs.count()


def discriminant(docs, labels):
    """A plain fit on the labelled rows of the training folds, and its score."""
    import zlib

    rows = [(np.array(quality.statistics(t)), labels[i]) for i, t in docs if labels.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 5 != 0]
    x = [np.array([v for v, y in rows if y == k]) for k in (0, 1)]
    means = [v.mean(0) for v in x]
    own = [np.cov(v.T, bias=True) for v in x]
    pooled = sum(len(v) * c for v, c in zip(x, own)) / len(rows)
    cov = []
    for c in own:
        c = 0.9 * c + 0.1 * pooled
        cov.append(0.95 * c + 0.05 * np.diag(np.diag(pooled)) + 1e-4 * np.eye(quality.D))

    def score(text):
        v = np.array(quality.statistics(text))
        dens = [math.log(len(x[k])) - 0.5 * ((v - means[k]) @ np.linalg.solve(cov[k], v - means[k]) + np.linalg.slogdet(cov[k])[1]) for k in (0, 1)]
        return 1 / (1 + math.exp(min(500, max(-500, dens[0] - dens[1]))))

    return score


def test_quality_scores_are_those_of_plain_numpy(spark, tables):
    docs = documents(spark, tables)
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    judge = discriminant([tuple(r)[:2] for r in docs.collect()], {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None})
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in (3, 5)}
    for r in quality.classify(docs, labels).collect():
        if r.doc_id in texts:
            assert math.isclose(r.score, judge(texts[r.doc_id]), rel_tol=1e-9, abs_tol=1e-12)


def test_lines_against_brute_force(spark, tables):
    docs = documents(spark, tables)
    rows = docs.collect()
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rank = lambda i: -math.inf if i is None else i
    for r in rows:
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(rank(r.doc_id))
    truth = []
    for r in rows:
        kept = [x for x in (r.text or "").split("\n") if len(holders[key(x)]) < 3 or max(holders[key(x)]) == rank(r.doc_id)]
        text = None if r.text is None else "\n".join(kept)
        truth.append((r.doc_id, text, r.lang, r.source, None if text is None else len(text), r["__n"], r.spans))
    assert plain(stage("line_dedup")(spark, docs, tables)) == sorted(truth, key=str)
    assert any(t[1] != r.text for t, r in zip(truth, rows))


def shingled(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def test_near_duplicates_against_brute_force(spark, tables):
    docs = documents(spark, tables)
    rows = docs.collect()
    sets = [shingled(r.text, 5) for r in rows]
    top = list(range(len(rows)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if rows[i].doc_id is None or rows[j].doc_id is None:
                continue
            same_id = rows[i].doc_id == rows[j].doc_id
            if same_id or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])):
                top[root(i)] = root(j)
    least = defaultdict(lambda: math.inf)
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            least[root(k)] = min(least[root(k)], r.doc_id)
    truth = [tuple(r) for k, r in enumerate(rows) if r.doc_id is None or not sets[k] or least[root(k)] == r.doc_id]
    got = plain(stage("near_dup")(spark, docs, tables))
    assert got == sorted(truth, key=str) and len(got) < len(rows)


def test_passages_against_brute_force(spark, tables):
    docs, items = documents(spark, tables), [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 13]) for _, t in items for w in [decontaminate.words_of(t)] for k in range(max(0, len(w) - 12))}
    truth, cut = [], 0
    for r in docs.collect():
        words = decontaminate.words_of(r.text)
        hit = set()
        for k in range(len(words) - 12):
            if tuple(words[k : k + 13]) in windows:
                hit.update(range(k, k + 13))
        if hit and 20 * len(hit) >= len(words):
            continue
        spans, at = [], 0
        while at < len(words):
            end = at
            while end in hit:
                end += 1
            if end - at >= 50:
                spans.append((at, end))
            at = max(end, at + 1)
        text = decontaminate.clean_text(r.text, spans)
        cut += bool(spans)
        truth.append((r.doc_id, text, r.lang, r.source, None if text is None else len(text), r["__n"], r.spans))
    assert plain(stage("decontaminate")(spark, docs, tables)) == sorted(truth, key=str)
    assert cut and len(truth) < docs.count()
    small = decontaminate.uncontaminated(docs, spark.read.parquet(f"{tables}/benchmark.parquet"), block_bytes=400)
    assert sorted((r.doc_id or -1, r.text or "") for r in small.collect()) == sorted((t[0] or -1, t[1] or "") for t in truth)


def test_encoding_comes_back(spark, tables):
    docs = documents(spark, tables)
    text = {}
    for r in docs.collect():
        text.setdefault(r.doc_id, set()).add(hashlib.sha256((r.text or "").encode()).hexdigest())
    got = stage("encode")(spark, docs, tables).collect()
    v = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert len(got) == docs.count()
    for r in got:
        assert r.decoded_sha256 in text[r.doc_id] and hashlib.sha256(v.decode(bytes(r.ids))).hexdigest() == r.decoded_sha256
        assert r.n_tokens == len(r.ids) // 4 and hashlib.sha256(bytes(r.ids)).hexdigest() == r.ids_sha256


def test_all_stages_in_turn(spark, tables):
    docs = documents(spark, tables)
    for _, run in corpus_pipeline.STAGES:
        docs = run(spark, docs, tables)
    truth = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect())
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, tables).collect())
    assert got == truth and 20 < len(got) < 90


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_tables(spark, tables, name):
    docs = documents(spark, tables).limit(0)
    done = stage(name)(spark, docs, tables)
    assert done.count() == 0
    assert name == "encode" or done.columns == docs.columns


def test_toxicity_scores_are_those_of_a_plain_loop(spark, tables):
    import zlib

    docs = documents(spark, tables).where("doc_id not in (3, 5)")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = labels.where("doc_id not in (3, 5)").select("doc_id", "toxic", F.xxhash64("doc_id").alias("h")).orderBy("h").collect()
    rows = [(set(toxicity.features(texts[r.doc_id]).tolist()), r.toxic) for r in order if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    z, n = defaultdict(float), defaultdict(float)
    bias = 1 << toxicity.BITS

    def weight(i):
        over = max(abs(z[i]) - (0 if i == bias else toxicity.L1), 0)
        return -math.copysign(over, z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for x, y in rows:
            at = [*x, bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    for i, t in texts.items():
        margin = sum(weight(j) for j in {*toxicity.features(t).tolist(), bias})
        assert math.isclose(got[i], 1 / (1 + math.exp(-margin)), rel_tol=1e-9)
