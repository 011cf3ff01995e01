"""Classifiers and language-model scores: held-out accuracy, distributions, and figures straight from the rules."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from newsloom.llm import lm, quality, toxicity
from newsloom.llm.queries import classifiers, encoding

LARGE = "/root/testdata/sf0.1"  # enough labels to judge by
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def rest(key, modulus):
    return zlib.crc32(str(key).encode()) % modulus


@pytest.mark.parametrize(("name", "label", "modulus", "out", "least"), [("op2_quality", "quality", 5, 0, 0.95), ("op7_toxicity", "toxic", 4, 2, 0.95)])
def test_held_out_accuracy(spark, name, label, modulus, out, least):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    got = {r.doc_id: r for r in classifiers.QUERIES[name](spark, LARGE).select("doc_id", "held_out", "score", "predicted").collect()}
    assert len(got) == spark.read.parquet(f"{LARGE}/documents.parquet").count()
    for r in got.values():
        assert r.held_out == (rest(r.doc_id, modulus) == out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(got[i].score, y) for i, y in truth.items() if i in got and got[i].held_out]
    right = sum((s >= 0.3) == bool(y) for s, y in held) / len(held)
    wins = [(a > b) + (a == b) / 2 for a, y in held if y for b, z in held if not z]
    assert right >= least and sum(wins) / len(wins) >= 0.9


@pytest.mark.parametrize(("classify", "label"), [(quality.classify, "quality"), (toxicity.classify, "toxic")])
def test_classifiers_of_odd_tables(spark, classify, label):
    docs = spark.createDataFrame([(1, "good words here", 1), (1, "good words here", 2), (2, None, 3), (3, "", None), (None, "x " * 5000, None)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert {r.score for r in classify(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 1), (1, 1), (3, None), (None, 0), (2, 0), (2, 1), (99, 1)], f"doc_id long, {label} int")
    got = classify(docs, odd).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert classify(docs.limit(0), none).count() == 0


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(1)
    x = [rng.normal(k, 1 + k, (400, quality.D)) for k in (0, 1)]
    n, sums = np.array([400.0, 400.0]), np.stack([v.sum(0) for v in x])
    model = quality.Discriminant.fit(n, sums, np.stack([v.T @ v for v in x]), 0.0, 0.0, 0.0)
    at = rng.normal(0.5, 1, (5, quality.D))
    dens = []
    for v in x:
        c, d = np.cov(v.T, bias=True), at - v.mean(0)
        dens.append(-0.5 * (np.einsum("ni,ij,nj->n", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1]))
    assert np.allclose(model.score(at), 1 / (1 + np.exp(dens[0] - dens[1])), atol=1e-9)


def test_ftrl_learns_and_leaves_few_weights():
    rows = [(np.array([1 if k % 2 else 2, 10 + k % 7, 1 << toxicity.BITS], dtype=np.int32), k % 2) for k in range(400)]
    w = toxicity.train(rows)
    assert w[1] > 0 > w[2] and np.count_nonzero(w[10:17]) < 7 and np.count_nonzero(w) < 12


# --- language model --------------------------------------------------------------------------------------------------


def base(docs):
    """doc_id to held_out, n_tokens, n_known, train_tokens, base_score, straight from the rule."""
    cut = {i: (t or "").encode().lower().split() + [None] for i, t in docs}
    counts = Counter(w for i, ws in cut.items() if rest(i, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (rest(i, 7) == 2, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in cut.items()}


def test_base_scores(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    truth = base(docs)
    got = {r.doc_id: r for r in encoding.QUERIES["op5_lm_scores"](spark, small).collect()}
    assert got.keys() == truth.keys()
    for i, (held_out, n_tokens, n_known, n, score) in truth.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, n_tokens, n_known, n)
        assert math.isclose(r.base_score, score, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isfinite(r.score) and r.score <= 0


def test_held_out_texts_score_better_than_by_counts(spark):
    """On 10,000 documents. The base score gives every unseen word the share of all unseen ones, so its probabilities sum
    to more than one, and on few documents, where many words are unseen, no distribution reaches it."""
    held = encoding.QUERIES["op5_lm_scores"](spark, LARGE).where("held_out").select("score", "base_score", "n_tokens").collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_scores_do_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    one, other = ({r.doc_id: r.score for r in lm.score(d, PATH, PATTERN).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert one.keys() == other.keys() and all(math.isclose(one[i], other[i], rel_tol=1e-9) for i in one)


def test_blocks_change_no_counts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(80)
    truth = base([tuple(r) for r in docs.collect()])
    got = {r.doc_id: r for r in lm.score(docs, PATH, PATTERN, block_bytes=20_000).collect()}
    for i, (_, n_tokens, n_known, n, score) in truth.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n_tokens, n_known, n)
        assert math.isclose(got[i].base_score, score, rel_tol=1e-9, abs_tol=1e-9)


def test_scores_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "A a b", 1), (2, None, 1), (3, "", 1), (3, "", 1), (None, " \n ", 1)], "doc_id long, text string, score int")
    got = lm.score(docs, PATH, PATTERN).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 1, 4]
    assert all(math.isfinite(r.score) and r.train_tokens == got[0].train_tokens for r in got)
    assert lm.score(docs.limit(0), PATH, PATTERN).count() == 0


def some_words(rng, n):
    """Counts as the corpus gives them, of n made-up words of some ids, and Words of them."""
    ids = [tuple(rng.integers(0, 300, rng.integers(1, 4)).tolist()) for _ in range(n)]
    ids = list(dict.fromkeys(ids))
    counts = rng.integers(0, 9, len(ids))
    first, last, every, heads = (np.zeros(300) for _ in range(4))
    for w, c in zip(ids, counts):
        if c:
            first[w[0]] += c
            last[w[-1]] += c
            heads[w[0]] += 1
            for i in w:
                every[i] += 1
    inner = lm.Words.layout(first, last, every)[2]
    steps = np.zeros((lm.INNER, lm.INNER + 1))
    for w, c in zip(ids, counts):
        if c:
            for i, j in zip(w, [inner[k] for k in w[1:]] + [lm.STOP]):
                steps[inner[i], j] += 1
    return ids, counts, lm.Words.of_counts(first, last, every, heads, steps, 17)


def test_shares_of_words_are_distributions():
    """All words of up to two ids: what a class gives to words known and unknown is at most one, and nearly so."""
    ids, counts, words = some_words(np.random.default_rng(5), 200)
    known = {w: c for w, c in zip(ids, counts)}
    every = [(i,) for i in range(300)] + [(i, j) for i in range(300) for j in range(300)] + [w for w in ids if len(w) == 3]
    a, _, share = words.coded(np.concatenate([np.array(w) for w in every]), np.array([len(w) for w in every]), np.array([known.get(w, 0) for w in every]))
    total = np.bincount(a, 10.0**share, lm.CLASSES)
    assert (total < 1 + 1e-6).all() and total.max() > 0.5 and np.isfinite(share).all()


def test_long_unknown_words_have_a_finite_share():
    _, _, words = some_words(np.random.default_rng(6), 50)
    share = words.coded(np.full(5000, 299), np.array([5000]), np.array([0]))[2]
    assert np.isfinite(share).all() and share[0] < -1000


def test_a_text_scored_in_plain_python():
    rng = np.random.default_rng(7)
    p = {n: rng.normal(0, 0.3, s).astype(np.float32) for n, s in lm.SHAPES.items()}
    texts = [(rng.integers(0, lm.END, n).astype(np.uint8), rng.integers(0, lm.END, n).astype(np.uint8)) for n in (0, 1, 15, 16, 40, 2000)]
    for (a, b), got in zip(texts, lm.attention_scores(p, texts)):
        one, two, goal = [lm.START, *a.tolist()], [lm.START, *b.tolist()], [*a.tolist(), lm.END]
        x = [(p["a"][i] + p["b"][j]).astype(float) for i, j in zip(one, two)]
        total = 0.0
        for t in range(len(one)):
            start = max(0, t // lm.CHUNK - 1) * lm.CHUNK
            scores = [float(x[t][lm.Q] @ x[k][lm.K]) * lm.DIM**-0.5 + float(p["d"][t - k]) for k in range(start, t + 1)]
            share = np.exp(np.array(scores) - max(scores))
            h = sum(w / share.sum() * x[k][lm.V] for w, k in zip(share, range(start, t + 1))) + x[t][lm.O]
            logits = h @ p["u"].astype(float) + p["c"]
            total += logits[goal[t]] - logits.max() - math.log(np.exp(logits - logits.max()).sum())
        assert math.isclose(got, total / math.log(10), rel_tol=1e-4)


def test_attention_tells_ids_apart():
    """Words that differ in one id in the middle have other codes there, and the classes after it differ."""
    ids, counts, words = some_words(np.random.default_rng(9), 200)
    every, sizes = np.concatenate([np.array(w) for w in ids]), np.array([len(w) for w in ids])
    _, codes, _ = words.coded(every, sizes, counts)
    starts = np.zeros(len(every), dtype=bool)
    starts[np.cumsum(sizes) - sizes] = True
    seen = set(every[np.repeat(counts > 0, sizes)].tolist())
    of = {(bool(s), int(i)): tuple(c) for s, i, c in zip(starts, every, codes.tolist()) if i in seen}
    assert len(set(of.values())) == len(of)
    middle = [c for (s, _), c in of.items() if not s]
    p = {n: np.random.default_rng(1).normal(0, 0.3, x).astype(np.float32) for n, x in lm.SHAPES.items()}
    texts = [tuple(np.array([codes[0], m, codes[-1]], dtype=np.uint8).T) for m in middle[:2]]
    one, two, _, opens, _ = lm.chunked(texts)
    x, y = lm.forward(p, one, two, opens)[0].reshape(2, lm.CHUNK, -1)
    assert np.allclose(x[:2], y[:2]) and not np.allclose(x[2], y[2]) and not np.allclose(x[3], y[3])


def test_words_scored_in_plain_python():
    rng = np.random.default_rng(10)
    ids, counts, words = some_words(rng, 200)
    p = {n: rng.normal(0, 0.3, s).astype(np.float32) for n, s in lm.SHAPES.items()}
    texts = [[], [3], [5, 7, 5], rng.integers(0, len(ids), 40).tolist()]
    coded = [words.coded(np.array(w), np.array([len(w)]), np.array([c])) for w, c in zip(ids, counts)]
    pairs = [np.concatenate([coded[k][1] for k in t] or [np.zeros((0, 2), np.uint8)]) for t in texts]
    got = lm.word_scores(p, [tuple(x.T) for x in pairs], np.array([coded[k][2][0] for t in texts for k in t]), words.of_places, words.spelt)
    for t, x, score in zip(texts, pairs, got):
        one, two, _, opens, _ = lm.chunked([tuple(x.T)])
        logits = lm.forward(p, one, two, opens)[0].astype(float)
        each = np.exp(logits - logits.max(1, keepdims=True))
        each /= each.sum(1, keepdims=True)
        over = each[:, : lm.FIRST].sum(1) + each[:, lm.END]
        total, at = 0.0, 0
        for k in t:
            (a, b), *rest_of_word = coded[k][1].tolist()
            spelling = 10.0 ** words.of_places[a, b]
            start = each[at, a] / over[at]
            for a2, b2 in rest_of_word:
                at += 1
                spelling *= each[at, a2] * 10.0 ** words.of_places[a2, b2]
            at += 1
            total += math.log10(start * (10.0 ** coded[k][2][0] + 10.0 ** words.spelt[a] * spelling * over[at]))
        assert math.isclose(score, total + math.log10(each[at, lm.END] / over[at]), rel_tol=1e-4, abs_tol=1e-4)


def test_texts_of_a_word_are_a_distribution():
    """The empty text and all texts of one word of up to two ids have at most all of the probability."""
    rng = np.random.default_rng(11)
    ids, counts, words = some_words(rng, 200)
    p = {n: rng.normal(0, 0.3, s).astype(np.float32) for n, s in lm.SHAPES.items()}
    p["c"][lm.END] = 6  # else most of it is in longer texts
    known = {w: c for w, c in zip(ids, counts)}
    every = [(i,) for i in range(300)] + [(i, j) for i in range(300) for j in range(300)] + [w for w in ids if len(w) == 3]
    sizes = np.array([len(w) for w in every])
    _, codes, share = words.coded(np.concatenate([np.array(w) for w in every]), sizes, np.array([known.get(w, 0) for w in every]))
    texts = [tuple(x.T) for x in np.split(codes, np.cumsum(sizes)[:-1])]
    total = (10.0 ** lm.word_scores(p, [(codes[:0, 0], codes[:0, 1])] + texts, share, words.of_places, words.spelt)).sum()
    assert 0.5 < total < 1 + 1e-4


def test_every_training_token_is_trained_on(spark):
    rng = np.random.default_rng(8)
    text = rng.integers(0, lm.END, (399, 2)).astype(np.uint8)

    def model(changed):
        codes = text.copy()
        if changed is not None:
            codes[changed] = (codes[changed] + 1) % lm.END
        rows = spark.createDataFrame([(0, 0, codes.tobytes()), (0, 1 << 40, text.tobytes())], "shard int, rid long, codes binary")
        return lm.flat(lm.trained(rows, np.zeros(lm.CLASSES, dtype=np.float32)))

    whole = model(None)
    for k in (0, 150, 398):
        assert not np.array_equal(model(k), whole), k


def test_attention_is_causal_and_classes_sum_to_one():
    rng = np.random.default_rng(2)
    p = lm.fresh(np.zeros(lm.CLASSES, dtype=np.float32))
    one, two = (rng.integers(0, lm.CLASSES, (3, lm.CHUNK)).astype(np.uint8) for _ in range(2))
    starts = np.array([True, False, False])
    logits = lm.forward(p, one, two, starts)[0].reshape(3, lm.CHUNK, -1)
    later = one.copy()
    later[1, 5:] = (later[1, 5:] + 1) % lm.CLASSES
    changed = lm.forward(p, later, two, starts)[0].reshape(3, lm.CHUNK, -1)
    assert np.allclose(logits[0], changed[0]) and np.allclose(logits[1, :5], changed[1, :5])
    assert not np.allclose(logits[1, 5:], changed[1, 5:]) and not np.allclose(logits[2], changed[2])
    every = [lm.log_classes(p, one[:1], two[:1], np.where(np.arange(lm.CHUNK) == 5, c, lm.NO_TARGET)[None, :].astype(np.uint8), starts[:1])[0] for c in range(lm.CLASSES)]
    assert math.isclose(np.exp(every).sum(), 1, abs_tol=1e-4)


def test_gradients():
    rng = np.random.default_rng(3)
    p = {n: rng.normal(0, 0.3, s) for n, s in lm.SHAPES.items()}
    one, two, target = (rng.integers(0, lm.CLASSES, (4, lm.CHUNK)).astype(np.uint8) for _ in range(3))
    target[3, 7:] = lm.NO_TARGET
    starts = np.array([True, False, True, False])
    g = lm.gradients(p, one, two, target, starts)
    for n in lm.SHAPES:
        at = np.unravel_index(np.abs(g[n]).argmax(), g[n].shape)
        up, down = ({k: x.copy() for k, x in p.items()} for _ in range(2))
        up[n][at] += 1e-3
        down[n][at] -= 1e-3
        loss = [-lm.log_classes(q, one, two, target, starts).sum() / (target != lm.NO_TARGET).sum() for q in (up, down)]
        assert math.isclose((loss[0] - loss[1]) / 2e-3, g[n][at], rel_tol=2e-2), n


def test_a_token_is_a_target_once():
    rng = np.random.default_rng(4)
    texts = [(rng.integers(0, lm.END, n).astype(np.uint8),) * 2 for n in (0, 1, 15, 16, 17, 100)]
    one, _, target, starts, sizes = lm.chunked(texts)
    assert sizes.tolist() == [len(a) // lm.CHUNK + 1 for a, _ in texts] and np.flatnonzero(starts).tolist() == [0, *np.cumsum(sizes)[:-1].tolist()]
    real = target != lm.NO_TARGET
    assert target[real].tolist() == [x for a, _ in texts for x in [*a.tolist(), lm.END]]
    assert (one[starts][:, 0] == lm.START).all() and (one == lm.START).sum() == len(texts)


class Captured:
    """In place of a DataFrame: gives what a worker would run on its batches."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_workers_remember_no_encoded_words():
    """Workers outlive their tasks; what they keep of each word adds up over a corpus."""
    v = lm.vocabulary(PATH, PATTERN)
    v.words.clear(), v.heads.clear()
    words = [f"{('word', 'größe')[k % 2]}{k},".encode() for k in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 3000, pa.int32()), pa.array(words, pa.binary()), pa.array([1] * 3000, pa.int64()), pa.array([True] * 3000)], ["block", "word", "c", "first"])
    (out,) = lm.encoded(Captured(), PATH, PATTERN)(iter([batch]))
    assert [v.decode(i) for i in out.column("ids").to_pylist()] == [b" " + w for w in words]
    assert not v.words and not v.heads


def test_words_are_split_as_bytes_are():
    rng = np.random.default_rng(3)
    marks = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", "\x00", "a", "B", "É", "z,"]
    texts = [None, b"", b" ", *("".join(rng.choice(marks, rng.integers(0, 30))).encode() for _ in range(3000))]
    words, sizes = lm.split_words(pa.array(texts, pa.binary()).slice(1))
    truth = [(t or b"").lower().split() for t in texts[1:]]
    assert sizes.tolist() == [len(w) for w in truth] and words.to_pylist() == [x for w in truth for x in w]
    words, sizes = lm.split_words(pa.array(texts[:1], pa.binary()))
    assert sizes.tolist() == [0] and not len(words)


@pytest.mark.parametrize("part, piece", [(1 << 20, 1 << 20), (7, 100)])
def test_texts_of_a_block_in_plain_python(monkeypatch, part, piece):
    """Whatever numpy takes at a time, texts have the codes and shares of their words one by one."""
    monkeypatch.setattr(lm, "PART", part)
    monkeypatch.setattr(lm, "SLICE", piece)
    rng = np.random.default_rng(11)
    ids, counts, shares = some_words(rng, 200)
    names = [f"w{k}".encode() for k in range(len(ids))]
    picks = [[], *(rng.integers(0, len(ids), n).tolist() for n in rng.integers(0, 60, 40)), []]
    texts = [None, *(b" " + b" ".join(names[i].upper() for i in p) for p in picks[1:-1]), b" \n"]
    n = len(texts)
    words = pa.table({"block": pa.array([0] * len(names), pa.int32()), "word": pa.array(names, pa.binary()), "c": pa.array(counts), "ids": pa.array([np.array(i, "<u4").tobytes() for i in ids], pa.binary())})
    rows = pa.table({"block": pa.array([0] * n, pa.int32()), "rid": pa.array(range(n), pa.int64()), "id": pa.array(range(n), pa.int64()), "held_out": pa.array([False] * n), "text": pa.array(texts, pa.binary())})
    got = lm.coded_texts(rows, words, shares, 900, 190, 30).to_pylist()
    each = [shares.coded(np.array(w), np.array([len(w)]), np.array([c])) for w, c in zip(ids, counts)]
    assert [r["id"] for r in got] == list(range(n))
    for r, p in zip(got, picks):
        assert r["codes"] == b"".join(each[i][1].tobytes() for i in p)
        assert np.allclose(np.frombuffer(r["counted"], "<f4"), [each[i][2][0] for i in p], rtol=1e-6)
        assert (r["n_tokens"], r["n_known"]) == (len(p) + 1, sum(int(counts[i] > 0) for i in p) + 1)
        assert math.isclose(r["base_score"], sum(math.log10((c + 1) / 1091) for c in [*(counts[i] for i in p), 30]), rel_tol=1e-9)
