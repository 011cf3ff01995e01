"""Spelling variants against brute force over all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import compare
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import spelling
from newsloom.llm.queries import words as queries


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def words_of(docs) -> Counter:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return Counter({w: k for w, k in n.items() if len(w) >= 5 and k >= 3})


def plain(docs) -> dict:
    n, out = words_of(docs), {}
    form = {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = [n[w], len(near), form[w], n[form[w]] if form[w] else None]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return {w: tuple(x) for w, x in out.items()}


def found(frame) -> dict:
    rows = frame.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def texts(seed: int, alphabet: str, many: int) -> list[tuple]:
    rng = random.Random(seed)
    bases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(4, 9))) for _ in range(30)]
    docs = []
    for doc in range(many):
        line = []
        for _ in range(60):
            w = rng.choice(bases[: rng.randint(1, 30)])
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                k = rng.randrange(len(w) + 1)
                w = rng.choice((w[:k] + rng.choice(alphabet) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k + 1 :]))
            line.append(w.upper() if rng.random() < 0.2 else w)
        docs.append((doc, " ".join(line)))
    return docs


def test_against_brute_force(spark):
    docs = texts(1, "abcé", 120) + [(None, "aaaaa aaaab " * 4), (7, None), (8, ""), (9, "x" * 20_000 + " " + "x" * 19_999 + " ") , (10, ("x" * 20_000 + " ") * 3 + ("x" * 19_999 + "÷ ") * 3), (11, "Ünder ÜNDER ünder " * 3)]
    frame = spark.createDataFrame([(d, t, "w", 1) for d, t in docs], "doc_id long, text string, word string, n int")
    want = plain(docs)
    assert found(spelling.variants(frame)) == want and any(x[2] for x in want.values()) and any(x[4] != x[2] for x in want.values() if x[2])


def test_crowded_groups_are_cut(spark):
    n = words_of(texts(2, "ab", 60) + texts(3, "abcdef", 60))
    frame = spark.createDataFrame(list(n.items()), "word string, n long")
    want = {(a, b) for a in n for b in n if one_edit(a, b)}
    for crowded, bucket in ((4096, 50_000), (3, 10), (1, 1)):
        assert {(r.word, r.near) for r in spelling.near_words(frame, crowded=crowded, bucket=bucket).collect()} == want


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abc", max_size=7), min_size=1, max_size=40), st.integers(1, 3))
def test_tries(rests, groups):
    rests = sorted(rests)
    group = np.arange(len(rests)) % groups
    _, group = np.unique(group, return_inverse=True)
    i, j = spelling.near_in_tries(group, [r.encode() for r in rests])
    want = Counter((a, b) for a in range(len(rests)) for b in range(len(rests)) if group[a] == group[b] and one_edit(rests[a], rests[b]))
    assert Counter(zip(i.tolist(), j.tolist())) == want


def test_roots_follow_long_chains(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [("a", "w30"), ("b", "a")]
    assert {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()} == {w: "w37" for w, _ in forms}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).collect() == []


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_same_as_sql(spark, small):
    assert not compare.differences(queries.op13_spelling(spark, small), compare.views(small), queries.ORACLES["op13_spelling"])
