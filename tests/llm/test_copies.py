"""Line dedup, near-duplicates and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import compare
import pytest

from newsloom.llm import decontaminate, line_dedup, near_dup
from newsloom.llm.queries import contamination, copies, lines

SPACE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- lines -----------------------------------------------------------------------------------------------------------


def deduped(docs, shortest=20, documents=3):
    """doc_id, n_lines, n_dropped, kept text; ids are distinct."""
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            key = line.strip(SPACE).translate(FOLD)
            if len(key) >= shortest:
                holders[key].add(i)
    out = {}
    for i, t in docs:
        every = (t or "").split("\n")
        keys = [line.strip(SPACE).translate(FOLD) for line in every]
        stay = [line for line, k in zip(every, keys) if not (len(k) >= shortest and len(holders[k]) >= documents and i != max(holders[k]))]
        out[i] = (len(every), len(every) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


LINES = ["a line that is long enough to count", "  A LINE that is long enough to Count\t", "short", "", "exactly twenty chars", "nineteen characters", "ÄÖ line of more than twenty", "äö line of more than twenty", "\x0bvertical tab around this line\x0c", " no-break blanks aren't stripped "]


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = [(i, "\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 150 if i == 3 else 8)))) for i in range(30)] + [(30, None), (31, ""), (32, "\n")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digests(line_dedup.dedup(rows)).collect()}
    assert got == deduped(docs)


def test_a_hot_line_goes_the_heavy_way(spark):
    docs = [(i, f"{LINES[0]}\na line of its own number {i:09d}") for i in range(6000)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup(rows).select("doc_id", "n_dropped").collect()}
    assert Counter(got.values()) == {1: 5999, 0: 1} and got[5999] == 0


def test_lines_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, LINES[0], "x", 5), (1, LINES[0], "y", 6), (2, LINES[0], None, None), (None, LINES[0], None, None)], "doc_id long, text string, dropped string, kept int")
    got = line_dedup.dedup(rows)
    assert set(got.columns) == {"doc_id", "text", "dropped", "kept", "n_lines", "n_dropped"}
    assert sorted((r.doc_id or 0, r.kept) for r in got.collect()) == [(0, ""), (1, ""), (1, ""), (2, LINES[0])]  # 1, 2 and null are three documents
    assert line_dedup.dedup(rows.limit(0)).count() == 0


def test_lines_query_same_as_sql(spark, small):
    assert not compare.differences(lines.QUERIES["op6_line_dedup"](spark, small), compare.views(small), lines.ORACLES["op6_line_dedup"])


# --- near-duplicates -------------------------------------------------------------------------------------------------


def sets_of(docs, size):
    out = {}
    for i, t in docs:
        words = (t or "").translate(FOLD).encode().split()
        n = min(size, len(words))
        out[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    return out


def grouped(docs, size=2, least=80):
    sets = sets_of(docs, size)
    ids, top = sorted(sets), {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= least * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def families(rng, n, copies_of):
    docs, words = [], [f"w{k}" for k in range(400)]
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice((5, 40, 120)))]
        for _ in range(rng.randint(1, copies_of)):
            mine = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 9))):
                mine[rng.randrange(len(mine))] = rng.choice(words)
            docs.append((len(docs), " ".join(mine)))
    return docs + [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, "  \n"), (len(docs) + 3, "One"), (len(docs) + 4, "one")]


@pytest.mark.parametrize(("seed", "size", "small_key"), [(1, 2, 64), (2, 5, 64), (3, 2, 3)])
def test_groups_against_brute_force(spark, seed, size, small_key):
    docs = families(random.Random(seed), 12, 18)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = near_dup.linked(rows, size, 80, small_key=small_key).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == grouped(docs, size)


@pytest.mark.parametrize("words", [24, 45])
def test_a_hot_group_without_a_hub(spark, words):
    """Many variants of one text that share keys; some are links, most aren't, and no one is near to all."""
    rng = random.Random(words)
    base = [f"w{k}" for k in range(words)]
    docs = []
    for i in range(150):
        mine = list(base)
        for k in range(rng.randint(1, 3)):
            mine[rng.randrange(words)] = rng.choice(("x", "y", f"z{i}"))
        docs.append((i, " ".join(mine)))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = near_dup.linked(rows, 5, 80, small_key=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == grouped(docs, 5)


def test_groups_of_odd_tables(spark):
    rows = spark.createDataFrame([(2, "a b c", 1), (2, "d e f", 1), (3, "d e f", 1), (None, "a b c", 1), (5, None, 1)], "doc_id long, text string, kept int")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dup.linked(rows).collect())
    assert got == [(0, 0, True), (2, 2, True), (2, 2, True), (3, 2, False), (5, 5, True)]
    assert near_dup.linked(rows.limit(0)).count() == 0


def test_ids_that_repeat_are_one_document(spark):
    rows = spark.createDataFrame([(3, "a b c"), (5, "a b c"), (5, "d e f"), (9, "d e f"), (7, "x y"), (7, None), (None, "d e f")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dup.linked(rows).collect()}
    assert got == {(3, 2): (3, True), (5, 2): (3, False), (9, 2): (3, False), (7, 1): (7, True), (7, 0): (7, True), (None, 2): (None, True)}


@pytest.mark.parametrize(("seed", "small_key"), [(11, 2), (12, 64)])
def test_small_blocks_are_crossed(spark, seed, small_key):
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(30)]
    docs = []
    for i in range(150):
        mine = list(base)
        for k in range(rng.randint(0, 3)):
            mine[rng.randrange(30)] = rng.choice(("x", "y", f"z{i}"))
        docs.append((i, " ".join(mine)))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = near_dup.linked(rows, 5, 80, small_key=small_key, block=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == grouped(docs, 5)


def test_one_very_long_text(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:190_000])), (3, " ".join(words[:60_000]))]
    got = near_dup.linked(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_near_dup_query(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in copies.QUERIES["op10_near_dup"](spark, small).collect()}
    assert got == grouped(docs)


def test_signatures_of_alike_sets_share_a_key():
    rng = random.Random(4)
    for _ in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        other = base[:270] + [f"v{k}" for k in range(30)]
        x, y = (near_dup.shingles(" ".join(t), 1) for t in (base, other))
        kx, ky = (near_dup.keys_of(near_dup.signature(s)[None, :]) for s in (x, y))
        assert (kx == ky).any()


# --- benchmark passages ----------------------------------------------------------------------------------------------


def judged(docs, items, window=13):
    """doc_id to n_words, n_hit, n_items, items, contaminated, straight from the rule."""
    windows = defaultdict(set)
    for item, t in items:
        words = decontaminate.words_of(t)
        n = min(window, len(words))
        for k in range(len(words) - n + 1 if words else 0):
            windows[tuple(words[k : k + n])].add(item)
    sizes = sorted({len(w) for w in windows})
    out = {}
    for i, t in docs:
        words = decontaminate.words_of(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if (of := windows.get(tuple(words[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= of
        text = ",".join(sorted(map(str, found)))
        out[i] = (len(words), len(hit), len(found), hashlib.sha256(text.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words))
    return out


def rows_by_id(found):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()}


@pytest.mark.parametrize(("seed", "block_bytes"), [(1, 8 << 20), (2, 300), (3, 120)])
def test_passages_against_brute_force(spark, seed, block_bytes):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcd")  # noqa: E731  few words, so that windows overlap and repeat
    items = [(k, " ".join(word() for _ in range(rng.choice((1, 2, 5, 12, 13, 14, 30))))) for k in range(4, 12)] + [(20, None), (21, ""), (22, "!!"), (23, "a b c d a b c d a b c d a"), (24, "a b c d a b c d a b c d a")]
    items = [i for i in items if not i[1] or len(i[1].split()) > 4]
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 400)))) for k in range(40)] + [(50, None), (51, "A-B.c d;a b c d a b c d A"), (52, items[0][1])]
    found = decontaminate.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert rows_by_id(decontaminate.digests(found)) == judged(docs, items)


def test_passages_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", 3), (1, "a b c", 3), (None, None, None)], "doc_id long, text string, items int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.digests(decontaminate.hits(docs, none)).collect()] == [0, 0, 0]
    one = spark.createDataFrame([(1, "B")], "item_id long, text string")
    assert sorted(r.n_hit for r in decontaminate.digests(decontaminate.hits(docs, one)).collect()) == [0, 1, 1]
    assert decontaminate.uncontaminated(docs, one).columns == docs.columns
    assert [r.doc_id for r in decontaminate.uncontaminated(docs, one).collect()] == [None]
    assert decontaminate.hits(docs.limit(0), one).count() == 0
    assert sorted(r.text or "" for r in decontaminate.without_spans(docs, one).collect()) == ["", "a  c", "a  c"]


def test_passages_query(spark, small):
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{small}/{name}.parquet").select(key, "text").collect()]
    name = next(iter(contamination.QUERIES))
    got = rows_by_id(contamination.QUERIES[name](spark, small))
    assert got == judged(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert any(v[4] for v in got.values()) and not all(v[4] for v in got.values())
