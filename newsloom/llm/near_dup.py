"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's set of word shingles has a signature of SLOTS minima of BITS bits. Signatures are cut into CHUNKS chunks; by
the pigeonhole principle, two signatures that differ in fewer than CHUNKS * (ERRORS + 1) slots agree in all but ERRORS
slots of some chunk, so enumerating the errors (leaving out each slot of a chunk in turn) gives keys that every such pair
shares. Keys only propose: every link is confirmed on the full sets.

Equal sets meet first and are one node from there on. A key's holders are not paired with each other but with the least
of them (the pivot), and a document with the pivots of its few most held keys, so candidates grow with the documents
alone. What pivots leave open - holders of a key that are still in different components - is settled exactly: small keys by their cross pairs, large keys by testing each
holder outside the key's main component against that component in blocks, and against the others outside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import components
from .common import slices, written

CHUNKS, WIDTH, ERRORS, BITS = 16, 6, 1, 16
SLOTS = CHUNKS * WIDTH
KEYS = CHUNKS * WIDTH  # one error allowed: each slot of each chunk left out in turn
#: The keys guarantee every pair whose signatures differ in up to CHUNKS * (ERRORS + 1) - 1 = 31 slots, and miss one of
#: similarity 0.8 with a probability of (1 - 0.8**6 - 6 * 0.2 * 0.8**5)**16, which is 4e-8. Pairs that share a key are
#: compared if their signatures differ in at most FARTHEST slots; at a similarity of 0.8 more do with a probability of
#: 2e-10, so that a link is missed with one of 4e-8 in all.
FARTHEST = 46
SMALL_KEY, BLOCK = 64, 1024
#: A document is first tested with the pivots of this many keys, those with the most holders; the rest is settled later.
PIVOTS = 8
_seeds = np.random.default_rng(20240229)
FACTORS = _seeds.integers(1, 1 << 63, SLOTS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
NO_SET = np.zeros(0, dtype=np.uint64)


def shingles(text: str | None, size: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole sequence where there are fewer words."""
    words = (text or "").encode().lower().split()
    if not words:
        return NO_SET
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ h[k : len(h) - size + 1 + k]) * MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """BITS bits of the minimum of each of SLOTS multiplicative hashes."""
    least = np.full(SLOTS, ~np.uint64(0))
    for a in range(0, len(s), 4096):
        least = np.minimum(least, ((s[a : a + 4096, None] ^ (s[a : a + 4096, None] >> np.uint64(29))) * FACTORS).min(0))
    return ((least * MIX) >> np.uint64(64 - BITS)).astype("<u2")


def keys_of(sigs: np.ndarray) -> np.ndarray:
    """The keys (rows x KEYS) of signatures (rows x SLOTS)."""
    chunks = sigs.reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
    each = (chunks + np.uint64(1)) * (np.arange(1, SLOTS + 1, dtype=np.uint64).reshape(CHUNKS, WIDTH) * MIX | np.uint64(1))
    each = (each ^ (each >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    left = each.sum(2, keepdims=True) - each + np.arange(KEYS, dtype=np.uint64).reshape(CHUNKS, WIDTH) * np.uint64(0x94D049BB133111EB)
    return ((left ^ (left >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)).reshape(len(sigs), -1).view(np.int64)


def signed(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, n (set size), same (digest of the set), sig of each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(t, size) for t in part.column("text").to_pylist()]
                same = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())], ["id", "n", "same", "sig"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n bigint, same binary, sig binary")


def keyed(reps: DataFrame) -> DataFrame:
    """key, rep: a row for each key of each rep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                k = keys_of(np.frombuffer(b"".join(part.column("sig").to_pylist()), dtype="<u2").reshape(-1, SLOTS))
                yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1)), part.column("rep").take(pa.array(np.repeat(np.arange(len(k)), KEYS)))], ["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, f"key bigint, rep {reps.schema['rep'].dataType.simpleString()}")


def sets_of(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """rep, sig, members (the set as bytes) of the documents in reps; sets and signatures are made again, not kept from
    the first pass, as they are as large as the texts and few are needed."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(t, size) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "sig", "members"])

    rows = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(reps, "rep", "left_semi")
    return rows.mapInArrow(run, f"rep {kind}, sig binary, members binary")


def alike(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    """Whether 100 * intersection >= least * union."""
    if 100 * min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= least * (len(x) + len(y) - both)


def joined(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """Pairs a, b with a column of sets for both sides."""
    left = sets.select(F.col("rep").alias("a"), F.col(column).alias("of_a"))
    right = sets.select(F.col("rep").alias("b"), F.col(column).alias("of_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")


def confirmed(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs a, b whose full sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("of_a"), batch.column("of_b"))
            keep = [alike(np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64), least) for x, y in rows]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return joined(pairs, sets, "members").mapInArrow(run, f"a {kind}, b {kind}")


def near_pivots(pairs: DataFrame, sets: DataFrame, farthest: int) -> DataFrame:
    """a, b, far of the pairs whose signatures differ in at most `farthest` slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, SLOTS) for c in ("of_a", "of_b"))
            far = (x != y).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(far, pa.int32())], ["a", "b", "far"]).filter(pa.array(far <= farthest))

    kind = pairs.schema["a"].dataType.simpleString()
    return joined(pairs, sets, "sig").mapInArrow(run, f"a {kind}, b {kind}, far int")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels node, component after the links between nodes, whose ends may lack a label, are added."""
    mine = lambda c: F.coalesce(F.col(f"of_{c}"), F.col(c)).alias(c)
    both = with_labels(links, labels).select(mine("a"), mine("b"))
    higher = components(both).withColumnsRenamed({"node": "old", "component": "new"})
    nodes = labels.join(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "full_outer").select("node", F.coalesce("component", "node").alias("old"))
    return written(nodes.join(higher, "old", "left").select("node", F.coalesce("new", "old").alias("component")), "labels")


def with_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs with of_a and of_b, the components of both ends; an end without a label is its own."""
    for c in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left")
    return pairs.withColumns({f"of_{c}": F.coalesce(f"of_{c}", c) for c in ("a", "b")})


def near_in_group(table: pa.Table, key: int, across: bool, farthest: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of a group in different components whose signatures differ in at most `farthest` slots, for
    which this is the first key that both have. In a group of two blocks, only pairs across."""
    sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype="<u2").reshape(-1, SLOTS)
    keys, comp = keys_of(sigs), np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
    block = table.column("block").to_numpy()
    one, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in range(len(sigs) - 1):
        y = np.arange(x + 1, len(sigs))
        y = y[(comp[y] != comp[x]) & ((block[y] != block[x]) if across else True)]
        y = y[(sigs[y] != sigs[x]).sum(1) <= farthest]
        if len(y):
            y = y[keys[x][(keys[y] == keys[x]).argmax(1)] == key]
            one.append(np.full(len(y), x))
            other.append(y)
    return np.concatenate(one), np.concatenate(other)


def cross_links(groups: DataFrame, sets: DataFrame, farthest: int, least: int) -> DataFrame:
    """Links a, b between holders of a key (groups: key, i, j, rep, component, block) in different components. First by
    signatures alone: who has a candidate. Then those meet with their full sets, and a pair is compared, in the task,
    unless links found before have joined its components. So rows are made for documents and links, never for pairs."""
    kind = groups.schema["rep"].dataType.simpleString()
    fields = "key bigint, i int, j int, rep {0}, component {0}, block int".format(kind)

    def having(key, table):
        one, other = near_in_group(table, key[0].as_py(), key[1].as_py() != key[2].as_py(), farthest)
        return table.take(pa.array(np.union1d(one, other))).select(["key", "i", "j", "rep", "component", "block"])

    def compared(key, table):
        one, other = near_in_group(table, key[0].as_py(), key[1].as_py() != key[2].as_py(), farthest)
        members, rep = table.column("members"), table.column("rep").combine_chunks()
        top = list(range(len(table)))
        for same in np.split(np.argsort(comp := np.unique(table.column("component").to_numpy(), return_inverse=True)[1], kind="stable"), np.cumsum(np.bincount(comp))[:-1]):
            for x in same.tolist():
                top[x] = int(same[0])

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        found: dict[int, np.ndarray] = {}

        def set_of(x: int) -> np.ndarray:
            if x not in found:
                found[x] = np.frombuffer(members[x].as_py(), dtype=np.uint64)
            return found[x]

        a, b = [], []
        for x, y in zip(one.tolist(), other.tolist()):
            if root(x) != root(y) and alike(set_of(x), set_of(y), least):
                top[root(y)] = root(x)
                a.append(x)
                b.append(y)
        return pa.table({"a": rep.take(pa.array(a, pa.int64())), "b": rep.take(pa.array(b, pa.int64()))})

    some = groups.join(sets.select("rep", "sig"), "rep").groupBy("key", "i", "j").applyInArrow(having, fields)
    some = written(some, "candidates")
    return some.join(sets.select("rep", "sig", "members"), "rep").groupBy("key", "i", "j").applyInArrow(compared, f"a {kind}, b {kind}")


def outside_links(tests: DataFrame, labels: DataFrame, sets: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """Links a, b between outsiders and a component: tests holds outsider, component. Both sides are dealt into blocks
    of about `block`, so that no task holds a component, and a row is made only for a link."""
    asked = tests.groupBy("component").agg(F.count("*").alias("n_out"))
    sized = labels.join(asked, "component").groupBy("component").agg(F.count("*").alias("n"), F.first("n_out").alias("n_out"))
    sized = sized.select("component", F.ceil(F.col("n") / block).cast("int").alias("rows"), F.ceil(F.col("n_out") / block).cast("int").alias("cols"))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside = labels.join(sized, "component").select("component", F.col("node").alias("rep"), part("node", "rows").alias("row"), every("cols").alias("col"), F.lit(False).alias("out"))
    outside = tests.join(sized, "component").select("component", F.col("outsider").alias("rep"), every("rows").alias("row"), part("outsider", "cols").alias("col"), F.lit(True).alias("out"))
    rows = inside.union(outside).join(sets.select("rep", "members"), "rep")
    kind = labels.schema["node"].dataType.simpleString()

    def run(key, table):
        rep, out = table.column("rep").to_pylist(), table.column("out").to_pylist()
        found = [np.frombuffer(m.as_py(), dtype=np.uint64) for m in table.column("members")]
        within = [i for i, o in enumerate(out) if not o]
        a, b = [], []
        if within:
            every, sizes = np.concatenate([found[i] for i in within]), np.array([len(found[i]) for i in within])
            owner = np.repeat(np.arange(len(within)), sizes)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            for x in (i for i, o in enumerate(out) if o):
                lo, hi = np.searchsorted(every, found[x]), np.searchsorted(every, found[x], side="right")
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange((hi - lo).sum())
                both = np.bincount(owner[at], minlength=len(within))
                for k in np.flatnonzero(100 * both >= least * (sizes + len(found[x]) - both))[:1].tolist():  # one link joins the component
                    a.append(rep[x])
                    b.append(rep[within[k]])
        return pa.table({"a": pa.array(a, table.schema.field("rep").type), "b": pa.array(b, table.schema.field("rep").type)})

    return rows.groupBy("component", "row", "col").applyInArrow(run, f"a {kind}, b {kind}")


def same_id_links(every: DataFrame, reps: DataFrame) -> DataFrame:
    """Links a, b between the sets of rows that repeat an id: each of its sets with the least of them."""
    of_id = every.where("n > 0 and id is not null").select("id", "same").join(reps.select("same", "rep"), "same").select("id", "rep")
    several = of_id.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b < most").select("id", "b")
    return of_id.join(several, "id").where("rep > b").select(F.col("rep").alias("a"), "b").distinct()


def linked(docs: DataFrame, size: int = 2, least: int = 80, id_col: str = "doc_id", text_col: str = "text", small_key: int = SMALL_KEY, block: int = BLOCK) -> DataFrame:
    """id, n_shingles long (set size), component_id (the least id reachable by links, itself included) and kept boolean
    (the id is its component's) of each row of docs.

    A document's set holds its distinct shingles of `size` words (A-Z lower-cased, cut at ASCII white space), or its
    whole sequence where it has fewer; documents whose sets have 100 * intersection >= least * union are linked. Null
    and empty texts, and texts without words, have no set and no link. Rows that repeat an id are one document that each
    of its texts links, and have one component; n_shingles is the row's own. A null id has no link, a null component_id,
    and is kept. Extra columns are ignored.

    small_key: holders of a key that are always compared with each other; block: rows of a side that a task compares at
    a time. Neither changes the result.
    """
    every = written(signed(docs, id_col, text_col, size), "signed")
    reps = written(every.where("n > 0 and id is not null").groupBy("same").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "reps")
    keys = keyed(reps)
    several = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("holders")).where("holders > 1")
    held = written(keys.join(several, "key"), "keys")
    sets = written(sets_of(docs, held.select("rep").distinct(), id_col, text_col, size), "sets")
    stars = held.where("rep <> pivot").groupBy(F.col("rep").alias("a"), F.col("pivot").alias("b")).agg(F.max("holders").alias("holders"))
    stars = stars.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("holders"), "b"))).where(F.col("rn") <= PIVOTS)
    stars = written(near_pivots(stars.select("a", "b"), sets, FARTHEST), "pairs")

    nearest = stars.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy("far", "b"))).where("rn = 1").select("a", "b")
    links = written(confirmed(nearest, sets, least), "links")
    labels = written(components(links), "labels")
    links = written(confirmed(with_labels(stars, labels).where("of_a <> of_b").select("a", "b"), sets, least), "links")
    labels = relabelled(labels, links)

    mixed = held.join(labels, held.rep == labels.node, "left").select("key", "rep", "holders", F.coalesce("component", "rep").alias("component"))
    counts = mixed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mains = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
    mains = mains.select("key", F.when(F.col("most") > 1, F.col("main")).alias("main"))  # where all are alone, none is the main one
    mixed = written(mixed.join(mains, "key"), "mixed")
    outside = (F.col("holders") > small_key) & F.col("main").isNotNull()
    loose = mixed.where(~outside | (F.col("component") != F.col("main")))
    sized = loose.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    loose = loose.join(sized, "key").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    loose = loose.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "rep", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    tests = mixed.where(outside & (F.col("component") != F.col("main"))).select(F.col("rep").alias("outsider"), F.col("main").alias("component")).distinct()
    links = written(cross_links(loose, sets, FARTHEST, least).union(same_id_links(every, reps)).union(outside_links(written(tests, "tests"), labels, sets, least, block)), "links")
    labels = relabelled(labels, links)

    nodes = every.join(reps.select("same", "rep"), "same", "left").join(labels, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return nodes.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
