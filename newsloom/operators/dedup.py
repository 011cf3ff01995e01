"""Duplicate articles: exact texts, near titles and near vectors within a time window, and one representative each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import title_key
from ..storage import written
from .components import components
from .vector_links import spanning


def same_text(rows: DataFrame, text: str = "body", id_col: str = "id") -> DataFrame:
    """digest, n, first of each text that several rows have."""
    return rows.groupBy(F.sha2(text, 256).alias("digest")).agg(F.count("*").alias("n"), F.min(id_col).alias("first")).where("n > 1")


#: Grams of more keys than one in so many are frequent, and how many of these, the most frequent, are told apart.
FREQUENT, TOLD = 1000, 200_000
#: Characters whose grams are in memory at once.
CHARACTERS = 1 << 20
#: Rows of one title and day that are a block, and pairs of rows that a task makes, about.
BLOCK, PAIRS = 512, 1_000_000


def grams(key: str, n: int = 3) -> np.ndarray:
    """A text's distinct n-grams of code points as numbers, sorted: exact for n up to 3, hashes beyond. A shorter text is
    one gram."""
    c = np.frombuffer(key.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    c = np.pad(c, (0, max(0, n - len(c))))
    out = np.zeros(len(c) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = (out << np.uint64(21) | c[k : k + len(out)]) if n <= 3 else out * np.uint64(0x100000001B3) + c[k : k + len(out)]
    return np.unique(out)


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    start, size = 0, 0
    for i, length in enumerate(pc.utf8_length(batch.column(column)).to_pylist(), 1):
        size += length or 0
        if size >= CHARACTERS or i == batch.num_rows:
            yield batch.slice(start, i - start)
            start, size = i, 0


def frequent_grams(keys: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams that many keys have, sorted, and how many do. They tell little, so that whoever orders grams puts them last."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "key"):
                gram, count = np.unique(np.concatenate([grams(x, n) for x in part.column("key").to_pylist()]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(count)], ["gram", "n"])

    total = keys.select("key").mapInArrow(counted, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    found = total.where(F.col("n") > keys.count() / FREQUENT).orderBy(F.desc("n"), "gram").limit(TOLD).toArrow()
    gram, count = found.column("gram").to_numpy().astype(np.uint64), found.column("n").to_numpy()
    order = np.argsort(gram)
    return gram[order], count[order]


def bands(least: float, most: int) -> np.ndarray:
    """The largest size of each band: of two sets at least `least` alike, the larger one's size falls in the band of the
    smaller one's, or in the next."""
    ends = [1]
    while ends[-1] < most:
        ends.append(int(np.floor((ends[-1] + 1) / least + 1e-9)))
    return np.array(ends)


def signatures(g: np.ndarray, rank: np.ndarray, level: int, end: int, least: float) -> np.ndarray:
    """A hash of each part of a set of grams, for sets of at most `end` grams. rank: what deals the grams to parts.

    Two such sets differ in at most 2 end (1 - least) / (1 + least) grams, and there is a part more than that, so one part
    at least is equal in both."""
    parts = int(np.floor(2 * end * (1 - least) / (1 + least) + 1e-9)) + 1
    out = (np.uint64(level) << np.uint64(40)) + np.arange(1, parts + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    np.add.at(out, (rank % np.uint64(parts)).astype(np.int64), _mixed(g))
    return _mixed(out).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def alike_keys(keys: DataFrame, rows: DataFrame, least: float, days: int, n: int = 3) -> DataFrame:
    """ka, kb, similarity of the keys (key, k: its number), ka <> kb, each pair once, whose n-gram sets have at least
    `least` in common and some of whose days (rows: k, day) are within `days`; and not only these: whoever uses them looks
    at days.

    Sets so much alike differ in few grams, so of as many parts and one more, one is equal in both: keys meet by hashes of
    whole parts (some nine grams at 0.9, fewer at less) in a slot of days. The frequent grams are dealt in turn, so that
    every part tells keys apart. A key has the parts of its own band of sizes and of the next; what shares one is compared
    whole."""
    width = 8 * max(days, 1)
    slot = lambda shift: F.floor((F.datediff("day", F.lit("1970-01-01").cast("date")) + shift) / width)
    often = keys.sparkSession.sparkContext.broadcast(frequent_grams(keys, n))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = often.value
        turn = np.empty(len(known), dtype=np.uint64)
        turn[np.argsort(-count, kind="stable")] = np.arange(len(known), dtype=np.uint64)
        ends = bands(least, 1)
        for batch in batches:
            for part in _parts(batch, "key"):
                own, following = [], []
                for key in part.column("key").to_pylist():
                    g = grams(key, n)
                    rank = _mixed(g + np.uint64(1)) >> np.uint64(1)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                        rank = np.where(known[at] == g, turn[at], rank)
                    if ends[-1] < 2 * len(g):
                        ends = bands(least, 4 * len(g))
                    level = int(np.searchsorted(ends, len(g)))
                    own.append(signatures(g, rank, level, int(ends[level]), least))
                    following.append(signatures(g, rank, level + 1, int(bands(least, int(ends[level]) + 1)[level + 1]), least))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x))) for x in (own, following)]
                yield pa.RecordBatch.from_arrays([part.column("k"), *lists], ["k", "own", "following"])

    made = written(keys.select("key", "k").mapInArrow(signed, "k bigint, own array<bigint>, following array<bigint>"), "title-parts")
    placed = lambda name, slots, parts: _sorted(["k"], made, rows.select("k", slots.alias("slot")).distinct()).select("slot", F.col("k").alias(name), F.explode(parts).alias("part"))
    one, other = placed("kb", F.explode(F.array_distinct(F.array(slot(-days), slot(0), slot(days)))), F.col("own")), placed("ka", slot(0), F.concat("own", "following"))
    pairs = _sorted(["part", "slot"], one, other).where("ka <> kb").select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb")).distinct()
    side = lambda name: keys.select(F.col("k").alias(f"k{name}"), F.col("key").alias(name))
    found = _sorted(["kb"], _sorted(["ka"], pairs, side("a")), side("b"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "a"):
                likes, last = [], ("", np.zeros(0))
                for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist()):
                    last = last if last[0] == b else (b, grams(b, n))
                    g = grams(a, n)
                    both = len(np.intersect1d(last[1], g, assume_unique=True))
                    likes.append(both / (len(last[1]) + len(g) - both))
                yield pa.RecordBatch.from_arrays([part.column("ka"), part.column("kb"), pa.array(likes, pa.float64())], ["ka", "kb", "similarity"])

    return found.select("ka", "kb", "a", "b").mapInArrow(compared, "ka bigint, kb bigint, similarity double").where(F.col("similarity") >= least)


def _sorted(on: list[str], left: DataFrame, right: DataFrame) -> DataFrame:
    """left joined with right by sorting both. A table's size on disk says little of what it is in memory, or of what is made
    of it, so none is sent whole to every executor."""
    return left.hint("merge").join(right.hint("merge"), on)


def _keyed(rows: DataFrame, title: str, day: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """key, k of each distinct key of titles, k being its number; and id, day, k of each row that has one."""
    some = F.col(title).isNotNull() & F.col(day).isNotNull() & F.col(id_col).isNotNull()  # of the key it would be made twice
    keyed = rows.where(some).select(F.col(id_col).alias("id"), F.col(day).alias("day"), title_key(F.col(title)).alias("key"))
    keyed = written(keyed, "title-keys")
    keys = written(keyed.select("key").distinct().withColumn("k", F.monotonically_increasing_id()), "title-numbers")
    return keys, written(keyed.join(keys, "key").select("id", "day", "k"), "title-rows")


def _near_days(rows: DataFrame, days: int) -> DataFrame:
    """kb, db, and what else the rows (k, day) have, for each day that is within `days` of theirs."""
    around = F.explode(F.sequence(F.date_sub("day", days), F.date_add("day", days)))
    return rows.withColumn("da", around).withColumnRenamed("k", "kb").drop("day")


def _blocks(rows: DataFrame) -> DataFrame:
    """k, day, part, ids: the rows of a title and day, dealt by hash to blocks of some BLOCK."""
    parts = rows.groupBy("k", "day").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = _sorted(["k", "day"], rows, parts).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    return dealt.groupBy("k", "day", "part").agg(F.collect_list("id").alias("ids"))


def near_titles(rows: DataFrame, least: float, days: int, title: str = "title", day: str = "day", id_col: str = "id", n: int = 3) -> DataFrame:
    """a, b, similarity of titles whose n-gram sets have at least `least` in common within `days`; null titles have none.

    The pairs of copies grow with the square of their number, so they are made last, in place: blocks of rows meet, and the
    pairs of blocks are dealt to as many tasks as their pairs of rows ask for. Nothing is sorted or sent by pairs of rows."""
    keys, rows = _keyed(rows, title, day, id_col)
    itself = keys.select(F.col("k").alias("ka"), F.col("k").alias("kb"), F.lit(1.0).alias("similarity"))
    alike = written(alike_keys(keys, rows, least, days, n).unionByName(itself), "title-alike")
    blocks = written(_blocks(rows), "title-blocks")
    counts = rows.groupBy("k", "day").agg(F.count("*").alias("n"))
    x, y = counts.select(F.col("k").alias("ka"), F.col("day").alias("da"), F.col("n").alias("x")), _near_days(counts.withColumnRenamed("n", "y"), days)
    total = _sorted(["kb", "da"], _sorted(["ka"], alike, x), y).agg(F.sum(F.col("x").cast("double") * F.col("y"))).first()[0] or 0
    x = blocks.select(F.col("k").alias("ka"), F.col("day").alias("da"), F.col("part").alias("pa"), F.col("ids").alias("xs"))
    y = _near_days(blocks.select("k", "day", F.col("day").alias("db"), F.col("part").alias("pb"), F.col("ids").alias("ys")), days)
    both = _sorted(["kb", "da"], _sorted(["ka"], alike, x), y)
    same = (F.col("ka") == F.col("kb")) & (F.col("da") == F.col("db")) & (F.col("pa") == F.col("pb"))
    # blocks of one title meet once, and a row without copies in its block meets nothing there
    both = both.where((F.col("ka") != F.col("kb")) | (F.struct("da", "pa") <= F.struct("db", "pb"))).where(~same | (F.size("xs") > 1))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(total / PAIRS) + 1)
    dealt = both.withColumn("same", same).repartition(tasks, "ka", "da", "pa", "kb", "db", "pb")
    pairs = dealt.select("similarity", "same", "ys", F.explode("xs").alias("i")).select("similarity", "same", "i", F.explode("ys").alias("j"))
    pairs = pairs.where((F.col("i") != F.col("j")) & (~F.col("same") | (F.col("i") < F.col("j"))))
    return pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "similarity")


def title_links(rows: DataFrame, least: float, days: int, title: str = "title", day: str = "day", id_col: str = "id", n: int = 3) -> DataFrame:
    """a, b: links whose components are those of near_titles(), without its pairs between copies. Rows of one title and
    day are one node, named by its least id, to which each links; a title's nodes link to the next day's within reach, and
    nodes of alike titles to each other."""
    keys, rows = _keyed(rows, title, day, id_col)
    nodes = written(rows.groupBy("k", "day").agg(F.min("id").alias("node")), "title-nodes")
    of_node = rows.join(nodes, ["k", "day"]).where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    before = Window.partitionBy("k").orderBy("day")
    next_days = nodes.withColumn("b", F.lag("node").over(before)).withColumn("gap", F.datediff("day", F.lag("day").over(before))).where(F.col("gap") <= days).select(F.col("node").alias("a"), "b")
    x = nodes.select(F.col("node").alias("a"), F.col("day").alias("da"), F.col("k").alias("ka"))
    y = _near_days(nodes.select(F.col("node").alias("b"), "day", "k"), days)
    between = alike_keys(keys, nodes, least, days, n).join(x, "ka").join(y, ["kb", "da"]).select("a", "b")
    return of_node.unionByName(next_days).unionByName(between)


def same_links(rows: DataFrame, value: Column, id_col: str = "id") -> DataFrame:
    """a, b: each row of a value that several have, with the least of them; null values are like none."""
    keyed = rows.select(F.col(id_col).alias("a"), value.alias("value")).where("value is not null and a is not null")
    several = keyed.groupBy("value").agg(F.min("a").alias("b"), F.max("a").alias("most")).where("b < most").select("value", "b")
    return keyed.join(several, "value").where("a <> b").select("a", "b")


def clusters(rows: DataFrame, links: DataFrame, outlets: DataFrame, url: str = "url", id_col: str = "id") -> DataFrame:
    """rows with grp (the least id that links reach), is_representative, and on representatives the aliases: the group's
    other urls. links: the union of all kinds of links between ids."""
    labels = components(links).select(F.col("node").alias("of"), "component")
    grouped = rows.join(labels, F.col(id_col) == F.col("of"), "left").drop("of").withColumn("grp", F.coalesce("component", id_col)).drop("component")
    one = representatives(grouped, outlets, F.col("grp")).select(F.col("grp").alias("of"), F.col("id").alias("one"))
    marked = grouped.join(one, F.col("grp") == F.col("of"), "left").drop("of").withColumn("is_representative", F.col(id_col) == F.col("one")).drop("one")
    if url not in rows.columns:
        return marked
    others = marked.where(~F.col("is_representative")).groupBy(F.col("grp").alias("of")).agg(F.array_sort(F.collect_set(url)).alias("aliases"))
    return marked.join(others, (F.col("grp") == F.col("of")) & F.col("is_representative"), "left").drop("of").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def residual(rows: DataFrame, linked: DataFrame, similar: DataFrame, most: int, prefilter: float, order: list[Column], id_col: str = "id") -> DataFrame:
    """Which rows of a run get an embedding: those that no exact or title link has settled, that resemble some other row
    by at least `prefilter` (similar: id, similarity), and of these the first `most`."""
    settled = linked.select(F.explode(F.array("a", "b")).alias(id_col)).distinct()
    close = similar.where(F.col("similarity") >= prefilter).select(id_col).distinct()
    return rows.join(settled, id_col, "left_anti").join(close, id_col, "left_semi").orderBy(*order).limit(most)


def _dated(rows: DataFrame, day: str, vector: str, id_col: str) -> DataFrame:
    rows = rows.select(F.col(id_col).alias("id"), F.datediff(day, F.lit("1970-01-01").cast("date")).alias("d"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where("id is not null and d is not null and v is not null")


def _dealt(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows of dated vectors with k, the block of about `size` that they are dealt to by hash, and d, n, k of the blocks."""
    days = rows.groupBy("d").agg(F.ceil(F.count("*") / size).cast("int").alias("n"))
    dealt = rows.join(days, "d").withColumn("k", F.pmod(F.xxhash64("id"), "n").cast("int")).drop("n")
    return dealt, days.select("d", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))


def starred(ids: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The place of the least id that the links i, j between places join with each place."""
    rank = np.empty(len(ids), dtype=np.int64)
    order = pc.sort_indices(ids).to_numpy()
    rank[order] = np.arange(len(ids))
    top = list(range(len(ids)))
    for a, b in zip(rank[i].tolist(), rank[j].tolist()):
        while top[a] != a:
            top[a] = a = top[top[a]]
        while top[b] != b:
            top[b] = b = top[top[b]]
        top[max(a, b)] = min(a, b)
    for a in range(len(top)):  # a top is never above its node
        top[a] = top[top[a]]
    return order[np.array(top, dtype=np.int64)[rank]] if len(ids) else order


def _near_of_blocks(left: DataFrame, right: DataFrame, pairs: DataFrame, least: float, span: bool, same: bool = True, stars: bool = False) -> DataFrame:
    """a, b, similarity of the vectors at least `least` alike of each two blocks of pairs (d, k, d2, k2), a task for each as
    one product of matrices. d, k are a block of left, d2, k2 one of right, and with same of left too. span: only so many of
    them, from each task, as join what all of them join. stars: of these, each vector's link to the least id that they reach
    in the task, whose similarity is null."""
    kind = left.schema["id"].dataType.simpleString()
    pair = F.struct("d", "k", "d2", "k2")
    alone = (F.col("d2") != F.col("d")) | (F.col("k2") != F.col("k")) if same else F.lit(True)
    sides = lambda rows, d, k, side, some: rows.join(some.select(F.col(d).alias("d"), F.col(k).alias("k"), pair.alias("pair")), ["d", "k"]).select("pair.*", F.lit(side).alias("side"), "id", "v")
    both = sides(left, "d", "k", 0, pairs).unionByName(sides(right, "d2", "k2", 1, pairs.where(alone)))

    def alike(key: tuple, table: pa.Table) -> pa.Table:
        d, k, d2, k2 = (x.as_py() for x in key)
        ids, side = table.column("id").combine_chunks(), table.column("side").to_numpy()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).copy()
        norm = np.sqrt((v * v).sum(1))
        v /= np.where(norm > 0, norm, 1)[:, None]
        left, right = (np.flatnonzero((side == k) & (norm > 0)) for k in (0, 1))
        itself = same and (d, k) == (d2, k2)
        right = left if itself else right
        x, y = np.nonzero(v[left] @ v[right].T >= least - 1e-9)
        i, j = left[x], right[y]
        if itself:
            i, j = i[x < y], j[x < y]
        if span:
            sure = np.concatenate([np.zeros(0, bool), *((v[i[n : n + 65536]] * v[j[n : n + 65536]]).sum(1) >= least for n in range(0, len(i), 65536))])
            i, j = i[sure], j[sure]
            first = spanning(len(v), i, j)
            i, j = i[first], j[first]
        if stars:
            of = starred(ids, i, j)
            return pa.table({"a": ids, "b": ids.take(pa.array(of)), "similarity": pa.nulls(len(ids), pa.float64())}).filter(pa.array(of != np.arange(len(of))))
        near = np.concatenate([np.zeros(0), *((v[i[n : n + 65536]] * v[j[n : n + 65536]]).sum(1) for n in range(0, len(i), 65536))])
        p, q = ids.take(pa.array(i)), ids.take(pa.array(j))
        less = pc.less(p, q)
        found = pa.table({"a": pc.if_else(less, p, q), "b": pc.if_else(less, q, p), "similarity": pa.array(near)})
        return found.filter(pc.and_(pc.not_equal(p, q), pa.array(near >= least)))

    return both.groupBy("d", "k", "d2", "k2").applyInArrow(lambda key, t: alike(key, t), f"a {kind}, b {kind}, similarity double")


def near_vectors_within(rows: DataFrame, least: float, days: int, day: str = "day", vector: str = "embedding", id_col: str = "id", size: int = 1024, span: bool = False) -> DataFrame:
    """a, b, similarity of all vectors at least `least` alike and at most `days` apart; null and zero vectors are like none.
    span: only so many of them, from each task, as join what all of them join.

    Exact: a day's vectors are dealt by hash to blocks of about `size`, and each two blocks of days near enough meet in a
    task of their own. Only pairs that reach `least` leave it."""
    dealt, blocks = _dealt(_dated(rows, day, vector, id_col), size)
    other = blocks.select(F.col("d").alias("d2"), F.col("k").alias("k2"))
    ahead = blocks.select("d", "k", F.explode(F.sequence("d", F.col("d") + days)).alias("d2")).join(other, "d2").where("d2 > d or k2 >= k")
    return _near_of_blocks(dealt, dealt, ahead, least, span)


def vector_links(rows: DataFrame, least: float, days: int, day: str = "day", vector: str = "embedding", id_col: str = "id", size: int = 1024) -> DataFrame:
    """a, b: links whose components are those of near_vectors_within(), found without comparing each two vectors.

    First each block meets itself, the next one of its day and one of the next day, which grows with the rows. What these
    links make the largest component is joined already; only the vectors outside it meet all blocks of days near enough.
    So the more vectors are near, the fewer are left for that; where none are, each two are compared."""
    dealt, blocks = _dealt(_dated(rows, day, vector, id_col), size)
    dealt, blocks = written(dealt, "vector-blocks"), written(blocks, "vector-pairs")
    near = blocks.select("d", "k", F.col("d").alias("d2"), F.col("k").alias("k2")).union(blocks.where("n > 1").select("d", "k", "d", F.expr("(k + 1) % n")))
    if days:
        before = blocks.where("k = 0").select(F.explode(F.sequence(F.col("d") - days, F.col("d") - 1)).alias("e"), F.struct("d", "n").alias("x"))
        following = before.groupBy(F.col("e").alias("d")).agg(F.min("x").alias("x")).select("d", F.col("x.d").alias("d2"), F.col("x.n").alias("n2"))
        near = near.union(blocks.join(following, "d").select("d", "k", "d2", F.expr("k % n2")))
    first = written(_near_of_blocks(dealt, dealt, near, least, span=True, stars=True).select("a", "b"), "vector-links")
    groups = written(components(first), "vector-groups")
    top = groups.groupBy("component").count().orderBy(F.desc("count"), "component").first()
    rest = dealt.select("id", "d", "v")
    if top:
        rest = rest.join(groups.where(F.col("component") == top.component).select(F.col("node").alias("id")), "id", "left_anti")
    rest, parts = _dealt(written(rest, "vector-rest"), size)
    other = blocks.select(F.col("d").alias("d2"), F.col("k").alias("k2"))
    all_near = parts.select("d", "k", F.explode(F.sequence(F.col("d") - days, F.col("d") + days)).alias("d2")).join(other, "d2")
    joined = groups.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return joined.unionByName(_near_of_blocks(rest, dealt, all_near.select("d", "k", "d2", "k2"), least, span=True, same=False, stars=True).select("a", "b"))


def representatives(rows: DataFrame, outlets: DataFrame, group: Column) -> DataFrame:
    """One row a group: the lowest tier, then with a body, then the earliest, then the least id; with the group's size."""
    rows = rows.join(outlets, "press", "left").withColumn("grp", group)
    best = F.min_by("id", F.struct(F.coalesce("tier", F.lit(9)), F.coalesce(F.col("body"), F.lit("")) == "", "published_on", "id"))
    return rows.groupBy("grp").agg(best.alias("id"), F.count("*").alias("members"))
