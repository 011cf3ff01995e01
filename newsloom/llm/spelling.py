"""Spelling variants: groups of words that lie one edit apart, by a trie self-join.

Words are counted with map-side combining. Two words of which the shorter has m letters and which are one edit apart agree
on their first m // 2 letters or on their last m - m // 2; so a word goes, with its letters in order and reversed, to the
group of its prefix, once for its own length and once as the longer word of a pair. A group holds the words of one prefix;
groups that hold too many are cut again by what follows the prefix, in the same way, which ends where a single letter is
left. Each task lays the words of several groups into one trie and walks it down level by level: every node carries the
active nodes at distance one of it, made from its parent's; where two such nodes end words, a pair comes out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, written

#: Runs of letters, and how words are made from them.
LETTERS = "[A-Za-zÀ-ÿ]+"
THINNED, SHORTEST, RAREST = 97, 5, 3
#: A form occurs at least so many times as often as the word.
TIMES = 2
#: Words that a group may hold before it is cut, and rows that a task walks at once, about.
CROWDED, BUCKET = 4096, 50_000


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """run: a row for each run of letters with A-Z lower-cased; where THINNED divides the crc32 of `<id>:<run>`, the run
    lacks the letter at that crc32 modulo its length. A null id counts as the empty text, a null text has no runs."""
    docs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.translate(text_col, UPPER, LOWER).alias("text"))
    each = docs.select("id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    thinned = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return each.withColumn("h", h).select(F.when(F.col("h") % THINNED == 0, thinned).otherwise(F.col("run")).alias("run"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the runs of at least SHORTEST letters that occur at least RAREST times."""
    found = runs(docs, id_col, text_col).where(F.char_length("run") >= SHORTEST)
    return found.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= RAREST)


def _cut(rows: DataFrame, least: F.Column) -> list[DataFrame]:
    """rows (key, rest, least: letters left in the shorter words of the group) by the first half of what is left, and by the
    second half read backwards."""
    head = F.floor(least / 2).cast("int")
    tail = least - head
    ahead, back = F.col("rest"), F.reverse("rest")
    return [
        rows.select(F.concat("key", F.lit("<"), F.substring(ahead, F.lit(1), head)).alias("key"), F.substring(ahead, head + 1, F.char_length("rest")).alias("rest"), tail.alias("least"), "word", "n"),
        rows.select(F.concat("key", F.lit(">"), F.substring(back, F.lit(1), tail)).alias("key"), F.substring(back, tail + 1, F.char_length("rest")).alias("rest"), head.alias("least"), "word", "n"),
    ]


def prefix_groups(words: DataFrame, shortest: int = SHORTEST, crowded: int = CROWDED) -> DataFrame:
    """key, rest, least, word, n: the groups that words with a common prefix form. Words that are one edit apart meet in one
    group at least; groups of more than `crowded` words are cut while more than one letter is left."""
    size = F.char_length("word")
    pair = F.when(size > shortest, F.array(size, size - 1)).otherwise(F.array(size))
    whole = words.select("word", "n", F.explode(pair).alias("least"), F.col("word").alias("rest"))
    rows = written(reduce(DataFrame.unionByName, _cut(whole.withColumn("key", F.col("least").cast("string")), F.col("least"))), "spelling-groups")
    done = []
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("members"), F.first("least").alias("left"))
        full = written(sizes.where((F.col("members") > crowded) & (F.col("left") > 1)).select("key"), "spelling-crowded")
        if full.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows])
        done.append(rows.join(full, "key", "left_anti").select("key", "rest", "least", "word", "n"))
        rows = written(reduce(DataFrame.unionByName, _cut(rows.join(full, "key", "left_semi"), F.col("least"))), "spelling-groups")


def near_in_tries(group: np.ndarray, rests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), both ways, of words of one group whose rests are one edit apart. Rests are distinct in a group."""
    length = np.array([len(r) for r in rests])
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    letters = np.frombuffer(b"".join(rests), dtype=np.uint8).astype(np.int64)
    # nodes of each level: (parent's place in the level above) * 256 + letter, sorted; and the word that ends there
    at = group.astype(np.int64).copy()
    levels = [np.arange(int(at.max()) + 1)]
    ends = [np.full(len(levels[0]), -1)]
    ends[0][at[length == 0]] = np.flatnonzero(length == 0)
    for depth in range(1, int(length.max()) + 1):
        here = np.flatnonzero(length >= depth)
        nodes, place = np.unique(at[here] * 256 + letters[start[here] + depth - 1], return_inverse=True)
        at[here] = place
        end = np.full(len(nodes), -1)
        last = length[here] == depth
        end[place[last]] = here[last]
        levels.append(nodes)
        ends.append(end)
    levels += [np.zeros(0, np.int64)] * 2
    ends += [np.zeros(0, np.int64)] * 2

    def children(x: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For nodes x: (position in x, child in the level below), for every child."""
        a, b = np.searchsorted(below, x * 256), np.searchsorted(below, x * 256 + 256)
        n = b - a
        which = np.repeat(np.arange(len(x)), n)
        return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)

    def step(x: np.ndarray, y: np.ndarray, below_x: np.ndarray, below_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Active pairs of the children: x and y go down by the same letter."""
        which, child = children(x, below_x)
        wanted = y[which] * 256 + below_x[child] % 256
        found = np.searchsorted(below_y, wanted)
        ok = found < len(below_y)
        ok[ok] = below_y[found[ok]] == wanted[ok]
        return child[ok], found[ok]

    none = np.zeros(0, np.int64)
    replaced, longer = (none, none), children(np.arange(len(levels[0])), levels[1])
    out_i, out_j = [], []
    for depth, nodes in enumerate(levels[:-2]):
        if depth:
            level, below = levels[depth], levels[depth + 1]
            # one letter replaced: siblings, and what the parent's active nodes reach by the node's letter
            which, sibling = children(level // 256, level)
            other = which != sibling
            far = step(*replaced, level, level)
            replaced = (np.concatenate([which[other], far[0]]), np.concatenate([sibling[other], far[1]]))
            # one letter more: children, and the same
            born, far = children(np.arange(len(level)), below), step(*longer, level, below)
            code = np.unique(np.concatenate([born[0], far[0]]) * max(1, len(below)) + np.concatenate([born[1], far[1]]))
            longer = (code // max(1, len(below)), code % max(1, len(below)))
        for (x, y), deep in ((replaced, depth), (longer, depth + 1)):
            i, j = ends[depth][x], ends[deep][y]
            ok = (i >= 0) & (j >= 0)
            out_i += [i[ok]] + ([j[ok]] if deep > depth else [])
            out_j += [j[ok]] + ([i[ok]] if deep > depth else [])
    return np.concatenate(out_i), np.concatenate(out_j)


def near_words(words: DataFrame, shortest: int = SHORTEST, crowded: int = CROWDED, bucket: int = BUCKET) -> DataFrame:
    """word, near, near_n: every two words of the vocabulary (word, n) that differ by one letter inserted, deleted or
    replaced, both ways. Words are of letters up to U+00FF and have at least `shortest` of them."""
    rows = prefix_groups(words, shortest, crowded)
    buckets = max(1, rows.count() // bucket)

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        met = np.flatnonzero(np.bincount(key)[key] > 1)  # a word alone has no partner here
        i = j = np.zeros(0, np.int64)
        if len(met):
            _, group = np.unique(key[met], return_inverse=True)
            rests = [r.encode("latin-1") for r in table.column("rest").take(pa.array(met)).to_pylist()]
            i, j = near_in_tries(group, rests)
            i, j = met[i], met[j]
        word = table.column("word")
        return pa.table({"word": word.take(pa.array(i)), "near": word.take(pa.array(j)), "near_n": table.column("n").take(pa.array(j))})

    found = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInArrow(run, "word string, near string, near_n bigint")
    return found.repartition("word").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the chain of forms (word, form) ends. A form occurs more often than its word, so no chain returns;
    each round doubles the links that a row has followed."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        now = written(now.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every word of the documents with the more frequent spelling one edit away.

    Returns word, n, n_near (words one edit apart), form (of these the most frequent, ties to the first in code-point order,
    if it occurs TIMES times as often, else null), form_n, root (from word, forms followed to the last). Null and empty
    texts have no words, null ids count as the empty text, rows that repeat an id count each; extra columns are ignored; an
    empty table gives no rows.
    """
    words = written(vocabulary(docs, id_col, text_col), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = -F.col("best.less") >= TIMES * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    found = written(found, "spelling-forms")
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
