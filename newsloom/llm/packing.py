"""Packing documents into sequences of a fixed number of tokens, by linear grouping.

Tasks turn texts into pieces (id, start, length, checksum); token ids go no further. What the driver sees is the histogram
of lengths alone, at most one entry a length, whatever the number of documents. From it comes a plan: the larger lengths
are sorted, cut into groups of equally many pieces and rounded up to their group's largest; with the few sizes that are
left, the configurations of a sequence are optimised (a linear programme by column generation); whole multiples of each
configuration are then filled with the groups' true lengths, and everything else goes where it fits best. Sequences with
the same lengths in the same order are one row of the plan, so that the plan is bounded as the histogram is. A piece finds
its sequence by its number among the pieces of its length, counted by buckets.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, written

CAPACITY, END = 2048, 0
#: Which lengths are large, as a share of a sequence, and in how many groups (in the last choice none is, and all are placed
#: by best fit); the plan of fewest sequences is taken, or the first that is so near (a share) to what all tokens need.
CHOICES, NEAR = ((1 / 3, 16), (1 / 8, 16), (1 / 3, 64), (1 / 8, 64), (1 / 3, 256), (1, 1)), 1e-4
#: Pieces that one bucket numbers, about.
BUCKET = 100_000
#: Parts of words that a task remembers the ids of, and the longest of them.
MEMORY, LONGEST = 1 << 20, 48

PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


@cache
def word_ids(path: str):
    """A function from a list of texts to their ids, as bytes of little-endian 32-bit integers each.

    The vocabulary's rules (fixed values of its file) drop white space and never look across it, so that what stands between
    can be encoded apart, each text of it once while it is remembered. Of words in ASCII and plain Latin letters, which
    normalisation leaves alone but for their case, the parts that the rules cut them into are known, and remembered instead:
    there are fewer of these. A word with anything else, or with a mark of special tokens, is encoded whole. A worker keeps
    the function, and what it remembers, for its next task.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer, known = Tokenizer.from_file(path), {}
    lower = "a-zß-öø-ÿ"
    plain = re.compile(f"[\\x09-\\x0D -~{lower}À-ÖØ-Þ]*").fullmatch
    parts = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{lower}]+|[0-9]|[^ \x09-\x0D{lower}0-9]+").findall

    def cut(text: str) -> list[str]:
        if "<|" not in text and plain(text):
            return parts(text.lower())
        out = []
        for word in text.encode().split():
            word = word.decode()
            out += parts(word.lower()) if "<|" not in word and plain(word) else [word]
        return out

    def encode(texts: list[str]) -> list[bytes]:
        if len(known) > MEMORY:
            known.clear()
        every = [cut(t) for t in texts]
        new = list(set().union(*every) - known.keys())
        made = [e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        ids, ends = np.array([i for e in made for i in e], dtype="<u4").tobytes(), np.cumsum([4 * len(e) for e in made]).tolist()
        known.update((w, ids[a:b]) for w, a, b in zip(new, [0, *ends], ends))
        out = [b"".join(map(known.__getitem__, words)) for words in every]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        return out

    return encode


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the pieces of its ids: piece from 0, start, length, and the crc32 of the ids as bytes.

    A document is its text's ids and the id `end`; a null text is empty. Documents longer than `capacity` are cut into
    pieces of that length, of which the last may be shorter.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = word_ids(path), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                at, out = [], []
                for row, ids in enumerate(encode(part.column("text").to_pylist())):
                    ids += last
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[start : start + 4 * capacity]
                        at.append(row)
                        out.append((k, start // 4, len(cut) // 4, zlib.crc32(cut)))
                cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)), *cols], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, schema)


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[list[int], float]]:
    """How often to use which configuration (how many of each size in a sequence) so that the demand is met with the least
    number of sequences, in fractions: a linear programme whose columns are made as they pay."""
    g = len(sizes)
    most = capacity // min(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, dtype=float)
    every = np.arange(capacity + 1)
    shifted = every + max(sizes) - np.array(sizes)[:, None]
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(g))
        # the configuration of greatest worth: value[c] of at most k pieces within c tokens, and the last size taken
        paying = np.flatnonzero(worth > 1e-12)
        value, took = np.zeros(capacity + 1), []
        for _k in range(most):
            with_one = np.concatenate([np.full(max(sizes), -np.inf), value])[shifted[paying]] + worth[paying, None]
            last = with_one.argmax(0)
            best = with_one[last, every]
            better = best > value + 1e-12
            if not better.any():
                break
            took.append(np.where(better, paying[last], -1))
            value = np.where(better, best, value)
        if value[-1] <= 1 + 1e-9:
            break
        column, room = np.zeros(g), capacity
        for last in reversed(took):
            if last[room] >= 0:
                column[last[room]] += 1
                room -= sizes[last[room]]
        use, along = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(along > 1e-9, np.maximum(use, 0) / np.where(along > 1e-9, along, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    use = np.linalg.solve(basis, need)
    return [(basis[:, j].round().astype(int).tolist(), max(0.0, float(use[j]))) for j in range(g)]


class Sequences:
    """Runs of sequences with the same contents, by the room that is left in them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
        self.used = 0

    def put(self, bins: int, holds: list[tuple[int, int]]) -> None:
        if bins:
            room = self.capacity - sum(length * n for length, n in holds)
            self.by_room.setdefault(room, []).append((bins, holds))

    def open(self, bins: int, holds: list[tuple[int, int]]) -> None:
        self.used += bins
        self.put(bins, holds)

    def best_fit(self, length: int, count: int) -> None:
        """Pieces of one length go, one after another, where they leave the least room."""
        while count:
            room = min((r for r in self.by_room if r >= length), default=None)
            if room is None:
                each = min(count, self.capacity // length)
                self.open(count // each, [(length, each)])
                count %= each
                continue
            runs = self.by_room[room]
            bins, holds = runs.pop()
            if not runs:
                del self.by_room[room]
            each = min(count, room // length)
            full = min(bins, count // each)
            self.put(full, [*holds, (length, each)])
            self.put(bins - full, holds)
            count -= full * each


def grouped(counts: dict[int, int], capacity: int, share: float, groups: int) -> Sequences:
    """The sequences that one choice of what is large, and of how many groups, gives."""
    large = [[length, counts[length]] for length in sorted(counts, reverse=True) if share * capacity < length]
    small = {length: n for length, n in counts.items() if length <= share * capacity}
    total = sum(n for _, n in large)
    members: dict[int, list[list[int]]] = {}  # rounded size: lengths and counts, longest first
    left, size = 0, 0
    for length, n in large:
        while n:
            if not left:
                left, size = -(-total // groups), length
            take = min(n, left)
            members.setdefault(size, []).append([length, take])
            n, left = n - take, left - take
    out = Sequences(capacity)
    sizes = list(members)
    if sizes:
        for config, use in configurations(sizes, [sum(n for _, n in members[s]) for s in sizes], capacity):
            bins = min([int(use + 1e-6), *(sum(n for _, n in members[s]) // a for s, a in zip(sizes, config) if a)])
            while bins:
                # sequences in a row that get the same lengths, as long as those last
                same = min([bins, *(members[s][0][1] // a for s, a in zip(sizes, config) if a)]) or 1
                holds = []
                for s, a in zip(sizes, config):
                    while a:
                        n = min(a, members[s][0][1] // same)
                        holds.append((members[s][0][0], n))
                        members[s][0][1] -= n * same
                        a -= n
                        if not members[s][0][1]:
                            members[s].pop(0)
                out.open(same, holds)
                bins -= same
    rest = dict(small)
    for runs in members.values():
        for length, n in runs:
            rest[length] = rest.get(length, 0) + n
    for length in sorted(rest, reverse=True):
        out.best_fit(length, rest[length])
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, end, each, sequence, offset): pieces first <= number < end of a length go to sequences from
    `sequence` on, `each` to one, from `offset` on. counts has how many pieces there are of each length."""
    best, least = None, -(-sum(length * n for length, n in counts.items()) // capacity)
    for share, groups in CHOICES:
        made = grouped(counts, capacity, share, groups)
        best = made if best is None or made.used < best.used else best
        if best.used <= least * (1 + NEAR):
            break
    rows, seen, sequence = [], dict.fromkeys(counts, 0), 0
    for _, runs in sorted(best.by_room.items()):
        for bins, holds in runs:
            offset = 0
            for length, each in holds:
                first = seen[length]
                seen[length] = end = first + bins * each
                rows.append((length, first, end, each, sequence, offset))
                offset += length * each
            sequence += bins
    return rows


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place in a sequence of at most `capacity` tokens.

    Returns doc_id, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long. A null text is
    empty, and an empty one is the end id alone. Null ids stay null; rows that repeat an id are documents of their own;
    pieces of equal length are alike to the plan. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, path, capacity, end, id_col, text_col), "packing-pieces")
    counts = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), sum(counts.values()) // BUCKET)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("bucket", "length").count().select("bucket", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    in_bucket = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    numbered = cut.withColumn("number", F.row_number().over(in_bucket)).join(offsets, ["bucket", "length"])
    numbered = numbered.withColumn("number", F.col("earlier") + F.col("number") - 1)
    places = spark.createDataFrame(plan(counts, capacity) if counts else [], "length bigint, first bigint, until bigint, each bigint, sequence bigint, place bigint")
    # a plan has a few rows a length, of which there are at most `capacity`
    found = numbered.join(F.broadcast(places), ["length"]).where((F.col("number") >= F.col("first")) & (F.col("number") < F.col("until")))
    nth = F.col("number") - F.col("first")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("place") + nth % F.col("each") * F.col("length")).alias("offset"))
