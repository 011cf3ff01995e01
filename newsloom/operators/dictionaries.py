"""Dictionaries as tables: which of their terms a text holds, in one pass whose cost doesn't grow with the terms.

A few terms are literals of one expression. More of them are one automaton (Aho-Corasick), built in each worker from a
broadcast whose size is measured before; it walks a text once, whatever the number of terms. A dictionary beyond the bound
never leaves its table: workers have a filter of fixed size, by which they take from a text what may be a term, and a join
with the terms tells.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from ..storage import written

#: Terms that are literals, and bytes of terms that are one automaton, which takes many times that in driver and workers.
LITERALS, MOST_BYTES = 50, 4 << 20
#: Bits of the filter for each term, and at most (16 MB); and bytes of texts that are hashed at once.
BITS, MOST_BITS, BYTES = 24, 1 << 27, 1 << 19
#: Automata that this worker has built, by the broadcast that they came from.
BUILT: dict = {}


def automaton(terms: list[tuple[int, str]]):
    """None where there are no terms."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, term in terms:
        found.add_word(term, found.get(term, ()) + (i,))
    found.make_automaton()
    return found if terms else None


def held(found, text: str | None) -> list[int]:
    """The ids of the terms that a text holds, each once, in order."""
    return [] if not text or found is None else sorted({i for _, ids in found.iter(text) for i in ids})


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _windows(data: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """A hash of the q bytes from each place on, for q = 1, 2, 4 and so on up to `most`."""
    q, h = 1, _mixed(data.astype(np.uint64) + np.uint64(1))
    while len(h):
        yield q, h
        if 2 * q > most:
            return
        h = _mixed(h[:-q] * np.uint64(0x9E3779B97F4A7C15) + h[q:])
        q *= 2


def _begins(h: np.ndarray, q: int, bits: int) -> np.ndarray:
    """The place in the filter of terms that begin with such q bytes and are shorter than 2 q."""
    return (_mixed(h + np.uint64(q * 0xA24BAED5)) & np.uint64(bits - 1)).astype(np.int64)


def _whole(first: np.ndarray, last: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """A hash of a term, from those of its first and last q bytes, which hold all of it."""
    return _mixed(first * np.uint64(0xC2B2AE3D27D4EB4F) + last + np.asarray(length, np.uint64) * np.uint64(0x165667B19E3779F9))


def _places(g: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (g & np.uint64(bits - 1)).astype(np.int64), ((g >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts one after another, and where each ends; nulls are empty."""
    column = pa.concat_arrays([column.fill_null("").cast(pa.large_string())])
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    ends = _bytes_of(batch.column(column))[1][1:]
    start = 0
    while start < batch.num_rows:
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def filter_of(terms: DataFrame, lengths: list[int], bits: int) -> np.ndarray:
    """A bit for the first half, at least, of each term (column t), and two for the whole of it, made where the terms are."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "t"):
                data, at = _bytes_of(part.column("t"))
                length, found = np.diff(at), []
                for q, h in _windows(data, lengths[-1]):
                    mine = (length >= q) & (length < 2 * q)
                    first, last = h[at[:-1][mine]], h[at[1:][mine] - q]
                    found += [_begins(first, q, bits), *_places(_whole(first, last, length[mine]), bits)]
                at = np.unique(np.concatenate(found))
                word, start = np.unique(at >> 6, return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), start)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "value"])

    words = terms.select("t").mapInArrow(placed, "word bigint, value bigint").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("value").to_numpy()
    return out.view(np.uint8)


def candidates(column: pa.Array, found: np.ndarray, lengths: list[int]) -> list[list[str]]:
    """What of each text may be a term, by the filter: all terms that it holds, and little else, each once."""
    data, at = _bytes_of(column)
    bits = 8 * len(found)
    has = lambda place: (found[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    row, start, size = [], [], []
    for q, h in _windows(data, lengths[-1]):
        mine = [n for n in lengths if q <= n < 2 * q]
        if not mine:
            continue
        p = np.flatnonzero(has(_begins(h, q, bits)))
        of = np.searchsorted(at, p, "right") - 1
        room = at[of + 1] - p
        for n in mine:
            some = room >= n
            x, r = p[some], of[some]
            g = _whole(h[x], h[x + n - q], n)
            one, two = _places(g, bits)
            hit = has(one)
            hit[hit] = has(two[hit])
            row.append(r[hit])
            start.append(x[hit])
            size.append(np.full(int(hit.sum()), n))
    out: list[dict] = [{} for _ in range(len(column))]
    if row:
        row, start, size = (np.concatenate(c) for c in (row, start, size))
        text = data.tobytes()
        for r, s, n in zip(row.tolist(), start.tolist(), size.tolist()):
            out[r][text[s : s + n]] = None
    return [[t for t in (_text(x) for x in some) if t is not None] for some in out]


def _text(x: bytes) -> str | None:
    try:
        return x.decode()
    except UnicodeDecodeError:  # begins or ends within a character, as no term does
        return None


def _joined(rows: DataFrame, terms: DataFrame, size, text_col: str, out: str, keep_text: bool) -> DataFrame:
    terms = written(terms, "terms")
    lengths = sorted(r.n for r in terms.select(F.octet_length("t").alias("n")).distinct().collect())
    bits = min(MOST_BITS, 1 << max(10, int(BITS * size.n).bit_length()))
    sent = rows.sparkSession.sparkContext.broadcast(filter_of(terms, lengths, bits))
    names = [c for c in rows.columns if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, text_col):
                found = candidates(part.column(text_col), sent.value, lengths)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found, pa.list_(pa.string()))], [*names, "may_be"])

    schema = rows.select(*names).schema.add("may_be", ArrayType(StringType()))
    marked = written(rows.mapInArrow(run, schema).withColumn("row_of", F.monotonically_increasing_id()), "may-be")
    each = marked.select("row_of", F.explode("may_be").alias("t"))
    ids = each.hint("merge").join(terms.hint("merge"), "t").groupBy("row_of").agg(F.array_sort(F.collect_set("i")).alias(out))
    done = marked.drop("may_be").hint("merge").join(ids.hint("merge"), "row_of", "left")
    return done.select(*names, F.coalesce(out, F.array().cast("array<bigint>")).alias(out))


def with_terms(rows: DataFrame, terms: DataFrame, text_col: str = "text", out: str = "term_ids", id_col: str = "term_id", term_col: str = "term", literals: int = LITERALS, most_bytes: int = MOST_BYTES, keep_text: bool = True) -> DataFrame:
    """rows with the ids of all terms that the text holds anywhere, as it is written: array<bigint>, each id once, in order.

    terms: id and term; empty and null terms are in no text, terms that repeat count for each of their ids, a null text holds
    none. A column of rows named as the new one is replaced. keep_text: whether the texts are wanted in the result."""
    spark = rows.sparkSession
    terms = terms.select(F.col(id_col).cast("long").alias("i"), F.col(term_col).alias("t")).where((F.coalesce("t", F.lit("")) != "") & F.col("i").isNotNull()).distinct()
    size = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t") + 8), F.lit(0)).alias("bytes")).first()
    rows = rows.drop(out)
    if size.n <= literals:
        every = sorted((r.i, r.t) for r in terms.collect())
        each = [F.when(F.contains(F.coalesce(text_col, F.lit("")), F.lit(t)), F.lit(i).cast("long")) for i, t in every]
        found = F.array_sort(F.array_distinct(F.filter(F.array(*each), lambda i: i.isNotNull()))) if each else F.array().cast("array<bigint>")
        found = rows.withColumn(out, found.cast("array<bigint>"))
        return found if keep_text else found.drop(text_col)
    if size.bytes > most_bytes:
        return _joined(rows, terms, size, text_col, out, keep_text)
    names = [c for c in rows.columns if keep_text or c != text_col]
    sent, key = spark.sparkContext.broadcast([(r.i, r.t) for r in terms.collect()]), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in BUILT:
            BUILT.clear()  # one automaton at a time
            BUILT[key] = automaton(sent.value)
        found = BUILT[key]
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                some = batch.slice(start, 64)
                ids = [held(found, t) for t in some.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), pa.array(ids, pa.list_(pa.int64()))], [*names, out])

    return rows.mapInArrow(run, rows.select(*names).schema.add(out, ArrayType(LongType())))
