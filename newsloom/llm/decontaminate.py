"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items, as sequences of word ids, build one suffix automaton; training words stream through it and
the longest match that ends at each word is tracked. A match as long as the window is a contaminated span. Items come in
blocks of bounded size, one automaton each and one pass over the texts each, so that what is sent out or built at a time
doesn't grow with the benchmark.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: Words of a window, and of a span that is cut from a text that stays.
WINDOW, LONGEST = 13, 50
#: UTF-8 bytes that one block of items may hold; an item of more is a block by itself.
BLOCK_BYTES = 8 << 20
#: Each byte as it counts: digits, a-z (A-Z too) and bytes of other scripts are word bytes, the rest separates.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Automaton:
    """A generalised suffix automaton over items, each a sequence of word ids."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.length, self.link, self.next = [0], [-1], [{}]
        ends: list[tuple[int, int, bool]] = []  # state, item, whether it ends a whole short item
        self.shortest = window
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if not ids:
                continue
            self.shortest = min(self.shortest, len(ids))
            at = 0
            for k, c in enumerate(ids):
                at = self._extend(at, c)
                ends.append((at, item, k == len(ids) - 1 and len(ids) < window))
        self._index(ends)

    def _extend(self, last: int, c: int) -> int:
        length, link, nxt = self.length, self.link, self.next
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int, nxt: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(0)
        self.next.append(nxt)
        return len(self.length) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _index(self, ends: list[tuple[int, int, bool]]) -> None:
        """For each state: which items hold its window (through the links below it), and which whole short items end it."""
        self.items: list[set[int]] = [set() for _ in self.length]
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for state, item, short in ends:
            self.items[state].add(item)
            if short:
                self.short[state].append((self.length[state], item))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for s in reversed(order):  # an occurrence of a state is one of its link; only states that can stand for a window need it
            if self.link[s] > 0 and self.length[self.link[s]] >= self.window:
                self.items[self.link[s]] |= self.items[s]
        for s in order:
            self.short[s] = self.short[s] + self.short[self.link[s]]
        #: the state that holds the suffix of `window` words of a longer match
        self.anchor = [0] * len(self.length)
        for s in order:
            if self.length[s] >= self.window:
                self.anchor[s] = self.anchor[self.link[s]] if self.length[self.link[s]] >= self.window else s

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words, as sorted disjoint [start, end), and the items with occurring windows."""
        if len(words) < self.shortest or not self.vocabulary:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), dtype=np.int64, count=len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        starts, stops = edges[::2], edges[1::2]
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        length, link, nxt = self.length, self.link, self.next
        for a, b in zip(starts.tolist(), stops.tolist()):
            if b - a < self.shortest:
                continue
            state, n = 0, 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):  # i: the end of the match
                while state and c not in nxt[state]:
                    state = link[state]
                    n = length[state]
                if c in nxt[state]:
                    state, n = nxt[state][c], n + 1
                if n >= self.window:
                    found |= self.items[self.anchor[state]]
                    self._add(spans, i - self.window, i)
                if n >= self.shortest:
                    for size, item in self.short[state]:
                        if size <= n:
                            found.add(item)
                            self._add(spans, i - size, i)
        return spans, found

    @staticmethod
    def _add(spans: list[tuple[int, int]], a: int, b: int) -> None:
        while spans and spans[-1][1] >= a:
            a = min(a, spans.pop()[0])
        spans.append((a, b))


#: A worker's latest automaton, by the name of its block.
_machines: dict[str, Automaton] = {}


@dataclass(frozen=True)
class Block:
    """A block of items on its way to the workers, each of which builds its automaton once."""

    name: str
    items: Broadcast
    window: int

    def automaton(self) -> Automaton:
        if self.name not in _machines:
            _machines.clear()
            _machines[self.name] = Automaton(self.items.value, self.window)
        return _machines[self.name]


def item_blocks(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The distinct items in blocks of about half of `block_bytes`, dealt by hash; a block is fetched and sent out when it is
    asked for, and whoever asked takes it back."""
    spark = items.sparkSession
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct().withColumn("key", F.xxhash64("item", "text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // max(1, block_bytes // 2))
    for k in range(n):
        found = [(r.item, r.text) for r in (rows.where(F.pmod("key", F.lit(n)) == k) if n > 1 else rows).select("item", "text").collect()]
        if found:
            yield Block(uuid.uuid4().hex, spark.sparkContext.broadcast(found), window)


SPANS = "spans array<struct<start: bigint, end: bigint>>, items array<string>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def scanned(rows: DataFrame, block: Block | None) -> DataFrame:
    """rows (with a column text) and n_words, spans and items of one block, or of none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                cut = [words_of(t) for t in part.column("text").to_pylist()]
                found = [block.automaton().scan(words) if block else ([], set()) for words in cut]
                made = {
                    "n_words": pa.array([len(w) for w in cut], pa.int64()),
                    "spans": pa.array([[{"start": a, "end": b} for a, b in spans] for spans, _ in found], SPAN),
                    "items": pa.array([sorted(map(str, items)) for _, items in found], pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_arrays([*part.columns, *made.values()], [*part.schema.names, *made])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, n_words bigint, {SPANS}")


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Contaminated spans of each text.

    Returns one row per row of docs: the id column, text, n_words long, spans array<struct<start, end>> (in words,
    disjoint, in order) and items array<string> (ids of the items with occurring windows, sorted as strings). A window
    is `window` consecutive words of an item, or all words of a shorter item. Null texts have no words; null or empty
    items have no window; repeated items count once, repeated ids and rows are kept as they are; other columns are
    ignored.

    A benchmark of one block, the common case, is one pass over the texts. More blocks are as many passes, each with one
    block sent out and one automaton a worker; a pass writes the few rows with hits, which are merged at the end.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = item_blocks(items, window, block_bytes=block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return scanned(rows, first).withColumnsRenamed({"id": id_col, "text": text_col})
    keyed = rows.withColumn("rid", F.xxhash64("id", "text"))
    found = None
    for block in itertools.chain((first, second), blocks):
        some = written(scanned(keyed, block).where(F.size("items") > 0).select("id", "rid", "spans", "items"), "hits")
        found = some if found is None else found.unionByName(some)
        block.items.unpersist()
    found = found.groupBy(F.col("id").alias("of"), F.col("rid").alias("rid_of")).agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    found = found.select("of", "rid_of", joined_spans(F.col("spans")).alias("spans"), "items")
    every = scanned(keyed, None).drop("spans", "items").join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("rid") == F.col("rid_of")), "left")
    nothing = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
    return every.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_words", nothing("spans"), nothing("items"))


def joined_spans(spans: Column) -> Column:
    """Spans, sorted and with those that overlap or touch as one."""
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last.isNotNull() & (s["start"] <= last["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), start, add)


def judged(found: DataFrame, coverage: int = 20) -> DataFrame:
    """Adds n_hit long (hit words) and contaminated boolean: some word is hit, and at least one in `coverage`."""
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.withColumn("n_hit", n).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(coverage) * F.col("n_hit") >= F.col("n_words")))


def uncontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = 20, longest: int = LONGEST, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that aren't contaminated (see judged()); the others go as a whole. What
    stays loses its spans of at least `longest` words from its text."""
    blocks = item_blocks(items, window, block_bytes=block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    names = docs.columns
    if second is None:

        def spans_of(part: pa.RecordBatch) -> list[tuple[int, list[tuple[int, int]]]]:
            cut = [words_of(t) for t in part.column(text_col).to_pylist()]
            return [(len(w), first.automaton().scan(w)[0] if first else []) for w in cut]

        rows = docs
    else:
        found = hits(docs.select(F.xxhash64(text_col).alias("rid"), text_col), items, window, "rid", text_col, block_bytes)
        mark = "found"
        while any(c.startswith(mark) for c in names):  # no column of docs may clash with what is joined
            mark += "_"
        found = found.where(F.size("spans") > 0).select(F.struct("rid", F.col(text_col).alias("text"), "n_words", "spans").alias(mark)).distinct()
        rows = docs.join(found, (F.xxhash64(text_col) == F.col(f"{mark}.rid")) & (F.col(text_col) == F.col(f"{mark}.text")), "left")

        def spans_of(part: pa.RecordBatch) -> list[tuple[int, list[tuple[int, int]]]]:
            return [(x["n_words"], [(s["start"], s["end"]) for s in x["spans"]]) if x else (0, []) for x in part.column(mark).to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                found = spans_of(part)
                n_hit = [sum(b - a for a, b in spans) for _, spans in found]
                keep = [not h or coverage * h < n for h, (n, _) in zip(n_hit, found)]
                long = [[(a, b) for a, b in spans if b - a >= longest] for _, spans in found]
                part = part.select(names)
                if any(k and x for k, x in zip(keep, long)):
                    texts = [clean_text(t, x) if k else t for t, k, x in zip(part.column(text_col).to_pylist(), keep, long)]
                    part = part.set_column(names.index(text_col), text_col, pa.array(texts, part.schema.field(text_col).type))
                yield part.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, docs.schema)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return judged(found).select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def clean_text(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the characters from the first to the last word of each span."""
    if text is None or not spans:
        return text
    raw = text.encode()
    flags = np.frombuffer(raw.translate(WORD_BYTES), dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    starts, stops = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(stops[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def without_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, longest: int = LONGEST, coverage: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' ids and texts without the spans that are too much: all spans of a contaminated text (see judged()), and
    elsewhere the spans of at least `longest` words; cleaned boolean tells which texts changed."""
    rows = judged(hits(docs, items, window, id_col, text_col), coverage)
    cut = F.when(F.col("contaminated"), F.col("spans")).otherwise(F.filter("spans", lambda s: s["end"] - s["start"] >= longest))
    rows = rows.withColumn("cut", cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [clean_text(t, [(s["start"], s["end"]) for s in cut or ()]) for t, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([bool(c) for c in batch.column(2).to_pylist()])], [batch.schema.names[0], text_col, "cleaned"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.select(id_col, text_col, "cut").mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string, cleaned boolean")
