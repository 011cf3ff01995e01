"""Byte-level BPE encoding and decoding.

Pre-tokens are merged with a segment tree over byte positions. A leaf holds `rank << 32 | position` of the pair that
starts there, so the root is the leftmost pair of least rank; a merge rewrites the leaves of the merged position, of its
dead right neighbour and of its live left neighbour, each by a walk to the root. Short pre-tokens of one size class are
merged side by side with numpy, one tree per row; long ones have a tree of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

NONE = 1 << 62
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Pre-tokens of up to this many bytes are merged side by side.
SIDE_BY_SIDE = 64
#: Fewer than this of one size are merged one by one.
FEW = 24
#: Entries that a worker's memo may hold, and the characters that an entry's word may have.
MEMO, MEMO_WORD = 800_000, 64


class Vocabulary:
    """Ranks of a tiktoken file, and every pair of tokens whose bytes together are a token."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.loose = regex.compile(r"\s\s|^\s|\s$").search
        self.tokens = {i: t for t, i in ranks.items()}
        self.whole = {t: i.to_bytes(4, "little") for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.pairs = {(a << 32) | b: i for t, i in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None}
        keys, found = np.fromiter(self.pairs, np.int64, len(self.pairs)), np.fromiter(self.pairs.values(), np.int64, len(self.pairs))
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.slot_key, self.slot_rank = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, NONE, dtype=np.int64)
        slot = ((keys.view(np.uint64) * SPREAD) >> np.uint64(64 - self.bits)).view(np.int64)
        while len(keys):  # the first of those that want a slot gets it, the rest move on
            free = self.slot_key[slot] == -1
            first = np.zeros(len(slot), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            got = free & first
            self.slot_key[slot[got]], self.slot_rank[slot[got]] = keys[got], found[got]
            keys, found, slot = keys[~got], found[~got], slot[~got]
            slot = np.where(self.slot_key[slot] == -1, slot, (slot + 1) & (len(self.slot_key) - 1))
        self.words: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where they don't merge; a negative id stands for no neighbour."""
        key = np.where((left < 0) | (right < 0), -1, (left << 32) | right)
        slot = ((key.view(np.uint64) * SPREAD) >> np.uint64(64 - self.bits)).view(np.int64)
        out, at = np.full(len(key), NONE, dtype=np.int64), np.arange(len(key))
        while len(at):  # linear probing; an empty slot ends the search
            found = self.slot_key[slot]
            hit = found == key
            out[at[hit]] = self.slot_rank[slot[hit]]
            on = ~hit & (found != -1)
            at, key, slot = at[on], key[on], (slot[on] + 1) & (len(self.slot_key) - 1)
        return out

    def merge_one(self, piece: bytes) -> list[int]:
        """The ids of one pre-token, by a segment tree of its own."""
        n = len(piece)
        size = 1 << max(n - 1, 1).bit_length()
        ids = [int(self.byte[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree, pairs = [NONE] * (2 * size), self.pairs

        def leaf(i: int) -> int:
            j = after[i]
            rank = pairs.get((ids[i] << 32) | ids[j]) if j < n else None
            return NONE if rank is None else (rank << 32) | i

        for i in range(n):
            tree[size + i] = leaf(i)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] < NONE:
            rank, i = tree[1] >> 32, tree[1] & 0xFFFFFFFF
            j = after[i]
            ids[i], after[i] = rank, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k, value in ((j, NONE), (i, leaf(i)), *(((before[i], leaf(before[i])),) if before[i] >= 0 else ())):
                k += size
                tree[k] = value
                while k > 1:
                    k >>= 1
                    least = min(tree[2 * k], tree[2 * k + 1])
                    if tree[k] == least:
                        break
                    tree[k] = least
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merge_side_by_side(self, pieces: list[bytes], size: int) -> list[bytes]:
        """The ids of pre-tokens of at most `size` bytes, a segment tree in each row."""
        rows, width = np.arange(len(pieces)), size + 2
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, size)
        n = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width), -1, dtype=np.int64)  # column 0 and the last stand for no neighbour
        ids[:, 1:-1] = np.where(np.arange(size) < n[:, None], self.byte[raw], -1)
        after = np.tile(np.minimum(np.arange(width) + 1, width - 1), (len(pieces), 1))
        before = np.tile(np.maximum(np.arange(width) - 1, 0), (len(pieces), 1))
        tree = np.full((len(pieces), 2 * size), NONE, dtype=np.int64)
        rank = self.pair_ranks(ids[:, 1:-1].ravel(), ids[:, 2:].ravel()).reshape(-1, size)
        tree[:, size:] = np.where(rank < NONE, (rank << 32) | np.arange(size), NONE)
        for k in range(size - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

        def put(r: np.ndarray, i: np.ndarray, value: np.ndarray | int) -> None:
            k = size + i - 1
            tree[r, k] = value
            for _ in range(size.bit_length() - 1):
                k >>= 1
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

        while True:
            root = tree[rows, 1]
            rows, root = rows[root < NONE], root[root < NONE]
            if not len(rows):
                break
            i = (root & 0xFFFFFFFF) + 1
            j = after[rows, i]
            last = after[rows, j]
            ids[rows, i], ids[rows, j] = root >> 32, -1
            after[rows, i] = last
            before[rows, last] = i
            put(rows, j, NONE)
            rank = self.pair_ranks(ids[rows, i], ids[rows, last])
            put(rows, i, np.where(rank < NONE, (rank << 32) | (i - 1), NONE))
            first = before[rows, i]
            r, first, i = rows[first > 0], first[first > 0], i[first > 0]
            rank = self.pair_ranks(ids[r, first], ids[r, i])
            put(r, first, np.where(rank < NONE, (rank << 32) | (first - 1), NONE))
        kept = ids[:, 1:-1]
        live = kept >= 0
        flat, ends = kept[live].astype("<u4").tobytes(), 4 * np.cumsum(live.sum(1))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of each distinct pre-token."""
        out, classes = {}, {}
        for text in pieces:
            p = text.encode()
            if (whole := self.whole.get(p)) is not None:
                out[text] = whole
            elif (n := len(p)) > SIDE_BY_SIDE:
                out[text] = np.array(self.merge_one(p), dtype="<u4").tobytes()
            else:
                names, found = classes.setdefault(1 << max(n - 1, 1).bit_length(), ([], []))
                names.append(text)
                found.append(p)
        for size, (names, found) in classes.items():
            if len(found) < FEW:
                out.update((t, np.array(self.merge_one(p), dtype="<u4").tobytes()) for t, p in zip(names, found))
            else:
                out.update(zip(names, self.merge_side_by_side(found, size)))
        return out

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Where white space stands alone between other characters, every blank starts a pre-token and
        every line feed is one, so such texts are cut there and their words looked up; the rest are cut by the pattern."""
        if len(self.words) > MEMO:
            self.words.clear()
        if len(self.heads) > MEMO:
            self.heads.clear()
        cut: list[tuple[bool, list[str]]] = []
        words, heads = set(), set()
        for t in texts:
            if t and not self.loose(t):
                parts = t.replace("\n", " \n").split(" ")
                heads.add(parts[0])
                words.update(parts[1:])
                cut.append((True, parts))
            else:
                cut.append((False, parts := self.find(t)))
                heads.update(parts)
        new = {w: [" " + w] if w.isalpha() else [" " + w[:-1], w[-1]] if w[-1] in ".," and w[:-1].isalpha() else self.find(w if w[0] == "\n" else " " + w) for w in words.difference(self.words)}
        new_heads = {w: self.find(w) for w in heads.difference(self.heads)}
        pieces = self.encode_pieces({p for of in (new, new_heads) for found in of.values() for p in found})
        for memo, of in ((self.words, new), (self.heads, new_heads)):
            for w, found in of.items():
                memo[w] = pieces[found[0]] if len(found) == 1 else pieces[found[0]] + pieces[found[1]] if len(found) == 2 else b"".join([pieces[p] for p in found])
        word, head = self.words.__getitem__, self.heads.__getitem__
        out = [head(p[0]) + b"".join(map(word, p[1:])) if at_blanks else b"".join(map(head, p)) for at_blanks, p in cut]
        for memo, of in ((self.words, new), (self.heads, new_heads)):  # long words rarely come again, and would fill the memory
            for w in of:
                if len(w) > MEMO_WORD:
                    del memo[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One for each worker."""
    return Vocabulary(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Ids of each text, and what they decode to.

    Returns one row per row of docs: the id column, n_tokens long, ids binary (little-endian unsigned 32-bit integers)
    and, with keep_text, decoded binary (the UTF-8 bytes rebuilt from the ids). A null text counts as empty and has no
    ids; ids may be null or repeated; other columns are ignored. The vocabulary file must be on every machine.
    """
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids", pa.binary())] + [pa.field("decoded", pa.binary())] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = v.encode_texts([t or "" for t in part.column("text").to_pylist()])
                made = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                if keep_text:
                    made.append(pa.array([v.decode(i) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column("id"), *made], schema=pa.schema([part.schema.field("id"), *fields]))

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary" + ", decoded binary" * keep_text)
    return out.withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the decoded bytes."""
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
