"""Edit-aware token counts.

A text is cut into leaves at pre-token boundaries; a segment tree over the leaves sums their characters and tokens. An
edit descends to the leaves it touches, takes the pre-tokens around it as context, lexes onwards until a new boundary
meets an old one, encodes only those pre-tokens, and updates the sums on the way to the root. The rest of the text is
neither lexed nor encoded again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, vocabulary
from .common import slices

#: Characters in a leaf, about.
LEAF = 256
Edit = tuple[int, int, str]
#: Fixed patterns of what redactions() replaces: mail addresses and long numbers.
REDACTED = re.compile(r"(?P<mail>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)|(?P<number>\+?\(?\d[\d ()-]{7,}\d)")


def redactions(text: str) -> list[Edit]:
    """Edits that mask mail addresses and long numbers; from the end, so that positions hold."""
    found = [(m.start(), m.end(), f"<{m.lastgroup}>") for m in REDACTED.finditer(text)]
    return found[::-1]


class CountedText:
    """A text with its token count, kept up to date under edits."""

    def __init__(self, v: Vocabulary, text: str, counts: Callable[[list[str]], list[int]], leaf: int = LEAF):
        self.v, self.counts, self.leaf, self.reencoded = v, counts, leaf, 0
        self._lay(*self._leaves_of(v.find(text)))

    def _leaves_of(self, pieces: list[str]) -> tuple[list[str], list[int]]:
        """Pre-tokens as leaves of about `leaf` characters, and the tokens of each."""
        sizes, ends = self.counts(pieces), np.cumsum([len(p) for p in pieces])
        cuts = np.flatnonzero(np.diff(ends // self.leaf)) + 1 if pieces else np.zeros(0, int)
        at = [0, *cuts.tolist(), len(pieces)]
        return ["".join(pieces[a:b]) for a, b in zip(at, at[1:])], [sum(sizes[a:b]) for a, b in zip(at, at[1:])]

    def _lay(self, leaves: list[str], tokens: list[int]) -> None:
        """The tree over these leaves; nothing is lexed or encoded."""
        self.leaves = leaves
        self.size = 1 << max(len(leaves) - 1, 0).bit_length()
        spare = [0] * (self.size - len(leaves))
        self.chars, self.tokens = [0] * self.size + list(map(len, leaves)) + spare, [0] * self.size + tokens + spare
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        k = leaf + self.size
        self.chars[k], self.tokens[k] = len(text), tokens
        while k > 1:
            k >>= 1
            self._sum(k)

    def _leaf_of(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character at the position, and where the leaf starts."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if position - start >= self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return min(k - self.size, len(self.leaves) - 1), start

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def replace(self, start: int, end: int, new: str) -> None:
        """Replaces the characters [start, end); positions beyond the text are clipped."""
        total = self.chars[1]
        start = min(max(start, 0), total)
        end = min(max(end, start), total)
        if not total:
            pieces = self.v.find(new)
            self.reencoded += len(pieces)
            self._lay(*self._leaves_of(pieces))
            return
        first, at = self._leaf_of(max(start - 1, 0))
        stop = self._leaf_of(max(end - 1, 0))[0] + 1
        context = self._region(first, stop)[: start - at]
        blank, size = not context.strip(), len(context)
        while first > 0 and (blank or size <= 3):
            first -= 1
            at -= len(self.leaves[first])
            blank, size = blank and (not self.leaves[first] or self.leaves[first].isspace()), size + len(self.leaves[first])
        shift, step = len(new) - (end - start), 1
        while True:
            region, tail = self._region(first, stop), self._tail(stop)
            old, pieces = self.v.find(region + tail), self.v.find(region[: start - at] + new + region[end - at :] + tail)
            ends = np.cumsum([0, *map(len, pieces)])
            if not tail or self._meets(region + tail, old, ends - shift, end - at, len(region)):
                break
            stop, step = min(stop + step, len(self.leaves)), 2 * step  # so that long runs of white space are lexed a few times alone
        pieces = pieces[: int(np.searchsorted(ends, len(region) + shift))]
        self.reencoded += len(pieces)
        if len(region) + shift > 4 * self.leaf * (stop - first):  # too long for these leaves
            leaves, tokens = self._leaves_of(pieces)
            counted = self.tokens[self.size : self.size + len(self.leaves)]
            self._lay(self.leaves[:first] + leaves + self.leaves[stop:], counted[:first] + tokens + counted[stop:])
            return
        share = max(1, -(-len(pieces) // (stop - first)))
        sizes = self.counts(pieces)
        for k in range(first, stop):
            part = slice((k - first) * share, (k - first + 1) * share)
            self._put(k, "".join(pieces[part]), sum(sizes[part]))

    def _region(self, first: int, stop: int) -> str:
        return "".join(self.leaves[first:stop])

    @staticmethod
    def _rests(text: str) -> bool:
        """Whether a boundary before this text stands whatever follows the text: the pattern looks at most to the first
        character after a run of white space, or three characters on."""
        return len(text) > 3 and not text.isspace()

    def _tail(self, stop: int) -> str:
        """What follows the leaves, until it rests or the text ends."""
        out, blank, size = [], True, 0
        while stop < len(self.leaves) and (blank or size <= 3):
            out.append(self.leaves[stop])
            blank, size = blank and (not out[-1] or out[-1].isspace()), size + len(out[-1])
            stop += 1
        return "".join(out)

    def _meets(self, text: str, old: list[str], new_ends: np.ndarray, end: int, length: int) -> bool:
        """Whether the new lexing meets the old one: a boundary in the unchanged rest of the region that both have and
        that stands whatever follows. From there on, both go the same way."""
        ends = {0, *np.cumsum([len(p) for p in old]).tolist()}
        return any(was in ends and self._rests(text[was:]) for was in new_ends[(new_ends >= end) & (new_ends <= length)].tolist())


def counter(v: Vocabulary) -> Callable[[list[str]], list[int]]:
    """Token counts of pre-tokens, by the vocabulary's memo."""

    def counts(pieces: list[str]) -> list[int]:
        if new := set(pieces).difference(v.heads):
            v.heads.update(v.encode_pieces(new))
        return [len(v.heads[p]) >> 2 for p in pieces]

    return counts


def edited_counts(docs: DataFrame, path: str, pattern: str, propose: Callable[[str], list[Edit]] = redactions, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of each text before and after the edits that propose(text) gives, each (start, end, new text) in
    code points of the text as the edits before it have left it.

    Returns one row per row of docs: the id column, n_tokens, n_edits, n_reencoded (pre-tokens encoded again),
    n_tokens_edited, all long, and edited string. A null text counts as empty; edits beyond a text are clipped; ids may
    be null or repeated; other columns are ignored. The vocabulary file must be on every machine.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_tokens", "n_edits", "n_reencoded", "n_tokens_edited"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        counts = counter(v)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                proposed = [propose(t) for t in texts]
                plain = iter(v.encode_texts([t for t, edits in zip(texts, proposed) if not edits]))
                rows, edited = [], []
                for text, edits in zip(texts, proposed):
                    if not edits:
                        n = len(next(plain)) >> 2
                        rows.append((n, 0, 0, n))
                        edited.append(text)
                        continue
                    tree = CountedText(v, text, counts)
                    n = tree.n_tokens
                    for start, end, new in edits:
                        tree.replace(start, end, new)
                    rows.append((n, len(edits), tree.reencoded, tree.n_tokens))
                    edited.append(tree.text)
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, pa.int64()) for c in zip(*rows)), pa.array(edited, pa.string())], ["id", *names, "edited"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {', '.join(f'{n} bigint' for n in names)}, edited string").withColumnRenamed("id", id_col)
