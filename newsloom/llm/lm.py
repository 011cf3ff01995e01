"""LM scoring: a causal self-attention model over subword ids, trained in numpy.

The text is modelled as its tokens (A-Z lower-cased words and one end), each word as the subword ids of a blank and the
word. Causal attention runs over the ids of the whole text, each with a vector of its own (the sum of its class's and of
its place's in the class), and gives at each id the class of the next one: of the ids that go on with the word, or of
those that start the next, or the end. So it scores the spelling of each word and what each word starts with, in context.

A word's probability is that of its first id's class (given that the word before is over) and its share of the class: of
the training counts, where a part as large as the class has distinct words (Witten and Bell) is kept for spelling. That
part falls to attention (the product of its ids' classes and shares in these, and of no id going on after the last) and to
the steps between ids in distinct training words. Classes, shares and spellings are distributions each, so the
probabilities of all tokens sum to at most one, unseen words included.

Ids are cut into chunks of CHUNK; windows of two chunks overlap by one, each scores its second, in batches of masked
attention.

Corpus work is Spark's: documents are dealt by hash to blocks of bounded size; each block reports its distinct words and
their training counts, a window over each word sums them, each distinct word is encoded once, and sums and ids go back
to the blocks, so that no table of all words is ever in one place. There texts become codes of two bytes an id, which
is all that training reads, and four bytes a word of what the counts give to it. Training takes every token of every training document: shards, which depend on
the hash alone, train copies that are averaged, once for each half of the documents, so that scores don't depend on how
Spark partitions the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import vocabulary
from .common import fold, slices, written

FOLDS, HELD_OUT = 7, 2
#: Bytes of text in a block, and blocks in a shard of training.
BLOCK_BYTES, SHARD = 16 << 20, 3
CHUNK, DIM, CLASSES, BINS = 16, 16, 192, 16
END, START, PAD, NO_TARGET = CLASSES - 1, CLASSES, CLASSES + 1, 255
#: Classes below FIRST are of ids that start a word, those from there to END of ids that go on with one.
FIRST, FIRST_BINS = 168, 4
#: An id's place in its class is its second code; START and PAD are places of their own. PLACES are the others.
CODES = 256
PLACES = np.delete(np.arange(CODES), [START, PAD])
#: Classes of ids within words, the last ones bins of rare ids; STOP ends a word.
INNER, INNER_BINS = 1024, 64
STOP = INNER
#: Of what a class keeps for spelling, the part of attention; steps between inner classes have the rest.
SPELT = 0.05
#: Chunks at a time: what numpy holds of so many stays in a core's cache.
ROUNDS, BATCH, RATE = 2, 64, 0.02
FAR = np.float32(-1e9)
#: Where malloc gives what is freed back to the system, each batch pays for its pages again, which takes longer than its
#: arithmetic. A freed block of this size makes it keep as much.
KEPT = 30 << 20
#: Words of a block whose ids numpy takes at a time.
PART = 20_000
#: Bytes of a block's texts that are looked up in its words at a time; each time the words are hashed again.
SLICE = 3 << 20


def keep_freed() -> None:
    np.empty(KEPT, dtype=np.uint8)


# --- words and ids -------------------------------------------------------------------------------------------------


def classes_of(counts: np.ndarray, single: int, bins: int) -> np.ndarray:
    """The class of each id: the most counted have their own, the rest share bins, evenly by count and by counted ids."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    rest = order[single:]
    n, of = counts[rest], np.zeros(len(counts), dtype=np.int64)
    mass = np.cumsum(n / max(n.sum(), 1) + (n > 0) / max(np.count_nonzero(n), 1), dtype=np.float64)
    of[order[:single]] = np.arange(min(single, len(counts)))
    of[rest] = single + np.minimum(mass * bins / 2, bins - 1).astype(np.int64)
    return of


def places_of(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The place of each id in its class, the most counted first; ids beyond the PLACES share them."""
    order = np.lexsort((np.arange(len(counts)), -counts, of))
    begins = np.searchsorted(of[order], np.arange(CLASSES))
    place = np.zeros(len(counts), dtype=np.int64)
    place[order] = PLACES[(np.arange(len(order)) - begins[of[order]]) % len(PLACES)]
    return place


@dataclass
class Words:
    """What the training counts say of words: codes of ids, and the shares of classes that words and ids have."""

    first: np.ndarray  # class of each id at a word's start
    going: np.ndarray  # and after it
    places: tuple[np.ndarray, np.ndarray]  # the ids' places in both
    inner: np.ndarray  # class of each id within words
    start: np.ndarray  # log10 share of a first id in its class, of distinct words
    share: np.ndarray  # log10 share of an id in its inner class, of distinct words
    step: np.ndarray  # log10 of the next inner class, or STOP, after an inner class
    tokens: np.ndarray  # of each class of first ids: the training tokens
    kinds: np.ndarray  # and the distinct words, one at least
    prior: np.ndarray  # log of the classes' shares of all ids and ends
    of_places: np.ndarray  # log10 share in its class of an id at a place, of distinct words
    spelt: np.ndarray  # log10 of the part of a class that is kept for spelling by attention

    @staticmethod
    def layout(first: np.ndarray, going: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of first ids, of those after them and of ids within words from the ids' counts."""
        after = END - FIRST - BINS
        return classes_of(first, FIRST - FIRST_BINS, FIRST_BINS), FIRST + classes_of(going, after, BINS), classes_of(every, INNER - INNER_BINS, INNER_BINS)

    @staticmethod
    def of_counts(first: np.ndarray, going: np.ndarray, every: np.ndarray, heads: np.ndarray, steps: np.ndarray, ends: int) -> Words:
        """first, going: counts of first ids and of those after them in training tokens; every, heads: of all ids and of
        first ids in distinct training words; steps: of inner classes after each other there; ends: training documents."""
        a, b, inner = Words.layout(first, going, every)
        log_share = lambda n, of, k: np.log10(n / np.bincount(of, n, k)[of])
        tokens = np.bincount(a, first, CLASSES)
        kinds = np.maximum(np.bincount(a, heads, CLASSES), 1)
        after = steps.sum(0) + 1
        unstepped = 0.5 * (steps > 0).sum(1, keepdims=True) + 0.1
        step = (steps + unstepped * (after / after.sum())) / (steps.sum(1, keepdims=True) + unstepped)
        of_class = tokens + np.bincount(b, going, CLASSES)
        of_class[END] = ends
        prior = np.log((of_class + 1) / (of_class + 1).sum()).astype(np.float32)
        places = places_of(first, a), places_of(going, b)
        mass, ids = np.zeros((2, CLASSES * CODES))
        for of, place, n in ((a, places[0], heads + 0.1), (b, places[1], np.maximum(every - heads, 0) + 0.1)):
            mass += np.bincount(of * CODES + place, n, len(mass))
            ids += np.bincount(of * CODES + place, minlength=len(ids))
        mass = mass.reshape(CLASSES, CODES)
        with np.errstate(divide="ignore", invalid="ignore"):
            of_places = np.log10(mass / mass.sum(1, keepdims=True) / ids.reshape(mass.shape))
        spelt = np.log10(SPELT * kinds / (tokens + kinds))
        return Words(a, b, places, inner, log_share(heads + 0.1, a, CLASSES), log_share(every + 0.2, inner, INNER), np.log10(step).astype(np.float32), tokens, kinds, prior, of_places, spelt)

    def coded(self, ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class of each word's first id, class and place of each id, and the log10 of what counts and steps give to
        the word in that class. ids: of all words, one after another; sizes: how many each has; counts: its training tokens."""
        if not len(sizes):
            return np.zeros(0, np.uint8), np.zeros((0, 2), np.uint8), np.zeros(0)
        stops = np.cumsum(sizes)
        starts = stops - sizes
        head = ids[starts]
        codes = np.stack([self.going[ids], self.places[1][ids]], axis=1).astype(np.uint8)
        codes[starts, 0], codes[starts, 1] = self.first[head], self.places[0][head]
        following = np.append(self.inner[ids[1:]], STOP)
        following[stops - 1] = STOP
        of_next = np.append(self.share[ids[1:]], 0.0)
        of_next[stops - 1] = 0.0
        spelling = self.start[head] + np.add.reduceat(self.step[self.inner[ids], following] + of_next, starts)
        a = self.first[head]
        n, spare = self.tokens[a], self.kinds[a] * (1 - SPELT)
        seen = counts > 0
        share = np.log10(spare) + spelling
        share[seen] = np.log10(counts[seen] + spare[seen] * 10.0 ** spelling[seen])
        return a.astype(np.uint8), codes, share - np.log10(n + self.kinds[a])


# --- the model -----------------------------------------------------------------------------------------------------

#: Of each id: a query, a key, a value and what goes to the output directly, as sums over its class and its place there.
WIDE = 4 * DIM
SHAPES = {"a": (CLASSES + 2, WIDE), "b": (CODES, WIDE), "u": (DIM, CLASSES), "c": (CLASSES,), "d": (2 * CHUNK,)}
Q, K, V, O = (slice(i * DIM, (i + 1) * DIM) for i in range(4))
SCALE = np.float32(DIM**-0.5)
MASK = np.where(np.arange(2 * CHUNK) <= CHUNK + np.arange(CHUNK)[:, None], np.float32(0), FAR)
SEEN = (MASK == 0).astype(np.float32)
CELLS = np.arange(CODES * WIDE).reshape(CODES, WIDE)
DISTANCE = np.clip(CHUNK + np.arange(CHUNK)[:, None] - np.arange(2 * CHUNK), 0, None)


#: Sums as products: of rows of up to so many numbers, and of all classes and those that end a word.
ONES = np.ones(1 << 12, dtype=np.float32)
GROUPS = np.stack([np.ones(CLASSES), (np.arange(CLASSES) < FIRST) | (np.arange(CLASSES) == END)], axis=1).astype(np.float32)


def fresh(prior: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    p = {n: rng.normal(0, 0.1, s).astype(np.float32) for n, s in SHAPES.items()}
    p["c"], p["d"][:] = prior.copy(), 0
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n in SHAPES])


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])
    return {n: part.reshape(s).astype(np.float32, copy=False) for (n, s), part in zip(SHAPES.items(), np.split(x, ends[:-1]))}


def chunked(texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of several texts: both codes of the inputs, the target classes, which chunks open a text, and each text's
    number of chunks. A text's inputs are the start and its ids, its targets the ids and the end."""
    sizes = np.array([len(a) // CHUNK + 1 for a, _ in texts])
    opens = np.cumsum(sizes) - sizes
    n = int(sizes.sum()) * CHUNK
    one, two = np.full(n, PAD, dtype=np.uint8), np.full(n, PAD, dtype=np.uint8)
    target = np.full(n, NO_TARGET, dtype=np.uint8)
    for (a, b), at in zip(texts, (opens * CHUNK).tolist()):
        one[at] = two[at] = START
        stop = at + len(a)
        one[at + 1 : stop + 1], two[at + 1 : stop + 1], target[at:stop], target[stop] = a, b, a, END
    starts = np.zeros(n // CHUNK, dtype=bool)
    starts[opens] = True
    return one.reshape(-1, CHUNK), two.reshape(-1, CHUNK), target.reshape(-1, CHUNK), starts, sizes


def forward(p: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, starts: np.ndarray) -> tuple:
    """Class logits after each input of consecutive chunks, each with the chunk before it as context; a chunk that opens
    a text has none, nor has the first. Also what the gradients take: queries, keys and values, weights, their sums, outputs."""
    n = len(one)
    x = np.take(p["a"], one.ravel(), axis=0)
    x += np.take(p["b"], two.ravel(), axis=0)
    x = x.reshape(n, CHUNK, WIDE)
    q = x[:, :, Q] * SCALE
    kv = np.empty((n, 2 * CHUNK, 2 * DIM), dtype=np.float32)
    kv[:, CHUNK:] = x[:, :, DIM : 3 * DIM]
    kv[0, :CHUNK] = 0
    kv[1:, :CHUNK] = kv[:-1, CHUNK:]
    s = q @ kv[:, :, :DIM].transpose(0, 2, 1)
    s += p["d"][DISTANCE]
    if not (s.max() < 50 and s.min() > -50):  # else single precision holds their exponentials as they are
        s += MASK
        s -= s.max(2, keepdims=True)
    np.exp(s, out=s)
    s *= SEEN
    s[starts, :, :CHUNK] = 0
    s[0, :, :CHUNK] = 0
    sums = (s.reshape(-1, 2 * CHUNK) @ ONES[: 2 * CHUNK]).reshape(n, CHUNK, 1)
    h = s @ kv[:, :, DIM:]
    h /= sums
    h += x[:, :, O]
    logits = h.reshape(-1, DIM) @ p["u"]
    logits += p["c"]
    return logits, (q, kv, s, sums, h)


def exponentials(logits: np.ndarray) -> np.ndarray:
    """In place, up to a factor of each row where they are large."""
    if not (logits.max() < 60 and logits.min() > -60):
        logits -= logits.max(1, keepdims=True)
    return np.exp(logits, out=logits)


def log_positions(p: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, target: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each position: the log probability of its target's class, and of that no id goes on with the word. Without a
    target the first is 0."""
    logits, _ = forward(p, one, two, starts)
    goal = target.ravel()
    real = goal != NO_TARGET
    if not (logits.max() < 60 and logits.min() > -60):
        logits -= logits.max(1, keepdims=True)
    hit = logits[np.arange(len(goal)), np.where(real, goal, 0)]
    np.exp(logits, out=logits)
    every, stop = np.log(logits @ GROUPS).T
    return ((hit - every) * real).reshape(target.shape), (stop - every).reshape(target.shape)


def log_classes(p: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, target: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The log probability of each chunk's targets."""
    return log_positions(p, one, two, target, starts)[0].sum(1, dtype=np.float64)


def by_code(of: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by code."""
    return np.bincount(np.take(CELLS, of, axis=0).ravel(), rows.ravel(), n * WIDE).astype(np.float32).reshape(n, WIDE)


def gradients(p: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, target: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log likelihood of the targets."""
    logits, (q, kv, s, sums, h) = forward(p, one, two, starts)
    s /= sums
    exponentials(logits)
    goal = target.ravel()
    real = goal != NO_TARGET
    weight = real / np.float32(max(real.sum(), 1))
    logits *= (weight / (logits @ ONES[:CLASSES]))[:, None]
    logits[np.arange(len(logits)), np.where(real, goal, 0)] -= weight
    dh = (logits @ p["u"].T).reshape(h.shape)
    ds = dh @ kv[:, :, DIM:].transpose(0, 2, 1)
    ds *= s
    ds -= s * (ds.reshape(-1, 2 * CHUNK) @ ONES[: 2 * CHUNK]).reshape(h.shape[0], CHUNK, 1)
    dk, dv = ds.transpose(0, 2, 1) @ q, s.transpose(0, 2, 1) @ dh
    dk[:-1, CHUNK:] += dk[1:, :CHUNK]
    dv[:-1, CHUNK:] += dv[1:, :CHUNK]
    dx = np.empty((len(one), CHUNK, WIDE), dtype=np.float32)
    np.matmul(ds, kv[:, :, :DIM], out=dx[:, :, Q])
    dx[:, :, Q] *= SCALE
    dx[:, :, K], dx[:, :, V], dx[:, :, O] = dk[:, CHUNK:], dv[:, CHUNK:], dh
    dx = dx.reshape(-1, WIDE)
    return {
        "a": by_code(one.ravel(), dx, CLASSES + 2), "b": by_code(two.ravel(), dx, CODES),
        "u": h.reshape(-1, DIM).T @ logits, "c": ONES[: len(logits)] @ logits if len(logits) <= len(ONES) else logits.sum(0),
        "d": np.bincount(DISTANCE.ravel(), ds.sum(0).ravel(), 2 * CHUNK).astype(np.float32),
    }


def trained_copy(p: dict[str, np.ndarray], texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, dict[str, np.ndarray]]:
    """Parameters after Adam over all chunks of the texts, once and in order, and the number of tokens."""
    keep_freed()
    x = flat(p).astype(np.float32)
    p = unflat(x)  # views of x
    mean, square = np.zeros_like(x), np.zeros_like(x)
    one, two, target, starts, _ = chunked(texts)
    for t, at in enumerate(range(0, len(one), BATCH), 1):
        rate = RATE / (1 + t / 300) ** 0.5 / (1 - 0.9**t)
        g = flat(gradients(p, *(y[at : at + BATCH] for y in (one, two, target, starts))))
        mean += np.float32(0.1) * (g - mean)
        g *= g
        square += np.float32(0.01) * (g - square)
        np.sqrt(square, out=g)
        g *= np.float32((1 - 0.99**t) ** -0.5)
        g += np.float32(1e-8)
        np.divide(mean, g, out=g)
        g *= np.float32(rate)
        x -= g
    return int((target != NO_TARGET).sum()), p


def log_targets(p: dict[str, np.ndarray], texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all targets of the texts, one after another: both codes, the log probabilities of log_positions; and where each text's begin."""
    keep_freed()
    one, two, target, starts, _ = chunked(texts)
    parts = [[x[min(at, 1) :] for x in log_positions(p, *(x[max(at - 1, 0) : at + BATCH] for x in (one, two, target, starts)))] for at in range(0, len(one), BATCH)]
    real = target != NO_TARGET
    goal, going, stop = target[real], *(np.concatenate(x)[real].astype(np.float64) for x in zip(*parts))
    sizes = np.array([len(a) + 1 for a, _ in texts])
    begins = np.cumsum(sizes) - sizes
    place = np.zeros(len(goal), dtype=np.uint8)
    place[np.delete(np.arange(len(goal)), begins + sizes - 1)] = np.concatenate([b for _, b in texts])
    return goal, place, going, stop, begins


def attention_scores(p: dict[str, np.ndarray], texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 of the probability of each text's classes."""
    _, _, going, _, begins = log_targets(p, texts)
    return np.add.reduceat(going, begins) / np.log(10)


def word_scores(p: dict[str, np.ndarray], texts: list[tuple[np.ndarray, np.ndarray]], counted: np.ndarray, of_places: np.ndarray, spelt: np.ndarray) -> np.ndarray:
    """log10 of the probability of each text. counted: of all words of the texts, log10 of what the counts give to the
    word in its class; of_places: log10 of each place's share of a class; spelt: log10 of the part of a class that is
    kept for spelling by attention. A word ends where no id goes on with it, which its spelling counts and the class of
    the next first id, given that, doesn't."""
    goal, place, going, stop, begins = log_targets(p, texts)
    going, stop = going / np.log(10), stop / np.log(10)
    edge = (goal < FIRST) | (goal == END)
    at = np.flatnonzero(edge)  # the first ids of words, and ends
    spelling = np.where(edge, 0.0, going) + np.where(goal == END, 0.0, of_places[goal, place])
    words = goal[at] != END
    of_word = np.add.reduceat(spelling, at)[words] + stop[at[np.flatnonzero(words) + 1]] + spelt[goal[at[words]]]
    high, low = np.maximum(counted, of_word), np.minimum(counted, of_word)
    total = np.where(edge, going - stop, 0.0)
    total[at[words]] += high + np.log1p(10.0 ** (low - high)) / np.log(10)
    return np.add.reduceat(total, begins)


# --- the corpus ----------------------------------------------------------------------------------------------------


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and how many each text has."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null(b"").view(pa.string())))  # cuts as bytes.split() does, but for empty words
    words, of = found.flatten(), pc.list_parent_indices(found)
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full).view(pa.binary()), np.bincount(of.filter(full).to_numpy(), minlength=len(texts))


def block_words(dealt: DataFrame) -> DataFrame:
    """block, word, n of each distinct word of each block; n: its count in the block's training documents. dealt is
    sorted by block within partitions."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, []

        def rows() -> Iterator[pa.RecordBatch]:
            if counts:
                for part in summed(counts).to_batches(max_chunksize=50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, at, dtype=np.int32)), *part.columns], ["block", "word", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                blocks = part.column("block").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
                for a, b in zip(edges, edges[1:]):
                    if a < b and blocks[a] != at:
                        yield from rows()
                        at, counts = int(blocks[a]), []
                    words, sizes = split_words(part.column("text").slice(a, b - a))
                    train = np.repeat(~part.column("held_out").slice(a, b - a).to_numpy(zero_copy_only=False), sizes)
                    counts.append(summed([pa.table({"word": words, "n": pa.array(train.astype(np.int64))})]))
        yield from rows()

    return dealt.select("block", "text", "held_out").mapInArrow(run, "block int, word binary, n bigint")


def ids_of(words: list[bytes], path: str, pattern: str) -> list[bytes]:
    """The ids of a blank and each word. No word comes again, and workers outlive their tasks: none is remembered."""
    v = vocabulary(path, pattern)
    ids = v.encode_texts([" " + w.decode() for w in words])
    v.words.clear()
    v.heads.clear()
    return ids


def encoded(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """words (block, word, c, first), sorted by word within partitions, with ids: each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        for batch in batches:
            names = batch.column("word").to_pylist()
            new = list(dict.fromkeys(names))
            ids = dict(zip(new, ids_of(new, path, pattern)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([ids[w] for w in names], pa.binary())], [*batch.schema.names, "ids"])

    return words.select("block", "word", "c", "first").mapInArrow(run, "block int, word binary, c bigint, first boolean, ids binary")


def ids_and_sizes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    found = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(found):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ends = np.frombuffer(found.buffers()[1], dtype=np.int32, count=len(found) + 1, offset=4 * found.offset)
    return np.frombuffer(found.buffers()[2], dtype="<u4", count=(ends[-1] - ends[0]) // 4, offset=int(ends[0])).astype(np.int64), np.diff(ends).astype(np.int64) // 4


def id_counts(words: DataFrame, size: int) -> list[np.ndarray]:
    """Counts of ids: first ones and those after them, of training tokens; all and first, of distinct training words.
    words: c, ids of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, size), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                ids, sizes = ids_and_sizes(batch.column("ids"))
                starts, c = np.cumsum(sizes) - sizes, batch.column("c").to_numpy()
                for row, of, n in ((0, ids[starts], c), (1, ids, np.repeat(c, sizes)), (2, ids, None), (3, ids[starts], None)):
                    total[row] += np.bincount(of, n, size).astype(np.int64)
        total[1] -= total[0]
        kind, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(at, pa.int32()), pa.array(total[kind, at])], ["kind", "id", "n"])

    found = words.select("c", "ids").mapInArrow(run, "kind int, id int, n bigint").groupBy("kind", "id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((4, size))
    out[found.column("kind").to_numpy(), found.column("id").to_numpy()] = found.column("n").to_numpy()
    return list(out)


def step_counts(words: DataFrame, inner: np.ndarray) -> np.ndarray:
    """Counts of inner classes, or STOP, after inner classes in distinct training words: INNER x (INNER + 1), whatever
    the corpus."""
    of = words.sparkSession.sparkContext.broadcast(inner.astype(np.int16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, total = of.value.astype(np.int64), np.zeros(INNER * (INNER + 1), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                ids, sizes = ids_and_sizes(batch.column("ids"))
                following = np.append(inner[ids[1:]], STOP)
                following[np.cumsum(sizes) - 1] = STOP
                total += np.bincount(inner[ids] * (INNER + 1) + following, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["at", "n"])

    found = words.select("ids").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(INNER * (INNER + 1))
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(INNER, INNER + 1)


def coded_texts(texts: pa.Table, words: pa.Table, shares: Words, n_all: int, v_all: int, n_train: int) -> pa.Table:
    """The texts of a block with what counts give to them, their ids' codes and what counts give to each word. words: the
    block's distinct words. What numpy makes of all ids is made for PART words at a time, and texts take codes by their
    places, so that a task holds little more than its block."""
    parts = []
    for at in range(0, len(words), PART):
        some = words.slice(at, PART)
        ids, sizes = ids_and_sizes(some.column("ids"))
        _, codes_of_ids, share = shares.coded(ids, sizes, some.column("c").to_numpy())
        parts.append((codes_of_ids.view("<u2").ravel(), sizes, share.astype("<f4")))
    codes_of_ids, sizes, share = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, t) for t in ("<u2", np.int64, "<f4"))
    del parts
    sizes = sizes.astype(np.int32)
    begins = np.cumsum(sizes, dtype=np.int32) - sizes
    n_words, names = words.column("c").to_numpy(), words.column("word").combine_chunks()
    log_count, known = np.log10(n_words + 1.0), (n_words > 0).astype(np.float64)
    base, of_end = -np.log10(n_all + v_all + 1.0), np.log10(n_train + 1.0)

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        found, n = split_words(part.column("text"))
        at = pc.index_in(found, value_set=names).to_numpy()
        of_text = np.repeat(np.arange(len(n)), n)
        n_ids = sizes[at]
        of_ids = np.repeat(begins[at] - np.cumsum(n_ids, dtype=np.int32) + n_ids, n_ids)
        of_ids += np.arange(len(of_ids), dtype=np.int32)
        made = {
            "n_tokens": pa.array(n + 1), "n_known": pa.array(np.bincount(of_text, known[at], len(n)).astype(np.int64) + (n_train > 0)),
            "base_score": pa.array(np.bincount(of_text, log_count[at], len(n)) + of_end + (n + 1) * base),
            "codes": rows_of(codes_of_ids[of_ids], np.bincount(of_text, n_ids, len(n))), "counted": rows_of(share[at], n),
        }
        kept = ["block", "rid", "id", "held_out"]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made.values()], [*kept, *made])

    return pa.Table.from_batches([rows(part) for batch in texts.to_batches() for part in slices(batch, "text", SLICE)])


def rows_of(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of so many values each, as binaries."""
    ends = np.append(0, np.cumsum(sizes * values.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def texts_of(table: pa.Table | pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Both codes of each text's ids."""
    return [tuple(np.frombuffer(x, dtype=np.uint8).reshape(-1, 2).T) for x in table.column("codes").to_pylist()]


def trained(coded: DataFrame, prior: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters after training on coded (shard, rid, codes): each round trains a copy on each shard's documents of this
    round and averages the copies."""
    spark = coded.sparkSession
    p = fresh(prior)

    for k in range(rounds):
        now = spark.sparkContext.broadcast(p)

        def run(table: pa.Table) -> pa.Table:
            seen, done = trained_copy(now.value, texts_of(table.sort_by("rid")))
            return pa.table({"seen": pa.array([float(seen)]), "p": pa.array([flat(done).astype(np.float64) * seen], pa.list_(pa.float64()))})

        copies = coded.where(F.pmod(F.shiftright("rid", 40), F.lit(rounds)) == k).groupBy("shard").applyInArrow(run, "seen double, p array<double>")
        sums = copies.select("seen", F.posexplode("p").alias("i", "x"))  # no second Python step: a task would hold two workers
        mean = sums.groupBy("i").agg((F.sum("x") / F.sum("seen")).alias("x")).toArrow()
        if mean.num_rows:
            x = np.zeros(mean.num_rows)
            x[mean.column("i").to_numpy()] = mean.column("x").to_numpy()
            p = unflat(x)
    return p


def score(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    Tokens are the words and one end. base_score: sum of log10((c + 1) / (N + V + 1)) with a token's count c, all N and
    distinct V in the training documents; score: the model's log10 probability of the words and the end. Null, empty
    and blank texts hold the end alone; null ids fall in the fold of the empty text; rows that repeat are scored alike,
    and each counts; without training documents N and V are 0. Extra columns are ignored. A text of any length is one
    row of one block, so it must fit in a task.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), F.xxhash64(id_col, text_col).alias("rid"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held_out")).alias("train")).first()
    n_blocks, n_train = -(-(size.bytes or 0) // block_bytes) or 1, size.train
    dealt = rows.withColumn("block", F.pmod("rid", F.lit(n_blocks)).cast("int"))
    partial = block_words(dealt.repartition(n_blocks, "block").sortWithinPartitions("block"))
    by_word = Window.partitionBy("word")
    partial = partial.withColumn("c", F.sum("n").over(by_word)).withColumn("first", F.col("block") == F.min("block").over(by_word))
    words = written(encoded(partial, path, pattern), "lm-words", compression="zstd")
    known = words.where("first and c > 0")
    totals = known.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = (totals.n or 0) + n_train, totals.v + (n_train > 0)

    first, going, every, heads = id_counts(known, max(vocabulary(path, pattern).tokens) + 1)
    steps = step_counts(known, Words.layout(first, going, every)[2])
    shares = spark.sparkContext.broadcast(Words.of_counts(first, going, every, heads, steps, n_train))

    def code(texts: pa.Table, words: pa.Table) -> pa.Table:
        return coded_texts(texts.sort_by("rid"), words, shares.value, n_all, v_all, n_train)

    sides = dealt.groupBy("block").cogroup(words.select("block", "word", "c", "ids").groupBy("block"))
    fields = f"block int, rid bigint, id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, codes binary, counted binary"
    coded = written(sides.applyInArrow(code, fields), "lm-codes", compression="zstd")
    shard = F.floor(F.col("block") / SHARD).cast("int").alias("shard")
    model = spark.sparkContext.broadcast(trained(coded.where(~F.col("held_out")).select(shard, "rid", "codes"), shares.value.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "codes"):
                found = np.zeros(0)
                if part.num_rows:
                    counted = np.frombuffer(b"".join(part.column("counted").to_pylist()), dtype="<f4").astype(np.float64)
                    found = word_scores(model.value, texts_of(part), counted, shares.value.of_places, shares.value.spelt)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "held_out", "n_tokens", "n_known", "base_score")), pa.array(found)], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    done = coded.drop("block", "rid").mapInArrow(run, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return done.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
