"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, its word pairs and its pairs with one word between. Training
takes a bounded sample of labelled rows: Spark tasks hash their texts, and one task runs FTRL-proximal over the sample,
with rates by coordinate. It holds the state of all coordinates and one group of rows at a time, of bounded size, over
which it makes its epochs. L1 leaves few weights, which are broadcast for scoring; there can't be more than 2**BITS.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, slices
from .decontaminate import words_of

BITS = 20
#: The most labelled rows that training takes, by hash of their ids; rows and coordinates of a group, and coordinates that
#: one row of the shuffle holds.
SAMPLE, EPOCHS = 24_000, 3
GROUP, GROUP_FEATURES, PIECE = 2_000, 16 << 20, 4096
ALPHA, BETA, L1, L2 = 0.5, 1.0, 5.0, 0.5
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
MIX, BIGRAM, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def features(text: str | None) -> np.ndarray:
    """Hashed features of one whole text, repeats included; none without words."""
    words = words_of(text)
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    every = np.concatenate([h * MIX, (h[:-1] * MIX + h[1:]) * BIGRAM, (h[:-2] * MIX + h[2:]) * SKIP])
    return (every >> np.uint64(64 - BITS)).astype(np.int32)


class Learner:
    """FTRL-proximal; the last coordinate is the intercept, which L1 spares."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(i == 1 << BITS, 0, self.l1), 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)

    def learn(self, rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> None:
        """rows: distinct coordinates, the intercept's among them, and the label."""
        for _ in range(epochs):
            for x, y in rows:
                w = self.weights(x)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                grown = self.n[x] + g * g
                self.z[x] += g - (np.sqrt(grown) - np.sqrt(self.n[x])) / self.alpha * w
                self.n[x] = grown


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """The weights after one group of rows."""
    learner = Learner()
    learner.learn(rows, epochs)
    return learner.weights(np.arange((1 << BITS) + 1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, group: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that aren't zero. Null labels teach nothing; ids whose labels differ neither; of rows that
    repeat ids, no more than `sample` in all are taken."""
    one = labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("int").alias("y")).where("of is not null and y in (0, 1)").where(fold("of", FOLDS) != HELD_OUT)
    one = one.groupBy("of").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("of", "y", F.xxhash64("of").alias("h")).orderBy("h", "of").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(one), rows.id == one["of"]).select("y", "h", "text")  # at most `sample` small rows

    rows = rows.select("y", "h", F.xxhash64("text").alias("t"), F.monotonically_increasing_id().alias("row"), "text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                every = [np.unique(features(t)) for t in part.column("text").to_pylist()]
                pieces = [[x[a : a + PIECE].tobytes() for a in range(0, max(len(x), 1), PIECE)] for x in every]
                at = pa.array(np.repeat(np.arange(len(every)), [len(p) for p in pieces]))
                keys = [part.column(c).take(at) for c in ("y", "h", "t", "row")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([k for p in pieces for k in range(len(p))], pa.int32()), pa.array([x for p in pieces for x in p], pa.binary())], ["y", "h", "t", "row", "piece", "x"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, taken, rows, size = Learner(), 0, [], 0
        key, parts, label = None, [], 0

        def close() -> None:
            nonlocal taken, size
            if key is not None and taken < sample:
                taken += 1
                rows.append((np.concatenate([*parts, np.array([1 << BITS], dtype=np.int32)]), label))
                size += len(rows[-1][0])

        def learn() -> None:
            nonlocal size
            learner.learn(rows)
            rows.clear()
            size = 0

        for batch in batches:
            for y, h, t, row, x in zip(*(batch.column(c).to_pylist() for c in ("y", "h", "t", "row", "x"))):
                if (h, t, row) != key:
                    close()
                    if len(rows) >= group or size >= GROUP_FEATURES:
                        learn()
                    key, parts, label = (h, t, row), [], y
                parts.append(np.frombuffer(x, dtype=np.int32))
        close()
        learn()
        if taken:
            w = learner.weights(np.arange((1 << BITS) + 1))
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at])], ["i", "w"])

    made = rows.mapInArrow(featured, "y int, h bigint, t bigint, row bigint, piece int, x binary")
    weights = made.repartition(1).sortWithinPartitions("h", "t", "row", "piece").mapInArrow(trained, "i int, w double").toArrow()
    return weights.column("i").to_numpy(), weights.column("w").to_numpy()


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, held_out boolean, score double (0 to 1) and predicted int (score at least the threshold) of each row of docs.

    Scores come from whole texts alone. A null or empty text has no features and gets the intercept's score; without any
    labelled row to learn from, every score is 0.5. Null ids are judged as the empty text; repeated rows are scored
    alike; extra columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << BITS) + 1, dtype=np.float64)
        at, of = model.value
        w[at] = of
        for batch in batches:
            for part in slices(batch, "text"):
                margins = []
                for t in part.column("text").to_pylist():
                    x = features(t)
                    margins.append(w[np.unique(x[w[x] != 0])].sum() + w[-1])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(1 / (1 + np.exp(-np.clip(margins, -500, 500))))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
    return scored.select(id_col, (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
