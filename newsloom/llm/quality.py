"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Statistics are made in one pass over the texts and written; the class moments are plain sums over every labelled
training row, so fitting is one aggregation of a fixed number of doubles whatever the corpus. Covariances are shrunk
towards the pooled one and its diagonal; scores are differences of log densities, from Cholesky factors computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, kept_rows, slices, written

STATISTICS = ("length", "upper", "symbols", "stops", "digits", "spaces", "word_length", "short_words", "lines", "fresh_words", "fresh_lines", "bangs", "bars", "entropy")
D = len(STATISTICS)
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
BYTES = np.arange(256)
IS_UPPER, IS_LETTER = (BYTES >= 65) & (BYTES <= 90), ((BYTES | 32) >= 97) & ((BYTES | 32) <= 122) & (BYTES < 128) | (BYTES >= 128)
IS_DIGIT, IS_SPACE = (BYTES >= 48) & (BYTES <= 57), (BYTES == 32) | (BYTES >= 9) & (BYTES <= 13)
IS_STOP = np.isin(BYTES, [ord(c) for c in ".,"])
IS_SYMBOL = ~(IS_LETTER | IS_DIGIT | IS_SPACE | IS_STOP)
CLASSES = np.stack([IS_UPPER, IS_LETTER, IS_DIGIT, IS_SPACE, IS_STOP, IS_SYMBOL, BYTES == ord("!"), BYTES == ord("|")], axis=1).astype(float)


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text; zeros for a null or empty one, but for the ratios of counts plus one."""
    raw = (text or "").encode()
    n = max(len(raw), 1)
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, letters, digits, spaces, stops, symbols, bangs, bars = (hist @ CLASSES).tolist()
    words, lines = raw.split(), raw.split(b"\n")
    w = max(len(words), 1)
    p = hist[hist > 0] / n
    root = lambda part, whole: (part / whole) ** 0.5  # noqa: E731  spreads small shares
    return [
        np.log1p(len(raw)), root(upper, max(letters, 1)), root(symbols, n), root(stops, n), root(digits, n), root(spaces, n), np.log1p(letters / w), root(sum(len(x) <= 3 for x in words), w),
        np.log1p(100 * len(lines) / w), np.log((len(set(words)) + 1) / (w + 1) ** 0.8), root(len(set(lines)), len(lines)), root(bangs, n), root(bars, n), float(-(p * np.log2(p)).sum()),
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and stats array<double> of each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.array([statistics(t) for t in part.column("text").to_pylist()]).reshape(-1)
                stats = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, D), pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([part.column("id"), stats], ["id", "stats"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, stats array<double>").withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Discriminant:
    means: np.ndarray  # 2 x D
    factors: np.ndarray  # 2 x D x D: inverse Cholesky factors
    offset: float  # log prior odds less half the difference of log determinants

    @staticmethod
    def fit(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, pooled: float, diagonal: float, floor: float) -> Discriminant:
        """From the counts, sums and sums of outer products of both classes. A class without rows takes the pooled
        moments, and half a row as its count; without any rows, every score is the prior's 0.5."""
        total = max(n.sum(), 1)
        mean_all = sums.sum(0) / total
        means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], mean_all)
        scatter = squares - n[:, None, None] * means[:, :, None] * means[:, None, :]
        within = scatter.sum(0) / total
        cov = np.where(n[:, None, None] > 0, scatter / np.maximum(n, 1)[:, None, None], within)
        cov = (1 - pooled) * cov + pooled * within
        cov = (1 - diagonal) * cov + diagonal * np.eye(D) * np.diagonal(within) + floor * np.eye(D)
        chol = np.linalg.cholesky(cov)
        logdet = 2 * np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(1)
        prior = np.maximum(n, 0.5)
        return Discriminant(means, np.linalg.inv(chol), float(np.log(prior[1] / prior[0]) - 0.5 * (logdet[1] - logdet[0])))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        far = [(((x - self.means[k]) @ self.factors[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(self.offset - 0.5 * (far[1] - far[0]), -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", pooled: float = 0.1, diagonal: float = 0.05, floor: float = 1e-4) -> Discriminant:
    """Fits on every labelled row outside the held-out fold. A null label teaches nothing; ids whose labels differ
    neither; a label repeated alike counts once."""
    one = labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("int").alias("y")).where("of is not null and y in (0, 1)")
    one = one.groupBy("of").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").where(fold("of", FOLDS) != HELD_OUT)
    rows = stats.join(one, stats[id_col] == one["of"]).select("y", *[F.col("stats")[i].alias(f"x{i}") for i in range(D)])
    pairs = [(i, j) for i in range(D) for j in range(i, D)]
    found = rows.groupBy("y").agg(F.count("*").alias("n"), *[F.sum(f"x{i}") for i in range(D)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).collect()
    n, sums, squares = np.zeros(2), np.zeros((2, D)), np.zeros((2, D, D))
    for r in found:
        k, v = r[0], r[1:]
        n[k], sums[k] = v[0], v[1 : D + 1]
        for (i, j), s in zip(pairs, v[D + 1 :]):
            squares[k, i, j] = squares[k, j, i] = s
    return Discriminant.fit(n, sums, squares, pooled, diagonal, floor)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, held_out boolean, score double (0 to 1) and predicted int (score at least the threshold) of each row of docs.

    Scores come from the text alone. Null and empty texts have statistics like any other and so a score; null ids are in
    the held-out fold of the empty text; repeated rows are scored alike; extra columns are ignored.
    """
    stats = written(measured(docs, id_col, text_col), "quality-stats")
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, id_col, label_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.value.score(x))], ["id", "score"])

    scored = stats.select(F.col(id_col).alias("id"), "stats").mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
    return scored.select(id_col, (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs, with all their columns, that classify() predicts 1 for."""
    model = docs.sparkSession.sparkContext.broadcast(fit(measured(docs, id_col, text_col), labels, id_col, label_col))
    return kept_rows(docs, text_col, lambda texts: (model.value.score(np.array([statistics(t) for t in texts]).reshape(-1, D)) >= threshold).tolist())
