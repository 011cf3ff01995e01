"""Whitening of embeddings by Spark MLlib's singular value decomposition.

Entries become integers, so that counts, sums and deviations are exact. The rows, centred in exact arithmetic and divided
once, go to MLlib's computeSVD; asked for all components it takes one pass over the rows, for their Gramian, and decomposes
that. Singular values are rescaled by the divisor n. The total variance comes from the exact deviations, not from the
decomposition, and the covariance of what comes out is measured by MLlib in a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, MOST = 64, 1_000_000, 32
#: Entries beyond +-2**46 count as that, so that their integers are exact in double precision.
BOUND = float(1 << 52)
#: Components whose singular value is below this share of the largest are taken for none: their directions are noise.
LEAST = 3e-6
LONG = (1 << 63) - 1
SCHEMA = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def integers(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x array<bigint>, of rows whose vector is there, has entries, and holds no null and no non-finite one."""
    v = F.col(vector_col)
    whole = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), SCALE * c.cast("double")))).cast("bigint") + SHIFT)
    return rows.where(whole).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(n * x - sums) / n in doubles, and each row's exact sum of squares of n * x - sums. sums holds Python's integers."""
    fits = n * max(int(np.abs(x).max(initial=0)), 1) < LONG // 4 and max(abs(int(s)) for s in sums) < LONG // 4
    d = n * x - sums.astype(np.int64) if fits else n * x.astype(object) - sums
    if not fits or int(np.abs(d).max(initial=0)) ** 2 * x.shape[1] > LONG:
        o = d.astype(object)
        return (o / n).astype(float), (o * o).sum(1).tolist()
    return d / n, (d * d).sum(1).tolist()


def _passed(data: DataFrame, n: int, sums: list[int], basis: np.ndarray | None = None) -> DataFrame:
    """vec_id, deviation (null beyond a long), beyond (the same in double precision, where that is null), v: the centred
    row, or its projection on the columns of a basis."""
    total, dim = np.array(sums, dtype=object), len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(-1, dim)
            v, exact = centred(x, n, total)
            v = v if basis is None else v @ basis
            fit = [e if e <= LONG else None for e in exact]
            beyond = [None if e <= LONG else float(e) for e in exact]
            offsets = pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(fit, pa.int64()), pa.array(beyond, pa.float64()), pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], ["vec_id", "deviation", "beyond", "v"])

    return data.mapInArrow(run, f"vec_id {data.schema['vec_id'].dataType.simpleString()}, deviation bigint, beyond double, v array<double>")


def _matrix(rows: DataFrame) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v"))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST) -> DataFrame:
    """Each row's coordinate on each of the first components, scaled to variance one.

    Returns a row for each row of the table and each component: vec_id, component int (from 1, by falling variance), n long
    (rows that take part), deviation long (sum over dimensions of (n * x - S) ** 2, S the sums of x; null where that isn't
    a long), whitened double, explained double (the component's share of the variance), identity_error double (largest
    absolute entry of the covariance of whitened less the identity; the same in all rows). Components are numbered where
    variances tie, in any order, and have either sign, the same for all rows. Vectors that are null or empty, or hold null
    or non-finite entries, take no part; where lengths differ, the commonest (then the longest) takes part. Rows that repeat
    an id or a vector count each; null ids stay. Directions without variance (one row, equal rows) have no component, and a
    table without any has no rows. Extra columns are ignored.
    """
    spark = rows.sparkSession
    data = integers(rows, id_col, vector_col)
    none = spark.createDataFrame([], SCHEMA.format(data.schema["vec_id"].dataType.simpleString()))
    sizes = data.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not sizes:
        return none
    n, data = sizes["count"], data.where(F.size("x") == sizes.d)
    by_place = data.select(F.posexplode("x").alias("place", "x")).groupBy("place").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
    sums = [int(r.s) for r in by_place.orderBy("place").collect()]  # one row a dimension
    middle = _passed(data, n, sums)
    spread = middle.agg(F.sum(F.col("deviation").cast("decimal(38,0)")).alias("exact"), F.sum("beyond").alias("beyond")).first()
    trace = (float(spread.exact or 0) + (spread.beyond or 0.0)) / float(n) ** 3
    if not trace:
        return none
    svd = _matrix(middle).computeSVD(sizes.d, False, LEAST)
    variance = svd.s.toArray()[:most] ** 2 / n
    basis = svd.V.toArray()[:, : len(variance)] / np.sqrt(variance)
    white = _passed(data, n, sums, basis)
    error = float(np.abs(_matrix(white).computeCovariance().toArray() * ((n - 1) / n) - np.eye(len(variance))).max())
    explained = F.array(*(F.lit(float(e / trace)) for e in variance))
    each = white.select("vec_id", "deviation", F.posexplode("v").alias("place", "whitened"))
    return each.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"))
