"""Links between near vectors by hashes of their directions.

Vectors at an angle t agree on the side of a random plane with probability 1 - t / pi. A table cuts the space by so many
planes that its cells hold few vectors, whatever the number of all; as many tables are laid as bring the probability that
two vectors at the threshold never share a cell below `miss` (nearer ones: far below). So what is compared grows much more
slowly than the pairs, and what may be missed is known. Cells are compared in tasks, as products of matrices, and leave
links that span what they found, not its pairs. Rows of one vector and day are one node, so that copies are no cell's load.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written

#: Vectors that a cell should hold, and those that are compared at a time; a cell of more is compared in pairs of blocks.
CELL, BLOCK = 512, 2048
SEED = 11


def layout(n: int, least: float, miss: float, cell: int = CELL) -> tuple[int, int]:
    """Planes of a table, and tables, for n vectors."""
    agree = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    planes = max(1, min(24, math.ceil(math.log2(max(2, n / cell)))))
    if agree >= 1:
        return planes, 1
    return planes, max(1, math.ceil(math.log(miss) / math.log1p(-(agree**planes))))


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the links i, j join what the ones before them don't."""
    top, keep = list(range(n)), np.zeros(len(i), dtype=bool)
    for at, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        while top[a] != a:
            top[a] = a = top[top[a]]
        while top[b] != b:
            top[b] = b = top[top[b]]
        if a != b:
            top[max(a, b)], keep[at] = min(a, b), True
    return keep


def near_vector_links(rows: DataFrame, least: float, days: int, day: str = "day", vector: str = "embedding", id_col: str = "id", miss: float = 1e-6, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """a, b: links whose components are those of all pairs of vectors of cosine `least` or more, at most `days` apart, but
    that a pair at the threshold is overlooked with the probability `miss` (and only if no other path joins its ends).

    Each link is a pair that reaches the threshold. Null and zero vectors, those with null or non-finite entries, of another
    length than the commonest, and rows without a day or id have none. Rows that repeat an id link to each other through it.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    v = F.col("v")
    rows = rows.select(F.col(id_col).alias("id"), F.datediff(day, F.lit("1970-01-01").cast("date")).alias("d"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("d").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if not size:
        return spark.createDataFrame([], f"a {kind}, b {kind}")
    rows = rows.where(F.size("v") == size.dim)
    nodes = written(rows.groupBy("v", "d").agg(F.min("id").alias("id"), F.max("id").alias("most"), F.count("*").alias("members")), "vector-nodes")
    copies = rows.join(nodes.where("id <> most").select("v", "d", F.col("id").alias("b")), ["v", "d"]).where("id <> b").select(F.col("id").alias("a"), "b")
    before = Window.partitionBy("v").orderBy("d")
    next_days = nodes.select(F.col("id").alias("a"), F.lag("id").over(before).alias("b"), (F.col("d") - F.lag("d").over(before)).alias("gap")).where(F.col("gap") <= days).select("a", "b")

    planes, tables = layout(nodes.count(), least, miss, cell)
    width = 8 * max(days, 1)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals = np.random.default_rng(SEED).normal(size=(size.dim, tables * planes))
        weights = 1 << np.arange(planes, dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x = part.column("v").flatten().to_numpy().reshape(-1, size.dim)
                x = x / np.sqrt((x * x).sum(1))[:, None]
                cells = ((x @ normals > 0).reshape(len(x), tables, planes) * weights).sum(2)
                d = part.column("d").to_numpy()
                unit = pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())
                early, late = d // width, (d + days) // width  # a pair of two slots meets in the earlier's late one
                for slot, rows_of in ((early, np.arange(len(x))), (late, np.flatnonzero(late != early))):
                    at = np.repeat(rows_of, tables)
                    cols = [pa.array(np.tile(np.arange(tables), len(rows_of)), pa.int32()), pa.array(cells[rows_of].ravel()), pa.array(slot[at], pa.int32())]
                    for a in range(0, len(at), 65536):
                        some = pa.array(at[a : a + 65536])
                        yield pa.RecordBatch.from_arrays([*(c.slice(a, 65536) for c in cols), part.column("id").take(some), part.column("d").take(some), unit.take(some)], ["t", "cell", "slot", "id", "d", "u"])

    keyed = nodes.select("id", "d", "v").mapInArrow(hashed, f"t int, cell bigint, slot int, id {kind}, d int, u binary")
    where = ["t", "cell", "slot"]
    sizes = keyed.select(*where).groupBy(*where).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = keyed.join(sizes, where).withColumn("k", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    # a cell of one block is compared at once; of several, each block with itself and with every other
    pair = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("k", o).alias("x"), F.greatest("k", o).alias("y"))))
    dealt = dealt.select(*where, "k", "id", "d", "u", F.explode(pair).alias("pair")).select(*where, "pair.x", "pair.y", "k", "id", "d", "u")
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64(*where, "x", "y"), F.lit(max(1, size["count"] * tables // 50_000))))

    def compared(table: pa.Table) -> pa.Table:
        """All cells of a bucket, one after another."""
        table = table.sort_by([(c, "ascending") for c in (*where, "x", "y")])
        key = np.stack([table.column(c).to_numpy() for c in (*where, "x", "y")])
        cuts = np.flatnonzero((np.diff(key, axis=1) != 0).any(0)) + 1
        out_i, out_j = [], []
        d, k = table.column("d").to_numpy(), table.column("k").to_numpy()
        u = np.frombuffer(b"".join(table.column("u").to_pylist()), dtype=np.float32).reshape(-1, size.dim)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), table.num_rows]):
            left, right = np.arange(a, b), np.arange(a, b)
            if key[3, a] != key[4, a]:
                left, right = left[k[a:b] == key[3, a]], right[k[a:b] == key[4, a]]
            for s in range(0, len(left), block):
                some = left[s : s + block]
                i, j = np.nonzero(u[some] @ u[right].T >= least - 1e-4)
                i, j = some[i], right[j]
                ok = (i < j if key[3, a] == key[4, a] else i != j) & (np.abs(d[i] - d[j]) <= days)
                i, j = i[ok], j[ok]
                x, y = u[i].astype(np.float64), u[j].astype(np.float64)
                ok = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)) >= least - 1e-7
                i, j = i[ok], j[ok]
                ok = spanning(b - a, i - a, j - a)
                out_i.append(i[ok])
                out_j.append(j[ok])
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_i, out_j))
        ids = table.column("id").combine_chunks()
        p, q = ids.take(pa.array(i)), ids.take(pa.array(j))
        less = pc.less(p, q)
        return pa.table({"a": pc.if_else(less, p, q), "b": pc.if_else(less, q, p)}).filter(pc.not_equal(p, q))

    found = dealt.groupBy("bucket").applyInArrow(compared, f"a {kind}, b {kind}").distinct()
    # single precision proposes, double precision decides
    of = lambda name: nodes.select(F.col("id").alias(name), F.col("v").alias(f"v{name}"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    sure = found.join(of("a"), "a").join(of("b"), "b").where(dot("va", "vb") / F.sqrt(dot("va", "va")) / F.sqrt(dot("vb", "vb")) >= least - 1e-12)
    return copies.unionByName(next_days).unionByName(sure.select("a", "b"))
