"""Maximum inner product search: score-aware (anisotropic) quantisation, four-bit table scans, exact reranking.

A vector is cut into pairs of coordinates, each coded in four bits. Codebooks and codes minimise the residual's square
plus a penalty on its part parallel to the vector, which is what an inner product with a near query feels. Vectors and
queries are dealt into blocks of bounded size, and each pair of blocks is one small task: a scan that adds table
entries, the best few per query, then their exact inner products. Rows of equal vectors are searched once and expanded
by id at the end, which is exact and keeps a hot vector from filling a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

NEAREST, EVERY = 20, 20
#: About as many distinct vectors are picked by hash to fit the codebooks, and never more than twice that; every vector
#: is indexed.
SAMPLE = 8192
#: Vectors and queries in a block, and how many of a block's candidates each query reranks exactly.
BLOCK, QUERIES, RERANK = 8192, 4096, 192
#: The inner products that matter, as a share of the product of norms; sets the weight of the parallel residual.
THRESHOLD = 0.2
CENTRES, SWEEPS, ROUNDS = 16, 2, 12


def weight(dim: int) -> float:
    """How much more the parallel residual weighs than the rest."""
    return max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


def padded(x: np.ndarray) -> np.ndarray:
    """Vectors as pairs of coordinates: n x pairs x 2, an even number of pairs."""
    n, d = x.shape
    return np.pad(x, ((0, 0), (0, -d % 4))).reshape(n, -1, 2)


def assign(x: np.ndarray, books: np.ndarray, codes: np.ndarray | None = None, sweeps: int = SWEEPS, extra: float | None = None) -> np.ndarray:
    """Codes of vectors (n x pairs x 2), by coordinate descent over the pairs."""
    n, pairs, _ = x.shape
    extra = weight(2 * pairs) - 1 if extra is None else extra
    unit = x / np.maximum(np.linalg.norm(x.reshape(n, -1), axis=1), 1e-30)[:, None, None]
    if codes is None:
        codes = np.stack([((x[:, s, None, :] - books[s]) ** 2).sum(-1).argmin(1) for s in range(pairs)], axis=1)
    along = np.stack([((x[:, s] - books[s][codes[:, s]]) * unit[:, s]).sum(-1) for s in range(pairs)], axis=1)
    total = along.sum(1)
    for _ in range(sweeps):
        for s in range(pairs):
            r = x[:, s, None, :] - books[s]
            a = (r * unit[:, s, None, :]).sum(-1)
            others = total - along[:, s]
            best = ((r**2).sum(-1) + extra * (others[:, None] + a) ** 2).argmin(1)
            codes[:, s] = best
            along[:, s] = a[np.arange(n), best]
            total = others + along[:, s]
    return codes


def fit(x: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (pairs x 16 x 2) for vectors (n x pairs x 2): assignments and weighted least squares in turn."""
    n, pairs, _ = x.shape
    extra = weight(2 * pairs) - 1
    unit = x / np.maximum(np.linalg.norm(x.reshape(n, -1), axis=1), 1e-30)[:, None, None]
    at = np.linspace(0, n - 1, CENTRES).astype(int)
    books = np.stack([x[np.argsort(np.arctan2(x[:, s, 1], x[:, s, 0]), kind="stable")[at], s] for s in range(pairs)])
    codes = None
    for k in range(rounds):
        codes = assign(x, books, None if k == 0 else codes, 1, extra)
        along = np.stack([((x[:, s] - books[s][codes[:, s]]) * unit[:, s]).sum(-1) for s in range(pairs)], axis=1)
        total = along.sum(1)
        for s in range(pairs):
            u, c = unit[:, s], codes[:, s]
            others = total - along[:, s]
            count = np.bincount(c, minlength=CENTRES)
            left = count[:, None, None] * np.eye(2)
            right = np.zeros((CENTRES, 2))
            pull = x[:, s] + extra * u * (others + (x[:, s] * u).sum(-1))[:, None]
            for i in range(2):
                right[:, i] = np.bincount(c, pull[:, i], CENTRES)
                for j in range(2):
                    left[:, i, j] += extra * np.bincount(c, u[:, i] * u[:, j], CENTRES)
            full = count > 0
            books[s][full] = np.linalg.solve(left[full], right[full][:, :, None])[:, :, 0]
            along[:, s] = ((x[:, s] - books[s][c]) * u).sum(-1)
            total = others + along[:, s]
    return books


def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries x vectors) from tables (queries x pairs x 16) and bytes of two codes each."""
    q = len(tables)
    joint = (tables[:, 1::2, :, None] + tables[:, 0::2, None, :]).reshape(q, -1, CENTRES * CENTRES)
    out = np.take(joint[:, 0], codes[:, 0], axis=1)
    for s in range(1, codes.shape[1]):
        out += np.take(joint[:, s], codes[:, s], axis=1)
    return out


def nearest(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, ids: list[list[int]], books: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, id, score: at most k rows a query, nearest first and then by id, without the query itself."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    least = np.array([i[0] for i in ids])
    for a in range(0, len(queries), 128):
        q = queries[a : a + 128]
        tables = np.einsum("qsd,scd->qsc", padded(q), books).astype(np.float32)
        if len(vectors) > rerank:
            found = np.argpartition(scan(tables, codes), len(vectors) - rerank, axis=1)[:, -rerank:]
        else:
            found = np.broadcast_to(np.arange(len(vectors)), (len(q), len(vectors)))
        exact = (vectors[found] * q[:, None, :]).sum(-1)
        order = np.lexsort((least[found], -exact), axis=1)[:, : k + 1]
        for j in range(len(q)):
            mine, rows = query_ids[a + j], []
            for f, score in zip(found[j, order[j]].tolist(), exact[j, order[j]].tolist()):
                rows += [(-score, i) for i in ids[f] if i != mine]
            rows = sorted(rows)[:k]
            out.append((np.full(len(rows), mine), np.array([i for _, i in rows], dtype=np.int64), np.array([-s for s, _ in rows])))
    return tuple(np.concatenate(c) if out else np.zeros(0) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v array<double> of the rows that take part."""
    v = F.col("v")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def search(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, is_query: Column | None = None, rerank: int = RERANK, block: int = BLOCK, query_block: int = QUERIES, sample: int = SAMPLE) -> DataFrame:
    """The k rows of largest inner product with each query.

    Returns query_id long, rank int (from 1), vec_id long, score double (in double precision on the original vectors):
    nearest first, ties to the smaller id, all candidates where there are fewer than k. Queries are the rows that
    is_query holds for (the column `id` is the row's id; default: divisible by 20), candidates all rows but the query's
    own. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; where
    lengths differ, the commonest (then the longest) takes part. Rows that repeat an id stand for one, with the vector
    that sorts first. Extra columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    data = written(usable(rows, id_col, vector_col), "ann-rows")
    sizes = data.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes.d
    data = data.where(F.size("v") == dim)
    is_query = F.col("id") % EVERY == 0 if is_query is None else is_query
    n_queries = data.where(is_query).count()
    n_blocks, n_query_blocks = -(-sizes["count"] // block), max(1, -(-n_queries // query_block))
    step = -(-sizes["count"] // sample)
    picked = data.where(F.pmod(F.xxhash64("v", F.lit(1)), F.lit(step)) == 0).select("v").distinct().limit(2 * sample).collect() or data.select("v").limit(1).collect()
    books = spark.sparkContext.broadcast(fit(padded(np.array(sorted(r.v for r in picked)))))

    by_vector = Window.partitionBy("v").orderBy("id")
    few = data.withColumn("rn", F.row_number().over(by_vector)).where(F.col("rn") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    packed = "b int, ids array<array<bigint>>, vectors binary, codes binary"

    def pack(key, table):
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        codes = assign(padded(v), books.value)
        codes = (codes[:, 0::2] + CENTRES * codes[:, 1::2]).astype(np.uint8)
        return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))), "vectors": pa.array([v.tobytes()], pa.binary()), "codes": pa.array([codes.tobytes()], pa.binary())})

    def pack_queries(key, table):
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({"q": pa.array([key[0].as_py()], pa.int32()), "query_ids": pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())), "queries": pa.array([v.tobytes()], pa.binary())})

    index = written(few.withColumn("b", F.pmod(F.xxhash64("v"), F.lit(n_blocks)).cast("int")).groupBy("b").applyInArrow(pack, packed), "ann-index")
    asked = data.where(is_query).withColumn("q", F.pmod(F.xxhash64("id"), F.lit(n_query_blocks)).cast("int")).groupBy("q").applyInArrow(pack_queries, "q int, query_ids array<bigint>, queries binary")
    asked = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = asked.join(index, "b").repartition(n_blocks * n_query_blocks, "b", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                v = np.frombuffer(r["vectors"]).reshape(-1, dim)
                codes = np.frombuffer(r["codes"], dtype=np.uint8).reshape(len(v), -1)
                made = nearest(np.frombuffer(r["queries"]).reshape(-1, dim), np.array(r["query_ids"]), v, codes, r["ids"], books.value, k, rerank)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
