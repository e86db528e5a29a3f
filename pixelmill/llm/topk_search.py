"""Exact top-k inner-product search by the threshold algorithm.

Vectors are dealt into blocks of bounded size. For a block, each dimension has
its list of vectors sorted by that component. A query reads all lists in step,
from the end that its sign favours, scores what it meets by random access, and
stops when the bound on unseen vectors, the sum of weight times the value last
read in each list, cannot reach the kth score. Blocks' winners are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VECTORS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 2048
FIRST_DEPTH = 16


def _matrix(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(column), -1)


def threshold_topk(vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best vectors for one query; ties go to the smaller id.

    ``lists[:, d]`` are the row numbers sorted by component d, ascending.
    """
    n = len(vectors)
    dims = np.flatnonzero(query)
    up, down = dims[query[dims] < 0], dims[query[dims] > 0]
    seen = ids == own
    scores = np.full(n, -np.inf)
    left, depth, step = n - int(seen.sum()), 0, FIRST_DEPTH
    want = min(k, left)
    if not len(dims):  # every score is zero: one read of all
        scores[~seen], left = 0.0, 0
    while left and depth < n:
        end = min(n, depth + step)
        met = np.zeros(n, bool)
        met[lists[depth:end, up].ravel()] = True
        met[lists[n - end : n - depth, down].ravel()] = True
        new = np.flatnonzero(met & ~seen)
        scores[new] = vectors[new] @ query
        seen[new] = True
        left -= len(new)
        bound = query[up] @ vectors[lists[end - 1, up], up] + query[down] @ vectors[lists[n - end, down], down]
        depth, step = end, step * 2
        if left and np.count_nonzero(scores > bound) >= want:
            break
    found = np.flatnonzero(scores > -np.inf)
    if len(found) > want:
        found = found[scores[found] >= np.partition(scores[found], len(found) - want)[len(found) - want]] if want else found[:0]
    order = found[np.lexsort((ids[found], -scores[found]))][:want]
    return ids[order], scores[order]


def exact_topk(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The k highest integer inner products of each query with all other vectors.

    Components become ``floor(scale * x)``. Returns ``query_id, rank, vec_id,
    score``, ranks from 1, ties to the smaller id; fewer rows where there are
    fewer candidates. Vectors that are null or hold a null or non-finite
    component, and rows without id, take no part. A vector is compared with those
    of its own length only; an empty vector scores 0. A repeated id is one
    query (its smallest vector) and as many candidates as it has rows; a query's
    own id is no candidate. Sums are exact below 2**53. An empty table gives an
    empty result; other columns are ignored.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vec_col}`")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)

    vectors, queries = clean(vectors), clean(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    nv, nq = vectors.count(), queries.count()
    vector_blocks, query_blocks = max(1, -(-nv // VECTORS_PER_BLOCK)), max(1, -(-nq // QUERIES_PER_BLOCK))
    parts = min(vector_blocks * query_blocks, 20_000)
    block = lambda df, n: F.pmod(F.xxhash64("vec_id", F.hash("v")), F.lit(n))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    right = vectors.withColumn("vb", block(vectors, vector_blocks)).withColumn("qb", F.explode(numbers(query_blocks)))
    left = queries.withColumn("qb", block(queries, query_blocks)).withColumn("vb", F.explode(numbers(vector_blocks)))
    keys = [F.size("v").alias("dim"), "qb", "vb", "vec_id", "v"]

    def search(_, q, v):
        out: list = []
        if q.num_rows and v.num_rows:
            ids, matrix = v["vec_id"].to_numpy(), _matrix(v["v"], scale)
            lists = np.argsort(matrix, axis=0, kind="stable")
            for own, one in zip(q["vec_id"].to_numpy(), _matrix(q["v"], scale), strict=True):
                got, scores = threshold_topk(matrix, ids, lists, one, own, k)
                out.append((np.full(len(got), own), got, scores))
        a, b, c = (np.concatenate([x[i] for x in out]) if out else np.zeros(0) for i in range(3))
        return pa.table({"query_id": a.astype(np.int64), "vec_id": b.astype(np.int64), "score": c.astype(np.int64)})

    spread = lambda df: df.select(*keys).repartition(parts, "dim", "qb", "vb").groupBy("dim", "qb", "vb")
    local = spread(left).cogroup(spread(right)).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(vectors, vectors.where("vec_id % 50 = 0"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
