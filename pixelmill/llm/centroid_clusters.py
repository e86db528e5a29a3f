"""Exact k-means on integer vectors with bounds that follow the geometry of each move.

Every vector carries its cluster and a lower bound of its distance to all other
centroids. After a move the distance to its own centroid is taken exactly. The
bound is loosened once for a whole cluster: its vectors lie in a sphere round the
old centroid, and in the plane through the sphere's centre and both places of a
moved centroid, one sees how much nearer that centroid can have come to any point
of the sphere. That is the full drift only where the sphere lies straight ahead of
the move. A vector whose own distance is below its bound keeps its cluster; all
others are ambiguous and scanned exactly. Equal results to a plain scan, ties
included: a bound decides only where it is strictly larger.

Vectors are written once as integers. A round is one pass over them and one sum
of ``k`` rows for each task; only centroids, radii and counts reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written
from .vectors import finite, lists, matrix

#: Squared distances of vectors up to this size fit a long.
LARGEST = 1 << 27
STATE = "vec_id long, x array<int>, cluster int, distance long, lower double, scans int"


def loosening(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """``[i, j]``: the most by which centroid j came nearer to any point within ``radii[i]`` of ``old[i]``.

    With a the old and b the new place, d the drift and M the middle of both, the
    points that came nearer by more than d cos(w) lie inside a branch of a
    hyperbola, and so within the cone at M of half-angle w round the direction of
    the move. A sphere is seen from M at an angle beta to that direction, and
    reaches gamma to its sides; so it gains d cos(beta - gamma) at most, and
    nothing where that angle is a right one or more.
    """
    drift = np.linalg.norm(new - old, axis=1)
    out = np.tile(drift, (len(old), 1))
    for j in np.flatnonzero(drift):
        middle, ahead = (old[j] + new[j]) / 2, (new[j] - old[j]) / drift[j]
        far = old - middle
        length = np.linalg.norm(far, axis=1)
        outside = length > radii
        seen = np.maximum(length, 1e-300)
        beta = np.arccos(np.clip(far @ ahead / seen, -1, 1))
        gamma = np.arcsin(np.clip(radii / seen, 0, 1))
        gain = drift[j] * np.cos(np.clip(beta - gamma, 0, np.pi / 2))
        out[outside, j] = np.minimum(gain[outside] + 1e-9 * (1 + drift[j]), drift[j])
    return out


def assign(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray | None, lower: np.ndarray | None, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, squared distance, lower bound to all others and whether it was scanned, for each row of ``x``.

    ``half[i]`` is half the way from centroid i to the nearest other one.
    """
    n, k = len(x), len(centroids)
    if cluster is None:
        cluster, lower, distance, open_ = np.zeros(n, np.int64), np.full(n, -1.0), np.zeros(n, np.int64), np.arange(n)
    else:
        away = x - centroids[cluster]
        distance = np.einsum("ij,ij->i", away, away)
        open_ = np.flatnonzero(~(np.sqrt(distance.astype(float)) * (1 + 1e-12) < np.maximum(lower, half[cluster] * (1 - 1e-12))))
    cluster, lower = cluster.copy(), lower.copy()
    if len(open_):
        part = x[open_]
        d = np.stack([np.einsum("ij,ij->i", away, away) for away in (part - c for c in centroids)], axis=1)
        cluster[open_] = best = d.argmin(axis=1)  # the first of equal ones
        distance[open_] = d[np.arange(len(part)), best]
        if k > 1:
            d[np.arange(len(part)), best] = np.iinfo(np.int64).max
            lower[open_] = np.sqrt(d.min(axis=1).astype(float)) * (1 - 1e-12)
        else:
            lower[open_] = np.inf
    scanned = np.zeros(n, bool)
    scanned[open_] = True
    return cluster, distance, lower, scanned


def _integers(vectors: DataFrame, scale: float) -> DataFrame:
    """``vec_id, x``: components as ``floor(scale * x)``."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x = np.floor(scale * matrix(b["v"]).astype(np.float64))
            if x.size and np.abs(x).max() >= LARGEST:
                raise ValueError(f"a component is {np.abs(x).max()} after scaling; squared distances fit a long below {LARGEST}")
            yield pa.RecordBatch.from_arrays([b["vec_id"], lists(x.astype(np.int32))], ["vec_id", "x"])

    return vectors.mapInArrow(run, "vec_id long, x array<int>")


def _pass(table: DataFrame, centroids: np.ndarray, loosen: np.ndarray | None) -> DataFrame:
    """The table with clusters by these centroids; ``loosen[i]`` is taken from the bounds of cluster i first."""
    gaps = np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(axis=2).astype(float))
    np.fill_diagonal(gaps, np.inf)
    half = gaps.min(axis=1) / 2 if len(centroids) > 1 else np.zeros(1)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x = matrix(b["x"]).astype(np.int64)
            cluster = lower = None
            scans = np.zeros(len(x), np.int32)
            if loosen is not None:
                cluster = b["cluster"].to_numpy().astype(np.int64)
                lower = b["lower"].to_numpy() - loosen[cluster]
                scans = b["scans"].to_numpy()
            if len(x):
                cluster, distance, lower, scanned = assign(x, centroids, cluster, lower, half)
                columns = [pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(lower), pa.array(scans + scanned.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["x"], *columns], ["vec_id", "x", "cluster", "distance", "lower", "scans"])

    return table.mapInArrow(run, STATE)


def _sums(table: DataFrame) -> dict[int, tuple[int, int, list[int]]]:
    """Rows, largest squared distance and componentwise sums of each cluster that has any."""

    def run(batches: Iterator[pa.RecordBatch]):
        found: dict[int, list] = {}
        for b in batches:
            x, cluster, distance = matrix(b["x"]).astype(np.int64), b["cluster"].to_numpy(), b["distance"].to_numpy()
            for c in np.unique(cluster):
                own = cluster == c
                was = found.get(int(c), [0, 0, 0])
                found[int(c)] = [was[0] + int(own.sum()), max(was[1], int(distance[own].max())), was[2] + x[own].sum(axis=0)]
        rows = [(c, j, n, far, s) for c, (n, far, sums) in found.items() for j, s in enumerate(sums.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["cluster", "j", "n", "far", "s"])

    part = table.select("x", "cluster", "distance").mapInArrow(run, "cluster long, j long, n long, far long, s long")
    rows = part.groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # k x dimension
    out: dict[int, tuple[int, int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r["cluster"], r["j"])):
        out.setdefault(r["cluster"], (r["n"], r["far"], []))[2].append(int(r["s"]))
    return out


def centroid_clusters(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dimension: int = 64, scale: float = 64.0, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Clusters of all vectors after ``rounds`` moves of ``k`` centroids, and the centroids.

    Returns ``vec_id, cluster, distance, scans`` (squared distance; in how many of
    the passes it was ambiguous) and ``cluster, centroid, n, inertia`` of all
    clusters, empty ones too. Components are ``floor(scale * x)``. Starts are the
    ``k`` vectors with the smallest sha256 of ``seed:vec_id``, ties by id and
    components; of fewer vectors, all. Vectors that are null, of another length or
    hold null or non-finite components take no part, nor do rows without an id; a
    repeated row or id is a vector of its own. Components of 2**27 and more after
    scaling raise an error, as distances would not fit a long. An empty table gives
    empty results; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vec_col}`")
    usable = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") == dimension) & finite(F.col("v")))
    table = written(_integers(usable, scale))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = table.select(key.alias("key"), "vec_id", "x").orderBy("key", "vec_id", "x").limit(k).collect()
    centroids = np.array([r["x"] for r in starts], np.int64).reshape(len(starts), dimension)
    loosen = None
    for turn in range(rounds + 1 if len(starts) else 0):
        state = written(_pass(table, centroids, loosen))
        dropped(table)
        table = state
        if turn < rounds:
            sums, moved, radii = _sums(table), centroids.copy(), np.zeros(len(centroids))
            for c, (n, far, s) in sums.items():
                moved[c] = [t // n for t in s]
                radii[c] = np.sqrt(far) * (1 + 1e-12)
            gains = loosening(centroids.astype(float), moved.astype(float), radii)
            np.fill_diagonal(gains, 0)
            loosen, centroids = gains.max(axis=1) * (1 + 1e-12), moved
    if not len(starts):
        table = spark.createDataFrame([], STATE)
    found = {r["cluster"]: (r["n"], int(r["inertia"])) for r in table.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    rows = [(c, [int(t) for t in x], *found.get(c, (0, 0))) for c, x in enumerate(centroids)]
    return table.select("vec_id", "cluster", "distance", "scans"), spark.createDataFrame(rows, "cluster int, centroid array<long>, n long, inertia long")


def op11_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    vectors, centroids = centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = centroids.collect()  # 16
    total = sum(r["inertia"] for r in rows)
    told = [(r["cluster"], r["inertia"], total, hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest()) for r in rows]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return vectors.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op11_sql(k: int = 16, rounds: int = 3) -> str:
    distance = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    parts = [f"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda t: CAST(floor(64 * CAST(t AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda t: t IS NULL OR NOT isfinite(t))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), vec_id, x) - 1 AS INTEGER) AS cluster, x FROM v QUALIFY cluster < {k}
)"""]  # fmt: skip
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, x, cluster, distance FROM (SELECT v.vec_id, v.x, c.cluster, {distance} AS distance FROM v, c{r} c)
  QUALIFY row_number() OVER (PARTITION BY vec_id, x ORDER BY distance, cluster) = 1
)""")  # fmt: skip
        if r < rounds:
            parts.append(f"""s{r} AS MATERIALIZED (
  SELECT cluster, j, (sum(t) - ((sum(t) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT cluster, unnest(x) AS t, generate_subscripts(x, 1) AS j FROM a{r}) GROUP BY cluster, j
), c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, CASE WHEN m.x IS NULL THEN c.x ELSE m.x END AS x FROM c{r} c LEFT JOIN (SELECT cluster, list(CAST(m AS BIGINT) ORDER BY j) AS x FROM s{r} GROUP BY cluster) m ON m.cluster = c.cluster
)""")  # fmt: skip
    return f"""WITH {", ".join(parts)}
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


OP11_SQL = _op11_sql()
