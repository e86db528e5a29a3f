"""PCA whitening of embeddings from exact integer sums.

One pass counts and adds up components, a second adds up products of entries that
are centred on the integer mean, so that the covariance is known exactly before it
becomes a matrix of doubles. Its pivoted Cholesky factor L is computed, and the
columns of L are rotated in pairs until they are orthogonal (one-sided Jacobi):
with L J = U S the covariance is U S**2 U', so squared column norms are the
eigenvalues and normalised columns the components. The covariance of the whitened
rows is measured in a pass of its own.

Sums leave a task as one row for each entry and are added up by Spark; the driver
holds one ``d x d`` matrix for each vector length, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import finite, matrix

SUMS = "dim int, i int, j int, s decimal(38,0), n long"
#: Doubles hold integers exactly up to this.
EXACT = 1 << 53


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with ``v = L L'``, one column for each pivot above rounding, the largest remaining diagonal first."""
    d, rest = len(v), v.diagonal().astype(float).copy()
    least = d * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    columns: list[np.ndarray] = []
    for _ in range(d):
        p = int(rest.argmax())
        if rest[p] <= least:
            break
        done = np.array(columns).reshape(len(columns), d)
        column = v[:, p] - done.T @ done[:, p]
        column = column / np.sqrt(rest[p])
        column[rest < 0] = 0.0  # pivots that are done
        column[p] = np.sqrt(rest[p])
        columns.append(column)
        rest = rest - column * column
        rest[p] = -np.inf
    return np.array(columns).reshape(len(columns), d).T


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``factor factor'`` that are not zero, falling, and their unit vectors as columns."""
    a = factor.T.copy()  # rows are the columns to rotate
    for _ in range(sweeps):
        turned = False
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                alpha, beta, gamma = a[p] @ a[p], a[q] @ a[q], a[p] @ a[q]
                if abs(gamma) <= 1e-15 * np.sqrt(alpha * beta):
                    continue
                turned = True
                zeta = (beta - alpha) / (2 * gamma)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                a[p], a[q] = c * a[p] - c * t * a[q], c * t * a[p] + c * a[q]
        if not turned:
            break
    norms = np.linalg.norm(a, axis=1)
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, (a[order] / norms[order, None]).T


def _entries(raw: np.ndarray, scale: float, shift: int) -> np.ndarray:
    x = np.floor(scale * raw.astype(np.float64)) + shift
    if x.size and np.abs(x).max() >= EXACT:
        raise ValueError(f"an entry is {np.abs(x).max()} after scaling; entries are exact below {EXACT}")
    return x.astype(np.int64)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers of each vector length of a batch."""
    dims = batch["dim"].to_numpy()
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


def _added(df: DataFrame, products: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, tuple[int, dict]]:
    """By vector length: rows, and the sum of ``products(dim, raw)`` (a matrix of exact integers) over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, list] = {}
        for b in batches:
            for dim, at in _by_length(b):
                got = products(dim, matrix(b["v"].take(pa.array(at))))
                was = sums.get(dim, [0, 0])
                sums[dim] = [was[0] + len(at), was[1] + got]
        for dim, (n, total) in sums.items():
            i, j = np.indices(total.shape).reshape(2, -1)
            keep = i <= j if len(total) > 1 else i >= 0
            i, j = i[keep], j[keep]
            values = pa.array([Decimal(int(t)) for t in total[i, j]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), values, pa.array(np.full(len(i), n, np.int64))], ["dim", "i", "j", "s", "n"])

    found = df.mapInArrow(run, SUMS).groupBy("dim", "i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    out: dict[int, tuple[int, dict]] = {}
    for r in found:
        out.setdefault(r["dim"], (r["n"], {}))[1][r["i"], r["j"]] = int(r["s"])
    return out


def _gram(y: np.ndarray) -> np.ndarray:
    """``y' y`` as exact Python integers."""
    largest = int(np.abs(y).max(initial=0))
    if largest * largest * max(1, len(y)) < EXACT:
        y = y.astype(float)
        return (y.T @ y).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


def _total(x: np.ndarray) -> np.ndarray:
    """Sums of all columns as one row of exact Python integers."""
    fits = int(np.abs(x).max(initial=0)) * max(1, len(x)) < 1 << 62
    return (x if fits else x.astype(object)).sum(axis=0).astype(object)[None]


def whiten(vectors: DataFrame, *, components: int = 32, scale: float = 64.0, shift: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, dict[int, dict]]:
    """Whitened rows ``vec_id, component, n, deviation, whitened, explained, identity_error`` and the models by vector length.

    Entries are ``floor(scale * c) + shift``. ``deviation`` is the exact sum of
    ``(n x - S)**2``, null where it does not fit a long. Components are numbered
    from 1 by falling eigenvalue, at most ``components`` of them and no more than
    the rank: equal rows, or a single one, give no rows. Vectors that are null,
    empty, or hold null or non-finite entries take no part, nor do rows without an
    id; repeated rows count each. Vectors of different lengths are lists of their
    own with models of their own. Entries of 2**53 and more after scaling raise an
    error. Other columns are ignored; an empty table gives an empty result.
    A model holds ``n, sums, values`` (all eigenvalues), ``vectors`` and ``identity_error``.
    """
    v = F.col(f"`{vec_col}`")
    usable = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite(F.col("v"))).withColumn("dim", F.size("v"))
    models: dict[int, dict] = {}
    for dim, (n, sums) in _added(usable, lambda _, raw: _total(_entries(raw, scale, shift))).items():
        total = [sums[0, j] for j in range(dim)]
        models[dim] = {"n": n, "sums": total, "middle": [t // n for t in total]}
    middles = {dim: np.array(m["middle"], np.int64) for dim, m in models.items()}
    for dim, (n, q) in _added(usable, lambda dim, raw: _gram(_entries(raw, scale, shift) - middles[dim])).items():
        m = models[dim]
        left = [t - n * c for t, c in zip(m["sums"], m["middle"], strict=True)]  # sums of what is centred on whole numbers
        cov = np.array([[(n * q[min(i, j), max(i, j)] - left[i] * left[j]) / (n * n) for j in range(dim)] for i in range(dim)])
        values, axes = one_sided_jacobi(pivoted_cholesky(cov))
        m |= {"left": left, "values": values, "vectors": axes, "trace": float(cov.trace()), "kept": min(components, len(values))}
    slim = {dim: {k: m[k] for k in ("n", "left", "values", "vectors", "kept")} for dim, m in models.items()}

    def project(dim: int, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = slim[dim]
        y = _entries(raw, scale, shift) - middles[dim]
        kept = m["kept"]
        return y, (y - np.array([s / m["n"] for s in m["left"]])) @ (m["vectors"][:, :kept] / np.sqrt(m["values"][:kept]))

    def spread(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, at in _by_length(b):
                w = project(dim, matrix(b["v"].take(pa.array(at))))[1]
                w = np.hstack([w, np.ones((len(w), 1))])  # the last line adds up the rows themselves
                sums[dim] = sums.get(dim, 0.0) + w.T @ w
        for dim, s in sums.items():
            i, j = np.indices(s.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s.ravel())], ["dim", "i", "j", "s"])

    measured: dict[int, np.ndarray] = {dim: np.zeros((m["kept"] + 1,) * 2) for dim, m in models.items()}
    for r in usable.mapInArrow(spread, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect():
        measured[r["dim"]][r["i"], r["j"]] = r["s"]
    for dim, s in measured.items():
        n, k = models[dim]["n"], models[dim]["kept"]
        mean = s[k, :k] / n
        models[dim]["identity_error"] = float(np.abs(s[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    told = {dim: (m["identity_error"], m["trace"]) for dim, m in models.items()}

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for dim, at in _by_length(b):
                m, (error, trace) = slim[dim], told[dim]
                n, kept = m["n"], m["kept"]
                if not kept:
                    continue
                y, w = project(dim, matrix(b["v"].take(pa.array(at))))
                largest = n * (int(np.abs(y).max()) + 1)
                off = n * (y if largest * largest * dim < 1 << 62 else y.astype(object)) - np.array(m["left"], object if largest * largest * dim >= 1 << 62 else np.int64)
                deviation = [d if d < 1 << 63 else None for d in (off * off).sum(axis=1).tolist()]
                ids = b["vec_id"].take(pa.array(np.repeat(at, kept)))
                counts = len(at)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), counts)), pa.array(np.full(counts * kept, n, np.int64)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(counts), kept))),
                     pa.array(w.ravel()), pa.array(np.tile(m["values"][:kept] / trace, counts)), pa.array(np.full(counts * kept, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return usable.mapInArrow(rows, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"), models


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]
