"""Clustering, whitening and near copies of embeddings, against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from pixelmill.llm import centroid_clusters, embedding_dedup, whitening

V = "vec_id long, embedding array<float>, label int, x string, cluster string, dim string, v int, h1 int, root int"
BAD = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "c", "d", 1, 2, 3) for i, v, label in rows], V)


def _vec(rng, n):
    return [float(t) for t in np.float32(rng.normal(0, 1, n))]


def _kmeans(rows, k, rounds, dimension, scale):
    """A plain scan: clusters and distances by position, centroids, in Python integers."""
    good = [(i, [int(np.floor(scale * float(np.float32(t)))) for t in v]) for i, v in rows]
    starts = sorted(good, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[0], r[1]))[:k]
    centroids = [x for _, x in starts]
    for turn in range(rounds + 1):
        found = []
        for i, x in good:
            found.append((i, *min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centroids)), x))
        if turn < rounds:
            for n in range(len(centroids)):
                own = [x for _, _, c, x in found if c == n]
                if own:
                    centroids[n] = [sum(x[j] for x in own) // len(own) for j in range(dimension)]
    return sorted((i, c, d) for i, d, c, _ in found), centroids


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_clusters_equal_a_plain_scan(spark, spread):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 1, (5, 6))
    rows = [(i, [float(t) for t in np.float32(middles[i % 5] + rng.normal(0, spread, 6))]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(30)] + [(7, rows[7][1]), (8, _vec(rng, 6))]  # copies, repeated ids
    bad = [(900 + i, v) for i, v in enumerate(BAD)] + [(910, [1.0] * 5), (None, [1.0] * 6)]
    df = _frame(spark, [(i, v, 0) for i, v in rows + bad])
    vectors, centroids = centroid_clusters.centroid_clusters(df, k=7, rounds=3, dimension=6)
    expected, middles = _kmeans(rows, 7, 3, 6, 64.0)
    got = vectors.collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == expected
    told = {r.cluster: r for r in centroids.collect()}
    assert [list(told[c].centroid) for c in range(7)] == middles
    sizes, inertia = Counter(c for _, c, _ in expected), Counter()
    for _, c, d in expected:
        inertia[c] += d
    assert all(told[c].n == sizes[c] and told[c].inertia == inertia[c] for c in range(7))
    if spread < 1:  # well apart: the bounds spare most scans
        assert sum(r.scans for r in got) < 2.5 * len(got)


def test_clusters_with_ties_and_empty_ones(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)]  # two places, sixteen starts: ties go to the smaller number
    df = _frame(spark, [(i, v, 0) for i, v in rows])
    vectors, centroids = centroid_clusters.centroid_clusters(df, k=16, rounds=3, dimension=2)
    expected, middles = _kmeans(rows, 16, 3, 2, 64.0)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in vectors.collect()) == expected
    assert [list(r.centroid) for r in centroids.orderBy("cluster").collect()] == middles
    few = _frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])  # equal starts: all go to the first
    assert {(r.vec_id, r.cluster, r.distance) for r in centroid_clusters.centroid_clusters(few, dimension=2)[0].collect()} == {(1, 0, 0), (2, 0, 0)}
    none = centroid_clusters.centroid_clusters(_frame(spark, []))
    assert none[0].collect() == [] and none[1].collect() == []
    with pytest.raises(Exception, match="fit a long"):
        centroid_clusters.centroid_clusters(_frame(spark, [(1, [3e9], 0)]), dimension=1)


def test_loosening_bounds_every_point_of_the_sphere():
    rng = np.random.default_rng(5)
    less = 0
    for _ in range(200):
        d = int(rng.integers(2, 6))
        old, new = rng.normal(0, 3, (3, d)), rng.normal(0, 3, (3, d))
        new = old + (new - old) * rng.choice([0.01, 0.3, 1.0])
        radii = rng.uniform(0, 3, 3)
        bound = centroid_clusters.loosening(old, new, radii)
        drift = np.linalg.norm(new - old, axis=1)
        assert (bound <= drift * (1 + 1e-9)).all()
        less += (bound < 0.9 * drift).sum()
        for i in range(3):
            ways = rng.normal(0, 1, (400, d))
            points = old[i] + radii[i] * ways / np.linalg.norm(ways, axis=1)[:, None]
            gain = np.linalg.norm(points[:, None] - old, axis=2) - np.linalg.norm(points[:, None] - new, axis=2)
            assert (gain.max(axis=0) <= bound[i] + 1e-9).all()
    assert less > 200  # it is the full drift only for some


def _whitened(rows, components):
    x = np.array([[int(np.floor(64 * float(np.float32(t)))) + 1_000_000 for t in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    centred = np.array((n * x - s) / n, float)
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    kept = min(components, int((values > 1e-9 * values[0]).sum()))
    return [int(t) for t in ((n * x - s) ** 2).sum(axis=1)], values, centred @ (axes[:, :kept] / np.sqrt(values[:kept])), cov


@pytest.mark.parametrize("rank", [5, 3])
def test_whitening_equals_an_eigendecomposition(spark, rank):
    rng = np.random.default_rng(2)
    basis = rng.normal(0, 1, (rank, 5)) * (4.0 ** np.arange(rank))[:, None]
    if rank < 5:  # whole numbers over 64 keep the rank
        basis = np.round(basis)
    rows = [(i, [float(t) for t in np.float32((rng.integers(-9, 9, rank) if rank < 5 else rng.normal(0, 1, rank)) @ basis)]) for i in range(200)]
    rows += [(50, rows[50][1]), (300, rows[9][1])]
    df = _frame(spark, [(i, v, 0) for i, v in rows + [(900 + i, v) for i, v in enumerate(BAD)] + [(None, [1.0] * 5)]])
    got, models = whitening.whiten(df, components=4)
    deviations, values, w, cov = _whitened(rows, 4)
    kept = min(4, rank)
    assert list(models) == [5] and models[5]["n"] == 202 and len(models[5]["values"]) >= rank
    assert np.allclose(models[5]["values"][:rank], values[:rank], rtol=1e-9)
    found = {}
    for r in got.collect():
        assert r.n == 202 and abs(r.explained - values[r.component - 1] / cov.trace()) < 1e-9 and r.identity_error < 1e-8
        found.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    for (i, _), deviation, line in zip(rows, deviations, w, strict=True):
        own = found[i, deviation]
        assert sorted(own) == list(range(1, kept + 1))
        for c in range(kept):
            sign = np.sign(np.dot(models[5]["vectors"][:, c], np.linalg.eigh(cov)[1][:, ::-1][:, c]))
            assert min(abs(v - sign * line[c]) for v in own[c + 1]) < 1e-6
    assert sum(len(v) for own in found.values() for v in own.values()) == len(rows) * kept


def test_whitening_of_lengths_equal_rows_and_nothing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, _vec(rng, 3)) for i in range(20)] + [(100 + i, _vec(rng, 2)) for i in range(20)] + [(200, [1.0] * 4), (201, [1.0] * 4)]
    got, models = whitening.whiten(_frame(spark, [(i, v, 0) for i, v in rows]))
    assert {d: m["n"] for d, m in models.items()} == {2: 20, 3: 20, 4: 2} and models[4]["kept"] == 0
    assert Counter(r.vec_id for r in got.collect()) == {i: len(v) for i, v in rows if len(v) < 4}
    assert whitening.whiten(_frame(spark, []))[0].collect() == []
    far = [(i, [1e9 * (i % 2), float(i)]) for i in range(9)]  # squares beyond a long
    assert {(r.vec_id, r.deviation) for r in whitening.whiten(_frame(spark, [(i, v, 0) for i, v in far]))[0].collect()} == {(i, d if d < 2**63 else None) for (i, _), d in zip(far, _whitened(far, 2)[0], strict=True)}


def test_cholesky_and_jacobi_keep_small_eigenvalues():
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.normal(0, 1, (8, 8)))[0]
    wanted = 10.0 ** -np.arange(8)
    m = (q * wanted) @ q.T
    factor = whitening.pivoted_cholesky(m)
    assert np.allclose(factor @ factor.T, m, atol=1e-14)
    values, axes = whitening.one_sided_jacobi(factor)
    assert np.allclose(values, wanted, rtol=1e-6) and np.allclose(axes.T @ axes, np.eye(8), atol=1e-10)


def _near(rows, similarity):
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(t is not None and np.isfinite(t) for t in v) and any(v)]
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in good}
    root, n, pairs = list(range(len(rows))), Counter(), 0

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for p, a in enumerate(good):
        for b in good[p + 1 :]:
            if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= similarity:
                n[a] += 1
                n[b] += 1
                pairs += 1
                root[find(a)] = find(b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, n[k], low[find(k)], i == low[find(k)]) for k, (i, _, _) in enumerate(rows)), pairs


@pytest.mark.parametrize("leaf", [16, 512])
def test_near_copies_equal_all_pairs(spark, leaf):
    rng = np.random.default_rng(8)
    rows = [(i, _vec(rng, 16), i % 2) for i in range(200)]
    for k in range(60):  # small groups, one copy each at some angle
        v = np.array(rows[k][1])
        rows.append((300 + k, [float(t) for t in np.float32(v + rng.normal(0, 0.05 + 0.2 * (k % 2), 16))], rows[k][2]))
    middle = rng.normal(0, 1, 16)
    rows += [(500 + k, [float(t) for t in np.float32(middle + rng.normal(0, 0.12, 16))], 1) for k in range(120)]  # a hot group
    rows += [(700 + k, rows[3][1], rows[3][2]) for k in range(50)]  # exact copies
    rows += [(3, rows[3][1], rows[3][2]), (800, [2 * t for t in rows[4][1]], rows[4][2]), (801, rows[4][1], 5), (802, rows[4][1], None), (803, [0.0] * 16, 1), (804, rows[4][1][:8], rows[4][2])]
    rows += [(900 + k, v, 1) for k, v in enumerate(BAD)]
    expected, pairs = _near(rows, 0.93)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_copies(_frame(spark, [*rows, (None, [1.0] * 16, 1)]), leaf=leaf).collect())
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert all(g[1] <= e[1] for g, e in zip(got, expected, strict=True))  # never a link too many
    if leaf == 512:
        assert got == expected
    else:
        assert sum(g[1] for g in got) >= 0.98 * 2 * pairs
        assert sum(g[2] == e[2] for g, e in zip(got, expected, strict=True)) >= 0.99 * len(rows)


def test_forest_finds_pairs_at_the_threshold(spark):
    """Recall over pairs at cosines just above the similarity, which trees part most often."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(600):
        a, b = rng.normal(0, 1, 64), rng.normal(0, 1, 64)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.931 + 0.01 * rng.random()
        rows += [(2 * k, [float(t) for t in a], 0), (2 * k + 1, [float(t) for t in c * a + np.sqrt(1 - c * c) * b], 0)]
    got = embedding_dedup.near_copies(_frame(spark, rows), leaf=32).collect()
    assert sum(r.n_links for r in got) >= 0.98 * 1200


def test_near_copies_of_nothing(spark):
    assert embedding_dedup.near_copies(_frame(spark, [])).collect() == []
    only = embedding_dedup.near_copies(_frame(spark, [(1, None, 1), (2, [1.0], None)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in only) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_depth_grows_with_the_points():
    depths = [embedding_dedup.depth_and_trees(n, 512) for n in (10, 512, 5000, 10**6, 10**9)]
    assert depths[:2] == [(0, 1)] * 2 and depths == sorted(depths)
