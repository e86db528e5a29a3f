"""Packed lines against plain loops over grids: bands, blocks, turns, sparse and unordered pixels."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.operators import geometry as G
from pixelmill.operators import lines as L
from pixelmill.operators import stats as A
from pixelmill.plans import derived

PX = "image_id long, width int, height int, x int, y int, r int, g int, b int, a int"


def _image(spark, grids, shuffled=0):
    rows = [(i, g.shape[1], g.shape[0], x, y, *map(int, g[y, x])) for i, g in grids.items() for y in range(g.shape[0]) for x in range(g.shape[1])]
    if shuffled:
        random.Random(shuffled).shuffle(rows)
    return spark.createDataFrame(rows, PX)


def _grids(pixels):
    out = {}
    for r in pixels.collect():
        g = out.setdefault(r.image_id, np.full((r.height, r.width, 4), -1))
        assert g.shape == (r.height, r.width, 4) and (g[r.y, r.x] == -1).all()  # each place once
        g[r.y, r.x] = r.r, r.g, r.b, r.a
    assert all((g >= 0).all() for g in out.values())
    return out


def _some(seed, *sizes):
    rng = np.random.default_rng(seed)
    return {i: rng.integers(0, 256, (h, w, 4)) for i, (w, h) in enumerate(sizes)}


def _blur(g, radius):
    if min(g.shape[:2]) < 3:
        return g
    for axis in (1, 0):
        n, g0 = g.shape[axis], np.moveaxis(g, axis, 0)
        g = np.moveaxis(np.stack([g0[max(0, k - radius) : k + radius + 1].sum(axis=0) // (min(n, k + radius + 1) - max(0, k - radius)) for k in range(n)]), 0, axis)
    return g


def _sharp(g, amount):
    out = g.copy()
    h, w = g.shape[:2]
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            for c in range(3):
                v = g[y, x, c]
                out[y, x, c] = math.floor(min(255.0, max(0.0, v + (4.0 * v - float(g[y, x - 1, c] + g[y, x + 1, c] + g[y - 1, x, c] + g[y + 1, x, c])) * amount)))
    return out


def test_pack_and_unpack(spark):
    grids = _some(1, (7, 5), (1, 1), (300, 2))
    for shuffled in (0, 3):
        p = _image(spark, grids, shuffled)
        back = _grids(L.unpack(L.pack(p)))
        assert all((back[i] == g).all() for i, g in grids.items())
    ordered = L.pack(_image(spark, grids).coalesce(1))
    assert ordered.count() == sum(len(g) for g in grids.values())  # one run a line
    none = spark.createDataFrame([], PX)
    assert L.unpack(L.pack(none)).collect() == [] and L.unpack(L.filter_lines(L.pack(none), 0.5, 2)).collect() == []
    sparse = spark.createDataFrame([(1, 9, 9, x, 4, x, 0, 0, 255) for x in (0, 1, 5, 8)], PX)
    assert sorted(r.x for r in L.unpack(L.pack(sparse)).collect()) == [0, 1, 5, 8]


def test_pixels_of_a_line_are_one_run_wherever_they_lie(spark, monkeypatch):
    monkeypatch.setattr(L, "PIECE", 50)
    monkeypatch.setattr(L, "PIECES", 3)
    grids = _some(8, (7, 9), (120, 3))
    runs = L.pack(_image(spark, grids, 5).repartition(6)).collect()
    assert sorted((r.image_id, r.y, r.x0, len(r.data) // 4) for r in runs) == sorted([(0, y, 0, 7) for y in range(9)] + [(1, y, x, min(50, 120 - x)) for y in range(3) for x in (0, 50, 100)])
    assert all(bytes(r.data) == grids[r.image_id][r.y, r.x0 : r.x0 + len(r.data) // 4].astype(np.uint8).tobytes() for r in runs)


@pytest.mark.parametrize(("amount", "radius"), [(0.0, 3), (0.5, 0), (0.5, 2), (0.0, 50)])
def test_filters_across_bands(spark, monkeypatch, amount, radius):
    monkeypatch.setattr(L, "BAND", 5)
    grids = _some(2, (9, 23), (4, 2), (3, 6))
    got = _grids(L.unpack(L.filter_lines(L.pack(_image(spark, grids, 1)), amount, radius)))
    for i, g in grids.items():
        want = _sharp(g, amount) if amount and min(g.shape[:2]) > 2 else g
        assert (got[i] == (_blur(want, radius) if radius else want)).all(), i


@pytest.mark.parametrize("name", ["Nearest", "Bilinear", "Lanczos3"])
def test_resizes_across_bands(spark, monkeypatch, name):
    monkeypatch.setattr(L, "BAND", 4)
    grids = _some(3, (13, 11), (2, 30), (1, 1), (40, 3))
    dims = [(0, 5, 7), (1, 9, 4), (2, 3, 3), (3, 80, 1), (9, 4, 4)]
    got = _grids(G.resize(_image(spark, grids, 2), spark.createDataFrame(dims, "image_id long, out_w int, out_h int"), name))
    for i, w, h in dims[:4]:
        g = grids[i]
        if name == "Nearest":
            want = g[[math.floor((y + 0.5) * g.shape[0] / h) for y in range(h)]][:, [math.floor((x + 0.5) * g.shape[1] / w) for x in range(w)]]
        else:
            want = L._unpremultiplied(L._resampled(L._resampled(L._premultiplied(g), 1, w, name), 0, h, name))
        assert (got[i] == want).all(), i


def test_taps_of_kernels():
    places, weights = L.taps(4, 2, "Bilinear")  # two wide: 1/8, 3/8, 3/8, 1/8 in the middle, cut at the edges
    assert {int(p): int(w) for p, w in zip(places[0], weights[0], strict=True) if w} == {0: 7022, 1: 7022, 2: 2341}
    places, weights = L.taps(8, 8, "Lanczos3")  # equal lengths change nothing
    assert all({int(p): int(w) for p, w in zip(places[k], weights[k], strict=True) if w} == {k: L.UNIT} for k in range(8))
    for name in L.SUPPORT:
        assert np.abs(L.taps(37, 11, name)[1].sum(axis=1) - L.UNIT).max() <= 20


@pytest.mark.parametrize("turn", [0, 90, 180, 270])
def test_turns_and_flips(spark, turn):
    grids = _some(4, (5, 3), (5, 3), (5, 3), (5, 3))
    ops = [(i, turn, bool(i & 1), bool(i & 2)) for i in range(3)] + [(3, None, None, None)]
    ops = spark.createDataFrame(ops, "image_id long, rotate int, flip_h boolean, flip_v boolean")
    p = _image(spark, grids, 5)
    got, plain = _grids(L.unpack(L.transform_lines(L.pack(p), ops))), _grids(G.transform(p, ops))
    for i, g in grids.items():
        want = g if i == 3 else np.rot90(g, -(turn // 90))
        want = want[:, ::-1] if i < 3 and i & 1 else want
        want = want[::-1] if i < 3 and i & 2 else want
        assert (got[i] == want).all() and (plain[i] == want).all()


def test_crop_and_trim_equal_the_pixel_forms(spark):
    grids = _some(6, (9, 8), (6, 6))
    for i, (w, h) in {2: (10, 7), 3: (4, 4)}.items():
        grids[i] = np.full((h, w, 4), 255)
    grids[2][2:5, 3:8] = 9
    p = _image(spark, grids, 7)
    boxes = spark.createDataFrame([(0, -2, 1, 6, 30), (1, 2, 2, 2, 2), (2, 50, 50, 3, 3)], "image_id long, x int, y int, w int, h int")
    rows = lambda df: sorted(map(tuple, df.select("image_id", "width", "height", "x", "y", "r", "g", "b", "a").collect()))
    assert rows(L.unpack(L.crop_lines(L.pack(p), boxes))) == rows(G.crop(p, boxes))
    assert rows(L.unpack(L.trim_lines(L.pack(p), 25))) == rows(G.auto_trim(p, 25))
    assert rows(L.bounds_of_lines(L.pack(p)).selectExpr("image_id", "0 AS width", "0 AS height", "x", "y", "w AS r", "h AS g", "0 AS b", "0 AS a")) == rows(A.content_bounds(p).selectExpr("image_id", "0 AS width", "0 AS height", "x", "y", "w AS r", "h AS g", "0 AS b", "0 AS a"))


def test_a_shuffle_of_lines_is_small(spark):
    """What a blur sends is a few bytes a pixel, not a row for each."""
    p = spark.range(40 * 64 * 64).select((F.col("id") / 4096).cast("long").alias("image_id"), F.lit(64).alias("width"), F.lit(64).alias("height"), (F.col("id") % 64).cast("int").alias("x"), (F.floor(F.col("id") / 64) % 64).cast("int").alias("y"), *(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(256)).cast("int").alias(c) for c in "rgba"))
    packed = L.pack(p)
    assert packed.count() < p.count() / 20 and packed.agg(F.sum(F.octet_length("data"))).first()[0] == 4 * p.count()


def test_images_edited_as_a_whole_equal_those_by_lines(spark, tmp_path):
    """Every turn and flip, holes, borders and single pixels; and neither pixels nor lines are written or shuffled."""
    rng, rows, ops = random.Random(5), [], []
    for i, (width, height) in enumerate([(9, 7), (1, 1), (2, 5), (12, 3), (5, 5), (8, 8), (30, 17), (4, 6), (6, 10), (7, 7), (3, 3), (16, 2)]):
        ops.append((i, (0, 90, 180, 270)[i % 4], i % 3 == 0, i % 5 < 2))
        for y in range(height):
            for x in range(width):
                inside = 1 < x < width - 2 and 0 < y < height - 1
                if i % 2 or rng.random() < 0.8:
                    rows.append((i, width, height, x, y, *((rng.randrange(256) if inside else 255) for _ in range(4))))
    pixels = spark.createDataFrame(rows, "image_id long, width int, height int, x int, y int, r int, g int, b int, a int").repartition(3, "image_id")
    turns = spark.createDataFrame(ops[:-2], "image_id long, rotate int, flip_h boolean, flip_v boolean")
    for trim, own, amount, radius in ((25, turns, 0.25, 2), (None, turns, 0.0, 0), (25, None, 0.5, 0), (None, None, 0.0, 3)):
        want = G.edit_lines(pixels, trim=trim, ops=own, sharpen_amount=amount, blur_radius=radius)
        found = G.apply_edits(pixels, trim=trim, ops=own, sharpen_amount=amount, blur_radius=radius)
        assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    spark.range(1, 41).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    grid = derived.table(spark, str(tmp_path), "pixels")
    plan = G.apply_edits(grid, trim=25, sharpen_amount=0.25, blur_radius=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # of the keys
    large = grid.withColumn("width", F.when(F.col("image_id") == 7, 1 << 14).otherwise(F.col("width")))
    assert G.apply_edits(large, blur_radius=1).count() == 40 * 1024
