"""Derived grids: keys beyond 64-bit products, and tasks that follow the cells and the images."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pixelmill.operators import stats as A
from pixelmill.plans import catalogue, derived
from pixelmill.sources import files


@pytest.mark.parametrize(("name", "base", "key", "kind", "shift"), [("pixels", "part", "p_partkey", "long", 0), ("pixels_big", "supplier", "s_suppkey", "long", 1_000_000_000)])
def test_seeds_of_large_keys(spark, tmp_path, name, base, key, kind, shift):
    """A key whose product with the multiplier does not fit a long has the seed that the arithmetic says."""
    k = 2_000_000 if name == "pixels" else 7_200_000
    spark.createDataFrame([(5,), (k,)], f"{key} {kind}").write.parquet(f"{tmp_path}/{base}.parquet")
    found = derived.table(spark, str(tmp_path), name).where(F.col("image_id").isin(5 + shift, k + shift) & (F.col("y") < 2)).collect()
    assert len(found) == 2 * 2 * (32 if name == "pixels" else 160)
    for p in found:
        seed = ((p.y * p.width + p.x + (p.image_id - shift) * 7919) * 1103515245 + 12345) % 2**32
        assert (p.r, p.g, p.b) == (seed // 65536 % 256, seed // 256 % 256, seed % 256)


def test_colour_estimates_hold_for_every_image(spark, tmp_path):
    """The image of 1.2 million whose 1024 colours the default sketch takes for 1293, and some beside it."""
    spark.createDataFrame([(k,) for k in (935_730, 935_731, 935_733, 1_079_795)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    pixels = derived.table(spark, str(tmp_path), "pixels")
    exact = {r.image_id: r.unique_colors for r in A.unique_colors(pixels, "exact").collect()}
    near = {r.image_id: r.unique_colors for r in A.unique_colors(pixels, "approx").collect()}
    assert exact[935_730] == 1024 and near.keys() == exact.keys()
    assert all(abs(near[k] - n) <= 0.1 * n for k, n in exact.items())


def test_grids_are_dealt_by_cells_and_images(spark, tmp_path, monkeypatch):
    """A single row group of keys is many tasks, and what goes by image shuffles no pixels."""
    monkeypatch.setattr(derived, "TASK_CELLS", 1 << 15)
    spark.range(1, 301).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    pixels = derived.table(spark, str(tmp_path), "pixels")
    assert pixels.rdd.getNumPartitions() == -(-300 * 1024 // (1 << 15))
    plan = A.color_histogram(pixels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # of the keys


def test_files_are_dealt_into_tasks_and_folders(spark, tmp_path, monkeypatch):
    """One partition of rows is written by several tasks, each into its own folder, and read back whole in few tasks."""
    monkeypatch.setattr(derived, "TASK_FILES", 10)
    rows = spark.range(100).coalesce(1).select(F.concat(F.lit("f"), "id", F.lit(".png")).alias("name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    derived.files_of(rows, f"file://{tmp_path}/all", "in", 100)
    found = [p for p in (tmp_path / "all" / "in").iterdir() if p.is_dir()]
    assert len(found) > 5 and max(len(list(p.iterdir())) for p in found) < 40
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    with files.small_files(spark):
        scanned = files.scan_catalog(spark, f"{tmp_path}/all")
        assert scanned.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1
        assert {(r.name, bytes(r.content)) for r in scanned.collect()} == {(f"f{k}.png", str(k).encode()) for k in range(100)}
    assert spark.conf.get("spark.sql.files.openCostInBytes") == was


def test_rasters_are_packed_from_numbers(spark):
    """Lines of different widths and colours with leading zeros, in no order; what is sorted for each pixel is one number."""
    rows = [(i, w, h, x, y, (x * 7 + i) % 256, y % 256, 255 * (x % 2), 0 if x == 0 else 9) for i, w, h in ((1, 300, 3), (2, 1, 1), (3, 2, 70)) for x in range(w) for y in range(h)]
    pixels = spark.createDataFrame(rows, "image_id long, width int, height int, x int, y int, r int, g int, b int, a int")
    packed = catalogue._packed(pixels.orderBy(F.xxhash64("x", "y")))
    found = {p.image_id: bytes(p.data) for p in packed.collect()}
    for i in (1, 2, 3):
        own = sorted((r for r in rows if r[0] == i), key=lambda r: (r[4], r[3]))
        assert found[i] == bytes(v for r in own for v in r[5:])
    assert "struct" not in packed._jdf.queryExecution().optimizedPlan().toString()


def test_classes_shuffle_no_pixels_that_are_dealt_by_image(spark, tmp_path):
    """All pixels meet in strips where they are: what is shuffled are keys and, at most, sums of strips."""
    spark.range(1, 41).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    pixels = derived.table(spark, str(tmp_path), "pixels")
    for mode in ("sample", "exact"):
        found = A.classify_images(pixels, mode)
        plan = found._jdf.queryExecution().executedPlan().toString()
        for part in plan.split("Exchange ")[1:]:
            assert "x#" not in part.split("\n")[0]
        assert plan.count("Window") == 0 and "by#" not in "".join(p.split("\n")[0] for p in plan.split("Exchange ")[1:])
        assert found.count() == 40


@pytest.mark.parametrize(("width", "height"), [(1, 1), (3, 9), (7, 5), (33, 240), (130, 21)])
def test_texture_equals_its_parts(spark, width, height):
    """The strips' sums give what A6, A7 and A8 give each on its own, for sizes that are no whole blocks, and with holes."""
    rows = [(i, width, height, x, y, *((x * x * 7 + y * 13 + i * 50) % 256 if (x // 6 + y // 5 + i) % 3 else 90 for _ in range(3)), 255 if (x + y) % 11 else 7) for i in (1, 2) for x in range(width) for y in range(height) if i == 1 or (x * y) % 17 != 5]
    pixels = spark.createDataFrame(rows, "image_id long, width int, height int, x int, y int, r int, g int, b int, a int")
    want = A.solid_ratio(pixels).join(A.transparency(pixels), "image_id").join(A.edge_stats(pixels), "image_id")
    found = A.texture_stats(pixels.repartition(3))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select(found.columns).collect()))
