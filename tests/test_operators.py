"""The image operators: carried-over analyser cases, hand-made grids, and algebraic properties."""

from __future__ import annotations

import os
import struct
import tempfile
import zlib

import pytest
from pyspark.sql import functions as F

from pixelmill.functions import scalars as P
from pixelmill.operators import geometry as G
from pixelmill.operators import joins as J
from pixelmill.operators import palette as K
from pixelmill.operators import state as S
from pixelmill.operators import stats as A
from pixelmill.operators import stencil as W
from pixelmill.operators import udx
from pixelmill.sources import files

PX = "image_id long, width int, height int, x int, y int, r int, g int, b int, a int"


def raster(spark, w, h, r="0", g="0", b="0", a="255", image=1):
    """Pixels of one image from SQL over i, x, y."""
    i = spark.range(w * h).withColumnRenamed("id", "i").withColumns({"x": F.col("i") % w, "y": F.floor(F.col("i") / w)})
    return i.select(F.lit(image).cast("long").alias("image_id"), F.lit(w).alias("width"), F.lit(h).alias("height"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *(F.expr(f"cast({e} AS int)").alias(c) for c, e in zip("rgba", (r, g, b, a), strict=True)))


def grid(df, c="r"):
    rows = df.select("x", "y", c).collect()
    w, h = max(r.x for r in rows) + 1, max(r.y for r in rows) + 1
    out = [[None] * w for _ in range(h)]
    for r in rows:
        out[r.y][r.x] = r[c]
    return out


def values(df):
    return sorted(map(tuple, df.select("image_id", "width", "height", "x", "y", "r", "g", "b", "a").collect()))


# the analyser's own seven cases


def test_noise_has_many_colors(spark):
    seed = "(i * 1103515245 + 12345) % 4294967296"
    p = raster(spark, 1000, 1000, f"({seed} div 65536) % 256", f"({seed} div 256) % 256", f"{seed} % 256")
    assert A.unique_colors(p).first().unique_colors >= 15000


def test_cycle_is_counted_exactly(spark):
    assert A.unique_colors(raster(spark, 50, 50, "i % 100")).first().unique_colors == 100


@pytest.mark.parametrize(("clear", "significant"), [(1000, True), (300, False)])
def test_transparency(spark, clear, significant):
    r = A.transparency(raster(spark, 100, 100, "128", "128", "128", f"if(i < {clear}, 0, 255)")).first()
    assert (r.has_transparency, r.has_significant_transparency, r.any_transparent) == (True, significant, True)


@pytest.mark.parametrize("side", [1, 2])
def test_tiny_images(spark, side):
    r = A.classify_images(raster(spark, side, side, "128", "128", "128")).first()
    assert (r.type, r.unique_colors, r.solid_ratio) == ("graphic", 1, 0.0)


def test_truncated_raster(spark):
    p = raster(spark, 10, 10).where("y < 5")
    assert A.classify_images(p).first().type == "graphic"


def test_last_block_row_is_left_out(spark):
    p = raster(spark, 8, 8, "if(x >= 4 OR y >= 4, i, 7)")
    assert A.solid_ratio(p).first().solid_ratio == 1.0


def test_blur_truncates_after_each_pass(spark):
    p = raster(spark, 3, 3, "i * 10")
    across = [[(0 + 10) // 2, (0 + 10 + 20) // 3, 15], [35, 40, 45], [65, 70, 75]]
    want = [[(across[0][x] + across[1][x]) // 2 for x in range(3)], [sum(across[y][x] for y in range(3)) // 3 for x in range(3)], [(across[1][x] + across[2][x]) // 2 for x in range(3)]]
    assert grid(W.box_blur(p, 1)) == want


def test_blur_of_constant_and_of_small_images(spark):
    p = raster(spark, 6, 5, "9")
    assert values(W.box_blur(p, 50)) == values(p)
    q = raster(spark, 2, 9, "i")
    assert values(W.box_blur(q, 3)) == values(q)


def test_sharpen(spark):
    p = raster(spark, 3, 3, "if(i = 4, 100, 90)")
    assert grid(W.sharpen(p, 0.5))[1][1] == 120
    assert grid(W.sharpen(p, 0.5))[0] == [90, 90, 90]
    assert values(W.sharpen(p, 0)) == values(p)


def test_smooth_mask(spark):
    m = {(r.x, r.y): r.smooth for r in W.smooth_mask(raster(spark, 6, 3, "if(x < 3, 0, 255)")).collect()}
    assert m[0, 0] and m[5, 2] and not m[2, 1] and not m[3, 1]


def test_rotations_and_flips(spark):
    p = raster(spark, 3, 2, "i")
    ops = lambda t, h, v: spark.createDataFrame([(1, t, h, v)], "image_id long, rotate int, flip_h boolean, flip_v boolean")
    assert grid(G.transform(p, ops(90, False, False))) == [[3, 0], [4, 1], [5, 2]]
    assert grid(G.transform(p, ops(270, False, False))) == [[2, 5], [1, 4], [0, 3]]
    assert grid(G.transform(p, ops(180, True, False))) == [[3, 4, 5], [0, 1, 2]]
    turned = p
    for _ in range(4):
        turned = G.transform(turned, ops(90, False, False))
    assert values(turned) == values(p)
    assert values(G.transform(G.transform(p, ops(0, True, True)), ops(0, True, True))) == values(p)


def test_crop_and_trim(spark):
    p = raster(spark, 8, 8, "if(x BETWEEN 2 AND 4 AND y BETWEEN 3 AND 5, 0, 255)", "255", "255")
    b = A.content_bounds(p).first()
    assert (b.x, b.y, b.w, b.h) == (2, 3, 3, 3)
    t = G.auto_trim(p)
    assert grid(t) == [[0] * 3] * 3 and t.first().width == 3
    box = spark.createDataFrame([(1, 0, 0, 8, 8)], "image_id long, x int, y int, w int, h int")
    assert values(G.crop(p, box)) == values(p)
    assert A.content_bounds(raster(spark, 5, 5, "3")).count() == 0
    assert values(G.auto_trim(raster(spark, 5, 5, "3"))) == values(raster(spark, 5, 5, "3"))


@pytest.mark.parametrize("name", ["Nearest", "Bilinear", "CatmullRom", "Mitchell", "Lanczos3"])
def test_resize_keeps_constants(spark, name):
    p = raster(spark, 6, 4, "70", "80", "90")
    dims = spark.createDataFrame([(1, 9, 3)], "image_id long, out_w int, out_h int")
    out = G.resize(p, dims, name)
    assert out.count() == 27
    assert {(r.r, r.g, r.b, r.a, r.width, r.height) for r in out.collect()} == {(70, 80, 90, 255, 9, 3)}


def test_nearest_resize(spark):
    dims = spark.createDataFrame([(1, 2, 2)], "image_id long, out_w int, out_h int")
    assert grid(G.resize(raster(spark, 4, 4, "i"), dims, "Nearest")) == [[5, 7], [13, 15]]


def test_premultiply(spark):
    p = raster(spark, 2, 1, "200", "100", "50", "if(i = 0, 0, 128)")
    assert grid(G.premultiply(p)) == [[0, 100]]
    assert grid(G.unpremultiply(G.premultiply(p))) == [[0, 199]]


def test_histogram_and_palette(spark):
    p = raster(spark, 16, 16, "i % 5 * 50", "0", "0")
    hist = A.color_histogram(p)
    assert hist.agg(F.sum("cnt")).first()[0] == 256
    few = K.median_cut(hist, 8)
    assert few.count() == 5
    two = K.median_cut(hist, 2)
    assert two.count() == 2 and two.agg(F.sum("cnt")).first()[0] == 256
    near = K.nearest_color(hist, few)
    assert {r.dist for r in near.collect()} == {0}
    left = K.remap(p, hist, K.kmeans_refine(hist, two)).first()
    assert left.colors_left == 2 and left.mse > 0


def test_two_color_box_never_gives_an_empty_side(spark):
    hist = spark.createDataFrame([(1, 0, 0, 0, 255, 90), (1, 9, 0, 0, 255, 1), (1, 200, 0, 0, 255, 1)], "image_id long, r int, g int, b int, a int, cnt long")
    assert sorted(r.cnt for r in K.median_cut(hist, 2).collect()) == [1, 91]


def test_ladder_clamps_and_interpolates(spark):
    jobs = spark.createDataFrame([(1, "jpeg", 92, 100, 100), (2, "gif", 10, 100, 100), (3, "auto", 100, 10, 10), (4, "png", 30, 10, 10)], "id long, format string, quality int, width int, height int")
    got = {r.id: r.estimated_size for r in J.estimate_size(jobs, J.size_ratios(spark)).collect()}
    assert got == {1: round(30000 * (0.18 + 0.4 * 0.07)), 2: 1500, 3: 120, 4: 105}


def test_overlap_touching_counts(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 10, 10), (2, 200, 200, 300, 300)], "id long, x long, y long, w long, h long")
    queries = spark.createDataFrame([(1, 10, 10, 300, 300), (2, 0, 0, 5, 50)], "qid long, x long, y long, w long, h long")
    assert sorted(map(tuple, J.overlap_join(boxes, queries).collect())) == [(1, 1), (1, 2)]


ACTIONS = "seq long, library_id long, image_id long, type string, status string"


def test_state_and_selection(spark):
    log = [
        (1, 1, 1, "ADD_FILES", None), (2, 1, 2, "ADD_FILES", None), (3, 1, 1, "UPDATE_STATUS", "completed"), (4, 1, 0, "SELECT_ALL", None), (5, 1, 3, "ADD_FILES", None),
        (6, 1, 2, "TOGGLE_SELECT", None), (7, 1, 3, "TOGGLE_SELECT", None), (8, 1, 1, "REMOVE_IMAGE", None), (9, 1, 9, "UPDATE_STATUS", "error"), (10, 2, 1, "ADD_FILES", None), (11, 2, 0, "CLEAR_ALL", None),
        (12, 3, 1, "ADD_FILES", None), (13, 3, 1, "UPDATE_STATUS", "error"), (14, 3, 1, "ADD_FILES", None), (15, 3, 0, "SELECT_ALL", None),
    ]
    df = spark.createDataFrame(log, ACTIONS)
    assert sorted(tuple(r) for r in S.library_state(df).collect()) == [(1, 2, 2, "queued"), (1, 3, 5, "queued"), (3, 1, 14, "queued")]
    assert sorted(tuple(r) for r in S.selection_state(df).collect()) == [(1, 3), (3, 1)]


def test_admission_rejects_whole_batches(spark):
    rows = [(1, f"f{i}.png", "", 10) for i in range(101)] + [(2, "a.HEIC", "", 10), (2, "b.exe", "", 10), (2, "c", "image/gif", 60 * 2**20)]
    df = spark.createDataFrame(rows, "batch_id int, name string, mime string, size long")
    assert [r.name for r in P.admit(df).collect()] == ["a.HEIC"]


def png(rows, alpha=False, text=b""):
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 6 if alpha else 2, 0, 0, 0)
    body = zlib.compress(b"".join(b"\0" + bytes(c for px in row for c in px) for row in rows))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"tEXt", text) if text else b"") + chunk(b"IDAT", body) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def pictures():
    path = tempfile.mkdtemp(prefix="spark-")
    rgb, rgba = png([[(1, 2, 3), (4, 5, 6)]], text=b"Title\0x"), png([[(9, 8, 7, 6)], [(1, 1, 1, 255)]], alpha=True)
    row = lambda *px: b"".join(bytes(reversed(p)) for p in px) + b"\0" * (-3 * len(px) % 4)
    pixels = row((10, 20, 30), (40, 50, 60))
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(pixels), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 24, 0, len(pixels), 0, 0, 0, 0) + pixels
    for name, data in (("a.png", rgb), ("copy.png", rgb), ("b.png", rgba), ("c.bmp", bmp), ("junk.png", b"not a png"), ("note.txt", b"x")):
        with open(os.path.join(path, name), "wb") as f:
            f.write(data)
    return path


def test_catalog_rasters_and_pixels(spark, pictures):
    cat = files.scan_catalog(spark, pictures)
    assert sorted(r.name for r in cat.collect()) == ["a.png", "b.png", "c.bmp", "copy.png", "junk.png"]
    assert all(len(r.hash) == 64 for r in cat.collect())
    found = files.explode_pixels(files.read_rasters(spark, pictures)).collect()
    by = {}
    for r in found:
        by.setdefault(r.image_id.rsplit("/", 1)[1], []).append((r.y, r.x, r.r, r.g, r.b, r.a))
    assert sorted(by["a.png"]) == [(0, 0, 1, 2, 3, 255), (0, 1, 4, 5, 6, 255)]
    assert sorted(by["b.png"]) == [(0, 0, 9, 8, 7, 6), (1, 0, 1, 1, 1, 255)]
    assert sorted(by["c.bmp"]) == [(0, 0, 10, 20, 30, 255), (0, 1, 40, 50, 60, 255)]
    assert set(by) == {"a.png", "b.png", "c.bmp", "copy.png"}


def test_png_chunks(spark, pictures):
    df = files.scan_catalog(spark, pictures).select(F.col("name").alias("image_id"), "content")
    got = [(r.seq, r.name, r.length, r.is_metadata) for r in files.png_chunks(df).where("image_id = 'a.png'").orderBy("seq").collect()]
    assert [g[1] for g in got] == ["IHDR", "tEXt", "IDAT", "IEND"] and got[1] == (1, "tEXt", 7, True)
    assert {r.name: r.images for r in files.metadata_audit(df).collect()} == {"tEXt": 2}


@pytest.mark.parametrize(("name", "mime", "head", "want"), [
    ("photo.heic", "", "", "heic"), ("photo.heif", "", "", "heic"), ("photo.HEIC", "", "", "heic"), ("image.png", "image/png", "", "png"), ("image.jpg", "image/jpeg", "", "jpeg"), ("image.webp", "image/webp", "", "webp"),
    ("x", "", "0000001866747970686569630000", "heic"), ("x", "", "00000018667479706D6966310000", "heic"), ("x", "", "89504E470D0A1A0A", "png"), ("x", "", "424D00", "bmp"), ("x", "", "42", None), ("x", "", "", None),
])
def test_sniffing(spark, name, mime, head, want):
    df = spark.createDataFrame([(name, mime, bytes.fromhex(head))], "name string, mime string, content binary")
    assert df.select(files.sniff_format(F.col("content"), F.col("name"), F.col("mime"))).first()[0] == want


def test_write_outcomes(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="spark-"), "out")
    df = spark.createDataFrame([(1, "a.b.png", "jpeg", "completed"), (2, "c.png", "webp", "error")], "id long, name string, format string, raw_status string")
    files.write_outcomes(df, out)
    assert [(r.id, r.file_name, r.format) for r in spark.read.parquet(out).collect()] == [(1, "optimized-a.b.jpg", "jpeg")]


def test_map_rasters(spark):
    df = spark.createDataFrame([("a", 1, 1, b"\1\2\3\4")], "image_id string, width int, height int, data binary")
    got = udx.map_rasters(df, lambda b: b.assign(n=b["data"].map(len))[["image_id", "n"]], "image_id string, n long").first()
    assert tuple(got) == ("a", 4)


def test_markup(spark):
    text = '<?xml version="1.0"?><!DOCTYPE svg><!-- c --><svg inkscape:x="1" id="">\n  <metadata>m</metadata><path d="M1.2345 2.5"/></svg>'
    df = spark.createDataFrame([(1, text), (2, None)], "id long, markup string")
    safe = {r.id: r for r in P.clean_markup(df).collect()}
    assert safe[1].cleaned == '<svg> <path d="M1.2345 2.5"/></svg>' and safe[2].cleaned is None
    assert P.clean_markup(df, mode="aggressive").where("id = 1").first().cleaned == '<svg> <path d="M1.23 2.5"/></svg>'


def test_large_images_decode_in_linear_time(spark):
    import struct
    import tempfile
    import time

    import numpy as np

    side = 1024
    own = np.random.default_rng(0).integers(0, 256, (side, side, 3), dtype=np.uint8)
    head = b"BM" + struct.pack("<IIIIIIHHIIIIII", 54 + own.size, 0, 54, 40, side, side, 1, 24, 0, 0, 0, 0, 0, 0)
    path = tempfile.mkdtemp(prefix="spark-")
    with open(os.path.join(path, "a.BMP"), "wb") as f:
        f.write(head + own[::-1, :, ::-1].tobytes())
    began = time.time()
    pixels = files.explode_pixels(files.read_rasters(spark, path))
    got = pixels.agg(F.count("*").alias("n"), *(F.sum(F.col(c) * (F.col("x") + F.col("y"))).alias(c) for c in "rgba")).first()
    assert time.time() - began < 30
    place = np.add.outer(np.arange(side), np.arange(side))
    assert got.n == side * side and [got[c] for c in "rgb"] == [int((own[..., k].astype(np.int64) * place).sum()) for k in range(3)] and got["a"] == 255 * int(place.sum())
    assert files.scan_catalog(spark, path).count() == 1


def test_presets_and_curves_come_from_their_tables(spark):
    known = spark.createDataFrame([("mine", "webp", 50, None, None)], "id string, format string, quality int, max_width int, max_height int")
    jobs = spark.createDataFrame([(1, "mine"), (2, "photo"), (3, None)], "id long, preset_id string")
    assert {(r.id, r.preset, r.preset_quality) for r in J.apply_preset(jobs, known).collect()} == {(1, "mine", 50), (2, "mine", 50), (3, "mine", 50)}
    curves = spark.createDataFrame([("own", 0, 0.1), ("own", 100, 0.2)], "format string, quality int, ratio double")
    sized = spark.createDataFrame([(1, 10, 10, 50, "own")], "id long, width int, height int, quality int, format string")
    assert [r.estimated_size for r in J.estimate_size(sized, curves).collect()] == [45]


# boxes of all sizes, in one crowd and far apart


@pytest.mark.parametrize("cell_boxes", [8, 4096])
def test_overlaps_of_boxes_from_1_to_a_million(spark, cell_boxes):
    import random

    rng = random.Random(3)
    size = lambda: int(10 ** rng.uniform(0, 6))
    boxes = [(i, rng.randrange(-(10**6), 10**6), rng.randrange(-(10**6), 10**6), size(), size()) for i in range(150)]
    boxes += [(200 + i, 10, 10, 1 + i % 5, 0) for i in range(60)] + [(300, 0, 0, 64, 64), (301, 64, 64, 64, 128), (302, None, 0, 1, 1), (303, 0, 0, None, 1)]  # a crowd, edges that touch
    queries = [(i, rng.randrange(-(10**6), 10**6), rng.randrange(-(10**6), 10**6), size(), size()) for i in range(60)] + [(100, 0, 0, 20, 20), (101, 0, 0, 5, 900), (102, 64, 0, 64, 64), (103, 12, 9, 6, 6), (104, 0, 0, 10**6, 10**6)]
    want = sorted((q[0], b[0]) for q in queries for b in boxes if None not in b and q[3] > 5 and q[4] > 5 and b[1] <= q[1] + q[3] and b[1] + b[3] >= q[1] and b[2] <= q[2] + q[4] and b[2] + b[4] >= q[2])
    found = J.overlap_join(spark.createDataFrame(boxes, "id long, x long, y long, w long, h long"), spark.createDataFrame(queries, "qid long, x long, y long, w long, h long"), cell_boxes=cell_boxes)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 200


def test_overlaps_of_nothing(spark):
    none = lambda k: spark.createDataFrame([], f"{k} long, x long, y long, w long, h long")
    assert J.overlap_join(none("id"), none("qid")).collect() == []


def test_color_sketches_merge(spark):
    p = raster(spark, 100, 60, "i % 256", "i div 256", "0")
    parts = A.color_sketches(p, lines=20)
    assert parts.count() == 3
    assert abs(A.colors_of(parts).first().unique_colors - 6000) < 0.03 * 6000
    assert abs(A.colors_of(parts.where("band < 2")).first().unique_colors - 4000) < 0.03 * 4000
    again = parts.unionByName(parts)  # a band that comes twice changes nothing
    assert A.colors_of(again).first().unique_colors == A.colors_of(parts).first().unique_colors
    assert {r.band for r in A.colors_of(parts, "image_id", "band").collect()} == {0, 1, 2}


def test_ranks_over_stretches_of_seq(spark):
    import random

    rng = random.Random(4)
    rows = [(s, rng.choice(["a", "a", "a", "b", None])) for s in range(300)] + [(1000, "b"), (10**9, "a")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "seq long, hash string")
    got = {r.seq: r.dup_rank for r in S.rank_duplicates(df, seqs=7).collect()}
    assert got == {s: sum(h == g and q <= s for q, g in rows) for s, h in rows}
    assert {r.name for r in A.duplicate_names(df.selectExpr("seq", "hash", "cast(seq AS string) AS name", "1 AS size").where("hash is not null")).collect()} == {str(s) for s, h in rows if h and got[s] > 1}
