"""Aggregations over pixels and outcomes, and the image classes built from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_up
from ..sources.folders import with_few

SAMPLE = 10_000
#: Relative standard error of estimates of colours: among millions of images none is likely to be ten times as far off.
SKETCH_ERROR = 0.02
GRAPHIC_BELOW, PHOTO_ABOVE = 5_000, 50_000


def library_totals(outcomes: DataFrame) -> DataFrame:
    """A1: totals over successful rows; compressed 0 or null counts as the original."""
    size = F.coalesce(F.nullif("compressed_size", F.lit(0)), "original_size")
    t = outcomes.where(F.col("raw_status") != "error").agg(F.count("*").alias("images"), F.coalesce(F.sum("original_size"), F.lit(0)).alias("original"), F.coalesce(F.sum(size), F.lit(0)).alias("compressed"))
    return t.withColumn("saved", F.col("original") - F.col("compressed")).withColumn("percent", F.when(F.col("original") > 0, F.col("saved") / F.col("original") * 100).otherwise(0.0))


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """A2: images, KB and the unweighted mean of savings, all rounded, for each batch."""
    saved = F.when(F.col("original_size") > 0, (F.col("original_size") - F.col("compressed_size")) / F.col("original_size") * 100).otherwise(0.0)
    return outcomes.where(F.col("raw_status") != "error").groupBy("batch_id").agg(
        F.count("*").alias("images"), half_up(F.sum("original_size") / 1024).alias("original_kb"), half_up(F.sum("compressed_size") / 1024).alias("compressed_kb"), half_up(F.avg(saved)).alias("savings")
    )


def status_counts(state: DataFrame) -> DataFrame:
    """A3: queued, active, done and failed images of each library, and whether it is idle."""
    status = F.col("status")
    return state.groupBy("library_id").agg(
        F.count_if(status == "queued").alias("queued"),
        F.count_if(status.isin("analyzing", "compressing")).alias("active"),
        F.count_if(status.isin("completed", "already-optimized")).alias("done"),
        F.count_if(status == "error").alias("failed"),
        (F.count_if(status.isin("queued", "analyzing", "compressing")) == 0).alias("idle"),
    )


def premultiplied(c: str) -> Column:
    return half_up(F.col(c) * (F.col("a") / 255.0)).cast("int")


def color_histogram(pixels: DataFrame) -> DataFrame:
    """A4: pixels of each premultiplied colour, added up before the shuffle."""
    return pixels.groupBy("image_id", premultiplied("r").alias("r"), premultiplied("g").alias("g"), premultiplied("b").alias("b"), "a").agg(F.count("*").alias("cnt"))


def _sampled(pixels: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Every step-th pixel, the image's size, and the number of pixels read."""
    n = F.col("width") * F.col("height")
    step = F.greatest(F.lit(1), F.floor(n / F.least(F.lit(SAMPLE), n)))
    return pixels.where((F.col("y") * F.col("width") + F.col("x")) % step == 0), n, F.ceil(n / step)


def _color() -> Column:
    return F.col("r") * 65536 + F.col("g") * 256 + F.col("b")


def unique_colors(pixels: DataFrame, mode: str = "sample") -> DataFrame:
    """A5: distinct colours: an estimate from a systematic sample, exact, or by a sketch."""
    if mode == "exact":
        return pixels.groupBy("image_id").agg(F.count_distinct(_color()).alias("unique_colors"))
    if mode == "approx":
        return pixels.groupBy("image_id").agg(F.approx_count_distinct(_color(), SKETCH_ERROR).alias("unique_colors"))
    some, n, read = _sampled(pixels)
    raw = some.groupBy("image_id", "width", "height").agg(F.count_distinct(_color()).alias("raw"))
    scaled = F.least(half_up(F.col("raw") * (F.ln(n) / F.ln(read))), n)
    return raw.select("image_id", F.when(read >= n, F.col("raw")).otherwise(scaled).cast("long").alias("unique_colors"))


#: Registers of a colour sketch, as a power of two: a relative standard error of some 0.8 %.
SKETCH_BITS = 14
#: Lines of an image that make one sketch.
SKETCH_LINES = 256


def color_sketches(pixels: DataFrame, lines: int = SKETCH_LINES, bits: int = SKETCH_BITS) -> DataFrame:
    """A5: ``image_id, band, sketch``: a mergeable sketch of the colours of each band of lines.

    To be kept as a table: bands that come later, or anew, add rows, and the pixels of
    the others are not read again.
    """
    return pixels.groupBy("image_id", F.floor(F.col("y") / lines).cast("int").alias("band")).agg(F.hll_sketch_agg(_color(), bits).alias("sketch"))


def colors_of(sketches: DataFrame, *by: str) -> DataFrame:
    """A5: distinct colours by the union of sketches, for each value of the columns ``by`` (without any, for each image)."""
    return sketches.groupBy(*(by or ("image_id",))).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_colors"))


def transparency(pixels: DataFrame) -> DataFrame:
    """Share of transparent pixels in the sample, the two flags, and whether any pixel is."""
    n = F.col("width") * F.col("height")
    step = F.greatest(F.lit(1), F.floor(n / F.least(F.lit(SAMPLE), n)))
    clear = F.col("a") < 255
    inside = (F.col("y") * F.col("width") + F.col("x")) % step == 0
    t = pixels.groupBy("image_id", "width", "height").agg(F.count_if(clear & inside).alias("hits"), F.bool_or(clear).alias("any_transparent"))
    ratio = F.col("hits") / F.ceil(n / step)
    return t.select("image_id", ratio.alias("transparency"), (ratio > 0.01).alias("has_transparency"), (ratio > 0.05).alias("has_significant_transparency"), "any_transparent")


def solid_ratio(pixels: DataFrame) -> DataFrame:
    """Share of 4x4 blocks of nearly one colour; blocks begin before side - 4."""
    by, bx = F.floor(F.col("y") / 4).cast("int"), F.floor(F.col("x") / 4).cast("int")
    inside = pixels.where((by * 4 < F.col("height") - 4) & (bx * 4 < F.col("width") - 4))
    spread = sum((F.max(c) - F.min(c) for c in ("g", "b")), F.max("r") - F.min("r"))
    blocks = inside.groupBy("image_id", by.alias("by"), bx.alias("bx")).agg(spread.alias("spread"))
    found = blocks.groupBy("image_id").agg(F.avg((F.col("spread") < 5).cast("double")).alias("solid_ratio"))
    return pixels.select("image_id").distinct().join(found, "image_id", "left").select("image_id", F.coalesce("solid_ratio", F.lit(0.0)).alias("solid_ratio"))


def edge_stats(pixels: DataFrame) -> DataFrame:
    """Hard and smooth neighbour differences on every step-th row."""
    step = F.greatest(F.lit(1), F.floor(F.col("height") / 100))
    row = Window.partitionBy("image_id", "y").orderBy("x")
    near = lambda f: sum((F.abs(F.col(c) - f(c).over(row)) for c in ("g", "b")), F.abs(F.col("r") - f("r").over(row)))
    rows = pixels.where(F.col("y") % step == 0).select("image_id", "width", "height", "x", near(F.lag).alias("before"), near(F.lead).alias("after"))
    inner = (F.col("x") >= 1) & (F.col("x") < F.col("width") - 1)
    d = F.greatest("before", "after")
    found = rows.groupBy("image_id", "width", "height").agg(F.count_if(inner & (d > 100)).alias("hard"), F.count_if(inner & (d > 0) & (d < 30)).alias("smooth"))
    total = F.greatest(F.lit(1), F.col("width") - 2) * F.greatest(F.lit(1), F.ceil(F.col("height") / step))
    hard, smooth = F.col("hard") / total, F.col("smooth") / total
    return found.select("image_id", hard.alias("edge_ratio"), smooth.alias("smooth_ratio"), (hard > 0.05).alias("has_hard_edges"), (smooth > 0.6).alias("has_smooth_gradients"))


#: Bits of a strip's number for a pixel: its line above its column above its colour.
_LINE, _COLUMN = 60, 32
#: Strips that are laid side by side, and their pixels, at most or nearly.
STRIPS, STRIP_PIXELS = 4096, 1 << 20


def _strip_sums(cells: pa.ListArray, width: np.ndarray, height: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Of strips of four lines of one width: whole blocks, those of nearly one colour, sampled transparent pixels, any transparent, hard and smooth neighbours."""
    w, n = int(width[0]), len(cells)
    of, values = np.repeat(np.arange(n), np.diff(cells.offsets.to_numpy())), cells.flatten().to_numpy()
    line, x, color = values >> _LINE, (values >> _COLUMN) & ((1 << _LINE - _COLUMN) - 1), values.astype(np.uint32).view(np.uint8).reshape(-1, 4)
    y = by[of] * 4 + line
    size = w * height.astype(np.int64)
    step = np.maximum(1, size // np.minimum(SAMPLE, size))
    clear = color[:, 3] < 255
    hits = np.bincount(of[clear & ((y * w + x) % step[of] == 0)], minlength=n)
    # neighbours: the next pixel that is there in the same line; those of the first and the last column do not count
    rgb = color[:, :3].astype(np.int32)
    same = np.flatnonzero((of[1:] == of[:-1]) & (line[1:] == line[:-1]))
    gap = np.abs(rgb[same + 1] - rgb[same]).sum(axis=1)
    d = np.full(len(values), -1, np.int32)
    d[same] = gap
    d[same + 1] = np.maximum(d[same + 1], gap)
    d[(x < 1) | (x >= w - 1) | (y % np.maximum(1, height // 100)[of] != 0)] = -1
    hard, smooth = (np.bincount(of[m], minlength=n) for m in (d > 100, (d > 0) & (d < 30)))
    # blocks, of what is there
    columns = -(-w // 4)
    block = of * columns + x // 4
    order = np.argsort(block, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(block[order]) != 0))
    spread = (np.maximum.reduceat(rgb[order], starts) - np.minimum.reduceat(rgb[order], starts)).sum(axis=1)
    owner, bx = np.divmod(block[order][starts], columns)
    whole = (by[owner] * 4 < height[owner] - 4) & (bx * 4 < w - 4)
    blocks, solid = (np.bincount(owner[m], minlength=n) for m in (whole, whole & (spread < 5)))
    return np.stack([blocks, solid, hits, np.bincount(of[clear], minlength=n), hard, smooth])


def texture_stats(pixels: DataFrame) -> DataFrame:
    """A6, A7 and A8 in one pass: one row per image.

    Pixels are collected into strips of four lines, each as one number, which serves the
    neighbours along a row and the 4x4 blocks alike and splits a large image over many
    tasks; only sums of strips go on to the image. Pixels that are dealt by image
    already are not shuffled, and none is sorted by a window.
    """
    kind = pixels.schema["image_id"].dataType.simpleString()
    sums = ["blocks", "solid", "hits", "clear", "hard", "smooth"]
    byte = lambda c, bits: F.shiftleft(F.col(c).cast("long").bitwiseAND(255), bits)
    value = F.shiftleft(F.col("y").cast("long").bitwiseAND(3), _LINE).bitwiseOR(F.shiftleft(F.col("x").cast("long"), _COLUMN))
    for k, c in enumerate("rgba"):
        value = value.bitwiseOR(byte(c, 8 * k))
    strips = pixels.groupBy("image_id", *(F.col(c).cast("int").alias(c) for c in ("width", "height")), F.floor(F.col("y") / 4).cast("int").alias("by")).agg(F.sort_array(F.collect_list(value)).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            widths = whole.column("width").to_numpy()
            for w in np.unique(widths).tolist():
                own = whole.filter(pa.array(widths == w))
                step = max(1, min(STRIPS, STRIP_PIXELS // (4 * max(w, 1))))
                for part in (own.slice(at, step) for at in range(0, own.num_rows, step)):
                    width, height, by = (part.column(c).to_numpy() for c in ("width", "height", "by"))
                    found = _strip_sums(part.column("cells"), width, height, by)
                    # strips of an image that lie side by side are one row
                    ids = part.column("image_id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                    starts = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (height[1:] != height[:-1])))
                    rows = part.select(["image_id", "width", "height"]).take(pa.array(starts))
                    yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(c.astype(np.int64)) for c in np.add.reduceat(found, starts, axis=1))], ["image_id", "width", "height", *sums])

    of_strips = strips.mapInArrow(run, f"image_id {kind}, width int, height int, " + ", ".join(f"{c} long" for c in sums))
    t = of_strips.groupBy("image_id", "width", "height").agg(*(F.sum(c).alias(c) for c in sums))
    n = F.col("width") * F.col("height")
    step = F.greatest(F.lit(1), F.floor(n / F.least(F.lit(SAMPLE), n)))
    edge_step = F.greatest(F.lit(1), F.floor(F.col("height") / 100))
    samples = F.greatest(F.lit(1), F.col("width") - 2) * F.greatest(F.lit(1), F.ceil(F.col("height") / edge_step))
    ratio = F.col("hits") / F.ceil(n / step)
    return t.select(
        "image_id", F.coalesce(F.col("solid") / F.nullif("blocks", F.lit(0)), F.lit(0.0)).alias("solid_ratio"), (ratio > 0.01).alias("has_transparency"), (ratio > 0.05).alias("has_significant_transparency"), (F.col("clear") > 0).alias("any_transparent"),
        (F.col("hard") / samples > 0.05).alias("has_hard_edges"), (F.col("smooth") / samples > 0.6).alias("has_smooth_gradients"),
    )


def classify_images(pixels: DataFrame, mode: str = "sample", graphic_below: int = GRAPHIC_BELOW, photo_above: int = PHOTO_ABOVE) -> DataFrame:
    """Graphic, photo or mixed, with the statistics behind it; one row per image.

    Colours are one pass with sums before the shuffle, everything else another.
    """
    all_ = unique_colors(pixels, mode).join(texture_stats(pixels), "image_id")
    graphic = (F.col("unique_colors") < graphic_below) | (F.col("has_hard_edges") & (F.col("solid_ratio") > 0.3))
    photo = (F.col("unique_colors") > photo_above) & F.col("has_smooth_gradients")
    kind = F.when(graphic, F.lit("graphic")).when(photo, F.lit("photo")).otherwise(F.lit("mixed"))
    return all_.select("image_id", kind.alias("type"), "unique_colors", "has_hard_edges", "has_smooth_gradients", "has_transparency", "has_significant_transparency", "solid_ratio")


def content_bounds(pixels: DataFrame, threshold: int = 25) -> DataFrame:
    """A10: the box of pixels that differ from the corners' mean; no row if all do, or none does."""
    corner = lambda cx, cy: ((F.col("x") == cx) & (F.col("y") == cy)).cast("int")
    right, low = F.col("width") - 1, F.col("height") - 1
    weight = corner(F.lit(0), F.lit(0)) + corner(right, F.lit(0)) + corner(F.lit(0), low) + corner(right, low)
    back = pixels.where(weight > 0).groupBy("image_id").agg(*(F.floor(F.sum(F.col(c) * weight) / 4).alias(f"b{c}") for c in "rgb"))
    other = (F.abs(F.col("r") - F.col("br")) > threshold) | (F.abs(F.col("g") - F.col("bg")) > threshold) | (F.abs(F.col("b") - F.col("bb")) > threshold)
    box = with_few(pixels, back, "image_id").where(other).groupBy("image_id", "width", "height").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    box = box.select("image_id", "x", "y", (F.col("x2") - F.col("x") + 1).alias("w"), (F.col("y2") - F.col("y") + 1).alias("h"), "width", "height")
    return box.where(~((F.col("w") == F.col("width")) & (F.col("h") == F.col("height")))).select("image_id", "x", "y", "w", "h")


def duplicate_report(ranked: DataFrame) -> DataFrame:
    """Files that repeat an earlier hash: number, names, and KB skipped, by hash."""
    return ranked.where("dup_rank > 1").groupBy("hash").agg(F.count("*").alias("skipped"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.sum("size").alias("bytes"))


def duplicate_names(incoming: DataFrame) -> DataFrame:
    """A13 by rows: ``hash, name, size`` of every file that repeats an earlier hash of ``seq, name, hash, size``.

    One row for each name, so a hash with very many files is never one row or one
    task: the first seq of each hash is a sum before the shuffle. Files of equal hash
    and seq all count as first.
    """
    first = incoming.groupBy("hash").agg(F.min("seq").alias("first_seq"))
    return incoming.join(first, "hash").where(F.col("seq") > F.col("first_seq")).select("hash", "name", "size")


def savings_by_format(outcomes: DataFrame) -> DataFrame:
    """Totals by format and over all."""
    size = F.coalesce(F.nullif("compressed_size", F.lit(0)), "original_size")
    t = outcomes.where(F.col("raw_status") != "error").rollup("format").agg(F.count("*").alias("images"), F.sum("original_size").alias("original"), F.sum(size).alias("compressed"), F.grouping_id().cast("int").alias("is_total"))
    return t.withColumn("percent", F.when(F.col("original") > 0, (F.col("original") - F.col("compressed")) / F.col("original") * 100).otherwise(0.0))
