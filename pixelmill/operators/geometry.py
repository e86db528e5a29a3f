"""Crops, rotations and resizes of the pixel grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_up
from ..sources.folders import cut, with_few
from .lines import WHOLE, crop_lines, edit_images, filter_lines, pack, resize_lines, transform_lines, trim_lines, unpack
from .stats import content_bounds


def crop(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """G1: the pixels of each image's box (``image_id, x, y, w, h``), with places counted from it."""
    box = boxes.select("image_id", *(F.col(c).alias(f"b_{c}") for c in ("x", "y", "w", "h")))
    both = with_few(pixels, box, "image_id").where((F.col("x") >= F.col("b_x")) & (F.col("y") >= F.col("b_y")) & (F.col("x") < F.col("b_x") + F.col("b_w")) & (F.col("y") < F.col("b_y") + F.col("b_h")))
    side = lambda size, low, own: (F.least(F.col(low) + F.col(size), F.col(own)) - F.greatest(F.col(low), F.lit(0))).cast("int")
    return both.select("image_id", side("b_w", "b_x", "width").alias("width"), side("b_h", "b_y", "height").alias("height"), (F.col("x") - F.greatest("b_x", F.lit(0))).cast("int").alias("x"), (F.col("y") - F.greatest("b_y", F.lit(0))).cast("int").alias("y"), "r", "g", "b", "a")


def transform(pixels: DataFrame, ops: DataFrame) -> DataFrame:
    """Rotate clockwise by 0, 90, 180 or 270, then flip; ``ops`` is ``image_id, rotate, flip_h, flip_v``."""
    p = with_few(pixels, ops, "image_id", "left").withColumn("rotate", F.coalesce("rotate", F.lit(0)))
    turn, w, h, x, y = F.col("rotate"), F.col("width"), F.col("height"), F.col("x"), F.col("y")
    swap = turn.isin(90, 270)
    nx = F.when(turn == 90, h - 1 - y).when(turn == 180, w - 1 - x).when(turn == 270, y).otherwise(x)
    ny = F.when(turn == 90, x).when(turn == 180, h - 1 - y).when(turn == 270, w - 1 - x).otherwise(y)
    p = p.select("image_id", F.when(swap, h).otherwise(w).alias("width"), F.when(swap, w).otherwise(h).alias("height"), nx.alias("x"), ny.alias("y"), "r", "g", "b", "a", F.coalesce("flip_h", F.lit(False)).alias("fh"), F.coalesce("flip_v", F.lit(False)).alias("fv"))
    return p.select("image_id", "width", "height", F.when(F.col("fh"), F.col("width") - 1 - F.col("x")).otherwise(F.col("x")).alias("x"), F.when(F.col("fv"), F.col("height") - 1 - F.col("y")).otherwise(F.col("y")).alias("y"), "r", "g", "b", "a")


def auto_trim(pixels: DataFrame, threshold: int = 25) -> DataFrame:
    """Crop each image to its content; images without bounds stay whole."""
    size = pixels.groupBy("image_id").agg(F.first("width").alias("fw"), F.first("height").alias("fh"))
    box = size.join(content_bounds(pixels, threshold), "image_id", "left")
    whole = {"x": F.lit(0), "y": F.lit(0), "w": F.col("fw"), "h": F.col("fh")}
    return crop(pixels, box.select("image_id", *(F.coalesce(F.col(c), d).alias(c) for c, d in whole.items())))


def premultiply(pixels: DataFrame) -> DataFrame:
    """Colours times alpha."""
    return pixels.select("image_id", "width", "height", "x", "y", *(half_up(F.col(c) * (F.col("a") / 255.0)).cast("int").alias(c) for c in "rgb"), "a")


def unpremultiply(pixels: DataFrame) -> DataFrame:
    """Back again; fully transparent pixels are black."""
    back = lambda c: F.when(F.col("a") == 0, 0).otherwise(F.least(F.lit(255), half_up(F.col(c) / F.nullif(F.col("a") / 255.0, F.lit(0.0)))))
    return pixels.select("image_id", "width", "height", "x", "y", *(back(c).cast("int").alias(c) for c in "rgb"), "a")


def resize(pixels: DataFrame, dims: DataFrame, filter: str = "Lanczos3") -> DataFrame:
    """Resize to ``image_id, out_w, out_h``.

    Nearest picks source pixels; the other filters work on premultiplied colour
    along x, then y. Pixels travel packed in lines (``lines``).
    """
    return unpack(resize_lines(pack(pixels), dims, filter))


def apply_edits(pixels: DataFrame, *, trim: int | None = None, boxes: DataFrame | None = None, dims: DataFrame | None = None, filter: str = "Lanczos3", ops: DataFrame | None = None, sharpen_amount: float = 0.0, blur_radius: int = 0) -> DataFrame:
    """Trim, crop, resize, rotate and flip, sharpen, blur, in this order; steps left out do nothing.

    Without a crop or a resize, images of few pixels are edited as a whole where they
    are. Of others pixels are packed into lines once, and unpacked at the end.
    """
    if boxes is None and dims is None:
        few = F.coalesce(F.col("width").cast("long") * F.col("height") <= WHOLE, F.lit(False))
        done = edit_images(pixels.where(few), trim, ops, sharpen_amount, blur_radius)
        pixels = pixels.where(~few)
        if not pixels.limit(1).count():
            return done
        return done.unionByName(edit_lines(pixels, trim=trim, ops=ops, sharpen_amount=sharpen_amount, blur_radius=blur_radius))
    return edit_lines(pixels, trim=trim, boxes=boxes, dims=dims, filter=filter, ops=ops, sharpen_amount=sharpen_amount, blur_radius=blur_radius)


def edit_lines(pixels: DataFrame, *, trim: int | None = None, boxes: DataFrame | None = None, dims: DataFrame | None = None, filter: str = "Lanczos3", ops: DataFrame | None = None, sharpen_amount: float = 0.0, blur_radius: int = 0) -> DataFrame:
    """G8 over packed lines, for images of any size."""
    out = pack(pixels)
    if trim is not None:
        out = trim_lines(cut(out), trim)  # read three times: corners, bounds, crop
    out = crop_lines(out, boxes) if boxes is not None else out
    out = resize_lines(out, dims, filter) if dims is not None else out
    out = transform_lines(out, ops) if ops is not None else out
    return unpack(filter_lines(out, sharpen_amount, blur_radius))
