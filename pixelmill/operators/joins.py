"""Joins: lookups, estimates, overlaps and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_up, savings
from ..sources.folders import cut, with_few

# Typical compressed size as a share of three bytes a pixel, by quality.
QUALITIES = [100, 95, 90, 85, 80, 75, 70, 60, 50]
SIZE_RATIOS = {
    "jpeg": [0.50, 0.25, 0.18, 0.15, 0.12, 0.10, 0.08, 0.06, 0.05],
    "webp": [0.40, 0.18, 0.12, 0.09, 0.07, 0.06, 0.05, 0.04, 0.03],
    "avif": [0.30, 0.12, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.02],
    "png": [0.35],
}
LADDER = [100, 92, 85, 70]
# Id, format, quality, longest width and height.
PRESETS = [("photo", "webp", 78, 2560, 1440), ("graphic", "png", 85, None, None), ("social", "jpeg", 72, 1200, 1200), ("custom", "auto", 80, None, None)]
#: Side of the grid cells that box overlaps are looked up by.
CELL = 64


def size_ratios(spark: SparkSession) -> DataFrame:
    rows = [(f, q, r) for f, ratios in SIZE_RATIOS.items() for q, r in zip(QUALITIES, ratios, strict=False)]
    return spark.createDataFrame(rows, "format string, quality int, ratio double")


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "id string, format string, quality int, max_width int, max_height int")


def new_only(incoming: DataFrame, library: DataFrame) -> DataFrame:
    """Incoming files whose hash the library does not hold."""
    return incoming.join(library.select("hash"), "hash", "left_anti")


def apply_preset(jobs: DataFrame, known: DataFrame, default: str | None = None) -> DataFrame:
    """The preset's options; an unknown id takes the default, or else the first of ``known``. ``known`` holds a few rows."""
    ids = [r["id"] for r in known.select("id").collect()]  # a table of presets is small by nature
    first = F.lit(default if default in ids else ids[0] if ids else None)
    named = known.select(F.col("id").alias("preset"), F.col("format").alias("preset_format"), F.col("quality").alias("preset_quality"), "max_width", "max_height")
    graphic = F.col("preset") == "graphic"
    found = F.when(F.col("preset_id").isin(ids), F.col("preset_id")).otherwise(first)
    return jobs.withColumn("preset", found).join(F.broadcast(named), "preset", "left").withColumn("dithering", F.when(graphic, 0).otherwise(1)).withColumn("lossless", graphic)


def _segments(ratios: DataFrame) -> DataFrame:
    """Stretches of quality between two points of a format's curve; open at both ends."""
    by = Window.partitionBy("format").orderBy("quality")
    points = ratios.withColumn("next_quality", F.lead("quality").over(by)).withColumn("next_ratio", F.lead("ratio").over(by)).withColumn("n", F.row_number().over(by))
    return points.select(F.col("format").alias("curve"), F.when(F.col("n") == 1, -(10**6)).otherwise(F.col("quality")).alias("low"), F.coalesce("next_quality", F.lit(10**6)).alias("high"), "quality", "ratio", "next_quality", "next_ratio")


def estimate_size(jobs: DataFrame, ratios: DataFrame) -> DataFrame:
    """``job_*`` rows with the estimated bytes. ``ratios`` is one small table of curves.

    Each job meets exactly one segment of its format's curve: an equi-join on the
    curve with a range on quality, the curves broadcast.
    """
    fmt = F.col("format")
    curves = [r["format"] for r in ratios.select("format").distinct().collect()]  # a few
    curve = F.when(fmt == "auto", F.lit("webp")).when(fmt.isin(curves), fmt).otherwise(F.lit("jpeg"))
    seg = _segments(ratios).withColumnRenamed("quality", "seg_quality")
    j = jobs.withColumn("curve", curve).join(F.broadcast(seg), "curve").where((F.col("quality") >= F.col("low")) & (F.col("quality") < F.col("high")))
    q = F.col("quality")
    t = (q - F.col("seg_quality")) / (F.col("next_quality") - F.col("seg_quality"))
    line = F.col("ratio") + t * (F.col("next_ratio") - F.col("ratio"))
    r = F.when(F.col("next_quality").isNull() | (q <= F.col("seg_quality")), F.col("ratio")).otherwise(line)
    return j.withColumn("estimated_size", half_up(F.col("width") * F.col("height") * 3 * r)).drop("curve", "low", "high", "seg_quality", "ratio", "next_quality", "next_ratio")


def quality_ladder(jobs: DataFrame, ratios: DataFrame) -> DataFrame:
    """The estimate at each step of the ladder, and whether the job asked for it."""
    steps = jobs.withColumn("asked", F.col("quality")).withColumn("quality", F.explode(F.array(*map(F.lit, LADDER))))
    return estimate_size(steps, ratios).withColumn("selected", F.col("quality") == F.col("asked"))


#: Boxes of a cell that are dealt out as one; cells with more are split.
CELL_BOXES = 4096


def _level(cell: int):
    """The grid whose cells are no smaller than a box: side ``cell * 2 ** level``."""
    side = F.greatest("w", "h").cast("double") / cell
    return F.when(side <= 1, 0).otherwise(F.ceil(F.log2(side))).cast("int")


def overlap_join(boxes: DataFrame, queries: DataFrame, cell: int = CELL, cell_boxes: int = CELL_BOXES) -> DataFrame:
    """Boxes that a query box touches; query boxes of side 5 and less are ignored.

    Grids come in levels, each of twice the cell side of the one before. A box
    lives at the level of its own size, where it lies in at most four cells. A pair
    meets at the higher of its two levels: there the query is laid out for boxes
    that are no larger, and the box for queries that are smaller. So a side is laid
    out once for each level that the other side has, in four cells at most, however
    large a box is. A pair is kept in the cell where its overlap begins, which needs
    no distinct. Cells with many boxes are split, and their queries go to each part.
    Boxes with a null place or side touch nothing; negative sides count as given.
    """
    placed = lambda df: df.where("x is not null and y is not null and w is not null and h is not null").withColumn("level", _level(cell))
    b = placed(boxes)
    q = placed(queries.where("w > 5 AND h > 5")).select("qid", *(F.col(c).alias(f"q{c}") for c in ("x", "y", "w", "h")), F.col("level").alias("q_level"))
    # at most some sixty numbers each
    levels = [sorted(r[0] for r in df.select(c).distinct().collect()) for df, c in ((b, "level"), (q, "q_level"))]
    own = lambda values, keep: F.filter(F.array(*map(F.lit, values)), keep) if values else F.array().cast("array<int>")

    def cells(df: DataFrame, at, p: str) -> DataFrame:
        df = df.withColumn("at", F.explode(at)).withColumn("side", F.pow(F.lit(2.0), F.col("at")) * cell)
        span = lambda low, size: F.sequence(F.floor(F.col(low) / F.col("side")), F.floor((F.col(low) + F.greatest(F.col(size), F.lit(0))) / F.col("side")))
        return df.withColumn("cx", F.explode(span(f"{p}x", f"{p}w"))).withColumn("cy", F.explode(span(f"{p}y", f"{p}h")))

    # boxes: at every level of a query that is theirs or higher; queries: at their own, and at higher ones of boxes
    b = cells(b, F.array_union(F.array("level"), own(levels[1], lambda x: x > F.col("level"))), "")
    q = cells(q, F.array_union(F.array("q_level"), own(levels[0], lambda x: x > F.col("q_level"))), "q").drop("side")
    key = ["at", "cx", "cy"]
    hot = b.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > cell_boxes).select(*key, F.ceil(F.col("n") / cell_boxes).cast("int").alias("parts"))
    hot = cut(hot)
    b = with_few(b, hot, key, "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    q = with_few(q, hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    both = b.join(q, [*key, "part"]).where(F.col("at") == F.greatest("level", "q_level"))
    touch = (F.col("x") <= F.col("qx") + F.col("qw")) & (F.col("x") + F.col("w") >= F.col("qx")) & (F.col("y") <= F.col("qy") + F.col("qh")) & (F.col("y") + F.col("h") >= F.col("qy"))
    here = (F.col("cx") == F.floor(F.greatest("x", "qx") / F.col("side"))) & (F.col("cy") == F.floor(F.greatest("y", "qy") / F.col("side")))
    return both.where(touch & here).select("qid", "id")


def resolve_blob(outcomes: DataFrame, catalog: DataFrame) -> DataFrame:
    """The output where there is one, else the original; ``catalog`` has id and original_blob."""
    return outcomes.join(catalog, "id", "left").withColumn("resolved_blob", F.coalesce("output_blob", "original_blob"))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Size delta, savings and the wider aspect ratio of two runs of the same images."""
    side = lambda df, p: df.select("id", *(F.col(c).alias(f"{p}_{c}") for c in ("width", "height", "size")))
    both = side(before, "before").join(side(after, "after"), "id")
    aspect = F.greatest(F.col("before_width") / F.col("before_height"), F.col("after_width") / F.col("after_height"))
    return both.withColumn("delta", F.col("after_size") - F.col("before_size")).withColumn("savings", savings(F.col("before_size"), F.col("after_size"))).withColumn("aspect", aspect)


def overlay(pixels: DataFrame, mark: DataFrame, position: str = "bottom-right", opacity: int = 50, padding: int = 10) -> DataFrame:
    """Lay one overlay raster over every image. ``mark`` has one image's pixels, width and height.

    The overlay's colour is mixed by its own alpha times the opacity; it is joined
    by its shifted place. Parts outside of the image are cut off.
    """
    ow, oh = F.col("o_width"), F.col("o_height")
    right, low = F.col("width") - ow - padding, F.col("height") - oh - padding
    mid_x, mid_y = F.floor((F.col("width") - ow) / 2), F.floor((F.col("height") - oh) / 2)
    at = {"top-left": (F.lit(padding), F.lit(padding)), "top-right": (right, F.lit(padding)), "bottom-left": (F.lit(padding), low), "bottom-right": (right, low)}
    left, top = at.get(position, (mid_x, mid_y))
    o = mark.select(F.col("width").alias("o_width"), F.col("height").alias("o_height"), F.col("x").alias("ox"), F.col("y").alias("oy"), *(F.col(c).alias(f"o_{c}") for c in "rgba"))
    size = mark.agg(F.max("width").alias("o_width"), F.max("height").alias("o_height"))
    placed = pixels.crossJoin(F.broadcast(size)).withColumn("ox", (F.col("x") - left).cast("int")).withColumn("oy", (F.col("y") - top).cast("int")).drop("o_width", "o_height")
    both = placed.join(o.drop("o_width", "o_height"), ["ox", "oy"], "left")
    share = F.col("o_a") / 255.0 * (opacity / 100.0)
    mixed = [F.when(F.col("o_a").isNull(), F.col(c)).otherwise(half_up(F.col(c) * (1 - share) + F.col(f"o_{c}") * share)).cast("int").alias(c) for c in "rgb"]
    return both.select("image_id", "width", "height", "x", "y", *mixed, "a")
