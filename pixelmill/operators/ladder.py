"""Choosing a quality, or a smaller size, from trial encodes held as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_up
from .joins import LADDER, estimate_size

RESIZE_STEPS, RESIZE_FACTOR, LEAST_SIDE = 3, 0.75, 100


def pick_for_target(trials: DataFrame) -> DataFrame:
    """For each id, the highest quality within ``target_bytes``, else the smallest trial.

    Trials are ``id, quality, bytes, target_bytes``; no target is always met. One
    aggregation; ties in size go to the higher quality.
    """
    fits = F.col("target_bytes").isNull() | (F.col("bytes") <= F.col("target_bytes"))
    t = F.struct("quality", "bytes")
    best = trials.groupBy("id").agg(F.max_by(t, F.when(fits, F.col("quality"))).alias("met"), F.min_by(t, F.struct("bytes", -F.col("quality"))).alias("least"), F.max("target_bytes").alias("target_bytes"))
    got = F.coalesce("met", "least")
    text = F.concat(F.lit("Could not meet target size of "), half_up(F.col("target_bytes") / 1024).cast("string"), F.lit("KB (best: "), half_up(got["bytes"] / 1024).cast("string"), F.lit("KB)"))
    return best.select("id", got["quality"].alias("quality"), got["bytes"].alias("bytes"), F.col("met").isNotNull().alias("met"), F.when(F.col("met").isNull(), text).alias("warning"))


def resize_fallback(jobs: DataFrame, ratios: DataFrame, qualities: tuple[int, ...] = tuple(LADDER)) -> DataFrame:
    """The first of up to three reductions by a quarter at which some quality meets the target.

    Jobs without a target are left out. Where no step meets it, the last step's
    smallest trial is taken.
    """
    shrink = lambda side: F.aggregate(
        F.when(F.col("step") > 0, F.sequence(F.lit(1), F.greatest(F.col("step"), F.lit(1)))).otherwise(F.array().cast("array<int>")),
        F.col(side).cast("long"),
        lambda s, _: F.greatest(half_up(s * RESIZE_FACTOR), F.lit(LEAST_SIDE)).cast("long"),
    )
    steps = jobs.where("target_kb IS NOT NULL").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(RESIZE_STEPS))))
    steps = steps.select("id", "format", "target_kb", "step", shrink("width").alias("width"), shrink("height").alias("height"), F.explode(F.array(*map(F.lit, qualities))).alias("quality"))
    trials = estimate_size(steps, ratios).withColumn("met", F.col("estimated_size") <= F.col("target_kb") * 1024)
    t = F.struct("step", "width", "height", "quality", F.col("estimated_size").alias("bytes"), "met")
    first = F.struct(~F.col("met"), F.when(F.col("met"), F.col("step")).otherwise(-F.col("step")), F.when(F.col("met"), -F.col("quality").cast("double")).otherwise(F.col("estimated_size").cast("double")), -F.col("quality"))
    return trials.groupBy("id").agg(F.min_by(t, first).alias("t")).select("id", "t.*")


def size_guard(trials: DataFrame) -> DataFrame:
    """An output no smaller than its original is retried at lower qualities, else given up.

    Trials are ``id, quality, bytes, original_size, asked`` with the trial at the
    asked quality among them. Retries go from min(asked, 70) down by tens, each
    begun while the last was 40 or more; the first below the original wins.
    """
    top = F.least("asked", F.lit(70))
    down = (top - F.col("quality")).cast("int")
    retry = (F.col("quality") < top) & (down % 10 == 0) & (F.col("quality") + 10 >= 40)
    small = F.col("bytes") < F.col("original_size")
    t = F.struct("quality", "bytes")
    got = trials.groupBy("id").agg(
        F.max_by(t, F.when((F.col("quality") == F.col("asked")) & small, F.lit(1))).alias("own"),
        F.max_by(t, F.when(retry & small, F.col("quality"))).alias("lower"),
        F.max("original_size").alias("original_size"),
    )
    use = F.coalesce("own", "lower")
    return got.select("id", use["quality"].alias("quality"), F.coalesce(use["bytes"], "original_size").alias("bytes"), use.isNull().alias("kept_original"), F.when(use.isNull() | (F.col("original_size") == 0), 0.0).otherwise((F.col("original_size") - use["bytes"]) / F.col("original_size") * 100).alias("savings"))
