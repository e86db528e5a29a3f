"""Neighbourhood operators over the pixel grid, by bands of lines or by windows along rows and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lines import filter_lines, pack, unpack


def _row(radius: int):
    return Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-radius, radius)


def _column(radius: int):
    return Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-radius, radius)


def filtered(pixels: DataFrame, amount: float = 0.0, radius: int = 0) -> DataFrame:
    """W2 then W1 with one shuffle of packed lines.

    A band of one image is one task's work, so a large image is still many tasks.
    """
    return unpack(filter_lines(pack(pixels), amount, radius)) if amount > 0 or radius > 0 else pixels


def box_blur(pixels: DataFrame, radius: int) -> DataFrame:
    """The mean over rows, then over columns, cut at the edges; each pass truncates."""
    return filtered(pixels, radius=radius) if radius > 0 else pixels


def sharpen(pixels: DataFrame, amount: float) -> DataFrame:
    """A five-point kernel mixed in by amount; borders, alpha and small images stay."""
    return filtered(pixels, amount=amount) if amount > 0 else pixels


def smooth_mask(pixels: DataFrame, below: float = 500.0) -> DataFrame:
    """Whether the summed RGB variance of the 3x3 neighbourhood is small; two passes of sums."""
    row, column = _row(1), _column(1)
    squares = F.col("r") * F.col("r") + F.col("g") * F.col("g") + F.col("b") * F.col("b")
    first = pixels.select("image_id", "x", "y", F.count("*").over(row).alias("n"), F.sum(squares).over(row).alias("q"), *(F.sum(c).over(row).alias(c) for c in "rgb"))
    both = first.select("image_id", "x", "y", F.sum("n").over(column).alias("n"), F.sum("q").over(column).alias("q"), *(F.sum(c).over(column).alias(c) for c in "rgb"))
    # n * q - (sums squared) is an integer, so nothing is lost before the comparison
    spread = F.col("n") * F.col("q") - (F.col("r") * F.col("r") + F.col("g") * F.col("g") + F.col("b") * F.col("b"))
    return both.select("image_id", "x", "y", (spread < below * F.col("n") * F.col("n")).alias("smooth"))
