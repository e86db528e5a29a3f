"""Distributed union-find: connected components by large-star and small-star rounds.

Only DataFrame functions. Minima are pre-aggregated before each shuffle and come
back by joins, which Spark can split where a vertex has very many edges. Each
round is cut off by a reliable checkpoint, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, released


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars already: no vertex hangs on two others, none that hangs is hung on."""
    roles = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    roles = roles.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not roles.where("up > 1 or (up = 1 and down = 1)").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """``v, root`` for every vertex of ``edges(u, v)`` but the roots themselves.

    The root is the smallest vertex that can be reached. Self-loops, repeated
    edges and null vertices do nothing; no edges give no rows.
    """
    low, high = F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")
    edges = checkpointed(edges.where("u <> v").select(high, low).distinct())  # u > v
    while not _settled(edges):
        # large-star: each vertex hangs its larger neighbours on its smallest
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: each vertex hangs itself and its smaller neighbours on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpointed(small)
        released(edges)
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
