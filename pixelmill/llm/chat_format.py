"""Chat formatting with collapse of cumulative snapshots (DataFrame functions only).

Chat logs often hold a conversation again each time a turn is added. A rolling
hash of every prefix of turns finds the conversations that are a prefix of a
longer one; anti-joins keep the maximal ones, which are then rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"


def _rendered(role, text, template: str):
    """The template with its two places filled, as one concat of columns."""
    before, _, rest = template.partition("{role}")
    middle, _, after = rest.partition("{text}")
    return F.concat(F.lit(before), role, F.lit(middle), text, F.lit(after))


def collapse_and_render(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: str = TURN) -> DataFrame:
    """Render each maximal conversation; snapshots that a longer one extends go.

    Returns ``conv_id, n_turns, n_copies, rendered``. Turns stand in the order of
    ``turn`` (null last), then role and text. Null role and text count as empty.
    Conversations with the same turns are one: the smallest id stays and
    ``n_copies`` counts them. Repeated rows are repeated turns. Rows without a
    conversation id belong to none and are left out. Two 64-bit hashes stand for
    a prefix. An empty table gives an empty result; other columns are ignored.
    """
    get = lambda name: F.col(f"`{name}`")
    turns = turns.select(
        get(conv_col).alias("conv_id"),
        get(turn_col).alias("turn"),
        F.coalesce(get(role_col), F.lit("")).alias("role"),
        F.coalesce(get(text_col), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = turns.withColumn("n", F.row_number().over(order))
    # the place is part of each turn's hash, so the running xor tells orders apart
    prefixes = numbered.select(
        "conv_id",
        "n",
        F.bit_xor(F.xxhash64(F.lit(1), "n", "role", "text")).over(so_far).alias("p1"),
        F.bit_xor(F.xxhash64(F.lit(2), "n", "text", "role")).over(so_far).alias("p2"),
        F.lead("n").over(order).isNotNull().alias("goes_on"),
    )
    # one shuffle: for each prefix, whether a conversation goes on after it, and who ends there
    kept = (
        prefixes.groupBy("n", "p1", "p2")
        .agg(F.bool_or("goes_on").alias("extended"), F.min(F.when(~F.col("goes_on"), F.col("conv_id"))).alias("conv_id"), F.count_if(~F.col("goes_on")).alias("n_copies"))
    )
    ends = kept.where("conv_id is not null").select("n", "p1", "p2", "conv_id", "n_copies")
    longer = kept.where("extended").select("n", "p1", "p2")
    maximal = ends.join(longer, ["n", "p1", "p2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")
    pieces = turns.select("conv_id", F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text").alias("t"))
    texts = pieces.join(maximal.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    rendered = F.array_join(F.transform("ts", lambda t: _rendered(t.role, t.text, template)), "")
    return maximal.join(texts, "conv_id").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", rendered.alias("rendered"))


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    return collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP10_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) AS n,
         concat('<|im_start|>', coalesce(role, ''), chr(10), coalesce(text, ''), '<|im_end|>', chr(10)) AS piece
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT conv_id, n, string_agg(piece, '') OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS r,
         count(*) OVER (PARTITION BY conv_id) AS total
  FROM t
), whole AS (
  SELECT n, r, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE n = total GROUP BY n, r
)
SELECT conv_id, n AS n_turns, n_copies, r AS rendered FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n = w.n AND p.r = w.r AND p.total > p.n)
"""
