"""Fuzzy line deduplication by MinHash (DataFrame functions only).

Every line that is not blank is a set of shingles of ``SHINGLE`` characters (a
shorter line is one shingle). Signatures take all of them: one hash per shingle
falls into one of 32 cells by its first bits, and the smallest hash of each cell is
one MinHash row. A cell without shingles takes the nearest other cell of its eighth
of the hashes. The four rows of an eighth make a band; bands give candidate pairs, a
sketch of two bits a row chooses partners, and an exact Jaccard similarity over all
shingles confirms links (``linking``); distributed union-find merges them. In each
component the first line, by document and place, stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linking import SIMILARITY, Unit, linked
from .shared import dropped, released, written

SHINGLE, BANDS, ROWS = 8, 8, 4
#: Four bytes a character, so that a shingle is found by its place.
CHARACTERS = Unit(lambda t: F.encode(t, "UTF-32"), lambda d: F.shiftright(F.octet_length(d), 2), lambda d, i, n: F.substring(d, i * 4 - 3, n * 4), SHINGLE)


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, own, n, line, h`` of every line that is not blank; ``own`` tells texts of one id apart."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("own"), F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.length(F.trim("line")) > 0)
    return lines.select("doc_id", "own", "n", "line", F.xxhash64("line").alias("h"))


def _signatures(lines: DataFrame) -> DataFrame:
    """``band, h, sketch``: a row for each band of each distinct line of ``h, line``."""
    data = lines.groupBy("h").agg(F.first("line").alias("line")).select("h", CHARACTERS.data(F.col("line")).alias("data"))
    rows = data.select("h", "data", F.explode(CHARACTERS.places(F.col("data"))).alias("i"))
    rows = rows.select("h", F.hash(CHARACTERS.piece(F.col("data"), F.col("i"))).alias("s"))
    rows = rows.select("h", F.shiftrightunsigned("s", 29).alias("e"), F.col("s").bitwiseAND((1 << 29) - 1).alias("s"))
    names = [f"m{k}" for k in range(ROWS)]
    least = rows.groupBy("h", "e").agg(*(F.min(F.col("s").bitwiseXOR(F.lit(k << 27))).alias(m) for k, m in enumerate(names)))
    own = F.lit(0)
    for k, m in enumerate(names):
        own = own.bitwiseOR(F.shiftleft(F.pmod(F.hash(m), F.lit(3)) + 1, 2 * k))
    turned = F.expr(f"shiftleft(cast(own as bigint), {2 * ROWS} * e)")
    bands = least.select("h", F.xxhash64("e", *names).alias("band"), own.alias("own"), "e").select("h", "band", turned.alias("own"))
    return bands.select("band", "h", F.expr("bit_or(own) over (partition by h)").alias("sketch"))


def line_classes(docs: DataFrame, *, similarity: float = SIMILARITY, **options) -> DataFrame:
    """``v, root`` for each line hash of ``doc_id, text`` that is like another, but the roots."""
    lines = _lines(docs).select("h", "line")
    table = written(_signatures(lines))
    released(table)
    roots = linked(table, lines, CHARACTERS, similarity=similarity, **options)
    dropped(table)
    return roots


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Keep one line of each class of similar lines over the whole table.

    Returns ``doc`` (the whole input row), ``doc_id, n_lines, n_removed, kept_text``.
    Lines are parted by line feeds; blank lines stay and are compared with
    nothing. The first line by document id, then text hash, then place, stays. A null
    or empty text stays as it is. Rows of one id and one text are one document: their
    lines stay or go together. Rows of one id with different texts are documents of
    their own, so none loses a line for another's. Rows with a null id are left alone
    and make no other line go. An empty table gives an empty result. The input's
    columns may have any names, as they come back in ``doc``.
    """
    get = lambda name: F.col(f"`{name}`")
    known = docs.select(get(id_col).alias("doc_id"), get(text_col).alias("text")).where("doc_id is not null")
    roots = line_classes(known, similarity=similarity).withColumnRenamed("v", "h")
    place = F.struct("doc_id", "own", "n")
    lines = _lines(known).select("doc_id", "own", "n", "h")
    # the classes of several lines, each with the place that stays; equal lines collapse before they are shuffled
    firsts = lines.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("size")).join(roots, "h", "left")
    firsts = written(firsts.select("h", "first", "size", F.coalesce("root", "h").alias("root")).where("root <> h or size > 1").unionByName(
        firsts.where("root is null and size = 1").join(roots.select(F.col("root").alias("h")).distinct(), "h", "left_semi").select("h", "first", "size", F.col("h").alias("root"))
    ))
    released(firsts)
    stays = firsts.groupBy("root").agg(F.min("first").alias("stays"))
    several = firsts.join(stays, "root").select("h", "stays")
    gone = lines.join(several, "h").where(place != F.col("stays")).groupBy("doc_id", "own").agg(F.collect_set("n").alias("gone"))
    rows = docs.select(F.struct(*(get(c) for c in docs.columns)).alias("doc"), get(id_col).alias("doc_id"), get(text_col).alias("text"))
    rows = rows.withColumn("own", F.xxhash64("text"))
    texts = F.split("text", "\n")
    kept = F.filter(texts, lambda _, i: ~F.array_contains("gone", i))
    return rows.join(gone, ["doc_id", "own"], "left").select(
        "doc",
        "doc_id",
        F.coalesce(F.size(texts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_removed", "kept_text")
