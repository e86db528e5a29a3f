"""A training corpus in five stages: language, lines, near copies, benchmark, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on what the stage before it
kept, which is written as Parquet and read again. All but the last return the
columns of ``documents``. SQL cannot express the first and third stage, so there
is no ORACLE_SQL; the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm.decontaminate import leaked_items
from pixelmill.llm.language_id import identify
from pixelmill.llm.line_dedup import dedup_lines
from pixelmill.llm.packing import best_fit_packing
from pixelmill.llm.shared import written
from pixelmill.llm.simhash import near_copies as similar_texts

#: A document goes where its first language holds a smaller share of its words.
LEAST_SHARE = 0.5
#: Words whose ids a worker keeps: few, as the same workers run the other stages.
REMEMBER = 200_000
#: Bytes of text whose languages a worker infers at a time: few, for the same reason.
BLOCK = 1 << 18


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a main language; learned from the labelled ones among them.

    Documents without any letter (null and empty ones too) go, and those whose
    first language has less than half of the words. Where no row is labelled,
    only the first rule holds.
    """
    found = identify(docs, docs, keep_rows=True, block=BLOCK)
    clear = (F.col("lang_pred") == "und") | (F.col("score") >= LEAST_SHARE)
    return found.where(F.col("doc.text").rlike(r"\p{L}") & clear).select("doc.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each class of similar lines stays; documents that lose all of their lines go."""
    found = dedup_lines(docs)
    left = found.where(~((F.col("n_removed") > 0) & (F.trim(F.regexp_replace("kept_text", r"\s+", " ")) == "")))
    changed = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("doc.n_chars"))}
    return left.select(*((changed[c].alias(c) if c in changed else F.col(f"doc.`{c}`").alias(c)) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the first text of the smallest id.

    Near copies have a Jaccard similarity of 0.8 or more over shingles of five words,
    or are linked by such; tries over SimHash fingerprints find them, exact sets
    confirm them. Rows without id stay. Of rows that share an id, those with the
    smallest text of the class stay.
    """
    key = F.xxhash64(F.lower(F.coalesce("text", F.lit("")))).alias("text_hash")
    classes = similar_texts(docs)
    rows = docs.where("doc_id is not null").select("doc_id", "text", key).join(classes.where("component_id is not null"), "text_hash")
    stays = rows.where("doc_id = component_id").groupBy("component_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"))).alias("stays"))
    stays = stays.select("component_id", F.xxhash64("stays.text").alias("stays"))
    exact = F.xxhash64(F.coalesce("text", F.lit("")))
    gone = rows.join(stays, "component_id").where((F.col("doc_id") != F.col("component_id")) | (exact != F.col("stays"))).select("doc_id", exact.alias("exact")).distinct()
    gone = gone.withColumnsRenamed({"doc_id": "gone_id", "exact": "gone_text"})
    here = (F.col("doc_id") == F.col("gone_id")) & (F.col("__exact") == F.col("gone_text"))
    return docs.withColumn("__exact", exact).join(gone, here, "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    A text's leaks are its own: rows that share an id, and rows without id, are judged
    by their texts. Null and empty texts leak nothing.
    """
    own = F.xxhash64("text")
    texts = docs.select(own.alias("doc_id"), "text").where("text is not null")
    leaked = leaked_items(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("leaked_text")).distinct()
    return docs.withColumn("__own", own).join(leaked, F.col("__own") == F.col("leaked_text"), "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and their places in sequences of 2048 tokens."""
    return best_fit_packing(docs, ids=True, remember=REMEMBER)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
