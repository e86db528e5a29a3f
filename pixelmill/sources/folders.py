"""Folders that driver and executors share, and tables kept there while a job runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table with one row for each image is broadcast up to so many rows; beyond that it is shuffled.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; on a local master one of our own where none is named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    elif named and not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return (named or sc.getCheckpointDir()).rstrip("/")


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def new_folder(spark: SparkSession, kind: str = "files") -> str:
    """A new folder below the shared one, as a full address."""
    store, where = _at(spark, f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}")
    store.mkdirs(where)
    return store.makeQualified(where).toString()


def matching(spark: SparkSession, path: str) -> list[str]:
    """The full addresses of the folders and files that a path or pattern names."""
    store, where = _at(spark, path)
    found = store.globStatus(where) or []
    if not len(found):
        raise FileNotFoundError(path)
    return [store.makeQualified(s.getPath()).toString() for s in found]


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it."""
    store, where = _at(spark, path)
    store.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where there is no such folder."""
    store, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(where)) if store.exists(where) else []


def cut(df: DataFrame) -> DataFrame:
    """A reliable, eager checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame, *folders: str) -> DataFrame:
    """The rows of ``df`` as a checkpoint; the folders that they came from are deleted."""
    done = cut(df)
    for folder in folders:
        removed(df.sparkSession, folder)
    return done


def with_few(many: DataFrame, few: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join a pixel table with one that follows images or sizes, which is written once and counted first.

    Spark cannot know the size of exploded pixels and might send those to all
    tasks. Only the small side is ever broadcast, up to ``BROADCAST_ROWS``; beyond
    that both are shuffled and the small side is the one that is hashed.
    """
    few = cut(few)
    small = few.count() <= BROADCAST_ROWS
    return many.join(F.broadcast(few) if small else few.hint("shuffle_hash"), on, how)
