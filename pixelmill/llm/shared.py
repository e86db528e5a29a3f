"""Shared folders, written tables and document columns.

Lineage is cut by tables written to, or checkpoints in, the folder that the
session names in ``spark.checkpoint.dir``. Only where that is unset and the
master is local, as in tests, a folder of our own is made.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a local master one is made where none is named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, *, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete the files of a table that ``written`` made and that nothing reads any more."""
    spark = table.sparkSession
    files = table.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable, eager checkpoint: files in the shared folder, cleaned when unused."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def released(df: DataFrame) -> None:
    """Let Spark's cleaner drop shuffle files and checkpoints that no DataFrame refers to any more.

    The cleaner acts once the driver has collected its garbage, which a driver with
    little to do may not do for a long time.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others may have any name and type."""
    return docs.select(*(F.col(f"`{n}`").alias(n) for n in names))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
