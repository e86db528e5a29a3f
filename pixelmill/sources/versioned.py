"""A keyed table as one base and the changes since, merged when it is read.

Each write is a folder of Parquet files named by its number, ``000000000007.base``
or ``.delta``. It counts once Spark has marked it as complete, so a write that
broke off is never seen and is overwritten by the next one. A delta holds one new
state for each key that changed, or a mark that the key is gone. Readers take the
newest base, leave out the keys that later deltas name, and add what those say;
only keys travel for that, the base itself is just scanned. ``compact`` writes that
view as a new base. There is one writer at a time; readers of the version before
the last base go on undisturbed.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .folders import names, removed

VERSION = re.compile(r"(\d{12})\.(base|delta)")
GONE = "_gone"


class VersionedTable:
    """Rows of ``schema`` under ``keys``, in a folder that all executors share. Keys may be null."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema

    def versions(self) -> list[tuple[int, str]]:
        """Number and kind of all complete writes, in order."""
        found = [(int(m[1]), m[2]) for m in map(VERSION.fullmatch, names(self.spark, self.path)) if m]
        return sorted(v for v in found if "_SUCCESS" in names(self.spark, self._folder(*v)))

    def _folder(self, number: int, kind: str) -> str:
        return f"{self.path}/{number:012d}.{kind}"

    def _write(self, rows: DataFrame, kind: str) -> int:
        number = max((n for n, _ in self.versions()), default=0) + 1
        rows.write.mode("overwrite").parquet(self._folder(number, kind))
        return number

    def put(self, rows: DataFrame) -> int:
        """New states of the keys of ``rows``; one row for each key. The first write of all is a base."""
        rows = rows.select(*self.schema.fieldNames())
        if not self.versions():
            return self._write(rows, "base")
        return self._write(rows.withColumn(GONE, F.lit(False)), "delta")

    def drop(self, keys: DataFrame) -> int:
        """Mark keys as gone."""
        others = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in self.keys]
        return self._write(keys.select(*self.keys, *others).select(*self.schema.fieldNames(), F.lit(True).alias(GONE)), "delta")

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"_{k}"]) for k in self.keys))

    def read(self) -> DataFrame:
        """The table as it stands; later versions win."""
        versions = self.versions()
        bases = [n for n, kind in versions if kind == "base"]
        whole = self.spark.read.schema(self.schema)
        base = whole.parquet(self._folder(bases[-1], "base")) if bases else self.spark.createDataFrame([], self.schema)
        deltas = [n for n, kind in versions if kind == "delta" and n > (bases[-1] if bases else 0)]
        if not deltas:
            return base
        changed = [self.spark.read.schema(StructType([*self.schema.fields]).add(GONE, "boolean")).parquet(self._folder(n, "delta")).withColumn("_version", F.lit(n)) for n in deltas]
        rest = [c for c in (*self.schema.fieldNames(), GONE) if c not in self.keys]
        last = reduce(DataFrame.unionByName, changed).groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_version").alias("_last"))
        named = last.select(*(F.col(k).alias(f"_{k}") for k in self.keys))
        kept = base.join(named, self._same(base, named), "left_anti")
        return kept.unionByName(last.select(*self.keys, "_last.*").where(~F.col(GONE)).select(*self.schema.fieldNames()))

    def compact(self) -> int:
        """One base in place of base and deltas; does nothing if there are no deltas. What is older than the base before goes."""
        versions = self.versions()
        bases = [n for n, kind in versions if kind == "base"]
        if bases and versions[-1][1] == "base":
            return bases[-1]
        number = self._write(self.read(), "base")
        for n, kind in versions:
            if bases and n < bases[-1]:
                removed(self.spark, self._folder(n, kind))
        return number
