"""A Spark data source that lists the chunks of PNG files without loading them.

``spark.read.format("pngchunks").option("path", folder).load()`` gives ``path, seq,
name, length, is_metadata``, one row for each chunk. A reader reads the twelve bytes
round a chunk's head and seeks past its body, so an audit of photographs of many
megabytes reads some hundred bytes of each. Filters on ``name`` are taken over by
the source, and once all kinds asked for can no longer come, a file is left: IEND
is always its last. Files are dealt out in groups of names; a file that is no PNG,
or breaks off, gives what could be read. Paths are those that Arrow's file systems
open: local folders, HDFS and object stores.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .files import METADATA_CHUNKS

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Files of a task.
FILES = 1024
ROWS = 4096


@dataclass
class Files(InputPartition):
    """Paths of some files."""

    paths: list[str]


def heads(file: pa.NativeFile, size: int, names: set[str] | None = None) -> Iterator[tuple[int, str, int]]:
    """``seq, name, length`` of the chunks of an open file, of the given names only."""
    if size < 8 or file.read(8) != SIGNATURE:
        return
    at, seq = 8, 0
    while at + 12 <= size:
        file.seek(at)
        length, name = struct.unpack(">I4s", file.read(8))
        name = name.decode("latin-1")
        if names is None or name in names:
            yield seq, name, length
        if name == "IEND":
            return
        at, seq = at + 12 + length, seq + 1


class PngChunkReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.names = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("name",):
                self._only(set(f.value))
            else:
                yield f

    def _only(self, names: set[str]) -> None:
        self.names = names if self.names is None else self.names & names

    def partitions(self) -> list[Files]:
        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.extension.lower() == "png")
        return [Files(found[k : k + FILES]) for k in range(0, len(found), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        rows: list[tuple] = []
        for path in partition.paths:
            with store.open_input_file(path) as file:
                for seq, name, length in heads(file, file.size(), self.names):
                    rows.append((path, seq, name, length, name in METADATA_CHUNKS))
                    if len(rows) == ROWS:
                        yield self._batch(rows)
                        rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["path", "seq", "name", "length", "is_metadata"])


class PngChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pngchunks"

    def schema(self) -> str:
        return "path string, seq int, name string, length long, is_metadata boolean"

    def reader(self, schema) -> PngChunkReader:
        return PngChunkReader(self.options["path"])


def scan_png_chunks(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """S5 over a folder: chunks of all PNG files below it, of some kinds or all, read by their heads alone."""
    spark.dataSource.register(PngChunkSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format("pngchunks").option("path", path).load()
    return found.where(F.col("name").isin(names)) if names is not None else found


def audit_png_folder(spark: SparkSession, path: str) -> DataFrame:
    """For each metadata kind the files of a folder that hold it, the chunks and their bytes."""
    each = scan_png_chunks(spark, path, METADATA_CHUNKS).groupBy("name", "path").agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"))
    return each.groupBy("name").agg(F.count("*").alias("images"), F.sum("chunks").alias("chunks"), F.sum("bytes").alias("bytes"))
