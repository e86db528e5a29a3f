"""File catalogues, rasters and pixel tables, PNG chunks, and the result sink."""

from __future__ import annotations

import struct
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.scalars import ACCEPTED_EXTENSIONS, extension, output_name
from ..operators.joins import resolve_blob
from .folders import cut, matching

# Chunks that carry metadata.
METADATA_CHUNKS = ["eXIf", "iCCP", "gAMA", "cHRM", "sRGB", "pHYs", "tEXt", "zTXt", "iTXt", "tIME"]


#: Bytes that opening a small file counts for when files are dealt into tasks.
OPEN_COST = 1 << 16


def image_glob() -> str:
    """A pattern of the accepted extensions in any case."""
    return "*{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in ACCEPTED_EXTENSIONS) + "}"


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Reads of very many small files, while plans are made and run: a task takes some two thousand, not 32."""
    name = "spark.sql.files.openCostInBytes"
    was = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_COST))
    try:
        yield
    finally:
        spark.conf.set(name, was)


#: Columns of a listing of files.
LISTED = "path string, modificationTime timestamp, length long"
#: Files and bytes of a task that reads files, folders of a task that lists them, and rows and bytes of a batch, at most or nearly.
READ_FILES, READ_BYTES, LIST_FOLDERS = 2048, 1 << 27, 16
BATCH_ROWS, BATCH_BYTES = 1024, 1 << 24


def _opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of an address, the address's path there, and what stands before paths of that file system."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), "file:"
    store, own = fs.FileSystem.from_uri(path)
    return store, own, path[: path.index("://") + 3] + path.split("://", 1)[1].removesuffix(own)


def _hidden(name: str) -> bool:
    """As Spark's readers have it: names that begin with a dot or, without an equals sign, an underscore; and copies under way."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(batches: Iterator[pa.RecordBatch], endings: tuple[str, ...], deep: bool) -> Iterator[pa.RecordBatch]:
    """Files of some endings in folders of ``path``, and the folders too; with ``deep`` what those hold instead."""
    rows = []

    def batch() -> pa.RecordBatch:
        kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "modificationTime", "length", "is_folder"])

    for paths in batches:
        for root in paths.column("path").to_pylist():
            store, own, before = _opened(root)
            left = [own]
            while left:
                own = left.pop()
                for f in store.get_file_info(fs.FileSelector(own)) if (top := store.get_file_info(own)).type == fs.FileType.Directory else [top]:
                    if _hidden(f.base_name):
                        continue
                    if f.type == fs.FileType.Directory and deep:
                        left.append(f.path)
                    elif f.type == fs.FileType.Directory or f.is_file and f.base_name.lower().endswith(endings):
                        rows.append((before + f.path, f.mtime_ns // 1_000_000 * 1000 if f.mtime_ns is not None else None, f.size, f.type == fs.FileType.Directory))
                    if len(rows) == 4096:
                        yield batch()
                        rows.clear()
    if rows:
        yield batch()


def list_files(spark: SparkSession, path: str, endings: tuple[str, ...] = tuple(ACCEPTED_EXTENSIONS)) -> DataFrame:
    """``path, modificationTime, length`` of all files of these endings below a folder (or a pattern of folders), empty ones too.

    Tasks do the listing: one takes the top, then many the folders below it. The
    driver sees no file, however many there are. The rows are a checkpoint.
    """
    kind = f"{LISTED}, is_folder boolean"
    tops = spark.createDataFrame([(p,) for p in matching(spark, path)], "path string")
    top = cut(tops.coalesce(1).mapInArrow(lambda b: _entries(b, endings, False), kind))
    below = top.where("is_folder")
    n = below.count()
    if not n:
        return top.where("not is_folder").drop("is_folder")
    deep = below.select("path").repartition(-(-n // LIST_FOLDERS), "path").mapInArrow(lambda b: _entries(b, endings, True), kind)
    return cut(top.where("not is_folder").unionByName(deep).drop("is_folder"))


def read_files(listed: DataFrame) -> DataFrame:
    """A listing with the ``content`` of its files, in batches of bounded size."""

    def run(batches):
        for batch in batches:
            at, held, size = 0, [], 0
            for k, path in enumerate(batch.column("path").to_pylist()):
                store, own, _ = _opened(path)
                with store.open_input_stream(own) as file:
                    held.append(file.read())
                size += len(held[-1])
                if len(held) == BATCH_ROWS or size >= BATCH_BYTES or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(held)) for c in ("path", "modificationTime", "length")), pa.array(held, pa.binary())], ["path", "modificationTime", "length", "content"])
                    at, held, size = k + 1, [], 0

    return listed.select("path", "modificationTime", "length").mapInArrow(run, f"{LISTED}, content binary")


def reading_tasks(listed: DataFrame) -> int:
    """Tasks that reading a listing's files makes."""
    files, size = listed.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return max(1, -(-files // READ_FILES), -(-size // READ_BYTES))


def scan_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per accepted image file, with its content and hash. Files without content count as well."""
    listed = list_files(spark, path)
    found = read_files(listed.repartition(reading_tasks(listed), "path"))
    return found.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("hash", F.sha2("content", 256))


def sniff_format(content: Column, name: Column, mime: Column) -> Column:
    """The format by MIME type, then extension, then leading bytes; null where none tells."""
    first = lambda n: F.hex(F.substring(content, 1, n))
    brand = F.hex(F.substring(content, 9, 4))
    named = {"heic": "heic", "heif": "heic", "tif": "tiff", "tiff": "tiff", "bmp": "bmp", "gif": "gif", "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "webp": "webp", "avif": "avif", "svg": "svg"}
    mimes = {"image/heic": "heic", "image/heif": "heic", "image/tiff": "tiff", "image/x-tiff": "tiff", "image/bmp": "bmp", "image/x-ms-bmp": "bmp", "image/gif": "gif", "image/png": "png", "image/jpeg": "jpeg", "image/webp": "webp", "image/avif": "avif", "image/svg+xml": "svg"}
    pick = lambda c, table: F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in table.items()))
    magic = (
        F.when((F.hex(F.substring(content, 5, 4)) == "66747970") & brand.isin("68656963", "6D696631", "6D736631"), F.lit("heic"))
        .when(first(4).isin("49492A00", "4D4D002A"), F.lit("tiff"))
        .when(first(2) == "424D", F.lit("bmp"))
        .when(first(6).isin("474946383761", "474946383961"), F.lit("gif"))
        .when(first(8) == "89504E470D0A1A0A", F.lit("png"))
        .when(first(3) == "FFD8FF", F.lit("jpeg"))
    )
    return F.coalesce(pick(F.lower(mime), mimes), pick(extension(name), named), magic)


#: Pixels in a batch of the pixel table.
BATCH_PIXELS = 1 << 18


#: Names that do not end in .bmp, as a pattern.
NO_BITMAPS = "{*[^pP],*[^mM]?,*[^bB]??,*[^.]???,?,??,???}"
HEAD = 54


def _is_plain(head: bytes, size: int) -> bool:
    """Whether a file of this head is a bitmap of 24 bits a pixel without compression, from its lowest line up."""
    if len(head) < HEAD or head[:2] != b"BM":
        return False
    at, own, width, height, planes, bits, packing = struct.unpack("<IIiiHHI", head[10:34])
    return own == 40 and (planes, bits, packing) == (1, 24, 0) and width > 0 and height > 0 and at >= HEAD and at + (3 * width + 3) // 4 * 4 * height <= size


def _origin(path: str) -> str:
    """A listed path as the address that the image source gives for it."""
    _, own, before = _opened(path)
    kept = lambda c: c.isascii() and (c.isalnum() or c in "-_.!~*'():@&=+$,;/") or not (c.isascii() or c.isspace() or unicodedata.category(c) in ("Cc", "Zs", "Zl", "Zp"))
    return ("file://" if before == "file:" else before) + "".join(c if kept(c) else "".join(f"%{b:02X}" for b in c.encode()) for c in own)


def _plain_bitmaps(listed: DataFrame) -> DataFrame:
    """Rasters of plain bitmaps."""

    def run(batches):
        for batch in batches:
            kept = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8)
                at, _, width, height = struct.unpack("<IIii", data[10:26].tobytes())
                line = (3 * width + 3) // 4 * 4
                rgba = np.full((height, width, 4), 255, np.uint8)
                rgba[..., :3] = data[at : at + line * height].reshape(height, line)[::-1, : 3 * width].reshape(height, width, 3)[..., ::-1]
                kept.append((_origin(path), width, height, rgba.tobytes()))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*kept, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["image_id", "width", "height", "data"])

    return read_files(listed.repartition(reading_tasks(listed), "path")).mapInArrow(run, "image_id string, width int, height int, data binary")


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """S3: decoded files as ``image_id, width, height, data`` in RGBA; files that cannot be read are dropped.

    Decoding is the JVM image source's, but for plain bitmaps (``.bmp``), whose bytes
    only change places: that source compiles code for each file, which takes longer than a
    small bitmap takes to be read, and its driver holds all names. Bitmaps of other kinds go to it as well.
    """
    listed, is_bitmap = list_files(spark, path, ("",)), F.lower(F.substring("path", -4, 4)) == ".bmp"

    def heads(batches):
        for batch in batches:
            plain = []
            for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                store, own, _ = _opened(path)
                with store.open_input_stream(own) as file:
                    plain.append(_is_plain(file.read(HEAD), size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_origin(p) for p in batch.column("path").to_pylist()], pa.string()), pa.array(plain, pa.bool_())], [*batch.schema.names, "image_id", "is_plain"])

    known = cut(listed.where(is_bitmap).mapInArrow(heads, f"{LISTED}, image_id string, is_plain boolean"))
    found = _plain_bitmaps(known.where("is_plain"))
    if listed.where(~is_bitmap).limit(1).count():
        found = found.unionByName(_decoded(spark, path, NO_BITMAPS))
    others = known.where("not is_plain").select("image_id")
    return found.unionByName(_decoded(spark, path, "*.[bB][mM][pP]").join(others, "image_id", "left_semi")) if others.limit(1).count() else found


def _decoded(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """What the JVM image source makes of the files of these names; its bytes are grey, or B, G, R and perhaps A.

    Channels change places for a whole image at a time.
    """
    image = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("image.*")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                n, data = batch.column("nChannels")[k].as_py(), np.frombuffer(batch.column("data")[k].as_buffer(), np.uint8)
                own = data.reshape(-1, n)
                rgba = np.full((len(own), 4), 255, np.uint8)
                rgba[:, :3] = own[:, [2, 1, 0]] if n >= 3 else own[:, :1]
                if n == 4:
                    rgba[:, 3] = own[:, 3]
                head = [batch.column(c).slice(k, 1) for c in ("origin", "width", "height")]
                yield pa.RecordBatch.from_arrays([*head, pa.array([rgba.tobytes()], pa.binary())], ["image_id", "width", "height", "data"])

    return image.select("origin", "width", "height", "nChannels", "data").mapInArrow(run, "image_id string, width int, height int, data binary")


def explode_pixels(rasters: DataFrame) -> DataFrame:
    """One row per pixel of row-major RGBA rasters; in batches of bounded size, however large an image is."""
    kind = rasters.schema["image_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                width, height = batch.column("width")[k].as_py(), batch.column("height")[k].as_py()
                cells = np.frombuffer(batch.column("data")[k].as_buffer(), np.uint8).reshape(-1, 4)
                for at in range(0, width * height, BATCH_PIXELS):
                    i = np.arange(at, min(at + BATCH_PIXELS, width * height), dtype=np.int32)
                    same = [pa.repeat(batch.column(c)[k], len(i)) for c in ("image_id", "width", "height")]
                    own = cells[at : at + BATCH_PIXELS].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*same, pa.array(i % width), pa.array(i // width), *(pa.array(np.ascontiguousarray(own[:, c])) for c in range(4))], ["image_id", "width", "height", "x", "y", "r", "g", "b", "a"])

    whole = rasters.where("width > 0 AND height > 0 AND octet_length(data) = 4L * width * height").selectExpr("image_id", "cast(width AS int) AS width", "cast(height AS int) AS height", "data")
    return whole.mapInArrow(run, f"image_id {kind}, width int, height int, x int, y int, r int, g int, b int, a int")


@udtf(returnType="seq int, name string, length int, is_metadata boolean")
class PngChunks:
    """The chunks of one PNG file; a file that is none, or breaks off, gives what could be read."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if not content or content[:8] != b"\x89PNG\r\n\x1a\n":
            return
        at, seq = 8, 0
        while at + 12 <= len(content):
            (length,) = struct.unpack(">I", content[at : at + 4])
            name = content[at + 4 : at + 8].decode("latin-1")
            yield seq, name, length, name in METADATA_CHUNKS
            if name == "IEND":
                return
            at, seq = at + 12 + length, seq + 1


def png_chunks(df: DataFrame) -> DataFrame:
    """``image_id, seq, name, length, is_metadata`` for files of ``image_id, content``."""
    spark = df.sparkSession
    spark.udtf.register("png_chunks", PngChunks)
    return spark.sql("SELECT d.image_id, c.* FROM {d} d, LATERAL png_chunks(d.content) c", d=df)


def metadata_audit(df: DataFrame) -> DataFrame:
    """For each metadata kind the images that hold it, the chunks and their bytes."""
    meta = png_chunks(df).where("is_metadata")
    each = meta.groupBy("name", "image_id").agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"))
    return each.groupBy("name").agg(F.count("*").alias("images"), F.sum("chunks").alias("chunks"), F.sum("bytes").alias("bytes"))


def write_outcomes(outcomes: DataFrame, path: str, originals: DataFrame | None = None) -> None:
    """Successful rows with their output's name, in one directory per format.

    With ``originals`` (``id, original_blob``), a row without an output blob gets its
    original's as ``resolved_blob`` (J7).
    """
    good = outcomes.where(F.col("raw_status") != "error").withColumn("file_name", output_name(F.col("name"), F.col("format")))
    if originals is not None:
        good = resolve_blob(good, originals)
    good.write.partitionBy("format").parquet(path)
