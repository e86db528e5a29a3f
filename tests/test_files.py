"""Listing and reading of many files by tasks."""

from __future__ import annotations

import hashlib
import os
import struct

import pytest

from pixelmill.plans import catalogue, live
from pixelmill.sources import files
from pixelmill.streaming import streams as ST

CONTENTS = {"a.png": b"one", "sub/b.PNG": b"", "sub/deep/c 1%20.tif": b"three", "sub/d.gif": b"", "e.txt": b"text", "_f.png": b"hidden", ".g.png": b"hidden", "_tmp/h.png": b"hidden", "sub/.i/j.png": b"hidden", "n=1/k.jpg": b"one"}
ACCEPTED = ["a.png", "sub/b.PNG", "sub/deep/c 1%20.tif", "sub/d.gif", "n=1/k.jpg"]


@pytest.fixture
def folder(tmp_path):
    for name, content in CONTENTS.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    return str(tmp_path / "in")


def test_the_catalogue_has_files_without_content(spark, folder):
    """Every accepted file at any depth, empty ones too, with times and paths as Spark's own source gives them."""
    found = {r.path: r for r in files.scan_catalog(spark, folder).collect()}
    assert set(found) == {f"file:{folder}/{name}" for name in ACCEPTED}
    for name in ACCEPTED:
        r, own = found[f"file:{folder}/{name}"], f"{folder}/{name}"
        assert (bytes(r.content), r.length, r.name, r.hash) == (CONTENTS[name], len(CONTENTS[name]), os.path.basename(own), hashlib.sha256(CONTENTS[name]).hexdigest())
    theirs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", files.image_glob()).load(folder)
    ours = files.scan_catalog(spark, folder)
    assert theirs.exceptAll(ours.select(theirs.columns)).count() == 0 and theirs.count() == 3
    assert ours.select("modificationTime").schema["modificationTime"].dataType == theirs.schema["modificationTime"].dataType
    assert {r.name for r in files.scan_catalog(spark, f"{folder}/s*b").collect()} == {"b.PNG", "c 1%20.tif", "d.gif"}
    assert [r.name for r in files.scan_catalog(spark, f"{folder}/a.png").collect()] == ["a.png"]
    with pytest.raises(FileNotFoundError):
        files.scan_catalog(spark, f"{folder}/none")


def test_reading_is_dealt_into_bounded_batches(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "READ_FILES", 2)
    monkeypatch.setattr(files, "BATCH_ROWS", 2)
    found = files.scan_catalog(spark, folder)
    assert found.rdd.getNumPartitions() == 3
    assert sorted(bytes(r.content) for r in found.collect()) == [b"", b"", b"one", b"one", b"three"]


def test_empty_files_are_ingested(spark, folder, tmp_path):
    """Both forms of ST1 have the empty content, once; the stream's source log names no image, however many there are."""
    want = sorted((hashlib.sha256(c).hexdigest(), len(c)) for c in (b"one", b"", b"three"))
    batch = ST.ingest(files.scan_catalog(spark, folder).drop("hash"))
    assert sorted((r.hash, r.length) for r in batch.collect()) == want
    table, checkpoint = f"{tmp_path}/table", f"{tmp_path}/checkpoint"
    for k in range(2):  # the second run brings one new content, and one that is there
        ST.ingest_to(spark, folder, table, checkpoint)
        assert sorted((r.hash, r.length) for r in spark.read.parquet(table).collect()) == want
        for name, content in (("new.png", b"four"), ("again.png", b"")):
            with open(f"{folder}/{name}", "wb") as f:
                f.write(content)
        if not k:
            want = sorted([*want, (hashlib.sha256(b"four").hexdigest(), 4)])
    log = "".join(open(os.path.join(d, n)).read() for d, _, ns in os.walk(f"{checkpoint}/sources") for n in ns if not n.endswith(".crc"))
    assert "found/part-" in log and ".png" not in log


def test_registered_file_queries_take_null_and_empty_texts(spark, tmp_path):
    rows = [(k, None if k == 3 else "" if k in (5, 6) else f"text {k % 8}") for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    name = lambda k: f"f{k}." + ["png", "JPG", "Jpeg", "webp", "txt", "tif"][k % 6]
    content = {name(k): (text or "").encode() for k, text in rows if not name(k).endswith("txt")}
    sha = lambda c: hashlib.sha256(c).hexdigest()
    found = catalogue.QUERIES["s1_scan_catalog"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted((n, len(c), sha(c)) for n, c in content.items())
    want = sorted({(sha(c), len(c)) for c in content.values()})
    for query in (catalogue.QUERIES["st1_ingest"], live.QUERIES["st1_stream_ingest"]):
        assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == want


def _bitmap(width: int, height: int, bits: int = 24, offset: int = 54, order: int = 1) -> bytes:
    line = (width * bits // 8 + 3) // 4 * 4
    head = b"BM" + struct.pack("<IHHI", offset + line * height, 0, 0, offset) + struct.pack("<IiiHHIIiiII", 40, width, order * height, 1, bits, 0, line * height, 0, 0, 0, 0)
    return head + b"\7" * (offset - 54) + bytes((k * k + 3 * k) % 251 for k in range(line * height))


def test_bitmaps_are_read_as_the_image_source_reads_them(spark, tmp_path):
    """Plain bitmaps, others, broken ones, and names that want quoting: rows and addresses equal the image source's."""
    own = {"a.bmp": _bitmap(5, 3), "x y/b%20+é.BMP": _bitmap(1, 1), "c.bmp": _bitmap(4, 2, offset=60), "d.bmp": _bitmap(3, 2, bits=32), "e.bmp": _bitmap(3, 2, order=-1), "f.bmp": _bitmap(9, 9)[:-1], "g.bmp": b"", "h.bmp": b"BM", "i.png": _bitmap(2, 2), "bmp": _bitmap(2, 3), "_j.bmp": _bitmap(1, 2)}
    for name, content in own.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = {r.image_id: (r.width, r.height, bytes(r.data)) for r in files.read_rasters(spark, str(tmp_path)).collect()}
    theirs = {r.image_id: (r.width, r.height, bytes(r.data)) for r in files._decoded(spark, str(tmp_path), "*").collect()}
    assert found == theirs and {os.path.basename(i) for i in found} >= {"a.bmp", "b%2520+é.BMP", "c.bmp", "i.png", "bmp"}


def test_plain_bitmaps_do_not_meet_the_image_source(spark, tmp_path):
    (tmp_path / "a.bmp").write_bytes(_bitmap(5, 3))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = files.read_rasters(spark, str(tmp_path))
    assert "FileScan image" not in plan(found) and found.count() == 1
    (tmp_path / "b.png").write_bytes(_bitmap(5, 3))
    found = files.read_rasters(spark, str(tmp_path))
    assert "FileScan image" in plan(found) and found.count() == 2
