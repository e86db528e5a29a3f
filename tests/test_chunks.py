"""The PNG chunk source: the same rows as a reader of whole files, from the heads alone."""

from __future__ import annotations

import io
import os
import struct
import tempfile

from pixelmill.sources import chunks


def _png(*parts):
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(body)) + name + body + b"0000" for name, body in parts)


class _Counted(io.BytesIO):
    bytes_read = 0

    def read(self, n=-1):
        got = super().read(n)
        self.bytes_read += len(got)
        return got


def test_only_heads_are_read():
    data = _png((b"IHDR", b"x" * 13), (b"tEXt", b"y" * 10_000_000), (b"IDAT", b"z" * 10_000_000), (b"IEND", b""))
    file = _Counted(data)
    assert [h[1:] for h in chunks.heads(file, len(data))] == [("IHDR", 13), ("tEXt", 10_000_000), ("IDAT", 10_000_000), ("IEND", 0)]
    assert file.bytes_read <= 8 + 4 * 12


def test_scan_and_audit(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="spark-")
    os.makedirs(f"{folder}/deep")
    whole = [(b"IHDR", b"x" * 13), (b"tEXt", b"abc"), (b"tIME", b"0123456"), (b"tEXt", b""), (b"IEND", b"")]
    files = {"a.png": _png(*whole), "deep/B.PNG": _png(*whole[:2]), "cut.png": _png(*whole)[:50], "none.png": b"", "text.png": b"no picture at all", "c.jpg": _png(*whole), "after.png": _png((b"IEND", b""), (b"tEXt", b"q"))}
    for name, data in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    found = sorted((os.path.basename(r.path), r.seq, r.name, r.length, r.is_metadata) for r in chunks.scan_png_chunks(spark, folder).collect())
    want = [("a.png", k, n.decode(), len(b), n in (b"tEXt", b"tIME")) for k, (n, b) in enumerate(whole)] + [("B.PNG", 0, "IHDR", 13, False), ("B.PNG", 1, "tEXt", 3, True), ("after.png", 0, "IEND", 0, False), ("cut.png", 0, "IHDR", 13, False), ("cut.png", 1, "tEXt", 3, True)]
    assert found == sorted(want)
    some = chunks.scan_png_chunks(spark, folder, ["tIME", "gAMA"])
    assert [(r.name, r.length) for r in some.collect()] == [("tIME", 7)]
    audit = {r.name: (r.images, r.chunks, r.bytes) for r in chunks.audit_png_folder(spark, folder).collect()}
    assert audit == {"tEXt": (3, 4, 9), "tIME": (1, 1, 7)}
    empty = tempfile.mkdtemp(prefix="spark-")
    assert chunks.scan_png_chunks(spark, empty).collect() == []


def test_filters_on_names_are_taken_over():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = chunks.PngChunkReader("/nowhere")
    rest = list(reader.pushFilters([In(("name",), ("tEXt", "tIME")), EqualTo(("name",), "tIME"), GreaterThan(("length",), 3)]))
    assert rest == [GreaterThan(("length",), 3)] and reader.names == {"tIME"}
