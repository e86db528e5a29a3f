"""Operator inputs derived from the driver tables by integer arithmetic.

The texts below hold for both engines but for integer division, the way a grid is
laid out, and how numbers stay within 64 bits, which are filled in for each.

A grid multiplies a few thousand keys by thousands of cells, so for Spark the keys are
dealt out first, by image and into tasks of bounded numbers of cells. What then goes
by image finds its pixels together, and no pixel has to be shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PIXELS = """
SELECT {image} AS image_id, 32 AS width, 32 AS height, x, y,
 CASE pat WHEN 0 THEN (seed {div} 65536) % 256 WHEN 1 THEN i % 100 WHEN 2 THEN 128 WHEN 3 THEN x*8
      ELSE CASE WHEN x BETWEEN 6 AND 24 AND y BETWEEN 5 AND 27 THEN k % 200 ELSE 255 END END AS r,
 CASE pat WHEN 0 THEN (seed {div} 256) % 256 WHEN 1 THEN 0 WHEN 2 THEN 128 WHEN 3 THEN y*8
      ELSE CASE WHEN x BETWEEN 6 AND 24 AND y BETWEEN 5 AND 27 THEN 40 ELSE 255 END END AS g,
 CASE pat WHEN 0 THEN seed % 256 WHEN 1 THEN 0 WHEN 2 THEN 128 WHEN 3 THEN (x+y)*4
      ELSE CASE WHEN x BETWEEN 6 AND 24 AND y BETWEEN 5 AND 27 THEN 90 ELSE 255 END END AS b,
 CASE WHEN pat = 2 AND i < 103 THEN 0 ELSE 255 END AS a
FROM (SELECT {k}, i, i % 32 AS x, i {div} 32 AS y, k % 5 AS pat,
             ({place} * 1103515245 + 12345) % 4294967296 AS seed FROM ({grid}) t) g
"""
_BIG = """
SELECT {image} AS image_id, 160 AS width, 125 AS height, x, y,
       (seed {div} 65536) % 256 AS r, (seed {div} 256) % 256 AS g, seed % 256 AS b, 255 AS a
FROM (SELECT {k}, i, i % 160 AS x, i {div} 160 AS y,
             ({place} * 1103515245 + 12345) % 4294967296 AS seed FROM ({grid}) t) g
"""
_PHOTO = """
SELECT {image} AS image_id, 256 AS width, 256 AS height, x, y,
       x AS r, y AS g, (x + y + k) {div} 2 % 256 AS b, 255 AS a
FROM (SELECT {k}, i, i % 256 AS x, i {div} 256 AS y FROM ({grid}) t) g
"""
#: Taller than a band of lines, with a white border.
_TALL = """
SELECT {image} AS image_id, 64 AS width, 600 AS height, x, y,
       CASE WHEN inside THEN (seed {div} 65536) % 256 ELSE 255 END AS r, CASE WHEN inside THEN (seed {div} 256) % 256 ELSE 255 END AS g,
       CASE WHEN inside THEN seed % 256 ELSE 255 END AS b, CASE WHEN inside THEN 100 + i % 156 ELSE 255 END AS a
FROM (SELECT {k}, i, i % 64 AS x, i {div} 64 AS y, i % 64 BETWEEN 4 AND 50 AND i {div} 64 BETWEEN 20 AND 570 AS inside,
             ({place} * 1103515245 + 12345) % 4294967296 AS seed FROM ({grid}) t) g
"""
_OUTCOMES = """
SELECT doc_id AS id, doc_id {div} 50 AS batch_id, concat('img_', doc_id, '.a.png') AS name,
 CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' ELSE 'avif' END AS format,
 n_chars AS original_size,
 CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 5 = 0 THEN n_chars
      ELSE n_chars * (30 + doc_id % 60) {div} 100 END AS compressed_size,
 64 + (doc_id * 37) % 4000 AS width, 64 + (doc_id * 53) % 3000 AS height,
 CASE WHEN doc_id % 11 = 0 THEN 'error' ELSE 'completed' END AS raw_status FROM {documents}
"""
_JOBS = """
SELECT doc_id AS id, doc_id {div} 50 AS batch_id, concat('img_', doc_id, CASE doc_id % 6 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG'
   WHEN 2 THEN '.webp' WHEN 3 THEN '.tif' WHEN 4 THEN '.heic' ELSE '.xyz' END) AS name,
 CASE doc_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/webp'
   WHEN 3 THEN 'image/svg+xml' ELSE '' END AS mime,
 64 + (doc_id * 37) % 4000 AS width, 64 + (doc_id * 53) % 3000 AS height,
 (doc_id * 17) % 101 AS quality,
 CASE doc_id % 5 WHEN 0 THEN 'photo' WHEN 1 THEN 'graphic' WHEN 2 THEN 'social' WHEN 3 THEN 'custom'
   ELSE 'nope' END AS preset_id,
 CASE doc_id % 7 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' WHEN 3 THEN 'avif' WHEN 4 THEN 'auto' ELSE 'gif' END AS format,
 CASE WHEN doc_id % 3 = 0 THEN 20 + doc_id % 400 END AS target_kb,
 n_chars AS original_size FROM {documents}
"""
_ACTIONS = """
SELECT event_id AS seq, ts, user_id % 8 AS library_id, event_id % 397 AS image_id,
 CASE WHEN event_id % 997 = 996 THEN 'CLEAR_ALL' WHEN event_id % 499 = 498 THEN 'SELECT_ALL'
      WHEN event_id % 293 = 292 THEN 'REMOVE_IMAGE' WHEN event_type = 'signup' THEN 'ADD_FILES'
      WHEN event_type = 'click' THEN 'TOGGLE_SELECT'
      WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'SELECT_IMAGE'
      WHEN event_type = 'view' THEN 'DESELECT_IMAGE' ELSE 'UPDATE_STATUS' END AS type,
 CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' END AS status FROM {events}
"""
#: All twelve kinds of action.
_FULL_ACTIONS = """
SELECT event_id AS seq, ts, user_id % 8 AS library_id,
 CASE WHEN event_id % 997 = 996 OR event_id % 499 = 498 OR event_id % 701 = 700 OR event_id % 97 = 96 OR event_id % 178 = 88 THEN NULL ELSE event_id % 397 END AS image_id,
 CASE WHEN event_id % 997 = 996 THEN 'CLEAR_ALL' WHEN event_id % 499 = 498 THEN 'SELECT_ALL' WHEN event_id % 701 = 700 THEN 'DESELECT_ALL'
      WHEN event_id % 97 = 96 THEN 'NEXT_QUEUE' WHEN event_id % 89 = 88 THEN 'SET_PREVIEW'
      WHEN event_id % 293 = 292 THEN 'REMOVE_IMAGE' WHEN event_type = 'signup' THEN 'ADD_FILES'
      WHEN event_type = 'click' THEN 'TOGGLE_SELECT'
      WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'SELECT_IMAGE'
      WHEN event_type = 'view' THEN 'DESELECT_IMAGE' WHEN event_type = 'purchase' THEN 'UPDATE_IMAGE' ELSE 'UPDATE_STATUS' END AS type,
 CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'already-optimized' WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'error' END AS status FROM {events}
"""
_TELEMETRY = """
SELECT event_id, ts, user_id,
 CASE event_type WHEN 'error' THEN 'error' ELSE 'funnel_stage' END AS name,
 CASE event_type WHEN 'signup' THEN 'landing' WHEN 'view' THEN 'upload' WHEN 'click' THEN 'completed'
      WHEN 'purchase' THEN 'download' END AS stage, value FROM {events}
"""
_USAGE = """
SELECT event_id, ts, user_id,
 CASE event_id % 12 WHEN 0 THEN 'image_upload' WHEN 1 THEN 'compression_complete' WHEN 2 THEN 'batch_complete' WHEN 3 THEN 'download' WHEN 4 THEN 'preset_select' WHEN 5 THEN 'format_change'
   WHEN 6 THEN 'quality_change' WHEN 7 THEN 'cta_click' WHEN 8 THEN 'external_link' WHEN 9 THEN 'funnel_stage' WHEN 10 THEN 'error' ELSE 'mystery' END AS name,
 concat('{{', CASE event_id % 12
   WHEN 0 THEN concat('"count":', 1 + event_id % 7, ',"totalSizeKb":', 100 + event_id % 900)
   WHEN 1 THEN concat('"originalSizeKb":', 200 + event_id % 800, ',"compressedSizeKb":', 20 + event_id % 180, ',"format":"', CASE event_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' WHEN 3 THEN 'avif' ELSE 'jxl' END, '","savingsPercent":', event_id % 91)
   WHEN 2 THEN concat('"imageCount":', 1 + event_id % 40, ',"totalOriginalKb":', event_id % 5000, ',"totalCompressedKb":', event_id % 2000, ',"avgSavingsPercent":', event_id % 77)
   WHEN 3 THEN concat('"format":"', CASE event_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' WHEN 3 THEN 'avif' ELSE 'svg' END, '","count":', 1 + event_id % 3)
   WHEN 4 THEN concat('"presetId":"', CASE event_id % 5 WHEN 0 THEN 'photo' WHEN 1 THEN 'graphic' WHEN 2 THEN 'social' ELSE 'custom' END, '"')
   WHEN 5 THEN '"format":"webp"' WHEN 6 THEN concat('"quality":', event_id % 101) WHEN 7 THEN concat('"ctaName":"start","location":"l', event_id % 4, '"')
   WHEN 8 THEN concat('"destination":"d', event_id % 9, '"') WHEN 9 THEN concat('"stage":"upload","timestamp":', 1700000000000 + event_id)
   WHEN 10 THEN concat('"errorType":"decode","errorMessage":"e', event_id % 6, '","context":"unknown"') ELSE '"x":1' END, '}}') AS props FROM {events}
"""
_BOXES = """
SELECT p_partkey AS id, (p_partkey*97) % 1000 AS x, (p_partkey*61) % 1000 AS y,
       10 + p_size AS w, 10 + p_partkey % 40 AS h FROM {part}
"""
_QUERY_BOXES = """
SELECT s_suppkey AS qid, (s_suppkey*131) % 1000 AS x, (s_suppkey*17) % 1000 AS y,
       s_suppkey % 80 AS w, 3 + s_suppkey % 60 AS h FROM {supplier}
"""
_MARKUP = """
SELECT page_id AS id, concat('<?xml version="1.0"?>', html, '<svg><metadata>m</metadata><path id="" d="M',
       page_id, '.12345 L2.', 1000 + page_id, ' 3.1"/></svg>') AS markup FROM {pages}
"""
_HASHED = "SELECT doc_id AS seq, concat('f', doc_id) AS name, sha2(text, 256) AS hash, n_chars AS size FROM {documents}"

#: Cells of a grid that one task lays out, about.
TASK_CELLS = 1 << 20
#: What is added to a key for the image's id.
_SHIFTS = {"pixels_big": 1_000_000_000, "pixels_photo": 2_000_000_000, "pixels_tall": 3_000_000_000}
#: name -> text, base table, key of the grid and its number of cells
_TABLES = {
    "pixels": (_PIXELS, "part", "p_partkey", 1024),
    "pixels_big": (_BIG, "supplier", "s_suppkey", 20000),
    "pixels_photo": (_PHOTO, "nation", "n_nationkey", 65536),
    "pixels_tall": (_TALL, "nation", "n_nationkey", 38400),
    "outcomes": (_OUTCOMES, "documents", None, 0),
    "jobs": (_JOBS, "documents", None, 0),
    "actions": (_ACTIONS, "events", None, 0),
    "full_actions": (_FULL_ACTIONS, "events", None, 0),
    "telemetry": (_TELEMETRY, "events", None, 0),
    "usage": (_USAGE, "events", None, 0),
    "boxes": (_BOXES, "part", None, 0),
    "query_boxes": (_QUERY_BOXES, "supplier", None, 0),
    "markup": (_MARKUP, "pages", None, 0),
    "hashed": (_HASHED, "documents", None, 0),
}


def _tasks(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """Tasks for the grids of some tables, by their number of cells."""
    cells = sum(spark.read.parquet(f"{sf_dir}/{_TABLES[n][1]}.parquet").count() * _TABLES[n][3] for n in names)
    return max(1, -(-cells // TASK_CELLS))


def table(spark: SparkSession, sf_dir: str, name: str, tasks: int | None = None) -> DataFrame:
    """A derived table for Spark; a grid's is dealt out by image, into ``tasks`` or as many as its cells need."""
    text, base, key, cells = _TABLES[name]
    source = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    if not cells:
        return spark.sql(text.replace("{div}", "div"), **{base: source})
    shift = _SHIFTS.get(name, 0)
    keys = source.selectExpr(f"cast({key} AS bigint) + {shift}L AS image").repartition(tasks or _tasks(spark, sf_dir, name), "image")
    grid = f"SELECT image, image - {shift}L AS k, explode(sequence(0L, {cells - 1}L)) AS i FROM {{keys}}"
    # a place is cut to its rest before it is multiplied: the same seeds, and no key is too large for them
    fill = {"{div}": "div", "{grid}": grid, "{image}": "image", "{k}": "image, k", "{place}": "((i + k*7919) % 4294967296)"}
    for mark, own in fill.items():
        text = text.replace(mark, own)
    found = spark.sql(text, keys=keys)
    return found.selectExpr("image_id", *(f"cast({c} AS int) AS {c}" for c in ("width", "height", "x", "y", "r", "g", "b", "a")))


#: Files that one task writes, into a folder of its own.
TASK_FILES = 1024


def files_of(rows: DataFrame, folder: str, below: str = "", number: int | None = None) -> None:
    """Write each row of ``name, content`` as a file of its own in a shared folder; tasks write side by side.

    With the ``number`` of rows these are dealt into tasks of some ``TASK_FILES`` first,
    however few partitions their table has. Each task has its own folder below the
    given one: listings of many small folders are dealt out as well, one of a large folder is not.
    """
    folder = f"{folder}/{below}" if below else folder
    rows = rows.select("name", "content")

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, path = fs.FileSystem.from_uri(folder)
        path = f"{path}/{TaskContext.get().partitionId()}"
        store.create_dir(path)
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                with store.open_output_stream(f"{path}/{name.as_py()}") as out:
                    out.write(content.as_buffer())
        yield from ()

    rows = rows if number is None else rows.repartition(max(1, -(-number // TASK_FILES)), "name")
    rows.mapInArrow(run, "n long").count()


def rasters_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three pixel tables, dealt out alike so that the union is still dealt by image."""
    names = ("pixels", "pixels_big", "pixels_photo")
    tasks = _tasks(spark, sf_dir, *names)
    first, *rest = (table(spark, sf_dir, n, tasks) for n in names)
    for other in rest:
        first = first.unionByName(other)
    return first


def duck(*names: str) -> str:
    """A WITH clause that defines derived tables for DuckDB; ``rasters`` is the three pixel tables."""
    parts = []
    for name in dict.fromkeys(["pixels", "pixels_big", "pixels_photo", *names] if "rasters" in names else names):
        if name == "rasters":
            continue
        text, base, key, cells = _TABLES[name]
        grid = f"SELECT {key} AS k, i FROM {base}, range({cells}) r(i)"
        image = f"k + {_SHIFTS[name]}" if name in _SHIFTS else "k"
        text = text.replace("{image}", image).replace("{k}", "k").replace("{place}", "(i + k*7919)")
        text = text.replace("{div}", "//").replace("{grid}", grid).replace(f"{{{base}}}", base).replace("{{", "{").replace("}}", "}").replace("sha2(text, 256)", "sha256(text)")
        parts.append(f"{name} AS MATERIALIZED ({text})" if cells else f"{name} AS ({text})")
    if "rasters" in names:
        parts.append("rasters AS (SELECT * FROM pixels UNION ALL SELECT * FROM pixels_big UNION ALL SELECT * FROM pixels_photo)")
    return "WITH " + ", ".join(parts) + " "
