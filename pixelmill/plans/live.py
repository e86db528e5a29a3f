"""Registered queries that move a table on: streams run in several runs over files, folds by steps, merges on read.

Each writes its derived input to the shared folder in parts, takes them one after
another, and returns what its table then holds. Folders go when the result is
settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import palette as K
from ..operators import state as S
from ..operators import stats as A
from ..sources import chunks, versioned
from ..sources.folders import new_folder, settled
from ..streaming import streams as ST
from .catalogue import _DONE, _KPI, _NAMED, _STATE, _USED, ORACLE_SQL, QUERIES, _half, _median_cut_sql, _pngs, _texts, query
from .derived import files_of

_FULL = _STATE.replace("FROM actions", "FROM full_actions").replace("= 'UPDATE_STATUS'", "IN ('UPDATE_STATUS','UPDATE_IMAGE')").replace("own AS (SELECT a.*, l.clr, l.wide, l.wide_type FROM full_actions a JOIN lib l USING (library_id) WHERE ", "own AS (SELECT a.*, l.clr, l.wide, l.wide_type FROM full_actions a JOIN lib l USING (library_id) WHERE type NOT IN ('SET_PREVIEW','NEXT_QUEUE') AND ")
_FULL_VIEW = f"""WITH {_FULL}, sel AS (SELECT i.*, EXISTS (SELECT 1 FROM own o WHERE o.library_id = i.library_id AND o.image_id = i.image_id AND o.seq = i.setter AND o.type = 'SELECT_IMAGE') AS by_own,
   (SELECT count(*) FROM own o WHERE o.library_id = i.library_id AND o.image_id = i.image_id AND o.type = 'TOGGLE_SELECT' AND o.seq > i.setter) AS toggles FROM img i)
 SELECT library_id, image_id, st.added, status, ((by_own OR (setter = wide AND coalesce(wide_type, '') = 'SELECT_ALL' AND added_b > removed_b AND added_b > clr))::INT + toggles) % 2 = 1 AS selected FROM sel JOIN st USING (library_id, image_id)"""
#: Parts of an action log, folded one after another.
STEPS = 5


def _advanced(actions: DataFrame, spark) -> tuple[S.LibrarySnapshot, str]:
    """A snapshot moved on over the whole log by ranges of seq, compacted half-way."""
    folder = new_folder(spark, "snapshot")
    snapshot = S.LibrarySnapshot(spark, folder)
    last = actions.agg(F.max("seq")).first()[0] or 0
    for k in range(1, STEPS + 1):
        snapshot.advance(actions.where(F.col("seq") <= last * k // STEPS))
        if k == STEPS // 2:
            snapshot.table.compact()
    return snapshot, folder


@query("w8_incremental_fold", _FULL_VIEW, "full_actions")
def _w8_incremental(t, spark):
    snapshot, folder = _advanced(t("full_actions"), spark)
    return settled(snapshot.view(), folder)


@query("w8_full_state", _FULL_VIEW, "full_actions")
def _w8_full(t, spark):
    return S.view(*S.fold(t("full_actions")))


@query("w8_previews", """WITH p AS (SELECT library_id, max(seq) FILTER (WHERE type = 'SET_PREVIEW') AS shown, max(seq) FILTER (WHERE type = 'CLEAR_ALL') AS clr FROM full_actions GROUP BY 1)
 SELECT p.library_id, a.image_id AS preview_id FROM p JOIN full_actions a ON a.library_id = p.library_id AND a.seq = p.shown WHERE a.image_id IS NOT NULL AND p.shown > coalesce(p.clr, -1)
  AND NOT EXISTS (SELECT 1 FROM full_actions r WHERE r.library_id = p.library_id AND r.image_id = a.image_id AND r.type = 'REMOVE_IMAGE' AND r.seq > p.shown)""", "full_actions")  # fmt: skip
def _w8_previews(t, spark):
    snapshot, folder = _advanced(t("full_actions"), spark)
    return settled(snapshot.previews(), folder)


@query("st2_stream_state", _FULL_VIEW, "full_actions")
def _st2_stream(t, spark):
    """Three runs with one checkpoint; actions come in no order over them."""
    actions, folder = t("full_actions"), new_folder(spark, "stream")
    with ST.rocksdb(spark):
        for k in range(3):
            actions.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == k).write.mode("append").parquet(f"{folder}/log")
            ST.run_to_table(ST.stream_state(spark.readStream.schema(actions.schema).parquet(f"{folder}/log"), shards=4), f"{folder}/changes", f"{folder}/checkpoint")
    return settled(ST.changed_state(spark.read.schema(ST.CHANGES).parquet(f"{folder}/changes")), folder)


def _st1_stream(spark, sf_dir: str) -> DataFrame:
    """Two runs with one checkpoint: the second sees only new files, and none whose content the first has taken."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "ingest")
    for k in range(2):
        part = docs.where(F.col("doc_id") % 2 == k)
        files_of(_texts(part), folder, "in", part.count())
        ST.ingest_to(spark, f"{folder}/in", f"{folder}/table", f"{folder}/checkpoint")
    found = spark.read.schema("path string, modificationTime timestamp, length long, hash string").parquet(f"{folder}/table")
    return settled(found.select("hash", "length"), folder)


QUERIES["st1_stream_ingest"] = _st1_stream
ORACLE_SQL["st1_stream_ingest"] = f"SELECT DISTINCT sha256(content) AS hash, strlen(content) AS length FROM ({_NAMED}) WHERE NOT ends_with(name, 'txt')"

#: What comes in time; the rest comes later, a tenth of it long behind the watermark.
_EARLY = "ts < TIMESTAMP '2024-01-20 00:00:00' AND event_id % 10 <> 0"
_MARKS = """marks AS (SELECT make_timestamp((epoch_ms(max(ts) FILTER (WHERE early)) - 3600000) * 1000) AS one, make_timestamp((epoch_ms(max(ts)) - 3600000) * 1000) AS two FROM parts)"""


def _late(usage: DataFrame, spark, stream) -> DataFrame:
    """The table that ``stream`` makes of parsed telemetry in two runs: what comes in time, then the rest."""
    folder, usage = new_folder(spark, "late"), usage.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need instants
    for part in (F.expr(_EARLY), ~F.expr(_EARLY)):
        usage.where(part).write.mode("append").parquet(f"{folder}/log")
        found = stream(ST.parse_telemetry(spark.readStream.schema(usage.schema).parquet(f"{folder}/log")))
        ST.run_to_table(found, f"{folder}/table", f"{folder}/checkpoint")
    table = spark.read.schema(found.schema).parquet(f"{folder}/table")
    return settled(table.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}), folder)


@query("st4_late_kpis", f"""WITH {_USED}, parts AS (SELECT *, {_EARLY} AS early, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start FROM used), {_MARKS},
 kept AS (SELECT p.* FROM parts p, marks WHERE early OR start + INTERVAL '1 hour' > one)
 SELECT start, start + INTERVAL '1 hour' AS "end", {_KPI} FROM kept, marks WHERE start + INTERVAL '1 hour' <= two GROUP BY 1, 2""", "usage", ("error_rate",))  # fmt: skip
def _st4_late(t, spark):
    return _late(t("usage"), spark, lambda df: ST.windowed_kpis(df, "1 hour"))


def _sessions_sql(source: str, name: str) -> str:
    return f"""{name}g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 {name}s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM {name}g),
 {name} AS (SELECT *, max(ts) OVER (PARTITION BY user_id, k) + INTERVAL '30 minutes' AS closes FROM {name}s)"""


@query("st6_late_sessions", f"""WITH {_USED}, parts AS (SELECT *, {_EARLY} AS early FROM used), marks AS (SELECT make_timestamp((epoch_ms(max(ts) FILTER (WHERE early)) - 1800000) * 1000) AS one, make_timestamp((epoch_ms(max(ts)) - 1800000) * 1000) AS two FROM parts),
 first AS (SELECT * FROM parts WHERE early), {_sessions_sql('first', 'fst')},
 second AS (SELECT event_id, ts, user_id, name, originalSizeKb, compressedSizeKb, savingsPercent FROM fst, marks WHERE closes > one UNION ALL SELECT event_id, ts, user_id, name, originalSizeKb, compressedSizeKb, savingsPercent FROM parts, marks WHERE NOT early AND ts + INTERVAL '30 minutes' > one), {_sessions_sql('second', 'snd')},
 closed AS (SELECT user_id, k, 1 AS run, ts, name, originalSizeKb, compressedSizeKb, savingsPercent FROM fst, marks WHERE closes <= one UNION ALL SELECT user_id, k, 2, ts, name, originalSizeKb, compressedSizeKb, savingsPercent FROM snd, marks WHERE closes <= two)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS events, count(*) FILTER (WHERE name = 'error') AS errors, count(*) {_DONE} AS images,
  {_half(f'coalesce(sum(originalSizeKb) {_DONE}, 0)')} AS original_kb, {_half(f'coalesce(sum(compressedSizeKb) {_DONE}, 0)')} AS compressed_kb, {_half(f'avg(savingsPercent) {_DONE}')} AS savings FROM closed GROUP BY user_id, k, run""", "usage")  # fmt: skip
def _st6_late(t, spark):
    return _late(t("usage"), spark, lambda df: ST.session_batches(df, "30 minutes"))


@query("u2_merge_on_read", f"""WITH {_STATE}, hashes AS (SELECT library_id, image_id, status, 50 AS progress, library_id || '/' || image_id AS hash, added AS seq FROM st),
 base AS (SELECT library_id, image_id, CASE WHEN status IN ('completed','already-optimized','error') THEN 'queued' ELSE status END AS status, CASE WHEN status IN ('completed','already-optimized','error') THEN 0 ELSE progress END AS progress, hash FROM hashes),
 incoming AS (SELECT library_id, image_id, library_id || '/' || image_id AS hash FROM actions WHERE type = 'TOGGLE_SELECT' GROUP BY 1, 2)
 SELECT library_id, image_id, status, progress FROM base UNION ALL SELECT library_id, image_id, 'queued', 0 FROM incoming WHERE hash NOT IN (SELECT hash FROM base)""", "actions")  # fmt: skip
def _u2_merge(t, spark):
    """A library as base and deltas: requeued, then new files (as finished ones), requeued again, compacted, and a last requeue that finds nothing."""
    actions, folder = t("actions"), new_folder(spark, "library")
    table = versioned.VersionedTable(spark, folder, "hash string, library_id long, image_id long, status string, progress int, seq long", ["hash"])
    key = F.concat_ws("/", "library_id", "image_id").alias("hash")
    table.put(S.library_state(actions).select(key, "library_id", "image_id", "status", F.lit(50).alias("progress"), F.col("added").alias("seq")))
    S.requeue_in(table)
    S.append_to(table, actions.where("type = 'TOGGLE_SELECT'").select(key, "library_id", "image_id", F.lit("completed").alias("status"), F.lit(100).alias("progress"), "seq"))
    S.requeue_in(table)
    table.compact()
    S.requeue_in(table)
    return settled(table.read().select("library_id", "image_id", "status", "progress"), folder)


@query("a5_color_sketches", None, "rasters")
def _a5_sketches(t, spark):
    """Estimates from stored sketches: those of even bands are written first, those of the others added; with the error against an exact count."""
    rasters, folder = t("rasters"), new_folder(spark, "sketches")
    for k in range(2):
        A.color_sketches(rasters.where(F.floor(F.col("y") / 8) % 2 == k), lines=8).write.mode("append").parquet(f"{folder}/sketches")
    stored = spark.read.parquet(f"{folder}/sketches")
    exact = A.unique_colors(rasters, "exact").withColumnRenamed("unique_colors", "exact")
    error = F.round((F.col("unique_colors") - F.col("exact")) / F.col("exact"), 6)
    return settled(A.colors_of(stored).join(exact, "image_id").select("image_id", "unique_colors", "exact", error.alias("relative_error")), folder)


@query("a11_median_cut_large", f"WITH {_median_cut_sql(4).replace('FROM pixels', 'FROM pixels_photo')} SELECT * FROM palette", "pixels_photo")
def _a11_large(t, spark):
    """Palettes of images that no task holds: every image of over 1000 colours is cut by sums."""
    return K.median_cut(A.color_histogram(t("pixels_photo")), 4, group=1000)


_PALETTE = "SELECT image_id, idx, (idx * 37 + CAST(image_id AS BIGINT) * 11) % 256 AS r, (idx * 91 + CAST(image_id AS BIGINT) * 5) % 256 AS g, (idx * 53 + CAST(image_id AS BIGINT) * 7) % 256 AS b, 255 AS a FROM (SELECT DISTINCT image_id FROM pixels_photo), {idx}"


@query("j6_nearest_color_256", f"""WITH palette AS ({_PALETTE.format(idx="range(256) t(idx)")}), h AS (SELECT image_id, r, g, b, a, count(*) AS cnt FROM pixels_photo GROUP BY ALL),
 d AS (SELECT h.*, min((h.r - p.r) * (h.r - p.r) + (h.g - p.g) * (h.g - p.g) + (h.b - p.b) * (h.b - p.b) + (h.a - p.a) * (h.a - p.a)) AS dist,
  arg_min(p.idx, ((h.r - p.r) * (h.r - p.r) + (h.g - p.g) * (h.g - p.g) + (h.b - p.b) * (h.b - p.b) + (h.a - p.a) * (h.a - p.a)) * 256 + p.idx) AS idx FROM h JOIN palette p ON p.image_id = h.image_id GROUP BY ALL)
 SELECT image_id, idx, count(*) AS colors, CAST(sum(cnt) AS BIGINT) AS pixels, CAST(sum(dist * cnt) AS BIGINT) AS error FROM d GROUP BY 1, 2""", "pixels_photo")  # fmt: skip
def _j6_large(t, spark):
    """Every colour of every photo against a palette of 256, by cells; added up by palette entry."""
    photo = t("pixels_photo")
    ids = photo.groupBy("image_id").agg(F.lit(1)).select("image_id")
    palette = ids.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(255)))).selectExpr("image_id", "idx", *(f"cast((idx * {m} + cast(image_id AS bigint) * {n}) % 256 AS int) AS {c}" for c, m, n in (("r", 37, 11), ("g", 91, 5), ("b", 53, 7))), "255 AS a")
    near = K.nearest_color_by_cell(A.color_histogram(photo), palette)
    return near.groupBy("image_id", "idx").agg(F.count("*").alias("colors"), F.sum("cnt").alias("pixels"), F.sum(F.col("dist").cast("long") * F.col("cnt")).alias("error"))


def _chunk_files(spark, sf_dir: str) -> str:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "png")
    files_of(_pngs(docs).select(F.concat(F.lit("i"), "image_id", F.lit(".png")).alias("name"), "content"), folder, number=docs.count())
    return folder


def _s5_scan(spark, sf_dir: str) -> DataFrame:
    folder = _chunk_files(spark, sf_dir)
    image = F.regexp_extract("path", r"i(\d+)\.png$", 1).cast("long").alias("image_id")
    return settled(chunks.scan_png_chunks(spark, folder).select(image, "seq", "name", "length", "is_metadata"), folder)


def _s5_folder(spark, sf_dir: str) -> DataFrame:
    folder = _chunk_files(spark, sf_dir)
    return settled(chunks.audit_png_folder(spark, folder), folder)


QUERIES["s5_scan_chunks"], ORACLE_SQL["s5_scan_chunks"] = _s5_scan, ORACLE_SQL["s5_png_chunks"]
QUERIES["s5_audit_folder"], ORACLE_SQL["s5_audit_folder"] = _s5_folder, ORACLE_SQL["s5_metadata_audit"]
