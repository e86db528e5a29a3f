"""Streaming ingest, state and usage metrics. Each has the same form over a batch table."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import half_up
from ..operators.state import OWN, UPDATES, WIDE, fold, view
from ..sources.files import LISTED, image_glob, list_files, read_files, reading_tasks
from ..sources.folders import cut, names, with_few

# The kinds of usage events.
EVENT_KINDS = ["image_upload", "compression_complete", "batch_complete", "download", "preset_select", "format_change", "quality_change", "cta_click", "external_link", "funnel_stage", "error"]
STAGES = ["landing", "upload", "completed", "download"]
# The properties of all kinds.
PROPS = (
    "count long, totalSizeKb double, originalSizeKb double, compressedSizeKb double, format string, savingsPercent double, imageCount long, totalOriginalKb double, totalCompressedKb double, avgSavingsPercent double, "
    "presetId string, quality long, ctaName string, location string, destination string, stage string, timestamp long, errorType string, errorMessage string, context string, value double"
)
#: Formats and presets that the metrics count one by one.
FORMATS, PRESET_IDS = ["png", "jpeg", "webp", "avif", "jxl", "svg"], ["photo", "graphic", "social", "custom"]


def stream_ingest(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """ST1: new image files as they come, one of each content hash within the watermark.

    Spark's own source of files: its driver remembers every file, and it leaves out
    files without content. ``ingest_to`` does neither.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", image_glob()).load(path)
    return _first_of_each(files, late)


def _first_of_each(files: DataFrame, late: str) -> DataFrame:
    return files.withColumn("hash", F.sha2("content", 256)).withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["hash"])


def ingest_to(spark: SparkSession, path: str, table: str, checkpoint: str, late: str = "1 hour") -> list[dict]:
    """ST1 as a run: what has come into ``path`` since the last run goes into ``table`` (without the content), each hash once.

    Files that no run has seen are listed by tasks and written below the checkpoint,
    and the stream follows that listing. So the driver knows the listing's few files
    and none of the images, and a listing whose run broke off is taken up by the next.
    """
    found = f"{checkpoint}/found"
    listed = list_files(spark, path)
    if names(spark, found):
        listed = cut(listed.join(spark.read.schema(LISTED).parquet(found).select("path"), "path", "left_anti"))
    tasks = reading_tasks(listed)
    if not names(spark, found) or listed.limit(1).count():
        listed.repartition(tasks, "path").write.mode("append").parquet(found)
    files = read_files(spark.readStream.schema(LISTED).parquet(found).repartition(tasks, "path"))
    return run_to_table(_first_of_each(files, late).drop("content"), table, checkpoint)


def ingest(files: DataFrame) -> DataFrame:
    """ST1 over a batch: one file of each content hash."""
    return files.withColumn("hash", F.sha2("content", 256)).dropDuplicates(["hash"])


#: Parts of a library's state; an image's part follows from its id, so one large library is many tasks.
SHARDS = 16
CHANGES = (
    "library_id long, image_id long, version long, adds array<long>, removed long, status string, status_seq long, setter long, setter_value boolean, toggles array<long>, "
    "clear long, wide long, wide_type string, preview_seq long, preview_id long"
)
_ENTRY = "adds string, removed long, status string, status_seq long, setter long, setter_value boolean, toggles string, version long"


class _Library(StatefulProcessor):
    """A part of one library: stamps of its last actions on all images, and what is known of each image.

    An action on all images changes the stamps alone; entries are read in their
    light. All that is kept is the greatest seq of each kind, and the seqs of adds
    and toggles that may still count, so the order in which actions come, within a
    batch or over several, does not matter, nor does an action that comes twice.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stamps = handle.getValueState("stamps", "clear long, wide long, wide_type string, preview_seq long, preview_id long")
        self.images = handle.getMapState("images", "image_id long", _ENTRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clear, wide, wide_type, preview_seq, preview_id = self.stamps.get() if self.stamps.exists() else (-1, -1, None, -1, None)
        before, touched = (clear, wide, preview_seq), {}
        for log in rows:
            for seq, image, kind, status in zip(log["seq"], log["image_id"], log["type"], log["status"], strict=True):
                seq, image, status = int(seq), None if pd.isna(image) else int(image), None if pd.isna(status) else status
                if kind in WIDE:
                    clear = max(clear, seq) if kind == "CLEAR_ALL" else clear
                    wide, wide_type = max((wide, wide_type), (seq, kind), key=lambda x: x[0])
                elif kind == "SET_PREVIEW":
                    preview_seq, preview_id = max((preview_seq, preview_id), (seq, image), key=lambda x: x[0])
                elif kind in OWN and image is not None:
                    if image not in touched:
                        touched[image] = self._entry(image)
                    self._apply(touched[image], seq, kind, status)
        if (clear, wide, preview_seq) != before:
            self.stamps.update((clear, wide, wide_type, preview_seq, preview_id))
            yield self._changes(key, [(None, None, None, None, None, None, None, None, None, clear, wide, wide_type, preview_seq, preview_id)])
        out = []
        for image, e in touched.items():
            e["adds"] = sorted(x for x in e["adds"] if x > max(e["removed"], clear))
            e["toggles"] = sorted(x for x in e["toggles"] if x > max(e["setter"], wide))
            e["version"] += 1
            text = lambda seqs: ",".join(map(str, seqs))
            self.images.updateValue((image,), (text(e["adds"]), e["removed"], e["status"], e["status_seq"], e["setter"], e["setter_value"], text(e["toggles"]), e["version"]))
            out.append((image, e["version"], e["adds"], e["removed"], e["status"], e["status_seq"], e["setter"], e["setter_value"], e["toggles"], None, None, None, None, None))
        if out:
            yield self._changes(key, out)

    def _entry(self, image: int) -> dict:
        if not self.images.containsKey((image,)):
            return {"adds": set(), "removed": -1, "status": None, "status_seq": -1, "setter": -1, "setter_value": False, "toggles": set(), "version": 0}
        adds, removed, status, status_seq, setter, value, toggles, version = self.images.getValue((image,))
        seqs = lambda text: {int(x) for x in text.split(",") if x}
        return {"adds": seqs(adds), "removed": removed, "status": status, "status_seq": status_seq, "setter": setter, "setter_value": value, "toggles": seqs(toggles), "version": version}

    @staticmethod
    def _apply(e: dict, seq: int, kind: str, status: str | None) -> None:
        if kind == "ADD_FILES":
            e["adds"].add(seq)
        elif kind == "TOGGLE_SELECT":
            e["toggles"].add(seq)
        elif kind in UPDATES:
            if status is not None and seq > e["status_seq"]:
                e["status"], e["status_seq"] = status, seq
        else:
            if kind == "REMOVE_IMAGE":
                e["removed"] = max(e["removed"], seq)
            if seq > e["setter"]:
                e["setter"], e["setter_value"] = seq, kind == "SELECT_IMAGE"

    @staticmethod
    def _changes(key, rows: list[tuple]) -> pd.DataFrame:
        names = [f.split()[0] for f in CHANGES.split(", ")]
        found = pd.DataFrame([(key[0], *r) for r in rows], columns=names)
        whole = {f.split()[0]: {"long": "Int64", "boolean": "boolean"}.get(f.split()[1], "object") for f in CHANGES.split(", ")}
        return found.astype(whole)

    def close(self) -> None:
        pass


def stream_state(actions: DataFrame, shards: int = SHARDS) -> DataFrame:
    """ST2: a log of what changes in each library: entries of the images that actions name, and stamps of the libraries.

    An action on all images goes to every part of its library and gives one row
    there, however many images it is about. ``changed_state`` reads the log. Needs
    the RocksDB state store.
    """
    wide = F.col("type").isin(*WIDE, "SET_PREVIEW")
    part = F.when(wide, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.pmod(F.xxhash64("image_id"), F.lit(shards)).cast("int")))
    dealt = actions.where("library_id is not null and seq is not null and type is not null").select("library_id", "seq", "image_id", "type", "status", F.explode(part).alias("shard"))
    return dealt.groupBy("library_id", "shard").transformWithStateInPandas(statefulProcessor=_Library(), outputStructType=CHANGES, outputMode="Append", timeMode="None")


def changed_state(changes: DataFrame) -> DataFrame:
    """``library_id, image_id, added, status, selected`` of the images that are present after all changes of ST2's log."""
    entry = ["adds", "removed", "status", "status_seq", "setter", "setter_value", "toggles"]
    last = changes.where("image_id is not null").groupBy("library_id", "image_id").agg(F.max_by(F.struct(*entry), "version").alias("e")).select("library_id", "image_id", "e.*")
    stamps = changes.where("image_id is null").groupBy("library_id").agg(F.max("clear").alias("clear"), F.max("wide").alias("wide"), F.max_by("wide_type", "wide").alias("wide_type"))
    both = with_few(last, stamps, "library_id", "left").withColumns({"clear": F.coalesce("clear", F.lit(-1)), "wide": F.coalesce("wide", F.lit(-1))})
    both = both.withColumn("adds", F.filter("adds", lambda x: x > F.greatest("removed", "clear"))).where(F.size("adds") > 0).withColumn("added", F.array_max("adds"))
    there = F.exists("adds", lambda x: x < F.col("wide"))  # adds after the last removal and clearing
    base = F.when(F.col("setter") > F.col("wide"), F.col("setter_value")).otherwise((F.coalesce("wide_type", F.lit("")) == "SELECT_ALL") & there)
    flips = F.size(F.filter("toggles", lambda x: x > F.greatest("setter", "wide"))) % 2 == 1
    return both.select("library_id", "image_id", "added", F.when(F.col("status_seq") > F.col("added"), F.col("status")).otherwise(F.lit("queued")).alias("status"), (base != flips).alias("selected"))


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Run a stream over all that its source holds now into a Parquet table; returns the progress of each batch.

    With the same checkpoint the next run goes on where this one ended: nothing is
    read twice, and the table gets each result once. Both folders have to be shared.
    """
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]


def late_groups(progress: list[dict]) -> int:
    """How many groups of late rows (partial sums of one task) a run dropped behind the watermark."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in progress for op in p.get("stateOperators", []))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store, which ST2 needs, while queries start and run."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)


def state_view(actions: DataFrame) -> DataFrame:
    """ST2 over a batch: the images of each library after the whole log, with status (W8) and selection."""
    return view(*fold(actions)).drop("added")


def parse_telemetry(df: DataFrame) -> DataFrame:
    """ST3: properties by name and type; an unknown kind keeps its text in ``rejected``."""
    known = F.col("name").isin(EVENT_KINDS)
    return df.withColumn("p", F.when(known, F.from_json("props", PROPS))).withColumn("rejected", F.when(~known, F.col("props"))).select("event_id", "ts", "user_id", "name", "p.*", "rejected")


def windowed_kpis(df: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """ST4: uploads, completions, KB in and out, downloads by format, preset picks and errors in tumbling or sliding windows.

    ``df`` is parsed telemetry (ST3) with ``ts``. Over a stream, rows later than the watermark are dropped.
    """
    of = lambda kind: F.col("name") == kind
    total = lambda kind, c: F.coalesce(F.sum(F.when(of(kind), F.col(c))), F.lit(0)).alias
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    kpis = df.withWatermark("ts", late).groupBy(window.alias("w")).agg(
        F.count("*").alias("events"), total("image_upload", "count")("uploads"), total("image_upload", "totalSizeKb")("upload_kb"),
        F.count_if(of("compression_complete")).alias("completed"), total("compression_complete", "originalSizeKb")("kb_in"), total("compression_complete", "compressedSizeKb")("kb_out"),
        total("download", "count")("downloads"), *(F.count_if(of("download") & (F.col("format") == f)).alias(f"downloads_{f}") for f in FORMATS),
        *(F.count_if(of("preset_select") & (F.col("presetId") == p)).alias(f"picks_{p}") for p in PRESET_IDS), F.count_if(of("error")).alias("errors"),
    )
    return kpis.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(c for c in kpis.columns if c != "w"), (F.col("errors") / F.col("events")).alias("error_rate"))


def funnel(df: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """ST5: users that reach each stage after all before it, and the share of those of the stage before.

    A user reaches a stage with the first of its events that comes no earlier than
    the one that reached the stage before, whatever else lies in between. Stage by
    stage, the events of one stage meet one time for each user, and the least that
    fits is taken before the shuffle; a user with very many events is many tasks.
    """
    stages = stages or STAGES
    of = lambda s: df.where((F.col("stage") == s) & F.col("ts").isNotNull() & F.col("user_id").isNotNull()).select("user_id", "ts")
    reached, counts = None, []
    for s in stages:
        events = of(s) if reached is None else of(s).join(reached, "user_id").where("ts >= since").select("user_id", "ts")
        reached = cut(events.groupBy("user_id").agg(F.min("ts").alias("since")))
        counts.append(reached.count())
    rows = [(i, s, counts[i], counts[i] / counts[max(0, i - 1)] if counts[max(0, i - 1)] else 0.0) for i, s in enumerate(stages)]
    return df.sparkSession.createDataFrame(rows, "step int, stage string, users long, conversion double")


def session_batches(df: DataFrame, gap: str) -> DataFrame:
    """ST6: runs of a user's events without a pause of ``gap``, with the summary of the images that they completed (A2)."""
    done = F.col("name") == "compression_complete"
    total = lambda c: half_up(F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0.0)))
    s = df.withWatermark("ts", gap).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("events"), F.count_if(F.col("name") == "error").alias("errors"), F.count_if(done).alias("images"),
        total("originalSizeKb").alias("original_kb"), total("compressedSizeKb").alias("compressed_kb"), half_up(F.avg(F.when(done, F.col("savingsPercent")))).alias("savings"),
    )
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(c for c in s.columns if c not in ("user_id", "w")))
