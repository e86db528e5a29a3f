"""Streaming runs held against their batch forms, and the driver contract."""

from __future__ import annotations

import os
import random
import shutil
import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from pixelmill.streaming import streams as ST

from .test_state import LOG, plain_fold, random_log, shown

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_ingest_drops_equal_content(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    for i, data in enumerate([b"a", b"b", b"a", b"c", b"d"]):
        with open(os.path.join(path, f"{i}.png"), "wb") as f:
            f.write(data)
    assert _run(ST.stream_ingest(spark, path), "ingest").count() == 4


def test_windowed_kpis_as_a_stream(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    props = ['{"errorType":"x","errorMessage":"m"}', '{"count":2,"totalSizeKb":10}', '{"originalSizeKb":9,"compressedSizeKb":3,"format":"webp","savingsPercent":66}', '{"format":"png","count":1}', '{"presetId":"photo"}']
    names = ["error", "image_upload", "compression_complete", "download", "preset_select"]
    rows = [(i, f"2024-01-01 0{i % 5}:10:00", i % 7, names[i % 5], props[i % 5]) for i in range(60)] + [(99, "2024-01-02 00:00:00", 1, "cta_click", '{"ctaName":"a"}')]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, name string, props string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.mode("overwrite").parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    got = {tuple(r) for r in _run(ST.windowed_kpis(ST.parse_telemetry(stream), "1 hour"), "kpis").collect()}
    want = {tuple(r) for r in ST.windowed_kpis(ST.parse_telemetry(df), "1 hour").collect()}
    assert got and got <= want and len(want) - len(got) <= 1


@pytest.mark.parametrize("seed", [11, 12])
def test_state_stream_equals_the_fold(spark, seed):
    """Three runs with one checkpoint; actions come in no order over them, some of them twice."""
    rows = random_log(seed)
    view, _ = plain_fold(rows)
    random.Random(seed).shuffle(rows)
    path = tempfile.mkdtemp(prefix="spark-")
    with ST.rocksdb(spark):
        for k in range(3):
            spark.createDataFrame(rows[k * 130 : k * 130 + 150], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
            changes = ST.stream_state(spark.readStream.schema(LOG).parquet(f"{path}/log"), shards=3)
            ST.run_to_table(changes, f"{path}/changes", f"{path}/checkpoint")
    log = spark.read.schema(ST.CHANGES).parquet(f"{path}/changes")
    assert shown(ST.changed_state(log)) == view
    # an action on all images gives one row in each part, not one for each image
    wide = sum(r[3] in ("CLEAR_ALL", "SELECT_ALL", "DESELECT_ALL", "SET_PREVIEW") for r in rows)
    assert log.where("image_id is null").count() <= 3 * wide


def test_selection_before_the_image_is_there(spark):
    rows = [(0, 0, 7, "SELECT_IMAGE", None, 1), (1, 0, 7, "ADD_FILES", None, 1), (2, 0, 8, "ADD_FILES", None, 1), (3, 0, 8, "UPDATE_IMAGE", "completed", 1)]
    df = spark.createDataFrame(rows, LOG)
    assert {(r.image_id, r.status, r.selected) for r in ST.state_view(df).collect()} == {(7, "queued", True), (8, "completed", False)}


def test_ingest_goes_on_after_a_restart(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    os.makedirs(f"{path}/in")

    def put(**files):
        for name, data in files.items():
            with open(f"{path}/in/{name}.png", "wb") as f:
                f.write(data)

    run = lambda: ST.ingest_to(spark, f"{path}/in", f"{path}/table", f"{path}/checkpoint")
    got = lambda: sorted(r.length for r in spark.read.parquet(f"{path}/table").collect())
    put(a=b"1", b=b"22", c=b"1")
    run()
    assert got() == [1, 2]
    run()  # nothing new
    put(d=b"22", e=b"333")  # one whose content came in the run before
    run()
    assert got() == [1, 2, 3]


def test_late_rows_are_left_out_and_counted(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    schema = "event_id long, ts timestamp, user_id long, name string, props string"

    def put(*hours):
        rows = [(k, f"2024-01-01 {h:02d}:10:00", 1, "error", "{}") for k, h in enumerate(hours)]
        spark.createDataFrame(rows, "event_id long, ts string, user_id long, name string, props string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{path}/log")

    def run():
        kpis = ST.windowed_kpis(ST.parse_telemetry(spark.readStream.schema(schema).parquet(f"{path}/log")), "1 hour")
        return ST.run_to_table(kpis, f"{path}/table", f"{path}/checkpoint")

    put(1, 2, 2, 9)
    assert ST.late_groups(run()) == 0
    put(2, 2, 8, 12)  # 2 o'clock is behind the watermark (8:10), 8 o'clock is not
    assert ST.late_groups(run()) == 1
    assert {(r.start.hour, r.events) for r in spark.read.parquet(f"{path}/table").collect()} == {(1, 1), (2, 2), (8, 1), (9, 1)}


def test_funnel_and_sessions(spark):
    rows = [(1, "landing", 0), (1, "upload", 1), (1, "completed", 2), (2, "upload", 0), (2, "landing", 5), (3, "landing", 90)]
    df = spark.createDataFrame(rows, "user_id long, stage string, m int").withColumn("ts", F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, m)")).withColumn("name", F.lit("compression_complete"))
    df = df.withColumns({c: F.lit(1.0) for c in ("originalSizeKb", "compressedSizeKb", "savingsPercent")})
    assert [(r.stage, r.users) for r in ST.funnel(df).orderBy("step").collect()] == [("landing", 3), ("upload", 1), ("completed", 1), ("download", 0)]
    assert sorted((r.user_id, r.images, r.original_kb) for r in ST.session_batches(df, "30 minutes").collect()) == [(1, 3, 3), (2, 2, 2), (3, 1, 1)]


def test_funnel_follows_the_order_of_events(spark):
    """A stage before its turn does not count against the same stage later on; against a plain walk over each user's events."""
    rng = random.Random(2)
    rows = [(u, rng.choice([*ST.STAGES, "other", None]), None if rng.random() < 0.02 else rng.randrange(40)) for u in range(40) for _ in range(rng.randrange(9))]
    rows += [(100, "upload", 1), (100, "landing", 2), (100, "upload", 3), (None, "landing", 1)]
    df = spark.createDataFrame(rows, "user_id long, stage string, m int").withColumn("ts", F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, m)"))
    reached = [0] * 4
    for u in {r[0] for r in rows if r[0] is not None}:
        since = -1
        for k, s in enumerate(ST.STAGES):
            since = min((m for v, stage, m in rows if v == u and stage == s and m is not None and m >= since), default=None)
            if since is None:
                break
            reached[k] += 1
    found = ST.funnel(df).orderBy("step").collect()
    assert [r.users for r in found] == reached and reached[1] > 3
    assert [round(r.conversion, 9) for r in found] == [round(reached[k] / reached[max(0, k - 1)], 9) if reached[max(0, k - 1)] else 0.0 for k in range(4)]
    assert [r.users for r in ST.funnel(df.where("false")).collect()] == [0] * 4


def test_queries_and_sql_agree_in_names():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert len(names) >= 60 and set(entry.oracle_sql()) <= names


def test_the_rest_stands_without_the_training_data_operators():
    """The entry point in copies of the repository that lack them, with and without the pipeline's file."""
    for pipeline in (True, False):
        copy = tempfile.mkdtemp(prefix="spark-")
        code = f"""
import shutil, sys
shutil.copytree({ROOT!r} + "/pixelmill", {copy!r} + "/pixelmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * {pipeline}:
    shutil.copy({ROOT!r} + "/" + name, {copy!r})
sys.path.insert(0, {copy!r})
import __spark_entry__ as e
assert e.__file__.startswith({copy!r})
assert not any(n.startswith("op") for n in e.queries()) and "a9_classify_images" in e.queries()
"""
        subprocess.run([sys.executable, "-c", code], check=True, cwd=copy, timeout=120)
    # the other tests import and are found without those folders
    ignore = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(f"{ROOT}/tests", f"{copy}/tests", ignore=ignore)
    found = subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_operators.py", "-k", "savings or status or tiny", "-p", "no:cacheprovider"], cwd=copy, timeout=300, capture_output=True, text=True)
    assert found.returncode == 0, found.stdout
    found = subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests", "-p", "no:cacheprovider"], cwd=copy, timeout=120, capture_output=True, text=True)
    assert found.returncode == 0 and "test_state" in found.stdout, found.stdout
