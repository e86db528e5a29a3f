"""The action log: one fold, folds in steps, streams and a plain fold in Python must agree."""

from __future__ import annotations

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from pixelmill.operators import state as S
from pixelmill.sources.versioned import VersionedTable

KINDS = ["ADD_FILES", "UPDATE_STATUS", "UPDATE_IMAGE", "NEXT_QUEUE", "CLEAR_ALL", "SELECT_IMAGE", "DESELECT_IMAGE", "SELECT_ALL", "DESELECT_ALL", "TOGGLE_SELECT", "SET_PREVIEW", "REMOVE_IMAGE"]
LOG = "seq long, library_id long, image_id long, type string, status string, w long"


def random_log(seed, n=400, libraries=3, images=9):
    rng = random.Random(seed)
    weights = [8, 6, 4, 1, 0.4, 5, 4, 1, 0.7, 8, 2, 3]
    rows = []
    for seq in range(n):
        kind = rng.choices(KINDS, weights)[0]
        image = None if kind in ("CLEAR_ALL", "SELECT_ALL", "DESELECT_ALL", "NEXT_QUEUE") or (kind == "SET_PREVIEW" and rng.random() < 0.3) else rng.randrange(images)
        status = rng.choice(["completed", "error", "compressing", None]) if kind.startswith("UPDATE") else None
        rows.append((seq, rng.randrange(libraries) if rng.random() < 0.6 else 0, image, kind, status, 1))
    return rows


def plain_fold(rows):
    """Action by action: what each library shows."""
    found = {}
    for seq, library, image, kind, status, _ in sorted(rows):
        images, selected, preview = found.setdefault(library, ({}, set(), [None]))
        if kind == "ADD_FILES":
            images[image] = [seq, "queued"]
        elif kind in ("UPDATE_STATUS", "UPDATE_IMAGE"):
            if image in images and status:
                images[image][1] = status
        elif kind == "CLEAR_ALL":
            images.clear(), selected.clear()
            preview[0] = None
        elif kind == "SELECT_IMAGE":
            selected.add(image)
        elif kind == "DESELECT_IMAGE":
            selected.discard(image)
        elif kind == "SELECT_ALL":
            selected.clear(), selected.update(images)
        elif kind == "DESELECT_ALL":
            selected.clear()
        elif kind == "TOGGLE_SELECT":
            selected.symmetric_difference_update({image})
        elif kind == "SET_PREVIEW":
            preview[0] = image
        elif kind == "REMOVE_IMAGE":
            images.pop(image, None), selected.discard(image)
            preview[0] = None if preview[0] == image else preview[0]
    view = {(library, i): (added, status, i in selected) for library, (images, selected, _) in found.items() for i, (added, status) in images.items()}
    return view, {library: p[0] for library, (_, _, p) in found.items() if p[0] is not None}


def shown(view):
    return {(r.library_id, r.image_id): (r.added, r.status, r.selected) for r in view.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_one_fold_equals_action_by_action(spark, seed):
    rows = random_log(seed)
    df = spark.createDataFrame(rows, LOG)
    entries, stamps = S.fold(df)
    view, previews = plain_fold(rows)
    assert shown(S.view(entries, stamps)) == view
    assert {r.library_id: r.preview_id for r in S.previews(entries, stamps).collect()} == previews
    assert {(r.library_id, r.image_id): (r.added, r.status) for r in S.library_state(df).collect()} == {k: v[:2] for k, v in view.items()}
    assert {(r.library_id, r.image_id) for r in S.selection_state(df).collect()} == {k for k, v in view.items() if v[2]}


@pytest.mark.parametrize("seed", [4, 5])
def test_ten_steps_equal_one_fold(spark, seed):
    rows = random_log(seed)
    df = spark.createDataFrame(rows, LOG)
    snapshot = S.LibrarySnapshot(spark, tempfile.mkdtemp(prefix="spark-"))
    for k in range(10):
        snapshot.advance(df.where(F.col("seq") < 40 * (k + 1)))  # all of the log so far: what is old is passed over
        if k in (3, 7):
            snapshot.table.compact()
        if k == 5:
            snapshot.advance(df.where("seq < 240"))  # nothing new
    view, previews = plain_fold(rows)
    assert shown(snapshot.view()) == view
    assert {r.library_id: r.preview_id for r in snapshot.previews().collect()} == previews


def test_a_step_writes_only_what_it_touches(spark):
    snapshot = S.LibrarySnapshot(spark, tempfile.mkdtemp(prefix="spark-"))
    rows = [(i, 0, i, "ADD_FILES", None, 1) for i in range(50)] + [(50, 0, None, "SELECT_ALL", None, 1), (51, 0, 7, "TOGGLE_SELECT", None, 1)]
    df = spark.createDataFrame(rows, LOG)
    snapshot.advance(df.where("seq < 50"))
    snapshot.advance(df)
    written = spark.read.parquet(f"{snapshot.table.path}/{2:012d}.delta")
    assert written.where("image_id is not null").count() == 1 and written.count() == 2
    assert {i for (_, i), v in shown(snapshot.view()).items() if v[2]} == set(range(50)) - {7}


def test_empty_and_odd_logs(spark):
    assert S.library_state(spark.createDataFrame([], LOG)).collect() == []
    odd = [(0, 0, None, "ADD_FILES", None, 1), (1, 0, 1, None, None, 1), (2, None, 1, "ADD_FILES", None, 1), (3, 0, 1, "WHAT", None, 1), (4, 0, 2, "ADD_FILES", None, 1), (5, 0, 2, "TOGGLE_SELECT", None, 1), (5, 0, 2, "TOGGLE_SELECT", None, 1), (None, 0, 3, "ADD_FILES", None, 1)]
    entries, stamps = S.fold(spark.createDataFrame(odd, LOG))
    assert shown(S.view(entries, stamps)) == {(0, 2): (4, "queued", True)}


def test_versioned_table(spark):
    table = VersionedTable(spark, tempfile.mkdtemp(prefix="spark-"), "k long, v string, _n int", ["k"])
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string, _n int")
    got = lambda: sorted(((r.k, r.v) for r in table.read().collect()), key=str)
    assert got() == [] and table.compact() == 1 and got() == []
    table.put(rows((1, "a", 0), (2, "b", 0), (None, "n", 0)))
    table.put(rows((2, "c", 0), (3, None, 0)))
    table.drop(rows((1, "x", 0), (None, None, 0)))
    table.put(rows((1, "again", 0)))
    want = [(1, "again"), (2, "c"), (3, None)]
    assert got() == want
    before = table.versions()
    # a compaction that broke off: files without Spark's mark are not seen, and the next write takes their place
    lost = f"{table.path}/{before[-1][0] + 1:012d}.base"
    os.makedirs(lost)
    with open(f"{lost}/part-00000.parquet", "wb") as f:
        f.write(b"broken")
    assert got() == want and table.versions() == before
    assert table.compact() == before[-1][0] + 1 and got() == want
    assert table.compact() == before[-1][0] + 1  # nothing to do
    table.put(rows((9, "z", 0)))
    table.compact()
    assert got() == [*want, (9, "z")] and len(table.versions()) < 8


def test_requeue_and_append_by_merge_on_read_equal_the_rewrite(spark):
    schema = "id long, status string, progress int, hash string, seq long"
    first = spark.createDataFrame([(i, ["queued", "completed", "error", "compressing", "already-optimized"][i % 5], 50, f"h{i % 7}", i) for i in range(7)], schema)
    incoming = spark.createDataFrame([(100 + i, "completed", 100, f"h{i % 11}", 100 + i) for i in range(30)], schema)
    table = VersionedTable(spark, tempfile.mkdtemp(prefix="spark-"), schema, ["hash"])
    table.put(first)
    S.requeue_in(table)
    S.append_to(table, incoming)
    S.requeue_in(table)
    whole = S.requeue(S.append(S.requeue(first), incoming))
    rows = lambda df: sorted(map(tuple, df.select("id", "status", "progress", "hash", "seq").collect()))
    assert rows(table.read()) == rows(whole)
    assert spark.read.parquet(f"{table.path}/{2:012d}.delta").count() == 4  # the finished ones only
    table.compact()
    assert rows(table.read()) == rows(whole)
