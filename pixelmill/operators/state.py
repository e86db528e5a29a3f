"""Library state folded from an action log, and duplicates within a batch.

The fold has two tables. ``entries`` has one row for each image that was ever
touched: when it was last added and removed, its status, whether it was selected
after its own last action, and the place of that action. ``stamps`` has one row for
each library: its last clearing, its last action on all images and what that was,
and its preview. An action on all images rewrites no entry: an entry that is older
than the stamp is read in its light. So a fold over newer actions touches only the
images that they name, and all of its sums are made before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.folders import cut, with_few
from ..sources.versioned import VersionedTable

WIDE = ["CLEAR_ALL", "SELECT_ALL", "DESELECT_ALL"]
SETTERS = ["SELECT_IMAGE", "DESELECT_IMAGE", "REMOVE_IMAGE"]
UPDATES = ["UPDATE_STATUS", "UPDATE_IMAGE"]
#: Kinds that name an image; the others are WIDE, SET_PREVIEW, and NEXT_QUEUE, which changes no image.
OWN = ["ADD_FILES", *UPDATES, "TOGGLE_SELECT", *SETTERS]
FINISHED = ["completed", "already-optimized", "error"]
ENTRIES = {"added": "long", "removed": "long", "status": "string", "selected": "boolean", "as_of": "long"}
STAMPS = {"clear": "long", "wide": "long", "wide_type": "string", "preview_seq": "long", "preview_id": "long", "high": "long"}
STATE = ", ".join(f"{c} {t}" for c, t in {"library_id": "long", "image_id": "long", **ENTRIES, **STAMPS}.items())


#: Seqs that one task orders for a hash.
SEQS = 1 << 16


def rank_duplicates(df: DataFrame, seqs: int = SEQS) -> DataFrame:
    """The place of each file among those of its hash, in order of seq; 1 is the one kept.

    Files are ordered within stretches of seq; what lies before a stretch comes from
    counts, one row for each stretch that a hash has, so a hot hash is many tasks.
    Files of equal hash and seq come in any order; a null hash or seq is a value.
    """
    stretch = F.floor(F.col("seq") / seqs)
    rows = df.withColumn("_stretch", stretch).withColumn("_place", F.row_number().over(Window.partitionBy("hash", "_stretch").orderBy("seq")))
    counts = df.groupBy("hash", stretch.alias("_stretch")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("hash").orderBy("_stretch")) - F.col("_n")).where("_before > 0").select(F.col("hash").alias("_hash"), F.col("_stretch").alias("_at"), "_before")
    both = rows.join(before, F.col("hash").eqNullSafe(F.col("_hash")) & F.col("_stretch").eqNullSafe(F.col("_at")), "left")
    return both.select(*df.columns, (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("int").alias("dup_rank"))


def first_of_each(df: DataFrame) -> DataFrame:
    """The files with rank 1, added up before the shuffle, so that a hot hash is one row a task."""
    cols = [c for c in df.columns if c != "hash"]
    return df.groupBy("hash").agg(F.min_by(F.struct(*cols), "seq").alias("first")).select("hash", "first.*")


def append(library: DataFrame, incoming: DataFrame) -> DataFrame:
    """The library and the new files: first of each hash, and not yet in the library."""
    fresh = first_of_each(incoming).join(library.select("hash"), "hash", "left_anti")
    return library.unionByName(fresh, allowMissingColumns=True)


def append_to(table: VersionedTable, incoming: DataFrame) -> None:
    """U1 as a merge on read: only the new files are written, as a change of a table keyed by ``hash``."""
    table.put(first_of_each(incoming).join(table.read().select("hash"), "hash", "left_anti"))


def requeue(state: DataFrame) -> DataFrame:
    """Finished and failed images go back to the queue with progress 0."""
    done = F.col("status").isin(*FINISHED)
    return state.withColumn("progress", F.when(done, 0).otherwise(F.col("progress"))).withColumn("status", F.when(done, F.lit("queued")).otherwise(F.col("status")))


def requeue_in(table: VersionedTable) -> None:
    """U2 as a merge on read: only the images that go back to the queue are written."""
    table.put(requeue(table.read().where(F.col("status").isin(*FINISHED))))


def _last(*types: str, when: Column | None = None) -> Column:
    of = F.col("type").isin(*types)
    return F.max(F.when(of if when is None else of & when, F.col("seq")))


def _or(c: str | Column, other=-1) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(other))


def _stamps(actions: DataFrame) -> DataFrame:
    """One row per library of a log."""
    wide, shown = F.col("type").isin(*WIDE), F.col("type") == "SET_PREVIEW"
    return actions.groupBy("library_id").agg(
        _or(_last("CLEAR_ALL")).alias("clear"), _or(_last(*WIDE)).alias("wide"), F.max_by("type", F.when(wide, F.col("seq"))).alias("wide_type"),
        _or(_last("SET_PREVIEW")).alias("preview_seq"), F.max_by("image_id", F.when(shown, F.col("seq"))).alias("preview_id"), F.max("seq").alias("high"),
    )


def _selected(clear: Column, wide: Column, wide_type: Column) -> Column:
    """Whether an entry is selected under its library's stamps."""
    by_all = (_or(wide_type, "") == "SELECT_ALL") & (F.col("added") > F.greatest(F.col("removed"), clear))
    return F.when(wide > F.col("as_of"), by_all).otherwise(F.col("selected"))


def fold(actions: DataFrame, entries: DataFrame | None = None, stamps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries of the images and stamps of the libraries that ``actions`` touch, on top of earlier ones.

    ``actions`` is ``library_id, image_id, seq, type, status``, all of it later than
    what was folded before. The result replaces the earlier rows of the same keys.
    A null kind, an unknown one, and an image's action without an image do nothing;
    of actions with equal seq in a library, toggles count once.
    """
    actions = actions.where("library_id is not null and seq is not null").select("library_id", "image_id", "seq", "type", "status")
    new = cut(_stamps(actions))
    old = new.select("library_id").join(stamps, "library_id") if stamps is not None else None
    before = {c: F.lit(None).cast(t).alias(f"p_{c}") for c, t in STAMPS.items()}
    both = new.select("*", *before.values()) if old is None else new.join(old.select("library_id", *(F.col(c).alias(f"p_{c}") for c in STAMPS)), "library_id", "left")
    later = F.col("wide") >= _or("p_wide")
    shown = F.col("preview_seq") >= _or("p_preview_seq")
    told = both.select(
        "library_id", F.greatest("clear", _or("p_clear")).alias("clear"), F.greatest("wide", _or("p_wide")).alias("wide"), F.when(later, F.col("wide_type")).otherwise(F.col("p_wide_type")).alias("wide_type"),
        F.greatest("preview_seq", _or("p_preview_seq")).alias("preview_seq"), F.when(shown, F.col("preview_id")).otherwise(F.col("p_preview_id")).alias("preview_id"), F.greatest("high", _or("p_high")).alias("high"),
    )
    light = both.select("library_id", F.col("wide").alias("w"), F.col("wide_type").alias("w_type"), F.greatest("clear", _or("p_clear")).alias("clear"), _or("p_clear").alias("p_clear"), _or("p_wide").alias("p_wide"), "p_wide_type")
    own = with_few(actions.where(F.col("type").isin(*OWN) & F.col("image_id").isNotNull()), light.select("library_id", "w"), "library_id")
    after, set_ = F.col("seq") > F.col("w"), F.col("type").isin(*SETTERS) & (F.col("seq") > F.col("w"))
    updated = F.col("type").isin(*UPDATES) & F.col("status").isNotNull()
    images = own.groupBy("library_id", "image_id").agg(
        F.max("w").alias("w"), _or(_last("ADD_FILES")).alias("n_added"), _or(_last("REMOVE_IMAGE")).alias("n_removed"), _or(_last("ADD_FILES", when=~after)).alias("added_b"), _or(_last("REMOVE_IMAGE", when=~after)).alias("removed_b"),
        _or(F.max(F.when(set_, F.col("seq")))).alias("setter"), F.max_by("type", F.when(set_, F.col("seq"))).alias("set_type"),
        _or(F.max(F.when(updated, F.col("seq")))).alias("status_seq"), F.max_by("status", F.when(updated, F.col("seq"))).alias("n_status"), F.max("seq").alias("n_as_of"),
    )
    images = images.withColumn("since", F.greatest("setter", "w"))
    toggles = own.where("type = 'TOGGLE_SELECT'").select("library_id", "image_id", "seq").join(images.select("library_id", "image_id", "since"), ["library_id", "image_id"]).where("seq > since")
    flips = toggles.groupBy("library_id", "image_id").agg(F.count_distinct("seq").alias("flips"))
    all_ = with_few(images.join(flips, ["library_id", "image_id"], "left"), light.drop("w"), "library_id")
    if entries is None:
        all_ = all_.withColumns({c: F.lit(None).cast(t) for c, t in ENTRIES.items()})
    else:
        all_ = all_.join(entries.select("library_id", "image_id", *ENTRIES), ["library_id", "image_id"], "left")
    all_ = all_.withColumns({"added": _or("added"), "removed": _or("removed"), "as_of": _or("as_of"), "selected": _or("selected", False)})
    was = _selected(F.col("p_clear"), F.col("p_wide"), F.col("p_wide_type"))
    there = F.greatest("added", "added_b") > F.greatest("removed", "removed_b", "clear")
    base = F.when(F.col("setter") > F.col("w"), F.col("set_type") == "SELECT_IMAGE").when(F.col("w") >= 0, (_or("w_type", "") == "SELECT_ALL") & there).otherwise(was)
    added = F.greatest("added", "n_added")
    status = F.when(F.col("status_seq") > added, F.col("n_status")).when(F.col("n_added") > F.col("added"), F.lit("queued")).otherwise(_or("status", "queued"))
    done = all_.select("library_id", "image_id", added.alias("added"), F.greatest("removed", "n_removed").alias("removed"), status.alias("status"), (base != (_or("flips", 0) % 2 == 1)).alias("selected"), F.greatest("as_of", "n_as_of").alias("as_of"))
    return done, told


def view(entries: DataFrame, stamps: DataFrame) -> DataFrame:
    """``library_id, image_id, added, status, selected`` of the images that are present."""
    both = with_few(entries, stamps.select("library_id", "clear", "wide", "wide_type"), "library_id")
    present = both.where(F.col("added") > F.greatest("removed", "clear"))
    return present.select("library_id", "image_id", "added", "status", _selected(F.col("clear"), F.col("wide"), F.col("wide_type")).alias("selected"))


def previews(entries: DataFrame, stamps: DataFrame) -> DataFrame:
    """``library_id, preview_id``: the image on show in each library that has one; clearing, or removing that image, ends it."""
    shown = stamps.where("preview_id is not null and preview_seq > clear").select("library_id", F.col("preview_id").alias("image_id"), "preview_seq")
    found = shown.join(entries.select("library_id", "image_id", "removed"), ["library_id", "image_id"], "left")
    return found.where(_or("removed") < F.col("preview_seq")).select("library_id", F.col("image_id").alias("preview_id"))


def library_state(actions: DataFrame) -> DataFrame:
    """``library_id, image_id, added, status`` of the images that are present.

    An image is present if its last ADD_FILES comes after its last REMOVE_IMAGE and
    the library's last CLEAR_ALL. Its status is the last one that UPDATE_STATUS or
    UPDATE_IMAGE set after that, or queued. Order is by seq.
    """
    return view(*fold(actions)).drop("selected")


def selection_state(actions: DataFrame) -> DataFrame:
    """``library_id, image_id`` of images that are present and selected.

    The last action that sets an image's selection counts, whether its own or on
    all images, then the parity of its toggles after it. Selecting all marks the
    images present at that moment, and only those; an absent image can be marked on
    its own and is selected once it is added.
    """
    return view(*fold(actions)).where("selected").select("library_id", "image_id")


class LibrarySnapshot:
    """Library state kept as a table of entries and stamps, moved on by the newer actions of a log.

    ``advance`` reads only actions past the high-water mark of their library, and
    writes only the images and libraries that they touch, in one atomic step. A
    step that broke off left the mark where it was and is simply taken again.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = VersionedTable(spark, path, STATE, ["library_id", "image_id"])

    def entries(self) -> DataFrame:
        return self.table.read().where("image_id is not null").select("library_id", "image_id", *ENTRIES)

    def stamps(self) -> DataFrame:
        return self.table.read().where("image_id is null").select("library_id", *STAMPS)

    def advance(self, actions: DataFrame) -> None:
        """Fold the actions that are newer than what was folded before."""
        first = not self.table.versions()
        stamps = None if first else cut(self.stamps())
        if stamps is not None:
            actions = with_few(actions, stamps.select("library_id", F.col("high").alias("_high")), "library_id", "left").where(F.col("seq") > _or("_high")).drop("_high")
        entries, told = fold(actions, None if first else self.entries(), stamps)
        self.table.put(entries.unionByName(told.withColumn("image_id", F.lit(None).cast("long")), allowMissingColumns=True))

    def view(self) -> DataFrame:
        return view(self.entries(), self.stamps())

    def previews(self) -> DataFrame:
        return previews(self.entries(), self.stamps())
