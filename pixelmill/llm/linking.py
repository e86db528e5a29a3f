"""Linking texts that share a bucket and have a Jaccard similarity (DataFrame functions only).

Candidates come as rows ``band, h, sketch``: texts (by their hash ``h``) of one band
meet. In each of a few turns, a text is compared with one partner of another
component: the text that comes first in its bucket, in another order each turn, in
most of its bands. That links nearly all of a class at a cost that follows its size;
sketches only choose the partners. Where a bucket still holds several components after
that, crowded ones have further turns, which leave fewer components, and then all
texts of different components are compared, but for pairs that cannot be
similar for certain: the numbers of their distinct shingles differ too much, or the
parities of their shingles in 512 cells (2048 in crowded buckets) differ in more cells than
two similar sets have shingles apart. No similar pair of a bucket is left out. Large buckets are dealt
into blocks, and into pairs of blocks for the last comparison, so no bucket is one task.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import checkpointed, dropped, released, shuffle_partitions, written

SIMILARITY = 0.8
#: Texts of a bucket that one block holds, about.
BLOCK = 512
#: Turns in which each text meets one partner.
TURNS = 2
#: Texts of a bucket that is crowded, and the turns that its texts have at most.
CROWDED, CROWDED_TURNS = 64, 5
#: Further turns end once fewer than this share of their pairs are similar.
WORTH = 0.05
#: One text in so many is counted to find the buckets that need several blocks.
COUNTED = 16
#: Of the sketch's rows that are filled, this share and so many more may differ between partners of a turn.
DIFFERS, MORE = 0.2, 2
#: Words of 64 parities of a text's shingles, and of a text in a crowded bucket.
PARITIES, FINE = 8, 32
#: Hashes (8 bytes each) that are broadcast to fetch their texts or rows; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Shingle hashes (8 bytes each) of texts whose sets are broadcast to the pairs; more are joined by a shuffle.
BROADCAST_SHINGLES = 2_000_000


class Unit(NamedTuple):
    """What a text's shingles are made of: its units, their number, a stretch of them, the stretch's size."""

    data: Callable[[Column], Column]
    length: Callable[[Column], Column]
    cut: Callable[[Column, Column, Column], Column]
    size: int

    def places(self, data: Column) -> Column:
        return F.sequence(F.lit(1), F.greatest(F.lit(1), self.length(data) - (self.size - 1)))

    def piece(self, data: Column, i: Column) -> Column:
        return self.cut(data, i, F.lit(self.size))

    def shingles(self, data: Column) -> Column:
        """The distinct shingles' hashes; ``data`` has to be a column as it stands, not computed."""
        return F.array_distinct(F.transform(self.places(data), lambda i: F.xxhash64(self.piece(data, i))))


def _alike(a: Column, b: Column) -> Column:
    """Whether two sketches agree on enough rows; two bits stand for a row, 0 for one without shingles."""
    cells = lambda x: F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return cells(a.bitwiseXOR(b)) <= cells(a.bitwiseOR(b)) * DIFFERS + MORE


def _few(df: DataFrame) -> DataFrame:
    """The same rows, to be broadcast if their number allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _fetched(wanted: DataFrame, texts: DataFrame, unit: Unit) -> DataFrame:
    """``h, data, n`` of the texts of distinct hashes ``h``, as a written table; ``n`` counts units."""
    # the aggregate leaves one of equal texts; the table keeps the cutting out of the loop over places
    found = texts.join(_few(wanted), "h", "left_semi").groupBy("h").agg(F.first("line").alias("line")).select("h", unit.data(F.col("line")).alias("data"))
    return written(found.select("h", "data", unit.length(F.col("data")).alias("n")))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("h")).distinct()


def _parities(table: DataFrame, unit: Unit) -> DataFrame:
    """``h, k, bits, fine`` of a fetched table: the number of distinct shingles, and the parity of those in each cell, by two numbers of cells."""
    rows = table.select("h", F.explode(unit.shingles(F.col("data"))).alias("s")).repartition(shuffle_partitions(table.sparkSession), "h")
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(s, 58) as int))")
    words = rows.select("h", F.col("s").bitwiseAND(FINE - 1).cast("int").alias("w"), bit.alias("b")).groupBy("h", "w").agg(F.count("*").alias("n"), F.bit_xor("b").alias("b"))
    # a coarse word is what fine ones with the same last bits add up to
    bits = [F.bit_xor(F.when(F.col("w").bitwiseAND(PARITIES - 1) == w, F.col("b")).otherwise(F.lit(0).cast("long"))).alias(f"b{w}") for w in range(PARITIES)]
    found = words.groupBy("h").agg(F.sum("n").alias("k"), *bits, F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"))
    fine = F.transform(F.sequence(F.lit(0), F.lit(FINE - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
    return found.select("h", "k", F.struct(*(f"b{w}" for w in range(PARITIES))).alias("bits"), fine.alias("fine"))


def _possible(a: str, b: str, similarity: float) -> Column:
    """Whether two texts can be similar by their parities: each cell that differs stands for a shingle of one of them only."""
    ka, kb = F.col(f"{a}.k"), F.col(f"{b}.k")
    apart = sum((F.bit_count(F.col(f"{a}.bits.b{w}").bitwiseXOR(F.col(f"{b}.bits.b{w}"))) for w in range(PARITIES)), F.lit(0))
    most = (ka + kb) * F.lit((1 - similarity) / (1 + similarity)) + 1e-9
    fine = F.zip_with(F.col(f"{a}.fine"), F.col(f"{b}.fine"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    fine = F.coalesce(F.aggregate(fine, F.lit(0), lambda x, y: x + y) <= most, F.lit(True))
    near = (F.least(ka, kb) >= F.greatest(ka, kb) * F.lit(similarity) - 1e-9) & (apart <= most)
    return F.coalesce(near, F.lit(True)) & fine


def similar(pairs: DataFrame, table: DataFrame, similarity: float, unit: Unit) -> DataFrame:
    """Those of the distinct pairs ``u, v`` of a fetched table's texts that have the Jaccard similarity."""
    # of texts with very different lengths, count the distinct shingles before sets are moved
    sized = pairs.join(table.select(F.col("h").alias("u"), F.col("n").alias("nu")), "u").join(table.select(F.col("h").alias("v"), F.col("n").alias("nv")), "v")
    odd = F.least("nu", "nv") < F.greatest("nu", "nv") * F.lit(similarity)
    sized = checkpointed(sized.select("u", "v", odd.alias("odd")))
    counted = table.join(_ends(sized.where("odd")), "h", "left_semi")
    counted = checkpointed(counted.select("h", F.size(unit.shingles(F.col("data"))).alias("k")))
    number = lambda c: counted.select(F.col("h").alias(c), F.col("k").alias(f"k{c}"))
    rest = sized.where("odd").join(number("u"), "u").join(number("v"), "v").where(F.least("ku", "kv") >= F.greatest("ku", "kv") * F.lit(similarity) - 1e-9)
    pairs = checkpointed(sized.where("not odd").select("u", "v").unionByName(rest.select("u", "v")))
    own = table.join(_ends(pairs), "h", "left_semi")
    few = (own.agg(F.sum("n").alias("n")).first()["n"] or 0) <= BROADCAST_SHINGLES
    if few:  # pairs of a large bucket share their texts, so sets are sent to pairs once
        sets = checkpointed(own.select("h", unit.shingles(F.col("data")).alias("s")))
        side = lambda name: F.broadcast(sets.select(F.col("h").alias(name), F.col("s").alias(f"s{name}")))
        pairs = pairs.repartition(shuffle_partitions(pairs.sparkSession), "u", "v")
    else:
        side = lambda name: table.join(pairs.select(F.col(name).alias("h")).distinct(), "h", "left_semi").select(F.col("h").alias(name), unit.shingles(F.col("data")).alias(f"s{name}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    common = F.size(F.array_intersect("su", "sv"))
    # common / (su + sv - common) >= similarity
    links = checkpointed(both.where(common * (1 + similarity) >= (F.size("su") + F.size("sv")) * F.lit(similarity) - 1e-9).select("u", "v"))
    released(links)
    return links


def _dealt(bands: DataFrame, block: int) -> DataFrame:
    """``band, h, sketch, salt``: rows of large buckets are dealt by their hashes; single rows of other buckets go."""
    counted = bands.where(F.pmod("h", F.lit(COUNTED)) == 0).groupBy("band").agg((F.count("*") * COUNTED).alias("n")).where(F.col("n") > block)
    large = _few(checkpointed(counted.select("band", F.ceil(F.col("n") / block).alias("blocks"))))
    salt = F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("h"), F.col("blocks")))
    rows = bands.join(large, "band", "left").select("band", "h", "sketch", F.coalesce(salt, F.lit(-1)).alias("salt"))
    return rows.withColumn("size", F.count("*").over(Window.partitionBy("band", "salt"))).where("size > 1 or salt >= 0").drop("size")


def _open(bands: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``band, h, sketch, salt, root`` of the buckets that hold several components."""
    if roots is None:
        return bands.withColumn("root", F.col("h"))
    named = bands.join(roots.withColumnRenamed("v", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    bucket = Window.partitionBy("band", "salt")
    named = named.withColumns({"low": F.min("root").over(bucket), "high": F.max("root").over(bucket)})
    return named.where("low < high or salt >= 0").drop("low", "high")


def _met(rows: DataFrame, turn: int) -> DataFrame:
    """One pair ``u, v`` for each text that is not in the component of all its buckets' first texts, sketches alike."""
    order = F.col("h") if turn == 0 else F.xxhash64("h", F.lit(turn))
    first = F.min(F.struct(order.alias("o"), F.col("h").alias("h"), F.col("sketch").alias("sketch"), F.col("root").alias("root")))
    pairs = rows.select("h", "sketch", "root", first.over(Window.partitionBy("band", "salt")).alias("p")).where("root <> p.root")
    pairs = pairs.where(_alike(F.col("sketch"), F.col("p.sketch"))).groupBy(F.col("h").alias("u"), F.col("p.h").alias("v")).count()
    return pairs.groupBy("u").agg(F.max_by("v", "count").alias("v"))


def _neighbours(rows: DataFrame, turn: int) -> DataFrame:
    """One pair ``u, v`` for each text and the likest, by sketch, of those before it in its buckets, by an order of sketches that starts elsewhere in each."""
    bits = F.expr(f"cast(8 * pmod(band + {turn}, 8) as int)")
    order = F.call_function("shiftleft", "sketch", bits).bitwiseOR(F.call_function("shiftrightunsigned", "sketch", F.lit(64) - bits))
    before = F.lag(F.struct("h", "sketch", "root")).over(Window.partitionBy("band", "salt").orderBy("o", "h"))
    pairs = rows.withColumn("o", order).select("h", "sketch", "root", before.alias("p")).where("root <> p.root")
    apart = F.bit_count(F.col("sketch").bitwiseXOR(F.col("p.sketch")))
    return pairs.groupBy(F.col("h").alias("u")).agg(F.min_by("p.h", F.struct(apart, "p.h")).alias("v"))


def _several(named: DataFrame, block: int) -> DataFrame:
    """``band, h, sketch, root, crowded, blocks, own`` of the buckets of several components, over all their blocks."""
    split = named.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high")
    split = _few(checkpointed(split.select("band", F.ceil(F.col("n") / block).alias("blocks"), (F.col("n") >= CROWDED).alias("crowded"))))
    return named.join(split, "band").select("band", "h", "sketch", "root", "crowded", "blocks", F.pmod(F.xxhash64("h"), F.col("blocks")).alias("own"))


def _across(rest: DataFrame, parities: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs ``u, v`` of all texts of a bucket that lie in different components, but those that cannot be similar."""
    # texts without a sketch are compared in any case
    known = [F.when(F.col("sketch") != 0, F.col(c)).alias(c) for c in ("k", "bits")]
    known.append(F.when((F.col("sketch") != 0) & F.col("crowded"), F.col("fine")).alias("fine"))
    rest = checkpointed(rest.join(parities, "h", "left").select("band", "h", "root", "blocks", "own", *known))
    known = ["k", "bits", "fine"]
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    # a pair meets where its first text's block crosses its second text's
    left = rest.select("band", F.col("own").alias("i"), others.alias("j"), F.struct("h", "root", *known).alias("a"))
    right = rest.select("band", others.alias("i"), F.col("own").alias("j"), F.struct("h", "root", *known).alias("b"))
    pairs = left.join(right.hint("merge"), ["band", "i", "j"]).where((F.col("a.root") < F.col("b.root")) & _possible("a", "b", similarity))
    return pairs.select(F.greatest("a.h", "b.h").alias("u"), F.least("a.h", "b.h").alias("v")).distinct()


def _merged(roots: DataFrame | None, new: DataFrame) -> DataFrame:
    """``v, root`` of the components after new links ``u, v``: only the components' roots are linked anew."""
    if roots is None:
        return components(new)
    name = lambda c: roots.select(F.col("v").alias(c), F.col("root").alias(f"r{c}"))
    ends = new.join(name("u"), "u", "left").join(name("v"), "v", "left")
    top = components(ends.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")))
    moved = roots.join(top.select(F.col("v").alias("root"), F.col("root").alias("next")), "root", "left").select("v", F.coalesce("next", "root").alias("root"))
    return checkpointed(moved.unionByName(top))


def linked(bands: DataFrame, texts: DataFrame, unit: Unit, *, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``v, root`` for each hash of ``texts`` (``h, line``) that is similar to another of its buckets, but the roots."""
    rows = checkpointed(_open(checkpointed(_dealt(bands, block)), None))
    roots, tried = None, None
    for turn in range(CROWDED_TURNS):
        some = rows
        if turn >= TURNS:
            # other blocks each turn, so that a block's first texts are others too
            some = checkpointed(_several(rows, block).where("crowded").withColumn("salt", F.pmod(F.xxhash64("h", F.lit(turn)), F.col("blocks"))))
        met = checkpointed(_met(some, turn) if turn < TURNS else _neighbours(some, turn))
        asked = met.count() if roots is not None else 1
        if not asked:
            break
        table = _fetched(checkpointed(_ends(met)), texts, unit)
        new = similar(met, table, similarity, unit)
        dropped(table)
        met = met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        tried = met if tried is None else tried.unionByName(met)
        found = new.count() if roots is not None else 1
        if found:
            roots = _merged(roots, new)
            rows = checkpointed(_open(rows.drop("root"), roots))
        released(rows)
        if turn >= TURNS and found < asked * WORTH:
            break
    rest = checkpointed(_several(rows, block))
    if not rest.limit(1).count():
        return roots
    table = _fetched(checkpointed(rest.select("h").distinct()), texts, unit)
    sketched = table.join(rest.where("sketch <> 0").select("h").distinct(), "h", "left_semi")
    across = checkpointed(_across(rest, _parities(sketched, unit), similarity).join(tried, ["u", "v"], "left_anti"))
    released(across)
    if across.limit(1).count():
        more = similar(across, table, similarity, unit)
        if more.limit(1).count():
            roots = _merged(roots, more)
    dropped(table)
    return roots
