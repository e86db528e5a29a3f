"""Near copies among embeddings by a forest of random-projection trees.

Equal vectors become one class first, so that any number of copies is one point.
Within a label, each tree projects the points on one random direction a level and
splits every node that is larger than a leaf near its median; points between the
two cuts go to both sides (spill overlap). The number of trees follows from the
depth: each level may part a pair at the threshold with a known probability, and
trees are added until all of them part it with ``MISSED`` at most. All points of a
leaf are compared; links are merged by distributed union-find.

Every link lies inside a component, so links are counted there and never listed.
Vectors within half the threshold's angle of their component's mean direction (its
core) are linked with each other for certain, as angles obey the triangle
inequality; they add their number. The others are compared with their whole
component: at once where it fits into a leaf, else block by block, the blocks being
parts of leaves. Counts are exact for the components found. A large group of near
copies around one text is all core; work is quadratic only in the members outside
of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import checkpointed, columns, written
from .vectors import finite, lists, matrix

SIMILARITY = 0.93
#: Points of a leaf, all compared with each other.
LEAF = 512
#: Shares of a node below the cuts of its right and its left side.
LOW, HIGH = 0.425, 0.575
#: Chance that one level parts a pair at the threshold, for points spread evenly in 64 dimensions.
PARTED = 0.03
#: Chance that all trees part such a pair.
MISSED = 0.001
#: Cuts of so many nodes are broadcast (a key and two numbers each); more are joined by shuffle.
BROADCAST_NODES = 50_000


def depth_and_trees(points: int, leaf: int) -> tuple[int, int]:
    """Levels that bring ``points`` down to leaves, and trees that keep pairs together often enough."""
    if points <= leaf:
        return 0, 1
    depth = math.ceil(math.log(points / leaf) / math.log(1 / (HIGH + 0.005)))
    return depth, max(3, math.ceil(math.log(MISSED) / math.log(1 - (1 - PARTED) ** depth)))


def _units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares stay finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _projected(points: DataFrame, depth: int, trees: int, seed: int) -> DataFrame:
    """``h1, h2, label, dim, tree, p``: each tree's projections, one a level, nudged apart where they are equal."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            dims, keys = b["dim"].to_numpy(), b["h1"].to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                v = _units(matrix(b["v"].take(pa.array(at))))
                directions = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), trees, depth))
                p = np.einsum("nd,dtl->ntl", v, directions, optimize=True)
                noise = (keys[at].astype(np.uint64)[:, None] * np.arange(1, 2 * trees * depth, 2, dtype=np.uint64)) >> np.uint64(40)
                p = p + 1e-9 * noise.reshape(p.shape) / 2**24
                every = pa.array(np.repeat(at, trees))
                yield pa.RecordBatch.from_arrays([*(b[c].take(every) for c in ("h1", "h2", "label", "dim")), pa.array(np.tile(np.arange(trees, dtype=np.int32), len(at))), lists(p.reshape(-1, depth))], ["h1", "h2", "label", "dim", "tree", "p"])

    kind = points.schema["label"].dataType.simpleString()
    return points.mapInArrow(run, f"h1 long, h2 long, label {kind}, dim int, tree int, p array<double>")


def _leaves(points: DataFrame, depth: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """``h1, h2, leaves``: the sorted keys of all leaves that hold a point; a key is unique within label and length."""
    if not depth:
        return points.select("h1", "h2", F.array(F.lit(0).cast("long")).alias("leaves"))
    node = ["label", "dim", "tree", "node"]
    rows = checkpointed(_projected(points, depth, trees, seed).withColumn("node", F.lit(1).cast("long")).withColumn("open", F.lit(True)))
    for level in range(depth):
        p = F.get("p", F.lit(level))
        cuts = checkpointed(rows.where("open").groupBy(*node).agg(F.count("*").alias("n"), F.percentile_approx(p, [LOW, HIGH], 1000).alias("cut")).where(F.col("n") > leaf).select(*node, "cut"))
        found = cuts.count()
        if not found:
            break
        sides = F.array(F.when(p <= F.col("cut")[1], F.col("node") * 2), F.when(p >= F.col("cut")[0], F.col("node") * 2 + 1))
        split = rows.join(F.broadcast(cuts) if found <= BROADCAST_NODES else cuts, node, "left").withColumn("open", F.col("cut").isNotNull())
        rows = checkpointed(split.withColumn("node", F.explode(F.when(F.col("open"), F.array_compact(sides)).otherwise(F.array("node")))).select("h1", "h2", *node, "p", "open"))
    return rows.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.xxhash64("tree", "node"))).alias("leaves"))


def _linked(v: np.ndarray, other: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs with this cosine or more, of ``v`` and ``other``, or i < j within ``v``."""
    unit = _units(v)
    gram = unit @ (unit if other is None else _units(other)).T
    near = gram >= similarity - 1e-9
    i, j = np.nonzero(np.triu(near, 1) if other is None else near)
    close = np.flatnonzero(gram[i, j] < similarity + 1e-9)  # rounding may decide: by the definition
    if len(close):
        whole = lambda x: x / np.abs(x).max(axis=1, keepdims=True)
        a, b = whole(v[i[close]]), whole((v if other is None else other)[j[close]])
        dot = lambda x, y: np.einsum("ij,ij->i", x, y)
        keep = np.ones(len(i), bool)
        keep[close] = dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))) >= similarity
        i, j = i[keep], j[keep]
    return i, j


def _smallest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row number that each row is linked to, directly or not."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        was = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == was).all():
            return root


def _links(cards: DataFrame, similarity: float) -> DataFrame:
    """Edges ``u, v`` of vertices ``(low, h1)``: in each leaf, each point with the smallest one that it is linked to."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("low", "ascending"), ("h1", "ascending")])
        i, j = _linked(matrix(t["v"]), None, similarity)
        root = _smallest(t.num_rows, i, j)
        at = np.flatnonzero(root != np.arange(t.num_rows))
        low, h = t["low"].to_numpy(), t["h1"].to_numpy()
        return pa.table({"ul": low[at], "uh": h[at], "vl": low[root[at]], "vh": h[root[at]]})

    dealt = cards.select("h1", "label", "dim", "v", "low", F.explode("leaves").alias("leaf"))
    found = dealt.groupBy("label", "dim", "leaf").applyInArrow(run, "ul long, uh long, vl long, vh long").distinct()
    vertex = lambda s: F.struct(F.col(f"{s}l").alias("low"), F.col(f"{s}h").alias("h"))
    return found.select(vertex("u").alias("u"), vertex("v").alias("v"))


def _means(cards: DataFrame) -> DataFrame:
    """``root, mean``: the sum of the unit vectors of each component, added up by batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            dims = b["dim"].to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                unit = _units(matrix(b["v"].take(pa.array(at))))
                keys, inverse = np.unique(np.stack([b["low"].to_numpy()[at], b["h"].to_numpy()[at]], axis=1), axis=0, return_inverse=True)
                sums = np.zeros((len(keys), int(dim)))
                np.add.at(sums, inverse.ravel(), unit)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists(sums)], ["low", "h", "sums"])

    part = cards.where("root is not null").select("root.low", "root.h", "dim", "v").mapInArrow(run, "low long, h long, sums array<double>")
    whole = part.select("low", "h", F.posexplode("sums")).groupBy("low", "h", "pos").agg(F.sum("col").alias("s"))
    return whole.groupBy("low", "h").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("m")).select(F.struct("low", "h").alias("root"), F.col("m.s").alias("mean"))


def _with_core(cards: DataFrame, similarity: float) -> DataFrame:
    """Adds ``core``: whether a point lies so near its component's mean that it is linked to all others that do."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    unit = F.transform("v", lambda x: x / F.array_max(F.transform("v", F.abs)))
    both = cards.join(_means(cards), "root", "left").withColumn("unit", unit)
    cosine = dot("unit", "mean") / F.sqrt(dot("unit", "unit") * dot("mean", "mean"))
    near = math.cos(math.acos(similarity) / 2) + 1e-9
    return both.withColumn("core", F.coalesce(F.col("mean").isNotNull() & (cosine >= near), F.lit(False))).drop("mean", "unit")


def _counts(cards: DataFrame, similarity: float, leaf: int) -> DataFrame:
    """``h1, h2, n``: vectors linked to each point, but for pairs of points in the core of one component."""
    own = cards.where("root is not null").select("h1", "h2", "v", "mult", "core", "root", "members", F.col("leaves")[0].alias("leaf"))
    own = own.withColumn("block", F.when(F.col("members") <= leaf, F.lit(0).cast("long")).otherwise(F.col("leaf"))).drop("members", "leaf")
    blocks = checkpointed(own.groupBy("root", "block").agg(F.bool_or(~F.col("core")).alias("open")))
    side = lambda c: blocks.select("root", F.col("block").alias(c), F.col("open").alias(f"open_{c}"))
    pairs = side("i").join(side("j"), "root").where("i <= j and (open_i or open_j)").select("root", "i", "j")
    first = own.withColumnRenamed("block", "i").join(pairs, ["root", "i"])
    second = own.withColumnRenamed("block", "j").join(pairs.where("i < j"), ["root", "j"])
    columns_ = ["root", "i", "j", "h1", "h2", "v", "mult", "core"]
    keyed = lambda df: df.select(*columns_).toDF(*columns_).groupBy("root", "i", "j")  # noqa: E731  (columns of its own for each side)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        other = b if b.num_rows else a
        i, j = _linked(matrix(a["v"]), matrix(b["v"]) if b.num_rows else None, similarity) if a.num_rows else (np.zeros(0, np.int64),) * 2
        open_ = ~(a["core"].to_numpy()[i] & other["core"].to_numpy()[j])
        i, j = i[open_], j[open_]
        out = []
        for t, own, partner, weights in ((a, i, j, other), (other, j, i, a)):
            n = np.zeros(t.num_rows, np.int64)
            np.add.at(n, own, weights["mult"].to_numpy()[partner])
            at = np.flatnonzero(n)
            out.append(pa.table({"h1": t["h1"].to_numpy()[at], "h2": t["h2"].to_numpy()[at], "n": n[at]}))
        return pa.concat_tables(out)

    return keyed(first).cogroup(keyed(second)).applyInArrow(run, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def near_copies(vectors: DataFrame, *, similarity: float = SIMILARITY, leaf: int = LEAF, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row with an id.

    Vectors are compared within a label and a length; ``n_links`` counts the other
    vectors found with a cosine of ``similarity`` or more, ``component_id`` is the
    smallest id that links reach, itself included, and one row of each component is
    kept. Every link that counts has been verified in double precision or follows
    from two verified angles; ``leaf`` bounds what is compared at once. Rows whose label is null, and vectors that are null,
    empty, zero or hold null or non-finite components, link with nothing. A repeated
    row is a vector of its own: it links with its copy, shares its component, and is
    kept with it, as ids are equal. Rows without an id are left out; other columns
    are ignored; an empty table gives an empty result.
    """
    v = F.col("v")
    rows = columns(vectors, id_col, label_col, vec_col).toDF("vec_id", "label", "v").withColumns({"vec_id": F.col("vec_id").cast("long"), "v": v.cast("array<double>")}).where("vec_id is not null")
    usable = F.coalesce(F.col("label").isNotNull() & finite(v) & F.exists(v, lambda x: x != 0), F.lit(False))
    hashed = rows.where(usable).select("vec_id", "label", "v", F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(1), "label", "v").alias("h2"))
    points = written(hashed.groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("mult"), F.min("vec_id").alias("low")).withColumn("dim", F.size("v")))
    most = points.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    depth, trees = depth_and_trees(most, leaf)
    cards = written(points.join(_leaves(points, depth, trees, leaf, seed), ["h1", "h2"]))
    hung = components(_links(cards, similarity))
    roots = checkpointed(hung.unionByName(hung.select(F.col("root").alias("v"), "root").distinct()).select(F.col("v.low").alias("low"), F.col("v.h").alias("h1"), "root"))
    cards = written(_with_core(cards.join(roots, ["low", "h1"], "left"), similarity))
    sizes = cards.where("root is not null").groupBy("root").agg(F.count("*").alias("members"), F.sum(F.when(F.col("core"), F.col("mult"))).alias("size"))
    cards = cards.join(checkpointed(sizes), "root", "left")
    told = cards.select("h1", "h2", "low", "mult", "root", "core", "size").join(_counts(cards, similarity, leaf), ["h1", "h2"], "left")
    others = F.coalesce("n", F.lit(0)) + F.col("mult") - 1 + F.when(F.col("core"), F.col("size") - F.col("mult")).otherwise(0)
    told = told.select("h1", "h2", others.alias("n_links"), F.coalesce("root.low", "low").alias("component_id"))
    found = hashed.select("vec_id", "h1", "h2").join(told, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op13_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op13_sql(similarity: float = SIMILARITY) -> str:
    return f"""WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda t: t IS NULL OR NOT isfinite(t))) = 0 AND len(list_filter(embedding, lambda t: t <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= {similarity}
), r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
c AS (SELECT u, min(v) AS low FROM r GROUP BY u), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id, c.low IS NULL OR e.vec_id <= c.low AS kept
FROM embeddings e LEFT JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id WHERE e.vec_id IS NOT NULL"""


OP13_SQL = _op13_sql()
