"""SimHash near-duplicates by a binary-trie self-join.

Documents become 64-bit fingerprints; equal ones collapse at once, so a group of
copies is one fingerprint however large it is. Two fingerprints with at most
``budget`` differing bits agree on at least one of ``budget + 1`` blocks of bits,
so each block value roots one trie. A trie is joined with itself level by level:
pairs of nodes carry the bits that differ so far, and a pair goes once it
exceeds the budget, or once both nodes lie in one component already. A task
returns links to representatives (fewer than its fingerprints), never all pairs;
distributed union-find merges them.

A similarity of 0.8 over word shingles is some 39 of 256 bits, which no block
survives for sure. ``near_copies`` therefore roots tries at many choices of 16 bits
from 256-bit fingerprints, joins each with a wide budget, and confirms what meets by
the exact similarity of the shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays
from .components import components
from .linking import SIMILARITY, Unit, linked
from .shared import columns, dropped, shuffle_partitions, written

SHINGLE = 3
SEED = 42
BUDGET = 3
#: Node pairs that are expanded at once.
FRONTIER = 1 << 18
#: Shingle hashes whose bits are counted at once.
HASH_BLOCK = 1 << 15
#: Rows that one task's tries hold, about.
GROUP_ROWS = 100_000
#: 64-bit words of a wide fingerprint, bits on which near copies may differ, and choices of 16 root bits (16 each).
WIDE, WIDE_BUDGET, CHOICES = 4, 56, ((0, 0, 0, 0), (0, 3, 7, 12), (0, 5, 11, 2))
#: Five words in lower case.
WORDS = Unit(lambda t: F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""), F.size, F.slice, 5)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is 1 if set in over half of the shingles' hashes; no word gives 0."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(words) - size + 1
    first, last = starts[:n].tolist(), ends[size - 1 :].tolist()
    for i in range(0, n, HASH_BLOCK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first[i : i + HASH_BLOCK], last[i : i + HASH_BLOCK], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of a table of ``doc_id, text``."""

    def run(batches):
        for batch in batches:
            raw, offsets = textarrays.buffers(batch.column("text"))
            raw = raw.tobytes()
            fps = [fingerprint(raw[a:b], shingle, seed) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def _union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest row of each component) after the links a - b."""
    while len(a):
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (up := labels[labels]).tobytes() != labels.tobytes():
            labels = up
    return labels


def trie_links(keys: np.ndarray, values: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of one key whose values differ in at most ``budget`` bits.

    ``keys`` and ``values`` (a 64-bit word a row, or several) are sorted by key, then
    value. Each row is linked to the smallest row of its component within the key.
    """
    n = len(values)
    words = values.reshape(n, -1) if n else np.zeros((0, 1), np.uint64)
    labels = np.arange(n)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if n else np.zeros(0, np.int64)
    ends = np.append(starts[1:], n)
    many = ends - starts > 1
    s, e = starts[many], ends[many]
    stack = [(64 * words.shape[1] - 1, s, e, s, e, np.zeros(len(s), np.int16))]
    run_end = np.arange(1, n + 1)
    while stack:
        level, s1, e1, s2, e2, diff = stack.pop()
        one = (run_end[s1] >= e1) & (run_end[s2] >= e2) & (labels[s1] == labels[s2])
        s1, e1, s2, e2, diff = (x[~one] for x in (s1, e1, s2, e2, diff))
        if not len(s1):
            continue
        if len(s1) > FRONTIER:
            for part in reversed(range(0, len(s1), FRONTIER)):
                stack.append((level, *(x[part : part + FRONTIER] for x in (s1, e1, s2, e2, diff))))
            continue
        single = (e1 - s1 == 1) & (e2 - s2 == 1)
        if level < 0 or single.any():
            a, b = s1[single], s2[single]
            near = np.bitwise_count(words[a] ^ words[b]).sum(axis=1) <= budget
            labels = _union(labels, a[near], b[near])
            change = np.flatnonzero(np.append(labels[1:] != labels[:-1], True))
            run_end = change[np.searchsorted(change, np.arange(n))] + 1
            s1, e1, s2, e2, diff = (x[~single] for x in (s1, e1, s2, e2, diff))
            if not len(s1) or level < 0:
                continue
        bit = np.uint64(1) << np.uint64(level % 64)
        ones = np.append(0, np.cumsum((words[:, words.shape[1] - 1 - level // 64] & bit) != 0))
        m1, m2 = e1 - (ones[e1] - ones[s1]), e2 - (ones[e2] - ones[s2])
        same = (s1 == s2) & (e1 == e2)
        kids = [
            (s1, m1, s2, m2, diff, True), (m1, e1, m2, e2, diff, True),
            (s1, m1, m2, e2, diff + 1, True), (m1, e1, s2, m2, diff + 1, ~same),
        ]
        out = []
        for a1, b1, a2, b2, d, want in kids:
            # a node pair of one row with itself has nothing left to link
            ok = (b1 > a1) & (b2 > a2) & (d <= budget) & want & ~((a1 == a2) & (b1 == b2) & (b1 - a1 == 1))
            out.append([x[ok] for x in (a1, b1, a2, b2, d)])
        stack.append((level - 1, *(np.concatenate(x) for x in zip(*out, strict=True))))
    linked = np.flatnonzero(labels != np.arange(n))
    return linked, labels[linked]


def _by_root(rooted: DataFrame, rows: int) -> DataFrame:
    """The rows with their ``part``: each root's rows in one, and bounded groups however many rows there are."""
    parts = max(4 * shuffle_partitions(rooted.sparkSession), -(-rows // GROUP_ROWS))
    return rooted.withColumn("part", F.pmod(F.xxhash64("root"), F.lit(parts))).repartition(parts, "part")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, budget: int = BUDGET) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    Fingerprints link at ``budget`` or fewer differing bits; ``component_id`` is the
    smallest id that can be reached. Null and empty texts have fingerprint zero and
    link like any other. Repeated rows come back as often as they stand. A row with
    a null id gets its group's smallest id, or null where all are null. An empty
    table gives an empty result; other columns are ignored.
    """
    if 64 % (budget + 1):
        raise ValueError("budget + 1 must divide 64")
    fps = written(fingerprints(columns(docs, id_col, text_col).toDF("doc_id", "text"), shingle=shingle, seed=seed))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    width = 64 // (budget + 1)
    blocks = F.array(*(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", i * width).bitwiseAND(2**width - 1).alias("value")) for i in range(budget + 1)))
    rooted = distinct.select("fp", F.explode(blocks).alias("b")).select("fp", (F.col("b.value") * (budget + 1) + F.col("b.i")).alias("root"))

    def join(_, table):
        roots, values = table["root"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((values, roots))
        roots, values = roots[order], values[order]
        a, b = trie_links(roots, values, budget)
        return pa.table({"u": values[a].view(np.int64), "v": values[b].view(np.int64)})

    links = _by_root(rooted, distinct.count() * (budget + 1)).groupBy("part").applyInArrow(lambda k, t: join(k, t), "u long, v long")
    roots = components(links)
    member = distinct.join(roots, distinct.fp == roots.v, "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = member.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_fingerprints(texts: DataFrame, shingle: int = WORDS.size) -> DataFrame:
    """``h, f0, f1, ...``: fingerprints of several 64-bit words of a table of ``h, text`` (lower case)."""

    def run(batches):
        for batch in batches:
            for at, end in textarrays.slices(batch.column("text"), 1 << 20):
                raw, offsets = textarrays.buffers(batch.column("text").slice(at, end - at))
                starts, ends, words = textarrays.word_bounds(raw, offsets)
                hashes = textarrays.word_hashes(raw, starts, ends)
                doc = np.repeat(np.arange(end - at), np.diff(words))
                full = textarrays.window_hashes(hashes, shingle)
                here = doc[: len(full)] == doc[len(doc) - len(full) :]
                # a text of fewer words is one shingle
                short = np.flatnonzero((np.diff(words) > 0) & (np.diff(words) < shingle))
                few = [textarrays.window_hashes(hashes[words[i] : words[i + 1]], words[i + 1] - words[i]) for i in short]
                found, owner = np.concatenate([full[here], *few]), np.concatenate([doc[: len(full)][here], short])
                order = np.argsort(owner, kind="stable")
                found, owner = found[order], owner[order]
                counts, out = np.zeros((end - at, 64), np.int64), []
                for word in range(WIDE):
                    counts[:] = 0
                    for i in range(0, len(found), HASH_BLOCK):
                        part, own = textarrays.mix(found[i : i + HASH_BLOCK] + np.uint64(word)), owner[i : i + HASH_BLOCK]
                        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
                    many = np.bincount(owner, minlength=end - at)[:, None]
                    out.append(pa.array(np.packbits(counts * 2 > many, axis=1, bitorder="little").view(np.uint64).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("h").slice(at, end - at), *out], ["h", *(f"f{w}" for w in range(WIDE))])

    return texts.mapInArrow(run, ", ".join(["h long", *(f"f{w} long" for w in range(WIDE))]))


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``text_hash, component_id`` of each text that is similar to another, by the smallest id of its class.

    Texts are sets of shingles of five words in lower case (a shorter one is one
    shingle); similar ones share ``similarity`` of both sets, and classes are what can
    be reached. ``text_hash`` is ``xxhash64(lower(text))``; equal texts are one text and
    make a class too. Null texts are empty ones. Ids may be null or repeated:
    ``component_id`` is null where a class has no id. An empty table gives no rows.
    """
    text = F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    members = texts.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    fps = written(wide_fingerprints(texts.select("h", "text")).distinct(), compression="lz4")
    shift = lambda w, by: F.shiftrightunsigned(f"f{w}", 4 * by).bitwiseAND(15)

    def root(choice: int, by: int) -> Column:
        own = [shift(w, (by + CHOICES[choice][w]) % 16) for w in range(WIDE)]
        bits = own[0] + own[1] * 16 + own[2] * 256 + own[3] * 4096
        return bits * (16 * len(CHOICES)) + (16 * choice + by)

    roots = F.array(*(root(c, by) for c in range(len(CHOICES)) for by in range(16)))
    names = [f"f{w}" for w in range(WIDE)]
    # the table is small for its rows, so its files would be few tasks
    rooted = fps.repartition(shuffle_partitions(docs.sparkSession)).select("h", *names, F.explode(roots).alias("root"))

    def join(_, table):
        root, h = table["root"].to_numpy(), table["h"].to_numpy()
        values = np.stack([table[w].to_numpy().view(np.uint64) for w in names], axis=1)
        order = np.lexsort((*values.T[::-1], root))
        root, values, h = root[order], values[order], h[order]
        a, b = trie_links(root, values, WIDE_BUDGET)
        heads = np.unique(b)
        rows = np.concatenate([a, heads])
        band = textarrays.mix(h[np.concatenate([b, heads])].view(np.uint64) ^ textarrays.mix(root[rows].view(np.uint64)))
        return pa.table({"band": band.view(np.int64), "h": h[rows], "sketch": np.zeros(len(rows), np.int64)})

    met = _by_root(rooted, fps.count() * 16 * len(CHOICES)).groupBy("part").applyInArrow(lambda k, t: join(k, t), "band long, h long, sketch long")
    bands = written(met, compression="lz4")
    found = linked(bands, texts.select("h", F.col("text").alias("line")), WORDS, similarity=similarity)
    for table in (fps, bands):
        dropped(table)
    member = members.join(found.withColumnRenamed("v", "h"), "h", "left").select("h", "doc_id", "n", F.coalesce("root", "h").alias("root"))
    classes = member.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("n").alias("size")).where("size > 1")
    return member.join(classes, "root").select(F.col("h").alias("text_hash"), "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
