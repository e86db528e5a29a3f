"""Repeated byte strings by a hash-compared suffix sort.

Every text is its UTF-8 bytes; a byte goes if a string of ``length`` bytes that
covers it also starts anywhere else. Prefix polynomial hashes give the hash of
any byte range, so a binary search over lengths finds how far two suffixes agree
in a logarithmic number of steps; a mergesort with that comparison orders
suffixes, and equal neighbours are checked byte by byte.

Not every suffix has to be sent. Each string of ``length`` bytes has an anchor,
the smallest hash of the ``GRAM``-byte strings in it, which is the same wherever
the string stands; the start positions that share an anchor form one stretch.
First, anchors are counted over all documents, each with the hash of its whole
stretch: an anchor met once has no repeated string, and a stretch that is met
whole elsewhere is repeated whole. Only where an anchor has different stretches
are its suffixes sorted in their chunk, and each class of equal suffixes is
counted over all chunks. Keys are pre-aggregated in every chunk, so a hot passage
is one key from each chunk, however many documents hold it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, textarrays
from .shared import columns

LENGTH = 200
GRAM = 100
#: Bytes of text in a chunk; hash arrays of a chunk take some 60 times this.
CHUNK_BYTES = 3 << 20


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first smallest value (by its upper 32 bits) in each window of ``width``."""
    least = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _expand(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each pair, one after another."""
    before = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


class Chunk:
    """The bytes of some texts with prefix hashes, and the stretches of their anchors.

    A stretch is a run of start positions in one text with one anchor:
    ``first`` to ``last`` (both included), the anchor's place ``anchor``.
    """

    def __init__(self, texts, length: int = LENGTH, gram: int = GRAM):
        self.length = length
        self.raw, self.offsets = textarrays.buffers(texts)
        self.prefix = textarrays.prefix_hash(self.raw)
        n, width = len(self.raw), length - gram + 1
        none = np.zeros(0, np.int64)
        self.first = self.last = self.anchor = none
        if n < length:
            return
        places = np.arange(n - gram + 1)
        grams = textarrays.mix(textarrays.range_hash(self.prefix, places, places + gram))
        place = _sliding_min(grams, width)
        text = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))[: len(place)]
        fits = np.arange(len(place)) + length <= self.offsets[text + 1]
        new = np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (fits[1:] != fits[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        ok = fits[first]
        self.first, self.last = first[ok], last[ok]
        self.anchor = place[self.first]
        self.key = grams[self.anchor]

    def stretch_hash(self) -> np.ndarray:
        """The hash of a stretch: all its bytes and the anchor's place in it."""
        h = textarrays.range_hash(self.prefix, self.first, self.last + self.length)
        size = (self.last - self.first).astype(np.uint64)
        return textarrays.mix(textarrays.mix(h) + size * np.uint64(1_000_003) + (self.anchor - self.first).astype(np.uint64))

    def hashes(self, starts: np.ndarray) -> np.ndarray:
        """The hash of the string of ``length`` bytes at each start."""
        return textarrays.mix(textarrays.range_hash(self.prefix, starts, starts + self.length))

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes, ``length`` at most, the suffixes at a and b have in common."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = textarrays.range_hash(self.prefix, a, a + mid) == textarrays.range_hash(self.prefix, b, b + mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def not_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffix at a is smaller than or equal to that at b, over ``length`` bytes."""
        common = self.agree(a, b)
        at = np.minimum(common, self.length - 1)
        return (common >= self.length) | (self.raw[a + at] <= self.raw[b + at])

    def sort(self, starts: np.ndarray) -> np.ndarray:
        """Starts in the order of their suffixes: a mergesort from the bottom up.

        Blocks of equal leading bytes are ordered by those; only inside them are
        suffixes merged, all blocks of a level at once: each element's place in the
        other run is found by binary search with hash comparisons.
        """
        if len(starts) < 2:
            return starts
        head = np.zeros(len(starts), np.uint64)
        for k in range(8):
            head = (head << np.uint64(8)) | self.raw[starts + k]
        order = np.argsort(head, kind="stable")
        head, cur = head[order], starts[order]
        block = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
        size = np.diff(np.append(block, len(cur)))
        begin, total = np.repeat(block, size), np.repeat(size, size)
        run, longest = 1, int(size.max())
        index = np.arange(len(cur))
        while run < longest:
            move = np.flatnonzero(total > run)
            inside = index[move] - begin[move]
            mine = inside // run
            other = begin[move] + (mine ^ 1) * run  # where the other run begins
            stop = np.minimum(other + run, begin[move] + total[move])
            low, high = other.copy(), np.maximum(stop, other)
            right = (mine & 1) == 1
            me = cur[move]
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                theirs, my, r = cur[mid], me[open_], right[open_]
                # left elements pass smaller ones only, right elements equal ones too: stable
                passes = np.where(r, self.not_after(theirs, my), ~self.not_after(my, theirs))
                low[open_] = np.where(passes, mid + 1, low[open_])
                high[open_] = np.where(passes, high[open_], mid)
            pair = begin[move] + (mine // 2) * 2 * run
            target = pair + (inside - mine * run) + (low - other)
            merged = cur.copy()
            merged[target] = me
            cur, run = merged, run * 2
        return cur

    def classes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted starts, and for each the number of its class of equal suffixes."""
        cur = self.sort(starts)
        same = np.zeros(len(cur), bool)
        if len(cur) > 1:
            same[1:] = self.agree(cur[:-1], cur[1:]) >= self.length
            check = np.flatnonzero(same)
            span = np.arange(self.length)
            for i in range(0, len(check), 4096):  # the bytes themselves decide
                c = check[i : i + 4096]
                same[c] = (self.raw[cur[c - 1][:, None] + span] == self.raw[cur[c][:, None] + span]).all(axis=1)
        return cur, np.cumsum(~same) - 1


def _anchor_entries(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (anchor, stretch) pairs sorted by anchor, their counts, a stretch of each, and each stretch's pair."""
    pairs = np.empty(len(chunk.first), [("key", np.uint64), ("whole", np.uint64)])
    if len(pairs):
        pairs["key"], pairs["whole"] = chunk.key, chunk.stretch_hash()
    order = np.lexsort((pairs["whole"], pairs["key"]))
    p = pairs[order]
    new = np.append(True, p[1:] != p[:-1]) if len(p) else np.zeros(0, bool)
    which = np.empty(len(p), np.int64)
    which[order] = np.cumsum(new) - 1
    return p["key"][new], p["whole"][new], np.bincount(which, minlength=int(new.sum())), order[new], which


_STRETCH = np.dtype([("whole", "<u8"), ("many", "u1")])
#: Answers for an anchor's stretch: nothing repeated, all of it repeated, sort its suffixes.
NONE, ALL, SORT = 0, 1, 2


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Remove every byte that a repeated string of ``length`` bytes covers.

    Returns ``doc_id, n_bytes, n_removed, spans, kept`` with the removed byte ranges
    and the bytes that remain. Strings lie within one text; overlaps within a text
    count. Null and empty texts have no bytes; texts shorter than ``length`` are
    kept. Repeated rows are texts of their own, so their long texts go. Null ids
    are documents like any other. An empty table gives an empty result; other
    columns are ignored.
    """
    docs = columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"]
    n = exchange.chunk_count(total, chunk_bytes)
    dealt = exchange.dealt(docs, exchange.by_hash(n, "doc_id", "text"), n)

    def anchors(key, table):
        keys, whole, many, *_ = _anchor_entries(Chunk(table["text"], length, gram))
        payload = np.empty(len(keys), _STRETCH)
        payload["whole"], payload["many"] = whole, np.minimum(many, 2)
        return exchange.entries(key[0].as_py(), keys, n, payload)

    def judge(_, keys, payload):
        got = np.frombuffer(payload, _STRETCH)
        order = np.lexsort((got["whole"], keys))
        k, w = keys[order], got["whole"][order]
        new_key = np.append(True, k[1:] != k[:-1])
        new = new_key | np.append(True, w[1:] != w[:-1])
        pair, group = np.cumsum(new) - 1, np.cumsum(new_key) - 1
        met = np.bincount(pair, weights=got["many"][order])[pair] > 1
        single = np.bincount(group, weights=new)[group] == 1
        out = np.empty(len(keys), np.uint8)
        # a stretch that is met whole elsewhere is repeated whole, but where the anchor has
        # other stretches too, its suffixes still have to be shown to these
        out[order] = np.where(single, np.where(met, ALL, NONE), SORT)
        return out

    def visit(table, got):
        """The chunk, each stretch's pair, the pairs' verdicts, and the sorted suffixes of one stretch of each open pair."""
        chunk = Chunk(table["text"], length, gram)
        _, _, many, one, which = _anchor_entries(chunk)
        verdict = exchange.returned(got, np.uint8)
        pick = np.flatnonzero(verdict == SORT)
        size = chunk.last[one[pick]] - chunk.first[one[pick]] + 1
        starts = _expand(chunk.first[one[pick]], size)
        weight = np.zeros(len(chunk.raw) + 1, np.int64)
        weight[starts] = np.repeat(many[pick], size)
        cur, number = chunk.classes(starts)
        return chunk, which, one, verdict, cur, number, weight[cur]

    def by_class(chunk: Chunk, cur: np.ndarray, number: np.ndarray, weight: np.ndarray):
        """Each class's hash in sorted order, how often it is met, and the order."""
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.zeros(0, np.int64)
        hashes = chunk.hashes(cur[first])
        order = np.argsort(hashes, kind="stable")
        return hashes[order], np.bincount(number, weights=weight, minlength=len(first))[order], order

    def suffixes(key, table, got):
        chunk, *_, cur, number, weight = visit(table, got)
        hashes, many, _ = by_class(chunk, cur, number, weight)
        return exchange.entries(key[0].as_py(), hashes, n, np.minimum(many, 2).astype(np.uint8))

    def repeated(_, keys, payload):
        _, which = np.unique(keys, return_inverse=True)
        return (np.bincount(which, weights=np.frombuffer(payload, np.uint8))[which] > 1).astype(np.uint8)

    def apply(_, table, got):
        stage = got["stage"].to_numpy(zero_copy_only=False) if got.num_rows else np.zeros(0)
        chunk, which, one, verdict, cur, number, weight = visit(table, got.filter(pa.array(stage == 1)))
        marks = np.zeros(len(chunk.raw) + 1, np.int64)
        _, _, order = by_class(chunk, cur, number, weight)
        twice = np.zeros(len(order), bool)
        twice[order] = exchange.returned(got.filter(pa.array(stage == 2)), np.uint8).astype(bool)
        hit = np.zeros(len(chunk.raw) + 1, bool)
        hit[cur[twice[number]]] = True
        # what holds for one stretch of a pair holds for all of them
        own = verdict[which]
        sort = np.flatnonzero(own == SORT)
        size = chunk.last[sort] - chunk.first[sort] + 1
        starts = _expand(chunk.first[sort], size)[hit[_expand(chunk.first[one[which[sort]]], size)]]
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + length, -1)
        whole = own == ALL
        np.add.at(marks, chunk.first[whole], 1)
        np.add.at(marks, chunk.last[whole] + length, -1)
        return _kept(table["doc_id"], chunk, np.cumsum(marks[:-1]) > 0)

    first = exchange.answers(dealt.groupBy("chunk").applyInArrow(anchors, exchange.ENTRY), n, judge)
    second = exchange.answers(dealt.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(suffixes, exchange.ENTRY), n, repeated)
    both = first.withColumn("stage", F.lit(1)).unionByName(second.withColumn("stage", F.lit(2)))
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    return dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(apply, schema)


def _kept(ids, chunk: Chunk, gone: np.ndarray) -> pa.Table:
    """Remaining bytes and removed ranges of each text."""
    rows: tuple[list, list, list, list] = ([], [], [], [])
    for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True):
        mask = gone[a:b]
        start, end = textarrays.runs(mask)
        rows[0].append(b - a)
        rows[1].append(int(mask.sum()))
        rows[2].append([{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist(), strict=True)])
        rows[3].append(chunk.raw[a:b][~mask].tobytes() if len(start) else chunk.raw[a:b].tobytes())
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
    return pa.table([ids.cast(pa.int64()), *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
