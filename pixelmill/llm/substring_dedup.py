"""Substring deduplication over fixed-length token windows.

Rabin-Karp hashes of every window of ``window`` words are counted over all
documents. A window counts as repeated in a document if the same word sequence
also starts in a document with a smaller id; the words that repeated windows
cover are removed, and neighbouring windows merge into maximal intervals.

Documents are cut into chunks that are ranges of ids, so that a window's sender
tells which copy comes first: a bucket only has to find the first chunk of each
hash and to answer one byte per key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange, textarrays
from .shared import columns


def _range_chunk(bounds: list[int]) -> Column:
    """The number of bounds below or at doc_id, by binary search over a literal array."""
    if not bounds:
        return F.lit(0)
    at = F.array(*(F.lit(int(b)) for b in bounds)) if len(bounds) < 2 else F.lit(bounds)
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    low_high = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")),
        lambda s, _: F.when(s.low >= s.high, s).otherwise(
            F.when(
                F.element_at(at, F.floor((s.low + s.high) / 2).cast("int") + 1) <= F.col("doc_id"),
                F.struct((F.floor((s.low + s.high) / 2) + 1).cast("int").alias("low"), s.high.alias("high")),
            ).otherwise(F.struct(s.low.alias("low"), F.floor((s.low + s.high) / 2).cast("int").alias("high")))
        ),
    )
    return low_high.low


def _windows(table: pa.Table, window: int):
    """Texts in order of doc_id with word bounds, window starts and window hashes."""
    table = table.sort_by("doc_id")
    raw, offsets = textarrays.buffers(table["text"])
    starts, ends, at = textarrays.word_bounds(raw, offsets)
    hashes = textarrays.window_hashes(textarrays.word_hashes(raw, starts, ends), window)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    here = np.flatnonzero(doc[: len(hashes)] == doc[len(doc) - len(hashes) :]) if len(hashes) else np.zeros(0, np.int64)
    return table, raw, offsets, starts, ends, at, doc, here, hashes[here]


def _result(table, raw, offsets, starts, ends, at, removed) -> pa.Table:
    """Kept words joined by one space, and the removed intervals, of each text."""
    n = len(at) - 1
    keep = ~removed
    doc = np.repeat(np.arange(n), np.diff(at))
    last = np.zeros(len(keep), bool)
    kept = np.flatnonzero(keep)
    if len(kept):
        last[kept[np.append(doc[kept][1:] != doc[kept][:-1], True)]] = True
    out, mask = raw.copy(), np.zeros(len(raw) + 1, np.int8)
    follow = keep & ~last
    out[ends[follow]] = 0x20
    np.add.at(mask, starts[keep], 1)
    np.add.at(mask, ends[keep] + follow[keep], -1)
    mask = np.cumsum(mask[:-1]).astype(bool)
    total = np.concatenate([[0], np.cumsum(mask)])[offsets]
    text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(out[mask])).cast(pa.string())
    first, end = textarrays.runs(removed)
    # a run must not go on into the next text
    cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(removed))]
    cut = cut[removed[cut] & removed[cut - 1]]
    first, end = np.sort(np.concatenate([first, np.unique(cut)])), np.sort(np.concatenate([end, np.unique(cut)]))
    owner = np.searchsorted(at, first, side="right") - 1
    spans = pa.StructArray.from_arrays([pa.array((x - at[owner]).astype(np.int64)) for x in (first, end)], names=["start", "end"])
    where = np.searchsorted(owner, np.arange(n + 1))
    sums = np.concatenate([[0], np.cumsum(removed)])[at]
    return pa.table({
        "doc_id": table["doc_id"].cast(pa.int64()),
        "n_words": pa.array(np.diff(at).astype(np.int64)),
        "n_removed": pa.array(np.diff(sums).astype(np.int64)),
        "kept_text": text,
        "spans": pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), spans),
    })


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, chunk_bytes: int = exchange.CHUNK_BYTES) -> DataFrame:
    """Remove words covered by a window that also starts in a document with a smaller id.

    Returns ``doc_id, n_words, n_removed, kept_text, spans``; ``kept_text`` is the
    kept words joined by one space, ``spans`` the maximal removed intervals in
    words. Null and empty texts have no words and give an empty text. Texts with
    fewer words than a window are kept. Repeated rows of one id are one document
    for the comparison: each is returned, and none makes the other's windows
    repeated. A null id is never smaller or greater: its text is kept whole.
    An empty table gives an empty result; other columns are ignored.
    """
    docs = columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n = exchange.chunk_count(total, chunk_bytes)
    bounds = []
    if n > 1:
        cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("p")).first()["p"]
        bounds = sorted(set(cuts or []))
    known = exchange.dealt(docs.where("doc_id is not null"), _range_chunk(bounds), n)

    def send(key, table):
        *_, hashes = _windows(table, window)
        return exchange.entries(key[0].as_py(), np.unique(hashes), n)

    def first_chunk(chunks, keys, _):
        order = np.lexsort((chunks, keys))
        k, c = keys[order], chunks[order]
        start = np.append(True, k[1:] != k[:-1])
        out = np.empty(len(keys), np.uint8)
        out[order] = c > c[np.maximum.accumulate(np.where(start, np.arange(len(k)), 0))]
        return out

    def apply(_, table, got):
        table, raw, offsets, starts, ends, at, doc, here, hashes = _windows(table, window)
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        before = exchange.returned(got, np.uint8).astype(bool)
        ids = table["doc_id"].to_numpy()
        repeated = np.zeros(0, bool)
        if len(unique):
            repeated = before[which] | (ids[doc[here]] > ids[doc[here[first]]][which])
        return _result(table, raw, offsets, starts, ends, at, textarrays.covered(here[repeated], window, len(starts)))

    schema = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,end:long>>"
    sent = known.groupBy("chunk").applyInArrow(send, exchange.ENTRY)
    back = exchange.answers(sent, n, first_chunk)
    done = known.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(apply, schema)

    def whole(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            raw, offsets = textarrays.buffers(table["text"])
            starts, ends, at = textarrays.word_bounds(raw, offsets)
            yield from _result(table, raw, offsets, starts, ends, at, np.zeros(len(starts), bool)).to_batches()

    return done.unionByName(docs.where("doc_id is null").mapInArrow(whole, schema))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, list_slice(ws, i, i + 12) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first_doc FROM win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM m WHERE first_doc < doc_id
), each AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.k) AS t, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.k = g.k GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
