"""Language identification as inference of a mixture of languages.

Character trigrams are counted per language over all labelled training
documents. A document is a mixture: every word is drawn from one of the
languages with the likelihood of its trigrams, and expectation-maximisation
estimates the document's proportions. Sets of languages are then compared by
likelihood with a penalty for each language, for every document: all sets of those
``SETS`` languages that have the largest proportions. The likelihood is concave, so
proportions near its top bound it from above; where not even that bound pays for a
second language, the best single one is the best set, and no other is fitted.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays
from .shared import columns

#: Cells of the hashed trigram table, one table per language.
CELLS = 1 << 17
SMOOTHING = 0.5
ROUNDS = 10
#: Nats that a further language must gain, besides half the log of the words.
PENALTY = 3.0
#: Languages of a document, by proportion, whose sets are all compared.
SETS = 5
UNKNOWN = "und"
BLOCK = 1 << 20
_CLASS = np.arange(256, dtype=np.int64)
_CLASS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = 0x2E
_CLASS[[*range(0x30, 0x3A)]] = 0x30
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0x20
_CLASS[[*range(0x41, 0x5B)]] = np.arange(0x61, 0x7B)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _cells(raw: np.ndarray) -> np.ndarray:
    """The cell of the trigram that ends at each byte; text is taken as set between spaces."""
    c = np.full(len(raw) + 2, 0x20, np.int64)
    c[2:] = _CLASS[raw]
    code = (c[:-2] << 16) | (c[1:-1] << 8) | c[2:]
    return ((code * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - 17)


def _lowered(texts: pa.Array, at: int, end: int) -> list[str]:
    return [(t or "").lower() for t in texts.slice(at, end - at).to_pylist()]


def trigram_counts(labelled: DataFrame) -> DataFrame:
    """``lang, cell, n`` of a table of ``text, lang``; added up in each task, then in Spark."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for at, end in textarrays.slices(batch.column("text"), BLOCK):
                texts = _lowered(batch.column("text"), at, end)
                for lang in set(langs[at:end]):
                    raw = " ".join(t for t, own in zip(texts, langs[at:end], strict=True) if own == lang).encode()
                    for i in range(0, len(raw), BLOCK):
                        found = np.bincount(_cells(np.frombuffer(raw[i : i + BLOCK], np.uint8)), minlength=CELLS)
                        totals[lang] = totals[lang] + found if lang in totals else found
        for lang, found in totals.items():
            cells = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(found[cells])], ["lang", "cell", "n"])

    return labelled.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log probability of each cell in each (CELLS x languages).

    What reaches the driver is bounded by CELLS times the number of languages.
    """
    rows = trigram_counts(labelled).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((CELLS, len(langs)))
    counts[rows["cell"], rows["lang"].map({x: i for i, x in enumerate(langs)})] = rows["n"]
    seen = max(1, int((counts.sum(axis=1) > 0).sum()))
    return langs, np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * (seen + 1))).astype(np.float32)


def _word_likelihoods(raw: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each word that has a letter in each language, and the texts' word offsets."""
    starts, ends, at = textarrays.word_bounds(raw, offsets)
    out = np.empty((len(starts), model.shape[1]))
    letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        low, high = int(starts[i]), int(ends[j - 1])
        part = np.append(raw[low:high], np.uint8(0x20))
        sums = np.zeros((len(part) + 1, model.shape[1]))
        np.cumsum(model[_cells(part)], axis=0, out=sums[1:])
        out[i:j] = sums[ends[i:j] - low + 1] - sums[starts[i:j] - low]
        i = j
    has = letters[ends] > letters[starts]
    return out[has], np.concatenate([[0], np.cumsum(has)])[at]


def _em(like: np.ndarray, doc: np.ndarray, at: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some rounds, and the log likelihood of each document's words."""
    n = np.diff(at)[:, None]
    for _ in range(rounds):
        r = like * share[doc]
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(r, at[:-1], axis=0) / n
    total = np.log(np.maximum((like * share[doc]).sum(axis=1), 1e-300))
    return share, np.add.reduceat(total, at[:-1])


def mixtures(raw: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> np.ndarray:
    """The proportions of the chosen languages for each text; zeros for other languages, and where no word has a letter."""
    logs, at = _word_likelihoods(raw, offsets, model)
    k, out = model.shape[1], np.zeros((len(offsets) - 1, model.shape[1]))
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    at = np.append(at[full], at[-1])
    out[full] = chosen_sets(logs - logs.max(axis=1, keepdims=True), at)
    return out


def chosen_sets(logs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The proportions of the set with the best penalised likelihood for each document of at least one word.

    ``logs`` are the words' log likelihoods in each language, up to a constant for each word.
    """
    n, k = np.diff(at), logs.shape[1]
    doc, like = np.repeat(np.arange(len(n)), n), np.exp(logs)
    share, score = _em(like, doc, at, np.full((len(n), k), 1 / k), ROUNDS)
    cost = PENALTY + 0.5 * np.log(n)
    alone = np.add.reduceat(logs, at[:-1], axis=0)
    first = alone.argmax(axis=1)
    best = alone.max(axis=1)
    chosen = np.zeros((len(n), k))
    chosen[np.arange(len(n)), first] = 1.0
    # no proportions are likelier than the score plus n times (the largest mean ratio of a language to the mixture, less 1)
    mixture = np.maximum((like * share[doc]).sum(axis=1, keepdims=True), 1e-300)
    bound = score + n * np.maximum(np.add.reduceat(like / mixture, at[:-1], axis=0).max(axis=1) / n - 1, 0)
    open_ = np.flatnonzero(bound - best > cost)
    if not len(open_):
        return chosen
    rows = np.concatenate([np.arange(at[i], at[i + 1]) for i in open_])
    sub = np.concatenate([[0], np.cumsum(n[open_])])
    own = np.repeat(np.arange(len(open_)), n[open_])
    order = np.argsort(-share[open_], axis=1, kind="stable")[:, :SETS]
    some = np.take_along_axis(like[rows], order[own], axis=1)
    top, kept = best[open_] - cost[open_], chosen[open_]
    for size in range(2, order.shape[1] + 1):
        for members in map(list, combinations(range(order.shape[1]), size)):
            part, fit = _em(some[:, members], own, sub, np.full((len(open_), size), 1 / size), ROUNDS)
            better = np.flatnonzero(fit - cost[open_] * size > top)
            top[better] = (fit - cost[open_] * size)[better]
            kept[better] = 0.0
            np.put_along_axis(kept, order[:, members], np.where(np.isin(np.arange(len(open_)), better)[:, None], part, np.take_along_axis(kept, order[:, members], axis=1)), axis=1)
    chosen[open_] = kept
    return chosen


def identify(docs: DataFrame, training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep_rows: bool = False, block: int = BLOCK) -> DataFrame:
    """``doc_id, lang_pred, score, languages`` for every document, and its whole row as ``doc`` if asked for.

    The model is learned from ``training`` rows with text and language.
    ``languages`` lists the chosen set with its proportions, largest first;
    ``lang_pred`` is the first and ``score`` its proportion. Null or empty texts,
    texts without a letter, and all texts where nothing was learned give ``und``,
    score 0 and no languages. Ties go to the language first in the alphabet.
    Repeated rows and null ids are documents like any other. An empty table gives
    an empty result; other columns are ignored. A worker takes some ``block`` bytes of
    text at a time, and needs much more memory for their words (some 130 MB for 1 MB).
    """
    labelled = columns(training, text_col, lang_col).toDF("text", "lang").where("text is not null and lang is not null")
    langs, model = train(labelled)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS x languages, a fixed size

    def run(batches):
        model = shared.value
        for batch in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            rest = [batch.column("doc")] if keep_rows else []
            whole = batch.column("doc").field(text_col) if keep_rows else batch.column("text")
            for at, end in textarrays.slices(whole, block):
                texts = _lowered(whole, at, end)
                encoded = [t.encode() for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int64)
                found = mixtures(np.frombuffer(b"".join(encoded), np.uint8), offsets, model) if langs else np.zeros((len(texts), 0))
                for doc, text, share in zip(batch.column("doc_id").slice(at, end - at).to_pylist(), texts, found, strict=True):
                    order = [i for i in np.argsort(-share, kind="stable").tolist() if share[i] > 0] if _has_letter(text) else []
                    rows[0].append(doc)
                    rows[1].append(langs[order[0]] if order else UNKNOWN)
                    rows[2].append(min(1.0, float(share[order[0]])) if order else 0.0)
                    rows[3].append([{"lang": langs[i], "share": float(share[i])} for i in order])
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(rows, kinds, strict=True)), *rest], ["doc_id", "lang_pred", "score", "languages", *["doc"] * keep_rows])
        pa.default_memory_pool().release_unused()  # the worker stays, and other stages need the memory

    schema = T.StructType.fromDDL("doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    texts = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")]
    if keep_rows:  # the text is in the row, and goes to the workers once
        schema, texts = schema.add("doc", docs.schema), [texts[0], F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")]
    return docs.select(*texts).mapInArrow(run, schema)


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def fold(id_col: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(parts))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, docs.where(fold("doc_id", 3) != 1))
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")
