"""A hidden Markov language model, trained by Baum-Welch over partitions.

A state emits a word's cell (its last bytes, hashed to a fixed number of cells),
and the cell emits the word by its corpus count, plus one, with one unseen word
for each cell. Word counts are exact and come from all training documents; the
states' tables have a fixed size. Each Baum-Welch round adds up expected counts
in every partition, then in Spark; each takes all training documents. Scaled forward recursion gives the
exact likelihood of whole texts; long texts are cut into segments whose transfer
from each state is computed side by side and then chained, which is the same sum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange, textarrays
from .language_id import fold
from .shared import columns, dropped, written

STATES = 6
CELLS = 1 << 13
#: Each round takes one in so many of the training documents: all of them.
ROUNDS = (1,) * 6
#: Tokens of a segment; segments of a text are chained exactly, in training as in scoring.
TRAIN_LENGTH, SCORE_LENGTH = 1024, 1024
#: Tokens that a training block or a slice of texts holds, about.
BLOCK_TOKENS, SLICE_BYTES = 1 << 19, 2 << 20
SEED_DOCUMENTS = 200
PRIOR = 50.0
END = np.uint64(0xE0D0E0D0E0D0E0D1)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # states x cells


@dataclass
class Corpus:
    """Counts over all training documents: by cell, of tokens and of distinct words."""

    tokens: np.ndarray
    types: np.ndarray


def tokens_of(texts, *, hashes: bool) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """Word hashes (if asked for), cells, and text offsets; an end token closes each text."""
    raw, offsets = textarrays.buffers(texts)
    raw = _LOWER[raw]
    starts, ends, at = textarrays.word_bounds(raw, offsets)
    n = len(at) - 1
    final = at + np.arange(n + 1)
    place = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(at))
    size = ends - starts
    code = raw[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    for k in (2, 3):
        code = (code << np.uint64(8)) | np.where(size >= k, raw[np.maximum(ends - k, 0)] if len(ends) else 0, 0).astype(np.uint64)
    cells = np.full(len(starts) + n, CELLS - 1, np.int64)
    cells[place] = (textarrays.mix(code + np.uint64(1)) % np.uint64(CELLS - 1)).astype(np.int64)
    words = None
    if hashes:
        words = np.full(len(starts) + n, END, np.uint64)
        words[place] = textarrays.word_hashes(raw, starts, ends)
    return words, cells, final


_COUNT = np.dtype([("n", "<u4"), ("cell", "<u4")])


def _counted(words: np.ndarray, cells: np.ndarray, counts_too: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct words with their training count and cell."""
    unique, first, which = np.unique(words, return_index=True, return_inverse=True)
    payload = np.empty(len(unique), _COUNT)
    payload["n"] = np.bincount(which, weights=counts_too, minlength=len(unique))
    payload["cell"] = cells[first]
    return unique, payload


def corpus_counts(training: DataFrame, n_buckets: int) -> Corpus:
    """Tokens and distinct words of each cell; at most CELLS rows reach the driver."""

    def send(batches):
        for batch in batches:
            for at, end in textarrays.slices(batch.column("text"), 4 * SLICE_BYTES):
                words, cells, _ = tokens_of(batch.column("text").slice(at, end - at), hashes=True)
                unique, payload = _counted(words, cells, np.ones(len(words)))
                yield from exchange.entries(0, unique, n_buckets, payload).to_batches()

    def count(_, table):
        keys = np.concatenate([exchange.unpack(x.as_buffer()) for x in table["keys"]])
        payload = np.frombuffer(b"".join(x.as_py() for x in table["payload"]), _COUNT)
        _, first = np.unique(keys, return_index=True)
        tokens = np.bincount(payload["cell"], weights=payload["n"], minlength=CELLS).astype(np.int64)
        types = np.bincount(payload["cell"][first], minlength=CELLS).astype(np.int64)
        full = np.flatnonzero(tokens)
        return pa.table({"cell": full.astype(np.int32), "tokens": tokens[full], "types": types[full]})

    sent = training.select("text").mapInArrow(send, exchange.ENTRY).repartition(n_buckets, "bucket")
    rows = sent.groupBy("bucket").applyInArrow(count, "cell int, tokens long, types long").groupBy("cell").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).toPandas()
    out = Corpus(np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64))
    out.tokens[rows["cell"]], out.types[rows["cell"]] = rows["tokens"], rows["types"]
    return out


def _entries(cells: np.ndarray, begin: np.ndarray, size: np.ndarray, inner: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The state ahead of each segment, and what follows after each (up to a factor).

    ``inner`` tells the segments that go on with a text; these are in order.
    """
    k = len(model.start)
    emit = np.ascontiguousarray(model.emit.T)
    ahead, out = np.tile(model.start, (len(begin), 1)), np.ones((len(begin), k))
    owners = np.flatnonzero(inner | np.append(inner[1:], False))
    if not len(owners):
        return ahead, out
    rows, longest = np.repeat(owners, k), int(size[owners].max())
    order = np.argsort(-size[rows], kind="stable")
    live = np.searchsorted(-size[rows][order], -np.arange(longest), side="left")
    first, cur = begin[rows][order], np.tile(np.eye(k), (len(owners), 1))[order]
    last, logs = np.zeros((len(rows), k)), np.zeros(len(rows))
    for t in range(longest):
        m = live[t]
        a = cur[:m] * emit[cells[first[:m] + t]]
        s = a.sum(axis=1)
        a /= s[:, None]
        logs[:m] += np.log(s)
        last[:m] = a
        cur = a @ model.move
    back = np.argsort(order)
    last, logs = last[back].reshape(-1, k, k), logs[back].reshape(-1, k)
    transfer = last * np.exp(logs - logs.max(axis=1, keepdims=True))[:, :, None]
    state = None
    for n, i in enumerate(owners.tolist()):
        if inner[i]:
            ahead[i] = state @ model.move
        state = ahead[i] @ transfer[n]
        state = state / state.sum()
    for n, i in reversed(list(enumerate(owners.tolist()))):
        if inner[i]:
            before = model.move @ (transfer[n] @ out[i])
            out[i - 1] = before / before.sum()
    return ahead, out


def _packed(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of sequences, the longest first, step by step: how many sequences reach each step, where it begins, and its tokens.

    Sequences keep their order in every step, so step t + 1 goes on with the first of step t.
    """
    live = np.searchsorted(-size, -np.arange(size[0]), side="left")
    first = np.cumsum(live) - live
    step = np.repeat(np.arange(len(live)), live)
    return live, first, begin[np.arange(len(step)) - first[step]] + step


def _expected(cells: np.ndarray, at: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions over one block of texts.

    Tokens are laid out step by step, so that each step of the recursion is a slice.
    """
    k = len(model.start)
    begin = np.concatenate([np.arange(a, b, TRAIN_LENGTH) for a, b in zip(at[:-1], at[1:], strict=True)])
    stop = np.minimum(begin + TRAIN_LENGTH, np.repeat(at[1:], -(-np.diff(at) // TRAIN_LENGTH)))
    inner = ~np.isin(begin, at[:-1])
    ahead, out = _entries(cells, begin, stop - begin, inner, model)
    order = np.argsort(begin - stop, kind="stable")  # the longest first
    begin, size, inner, ahead, out = begin[order], (stop - begin)[order], inner[order], ahead[order], out[order]
    live, first, tokens = _packed(begin, size)
    own = cells[tokens]
    emit, move, one = np.ascontiguousarray(model.emit.T)[own], model.move, np.ones(k)
    alpha, beta = np.empty((len(own), k)), np.empty((len(own), k))
    for m, f in zip(live.tolist(), first.tolist(), strict=True):
        a = ahead[:m] * emit[f : f + m]
        s = a @ one
        a /= s[:, None]
        alpha[f : f + m] = a
        emit[f : f + m] /= s[:, None]  # from here on, emission over scale
        ahead = a @ move
    moves = np.zeros((k, k))
    for t in range(len(live) - 1, -1, -1):
        m, f, on = live[t], first[t], live[t + 1] if t + 1 < len(live) else 0
        if on < m:  # sequences that end here
            ends = alpha[f + on : f + m]
            beta[f + on : f + m] = out[on:m] / (ends * out[on:m]).sum(axis=1, keepdims=True)
        if on:
            later = beta[f + m : f + m + on] * emit[f + m : f + m + on]
            moves += alpha[f : f + on].T @ later
            beta[f : f + on] = later @ move.T
    if inner.any():  # the moves over cuts
        place = np.empty(len(own), np.int64)
        place[tokens] = np.arange(len(own))
        heads = np.flatnonzero(inner)
        moves += alpha[place[begin[heads] - 1]].T @ (beta[heads] * emit[heads])
    gamma = alpha * beta
    gamma /= (gamma @ one)[:, None]
    emitted = np.stack([np.bincount(own, weights=gamma[:, j], minlength=CELLS) for j in range(k)])
    return gamma[: live[0]][~inner].sum(axis=0), model.move * moves, emitted


def _blocks(training: DataFrame) -> DataFrame:
    """The cells of all texts, two bytes a token, in blocks of texts, with the ends of the texts."""

    def run(batches):
        for batch in batches:
            for at, end in textarrays.slices(batch.column("text"), BLOCK_TOKENS * 6):
                _, cells, offsets = tokens_of(batch.column("text").slice(at, end - at), hashes=False)
                row = [pa.array([x.tobytes()], pa.binary()) for x in (cells.astype(np.uint16), offsets.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*row, pa.array([end - at])], ["cells", "ends", "texts"])

    return training.select("text").mapInArrow(run, "cells binary, ends binary, texts long")


def _round(blocks: DataFrame, model: Model, corpus: Corpus) -> Model:
    """One Baum-Welch round over blocks of texts; a table of fixed size comes back."""
    k = len(model.start)
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        total = np.zeros(k + k * k + k * CELLS)
        for batch in batches:
            for cells, ends in zip(batch.column("cells"), batch.column("ends"), strict=True):
                cells, ends = np.frombuffer(cells.as_buffer(), np.uint16).astype(np.int64), np.frombuffer(ends.as_buffer(), np.int64)
                total += np.concatenate([x.ravel() for x in _expected(cells, ends, shared.value)])
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], ["at", "n"])

    rows = blocks.select("cells", "ends").mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(k + k * k + k * CELLS)
    found[rows["at"]] = rows["n"]
    start, move, emit = found[:k] + 1, found[k : k + k * k].reshape(k, k) + 1, found[k + k * k :].reshape(k, CELLS)
    emit = emit + PRIOR * _overall(corpus)
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def _overall(corpus: Corpus) -> np.ndarray:
    return (corpus.tokens + 1) / (corpus.tokens.sum() + CELLS)


def _first_model(training: DataFrame, corpus: Corpus, states: int) -> Model:
    """States start from the cell counts of documents that fit those chosen before least.

    The documents come from a sample of at most SEED_DOCUMENTS.
    """
    overall = _overall(corpus)

    def histogram(batches):
        for batch in batches:
            _, cells, at = tokens_of(batch.column("text"), hashes=False)
            found = [np.unique(cells[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0].tolist() for x in found], pa.list_(pa.int64())), pa.array([x[1].tolist() for x in found], pa.list_(pa.int64()))], ["cell", "n"])

    sample = training.select("text", F.xxhash64("doc_id", "text").alias("h")).orderBy("h", "text").limit(SEED_DOCUMENTS)
    rows = sample.select("text").mapInArrow(histogram, "cell array<long>, n array<long>").toPandas()
    docs = np.zeros((len(rows), CELLS))
    for i, (cell, n) in enumerate(zip(rows["cell"], rows["n"], strict=True)):
        docs[i, cell] = n
    emit = [overall]
    if len(docs):
        size = docs.sum(axis=1)
        gain = np.full(len(docs), -np.inf)
        for _ in range(states - 1):
            gain = np.maximum(gain, docs @ np.log(emit[-1] / overall) / size)
            free = (docs * np.log((docs + PRIOR * overall) / (size + PRIOR)[:, None] / overall)).sum(axis=1) / size
            pick = int(np.argmax((free - gain) * np.minimum(size, 300)))
            emit.append((docs[pick] + PRIOR * overall) / (size[pick] + PRIOR))
    while len(emit) < states:
        emit.append(overall)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), np.stack(emit))


def train(training: DataFrame, corpus: Corpus, *, states: int = STATES, rounds: tuple[int, ...] = ROUNDS) -> Model:
    """Baum-Welch over a table of ``doc_id, text``."""
    model, whole = _first_model(training, corpus, states), None
    for i, share in enumerate(rounds):
        if share == 1:  # texts are split into tokens once, for all of these rounds
            whole = written(_blocks(training)) if whole is None else whole
            model = _round(whole, model, corpus)
        else:
            model = _round(_blocks(training.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(share)) == i % share)), model, corpus)
    if whole is not None:
        dropped(whole)
    return model


def log_likelihood(cells: np.ndarray, at: np.ndarray, model: Model, length: int = SCORE_LENGTH) -> np.ndarray:
    """Natural log probability of each text's cells by scaled forward recursion."""
    k, n = len(model.start), len(at) - 1
    emit = np.ascontiguousarray(model.emit.T)
    begin, size, ahead, owner = [], [], [], []
    for d, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for s in range(a, b, length):
            for pre in (model.start,) if s == a else model.move:
                begin.append(s)
                size.append(min(length, b - s))
                ahead.append(pre)
                owner.append(d)
    begin, size, ahead, owner = np.array(begin), np.array(size), np.array(ahead), np.array(owner)
    order = np.argsort(-size, kind="stable")
    rows = len(order)
    live, first, tokens = _packed(begin[order], size[order])
    emitted, one, scale = emit[cells[tokens]], np.ones(k), np.empty(len(tokens))
    last, cur = np.zeros((rows, k)), ahead[order]
    for m, f in zip(live.tolist(), first.tolist(), strict=True):
        a = cur[:m] * emitted[f : f + m]
        scale[f : f + m] = s = a @ one
        a /= s[:, None]
        last[:m] = a
        cur = a @ model.move
    logs = np.bincount(np.arange(len(tokens)) - np.repeat(first, live), weights=np.log(scale), minlength=rows)
    back = np.empty(rows, np.int64)
    back[order] = np.arange(rows)
    last, logs = last[back], logs[back]
    out = np.zeros(n)
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    out[owner[heads]] = logs[heads]
    tails = np.append(heads[1:], rows)
    for h, e in zip(heads[tails - heads > 1].tolist(), tails[tails - heads > 1].tolist(), strict=True):
        state, total = last[h], logs[h]
        for i in range(h + 1, e, k):  # chain the transfers from each state
            top = logs[i : i + k].max()
            mixed = (state * np.exp(logs[i : i + k] - top)) @ last[i : i + k]
            total += top + np.log(mixed.sum())
            state = mixed / mixed.sum()
        out[owner[h]] = total
    return out


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, *, train_on: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: tuple[int, ...] = ROUNDS, chunk_bytes: int = exchange.CHUNK_BYTES) -> DataFrame:
    """Score all documents, learning from those where ``train_on`` holds.

    Returns ``doc_id, n_tokens, n_known, train_tokens, base_score, score``; base is
    the add-one unigram model, score the log10 probability under the hidden Markov
    model. Null and empty texts are one end token. Repeated rows count, and are
    scored, as often as they stand; null ids are documents like any other; a null
    condition does not train. Without training documents the base is 0 a token. An
    empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(train_on, F.lit(False)).alias("train"))
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"]
    n = exchange.chunk_count(total, chunk_bytes)
    training = docs.where("train").select("doc_id", "text")
    corpus = corpus_counts(training, n)
    model = train(training, corpus, states=states, rounds=rounds)
    shared = docs.sparkSession.sparkContext.broadcast((model, corpus))  # of a fixed size
    dealt = exchange.dealt(docs, exchange.by_hash(n, "doc_id", "text"), n)

    def send(key, table):
        words, cells, at = tokens_of(table["text"], hashes=True)
        trains = np.repeat(table["train"].to_numpy(), np.diff(at)).astype(np.float64)
        unique, payload = _counted(words, cells, trains)
        return exchange.entries(key[0].as_py(), unique, n, payload)

    def count(_, keys, payload):
        _, which = np.unique(keys, return_inverse=True)
        found = np.bincount(which, weights=np.frombuffer(payload, _COUNT)["n"])
        return found[which].astype(np.int64)

    def score(_, table, got):
        model, corpus = shared.value
        ids, texts, parts = table["doc_id"], table["text"].combine_chunks(), []
        words, cells, at = tokens_of(texts, hashes=True)
        _, which = np.unique(words, return_inverse=True)
        c = exchange.returned(got, np.int64)[which]
        tokens, types = int(corpus.tokens.sum()), int(corpus.types.sum())
        add = lambda x: np.add.reduceat(x, at[:-1])
        within = np.log((c + 1) / (corpus.tokens[cells] + corpus.types[cells] + 1))
        parts = [
            np.diff(at).astype(np.int64), add((c > 0).astype(np.int64)), np.full(len(ids), tokens, np.int64),
            add(np.log10((c + 1) / (tokens + types + 1))), (add(within) + log_likelihood(cells, at, model)) / np.log(10),
        ]
        return pa.table([ids.cast(pa.int64()), *map(pa.array, parts)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    sent = dealt.groupBy("chunk").applyInArrow(send, exchange.ENTRY)
    back = exchange.answers(sent, n, count)
    return dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(score, SCORES)


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    return score_documents(docs, train_on=~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
