"""Counting keys of all documents without moving a row for each key.

Documents are dealt into chunks of bounded size, each handled by one task. A
chunk's distinct 64-bit keys (windows, words, anchors) are sorted and cut by
value into buckets; a chunk sends one row per bucket, holding its keys as bytes.
A bucket therefore gets each key at most once from every chunk, however many
copies a hot group has: keys are pre-aggregated before the shuffle, and hash
values spread evenly. Buckets answer in the order of the keys they were sent,
and the answers meet the chunk's documents again. The documents are shuffled
once; Spark reuses that exchange for the second visit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a chunk. Scratch arrays in a Python worker take some 25 times this.
CHUNK_BYTES = 6 << 20
ENTRY = "chunk long, bucket int, keys binary, payload binary"


def chunk_count(total_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    return max(1, -(-int(total_bytes or 0) // chunk_bytes))


def dealt(docs: DataFrame, chunk: Column, n_chunks: int) -> DataFrame:
    """``docs`` with a column ``chunk``, each chunk's rows in one partition."""
    return docs.withColumn("chunk", chunk.cast("long")).repartition(max(1, n_chunks), "chunk")


def by_hash(n_chunks: int, *names: str) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(n_chunks))


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes, high bytes first: the high planes compress well."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(">u8").reshape(-1).astype(np.uint64)


def bucket_edges(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket's part of the sorted keys begins, and the end."""
    width = -(-(1 << 64) // n_buckets)
    edges = np.array([min(i * width, 2**64 - 1) for i in range(1, n_buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def entries(chunk: int, keys: np.ndarray, n_buckets: int, payload: np.ndarray | None = None) -> pa.Table:
    """One row per bucket for a chunk's sorted distinct keys, with a value for each key."""
    at = bucket_edges(keys, n_buckets)
    full = np.flatnonzero(np.diff(at))
    return pa.table({
        "chunk": pa.array(np.full(len(full), chunk, np.int64)),
        "bucket": pa.array(full.astype(np.int32)),
        "keys": pa.array([pack(keys[at[b] : at[b + 1]]) for b in full], pa.binary()),
        "payload": pa.array([b"" if payload is None else payload[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()),
    })


def answers(sent: DataFrame, n_buckets: int, answer: Callable) -> DataFrame:
    """Each bucket's answers, one row per chunk and bucket.

    ``answer(chunks, keys, payloads)`` gets the sender of each key, all keys of
    the bucket and the payload bytes joined in the same order; it returns one
    value per key.
    """

    def one(_, table):
        parts = [unpack(x.as_buffer()) for x in table["keys"]]
        sizes = [len(x) for x in parts]
        chunks = np.repeat(table["chunk"].to_numpy(), sizes)
        values = answer(chunks, np.concatenate(parts), b"".join(x.as_py() for x in table["payload"]))
        cuts = np.split(values, np.cumsum(sizes)[:-1])
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "answer": pa.array([x.tobytes() for x in cuts], pa.binary())})

    return sent.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(one, "chunk long, bucket int, answer binary")


def returned(table: pa.Table, dtype) -> np.ndarray:
    """A chunk's answers in the order of its sorted keys."""
    if table.num_rows == 0:
        return np.zeros(0, dtype)
    order = np.argsort(table["bucket"].to_numpy())
    got = table["answer"].to_pylist()
    return np.frombuffer(b"".join(got[i] for i in order), dtype)
