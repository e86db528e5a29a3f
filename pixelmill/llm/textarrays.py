"""Vectorised word and hash arrays over a batch of texts.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All hashes are
polynomials modulo 2**64 over random byte values, so the hash of any byte range
follows from two prefix sums (Rabin-Karp).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 5)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A fixed random value for each byte.
BYTE_VALUE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of each hash over all 64; a bijection."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


@lru_cache(maxsize=4)
def _powers(n: int, inverse: bool) -> np.ndarray:
    base = pow(int(BASE), -1, 2**64) if inverse else int(BASE)
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    step, done = base, 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * U64(pow(step, 1, 2**64))
        step = step * step % 2**64
        done += take
    return out


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i modulo 2**64 for i < n; the length is rounded up to reuse tables."""
    return _powers(1 << max(16, int(n).bit_length()), inverse)


def buffers(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another and their n + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int):
    """Row ranges of about ``size`` bytes of text."""
    _, offsets = buffers(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(end, len(column))
        at = end


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 word offsets of the texts."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of byte value times BASE**i."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[raw] * powers(len(raw) + 1)[: len(raw)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each byte range, the same wherever the same bytes stand."""
    return (prefix[ends] - prefix[starts]) * powers(len(prefix), True)[starts]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word, block by block of bytes, so that scratch space stays small."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, side="right")))
        low = int(starts[i])
        prefix = prefix_hash(raw[low : int(ends[j - 1])])
        out[i:j] = range_hash(prefix, starts[i:j] - low, ends[i:j] - low)
        i = j
    return mix(out)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The rolling hash of each ``size`` consecutive word hashes (len - size + 1 of them)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= BASE
        out += words[k : k + n]
    return mix(out)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True."""
    padded = np.zeros(len(mask) + 2, np.int8)
    padded[1:-1] = mask
    step = np.diff(padded)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def covered(marks: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions a range of ``length`` starting at a position of ``marks`` covers."""
    begun = np.cumsum(np.bincount(marks, minlength=n)[:n])
    out = begun.copy()
    out[length:] -= begun[: max(0, n - length)]
    return out > 0
