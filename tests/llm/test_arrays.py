"""Byte planes, buckets and hash arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelmill.llm import exchange, textarrays


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.integers(1, 9))
def test_entries_round_trip(values, buckets):
    keys = np.unique(np.array(values, np.uint64))
    table = exchange.entries(5, keys, buckets, keys.astype(np.uint64))
    back = [exchange.unpack(x.as_buffer()) for x in table["keys"]]
    assert np.array_equal(np.concatenate([*back, np.zeros(0, np.uint64)]), keys)
    assert b"".join(table["payload"].to_pylist()) == keys.tobytes()
    assert sorted(table["bucket"].to_pylist()) == table["bucket"].to_pylist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\x0b", max_size=12)), max_size=8))
def test_word_bounds_follow_split(texts):
    raw, offsets = textarrays.buffers(pa.array(texts, pa.string()))
    starts, ends, at = textarrays.word_bounds(raw, offsets)
    data = raw.tobytes()
    for i, t in enumerate(texts):
        assert [data[s:e] for s, e in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]], strict=True)] == (t or "").encode().split()


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_word_hash_depends_on_the_word_only(block):
    raw, offsets = textarrays.buffers(pa.array(["abc def abc", "def  fed abc a b ab"]))
    starts, ends, _ = textarrays.word_bounds(raw, offsets)
    hashes = textarrays.word_hashes(raw, starts, ends, block)
    words = [raw[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
    by = {}
    for w, h in zip(words, hashes.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 29), max_size=30), st.integers(1, 7))
def test_covered(marks, length):
    n = 30
    marks = np.array(sorted(m for m in marks if m + length <= n), np.int64)
    want = np.zeros(n, bool)
    for m in marks:
        want[m : m + length] = True
    assert np.array_equal(textarrays.covered(marks, length, n), want)
    start, end = textarrays.runs(want)
    assert sum((end - start).tolist()) == int(want.sum())
