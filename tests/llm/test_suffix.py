"""Words, shingles and suffix arrays against plain Python."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm.suffix import Prefixes, spans_union, suffix_array
from tessera.llm.textkit import ALPHANUMERIC, NON_SPACE, Words, bytes_of, pieces, shingles

TEXTS = ["", None, "one", " a  b\tc\n", "Éa éA", "x" * 70_000, "a b a b a b a", " z "]
CASES = [(NON_SPACE, r"[^\x20\x09-\x0D]+"), (ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize(("kind", "pattern"), CASES)
def test_words(kind, pattern):
    w = Words(*bytes_of(pa.array(TEXTS)), kind, lower=True)
    data = w.data.tobytes()
    got = [[data[a:b].decode() for a, b in zip(w.starts[x:y], w.ends[x:y])] for x, y in zip(w.first, w.first[1:])]
    assert got == [re.findall(pattern, low(t)) for t in TEXTS]
    flat = sum(got, [])
    h = w.hashes()
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def test_no_texts():
    w = Words(*bytes_of(pa.array([], pa.string())), NON_SPACE, lower=True)
    assert len(w) == 0 and len(w.hashes()) == 0


def test_slices_of_arrays():
    whole = pa.array(["ab c", "d", None, "e f"])
    assert Words(*bytes_of(whole.slice(1, 3)), NON_SPACE, False).counts.tolist() == [1, 0, 2]


@given(st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=4))
@settings(max_examples=150, deadline=None)
def test_suffix_array(docs):
    ids = np.array(sum(docs, []), np.int64)
    ends = np.concatenate([np.full(len(d), e) for d, e in zip(docs, np.cumsum([len(d) for d in docs]), strict=True)] or [np.zeros(0)]).astype(np.int64)
    flat = ids.tolist()
    want = sorted(range(len(flat)), key=lambda i: (flat[i : ends[i]], i))
    assert suffix_array(ids, ends).tolist() == want
    if len(flat) > 1:
        a, b = np.arange(len(flat) - 1), np.arange(1, len(flat))
        got = Prefixes(ids.astype(np.uint64) + np.uint64(7), ends).common(a, b)
        for i, j, n in zip(a, b, got):
            x, y = flat[i : ends[i]], flat[j : ends[j]]
            k = 0
            while k < min(len(x), len(y)) and x[k] == y[k]:
                k += 1
            assert n == k


def test_shingles_stay_inside_texts():
    w = Words(*bytes_of(pa.array(["a b c", "b c", "a b"])), NON_SPACE, False)
    h, whole = shingles(w.hashes(), w.first, 2)
    assert whole.tolist() == [True, True, False, True, False, True, False]
    assert h[1] == h[3] and h[0] == h[5] and h[0] != h[1]


def test_union_of_spans():
    assert spans_union(np.array([1, 2, 6]), np.array([2, 3, 1]), 8).tolist() == [False, True, True, True, True, False, True, False]


def test_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "bbbb", "c" * 50, ""])], names=["t"])
    parts = list(pieces(iter([batch]), "t", most=6))
    assert [p.num_rows for p in parts] == [3, 1, 1]
    assert [p.num_rows for p in pieces(iter([batch]), "t", rows=2)] == [2, 2, 1]
