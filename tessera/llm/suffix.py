"""Suffix arrays over sequences of word numbers, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np

from tessera.llm.textkit import _power


def suffix_ranks(ids: np.ndarray, ends: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Rank of the suffix at each position, by prefix doubling.

    ids: non-negative numbers; ends: for each position the end of its text, where its suffix stops.
    Suffixes that agree to their ends, or to ``depth`` words, share a rank. Only suffixes whose
    rank is still shared are sorted again.
    """
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64)
    _, dense, counts = np.unique(ids, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[dense].astype(np.int64)  # the number of smaller suffixes: stays valid while groups split
    open_ = np.flatnonzero(counts[dense] > 1)
    h = 1
    while len(open_) and (depth is None or h < depth):
        nxt = open_ + h
        there = nxt < ends[open_]
        second = np.zeros(len(open_), np.int64)
        second[there] = rank[nxt[there]] + 1
        head = rank[open_]
        order = np.lexsort((second, head))
        head, second, at = head[order], second[order], open_[order]
        new_head = np.r_[True, head[1:] != head[:-1]]
        new = new_head | np.r_[True, second[1:] != second[:-1]]
        where = np.arange(len(at))
        group = np.maximum.accumulate(np.where(new_head, where, 0))
        sub = np.maximum.accumulate(np.where(new, where, 0))
        rank[at] = head + (sub - group)
        size = np.diff(np.r_[np.flatnonzero(new), len(at)])
        shared = np.repeat(size > 1, size)
        # a suffix that ended cannot be told apart from its equals any more
        shared &= second > 0
        open_ = np.sort(at[shared])
        h *= 2
    return rank


def suffix_array(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; equal suffixes by position."""
    return np.argsort(suffix_ranks(ids, ends), kind="stable")


class Prefixes:
    """Fingerprints of any range of words, for common prefixes by bisection."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        self.ends = ends
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * _power("up", len(words)), out=self.sums[1:])

    def at(self, a: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[a + length] - self.sums[a]) * _power("down", len(self.sums))[a]

    def common(self, a: np.ndarray, b: np.ndarray, least: int = 0) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, known to be ``least`` at least."""
        high = np.minimum(self.ends[a] - a, self.ends[b] - b)
        low = np.minimum(np.full(len(a), least, np.int64), high)
        while len(a) and (low < high).any():
            mid = (low + high + 1) // 2
            same = self.at(a, mid) == self.at(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def spans_union(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0
