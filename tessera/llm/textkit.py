"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A batch of texts is one byte array with document offsets. Words are runs of
bytes of a class; every byte of a multi-byte character is a word byte in both
classes used here, so byte runs and character runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def _table(excluded) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    for a, b in excluded:
        t[a : b + 1] = False
    return t


#: [^\x20\x09-\x0D]
NON_SPACE = _table([(0x20, 0x20), (0x09, 0x0D)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z became lower case
ALPHANUMERIC = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_STEP = U64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    got = _powers.get(which)
    if got is None or len(got) < n:
        base = _BASE if which == "up" else _INVERSE
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        got = _powers[which] = np.multiply.accumulate(steps)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each (one more than texts); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 2_000_000, rows: int = 4_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one come to ``most`` bytes and ``rows`` rows at most, or are a single text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0)).astype(np.int64)
        begin, total = 0, 0
        for i in range(n):
            if i > begin and (total + sizes[i] > most or i - begin >= rows):
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(sizes[i])
        yield batch.slice(begin, n - begin)


class Words:
    """Words of a batch: byte starts and ends, and for each text the range ``first[d]:first[d + 1]`` of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inside = kind[self.data]
        begin = inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            heads = offsets[:-1][offsets[:-1] < n]
            begin[heads] = inside[heads]
            end = inside.copy()
            end[:-1] &= ~inside[1:]
            tails = offsets[1:] - 1
            tails = tails[tails >= 0]
            end[tails] = inside[tails]
        else:
            end = begin
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit fingerprint of each word."""
        n = len(self.data)
        if not n or not len(self.starts):
            return np.zeros(len(self.starts), np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _power("up", n), out=sums[1:])
        raw = (sums[self.ends] - sums[self.starts]) * _power("down", n)[self.starts]
        return mix(raw + (self.ends - self.starts).astype(np.uint64) * _STEP)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of k consecutive words at each word, and which are whole inside their text."""
    n = len(words)
    out = np.zeros(n, np.uint64)
    for t in range(k):
        out[: n - t] = out[: n - t] * _BASE + words[t:]
        if t + 1 < k and n - t - 1 <= 0:
            break
    ends = np.repeat(first[1:], np.diff(first))
    return mix(out + np.array([k], np.uint64) * _STEP), np.arange(n) + k <= ends
