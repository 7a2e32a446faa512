"""Benchmark decontamination by suffix arrays over shards of the corpus.

A shard is a batch of whole documents. All its words, as numbers in one
sequence, get a suffix array (to the depth of a window; suffixes end with their
document), and every distinct benchmark suffix, to that depth, is looked up in
it by binary search; only those with a word that the shard does not have at all
need no search. The range it finds lists all locations of its window;
neighbouring windows on the same diagonal make the longest verbatim match.

Defined cases: null texts and texts without words match nothing; an item of
fewer words than the window is one window, one without words none; repeated
documents get equal results; repeated items count once each by item_id (null
ids count in no list). The benchmark is read in blocks of ``block_words``, so
what is broadcast has a fixed bound; with one block documents never shuffle,
with more they are read once for each. No column of the input is reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.suffix import suffix_ranks
from tessera.llm.textkit import ALPHANUMERIC, Words, bytes_of, pieces

#: pairs of a place in a shard and one in the benchmark that are held at a time, about
PAIRS = 2_000_000
#: item ids of a batch of results, about
NAMES = 500_000


class Windows:
    """The distinct windows of a block of benchmark items, with their items."""

    def __init__(self, ids: list, texts: list, width: int = 10):
        data, offsets = bytes_of(pa.array(texts, pa.string()))
        w = Words(data, offsets, ALPHANUMERIC, lower=True)
        words, counts = w.hashes(), w.counts
        length = np.minimum(counts, width)
        self.width = width
        self.sizes = sorted(set(length[length > 0].tolist()))
        start, item, size = [], [], []
        for k in self.sizes:
            which = np.flatnonzero(length == k)
            n = counts[which] - k + 1
            item.append(np.repeat(which, n))
            start.append(np.concatenate([np.arange(w.first[d], w.first[d] + c) for d, c in zip(which, n, strict=True)]))
            size.append(np.full(int(n.sum()), k, np.int64))
        start, item, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (start, item, size))
        reach = start[:, None] + np.arange(width)
        self.rows = np.where(np.arange(width) < size[:, None], words[np.minimum(reach, max(len(words) - 1, 0))] if len(words) else 0, 0).astype(np.uint64)
        self.size = size
        # equal windows once; of each, the items that have it and where
        key = np.concatenate([self.rows, size[:, None].astype(np.uint64)], axis=1)
        self.rows, owner = np.unique(key, axis=0, return_inverse=True) if len(key) else (key, np.zeros(0, np.int64))
        self.size = self.rows[:, -1].astype(np.int64)
        self.rows = np.ascontiguousarray(self.rows[:, :-1])
        owner = owner.reshape(-1).astype(np.int64)
        order = np.lexsort((start, item, owner))
        self.items, self.starts, owner = item[order], start[order], owner[order]
        self.edges = np.searchsorted(owner, np.arange(len(self.rows) + 1))
        #: windows with their items as one ascending number, to find a range of items
        self.n_items = max(1, len(ids))
        self.places = owner * self.n_items + self.items
        self.names = [None if x is None else str(x) for x in ids]


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values).clip(max=len(ordered) - 1)
    return ordered[at] == values


def search(texts: pa.Array, win: Windows) -> dict[str, np.ndarray]:
    """All places of all windows in a shard: ``doc``, ``pos`` (word of the document) and ``window``."""
    data, offsets = bytes_of(texts)
    w = Words(data, offsets, ALPHANUMERIC, lower=True)
    none = {"doc": np.zeros(0, np.int64), "pos": np.zeros(0, np.int64), "window": np.zeros(0, np.int64), "counts": w.counts.astype(np.int64)}
    if not len(win.rows) or not len(w):
        return none
    words = w.hashes()
    ends = np.repeat(w.first[1:], w.counts)
    alphabet, ids = np.unique(words, return_inverse=True)
    ids = ids.reshape(-1) + 1
    order = np.argsort(suffix_ranks(ids, ends, win.width), kind="stable")

    known = _among(win.rows.reshape(-1), alphabet).reshape(win.rows.shape)
    inside = np.arange(win.width) < win.size[:, None]
    ask = np.flatnonzero((known | ~inside).all(axis=1))
    rows, inside = win.rows[ask], inside[ask]
    if not len(ask):
        return none
    want = np.where(inside, np.searchsorted(alphabet, rows.reshape(-1)).reshape(rows.shape) + 1, 0)
    size = win.size[ask]

    def bisect(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(ask), np.int64), np.full(len(ask), len(order), np.int64)
        while (low < high).any():
            live = low < high
            mid = np.where(live, (low + high) // 2, 0)
            suffix = order[mid]
            state = np.zeros(len(ask), np.int8)  # of the suffix against the window
            for t in range(win.width):
                todo = (state == 0) & (t < size)
                if not todo.any():
                    break
                p = suffix[todo] + t
                have = np.where(p < ends[suffix[todo]], ids[p.clip(max=len(ids) - 1)], 0)
                state[todo] = np.sign(have - want[todo, t])
            right = (state < 0) | (upper & (state == 0))
            low = np.where(live & right, mid + 1, low)
            high = np.where(live & ~right, mid, high)
        return low

    low, high = bisect(False), bisect(True)
    n = high - low
    found = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    place = order[found]
    doc = np.searchsorted(w.first, place, side="right") - 1
    return none | {"doc": doc, "pos": place - w.first[doc], "window": np.repeat(ask, n)}


def _longest(doc: np.ndarray, pos: np.ndarray, window: np.ndarray, win: Windows, items: tuple[int, int], out: np.ndarray) -> None:
    """Raises ``out`` to each document's longest match with an item of a range: runs of neighbouring windows on one diagonal."""
    low, high = (np.searchsorted(win.places, window * win.n_items + k) for k in items)
    n = high - low
    hit = np.repeat(np.arange(len(doc)), n)
    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    if not len(at):
        return
    item, diagonal, size = win.items[at], win.starts[at] - pos[hit], win.size[window][hit]
    order = np.lexsort((pos[hit], diagonal, item, doc[hit]))
    d, i, g, p, k = doc[hit][order], item[order], diagonal[order], pos[hit][order], size[order]
    head = np.flatnonzero(np.r_[True, (np.diff(d) != 0) | (np.diff(i) != 0) | (np.diff(g) != 0) | (np.diff(p) != 1)])
    np.maximum.at(out, d[head], np.diff(np.r_[head, len(d)]) + k[head] - 1)


def verdicts(texts: pa.Array, win: Windows) -> Iterator[dict[str, list]]:
    """For each text: words, covered spans as start and end, longest verbatim match in words, and item ids; a range of texts at a time."""
    got = search(texts, win)
    n_docs = len(texts)
    order = np.lexsort((got["pos"], got["doc"]))
    doc, pos, window = (got[k][order] for k in ("doc", "pos", "window"))
    size, pairs = win.size[window], win.edges[window + 1] - win.edges[window]
    edges = np.searchsorted(doc, np.arange(n_docs + 1))
    longest = np.zeros(n_docs, np.int64)
    total = np.r_[0, np.cumsum(pairs)]
    first = 0
    while first < n_docs:  # documents in ranges, and items of one document in ranges, so that few pairs are held
        last = max(first + 1, int(np.searchsorted(total[edges], total[edges[first]] + PAIRS, side="right")) - 1)
        mine = slice(edges[first], edges[last])
        step = max(1, int(win.n_items * PAIRS // max(PAIRS, total[edges[last]] - total[edges[first]])))
        for k in range(0, win.n_items, step) if edges[last] > edges[first] else ():
            _longest(doc[mine], pos[mine], window[mine], win, (k, min(k + step, win.n_items)), longest)
        first = last
    begin, out, held = 0, {"spans": [], "items": []}, 0

    def done(stop: int) -> dict[str, list]:
        return out | {"begin": begin, "n_words": got["counts"][begin:stop], "longest": longest[begin:stop]}

    for d in range(n_docs):
        mine = slice(edges[d], edges[d + 1])
        names: set = set()
        spans: list = []
        if edges[d] < edges[d + 1]:
            for x in np.unique(window[mine]):
                names.update(win.names[k] for k in np.unique(win.items[win.edges[x] : win.edges[x + 1]]))
            names.discard(None)
            reach = np.maximum.accumulate(pos[mine] + size[mine])
            head = np.r_[True, pos[mine][1:] > reach[:-1]]
            spans = np.stack([pos[mine][head], reach[np.r_[np.flatnonzero(head)[1:] - 1, len(reach) - 1]]], axis=1).reshape(-1).tolist()
        out["spans"].append(spans)
        out["items"].append(sorted(names))
        held += len(names)
        if held > NAMES:
            yield done(d + 1)
            begin, out, held = d + 1, {"spans": [], "items": []}, 0
    if begin < n_docs:
        yield done(n_docs)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list]:
    """The benchmark's rows, at most about ``block_words`` words at a time on the driver."""
    b = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item_id"), F.col(f"`{text_col}`").alias("text")).distinct()  # so that repeated items do not make a block large
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // (4 * block_words)))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield (b if n == 1 else b.filter(part == k)).collect()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, longest_match, spans, item_ids.

    ``spans`` holds start and end words of covered passages in turn, ``longest_match`` the words of the longest of them.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("key", F.xxhash64("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    found = None
    rounds = 0
    for rows in blocks(benchmark, "item_id", "text", block_words):
        shared = spark.sparkContext.broadcast(Windows([r[0] for r in rows], [r[1] for r in rows], width))
        one = src.mapInArrow(_finder(shared), f"doc_id {kind}, key long, n_words long, n_hit long, longest_match long, spans array<int>, item_ids array<string>")
        found = one.withColumn("block", F.lit(rounds)) if found is None else found.unionByName(one.withColumn("block", F.lit(rounds)))
        rounds += 1
    if rounds > 1:
        # equal texts of one id give equal rows, so they meet in one group and are told apart by their number
        g = found.groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), F.max("longest_match").alias("longest_match"), F.count_if(F.col("block") == 0).alias("copies"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
        edges = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1), lambda i: F.struct(F.get("spans", 2 * i).alias("a"), F.get("spans", 2 * i + 1).alias("b"))))
        union = F.aggregate(edges, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["to"], x["a"]))).alias("n"), F.greatest(s["to"], x["b"]).alias("to")), lambda s: s["n"].cast("long"))
        found = g.withColumn("n_hit", F.when(F.size("spans") > 0, union).otherwise(F.lit(0).cast("long"))).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select("doc_id", "n_words", "n_hit", "longest_match", "spans", "item_ids")


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            for v in verdicts(part.column("text"), shared.value):
                some = part.slice(v["begin"], len(v["spans"]))
                hit = [sum(x[1::2]) - sum(x[::2]) for x in v["spans"]]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("key"), pa.array(v["n_words"], pa.int64()), pa.array(hit, pa.int64()), pa.array(v["longest"], pa.int64()), pa.array(v["spans"], pa.list_(pa.int32())), pa.array(v["items"], pa.list_(pa.string()))],
                    names=["doc_id", "key", "n_words", "n_hit", "longest_match", "spans", "item_ids"],
                )

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all columns as they were."""
    spark = docs.sparkSession
    for rows in blocks(benchmark, "item_id", "text", block_words):
        shared = spark.sparkContext.broadcast(Windows([r[0] for r in rows], [r[1] for r in rows], width))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in pieces(batches, text_col):
                keep = np.ones(part.num_rows, bool)
                keep[search(part.column(text_col), shared.value)["doc"]] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
