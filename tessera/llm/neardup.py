"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

SuperMinHash gives every element one pseudorandom permutation of the signature's
slots instead of independent hashes per slot; the ranks of a permutation are
correlated, which lowers the variance, and a text stops drawing as soon as no
later rank can lower any slot.

Texts with equal shingle sets form a class, which one representative (the
smallest doc_id) stands for. Representatives that share a band are candidates;
with 40 bands of 5 slots a pair at similarity 0.75 is missed with probability
2e-5, at 0.8 with 1e-7. Members of a bucket are first compared with its centre,
its smallest member. Only pairs of a bucket that then still lie in different
components are considered further, and those are found by an index on how
members differ from their centre, never by pairing a bucket's members.
Each link is confirmed on the full shingle sets of both texts.

The index: let R be the centre's shingles that x lacks, A those of x that the
centre lacks, E their union, w = 4 |R| + 3 |A|, and c the centre's size. x and
y link exactly if 7 |E(x) and E(y) common| >= w(x) + w(y) - c. Of two members in
different components one at least does not link with the centre, so its w is
over c and the common part is not empty. Sort each E by how many members have a
shingle, rarest first. If the first common shingle is number i of E(x) and j of
E(y), the common part is at most min(|E(x)| - i, |E(y)| - j), which must reach
(w(x) + w(y) - c) / 7. So with w(x) >= w(y), y is looked up under its shingle j
only if 7 (|E(y)| - j) >= 2 w(y) - c, and x asks under its shingle i only for
w(y) <= 7 (|E(x)| - i) + c - w(x). What texts share with many others of their
bucket, such as a common passage, comes last in that order and is not asked for.

Defined cases: a text without words (or null) has an empty set, links with
nothing and is kept; fewer words than a shingle are one shingle; rows that
share a doc_id are one document; rows with a null doc_id link with nothing,
have a null component and are kept. Ids must be whole numbers, other types are
an error. No column of the input is reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.errors import EngineError
from tessera.llm import scratch
from tessera.llm.components import stars
from tessera.llm.textkit import NON_SPACE, U64, Words, bytes_of, mix, pieces, shingles

WIDTH = 5
BANDS, ROWS = 40, 5
SLOTS = BANDS * ROWS
#: 100 * intersection >= THRESHOLD * union
THRESHOLD = 75
#: ids up to which a table of them is broadcast (8 bytes each); beyond, it is shuffled
BROADCAST_IDS = 2_000_000
_TOP = U64(52)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted fingerprints."""
    data, offsets = bytes_of(texts)
    w = Words(data, offsets, NON_SPACE, lower=True)
    words = w.hashes()
    grams, whole = shingles(words, w.first, width)
    out = []
    for d, n in enumerate(w.counts.tolist()):
        a = w.first[d]
        if n >= width:
            out.append(np.unique(grams[a : a + n - width + 1]))
        elif n:
            out.append(shingles(words[a : a + n], np.array([0, n]), n)[0][:1])
        else:
            out.append(grams[:0])
    return out


def superminhash(sets: list[np.ndarray], slots: int = SLOTS, most: int = 50_000) -> np.ndarray:
    """One signature per set: in each slot the smallest (rank, random fraction) that any element has there."""
    full = np.full((len(sets), slots), ~U64(0))
    begin = 0
    while begin < len(sets):
        end, n = begin + 1, len(sets[begin])
        while end < len(sets) and n + len(sets[end]) <= most:
            n += len(sets[end])
            end += 1
        _sign(sets[begin:end], full[begin:end], slots)
        begin = end
    return full


def _sign(sets: list[np.ndarray], h: np.ndarray, slots: int) -> None:
    flat = h.reshape(-1)
    x = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    perm = None
    for j in range(slots):
        if not len(x):
            return
        drawn = mix(x + np.array([j + 1], np.uint64) * U64(0x9E3779B97F4A7C15))
        k = j + (((drawn & U64(0xFFFFFFFF)) * U64(slots - j)) >> U64(32)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            rows = np.arange(len(x))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
        value = (drawn >> U64(12)) | (U64(j) << _TOP)
        at = own * slots + slot
        np.minimum.at(flat, at, value)
        # early stopping: a later rank is larger than all that the signature holds
        going = h.max(axis=1) >= (U64(j + 1) << _TOP)
        live = going[own]
        if 4 * np.count_nonzero(live) < 3 * len(live):  # draws of the others lower nothing
            x, own, k = x[live], own[live], k[live]
            perm = perm[live] if perm is not None else None
        if perm is None and len(x):
            perm = np.broadcast_to(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(x), slots)).copy()
            perm[np.arange(len(x)), k] = 0
    return


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n = len(signatures)
    cut = signatures.reshape(n, bands, -1)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + U64(77)), (n, bands)).copy()
    for r in range(cut.shape[2]):
        key = mix(key + cut[:, :, r])
    return key.view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches, "text"):
        sets = shingle_sets(part.column("text"))
        sizes = np.array([len(s) for s in sets], np.int64)
        filled = np.flatnonzero(sizes)
        high, low = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
        keys = np.zeros(0, np.int64)
        if len(filled):
            x, starts = np.concatenate(sets), np.r_[0, np.cumsum(sizes[filled])[:-1]]
            high[filled] = np.add.reduceat(mix(x ^ U64(0x5BF03635)), starts)
            low[filled] = np.add.reduceat(mix(x + U64(0x27D4EB2F165667C5)), starts)
            keys = band_keys(superminhash([sets[i] for i in filled])).reshape(-1)
        edges = np.r_[0, np.cumsum(np.where(sizes > 0, BANDS, 0))].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(sizes), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.ListArray.from_arrays(pa.array(edges), pa.array(keys, pa.int64()))],
            names=["doc_id", "n_shingles", "high", "low", "bands"],
        )


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each pair links."""
    for part in pieces(pieces(batches, "text_a"), "text_b"):
        ok = []
        for x, y in zip(shingle_sets(part.column("text_a")), shingle_sets(part.column("text_b")), strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(both > 0 and 100 * both >= THRESHOLD * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How a differs from its centre b: the size of b, w, |E| and, a row each, the shingles of E."""
    kinds = [pa.int64()] * 6
    for part in pieces(pieces(batches, "text_a"), "text_b"):
        for a, b, x, y in zip(part.column("a"), part.column("b"), shingle_sets(part.column("text_a")), shingle_sets(part.column("text_b")), strict=True):
            apart = np.setxor1d(x, y, assume_unique=True)
            both = (len(x) + len(y) - len(apart)) // 2
            fixed = (a.as_py(), b.as_py(), len(y), 4 * (len(y) - both) + 3 * (len(x) - both), len(apart))
            for begin in range(0, len(apart), 50_000):
                some = apart[begin : begin + 50_000]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(some), v, np.int64)) for v in fixed), pa.array(some.view(np.int64))], schema=pa.schema(list(zip(("rep", "centre", "size", "w", "differ", "shingle"), kinds, strict=True))))


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The tested pairs, with whether they link."""
    return scratch.table(_with_texts(pairs, texts).mapInArrow(_linked, "a long, b long, linked boolean"), "tested")


def _pairs(component: DataFrame) -> DataFrame:
    return component.select(F.col("v").alias("a"), F.col("m").alias("b"))


def _open(members: DataFrame, component: DataFrame) -> DataFrame:
    """Members, with their components, of the buckets that hold more than one component."""
    placed = members.join(component.withColumnsRenamed({"v": "rep", "m": "root"}), "rep", "left").select("bucket", "rep", "centre", F.coalesce("root", "rep").alias("root"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    return scratch.table(placed.join(split, "bucket"), "open")


def _possible(open_: DataFrame, tested: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of different components that the index on differences from a centre leaves."""
    members = scratch.table(open_.filter("rep <> centre").select("rep", "centre", "root").distinct(), "around")
    spread = _with_texts(members.select(F.col("rep").alias("a"), F.col("centre").alias("b")), texts).mapInArrow(_differences, "rep long, centre long, size long, w long, differ long, shingle long")
    spread = scratch.table(spread, "differences")
    often = spread.groupBy("centre", "shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")  # the others meet nothing, and come first
    rarest = Window.partitionBy("rep", "centre").orderBy(F.coalesce("often", F.lit(1)), "shingle")
    placed = spread.join(often, ["centre", "shingle"], "left").withColumn("i", F.row_number().over(rarest) - 1).filter("often > 1")
    # what is left of E from here on bounds the common part
    placed = placed.withColumn("most", 7 * (F.col("differ") - F.col("i")) + F.col("size") - F.col("w")).filter("most >= 0")
    placed = scratch.table(placed.join(members, ["rep", "centre"]).select("centre", "shingle", "rep", "root", "w", "most"), "index")
    held = placed.filter("most >= w").select("centre", "shingle", *(F.col(c).alias(f"y_{c}") for c in ("rep", "root", "w", "most")))
    larger = (F.col("w") > F.col("y_w")) | ((F.col("w") == F.col("y_w")) & (F.col("rep") > F.col("y_rep")))
    fits = larger & (F.col("root") != F.col("y_root")) & (F.col("y_w") <= F.col("most")) & (F.col("w") <= F.col("y_most"))
    met = placed.join(held, ["centre", "shingle"]).filter(fits)
    return met.select(F.greatest("rep", "y_rep").alias("a"), F.least("rep", "y_rep").alias("b")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise EngineError(f"ids of near duplicates must be whole numbers, {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    feats = scratch.table(src.mapInArrow(_features, "doc_id long, n_shingles long, high long, low long, bands array<long>"), "features")

    filled = feats.filter("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("high", "low").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("bands").alias("bands"))
    classes = scratch.table(classes, "classes")

    spread = classes.select("rep", F.explode("bands").alias("bucket"))
    full = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("centre")).filter("n > 1")
    members = scratch.table(spread.join(full, "bucket").select("bucket", "rep", "centre"), "members")

    ids = members.select(F.col("rep").alias("doc_id")).distinct()
    ids = scratch.table(ids, "candidates")
    n_ids = ids.count()
    texts = scratch.table(src.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "doc_id", "left_semi"), "texts")

    component = None
    if n_ids:
        first = members.groupBy(F.col("rep").alias("a")).agg(F.min("centre").alias("b")).filter("b < a")
        tested = _verify(first, texts)
        component = stars(tested.filter("linked"))
        more = _open(members, component).filter("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
        again = _verify(more.join(tested.select("a", "b"), ["a", "b"], "left_anti"), texts)
        tested = tested.union(again)
        component = stars(_pairs(component).union(again.filter("linked").select("a", "b")))
        last = _verify(_possible(_open(members, component), tested, texts), texts)
        component = stars(_pairs(component).union(last.filter("linked").select("a", "b")))
    named = classes.select("high", "low", "rep", "size")
    if component is not None:
        named = named.join(component.withColumnsRenamed({"v": "rep", "m": "root"}), "rep", "left").select("high", "low", "size", "rep", F.coalesce("root", "rep").alias("root"))
    else:
        named = named.withColumn("root", F.col("rep"))
    grouped = named.filter("size > 1 or root <> rep").select("high", "low", F.col("root").alias("component"))
    out = feats.select("doc_id", "n_shingles", *(F.when(F.col("n_shingles") > 0, F.col(c)).alias(c) for c in ("high", "low"))).join(grouped, ["high", "low"], "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component_id)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, and of rows that share an id one row."""
    verdict = scratch.table(near_duplicates(docs, id_col, text_col), "verdict")
    other, row = scratch.free_name(docs.columns, "_id"), scratch.free_name([id_col], "_row")
    same = F.col(f"`{id_col}`").cast("long") == F.col(other)
    gone = scratch.table(verdict.filter(~F.col("kept")).select(F.col("doc_id").alias(other)).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    left = docs.join(gone, same, "left_anti")
    again = verdict.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(other))
    again = scratch.table(again, "again")
    if again.isEmpty():
        return left
    twice = left.join(again, same, "left_semi")
    choice = twice.groupBy(F.col(f"`{id_col}`")).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns if docs.schema[c].dataType.typeName() != "map"))).alias(row))
    return left.join(again, same, "left_anti").unionByName(choice.select(f"{row}.*"))
