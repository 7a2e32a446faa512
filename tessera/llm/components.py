"""Connected components of an edge table, as stars around each component's smallest node.

Edges are first contracted by union-find inside each partition; what is left
alternates large-star and small-star steps until nothing moves. Edges stay
distributed throughout. A node of more than a share of all edges is a hub: the
smallest neighbours of hubs, HUBS nodes at most, are broadcast, so that a
component around one node isn't dealt to one task.

Defined cases: no edges give no rows; edges from a node to itself and edges
with a null are left out; repeated edges count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import scratch

#: nodes of the table of hubs at most (16 bytes each)
HUBS = 100_000
#: edges of a node up to which it is none
FEW = 64


class UnionFind:
    """Disjoint sets of integers; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:  # a batch bounds the memory; what it leaves apart, the star steps join
        sets = UnionFind()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.join(a, b)
        pairs = [(x, r) for x in list(sets.up) if (r := sets.find(x)) != x]
        v = np.array(pairs, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(v[:, 0]), pa.array(v[:, 1])], names=["v", "m"])


def _with_low(e: DataFrame, edges: int) -> DataFrame:
    """Adds to edges ``v, m`` the smallest m of each v, as ``low``."""
    least = scratch.table(e.groupBy("v").agg(F.min("m").alias("low"), F.count(F.lit(1)).alias("n")), "least")
    # a hub has more than 2 * edges / HUBS of the 2 * edges rows at most, so there are HUBS of them at most
    hub = F.col("n") > max(FEW, 2 * edges // HUBS)
    hubs = F.broadcast(least.filter(hub).select("v", "low"))
    light = least.filter(~hub).select("v", "low")
    return e.join(hubs, "v").unionByName(e.join(hubs, "v", "left_anti").join(light, "v"))


def _large_star(e: DataFrame, edges: int) -> DataFrame:
    both = e.union(e.select(F.col("m").alias("v"), F.col("v").alias("m")))
    moved = _with_low(both, edges).filter(F.col("m") > F.col("v"))
    return moved.select(F.col("m").alias("v"), F.least("v", "low").alias("m"))


def _small_star(e: DataFrame, edges: int) -> DataFrame:
    down = e.select(F.greatest("v", "m").alias("v"), F.least("v", "m").alias("m")).distinct()
    met = _with_low(down, edges)
    moved = met.filter("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
    return moved.union(met.select("v", F.col("low").alias("m"))).filter("v <> m").distinct()


def _is_stars(e: DataFrame) -> bool:
    """Every node points to one other, which points to none."""
    roles = e.select(F.col("v").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("held")).union(e.select("m", F.lit(0), F.lit(1)).distinct())
    return roles.groupBy("node").agg(F.sum("points").alias("points"), F.max("held").alias("held")).filter("points > 1 or (points = 1 and held = 1)").isEmpty()


def stars(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``v, m``: each node that is not the smallest of its component, and that smallest node."""
    e = edges.select(F.greatest(a, b).cast("long").alias("v"), F.least(a, b).cast("long").alias("m")).filter("v <> m").mapInArrow(_contract, "v long, m long")
    now = scratch.table(e.distinct(), "edges")
    while not _is_stars(now):
        n = now.count()
        now = scratch.table(_small_star(scratch.table(_large_star(now, n), "large"), n), "stars")
    return now
