"""Set operations and windows: beyond the parity set, listed by the roadmap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.errors import EngineError
from tessera.operators.sorting import SortKey


def combine(left: DataFrame, right: DataFrame, how: str, all_rows: bool = False) -> DataFrame:
    match how:
        case "union":
            out = left.unionByName(right)
            return out if all_rows else out.distinct()
        case "intersect":
            return left.intersectAll(right) if all_rows else left.intersect(right)
        case "except":
            return left.exceptAll(right) if all_rows else left.subtract(right)
    raise EngineError(f"no set operation {how!r}")


def over(function: Column, partition: Sequence[str], order: Sequence[SortKey] = (), rows: tuple[int, int] | None = None) -> Column:
    w = Window.partitionBy(*partition)
    if order:
        w = w.orderBy(*(k.order() for k in order))
    return function.over(w.rowsBetween(*rows) if rows else w)


def exchange(df: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows dealt to n partitions, by key where keys are given. Equal keys meet; no partitions is an error."""
    if n < 1:
        raise EngineError("an exchange needs a partition")
    return df.repartition(n, *map(F.col, keys)) if keys else df.repartition(n)


def bucket(n: int, *keys: Column) -> Column:
    """The partition of n that an exchange by these keys sends a row to."""
    return F.pmod(F.hash(*keys), F.lit(n))
