"""Aggregates by name, over any grouping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tessera.errors import EngineError


@dataclass(frozen=True)
class Measure:
    """An aggregate: its function, argument (none counts rows), name, and a condition on the rows it takes.

    ``order`` is what ``first``, ``last`` and ``list`` go by. ``share`` is the percentile asked for, from 0 to 1.
    """

    function: str
    argument: Column | str | None = None
    name: str | None = None
    where: Column | None = None
    distinct: bool = False
    order: Column | str | None = None
    descending: bool = False
    share: float | None = None


def ordered(m: Measure, arg: Column) -> Column:
    """An aggregate by order; equal orders go by value. Rows without an order count for ``list`` only, as the smallest.

    ``first`` and ``last`` hold one row a group. ``list`` holds a group's values in one row, as its result is one.
    """
    by = F.col(m.order) if isinstance(m.order, str) else m.order
    takes = F.lit(True) if m.where is None else m.where
    if m.function == "list":
        values = F.sort_array(F.collect_list(F.when(takes, F.struct(by.alias("by"), arg.alias("value")))), not m.descending)
        return F.transform(values, lambda x: x["value"])
    best = F.max_by if (m.function == "last") != m.descending else F.min_by
    return best(arg, F.when(takes & by.isNotNull(), F.struct(by, arg)))


def measure(m: Measure) -> Column:
    arg = F.col(m.argument) if isinstance(m.argument, str) else m.argument
    if m.function in ("first", "last", "list") and arg is not None and m.order is not None and not m.distinct:
        out = ordered(m, arg)
        return out.alias(m.name) if m.name else out
    if m.where is not None:
        arg = F.when(m.where, F.lit(1) if arg is None else arg)
    match m.function, m.distinct:
        case "count", False:
            out = F.count(F.lit(1) if arg is None else arg)
        case ("count", True) | ("count_distinct", _) if arg is not None:
            out = F.count_distinct(arg)
        case "sum", False if arg is not None:
            out = F.sum(arg)
        case "sum", True if arg is not None:
            out = F.sum_distinct(arg)
        case "avg", False if arg is not None:
            out = F.avg(arg)
        case "avg", True if arg is not None:
            out = F.try_divide(F.sum_distinct(arg), F.count_distinct(arg))
        case "min", _ if arg is not None:
            out = F.min(arg)
        case "max", _ if arg is not None:
            out = F.max(arg)
        case ("stddev" | "stddev_pop" | "variance" | "var_pop" | "median" | "approx_count_distinct"), False if arg is not None:
            out = SPREAD[m.function](arg)
        case ("percentile" | "approx_percentile"), False if arg is not None and m.share is not None:
            out = (F.percentile if m.function == "percentile" else F.percentile_approx)(arg, m.share)
        case "grouping", False if arg is not None and m.where is None:
            out = F.grouping(arg)
        case _:
            raise EngineError(f"no aggregate {m.function!r} of {m.argument!r}")
    return out.alias(m.name) if m.name else out


#: sample deviation and variance, those of a population, the interpolated median, and a sketch's count
SPREAD = {"stddev": F.stddev_samp, "stddev_pop": F.stddev_pop, "variance": F.var_samp, "var_pop": F.var_pop, "median": F.median, "approx_count_distinct": F.approx_count_distinct}


def aggregate(df: DataFrame, keys: Sequence[str | Column], measures: Sequence[Measure], grouping: str = "plain", sets: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Group by ``keys`` plainly, by rollup, by cube or by ``sets`` of keys; no keys give one row, also over no rows."""
    columns = [measure(m) for m in measures]
    if grouping == "sets":
        if not sets or not columns or any(k not in keys for s in sets for k in s):
            raise EngineError("grouping sets are lists of keys, and need a measure")
        return df.groupingSets([list(s) for s in sets], *keys).agg(*columns)
    if not keys:
        return df.agg(*columns)
    if not columns:
        return df.select(*keys).distinct()
    by = {"plain": df.groupBy, "rollup": df.rollup, "cube": df.cube}.get(grouping)
    if by is None:
        raise EngineError(f"no grouping {grouping!r}")
    return by(*keys).agg(*columns)


def salted_sum(df: DataFrame, keys: Sequence[str], value: Column, name: str, salts: int = 32) -> DataFrame:
    """A sum in two steps for keys so hot that one reducer's partial rows are too many."""
    part = df.withColumn("__salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(salts)))
    return part.groupBy(*keys, "__salt").agg(F.sum(value).alias("__part")).groupBy(*keys).agg(F.sum("__part").alias(name))
