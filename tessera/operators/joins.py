"""Joins of every kind, with a rule for equal column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessera.errors import EngineError

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
#: bytes up to which a build side, by its planner statistics, is sent to every executor; these
#: are of compressed files, and a hash table of their rows can be some ten times as large
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's output."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES, size_of: DataFrame | None = None) -> DataFrame:
    """A broadcast hint only below the limit; beyond it the planner shuffles or splits skew.

    ``size_of`` is what to measure where ``df`` has no more and no wider rows than it: the
    planner takes a join for the product of its sides.
    """
    return F.broadcast(df) if estimated_bytes(df if size_of is None else size_of) <= limit else df


def join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str] | None = None, kind: str = "inner", residual: Column | None = None, suffix: str = "_right", null_safe: bool = False) -> DataFrame:
    """Join on pairs of keys. Right columns whose names the left has get ``suffix``; null keys match only if ``null_safe``.

    Semi and anti joins give the left columns alone. ``residual`` is a further condition over the renamed columns;
    without keys it is the whole condition (a theta or range join, which compares all rows of both sides).
    """
    right_keys = list(right_keys or left_keys)
    if kind not in KINDS or len(left_keys) != len(right_keys) or (not left_keys and residual is None):
        raise EngineError(f"cannot join {list(left_keys)} with {right_keys} as {kind!r}")
    taken = set(left.columns)
    names = {c: c + suffix if c in taken else c for c in right.columns}
    right = right.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    condition = F.lit(True)
    for a, b in zip(left_keys, right_keys, strict=True):
        x, y = left[a], right[names[b]]
        condition = condition & (x.eqNullSafe(y) if null_safe else x == y)
    if residual is not None:
        condition = condition & residual
    return left.join(right, condition, KINDS[kind])


def salted_join(large: DataFrame, small: DataFrame, keys: Sequence[str], salts: int = 16, kind: str = "inner") -> DataFrame:
    """Join a side with hot keys to one with few rows per key: the large side spreads each key, the small one repeats.

    For inner, left and semi joins, where a large row's matches all carry its salt.
    """
    if kind not in ("inner", "left", "semi", "anti"):
        raise EngineError(f"salting cannot serve a {kind} join")
    spread = large.withColumn("__salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in large.columns)), F.lit(salts)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "__salt"], KINDS[kind]).drop("__salt")
