"""Sorts with explicit null placement, top-n, and pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tessera.errors import EngineError


@dataclass(frozen=True)
class SortKey:
    column: str
    descending: bool = False
    nulls_first: bool = False

    def order(self) -> Column:
        c = F.col(self.column)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


def sort(df: DataFrame, keys: Sequence[SortKey], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sorted rows; with a limit Spark keeps the best rows of each partition only. No keys leave the order open."""
    if (limit is not None and limit < 0) or offset < 0:
        raise EngineError("limit and offset cannot be negative")
    out = df.orderBy(*(k.order() for k in keys)) if keys else df
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)
