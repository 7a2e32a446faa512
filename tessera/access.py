"""Row filters and column masks, applied where a table is resolved."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tessera.context import SessionContext
from tessera.errors import MissingIdentity, UnknownColumn

Rule = Callable[[SessionContext], Column]


@dataclass(frozen=True)
class Mask:
    """A column is shown where ``shown`` holds, and ``value`` stands in for it elsewhere."""

    shown: Rule
    value: object = None


@dataclass(frozen=True)
class Policy:
    rows: tuple[Rule, ...] = ()
    masks: dict[str, Mask] = field(default_factory=dict)

    def apply(self, df: DataFrame, context: SessionContext | None) -> DataFrame:
        """``df`` as the context may see it. Filters see unmasked values."""
        if context is None:
            raise MissingIdentity("a table under a policy needs a session context")
        if unknown := set(self.masks) - set(df.columns):
            raise UnknownColumn(f"masked columns that the table lacks: {sorted(unknown)}")
        for rule in self.rows:
            df = df.filter(rule(context))
        shown = [
            F.when(m.shown(context), F.col(f"`{c}`")).otherwise(F.lit(m.value).cast(df.schema[c].dataType)).alias(c) if (m := self.masks.get(c)) else F.col(f"`{c}`")
            for c in df.columns
        ]
        return df.select(*shown) if self.masks else df
