"""Arithmetic where SQL engines differ."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def divide(a: Column, b: Column) -> Column:
    """Null where the divisor is zero."""
    return F.try_divide(a, b)


def day_number(n: Column) -> Column:
    """The date of a count of days since the epoch."""
    return F.date_from_unix_date(n)
