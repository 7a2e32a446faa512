"""String functions with SQL meaning: characters, 1-based, null in null out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def like(c: Column, pattern: str, escape: str | None = None) -> Column:
    return F.like(c, F.lit(pattern), F.lit(escape)) if escape else c.like(pattern)


def ilike(c: Column, pattern: str) -> Column:
    return c.ilike(pattern)


def substring(c: Column, start: int, length: int | None = None) -> Column:
    """From the start-th character, counted from the end if negative."""
    return F.substring(c, start, length if length is not None else 2**31 - 1)


def concat(*parts: Column) -> Column:
    """Null if any part is null."""
    return F.concat(*parts)


def length(c: Column) -> Column:
    return F.length(c)


def octet_length(c: Column) -> Column:
    return F.octet_length(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def lower(c: Column) -> Column:
    return F.lower(c)


def starts_with(c: Column, prefix: str) -> Column:
    return c.startswith(prefix)


def ends_with(c: Column, suffix: str) -> Column:
    return c.endswith(suffix)


def contains(c: Column, part: str) -> Column:
    return c.contains(part)


def replace(c: Column, old: str, new: str) -> Column:
    """Every occurrence, taken literally."""
    return F.replace(c, F.lit(old), F.lit(new))


def regexp_replace(c: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(c, pattern, new)


def lpad(c: Column, n: int, fill: str = " ") -> Column:
    return F.lpad(c, n, fill)


def rpad(c: Column, n: int, fill: str = " ") -> Column:
    return F.rpad(c, n, fill)
