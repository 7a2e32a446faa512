"""Expressions as nested lists: ``["op", ...]``, with columns by name.

``["col", name]``, ``["lit", value]``, ``["date", "1998-09-02"]``, comparison,
logic, arithmetic, ``["case", [cond, value], ..., default]``, string and
session functions. Unknown operators raise.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator as op
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tessera import context as ctx
from tessera.errors import EngineError
from tessera.functions import numbers, strings

_BINARY: dict[str, Callable] = {
    "=": op.eq, "<>": op.ne, "<": op.lt, "<=": op.le, ">": op.gt, ">=": op.ge,
    "+": op.add, "-": op.sub, "*": op.mul, "/": numbers.divide,
}
_TEXT: dict[str, Callable] = {
    "like": strings.like, "ilike": strings.ilike, "starts_with": strings.starts_with, "ends_with": strings.ends_with, "contains": strings.contains,
    "substring": strings.substring, "replace": strings.replace, "regexp_replace": strings.regexp_replace, "lpad": strings.lpad, "rpad": strings.rpad,
}
_SIMPLE: dict[str, Callable] = {"upper": F.upper, "lower": F.lower, "length": F.length, "octet_length": F.octet_length, "concat": F.concat, "coalesce": F.coalesce, "nullif": F.nullif}
_SESSION: dict[str, Callable] = {"current_user": ctx.current_user, "current_role": ctx.current_role, "current_catalog": ctx.current_catalog, "current_schema": ctx.current_schema}


def expression(e: object, context: ctx.SessionContext | None = None) -> Column:
    if not isinstance(e, list):
        return F.lit(e)
    if not e or not isinstance(e[0], str):
        raise EngineError(f"not an expression: {e!r}")
    name, *args = e
    sub = lambda x: expression(x, context)
    try:
        if name == "col":
            return F.col(args[0])
        if name == "lit":
            return F.lit(args[0])
        if name == "date":
            return F.lit(dt.date.fromisoformat(args[0]))
        if name == "day":
            return numbers.day_number(F.lit(args[0]))
        if name in ("and", "or"):
            return functools.reduce(op.and_ if name == "and" else op.or_, map(sub, args))
        if name == "not":
            return ~sub(args[0])
        if name == "neg":
            return -sub(args[0])
        if name == "is_null":
            return sub(args[0]).isNull()
        if name == "is_not_null":
            return sub(args[0]).isNotNull()
        if name == "between":
            return sub(args[0]).between(sub(args[1]), sub(args[2]))
        if name == "in":
            return sub(args[0]).isin(*args[1:])
        if name == "cast":
            return sub(args[0]).cast(args[1])
        if name == "case":
            *branches, default = args
            out = F
            for cond, value in branches:
                out = out.when(sub(cond), sub(value))
            return out.otherwise(sub(default))
        if name == "is_member_of":
            return ctx.is_member_of(context, args[0])
        if name in _BINARY and len(args) == 2:
            return _BINARY[name](sub(args[0]), sub(args[1]))
        if name in _TEXT:
            return _TEXT[name](sub(args[0]), *args[1:])
        if name in _SIMPLE:
            return _SIMPLE[name](*map(sub, args))
        if name in _SESSION:
            return _SESSION[name](context)
    except (IndexError, TypeError, ValueError) as x:
        if isinstance(x, EngineError):
            raise
        raise EngineError(f"bad arguments: {e!r}") from x
    raise EngineError(f"no function {name!r}")
