"""The identity a query runs under, and the functions that read it.

Identity functions become literals, so Catalyst folds policies away before
execution. Without a context they raise: a missing identity must not let rows
or columns through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from tessera.errors import MissingIdentity


@dataclass(frozen=True)
class SessionContext:
    user: str
    groups: frozenset[str] = frozenset()
    roles: tuple[str, ...] = ()
    catalog: str | None = None
    schema: str | None = None
    credentials: dict[str, str] = field(default_factory=dict, repr=False, hash=False, compare=False)


def _need(context: SessionContext | None) -> SessionContext:
    if context is None:
        raise MissingIdentity("this needs a session context")
    return context


def current_user(context: SessionContext | None) -> Column:
    return F.lit(_need(context).user)


def current_role(context: SessionContext | None) -> Column:
    """The first role, null without any."""
    roles = _need(context).roles
    return F.lit(roles[0]) if roles else F.lit(None).cast("string")


def current_catalog(context: SessionContext | None) -> Column:
    return F.lit(_need(context).catalog).cast("string")


def current_schema(context: SessionContext | None) -> Column:
    return F.lit(_need(context).schema).cast("string")


def is_member_of(context: SessionContext | None, group: str) -> Column:
    return F.lit(group in _need(context).groups)
