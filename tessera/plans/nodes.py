"""The relational nodes of a plan in JSON, and their compilation.

``{"scan": table, "columns": [...]}``, ``{"filter": pred, "input": ...}``,
``{"project": {name: expr}, "input": ...}``, ``{"aggregate": {"by": [...],
"measures": [...], "grouping": "sets", "sets": [...]}, "input": ...}``,
``{"join": {...}, "left": ..., "right": ...}`` (without keys, its residual is
the whole condition), ``{"sort": [...], "limit": n, "offset": n, "input": ...}``,
``{"exchange": {"keys": [...], "partitions": n}, "input": ...}`` and
``{"set": "union", "left": ..., "right": ...}``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from tessera.context import SessionContext
from tessera.errors import EngineError
from tessera.operators.aggregates import Measure, aggregate
from tessera.operators.joins import join
from tessera.operators.sets import combine, exchange
from tessera.operators.sorting import SortKey, sort
from tessera.plans.expressions import expression
from tessera.sources.registry import Registry


def compile_plan(plan: dict | str, registry: Registry, context: SessionContext | None = None) -> DataFrame:
    node = json.loads(plan) if isinstance(plan, str) else plan
    again = lambda key: compile_plan(node[key], registry, context)
    match node:
        case {"scan": str(name)}:
            df = registry.table(name, context)
            return df.select(*node["columns"]) if "columns" in node else df
        case {"filter": pred, "input": _}:
            return again("input").filter(expression(pred, context))
        case {"project": dict(columns), "input": _}:
            return again("input").select(*(expression(e, context).alias(n) for n, e in columns.items()))
        case {"aggregate": dict(spec), "input": _}:
            measures = [
                Measure(
                    m["function"], expression(m["of"], context) if "of" in m else None, m.get("name"), expression(m["where"], context) if "where" in m else None,
                    m.get("distinct", False), expression(m["order"], context) if "order" in m else None, m.get("descending", False), m.get("share"),
                )
                for m in spec.get("measures", [])
            ]
            return aggregate(again("input"), spec.get("by", []), measures, spec.get("grouping", "plain"), spec.get("sets", ()))
        case {"join": dict(spec), "left": _, "right": _}:
            residual = expression(spec["residual"], context) if "residual" in spec else None
            return join(again("left"), again("right"), spec.get("left_keys", ()), spec.get("right_keys"), spec.get("kind", "inner"), residual)
        case {"sort": list(keys), "input": _}:
            return sort(again("input"), [SortKey(**k) if isinstance(k, dict) else SortKey(k) for k in keys], node.get("limit"), node.get("offset", 0))
        case {"exchange": dict(spec), "input": _}:
            return exchange(again("input"), spec["partitions"], spec.get("keys", ()))
        case {"set": str(how), "left": _, "right": _}:
            return combine(again("left"), again("right"), how, node.get("all", False))
    raise EngineError(f"no such node: {sorted(node) if isinstance(node, dict) else node!r}")
