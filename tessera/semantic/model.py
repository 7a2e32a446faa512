"""The semantic model as data, and its validation."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from tessera.errors import ModelError

# The types that a field may declare.
TYPES = frozenset("integer bigint smallint tinyint boolean varchar string double real float decimal date timestamp".split())
# Aggregate words and the SQL around their argument.
AGGREGATES = {"sum": "SUM({})", "count": "COUNT({})", "avg": "AVG({})", "min": "MIN({})", "max": "MAX({})", "count_distinct": "COUNT(DISTINCT {})"}
_NAME = re.compile(r"[A-Za-z_]\w*")


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "varchar"
    description: str = ""
    primary_key: bool = False
    expression: str | None = None
    tags: tuple[str, ...] = ()

    def sql(self) -> str:
        return self.expression or self.name


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: str

    def sql(self) -> str:
        return f"{self.field} {self.operator} {self.value}"


@dataclass(frozen=True)
class Metric:
    name: str
    expression: str = ""
    aggregate: str = ""
    field: str | None = None
    filters: tuple[Filter, ...] = ()
    description: str = ""

    def sql(self) -> str:
        """The metric as an aggregate expression; filters narrow its argument, so it stands beside others in one query."""
        word = self.aggregate.lower()
        argument = self._argument()
        if word not in AGGREGATES or argument is None:
            if not self.expression:
                raise ModelError(f"metric {self.name!r} has no expression and no known aggregate")
            if self.filters:
                raise ModelError(f"metric {self.name!r} filters an expression that is not one aggregate")
            return self.expression
        if self.filters:
            conditions = " AND ".join(f"({f.sql()})" for f in self.filters)
            argument = f"CASE WHEN {conditions} THEN {argument} END"
        return AGGREGATES[word].format(argument)

    def _argument(self) -> str | None:
        """What is aggregated: the expression's own argument if it is one aggregate, else the field."""
        m = re.fullmatch(r"\s*(\w+)\s*\(\s*(distinct\s)?(.*)\)\s*", self.expression, re.I | re.S)
        if m and _balanced(m[3]):
            word = "count_distinct" if m[2] and m[1].lower() == "count" else m[1].lower()
            return ("1" if m[3].strip() == "*" else m[3].strip()) if word == self.aggregate.lower() else None
        return None if self.expression else self.field


def _balanced(text: str) -> bool:
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return depth == 0


@dataclass(frozen=True)
class Dataset:
    name: str
    table: str
    fields: tuple[Field, ...]
    metrics: tuple[Metric, ...] = ()
    description: str = ""

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise ModelError(f"{self.name} has no field {name!r}")

    def metric(self, name: str) -> Metric:
        for m in self.metrics:
            if m.name == name:
                return m
        raise ModelError(f"{self.name} has no metric {name!r}")


@dataclass(frozen=True)
class Relationship:
    name: str
    from_dataset: str
    from_field: str
    to_dataset: str
    to_field: str
    type: str = "many_to_one"


@dataclass(frozen=True)
class Model:
    name: str
    datasets: tuple[Dataset, ...]
    relationships: tuple[Relationship, ...] = ()
    description: str = ""
    version: str = "0.1.1"

    def dataset(self, name: str) -> Dataset:
        for d in self.datasets:
            if d.name == name:
                return d
        raise ModelError(f"{self.name} has no dataset {name!r}")

    def validate(self) -> Model:
        seen: set[str] = set()
        for d in self.datasets:
            if d.name in seen:
                raise ModelError(f"dataset {d.name!r} twice")
            seen.add(d.name)
            names = [f.name for f in d.fields]
            for n in [*names, *(m.name for m in d.metrics)]:
                if not _NAME.fullmatch(n):
                    raise ModelError(f"{d.name}: {n!r} is no name")
            if len(set(names)) < len(names):
                raise ModelError(f"{d.name}: a field name twice")
            for f in d.fields:
                if re.sub(r"\(.*\)$", "", f.type.lower()).strip() not in TYPES:
                    raise ModelError(f"{d.name}.{f.name}: no type {f.type!r}")
            for m in d.metrics:
                if m.field is not None:
                    d.field(m.field)
                for x in m.filters:
                    d.field(x.field)
                m.sql()
        for r in self.relationships:
            self.dataset(r.from_dataset).field(r.from_field)
            self.dataset(r.to_dataset).field(r.to_field)
        return self


def _dataset(d: dict) -> Dataset:
    source = d.get("source") or {}
    table = source if isinstance(source, str) else ".".join(source[k] for k in ("catalog", "schema", "table") if source.get(k))
    fields = tuple(Field(f["name"], f.get("type", "varchar"), f.get("description", ""), bool(f.get("primary_key")), f.get("expression"), tuple(f.get("tags", ()))) for f in d.get("fields", ()))
    metrics = tuple(Metric(m["name"], m.get("expression", ""), m.get("aggregate", ""), m.get("field"), tuple(Filter(x["field"], x["operator"], str(x["value"])) for x in m.get("filters", ())), m.get("description", "")) for m in d.get("metrics", ()))
    return Dataset(d["name"], table, fields, metrics, d.get("description", ""))


def parse(data: dict) -> Model:
    try:
        links = tuple(Relationship(r["name"], r["from"]["dataset"], r["from"]["field"], r["to"]["dataset"], r["to"]["field"], r.get("relationship_type", r.get("type", "many_to_one"))) for r in data.get("relationships", ()))
        model = Model(data["name"], tuple(map(_dataset, data.get("datasets", ()))), links, data.get("description", ""), str(data.get("version", "0.1.1")))
    except (KeyError, TypeError, AttributeError) as x:
        raise ModelError(f"not a model: {x!r}") from x
    return model.validate()


def load(path: str | Path) -> Model:
    """A model from a .json, .yaml or .yml file."""
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return parse(json.loads(text))
    import yaml

    return parse(yaml.safe_load(text))
