"""Models by name, and questions to them."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.errors import ModelError
from tessera.operators.sorting import SortKey, sort
from tessera.semantic.model import Dataset, Metric, Model, load

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Query:
    """Fields and metrics of a dataset; ``"*"`` is all fields, ``"metrics(*)"`` all metrics.

    Names of joined datasets are written ``dataset.field``. Fields group the metrics, if there are any.
    """

    model: str
    dataset: str
    select: tuple[str, ...]
    where: tuple[str, ...] = ()
    joins: tuple[str, ...] = ()
    order_by: tuple[SortKey, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class JoinOn:
    left: str
    left_field: str
    right: str
    right_field: str

    def sql(self) -> str:
        return f"{self.left}.{self.left_field} = {self.right}.{self.right_field}"


class Catalog:
    """Models of a folder and registered ones. ``tables`` turns a dataset's physical name into a DataFrame."""

    def __init__(self, spark: SparkSession, tables: Callable[[str], DataFrame] | None = None, folder: str | Path | None = None):
        self.spark, self.folder = spark, Path(folder) if folder else None
        self.tables = tables or spark.table
        self._models: dict[str, Model] = {}

    def register(self, model: Model) -> None:
        """A model of a known name takes its place."""
        self._models[model.name] = model.validate()

    def reload(self) -> list[str]:
        """Load the folder's models; a file that does not hold one is reported and passed over."""
        loaded = []
        for path in sorted(self.folder.iterdir()) if self.folder else []:
            if path.suffix in (".json", ".yaml", ".yml"):
                try:
                    model = load(path)
                except (ModelError, ValueError, OSError) as x:
                    log.warning("%s is passed over: %s", path.name, x)
                    continue
                self.register(model)
                loaded.append(model.name)
        return loaded

    def models(self) -> list[str]:
        return sorted(self._models)

    def model(self, name: str) -> Model:
        if name not in self._models:
            raise ModelError(f"no model {name!r}")
        return self._models[name]

    def datasets(self, model: str) -> list[str]:
        return sorted(d.name for d in self.model(model).datasets)

    def table_name(self, model: str, dataset: str) -> str:
        return self.model(model).dataset(dataset).table

    def metric(self, model: str, dataset: str, name: str) -> str:
        return self.model(model).dataset(dataset).metric(name).sql()

    def metrics(self, model: str, dataset: str) -> dict[str, str]:
        return {m.name: m.sql() for m in self.model(model).dataset(dataset).metrics}

    def join_on(self, model: str, left: str, right: str) -> JoinOn:
        """The relationship between two datasets, turned to the direction asked for."""
        for r in self.model(model).relationships:
            if (r.from_dataset, r.to_dataset) == (left, right):
                return JoinOn(left, r.from_field, right, r.to_field)
            if (r.to_dataset, r.from_dataset) == (left, right):
                return JoinOn(left, r.to_field, right, r.from_field)
        raise ModelError(f"no relationship between {left!r} and {right!r}")

    def describe(self, model: str, dataset: str) -> DataFrame:
        """name, type, is_metric, description, expression of fields and metrics, with the types that Spark gives."""
        d = self.model(model).dataset(dataset)
        frame = self._frame(d)
        types = dict(frame.dtypes)
        rows = [(f.name, types[f.name], False, f.description, f.expression or "") for f in d.fields]
        if d.metrics:
            measured = dict(frame.agg(*(F.expr(m.sql()).alias(m.name) for m in d.metrics)).dtypes)
            rows += [(m.name, measured[m.name], True, m.description, m.sql()) for m in d.metrics]
        return self.spark.createDataFrame(rows, "name string, type string, is_metric boolean, description string, expression string")

    def _frame(self, d: Dataset) -> DataFrame:
        """The dataset's fields, computed ones included."""
        return self.tables(d.table).select(*(F.expr(f.sql()).alias(f.name) for f in d.fields))

    def _expand(self, q: Query, d: Dataset) -> tuple[list[tuple[str, str]], list[Metric]]:
        """Selected fields as (reference, output name), and metrics."""
        fields: list[tuple[str, str]] = []
        metrics: list[Metric] = []
        for s in q.select:
            if s == "*":
                fields += [(f"{d.name}.{f.name}", f.name) for f in d.fields]
            elif s == "metrics(*)":
                metrics += d.metrics
            elif "." in s:
                other, name = s.split(".", 1)
                if other != d.name and other not in q.joins:
                    raise ModelError(f"{other!r} is not joined")
                self.model(q.model).dataset(other).field(name)
                fields.append((s, name if name not in {n for _, n in fields} else f"{other}_{name}"))
            elif s in {m.name for m in d.metrics}:
                metrics.append(d.metric(s))
            else:
                fields.append((f"{d.name}.{d.field(s).name}", s))
        return fields, metrics

    def _checked(self, q: Query) -> tuple[Model, Dataset, list[tuple[str, str]], list[Metric]]:
        model = self.model(q.model)
        d = model.dataset(q.dataset)
        if not q.select:
            raise ModelError("nothing is selected")
        for other in q.joins:
            model.dataset(other)
        return model, d, *self._expand(q, d)

    def query(self, q: Query) -> DataFrame:
        model, d, fields, metrics = self._checked(q)
        df = self._frame(d).alias(d.name)
        for other in q.joins:
            on = self.join_on(q.model, d.name, other)
            df = df.join(self._frame(model.dataset(other)).alias(other), F.expr(on.sql()))
        for condition in q.where:
            df = df.filter(F.expr(condition))
        shown = [F.col(ref).alias(name) for ref, name in fields]
        if metrics:
            # a metric's bare names are the main dataset's, whatever a joined one calls its own
            measures = [F.expr(_qualified(m.sql(), d)).alias(m.name) for m in metrics]
            df = df.groupBy(*shown).agg(*measures) if shown else df.agg(*measures)
        else:
            df = df.select(*shown)
        return sort(df, q.order_by, q.limit)

    def to_sql(self, q: Query) -> str:
        """The same question as SQL text over the physical tables."""
        model, d, fields, metrics = self._checked(q)
        table = lambda x: f"(SELECT {', '.join(f'{f.sql()} AS {f.name}' for f in x.fields)} FROM {x.table}) AS {x.name}"
        items = [f"{ref} AS {name}" for ref, name in fields] + [f"{_qualified(m.sql(), d)} AS {m.name}" for m in metrics]
        text = f"SELECT {', '.join(items)} FROM {table(d)}"
        for other in q.joins:
            text += f" JOIN {table(model.dataset(other))} ON {self.join_on(q.model, d.name, other).sql()}"
        if q.where:
            text += " WHERE " + " AND ".join(f"({c})" for c in q.where)
        if metrics and fields:
            text += " GROUP BY " + ", ".join(ref for ref, _ in fields)
        if q.order_by:
            text += " ORDER BY " + ", ".join(f"{k.column} {'DESC' if k.descending else 'ASC'} NULLS {'FIRST' if k.nulls_first else 'LAST'}" for k in q.order_by)
        return text if q.limit is None else f"{text} LIMIT {q.limit}"

    def expand_sql(self, model: str, dataset: str, text: str) -> str:
        """SQL text with ``METRIC(name)`` outside string literals replaced by the metric's expression."""
        return re.sub(r"'(?:[^']|'')*'|\bMETRIC\(\s*(\w+)\s*\)", lambda m: self.metric(model, dataset, m[1]) if m[1] else m[0], text, flags=re.I)


def _qualified(sql: str, d: Dataset) -> str:
    """Field names outside string literals, with their dataset."""
    names = {f.name for f in d.fields}

    def word(m: re.Match) -> str:
        return m[0] if m[0].startswith("'") or m[0] not in names else f"{d.name}.{m[0]}"

    return re.sub(r"'(?:[^']|'')*'|(?<![.\w])[A-Za-z_]\w*(?![\w(.])", word, sql)


def ask(catalog: Catalog, model: str, dataset: str, select: Sequence[str], **options) -> DataFrame:
    return catalog.query(Query(model, dataset, tuple(select), **{k: tuple(v) if isinstance(v, list) else v for k, v in options.items()}))
