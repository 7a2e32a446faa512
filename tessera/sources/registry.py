"""Named tables: where they are, and who may see what of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessera.access import Policy
from tessera.context import SessionContext
from tessera.errors import EngineError, UnknownTable
from tessera.sources.files import scan


@dataclass(frozen=True)
class TableSpec:
    """A table by its places, or by a key under the registry's root or among its pushed tables."""

    uris: tuple[str, ...] = ()
    store_key: str | None = None

    @classmethod
    def parse(cls, value: object) -> TableSpec:
        if not isinstance(value, dict) or not isinstance(value.get("uris", []), list):
            raise EngineError("a table is given as {'uris': [...], 'store_key': ...}")
        if extra := set(value) - {"uris", "store_key"}:
            raise EngineError(f"a table has no {sorted(extra)}")
        return cls(tuple(value.get("uris", [])), value.get("store_key"))


class Registry:
    """Tables by name. Places come first, then the root folder, then pushed tables, then the session's catalog."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root
        self.specs: dict[str, TableSpec] = {}
        self.pushed: dict[str, DataFrame] = {}
        self.policies: dict[str, Policy] = {}

    def register(self, name: str, spec: TableSpec | dict) -> None:
        self.specs[name] = spec if isinstance(spec, TableSpec) else TableSpec.parse(spec)

    def push(self, key: str, df: DataFrame) -> None:
        self.pushed[key] = df

    def drop(self, key: str) -> None:
        self.pushed.pop(key, None)

    def protect(self, name: str, policy: Policy) -> None:
        self.policies[name] = policy

    def _raw(self, name: str) -> DataFrame:
        spec = self.specs.get(name)
        if spec and spec.uris:
            return scan(self.spark, spec.uris)
        key = spec.store_key if spec and spec.store_key else name
        if spec and self.root and spec.store_key:
            return scan(self.spark, f"{self.root.rstrip('/')}/{key}")
        if key in self.pushed:
            return self.pushed[key]
        if self.spark.catalog.tableExists(key):
            return self.spark.table(key)
        raise UnknownTable(name)

    def table(self, name: str, context: SessionContext | None = None) -> DataFrame:
        df = self._raw(name)
        policy = self.policies.get(name)
        return policy.apply(df, context) if policy else df

    def names(self) -> list[str]:
        return sorted({*self.specs, *self.pushed, *(t.name for t in self.spark.catalog.listTables())})

    def columns(self, name: str) -> list[tuple[str, str]]:
        return self._raw(name).dtypes

    def sql(self, text: str, context: SessionContext | None = None) -> DataFrame:
        """SQL over the registered tables, each as the context sees it."""
        for name in {*self.specs, *self.pushed}:
            self.table(name, context).createOrReplaceTempView(name)
        return self.spark.sql(text)
