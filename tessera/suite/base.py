"""How a query of the suite is written down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: schemas by path and time of writing, so that footers are read once and not for every query
_schemas: dict[tuple[str, str, int], StructType] = {}


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        written = target.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(target).getModificationTime()
        key = (context.applicationId, path, written)
        if key not in _schemas:
            _schemas[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_schemas[key]).parquet(path)


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function of Tables as a query; ``sql`` is its oracle."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[key] = sql
        return f

    return keep


def cents(c: Column, digits: int = 4) -> Column:
    """A float total to the digits that its inputs have, so that the order of addition cannot show."""
    return F.round(c, digits)


def total(c: Column | str, name: str, digits: int = 4) -> Column:
    return cents(F.sum(c), digits).alias(name)


def mean(c: Column | str, name: str, digits: int = 6) -> Column:
    return F.round(F.avg(c), digits).alias(name)


def rows(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)
