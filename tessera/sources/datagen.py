"""Deterministic synthetic tables; any slice of rows is generated on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.sources.files import write_sorted

# Rows at scale 1, the first day, and the cycles and value lists of the columns
# below, which must give the same tables wherever they are generated.
LINEITEM_ROWS, ORDERS_ROWS = 6_000_000, 1_500_000
#: days from the epoch to the first ship and order date
FIRST_DAY = 8035


def _cycle(i: Column, values: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))


def _day(days: Column) -> Column:
    return F.date_from_unix_date(days.cast("int"))


def lineitem(spark: SparkSession, rows: int, offset: int = 0) -> DataFrame:
    i = F.col("id")
    ship = i % 2527 + FIRST_DAY
    commit = ship + i % 60 + 30
    return spark.range(offset, offset + rows).select(
        F.floor(i / 4).alias("l_orderkey"),
        (i % 200_000).alias("l_partkey"),
        (i % 10_000).alias("l_suppkey"),
        (i % 7 + 1).cast("int").alias("l_linenumber"),
        (i % 50 + 1).cast("double").alias("l_quantity"),
        ((i % 100_000) * F.lit(0.99) + 900).alias("l_extendedprice"),
        ((i % 11) * F.lit(0.01)).alias("l_discount"),
        ((i % 9) * F.lit(0.01)).alias("l_tax"),
        _cycle(i, ["A", "N", "R"]).alias("l_returnflag"),
        _cycle(i, ["F", "O"]).alias("l_linestatus"),
        _day(ship).alias("l_shipdate"),
        _day(commit).alias("l_commitdate"),
        _day(commit + i % 30 + 1).alias("l_receiptdate"),
    )


def orders(spark: SparkSession, rows: int, offset: int = 0) -> DataFrame:
    i = F.col("id")
    return spark.range(offset, offset + rows).select(
        i.alias("o_orderkey"),
        (i % 150_000).alias("o_custkey"),
        _cycle(i, ["F", "O", "P"]).alias("o_orderstatus"),
        (i * F.lit(2.5) + 100).alias("o_totalprice"),
        _cycle(i, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).alias("o_orderpriority"),
        _day(i % 2405 + FIRST_DAY).alias("o_orderdate"),
    )


def write_lineitem(spark: SparkSession, uri: str, rows: int, offset: int = 0) -> None:
    write_sorted(lineitem(spark, rows, offset), uri, ["l_discount", "l_quantity"], 8, "uncompressed")


def write_orders(spark: SparkSession, uri: str, rows: int, offset: int = 0) -> None:
    write_sorted(orders(spark, rows, offset), uri, ["o_orderdate"], 4, "uncompressed")
