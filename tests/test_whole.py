"""Queries that must read their tables whole: no id of an input may be left out."""

from __future__ import annotations

from pathlib import Path

import pytest

from tessera.suite import base, orders  # noqa: F401

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


def test_arithmetic_of_every_line(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert lines.filter("l_orderkey > 500").count() > 0
    got = base.QUERIES["project_arithmetic"](spark, SF)
    assert got.select("l_orderkey", "l_linenumber").exceptAll(lines.select("l_orderkey", "l_linenumber")).isEmpty()
    assert got.count() == lines.count() and got.filter("per IS NULL").count() == lines.filter("l_discount = 0").count()


def test_joins_of_every_order_and_customer(spark):
    run = lambda name: base.QUERIES[name](spark, SF)
    orders_ = {r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()}
    customers = {r[0] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()}
    sides = {k: run(f"join_{k}").select("o_orderkey", "c_custkey").collect() for k in ("inner", "left", "right", "full")}
    left, right = ({k: {r[i] for r in rows} - {None} for k, rows in sides.items()} for i in (0, 1))
    assert left["inner"] == left["left"] == left["full"] == orders_
    assert right["inner"] == right["right"] == right["full"] == customers
    some, none = ({r["c_custkey"] for r in run(f"join_{k}").collect()} for k in ("semi", "anti"))
    assert some | none == customers and some and none and not some & none
    assert any(r[1] is None for r in sides["left"]) and any(r[0] is None for r in sides["right"])


def test_column_comparison_of_every_order(spark):
    table = spark.read.parquet(f"{SF}/orders.parquet").select("o_totalprice", "o_custkey").collect()
    assert base.QUERIES["filter_columns"](spark, SF).collect()[0]["n"] == sum(r[0] > r[1] * 10 for r in table)
