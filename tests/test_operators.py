"""Operators on literal rows: nulls, empty sides, ties and errors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.operators.aggregates import Measure, aggregate, salted_sum
from tessera.operators.joins import join, salted_join
from tessera.operators.sets import combine, exchange
from tessera.operators.sorting import SortKey, sort


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Ann", 10), (2, "Bob", 20), (3, "Cid", 10), (4, "Dee", None), (5, "Eve", 40)], "emp_id int, name string, dept int")


@pytest.fixture(scope="module")
def depts(spark):
    return spark.createDataFrame([(10, "A"), (20, "B"), (30, "C"), (None, "N")], "dept int, name string")


def ids(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize(
    ("kind", "count"), [("inner", 3), ("left", 5), ("right", 5), ("full", 7), ("semi", 3), ("anti", 2)]
)
def test_join_kinds(people, depts, kind, count):
    assert join(people, depts, ["dept"], kind=kind).count() == count


def test_left_join_fills_with_nulls(people, depts):
    got = {r["emp_id"]: r["name_right"] for r in join(people, depts, ["dept"], kind="left").collect()}
    assert got == {1: "A", 2: "B", 3: "A", 4: None, 5: None}


def test_null_keys_match_only_on_request(people, depts):
    assert join(people, depts, ["dept"], null_safe=True).count() == 4


def test_joins_with_an_empty_side(people, depts):
    none = depts.filter("false")
    assert join(people, none, ["dept"], kind="left").count() == 5
    assert join(people, none, ["dept"], kind="anti").count() == 5
    assert join(people, none, ["dept"], kind="full").count() == 5
    assert join(people, none, ["dept"]).count() == 0


def test_residual_is_kept(people, depts):
    assert ids(join(people, depts, ["dept"], residual=F.col("emp_id") > 1), "emp_id") == [(2,), (3,)]


@pytest.mark.parametrize("kind", ["inner", "left", "semi", "anti"])
def test_salting_changes_nothing(spark, kind):
    large = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "x"), (1, "y"), (1, "z"), (9, "w")], "k long, s string")
    want = large.join(small, "k", {"semi": "left_semi", "anti": "left_anti"}.get(kind, kind))
    got = salted_join(large, small, ["k"], 8, kind)
    assert ids(got, *sorted(got.columns)) == ids(want, *sorted(want.columns))


def test_bad_join(people, depts):
    with pytest.raises(EngineError):
        join(people, depts, ["dept"], ["dept", "name"])


def test_grouped_aggregates_skip_nulls_and_null_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), (0, 2.0), (0, None), (1, None)], "k int, v double")
    out = aggregate(df, ["k"], [Measure("count", "v", "n"), Measure("sum", "v", "s"), Measure("avg", "v", "a"), Measure("min", "v", "lo"), Measure("count", None, "all")])
    assert ids(out, "k", "n", "s", "a", "lo", "all") == sorted([(None, 1, 1.0, 1.0, 1.0, 2), (0, 1, 2.0, 2.0, 2.0, 2), (1, 0, None, None, None, 1)], key=repr)


def test_global_aggregate_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert aggregate(df, [], [Measure("count", "v", "n"), Measure("sum", "v", "s")]).collect() == [(0, None)]


def test_large_integers_stay_distinct(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,), (2**53,), (None,)], "id long")
    assert aggregate(df, [], [Measure("count_distinct", "id", "n")]).first()["n"] == 2


def test_distinct_and_filtered_measures(spark):
    df = spark.createDataFrame([(1,), (1,), (3,), (None,)], "v int")
    out = aggregate(df, [], [Measure("sum", "v", "s", distinct=True), Measure("count", None, "big", where=F.col("v") > 1), Measure("avg", "v", "a", distinct=True)])
    assert tuple(out.first()) == (4, 1, 2.0)


def test_salted_sum(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    assert ids(salted_sum(df, ["k"], F.col("v"), "s"), "k", "s") == [(0, 2450), (1, 2500)]


def test_unknown_aggregate(spark):
    for bad in (Measure("median_of_medians", "id"), Measure("list", "id"), Measure("percentile", "id")):
        with pytest.raises(EngineError):
            aggregate(spark.range(1), [], [bad])


def test_ordered_measures(spark):
    df = spark.createDataFrame([("a", 2, 20), ("a", 1, None), ("a", 2, 30), ("a", None, 5), ("b", None, 7)], "k string, o int, v int")
    out = aggregate(df, ["k"], [Measure("first", "v", "f", order="o"), Measure("last", "v", "l", order="o"), Measure("first", "v", "fd", order="o", descending=True), Measure("list", "v", "all", order="o"), Measure("list", "v", "big", where=F.col("v") > 5, order="o", descending=True)])
    assert ids(out, "k", "f", "l", "fd", "all", "big") == [("a", None, 30, 30, [5, None, 20, 30], [30, 20]), ("b", None, None, None, [7], [7])]
    assert aggregate(df.filter("false"), [], [Measure("list", "v", "all", order="o"), Measure("last", "v", "l", order="o")]).collect() == [([], None)]


def test_percentiles(spark):
    df = spark.range(1, 12).select(F.col("id").cast("double").alias("v"))
    out = aggregate(df, [], [Measure("percentile", "v", "p", share=0.25), Measure("approx_percentile", "v", "a", share=0.5)])
    assert tuple(out.first()) == (3.5, 6.0)


def test_grouping_sets(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 2)], "k string, n int")
    out = aggregate(df, ["k", "n"], [Measure("count", None, "c"), Measure("grouping", "k", "g")], "sets", [["k"], ["n"]])
    assert ids(out, "k", "n", "c", "g") == sorted([("a", None, 2, 0), (None, None, 1, 0), (None, 1, 1, 1), (None, 2, 2, 1)], key=repr)
    for sets in ([], [["other"]]):
        with pytest.raises(EngineError):
            aggregate(df, ["k", "n"], [Measure("count", None, "c")], "sets", sets)


def test_sort_nulls_ties_and_pages(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("a", 1)], "s string, n int")
    first = [tuple(r) for r in sort(df, [SortKey("s", nulls_first=True), SortKey("n", True)]).collect()]
    assert first == [(None, 2), ("a", 3), ("a", 1), ("b", 1)]
    assert [r["n"] for r in sort(df, [SortKey("s"), SortKey("n")], 2, 1).collect()] == [3, 1]
    assert sort(df, [], 2).count() == 2
    with pytest.raises(EngineError):
        sort(df, [], -1)


def test_top_n_keeps_few_rows_a_partition(spark):
    plan = sort(spark.range(1000), [SortKey("id", True)], 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_sets(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    assert combine(a, b, "union").count() == 3 and combine(a, b, "union", True).count() == 5
    assert ids(combine(a, b, "intersect"), "k") == [(1,)] and combine(a, b, "except", True).count() == 2


def test_exchange_puts_equal_keys_together(spark):
    df = exchange(spark.range(100).withColumn("k", F.col("id") % 7), 4, ["k"])
    assert df.rdd.getNumPartitions() == 4
    assert df.select("k", F.spark_partition_id().alias("p")).distinct().count() == 7
    with pytest.raises(EngineError):
        exchange(df, 0)
