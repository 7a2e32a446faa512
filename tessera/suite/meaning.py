"""Semantic-layer, policy, plan and source queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructType

from tessera.access import Mask, Policy
from tessera.context import SessionContext, current_catalog, current_role, current_schema, current_user, is_member_of
from tessera.operators.sorting import SortKey
from tessera.plans.nodes import compile_plan
from tessera.semantic.catalog import Catalog, ask
from tessera.semantic.model import parse
from tessera.sources import datagen
from tessera.sources.files import adapt
from tessera.sources.registry import Registry
from tessera.suite.base import Tables, query

ALICE = SessionContext("alice", frozenset({"finance", "pii"}), ("analyst", "viewer"), "main", "sales")

MODEL = {
    "name": "shop",
    "datasets": [
        {
            "name": "orders",
            "source": {"table": "orders"},
            "fields": [
                {"name": "o_orderkey", "type": "bigint", "primary_key": True},
                {"name": "o_custkey", "type": "bigint"},
                {"name": "o_totalprice", "type": "double"},
                {"name": "o_orderstatus", "type": "varchar"},
                {"name": "order_year", "type": "integer", "expression": "year(o_orderdate)"},
            ],
            "metrics": [
                {"name": "revenue", "expression": "ROUND(SUM(o_totalprice), 4)"},
                {"name": "order_count", "expression": "COUNT(o_orderkey)", "aggregate": "count", "field": "o_orderkey"},
                {"name": "largest", "aggregate": "max", "field": "o_totalprice"},
                {"name": "finished", "expression": "COUNT(o_orderkey)", "aggregate": "count", "field": "o_orderkey", "filters": [{"field": "o_orderstatus", "operator": "=", "value": "'F'"}]},
            ],
        },
        {
            "name": "customers",
            "source": {"table": "customer"},
            "fields": [{"name": "c_custkey", "type": "bigint", "primary_key": True}, {"name": "c_mktsegment", "type": "varchar"}, {"name": "c_acctbal", "type": "double"}],
            "metrics": [{"name": "customer_count", "expression": "COUNT(DISTINCT c_custkey)", "aggregate": "count_distinct", "field": "c_custkey"}],
        },
        {
            "name": "parts",
            "source": {"table": "part"},
            "fields": [{"name": "p_partkey", "type": "bigint"}, {"name": "p_brand", "type": "varchar"}, {"name": "p_size", "type": "integer"}, {"name": "p_retailprice", "type": "double"}],
            "metrics": [{"name": "avg_margin", "expression": "AVG(p_retailprice - p_size)", "aggregate": "avg", "field": "p_retailprice"}],
        },
    ],
    "relationships": [{"name": "order_customer", "from": {"dataset": "orders", "field": "o_custkey"}, "to": {"dataset": "customers", "field": "c_custkey"}}],
}


def catalog(t: Tables) -> Catalog:
    out = Catalog(t.spark, lambda name: getattr(t, name))
    out.register(parse(MODEL))
    return out


@query("SELECT o_orderstatus, round(sum(o_totalprice), 4) AS revenue FROM orders GROUP BY 1")
def osi_simple(t: Tables) -> DataFrame:
    return ask(catalog(t), "shop", "orders", ["o_orderstatus", "revenue"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def osi_where_limit(t: Tables) -> DataFrame:
    return ask(catalog(t), "shop", "orders", ["o_orderkey", "o_totalprice"], where=["o_orderstatus = 'F' OR o_orderstatus = 'P'", "o_totalprice > 1000"], order_by=[SortKey("o_totalprice", True), SortKey("o_orderkey")], limit=25)


@query("SELECT c_mktsegment, round(sum(o_totalprice), 4) AS revenue, count(o_orderkey) AS order_count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def osi_join(t: Tables) -> DataFrame:
    return ask(catalog(t), "shop", "orders", ["customers.c_mktsegment", "revenue", "order_count"], joins=["customers"])


@query("SELECT o_orderstatus, count(DISTINCT c_custkey) AS customer_count FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def osi_join_reverse(t: Tables) -> DataFrame:
    return ask(catalog(t), "shop", "customers", ["orders.o_orderstatus", "customer_count"], joins=["orders"])


@query("SELECT round(sum(o_totalprice), 4) AS revenue, count(o_orderkey) AS order_count, max(o_totalprice) AS largest, count(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS finished FROM orders")
def osi_all_metrics(t: Tables) -> DataFrame:
    return ask(catalog(t), "shop", "orders", ["metrics(*)"])


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, count(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS finished, count(o_orderkey) AS order_count FROM orders GROUP BY 1")
def osi_filtered_metric(t: Tables) -> DataFrame:
    return ask(catalog(t), "shop", "orders", ["order_year", "finished", "order_count"])


@query("SELECT p_brand, round(avg(p_retailprice - p_size), 6) AS avg_margin FROM part GROUP BY 1")
def osi_calc_field(t: Tables) -> DataFrame:
    return ask(catalog(t), "shop", "parts", ["p_brand", "avg_margin"]).withColumn("avg_margin", F.round("avg_margin", 6))


@query("SELECT p_partkey, p_brand, p_size, p_retailprice, avg(p_retailprice - p_size) AS avg_margin FROM part GROUP BY ALL")
def osi_all_fields(t: Tables) -> DataFrame:
    return ask(catalog(t), "shop", "parts", ["*", "avg_margin"])


@query("""SELECT * FROM (VALUES ('o_orderkey', 'bigint', false), ('o_custkey', 'bigint', false), ('o_totalprice', 'double', false), ('o_orderstatus', 'string', false), ('order_year', 'int', false),
('revenue', 'double', true), ('order_count', 'bigint', true), ('largest', 'double', true), ('finished', 'bigint', true)) AS v(name, type, is_metric)""")
def osi_describe(t: Tables) -> DataFrame:
    return catalog(t).describe("shop", "orders").select("name", "type", "is_metric")


@query("SELECT o_orderstatus, round(sum(o_totalprice), 4) AS revenue FROM orders GROUP BY o_orderstatus")
def osi_sql(t: Tables) -> DataFrame:
    c = catalog(t)
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql(c.expand_sql("shop", "orders", "SELECT o_orderstatus, METRIC(revenue) AS revenue FROM orders GROUP BY o_orderstatus"))


@query("SELECT c_custkey, 'masked' AS c_name, c_acctbal FROM customer")
def case_mask(t: Tables) -> DataFrame:
    policy = Policy(masks={"c_name": Mask(lambda c: is_member_of(c, "support"), "masked"), "c_acctbal": Mask(lambda c: is_member_of(c, "finance"))})
    return policy.apply(t.customer.select("c_custkey", "c_name", "c_acctbal"), ALICE)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def row_filter(t: Tables) -> DataFrame:
    policy = Policy(rows=(lambda c: is_member_of(c, "admin") | (F.col("c_mktsegment") == "BUILDING"),))
    return policy.apply(t.customer.select("c_custkey", "c_mktsegment"), ALICE)


@query("SELECT r_regionkey, 'alice' AS who, 'analyst' AS role, 'main' AS cat, 'sales' AS sch, true AS pii, false AS hr FROM region")
def member_of(t: Tables) -> DataFrame:
    return t.region.select("r_regionkey", current_user(ALICE).alias("who"), current_role(ALICE).alias("role"), current_catalog(ALICE).alias("cat"), current_schema(ALICE).alias("sch"), is_member_of(ALICE, "pii").alias("pii"), is_member_of(ALICE, "hr").alias("hr"))


PLAN = {
    "sort": [{"column": "revenue", "descending": True}, "o_orderpriority"],
    "limit": 3,
    "input": {
        "project": {"o_orderpriority": ["col", "o_orderpriority"], "revenue": ["col", "revenue"], "n": ["col", "n"], "urgent": ["case", [["starts_with", ["col", "o_orderpriority"], "1"], "yes"], "no"]},
        "input": {
            "aggregate": {"by": ["o_orderpriority"], "measures": [{"function": "max", "of": ["*", ["col", "l_extendedprice"], ["-", 1.0, ["col", "l_discount"]]], "name": "revenue"}, {"function": "count", "name": "n"}]},
            "input": {
                "join": {"left_keys": ["l_orderkey"], "right_keys": ["o_orderkey"]},
                "left": {"filter": ["and", [">", ["col", "l_quantity"], 25], ["in", ["col", "l_returnflag"], "A", "N"]], "input": {"scan": "lineitem"}},
                "right": {"scan": "orders", "columns": ["o_orderkey", "o_orderpriority"]},
            },
        },
    },
}


def _registry(t: Tables, *names: str) -> Registry:
    registry = Registry(t.spark, t.sf_dir)
    for name in names:
        registry.register(name, {"store_key": f"{name}.parquet"})
    return registry


@query("""SELECT o_orderpriority, max(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n, CASE WHEN starts_with(o_orderpriority, '1') THEN 'yes' ELSE 'no' END AS urgent
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 25 AND l_returnflag IN ('A', 'N') GROUP BY o_orderpriority ORDER BY revenue DESC, o_orderpriority LIMIT 3""")
def plan_tree(t: Tables) -> DataFrame:
    return compile_plan(PLAN, _registry(t, "lineitem", "orders"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) FILTER (WHERE 1000 < o_totalprice) AS most,
first(o_custkey ORDER BY o_totalprice DESC, o_custkey DESC) AS best FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))""")
def plan_sets(t: Tables) -> DataFrame:
    measures = [
        {"function": "count", "name": "n"},
        {"function": "max", "of": ["col", "o_totalprice"], "name": "most", "where": ["<", ["lit", 1000.0], ["col", "o_totalprice"]]},
        {"function": "first", "of": ["col", "o_custkey"], "name": "best", "order": ["col", "o_totalprice"], "descending": True},
    ]
    by = {"by": ["o_orderstatus", "o_orderpriority"], "grouping": "sets", "sets": [["o_orderstatus"], ["o_orderpriority"]], "measures": measures}
    return compile_plan({"aggregate": by, "input": {"scan": "orders"}}, _registry(t, "orders"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey > r_regionkey")
def plan_theta(t: Tables) -> DataFrame:
    on = {"residual": [">", ["col", "n_regionkey"], ["col", "r_regionkey"]]}
    both = {"join": on, "left": {"scan": "nation"}, "right": {"scan": "region"}}
    return compile_plan({"project": {"n_name": ["col", "n_name"], "r_name": ["col", "r_name"]}, "input": both}, _registry(t, "nation", "region"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(NULL AS DOUBLE) AS discount FROM customer")
def schema_adapt(t: Tables) -> DataFrame:
    return adapt(t.customer, StructType().add("c_custkey", StringType()).add("c_nationkey", LongType()).add("discount", DoubleType()))


_DAY = "CAST(CAST(DATE '1992-01-01' + CAST({} AS INTEGER) AS DATE) AS VARCHAR)"  # as text: engines return dates in different Python types
_SHIP = "i % 2527"


@query(f"""SELECT i // 4 AS l_orderkey, i % 200000 AS l_partkey, i % 10000 AS l_suppkey, CAST(i % 7 + 1 AS INTEGER) AS l_linenumber, CAST(i % 50 + 1 AS DOUBLE) AS l_quantity,
(i % 100000)::DOUBLE * 0.99::DOUBLE + 900 AS l_extendedprice, (i % 11)::DOUBLE * 0.01::DOUBLE AS l_discount, (i % 9)::DOUBLE * 0.01::DOUBLE AS l_tax,
(['A', 'N', 'R'])[i % 3 + 1] AS l_returnflag, (['F', 'O'])[i % 2 + 1] AS l_linestatus, {_DAY.format(_SHIP)} AS l_shipdate, {_DAY.format(_SHIP + " + 30 + i % 60")} AS l_commitdate,
{_DAY.format(_SHIP + " + 30 + i % 60 + 1 + i % 30")} AS l_receiptdate FROM range(5000, 15000) AS t(i)""")
def datagen_lineitem(t: Tables) -> DataFrame:
    made = datagen.lineitem(t.spark, 10_000, 5_000)
    return made.withColumns({c: F.col(c).cast("string") for c in ("l_shipdate", "l_commitdate", "l_receiptdate")})


@query(f"""SELECT i AS o_orderkey, i % 150000 AS o_custkey, (['F', 'O', 'P'])[i % 3 + 1] AS o_orderstatus, i::DOUBLE * 2.5 + 100 AS o_totalprice,
(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])[i % 5 + 1] AS o_orderpriority, {_DAY.format("i % 2405")} AS o_orderdate FROM range(0, 10000) AS t(i)""")
def datagen_orders(t: Tables) -> DataFrame:
    return datagen.orders(t.spark, 10_000).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1996-02-01' GROUP BY 1")
def cast_date(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderdate").cast(DateType()).alias("d")).filter(F.col("d") < F.lit("1996-02-01").cast("date")).groupBy(F.col("d").cast("string").alias("d")).agg(F.count(F.lit(1)).alias("n"))
