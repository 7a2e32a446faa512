"""Semantic models, identities, policies, plans, strings, statistics and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.access import Mask, Policy
from tessera.context import SessionContext, current_role, current_user, is_member_of
from tessera.errors import EngineError, ErrorClass, MissingIdentity, ModelError, UnknownColumn, classify
from tessera.functions import strings as S
from tessera.operators.sorting import SortKey
from tessera.plans.expressions import expression
from tessera.plans.nodes import compile_plan
from tessera.semantic.catalog import Catalog, Query, ask
from tessera.semantic.model import Metric, parse
from tessera.sources.registry import Registry
from tessera.session import Switches, switched
from tessera.stats import observed
from tessera.streaming.events import event_stream, windowed_counts

SHOP = {
    "name": "shop",
    "datasets": [
        {
            "name": "orders",
            "source": {"catalog": "hive", "schema": "sales", "table": "orders"},
            "fields": [{"name": "id", "type": "integer"}, {"name": "customer", "type": "integer"}, {"name": "amount", "type": "decimal(10,2)"}, {"name": "status", "type": "varchar"}, {"name": "cents", "type": "bigint", "expression": "CAST(amount * 100 AS BIGINT)"}],
            "metrics": [
                {"name": "revenue", "expression": "SUM(amount)", "aggregate": "sum", "field": "amount"},
                {"name": "delivered", "expression": "SUM(amount)", "aggregate": "sum", "field": "amount", "filters": [{"field": "status", "operator": "=", "value": "'done'"}]},
                {"name": "margin", "expression": "AVG(amount - id)", "aggregate": "avg", "field": "amount"},
                {"name": "buyers", "aggregate": "count_distinct", "field": "customer"},
            ],
        },
        {"name": "people", "source": {"table": "people"}, "fields": [{"name": "id", "type": "integer"}, {"name": "tier", "type": "varchar"}]},
    ],
    "relationships": [{"name": "buyer", "from": {"dataset": "orders", "field": "customer"}, "to": {"dataset": "people", "field": "id"}}],
}


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "hive.sales.orders": spark.createDataFrame([(1, 1, 10.0, "done"), (2, 1, 5.0, "open"), (3, 2, 7.5, "done"), (4, None, 1.0, None)], "id int, customer int, amount double, status string"),
        "people": spark.createDataFrame([(1, "gold"), (2, "tin")], "id int, tier string"),
    }


@pytest.fixture(scope="module")
def catalog(spark, tables):
    c = Catalog(spark, tables.__getitem__)
    c.register(parse(SHOP))
    return c


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_names(catalog):
    assert catalog.models() == ["shop"] and catalog.datasets("shop") == ["orders", "people"]
    assert catalog.table_name("shop", "orders") == "hive.sales.orders"
    assert list(catalog.metrics("shop", "orders")) == ["revenue", "delivered", "margin", "buyers"]


def test_metric_sql(catalog):
    assert catalog.metric("shop", "orders", "revenue") == "SUM(amount)"
    assert catalog.metric("shop", "orders", "delivered") == "SUM(CASE WHEN (status = 'done') THEN amount END)"
    assert catalog.metric("shop", "orders", "margin") == "AVG(amount - id)"
    assert catalog.metric("shop", "orders", "buyers") == "COUNT(DISTINCT customer)"
    assert Metric("r", "SUM(a) / SUM(b)", "sum", "a").sql() == "SUM(a) / SUM(b)"


def test_questions(catalog):
    assert rows(ask(catalog, "shop", "orders", ["status", "revenue"])) == [("done", 17.5), ("open", 5.0), (None, 1.0)]
    assert rows(ask(catalog, "shop", "orders", ["delivered", "revenue", "buyers"])) == [(17.5, 23.5, 2)]
    assert rows(ask(catalog, "shop", "orders", ["people.tier", "revenue"], joins=["people"])) == [("gold", 15.0), ("tin", 7.5)]
    assert rows(ask(catalog, "shop", "people", ["tier", "orders.amount"], joins=["orders"], where=["tier = 'gold' OR false"])) == [("gold", 10.0), ("gold", 5.0)]
    assert rows(ask(catalog, "shop", "orders", ["cents"], where=["status IS NOT NULL OR false", "cents > 600"], order_by=[SortKey("cents", True)], limit=1)) == [(1000,)]
    assert len(ask(catalog, "shop", "orders", ["*", "revenue"]).columns) == 6


def test_sql_text_gives_the_same(spark, catalog, tables):
    tables["people"].createOrReplaceTempView("people")
    q = Query("shop", "people", ("tier",), order_by=(SortKey("tier", True),), limit=1)
    assert rows(spark.sql(catalog.to_sql(q))) == rows(catalog.query(q)) == [("tin",)]
    text = catalog.to_sql(Query("shop", "orders", ("people.tier", "delivered"), joins=("people",)))
    assert "ON orders.customer = people.id" in text and "THEN orders.amount END" in text and "GROUP BY people.tier" in text
    assert catalog.join_on("shop", "people", "orders").sql() == "people.id = orders.customer"
    assert catalog.expand_sql("shop", "orders", "SELECT metric(revenue) FROM t") == "SELECT SUM(amount) FROM t"


def test_describe(catalog):
    got = {r["name"]: (r["type"], r["is_metric"]) for r in catalog.describe("shop", "orders").collect()}
    assert got["cents"] == ("bigint", False) and got["buyers"] == ("bigint", True) and got["revenue"] == ("double", True)


@pytest.mark.parametrize(
    "change",
    [
        lambda m: m["datasets"][0]["fields"].append({"name": "id", "type": "integer"}),
        lambda m: m["datasets"][0]["fields"].append({"name": "x", "type": "blob"}),
        lambda m: m["datasets"][0]["metrics"].append({"name": "x", "aggregate": "sum", "field": "absent"}),
        lambda m: m["datasets"][0]["metrics"].append({"name": "x", "aggregate": "median"}),
        lambda m: m["relationships"][0]["to"].update(dataset="absent"),
        lambda m: m.pop("name"),
    ],
)
def test_bad_models(change):
    model = json.loads(json.dumps(SHOP))
    change(model)
    with pytest.raises(ModelError):
        parse(model)


def test_bad_questions(catalog):
    for q in (Query("none", "orders", ("id",)), Query("shop", "orders", ()), Query("shop", "orders", ("nothing",)), Query("shop", "orders", ("people.tier",)), Query("shop", "orders", ("id",), joins=("absent",))):
        with pytest.raises(ModelError):
            catalog.query(q)


def test_folder(spark, tmp_path, caplog):
    (tmp_path / "a.json").write_text(json.dumps(SHOP))
    (tmp_path / "b.json").write_text("{")
    c = Catalog(spark, folder=tmp_path)
    assert c.reload() == ["shop"] and "b.json" in caplog.text


CTX = SessionContext("alice", frozenset({"pii"}), ("analyst", "viewer"))


def test_identity(spark):
    got = spark.range(1).select(current_user(CTX), current_role(CTX), current_role(SessionContext("x")), is_member_of(CTX, "pii"), is_member_of(CTX, "hr")).first()
    assert tuple(got) == ("alice", "analyst", None, True, False)
    with pytest.raises(MissingIdentity):
        current_user(None)


def test_policies_fail_closed(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    policy = Policy((lambda c: F.col("id") > 1,), {"name": Mask(lambda c: is_member_of(c, "hr"), "***")})
    assert rows(policy.apply(df, CTX)) == [(2, "***")]
    with pytest.raises(MissingIdentity):
        policy.apply(df, None)
    with pytest.raises(UnknownColumn):
        Policy(masks={"x": Mask(lambda c: F.lit(True))}).apply(df, CTX)
    r = Registry(spark)
    r.push("t", df)
    r.protect("t", policy)
    with pytest.raises(MissingIdentity):
        r.table("t")
    assert r.sql("SELECT name FROM t", CTX).first()["name"] == "***"


def test_plan_and_expressions(spark):
    r = Registry(spark)
    r.push("t", spark.createDataFrame([(1, 2.0, None), (2, 0.0, "x%y"), (3, 4.0, "abc")], "id int, v double, s string"))
    plan = {"project": {"q": ["/", 1.0, ["col", "v"]], "m": ["case", [["is_member_of", "pii"], ["col", "s"]], "hidden"]}, "input": {"filter": ["or", ["is_null", ["col", "s"]], ["like", ["col", "s"], "a%"], ["=", ["col", "v"], 0.0]], "input": {"scan": "t"}}}
    assert rows(compile_plan(json.dumps(plan), r, CTX)) == sorted([(0.5, None), (None, "x%y"), (0.25, "abc")], key=repr)
    for bad in ({"scan": 1}, {"teleport": "t"}, []):
        with pytest.raises(EngineError):
            compile_plan(bad, r)
    for bad in (["frobnicate", 1], ["col"], [], ["is_member_of", "pii"]):
        with pytest.raises(EngineError):
            expression(bad)


def test_logic_is_three_valued(spark):
    df = spark.createDataFrame([(None,)], "b boolean")
    got = df.select(~(F.col("b") & F.lit(False)), F.col("b") | F.lit(True)).first()
    assert tuple(got) == (True, True)


def test_strings(spark):
    df = spark.createDataFrame([("Hällo", None)], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(S.length(a), S.octet_length(a), S.substring(a, 2, 2), S.substring(a, -3), S.concat(a, b), S.like(F.lit("a%b"), "a!%b", "!"), S.ilike(a, "h%LO"), S.upper(F.lit("ß")), S.lpad(a, 7, "*"), S.replace(a, "l", "L")).first()
    assert tuple(got) == (5, 6, "äl", "llo", None, True, True, "SS", "**Hällo", "HäLLo")


def test_statistics(spark):
    lines = []
    assert observed("q", spark.range(7), lambda d: d.count(), lines.append) == 7
    assert json.loads(lines[0])["rows"] == 7
    with pytest.raises(ZeroDivisionError):
        observed("bad", spark.range(1), lambda d: 1 / 0, lines.append)
    assert json.loads(lines[1])["error"] == "ZeroDivisionError" and json.loads(lines[1])["error_class"] == "internal"


def test_statistics_of_the_work_done(spark, tmp_path):
    p, lines = str(tmp_path / "t"), []
    spark.range(10_000).select("id", (F.col("id") % 7).alias("k")).repartition(3).write.parquet(p)
    observed("q", spark.read.parquet(p).groupBy("k").count(), lambda d: d.collect(), lines.append)
    observed("local", spark.createDataFrame([(1,)], "a int"), lambda d: d.collect(), lines.append)
    got, after = map(json.loads, lines)
    assert got["rows"] == 7 and got["bytes_read"] > 0 and got["shuffle_bytes"] > 0 and got["tasks"] >= got["stages"] >= 2
    assert got["executors"] == ["driver"] and got["fallback"] == [] and got["error"] is None
    assert after["shuffle_bytes"] == 0 and after["stages"] <= 1  # the work of other queries is not counted


def test_error_classes(spark):
    def of(f):
        with pytest.raises(Exception) as e:
            f()
        return classify(e.value)

    assert of(lambda: spark.sql("SELECT * FROM no_such_table")) is of(lambda: spark.read.parquet("/no/such/place")) is of(lambda: spark.sql("SELECT b FROM range(3)")) is ErrorClass.NOT_FOUND
    assert of(lambda: spark.sql("SELEC 1")) is of(lambda: spark.sql("SELECT CAST('a' AS INT)").collect()) is of(lambda: spark.sql("SELECT 1 / 0").collect()) is ErrorClass.USER
    assert classify(EngineError("x")) is classify(ModelError("x")) is ErrorClass.USER and classify(UnknownColumn("x")) is ErrorClass.NOT_FOUND
    assert classify(MissingIdentity("x")) is classify(RuntimeError("AccessControlException: Permission denied")) is ErrorClass.DENIED
    short = classify(RuntimeError("ExecutorLostFailure (executor 3 exited)"))
    assert short is ErrorClass.RESOURCES and short.retryable and not ErrorClass.USER.retryable and classify(KeyError("x")) is ErrorClass.INTERNAL


def test_switches_change_plans_and_no_results(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(1_000).select("id", (F.col("id") % 5).alias("k")).write.parquet(p)
    ask_ = lambda s: s.read.parquet(p).filter("id < 500").groupBy("k").count()
    plain = switched(spark, Switches(acceleration=False))
    one = switched(spark, Switches(split_bytes=1 << 10, single_task=True))
    assert rows(ask_(spark)) == rows(ask_(plain)) == rows(ask_(one))
    tree = lambda s: ask_(s)._jdf.queryExecution().executedPlan().toString()
    assert "AdaptiveSparkPlan" in tree(spark) and "AdaptiveSparkPlan" not in tree(plain) and "*(" not in tree(plain)  # no replanning, no generated code
    assert plain.conf.get("spark.sql.parquet.filterPushdown") == "false" and spark.conf.get("spark.sql.parquet.filterPushdown") == "true"
    assert one.read.parquet(p).rdd.getNumPartitions() > spark.read.parquet(p).rdd.getNumPartitions()
    assert one.conf.get("spark.sql.shuffle.partitions") == "1" != spark.conf.get("spark.sql.shuffle.partitions")
    assert one.conf.get("spark.sql.ansi.enabled") == "true"


def test_stream_agrees_with_batch(spark, tmp_path):
    folder = str(tmp_path / "events")
    spark.range(200).select(F.timestamp_seconds(F.col("id") * 300).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), F.col("id").cast("double").alias("value")).write.parquet(folder)
    batch = spark.read.parquet(folder)
    stream = windowed_counts(event_stream(spark, folder, batch.schema))
    q = stream.writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert rows(spark.table("seen")) == rows(windowed_counts(batch))


def test_yaml_model(spark, tmp_path, tables):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "shop.yaml").write_text(yaml.safe_dump(SHOP))
    c = Catalog(spark, tables.__getitem__, tmp_path)
    assert c.reload() == ["shop"] and rows(ask(c, "shop", "orders", ["revenue"])) == [(23.5,)]
