"""Files, registries and generators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from tessera.errors import EngineError, UnknownTable
from tessera.sources import datagen
from tessera.sources.files import adapt, list_files, resolve_uri, row_count, scan, scan_evolving, write_bucketed, write_sorted
from tessera.sources.registry import Registry, TableSpec


def test_uris():
    assert resolve_uri("s3://b/k") == "s3a://b/k"
    assert resolve_uri("/tmp/x") == "/tmp/x"
    assert resolve_uri("az://c/k") == "abfs://c/k"
    with pytest.raises(EngineError):
        resolve_uri("ftp://host/x")


def test_scan_prunes_and_pushes(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(500).select("id", (F.col("id") * 2.0).alias("value"), F.concat(F.lit("n"), F.col("id")).alias("name")).repartition(3).write.parquet(p)
    df = scan(spark, p, columns=["name"], where=F.col("value") < 150)
    assert df.count() == 75
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(value,150.0)" in plan and "ReadSchema: struct<value:double,name:string>" in plan
    assert len(list_files(spark, p)) == 3
    assert row_count(spark, p) == 500 and row_count(spark, p, F.col("id") < 10) == 10


@pytest.mark.parametrize("fmt", ["orc", "json", "csv"])
def test_other_formats(spark, tmp_path, fmt):
    p = str(tmp_path / fmt)
    rows = [(1, "x", 1.5), (2, None, None), (3, "a,\"b\"", -2.0)]
    schema = StructType().add("id", LongType()).add("name", StringType()).add("value", DoubleType())
    spark.createDataFrame(rows, schema).write.format(fmt).save(p)
    df = scan(spark, p, schema, columns=["name"], where=F.col("id") >= 2, fmt=fmt)
    assert sorted(map(tuple, df.collect()), key=repr) == [("a,\"b\"",), (None,)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,2)" in plan and "ReadSchema: struct<id:bigint,name:string>" in plan
    assert scan(spark, p, schema, fmt=fmt).count() == 3


def test_no_files(spark):
    schema = StructType().add("id", IntegerType())
    assert scan(spark, [], schema).count() == 0
    with pytest.raises(EngineError):
        scan(spark, [])


def test_evolution(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1, "x")], "id int, name string").write.parquet(a)
    spark.createDataFrame([(2, "y", 1.5, "gone")], "id long, name string, value double, extra string").write.parquet(b)
    target = StructType().add("id", LongType()).add("name", StringType()).add("value", DoubleType())
    assert sorted(map(tuple, scan_evolving(spark, [a, b], target).collect())) == [(1, "x", None), (2, "y", 1.5)]


def test_bad_casts_are_loud(spark):
    df = spark.createDataFrame([("a",)], "id string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        adapt(df, StructType().add("id", IntegerType())).collect()


def test_table_specs():
    assert TableSpec.parse({"uris": ["a"], "store_key": "k"}) == TableSpec(("a",), "k")
    for bad in ("path", {"uris": "path"}, {"path": []}):
        with pytest.raises(EngineError):
            TableSpec.parse(bad)


def test_registry_order(spark, tmp_path):
    p = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(p)
    r = Registry(spark, str(tmp_path))
    r.register("direct", {"uris": [p]})
    r.register("keyed", {"store_key": "t.parquet"})
    r.push("pushed", spark.range(5))
    assert [r.table(n).count() for n in ("direct", "keyed", "pushed")] == [3, 3, 5]
    assert r.sql("SELECT count(*) AS n FROM direct JOIN pushed USING (id)").first()["n"] == 3
    assert r.columns("direct") == [("id", "bigint")] and {"direct", "keyed", "pushed"} <= set(r.names())
    r.drop("pushed")
    with pytest.raises(UnknownTable):
        r.table("pushed_never")


def test_generator_slices_meet(spark):
    whole = datagen.lineitem(spark, 40).orderBy("l_orderkey", "l_partkey").collect()
    halves = datagen.lineitem(spark, 20).union(datagen.lineitem(spark, 20, 20)).orderBy("l_orderkey", "l_partkey").collect()
    assert whole == halves


def test_generated_averages(spark):
    lines, orders = datagen.lineitem(spark, 8), datagen.orders(spark, 2)
    got = {r[0]: round(r[1], 6) for r in lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus").agg(F.avg("l_extendedprice")).collect()}
    assert got == {"F": 901.485, "O": 905.445}


def test_sorted_files_have_disjoint_bounds(spark, tmp_path):
    p = str(tmp_path / "s")
    write_sorted(spark.range(1000).select(F.col("id").alias("k")), p, ["k"], 4)
    bounds = spark.read.parquet(p).groupBy(F.input_file_name().alias("f")).agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("a").collect()
    assert len(bounds) == 4 and all(x["b"] < y["a"] for x, y in zip(bounds, bounds[1:]))


def test_bucketed_join_needs_no_shuffle(spark, tmp_path):
    for t in ("bucket_a", "bucket_b"):
        write_bucketed(spark.range(100).select(F.col("id").alias("k"), F.col("id").alias(t)), t, ["k"], 4)
    df = spark.table("bucket_a").hint("merge").join(spark.table("bucket_b"), "k")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 100
    for t in ("bucket_a", "bucket_b"):
        spark.sql(f"DROP TABLE {t}")
