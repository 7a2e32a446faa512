"""Scans, filters, aggregates and joins over orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators.aggregates import Measure, aggregate
from tessera.operators.joins import BROADCAST_BYTES, broadcast_if_small, estimated_bytes, join
from tessera.operators.sorting import SortKey, sort
from tessera.sources.files import by_metadata
from tessera.suite.base import Tables, mean, query, rows, total


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("SELECT count(*) AS n FROM lineitem")
def scan_count(t: Tables) -> DataFrame:
    return by_metadata(t.spark, f"{t.sf_dir}/lineitem.parquet", t.lineitem.schema).agg(rows())


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05")
def filter_count(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_quantity > 25 AND l_discount < 0.05").agg(rows())


@query("SELECT count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def filter_between_count(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_discount BETWEEN 0.05D AND 0.07D AND l_quantity < 24").agg(rows())


@query("SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') AND NOT (l_quantity <= 10 OR l_tax >= 0.06) AND l_linenumber <> 3 GROUP BY 1")
def filter_logic(t: Tables) -> DataFrame:
    keep = F.col("l_returnflag").isin("A", "R") & ~((F.col("l_quantity") <= 10) | (F.col("l_tax") >= 0.06)) & (F.col("l_linenumber") != 3)
    return t.lineitem.filter(keep).groupBy("l_linestatus").agg(rows())


@query("SELECT count(*) AS n, count(v) AS present FROM (SELECT nullif(l_returnflag, 'A') AS v, l_quantity FROM lineitem) WHERE v IS NULL OR (v IS NOT NULL AND l_quantity < 5)")
def filter_nulls(t: Tables) -> DataFrame:
    v = t.lineitem.select(F.nullif("l_returnflag", F.lit("A")).alias("v"), "l_quantity")
    return v.filter(F.col("v").isNull() | (F.col("v").isNotNull() & (F.col("l_quantity") < 5))).agg(rows(), F.count("v").alias("present"))


@query("SELECT count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1998-09-02' AND CAST(o_orderdate AS DATE) >= DATE '1996-01-01'")
def filter_date(t: Tables) -> DataFrame:
    # against the stored type, so the bounds reach the scan
    return t.orders.filter("o_orderdate < TIMESTAMP_NTZ '1998-09-03' AND o_orderdate >= TIMESTAMP_NTZ '1996-01-01'").agg(rows())


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > o_custkey * 10.0")
def filter_columns(t: Tables) -> DataFrame:
    return t.orders.filter("o_totalprice > o_custkey * 10.0D").agg(rows())


@query("""SELECT l_returnflag, round(sum(l_extendedprice), 4) AS total_price, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
FROM lineitem GROUP BY l_returnflag""")
def agg_returnflag(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(total("l_extendedprice", "total_price"), mean("l_discount", "avg_discount"), rows())


_Q1 = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_base_price,
round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem {} GROUP BY l_returnflag, l_linestatus"""


def pricing_summary(lines: DataFrame) -> DataFrame:
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        total("l_quantity", "sum_qty"),
        total("l_extendedprice", "sum_base_price"),
        total(revenue(), "sum_disc_price"),
        total(revenue() * (1 + F.col("l_tax")), "sum_charge", 2),
        mean("l_quantity", "avg_qty"),
        mean("l_extendedprice", "avg_price"),
        mean("l_discount", "avg_disc"),
        rows("count_order"),
    )


@query(_Q1.format(""))
def q1_full(t: Tables) -> DataFrame:
    return pricing_summary(t.lineitem)


@query(_Q1.format("WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'"))
def q1_date(t: Tables) -> DataFrame:
    return pricing_summary(t.lineitem.filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'"))


@query(_Q1.format("WHERE l_discount < 0.07"))
def q1_discount(t: Tables) -> DataFrame:
    return pricing_summary(t.lineitem.filter(F.col("l_discount") < 0.07))


@query("""SELECT l_orderkey, round(sum(l_extendedprice), 4) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus = 'O' GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def q3_priority(t: Tables) -> DataFrame:
    open_ = t.orders.filter(F.col("o_orderstatus") == "O").select("o_orderkey")
    best = t.lineitem.join(open_, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey").agg(total("l_extendedprice", "revenue"), rows())
    return sort(best, [SortKey("revenue", True), SortKey("l_orderkey")], 10)


@query("""SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_date
FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def q3_full(t: Tables) -> DataFrame:
    building = t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    before = t.orders.filter("o_orderdate < TIMESTAMP_NTZ '1998-03-15'")
    after = t.lineitem.filter("l_shipdate > TIMESTAMP_NTZ '1998-03-15'")
    mine = before.join(broadcast_if_small(building), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    best = after.join(mine, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "o_orderdate").agg(total(revenue(), "revenue"))
    return sort(best, [SortKey("revenue", True), SortKey("l_orderkey")], 10).select("l_orderkey", "revenue", F.col("o_orderdate").cast("date").cast("string").alias("o_date"))


_Q6 = "l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"


def discounted(t: Tables) -> DataFrame:
    return t.lineitem.filter(F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))


@query(f"SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE {_Q6} AND l_extendedprice > 0")
def q6_revenue(t: Tables) -> DataFrame:
    return discounted(t).filter("l_extendedprice > 0").agg(total(F.col("l_extendedprice") * F.col("l_discount"), "revenue"))


@query(f"SELECT round(sum(l_extendedprice), 4) AS price, count(*) AS n FROM lineitem WHERE {_Q6}")
def q6_native(t: Tables) -> DataFrame:
    return discounted(t).agg(total("l_extendedprice", "price"), rows())


@query(f"SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE {_Q6} AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00'")
def q6_date(t: Tables) -> DataFrame:
    year = discounted(t).filter("l_shipdate >= TIMESTAMP_NTZ '1996-01-01' AND l_shipdate < TIMESTAMP_NTZ '1997-01-01'")
    return year.agg(total(F.col("l_extendedprice") * F.col("l_discount"), "revenue"))


@query("""SELECT o_orderstatus, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus ORDER BY revenue DESC, o_orderstatus""")
def join_revenue(t: Tables) -> DataFrame:
    status, lines = t.orders.select("o_orderkey", "o_orderstatus"), t.lineitem.select("l_orderkey", revenue().alias("revenue"), F.lit(1).cast("long").alias("n"))
    if estimated_bytes(status) > BROADCAST_BYTES:  # both sides are shuffled: add up each order's lines before
        lines = lines.groupBy("l_orderkey").agg(F.sum("revenue").alias("revenue"), F.sum("n").alias("n"))
    by_status = lines.join(broadcast_if_small(status), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus").agg(total("revenue", "revenue"), F.sum("n").alias("n"))
    return sort(by_status, [SortKey("revenue", True), SortKey("o_orderstatus")])


@query("SELECT o_orderstatus, round(avg(l_extendedprice), 6) AS avg_price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
def join_avg(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders.select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus").agg(mean("l_extendedprice", "avg_price"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 4) AS price FROM orders GROUP BY o_orderstatus")
def orders_agg(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(rows(), total("o_totalprice", "price"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS qty, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def multi_agg(t: Tables) -> DataFrame:
    measures = [Measure("min", "l_extendedprice", "low"), Measure("max", "l_extendedprice", "high"), Measure("count", None, "n"), Measure("sum", "l_quantity", "qty"), Measure("avg", "l_discount", "avg_disc")]
    out = aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], measures)
    return out.withColumns({"qty": F.round("qty", 4), "avg_disc": F.round("avg_disc", 6)})


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS q, round(sum(l_extendedprice), 4) AS p, round(sum(l_discount), 4) AS d,
round(avg(l_quantity), 6) AS aq, round(avg(l_extendedprice), 6) AS ap, round(avg(l_discount), 6) AS ad, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def multi_agg_sums(t: Tables) -> DataFrame:
    columns = [("l_quantity", "q"), ("l_extendedprice", "p"), ("l_discount", "d")]
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(*(total(c, n) for c, n in columns), *(mean(c, "a" + n) for c, n in columns), rows())


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def topn_price(t: Tables) -> DataFrame:
    keys = [SortKey("l_extendedprice", True), SortKey("l_orderkey"), SortKey("l_linenumber")]
    return sort(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), keys, 10)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1000")
def project_limit(t: Tables) -> DataFrame:
    return sort(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), [SortKey("l_orderkey"), SortKey("l_linenumber")], 1000)


_ARITHMETIC = """SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS added, l_quantity - l_tax AS taken, l_extendedprice * l_discount AS times, -l_quantity AS minus,
l_extendedprice / nullif(l_discount, 0) AS per, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS class,
CAST(l_quantity AS BIGINT) AS whole FROM lineitem"""


def arithmetic(lines: DataFrame) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount")
    return lines.select(
        "l_orderkey", "l_linenumber", (q + F.col("l_tax")).alias("added"), (q - F.col("l_tax")).alias("taken"), (F.col("l_extendedprice") * d).alias("times"), (-q).alias("minus"),
        F.try_divide("l_extendedprice", d).alias("per"), F.when(q < 10, "small").when(q < 30, "medium").otherwise("large").alias("class"), q.cast("bigint").alias("whole"),
    )


@query(_ARITHMETIC)
def project_arithmetic(t: Tables) -> DataFrame:
    return arithmetic(t.lineitem)


# Whole orders with whole customers. Every customer has orders and every order a customer, so a
# condition on the status leaves unmatched rows on both sides; the inner join needs none.
_FINISHED = "o_custkey = c_custkey AND o_orderstatus = 'F'"


def _whole(kind: str):
    on = "o_custkey = c_custkey" if kind == "inner" else _FINISHED

    @query(f"SELECT o_orderkey, o_totalprice, c_custkey, c_name FROM orders {kind.upper()} JOIN customer ON {on}", f"join_{kind}")
    def run(t: Tables) -> DataFrame:
        residual = None if kind == "inner" else F.col("o_orderstatus") == "F"
        orders, customers = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), t.customer.select("c_custkey", "c_name")
        return join(orders, customers, ["o_custkey"], ["c_custkey"], kind, residual).select("o_orderkey", "o_totalprice", "c_custkey", "c_name")


for _kind in ("inner", "left", "right", "full"):
    _whole(_kind)


def _customers_by_orders(kind: str, word: str):
    @query(f"SELECT c_custkey, c_name FROM customer WHERE {word} (SELECT 1 FROM orders WHERE {_FINISHED})", f"join_{kind}")
    def run(t: Tables) -> DataFrame:
        return join(t.customer.select("c_custkey", "c_name"), t.orders.select("o_custkey", "o_orderstatus"), ["c_custkey"], ["o_custkey"], kind, F.col("o_orderstatus") == "F")


_customers_by_orders("semi", "EXISTS")
_customers_by_orders("anti", "NOT EXISTS")


@query("""SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_tax AS l_tax_right FROM lineitem a JOIN (SELECT * FROM lineitem WHERE l_tax > 0.04) b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity < 20""")
def join_multikey(t: Tables) -> DataFrame:
    few = t.lineitem.filter("l_quantity < 20").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    taxed = t.lineitem.filter("l_tax > 0.04D").select("l_orderkey", "l_linenumber", "l_tax")
    return join(few, taxed, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax_right")


@query("""SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20""")
def join_residual(t: Tables) -> DataFrame:
    return join(t.orders, t.customer, ["o_custkey"], ["c_custkey"], residual=F.col("o_totalprice") > F.col("c_acctbal") * 20).agg(rows())


@query("SELECT count(*) AS n FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT nullif(s_nationkey, 3) AS k FROM supplier) b ON a.k = b.k")
def join_null_keys(t: Tables) -> DataFrame:
    a = t.customer.select(F.nullif("c_nationkey", F.lit(3)).alias("k"))
    b = t.supplier.select(F.nullif("s_nationkey", F.lit(3)).alias("k"))
    return join(a, b, ["k"]).agg(rows())


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def join_theta(t: Tables) -> DataFrame:
    return join(t.nation, F.broadcast(t.region), [], residual=F.col("n_regionkey") < F.col("r_regionkey")).select("n_name", "r_name")  # both sides of fixed size


@query("""SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS s, round(var_samp(l_quantity), 6) AS v, round(var_pop(l_discount), 8) AS vp, round(median(l_extendedprice), 4) AS mid
FROM lineitem GROUP BY l_returnflag""")
def agg_spread(t: Tables) -> DataFrame:
    measures = [Measure("stddev", "l_quantity", "s"), Measure("variance", "l_quantity", "v"), Measure("var_pop", "l_discount", "vp"), Measure("median", "l_extendedprice", "mid")]
    out = aggregate(t.lineitem, ["l_returnflag"], measures)
    return out.withColumns({"s": F.round("s", 6), "v": F.round("v", 6), "vp": F.round("vp", 8), "mid": F.round("mid", 4)})


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, first(l_extendedprice ORDER BY l_quantity, l_extendedprice) AS least,
last(l_extendedprice ORDER BY l_quantity, l_extendedprice) FILTER (WHERE l_tax < 0.05) AS most FROM lineitem GROUP BY l_returnflag""")
def agg_ordered(t: Tables) -> DataFrame:
    measures = [
        Measure("percentile", "l_extendedprice", "p90", share=0.9),
        Measure("first", "l_extendedprice", "least", order="l_quantity"),
        Measure("last", "l_extendedprice", "most", where=F.col("l_tax") < 0.05, order="l_quantity"),
    ]
    return aggregate(t.lineitem, ["l_returnflag"], measures).withColumn("p90", F.round("p90", 4))


@query("SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_nationkey DESC), ',') AS names FROM nation GROUP BY n_regionkey")
def agg_list(t: Tables) -> DataFrame:
    lists = aggregate(t.nation, ["n_regionkey"], [Measure("list", "n_name", "names", order="n_nationkey", descending=True)])
    return lists.withColumn("names", F.array_join("names", ","))


@query("SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem")
def count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"))


@query("SELECT p_brand, count(DISTINCT p_type) AS types, count(*) AS n FROM part GROUP BY p_brand")
def count_distinct_grouped(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.count_distinct("p_type").alias("types"), rows())


@query("SELECT l_linestatus, count(DISTINCT nullif(l_returnflag, 'A')) AS flags, count(nullif(l_returnflag, 'A')) AS present, sum(nullif(l_linenumber, 1))::BIGINT AS numbers FROM lineitem GROUP BY 1")
def count_distinct_nulls(t: Tables) -> DataFrame:
    v = F.nullif("l_returnflag", F.lit("A"))
    return t.lineitem.groupBy("l_linestatus").agg(F.count_distinct(v).alias("flags"), F.count(v).alias("present"), F.sum(F.nullif("l_linenumber", F.lit(1))).alias("numbers"))


@query("SELECT sum(DISTINCT l_linenumber)::BIGINT AS numbers, count(*) FILTER (WHERE l_quantity > 40) AS large, round(avg(DISTINCT l_quantity), 6) AS quantity FROM lineitem")
def agg_distinct_filter(t: Tables) -> DataFrame:
    measures = [Measure("sum", "l_linenumber", "numbers", distinct=True), Measure("count", None, "large", where=F.col("l_quantity") > 40), Measure("avg", "l_quantity", "quantity", distinct=True)]
    return aggregate(t.lineitem, [], measures).withColumn("quantity", F.round("quantity", 6))


@query("SELECT sum(l_quantity) AS total, min(l_quantity) AS low, avg(l_quantity) AS mean, count(l_quantity) AS n FROM lineitem WHERE l_quantity < 0")
def agg_empty(t: Tables) -> DataFrame:
    none = t.lineitem.filter("l_quantity < 0")
    return aggregate(none, [], [Measure("sum", "l_quantity", "total"), Measure("min", "l_quantity", "low"), Measure("avg", "l_quantity", "mean"), Measure("count", "l_quantity", "n")])


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(sum(l_quantity), 4) AS q, (grouping(l_returnflag) * 2 + grouping(l_linestatus))::BIGINT AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def grouping_sets(t: Tables) -> DataFrame:
    measures = [Measure("count", None, "n"), Measure("sum", "l_quantity", "q"), Measure("grouping", "l_returnflag", "a"), Measure("grouping", "l_linestatus", "b")]
    out = aggregate(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"], measures, "sets", [["l_returnflag", "l_linestatus"], ["l_linenumber"], []])
    return out.select("l_returnflag", "l_linestatus", "l_linenumber", "n", F.round("q", 4).alias("q"), (F.col("a") * 2 + F.col("b")).cast("bigint").alias("g"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(t: Tables) -> DataFrame:
    return aggregate(t.orders, ["o_orderstatus", "o_orderpriority"], [Measure("count", None, "n")], "cube")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_custkey, o_orderkey LIMIT 50")
def sort_multi(t: Tables) -> DataFrame:
    return sort(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), [SortKey("o_orderpriority", True), SortKey("o_custkey"), SortKey("o_orderkey")], 50)


def _null_sort(first: bool):
    word = "first" if first else "last"

    @query(f"SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s NULLS {word.upper()}, o_orderkey LIMIT 40", f"sort_nulls_{word}")
    def run(t: Tables) -> DataFrame:
        return sort(t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s")), [SortKey("s", nulls_first=first), SortKey("o_orderkey")], 40)


_null_sort(True)
_null_sort(False)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 30")
def offset_page(t: Tables) -> DataFrame:
    return sort(t.orders.select("o_orderkey", "o_totalprice"), [SortKey("o_totalprice", True), SortKey("o_orderkey")], 20, 30)
