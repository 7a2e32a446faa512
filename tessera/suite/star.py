"""Star joins, pivots, strings, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions import strings as S
from tessera.operators.joins import broadcast_if_small
from tessera.operators.sets import bucket, combine, over
from tessera.operators.sorting import SortKey, sort
from tessera.suite.base import Tables, mean, query, rows, total

_FACT = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"


def with_part(df: DataFrame, part: DataFrame) -> DataFrame:
    return df.join(broadcast_if_small(part), F.col("l_partkey") == F.col("p_partkey"))


@query(f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS y, p_brand, p_type, round(sum(l_extendedprice), 4) AS price FROM {_FACT}
WHERE p_size < 20 AND month(o_orderdate) = 11 GROUP BY ALL ORDER BY y, price DESC, p_brand, p_type LIMIT 100""")
def ds_q3(t: Tables) -> DataFrame:
    # parts cut the lines before these are shuffled
    lines = with_part(t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice"), t.part.filter("p_size < 20").select("p_partkey", "p_brand", "p_type"))
    november = t.orders.filter(F.month("o_orderdate") == 11).select("o_orderkey", "o_orderdate")
    out = lines.join(broadcast_if_small(november), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.year("o_orderdate").alias("y"), "p_brand", "p_type").agg(total("l_extendedprice", "price"))
    return sort(out, [SortKey("y"), SortKey("price", True), SortKey("p_brand"), SortKey("p_type")], 100)


@query(f"""SELECT p_name, round(avg(l_quantity), 6) AS q, round(avg(l_extendedprice), 6) AS p, round(avg(l_discount), 6) AS d, round(avg(l_tax), 6) AS x, count(*) AS n
FROM {_FACT} JOIN customer ON o_custkey = c_custkey WHERE c_acctbal BETWEEN 1000 AND 5000 AND c_mktsegment = 'MACHINERY' GROUP BY p_name ORDER BY p_name LIMIT 100""")
def ds_q7(t: Tables) -> DataFrame:
    who = t.customer.filter("c_acctbal BETWEEN 1000D AND 5000D AND c_mktsegment = 'MACHINERY'").select("c_custkey")
    mine = t.orders.select("o_orderkey", "o_custkey").join(broadcast_if_small(who), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    lines = with_part(t.lineitem.join(mine, F.col("l_orderkey") == F.col("o_orderkey")), t.part.select("p_partkey", "p_name"))
    out = lines.groupBy("p_name").agg(mean("l_quantity", "q"), mean("l_extendedprice", "p"), mean("l_discount", "d"), mean("l_tax", "x"), rows())
    return sort(out, [SortKey("p_name")], 100)


@query(f"""SELECT p_brand, n_name, round(sum(l_extendedprice), 4) AS price FROM {_FACT} JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE p_size IN (1, 5, 10, 15, 20) AND n_regionkey IN (1, 2) GROUP BY p_brand, n_name""")
def ds_q19(t: Tables) -> DataFrame:
    customers = t.customer.select("c_custkey", "c_nationkey")
    where = customers.join(F.broadcast(t.nation.filter("n_regionkey IN (1, 2)")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")  # nations are a fixed 25
    parts = t.part.filter("p_size IN (1, 5, 10, 15, 20)").select("p_partkey", "p_brand")
    # customers cut the orders and parts the lines before these two meet
    mine = t.orders.select("o_orderkey", "o_custkey").join(broadcast_if_small(where, size_of=customers), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    lines = with_part(t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice"), parts).join(broadcast_if_small(mine, size_of=t.orders.select("o_orderkey", "o_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("p_brand", "n_name").agg(total("l_extendedprice", "price"))


@query("""SELECT round(avg(q), 6) AS mean_qty, round(sum(p), 4) AS price, count(*) AS suppliers FROM
(SELECT l_suppkey, sum(l_quantity) AS q, sum(l_extendedprice) AS p, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20)""")
def ds_q27_nested(t: Tables) -> DataFrame:
    by = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"), rows()).filter("n > 20")
    return by.agg(mean("q", "mean_qty"), total("p", "price"), rows("suppliers"))


@query("""SELECT p_brand, n_name, CAST(grouping(n_name) AS BIGINT) AS g, round(avg(l_quantity), 6) AS q, round(sum(l_extendedprice), 4) AS p FROM lineitem, part, supplier, nation
WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND p_size > 25 GROUP BY ROLLUP (p_brand, n_name)""")
def ds_q27_rollup(t: Tables) -> DataFrame:
    who = t.supplier.select("s_suppkey", "s_nationkey")
    lands = who.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")  # nations are a fixed 25
    lines = with_part(t.lineitem, t.part.filter("p_size > 25").select("p_partkey", "p_brand")).join(broadcast_if_small(lands, size_of=who), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.rollup("p_brand", "n_name").agg(F.grouping("n_name").cast("bigint").alias("g"), mean("l_quantity", "q"), total("l_extendedprice", "p"))


@query("""SELECT s_name, dayname(l_shipdate) AS day, round(sum(l_extendedprice), 4) AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name, day""")
def ds_q43(t: Tables) -> DataFrame:
    lines = t.lineitem.join(broadcast_if_small(t.supplier.select("s_suppkey", "s_name")), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.groupBy("s_name", F.date_format("l_shipdate", "EEEE").alias("day")).agg(total("l_extendedprice", "p"))


_DAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


@query("SELECT s_name, " + ", ".join(f"round(sum(CASE WHEN dayname(l_shipdate) = '{d}' THEN l_extendedprice END), 4) AS {d.lower()}" for d in _DAYS) + " FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name")
def ds_q43_pivot(t: Tables) -> DataFrame:
    lines = t.lineitem.join(broadcast_if_small(t.supplier.select("s_suppkey", "s_name")), F.col("l_suppkey") == F.col("s_suppkey"))
    day = F.dayofweek("l_shipdate")  # Sunday is 1
    return lines.groupBy("s_name").agg(*(total(F.when(day == k, F.col("l_extendedprice")), d.lower()) for k, d in enumerate(_DAYS, 1)))


@query("""SELECT p_brand, round(sum(l_extendedprice), 4) AS p, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_brand LIKE '%2%' AND p_size = 10 GROUP BY p_brand ORDER BY p DESC, p_brand LIMIT 100""")
def ds_q55(t: Tables) -> DataFrame:
    lines = with_part(t.lineitem, t.part.filter(S.like(F.col("p_brand"), "%2%") & (F.col("p_size") == 10)).select("p_partkey", "p_brand"))
    return sort(lines.groupBy("p_brand").agg(total("l_extendedprice", "p"), rows()), [SortKey("p", True), SortKey("p_brand")], 100)


@query("""SELECT upper(substring(c_name, 1, 4)) || '-' || lower(c_mktsegment) AS k, count(*) AS n, round(sum(o_totalprice), 4) AS p
FROM customer JOIN orders ON c_custkey = o_custkey WHERE length(c_name) > 5 GROUP BY k""")
def ds_q96(t: Tables) -> DataFrame:
    key = S.concat(S.upper(S.substring(F.col("c_name"), 1, 4)), F.lit("-"), S.lower(F.col("c_mktsegment")))
    who = t.customer.filter(S.length(F.col("c_name")) > 5).select("c_custkey", key.alias("k"))
    return t.orders.join(broadcast_if_small(who), F.col("o_custkey") == F.col("c_custkey")).groupBy("k").agg(rows(), total("o_totalprice", "p"))


@query("""SELECT count(*) AS n FROM lineitem, part, supplier WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND p_size BETWEEN 10 AND 20 AND s_acctbal > 0""")
def ds_q96_count(t: Tables) -> DataFrame:
    parts, who = t.part.filter("p_size BETWEEN 10 AND 20").select("p_partkey"), t.supplier.filter("s_acctbal > 0").select("s_suppkey")
    return with_part(t.lineitem, parts).join(broadcast_if_small(who), F.col("l_suppkey") == F.col("s_suppkey")).agg(rows())


@query("""SELECT p_brand, count(*) AS n, round(sum(l_extendedprice), 4) AS p FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_quantity > 10 AND l_discount > 0.02 GROUP BY p_brand ORDER BY p DESC, p_brand LIMIT 20""")
def pipe_filter_join_agg_sort(t: Tables) -> DataFrame:
    lines = with_part(t.lineitem.filter("l_quantity > 10 AND l_discount > 0.02D"), t.part.select("p_partkey", "p_brand"))
    return sort(lines.groupBy("p_brand").agg(rows(), total("l_extendedprice", "p")), [SortKey("p", True), SortKey("p_brand")], 20)


@query("""SELECT l_returnflag, upper(p_type) AS t, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name LIKE '%a%' GROUP BY 1, 2""")
def str_pipeline(t: Tables) -> DataFrame:
    parts = t.part.filter(S.like(F.col("p_name"), "%a%")).select("p_partkey", S.upper(F.col("p_type")).alias("t"))
    return with_part(t.lineitem, parts).groupBy("l_returnflag", "t").agg(rows())


def _string(name: str, sql: str, f, table: str = "part", key: str = "p_partkey") -> None:
    @query(f"SELECT {key}, {sql} AS v FROM {table}", f"str_{name}")
    def run(t: Tables) -> DataFrame:
        return getattr(t, table).select(key, f(F.col).alias("v"))


_string("like_prefix", "p_type LIKE 'S%'", lambda c: S.like(c("p_type"), "S%"))
_string("like_contains", "p_name LIKE '%1%'", lambda c: S.like(c("p_name"), "%1%"))
_string("like_suffix", "c_name LIKE '%7'", lambda c: S.like(c("c_name"), "%7"), "customer", "c_custkey")
_string("like_multi", "o_orderpriority LIKE '_-%I%H%'", lambda c: S.like(c("o_orderpriority"), "_-%I%H%"), "orders", "o_orderkey")
_string("ilike", "p_type ILIKE '%sT%'", lambda c: S.ilike(c("p_type"), "%sT%"))
_string("upper", "upper(p_name)", lambda c: S.upper(c("p_name")))
_string("lower", "lower(p_type)", lambda c: S.lower(c("p_type")))
_string("substring", "substring(p_name, 2, 3)", lambda c: S.substring(c("p_name"), 2, 3))
_string("substring_end", "substring(p_name, -4, 2)", lambda c: S.substring(c("p_name"), -4, 2))
_string("replace", "replace(p_name, 'a', 'xy')", lambda c: S.replace(c("p_name"), "a", "xy"))
_string("length", "CAST(length(p_name) AS INTEGER)", lambda c: S.length(c("p_name")))
_string("octet_length", "CAST(strlen(p_name) AS INTEGER)", lambda c: S.octet_length(c("p_name")))
_string("concat", "p_brand || '/' || nullif(p_type, 'x')", lambda c: S.concat(c("p_brand"), F.lit("/"), c("p_type")))
_string("contains", "contains(p_name, '2')", lambda c: S.contains(c("p_name"), "2"))
_string("starts", "starts_with(p_brand, 'Brand#1')", lambda c: S.starts_with(c("p_brand"), "Brand#1"))
_string("ends", "ends_with(p_brand, '3')", lambda c: S.ends_with(c("p_brand"), "3"))
_string("regexp_replace", "regexp_replace(p_brand, '[0-9]+', 'N', 'g')", lambda c: S.regexp_replace(c("p_brand"), "[0-9]+", "N"))
_string("lpad", "lpad(p_brand, 12, '*')", lambda c: S.lpad(c("p_brand"), 12, "*"))
_string("rpad", "rpad(p_brand, 12, '*')", lambda c: S.rpad(c("p_brand"), 12, "*"))


# Beyond the parity set: windows and set operations, as the roadmap names them.


@query("""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr, CAST(ntile(4) OVER w AS INTEGER) AS nt,
lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS near FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderstatus)""")
def window_functions(t: Tables) -> DataFrame:
    by, order = ["o_custkey"], [SortKey("o_orderdate"), SortKey("o_orderkey")]
    status = Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    return t.orders.select(
        "o_orderkey", over(F.row_number(), by, order).cast("bigint").alias("rn"), F.rank().over(status).cast("bigint").alias("rk"), F.dense_rank().over(status).cast("bigint").alias("dr"), over(F.ntile(4), by, order).alias("nt"),
        over(F.lag("o_totalprice"), by, order).alias("before"), over(F.lead("o_totalprice"), by, order).alias("after"), F.round(over(F.sum("o_totalprice"), by, order, (-2, 0)), 4).alias("near"),
    )


def _set(how: str, all_rows: bool) -> None:
    word = how.upper() + (" ALL" if all_rows else "")

    @query(f"(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0) {word} (SELECT s_nationkey AS k FROM supplier)", f"set_{how}" + "_all" * all_rows)
    def run(t: Tables) -> DataFrame:
        return combine(t.customer.filter("c_acctbal > 0").select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")), how, all_rows)


for _how in ("union", "intersect", "except"):
    _set(_how, False)
    _set(_how, True)


@query("""SELECT count(*) AS n, count(DISTINCT o_custkey) AS keys, CAST(1 AS BIGINT) AS buckets_of_a_key, true AS inside FROM orders""")
def hash_partition(t: Tables) -> DataFrame:
    """Rows dealt to 16 buckets: none is lost, a key's rows meet in one bucket, and bucket numbers are below 16."""
    dealt = t.orders.select("o_custkey", bucket(16, F.col("o_custkey")).alias("bucket"))
    keys = dealt.groupBy("o_custkey").agg(rows(), F.count_distinct("bucket").alias("buckets"), F.min("bucket").alias("low"), F.max("bucket").alias("high"))
    return keys.agg(F.sum("n").alias("n"), rows("keys"), F.max("buckets").alias("buckets_of_a_key"), ((F.min("low") >= 0) & (F.max("high") < 16)).alias("inside"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def events_by_hour(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window("ts", "1 hour")["start"].alias("start"), "event_type").agg(rows(), total("value", "value"))
