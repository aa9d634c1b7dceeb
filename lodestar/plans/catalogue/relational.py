"""Scans, predicates, joins, aggregation, set operations, ordering, subqueries and CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators import joins, relational
from lodestar.plans.catalogue.registry import query, same
from lodestar.plans.dialect import run_sql
from lodestar.session import Tables

B = "bigint"


@query("flagship_top_customers", """
WITH rev AS (SELECT n_name, year(o_orderdate)::BIGINT AS o_year, c_custkey, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS revenue, count(DISTINCT o_orderkey) AS n_orders
  FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey
  WHERE l_returnflag <> 'R' GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n_name, o_year ORDER BY revenue DESC, c_custkey) AS rk FROM rev) WHERE rk <= 3""")
def flagship(t: Tables) -> DataFrame:
    sold = t.lineitem.where("l_returnflag <> 'R'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("amount"))
    # One row per order before the order meets its customer: the largest table is aggregated on its own join key.
    per_order = sold.groupBy("l_orderkey").agg(F.sum("amount").alias("amount"))
    orders = t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").cast(B).alias("o_year"))
    customers = t.customer.select("c_custkey", "c_nationkey").join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_year").agg(F.sum("amount").alias("amount"), F.count("*").alias("n_orders"))
    rev = joined.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("n_name", "o_year", "c_custkey", F.col("amount").cast("double").alias("revenue"), "n_orders")
    return relational.top_per_group(rev, ["n_name", "o_year"], [F.desc("revenue"), "c_custkey"], 3, "rk").withColumn("rk", F.col("rk").cast(B))


# Scans, projection, predicates
@query("scan_project_filter", "SELECT l_orderkey, l_partkey, l_quantity, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem WHERE l_shipdate < DATE '1996-06-01' AND l_quantity >= 30")
def scan(t: Tables) -> DataFrame:
    rows = t.lineitem.where((F.col("l_shipdate") < F.lit("1996-06-01").cast("date")) & (F.col("l_quantity") >= 30))
    return rows.select("l_orderkey", "l_partkey", "l_quantity", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6).alias("net"))


@query("scan_point_lookup", "SELECT * FROM orders WHERE o_orderkey = 77")
def point(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderkey") == 77)


@query("scan_key_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 250")
def key_range(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderkey").between(100, 250)).select("o_orderkey", "o_totalprice")


@query("scan_row_fetch", "SELECT o.* FROM orders o WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0)")
def row_fetch(t: Tables) -> DataFrame:
    wanted = t.lineitem.where("l_quantity = 50 AND l_discount = 0").select("l_orderkey")
    return t.orders.join(wanted, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@query("select_without_from", "SELECT 1::BIGINT AS one, 'a' || 'b' AS ab, 7 / 2 AS half, NULL::VARCHAR AS nothing")
def no_from(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.lit(1).cast(B).alias("one"), F.concat(F.lit("a"), F.lit("b")).alias("ab"), (F.lit(7) / F.lit(2)).alias("half"), F.lit(None).cast("string").alias("nothing"))


same("predicate_mix", """SELECT p_partkey, p_brand, p_size FROM part
WHERE p_size IN (1, 5, 9, 14) AND p_retailprice BETWEEN 900 AND 1500 AND p_name LIKE '%e%' AND NOT (p_type LIKE 'STANDARD%') AND p_brand IS NOT NULL""", "part")
same("like_escape", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%#0000%' OR c_name LIKE '%!_%' ESCAPE '!'", "customer")


@query("glob_match", "SELECT p_partkey, p_type FROM part WHERE p_type GLOB '*[A-M]*N?C*' OR p_brand GLOB 'Brand#[!1]?'")
def glob(t: Tables) -> DataFrame:
    from lodestar.functions.strings import glob as matches

    return t.part.where(matches("p_type", "*[A-M]*N?C*") | matches("p_brand", "Brand#[!1]?")).select("p_partkey", "p_type")


@query("regexp_match", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '[aeiou]{2}.*[0-9]?$')")
def regexp(t: Tables) -> DataFrame:
    from lodestar.functions.strings import regexp as matches

    return t.part.where(matches("p_name", "[aeiou]{2}.*[0-9]?$")).select("p_partkey", "p_name")


@query("collate_nocase", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = lower('BuIlDiNg')")
def collate(t: Tables) -> DataFrame:
    return t.customer.where(F.collate("c_mktsegment", "UTF8_LCASE") == F.collate(F.lit("BuIlDiNg"), "UTF8_LCASE")).select("c_custkey", "c_mktsegment")


@query("collate_rtrim", "SELECT count(*) AS n FROM customer WHERE rtrim(c_mktsegment || '  ') = 'BUILDING'")
def collate_rtrim(t: Tables) -> DataFrame:
    padded = F.collate(F.concat("c_mktsegment", F.lit("  ")), "UTF8_BINARY_RTRIM")
    return t.customer.where(padded == F.collate(F.lit("BUILDING"), "UTF8_BINARY_RTRIM")).agg(F.count("*").alias("n"))


same("case_expr", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS status,
CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders""", "orders")
same("cast_mix", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS q, CAST(l_orderkey AS VARCHAR(20)) AS k, CAST(l_linenumber AS DOUBLE) AS d,
CAST(l_shipdate AS DATE) AS day, CAST(l_discount > 0.05 AS BOOLEAN) AS b FROM lineitem""", "lineitem")
same("null_logic", """SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS seg, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS filled,
NULLIF(c_mktsegment, 'BUILDING') IS NULL AS missing, NULLIF(c_nationkey, 3) IS DISTINCT FROM 4 AS differs FROM customer""", "customer")
same("arithmetic", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity + 1 AS plus, l_quantity - 2 AS minus, l_quantity * 3 AS times, l_quantity / 4 AS quarter,
CAST(l_linenumber % 3 AS BIGINT) AS rem, -l_quantity AS neg FROM lineitem""", "lineitem")


@query("values_rel", "SELECT * FROM (VALUES (1::BIGINT, 'x'), (2, 'y'), (3, NULL)) AS t(id, name)")
def values(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT * FROM VALUES (1L, 'x'), (2L, 'y'), (3L, NULL) AS t(id, name)")


same("derived_table", "SELECT s.c_nationkey, s.n, s.total FROM (SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey) s WHERE s.n > 50", "customer")


@query("view_scan", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_nationkey = 7")
def view_scan(t: Tables) -> DataFrame:
    t.customer.where("c_acctbal > 5000").createOrReplaceTempView("rich_customers")
    return t.spark.sql("SELECT c_custkey, c_acctbal FROM rich_customers WHERE c_nationkey = 7")


@query("named_parameters", "SELECT c_custkey FROM customer WHERE c_nationkey = 5 AND c_acctbal >= 1000")
def parameters(t: Tables) -> DataFrame:
    return t.views("customer").sql("SELECT c_custkey FROM customer WHERE c_nationkey = ? AND c_acctbal >= ?", args=[5, 1000])


@query("generated_columns", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 2, 2) AS twice, upper(l_returnflag) || '-' || l_linestatus AS tag FROM lineitem")
def generated(t: Tables) -> DataFrame:
    base = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    return base.withColumns({"twice": F.round(F.col("l_quantity") * 2, 2), "tag": F.concat(F.upper("l_returnflag"), F.lit("-"), "l_linestatus")}).drop("l_quantity", "l_returnflag", "l_linestatus")


# Joins
@query("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_inner(t: Tables) -> DataFrame:
    buyers = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return t.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 150000")
def join_left(t: Tables) -> DataFrame:
    large = t.orders.where("o_totalprice > 150000").select("o_custkey", "o_orderkey")
    return t.customer.select("c_custkey").join(large, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("join_right", "SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 3000) s RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(t: Tables) -> DataFrame:
    return t.supplier.where("s_acctbal > 3000").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("join_full", """SELECT c_custkey, s_suppkey, coalesce(c_nationkey, s_nationkey)::BIGINT AS nationkey FROM (SELECT * FROM customer WHERE c_nationkey < 15) c
FULL JOIN (SELECT * FROM supplier WHERE s_nationkey >= 10) s ON c_nationkey = s_nationkey""")
def join_full(t: Tables) -> DataFrame:
    c = t.customer.where("c_nationkey < 15").select("c_custkey", "c_nationkey")
    s = t.supplier.where("s_nationkey >= 10").select("s_suppkey", "s_nationkey")
    return joins.grouped(c, s, [("c_nationkey", "s_nationkey")], "full").select("c_custkey", "s_suppkey", F.coalesce("c_nationkey", "s_nationkey").cast(B).alias("nationkey"))


@query("join_cross", "SELECT a.r_name AS a, b.n_name AS b FROM region a CROSS JOIN nation b")
def join_cross(t: Tables) -> DataFrame:
    return t.region.select(F.col("r_name").alias("a")).crossJoin(t.nation.select(F.col("n_name").alias("b")))


@query("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("join_using", "SELECT k, c_name, s_name FROM (SELECT c_nationkey AS k, c_name FROM customer WHERE c_acctbal > 9000) JOIN (SELECT s_nationkey AS k, s_name FROM supplier) USING (k)")
def join_using(t: Tables) -> DataFrame:
    c = t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), "c_name")
    return joins.grouped(c, t.supplier.select(F.col("s_nationkey").alias("k2"), "s_name"), [("k", "k2")]).drop("k2")


@query("join_natural", "SELECT * FROM (SELECT n_nationkey AS nk, n_name FROM nation) NATURAL JOIN (SELECT s_nationkey AS nk, s_suppkey FROM supplier)")
def join_natural(t: Tables) -> DataFrame:
    return joins.natural(t.nation.select(F.col("n_nationkey").alias("nk"), "n_name"), t.supplier.select(F.col("s_nationkey").alias("nk"), "s_suppkey"))


@query("join_multiway", """SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def join_multiway(t: Tables) -> DataFrame:
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    buyers = t.customer.select("c_custkey", "c_nationkey").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    orders = t.orders.select("o_orderkey", "o_custkey").join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "r_name")
    return t.lineitem.select("l_orderkey", "l_extendedprice").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("join_theta_range", """SELECT p_partkey, band FROM part JOIN (VALUES ('a', 900.0, 1100.0), ('b', 1050.0, 1400.0), ('c', 1400.5, 2200.0)) AS b(band, lo, hi) ON p_retailprice >= lo AND p_retailprice <= hi""")
def join_range(t: Tables) -> DataFrame:
    bands = t.spark.sql("SELECT band, CAST(lo AS DOUBLE) lo, CAST(hi AS DOUBLE) hi FROM VALUES ('a', 900.0, 1100.0), ('b', 1050.0, 1400.0), ('c', 1400.5, 2200.0) AS b(band, lo, hi)")
    return joins.interval_join(t.part.select("p_partkey", "p_retailprice"), bands, "p_retailprice", "lo", "hi", 250.0).select("p_partkey", "band")


@query("join_asof", """SELECT e.event_id, e.user_id, p.event_id AS prev_purchase FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def join_asof(t: Tables) -> DataFrame:
    clicks = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = t.events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return joins.asof(clicks, bought, "ts", "ts", ["user_id"]).select("event_id", "user_id", F.col("r_event_id").alias("prev_purchase"))


@query("join_asof_global", """SELECT e.event_id, o.o_orderkey AS last_order FROM (SELECT event_id, ts - INTERVAL 8 YEAR AS ts FROM events) e
ASOF LEFT JOIN (SELECT o_orderdate AS ts, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_orderdate) o ON e.ts >= o.ts""")
def join_asof_global(t: Tables) -> DataFrame:
    e = t.events.select("event_id", F.expr("ts - INTERVAL 8 YEARS").alias("ts"))
    o = t.orders.groupBy(F.col("o_orderdate").alias("ts")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return joins.asof(e, o, "ts", "ts").select("event_id", F.col("r_o_orderkey").alias("last_order"))


@query("join_null_safe", """SELECT a.c_custkey, b.s_suppkey FROM (SELECT c_custkey, NULLIF(c_nationkey, 3) AS k FROM customer) a
JOIN (SELECT s_suppkey, NULLIF(s_nationkey, 3) AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k""")
def join_null_safe(t: Tables) -> DataFrame:
    a = t.customer.select("c_custkey", F.expr("nullif(c_nationkey, 3)").alias("k"))
    b = t.supplier.select("s_suppkey", F.expr("nullif(s_nationkey, 3)").alias("k2"))
    return joins.null_safe_equal(a, b, [("k", "k2")]).select("c_custkey", "s_suppkey")


@query("join_salted", "SELECT l_returnflag, count(*) AS n FROM lineitem JOIN (SELECT DISTINCT l_returnflag AS f FROM lineitem) ON l_returnflag = f GROUP BY l_returnflag")
def join_salted(t: Tables) -> DataFrame:
    flags = t.lineitem.select("l_returnflag").distinct()
    return joins.salted(t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber"), flags, "l_returnflag", 16, spread=["l_orderkey", "l_linenumber"]).groupBy("l_returnflag").agg(F.count("*").alias("n"))


# Subqueries
same("semi_in", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", "supplier", "nation")
same("semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", "customer", "orders")
same("anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)", "customer", "orders")
same("anti_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(s_nationkey, 5) FROM supplier WHERE s_acctbal < 0)", "nation", "supplier")
same("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)", "orders")
same("correlated_scalar", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer", "customer", "orders")
same("subquery_in_having", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > (SELECT count(*) / 25.0 FROM customer)", "customer")


@query("any_subquery", "SELECT p_partkey FROM part WHERE p_retailprice > ANY (SELECT p_retailprice + 90 FROM part WHERE p_size < 20)")
def any_subquery(t: Tables) -> DataFrame:
    return joins.quantified(t.part, F.col("p_retailprice"), ">", "ANY", t.part.where("p_size < 20").select(F.col("p_retailprice") + 90)).select("p_partkey")


@query("all_subquery", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 9 AND c_acctbal < 5000)")
def all_subquery(t: Tables) -> DataFrame:
    return joins.quantified(t.supplier, F.col("s_acctbal"), ">=", "ALL", t.customer.where("c_nationkey = 9 AND c_acctbal < 5000").select("c_acctbal")).select("s_suppkey")


@query("lateral_topn", "SELECT c_custkey, x.o_orderkey, x.o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) x WHERE c_nationkey = 4")
def lateral(t: Tables) -> DataFrame:
    best = relational.top_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2)
    return t.customer.where("c_nationkey = 4").join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


# Aggregation
same("agg_global", "SELECT count(*) AS n, sum(l_quantity) AS q, round(avg(l_extendedprice), 4) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem", "lineitem")
same("agg_empty", "SELECT count(*) AS n, count(l_orderkey) AS m, sum(l_quantity) AS q, max(l_orderkey) AS k FROM lineitem WHERE l_quantity < 0", "lineitem")
same("agg_group", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS sum_disc,
CAST(sum(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(18,6))) AS DOUBLE) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= DATE '2000-09-02' GROUP BY l_returnflag, l_linestatus""", "lineitem")
same("agg_group_expression", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, o_orderpriority, count(*) AS n FROM orders GROUP BY year(o_orderdate), o_orderpriority", "orders")
same("agg_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_suppkey", "lineitem")
same("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem", "lineitem")
same("agg_filter", """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS large,
count(*) AS n FROM orders GROUP BY o_orderpriority""", "orders")
same("agg_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 14 AND sum(o_totalprice) > 1000000", "orders")


@query("agg_string", "SELECT n_regionkey::BIGINT AS r, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(n_name, ' | ' ORDER BY n_name DESC) AS back FROM nation GROUP BY n_regionkey")
def agg_string(t: Tables) -> DataFrame:
    return t.sql("SELECT CAST(n_regionkey AS BIGINT) AS r, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, listagg(n_name, ' | ') WITHIN GROUP (ORDER BY n_name DESC) AS back FROM nation GROUP BY n_regionkey", "nation")


same("agg_stats", """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS va, round(stddev_pop(l_quantity), 6) AS sp, round(var_pop(l_quantity), 6) AS vp,
round(corr(l_quantity, l_extendedprice), 6) AS co, round(covar_samp(l_quantity, l_discount), 6) AS cv, median(l_quantity) AS md FROM lineitem GROUP BY l_returnflag""", "lineitem")
same("agg_stats_small", "SELECT o_orderkey, stddev_samp(o_totalprice) AS sd, var_samp(o_totalprice) AS va FROM orders GROUP BY o_orderkey", "orders")


@query("agg_percentile", "SELECT l_linestatus, quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.9) AS p90, mode() WITHIN GROUP (ORDER BY l_linenumber)::BIGINT AS common FROM lineitem GROUP BY l_linestatus")
def agg_percentile(t: Tables) -> DataFrame:
    common = t.lineitem.groupBy(F.col("l_linestatus").alias("status")).agg(F.mode("l_linenumber").cast(B).alias("common"))
    values = relational.percentiles(t.lineitem, ["l_linestatus"], "l_extendedprice", p25=0.25, p90=0.9)
    return values.join(common, F.col("l_linestatus").eqNullSafe(F.col("status"))).drop("status")


@query("agg_minmax_by", "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS dearest, min_by(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY o_custkey")
def agg_minmax_by(t: Tables) -> DataFrame:
    """Of orders of one price the smallest key counts, DuckDB's first; orders without a price don't."""
    at = lambda key: F.when(F.col("o_totalprice").isNotNull() & F.col("o_orderkey").isNotNull(), F.struct("o_totalprice", key))
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", at(-F.col("o_orderkey"))).alias("dearest"), F.min_by("o_orderkey", at(F.col("o_orderkey"))).alias("cheapest"))


same("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS BIGINT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
same("agg_cube", "SELECT c_mktsegment, CAST(c_nationkey AS BIGINT) AS nk, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)", "customer")
same("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "orders")


@query("agg_approx")
def agg_approx(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("orders"), F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("median"))


@query("agg_pivot", "SELECT c_nationkey::BIGINT AS nk, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY c_nationkey")
def agg_pivot(t: Tables) -> DataFrame:
    wide = t.customer.groupBy(F.col("c_nationkey").cast(B).alias("nk")).pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).count()
    return wide.select("nk", F.coalesce("BUILDING", F.lit(0)).alias("building"), F.coalesce("MACHINERY", F.lit(0)).alias("machinery"))


# Set operations
_A, _C = "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer", "SELECT CAST(s_nationkey % 12 AS BIGINT) AS k FROM supplier"
for _kind in ("UNION", "INTERSECT", "EXCEPT"):
    for _all in (False, True):
        query(f"setop_{_kind.lower()}{'_all' if _all else ''}", f"{_A} {_kind}{' ALL' if _all else ''} {_C}")(
            lambda t, kind=_kind, all_=_all: relational.set_operation(t.sql(_A, "customer"), t.sql(_C, "supplier"), kind, all_)
        )
same("setop_nulls", "SELECT NULLIF(n_regionkey, 1) AS k FROM nation INTERSECT SELECT NULLIF(r_regionkey, 1) AS k FROM region", "nation", "region")
same("setop_chain", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region EXCEPT SELECT 3", "nation", "region")


# Sort, limit, top-k
@query("order_nulls", "SELECT k, v FROM (SELECT c_custkey AS k, NULLIF(c_nationkey, 2)::BIGINT AS v FROM customer) ORDER BY v ASC NULLS LAST, k DESC LIMIT 40")
def order_nulls(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").alias("k"), F.expr("nullif(c_nationkey, 2)").cast(B).alias("v"))
    return relational.page(rows, [F.asc_nulls_last("v"), F.desc("k")], 40)


@query("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def limit_offset(t: Tables) -> DataFrame:
    return relational.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25, 10)


@query("topk", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 100")
def topk(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return relational.page(rows, [F.desc("l_extendedprice"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], 100)


@query("topk_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3")
def topk_group(t: Tables) -> DataFrame:
    return relational.top_per_group(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 3).select("c_nationkey", "c_custkey", "c_acctbal")


@query("dialect_limit_pair", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 5")
def dialect_limit(t: Tables) -> DataFrame:
    return run_sql(t.views("customer"), "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5, 7")


@query("dialect_mixed", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind, trunc(p_retailprice)::BIGINT AS whole FROM part WHERE p_brand GLOB 'Brand#1*' AND p_size >= ALL (SELECT 10)")
def dialect_mixed(t: Tables) -> DataFrame:
    return run_sql(t.views("part"), "SELECT p_partkey, IIF(p_size > 25, 'big', 'small') AS kind, TRUNCATE(p_retailprice, 0) AS whole FROM part WHERE p_brand GLOB 'Brand#1*' AND p_size >= ALL (SELECT 10)")


# CTEs
same("cte_multi", """WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), b AS (SELECT k, total FROM a WHERE total > 1500000)
SELECT c_name, round(total, 2) AS total FROM b JOIN customer ON c_custkey = k""", "orders", "customer")


@query("cte_recursive_sequence", "WITH RECURSIVE s(n, f) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM s WHERE n < 15) SELECT n, f FROM s")
def cte_sequence(t: Tables) -> DataFrame:
    return t.spark.sql("WITH RECURSIVE s(n, f) AS (SELECT 1L, 1L UNION ALL SELECT n + 1, f * (n + 1) FROM s WHERE n < 15) SELECT n, f FROM s")


_TREE = """SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR(20)) AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer"""


@query("cte_recursive_hierarchy", f"WITH RECURSIVE tree AS ({_TREE}), walk AS (SELECT id, 0::BIGINT AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT t.id, w.depth + 1 FROM tree t JOIN walk w ON t.parent = w.id) SELECT id, depth FROM walk")
def cte_hierarchy(t: Tables) -> DataFrame:
    t.sql(_TREE, "region", "nation", "customer").createOrReplaceTempView("tree")
    return t.spark.sql("WITH RECURSIVE walk AS (SELECT id, 0L AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT t.id, w.depth + 1 FROM tree t JOIN walk w ON t.parent = w.id) SELECT id, depth FROM walk")


@query("cte_recursive_distinct", """WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS a, (n_regionkey + 1) % 5 AS b FROM nation), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r""")
def cte_distinct(t: Tables) -> DataFrame:
    edges = t.nation.select(F.col("n_regionkey").alias("a"), ((F.col("n_regionkey") + 1) % 5).alias("b")).distinct()
    step = edges.select(F.col("a").alias("m"), F.col("b").alias("to"))
    return relational.fixpoint(edges, lambda new: new.join(step, new.b == step.m).select("a", "to"))


# Windows
_W = {
    "win_row_number": "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "win_rank_dense": "CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) * 10 + dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority)",
    "win_ntile": "ntile(7) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)",
    "win_count": "count(*) OVER (PARTITION BY o_custkey, o_orderstatus)",
}
for _name, _expr in _W.items():
    same(_name, f"SELECT o_orderkey, CAST({_expr} AS BIGINT) AS v FROM orders", "orders")
same("win_percent_cume", """SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice), 8) AS pr,
round(cume_dist() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice), 8) AS cd FROM orders""", "orders")
same("win_lag_lead", """SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2, -1) OVER w AS after2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""", "orders")
same("win_first_last_nth", """SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 3) OVER w AS n3 FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", "orders")
same("win_running_sum", """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS s,
round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 2) AS rest FROM orders""", "orders")
same("win_moving_avg", """SELECT o_orderkey, round(avg(o_totalprice) OVER w, 4) AS a, min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi, count(*) OVER w AS n FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""", "orders")
same("win_range_frame", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM lineitem", "lineitem")


@query("win_ignore_nulls", """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen,
lag(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events""")
def win_ignore_nulls(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bought, clicked = F.when(F.col("event_type") == "purchase", F.col("event_id")), F.when(F.col("event_type") == "click", F.col("event_id"))
    return t.events.select("event_id", F.last(bought, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("seen"), F.last(clicked, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))


@query("win_filter", "SELECT o_orderkey, count(*) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_custkey) AS n FROM orders")
def win_filter(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.count(F.when(F.col("o_totalprice") > 100000, 1)).over(Window.partitionBy("o_custkey")).alias("n"))


# Forms of their own
same("scan_ordered", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey", "orders")
same("lateral_join", "SELECT c_custkey, x.n, x.top FROM customer, LATERAL (SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_custkey = c_custkey) x", "customer", "orders")
same("join_ordered", "SELECT n_name, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey ORDER BY n_name DESC, s_name LIMIT 50", "nation", "supplier")
same("not_patterns", "SELECT p_partkey FROM part WHERE p_type NOT LIKE 'PROMO%' AND NOT p_name LIKE '%q%'", "part")


@query("temp_table_scan", "SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def temp_table(t: Tables) -> DataFrame:
    t.customer.where("c_nationkey = 3").createOrReplaceTempView("temp_customers")
    return t.spark.table("temp_customers").select("c_custkey")


@query("dialect_not_patterns", "SELECT p_partkey FROM part WHERE NOT p_brand GLOB 'Brand#1*' AND NOT regexp_matches(p_name, '^[aeiou]')")
def dialect_not(t: Tables) -> DataFrame:
    return run_sql(t.views("part"), "SELECT p_partkey FROM part WHERE p_brand NOT GLOB 'Brand#1*' AND p_name NOT REGEXP '^[aeiou]'")


@query("dialect_power", "SELECT p_partkey, pow(p_size, 2)::DOUBLE AS sq FROM part")
def dialect_power(t: Tables) -> DataFrame:
    return run_sql(t.views("part"), "SELECT p_partkey, p_size ^ 2 AS sq FROM part")


@query("order_collate", "SELECT k, row_number() OVER (ORDER BY lower(k), k) AS place FROM (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS k FROM part)")
def order_collate(t: Tables) -> DataFrame:
    """ORDER BY .. COLLATE: upper and lower case are alike, the plain text decides ties."""
    k = F.expr("CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END")
    words = t.part.select(k.alias("k")).distinct()
    return words.withColumn("place", F.row_number().over(Window.orderBy(F.collate("k", "UTF8_LCASE"), "k")).cast(B))


@query("order_natural", "SELECT c_name FROM customer ORDER BY c_custkey DESC LIMIT 30")
def order_natural(t: Tables) -> DataFrame:
    return relational.page(t.customer.select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("s"), "c_name"), [F.desc(relational.natural_order("s"))], 30).select("c_name")


@query("sample_rows", "SELECT TRUE AS inside, 100::BIGINT AS shuffled")
def sample_rows(t: Tables) -> DataFrame:
    """SAMPLE and SHUFFLE: a tenth of the rows by chance, and 100 rows in an order by chance."""
    n = t.lineitem.count()
    part = t.lineitem.sample(0.1, 7).agg(F.count("*").between(int(n * 0.07), int(n * 0.13)).alias("inside"))
    return part.crossJoin(t.lineitem.orderBy(F.rand(3)).limit(100).agg(F.count("*").alias("shuffled")))
