"""Scans, predicates, joins, aggregation, windows, sorting, set operations and the TPC-H shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from .catalog import register, sql, table, views

# ---- TPC-H, trimmed to the columns at hand

sql(
    "q3_shipping_priority",
    """SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
    GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""",
)
sql(
    "q5_local_supplier_volume",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
      JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
      JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' GROUP BY n_name""",
)
sql(
    "q6_forecast_revenue",
    """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
      AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24""",
)
sql(
    "q10_returned_items",
    """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(c_acctbal, 2) AS c_acctbal, n_name
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
    WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
sql(
    "q14_promotion_effect",
    """SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END)
      / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
sql(
    "q15_top_supplier",
    """WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM lineitem GROUP BY l_suppkey)
    SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no
    WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""",
)
sql(
    "q17_small_quantity",
    """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE l_quantity < (SELECT 0.2 * avg(x.l_quantity) FROM lineitem x WHERE x.l_partkey = p_partkey)""",
)
sql(
    "q18_large_orders",
    """SELECT c_name, c_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice, sum(l_quantity) AS sum_qty
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
    GROUP BY c_name, c_custkey, o_orderkey, o_totalprice""",
)
sql(
    "q4_order_priority",
    """SELECT o_orderpriority, count(*) AS order_count FROM orders
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority""",
)
sql(
    "q7_volume_shipping",
    """SELECT s.n_name AS supp_nation, c.n_name AS cust_nation, year(l_shipdate) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
      JOIN nation s ON s_nationkey = s.n_nationkey JOIN nation c ON c_nationkey = c.n_nationkey
    WHERE s.n_name IN ('NATION_1', 'NATION_2', 'NATION_3') AND c.n_name IN ('NATION_4', 'NATION_5', 'NATION_6')
    GROUP BY s.n_name, c.n_name, year(l_shipdate)""",
)
sql(
    "q13_customer_distribution",
    """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer
      LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) c GROUP BY c_count""",
)
sql(
    "q19_discounted_revenue",
    """SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE (p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 1 AND 10 AND l_quantity BETWEEN 10 AND 20)
      OR (p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 20 AND 30)""",
)
sql(
    "q22_sales_opportunity",
    """SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
    WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_nationkey""",
)

# ---- projection, filter, predicates

sql("scan_project_filter", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
sql("scan_metadata_aggregate", "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n FROM orders")
sql("filter_compare", "SELECT o_orderkey FROM orders WHERE o_totalprice <> 0 AND o_orderkey >= 500 AND o_custkey >= 10 AND NOT o_orderkey = 7")
sql("filter_in_between", "SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice NOT BETWEEN 1000 AND 50000 AND o_custkey NOT IN (1, 2, 3)")
sql("filter_like_ilike", "SELECT p_partkey FROM part WHERE p_type LIKE 'S%' AND p_name ILIKE '%A%' AND p_brand NOT LIKE '%_3'")
sql(
    "three_valued_logic",
    """SELECT o_orderkey, (nullif(o_orderstatus, 'O') = 'F') AND o_totalprice > 1000 AS a, (nullif(o_orderstatus, 'O') = 'F') OR o_totalprice > 1000 AS o,
      NOT (nullif(o_orderstatus, 'O') = 'F') AS n, nullif(o_orderstatus, 'O') IS NULL AS isnull FROM orders""",
)
sql("unary_minus_arithmetic", "SELECT p_partkey, -p_size AS neg, p_size % 7 AS m, p_size + 1 AS plus, p_size * 2 - 3 AS mixed FROM part")
sql("int_division", "SELECT p_partkey, p_size div 7 AS q, (-p_size) div 7 AS nq FROM part", "SELECT p_partkey, p_size // 7 AS q, -(p_size // 7) AS nq FROM part")
sql(
    "case_expressions",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS simple,
      CASE WHEN o_totalprice > 200000 THEN 3 WHEN o_totalprice > 100000 THEN 2 ELSE 1 END AS searched FROM orders""",
)
sql("casts", "SELECT o_orderkey, CAST(o_totalprice AS bigint) AS whole, CAST(o_orderkey AS varchar(20)) AS txt, CAST(o_orderdate AS date) AS d FROM orders",
    "SELECT o_orderkey, CAST(trunc(o_totalprice) AS bigint) AS whole, CAST(o_orderkey AS varchar) AS txt, CAST(o_orderdate AS date) AS d FROM orders")
sql("string_concat", "SELECT c_custkey, c_name || '/' || c_mktsegment AS joined, nullif(c_mktsegment, 'BUILDING') || 'x' AS maybe FROM customer")
sql("array_subscript", "SELECT vec_id, element_at(embedding, 1) AS first, try_element_at(embedding, 1000) AS beyond FROM embeddings",
    "SELECT vec_id, embedding[1] AS first, embedding[1000] AS beyond FROM embeddings")
sql("json_get", "SELECT event_id, CAST(get_json_object(props, '$.k') AS bigint) AS k, get_json_object(props, '$.none') AS none FROM events",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS bigint) AS k, json_extract_string(props, '$.none') AS none FROM events")
sql("json_keys", "SELECT event_id, array_contains(json_object_keys(props), 'k') AS has_k FROM events", "SELECT event_id, list_contains(json_keys(props), 'k') AS has_k FROM events")
sql("interval_arithmetic", "SELECT event_id, ts + INTERVAL 3 HOURS AS later, ts - INTERVAL 2 DAYS AS earlier, CAST(ts AS date) AS d FROM events")
sql("scalar_subquery", "SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) AS above FROM orders")
sql("correlated_scalar_subquery", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
sql("exists_not_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
sql("in_not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("not_in_with_null", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation WHERE n_nationkey < 5)")
sql("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)")
sql("values_join", "SELECT r_name, t.w FROM region JOIN (VALUES (0, 10), (1, 20), (9, 30)) AS t(k, w) ON r_regionkey = t.k")


@register("parameters", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O'")
def _parameters(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 300000, "status": "O"})


# ---- joins

_C = "(SELECT * FROM customer WHERE c_acctbal > 0) c"
_O = "(SELECT * FROM orders WHERE o_orderstatus <> 'F') o"
for how in ("inner", "left", "right", "full"):
    sql(f"join_{how}", f"SELECT c_custkey, o_orderkey FROM {_C} {how.upper()} JOIN {_O} ON c.c_custkey = o.o_custkey")
sql("join_residual", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 20")
sql("join_cross", "SELECT r.r_name AS a, n.n_name AS b FROM region r CROSS JOIN nation n")
sql("join_comma", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
sql("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
sql("join_using", "SELECT k, v, w FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) a JOIN (SELECT r_regionkey AS k, r_name AS w FROM region) b USING (k)")
sql("join_natural", "SELECT * FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS w FROM region) b")
sql("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
sql("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
sql(
    "join_lateral",
    """SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders
      WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t""",
)
sql(
    "join_lateral_left",
    """SELECT c_custkey, t.n FROM customer LEFT JOIN LATERAL (SELECT count(*) AS n FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) t ON true""",
)
sql("join_derived_tables", """SELECT a.s, b.n FROM (SELECT o_orderstatus AS s, sum(o_totalprice) AS t FROM orders GROUP BY o_orderstatus) a
  JOIN (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY o_orderstatus) b ON a.s = b.s""")
sql("join_null_safe", "SELECT count(*) AS n FROM orders a JOIN (SELECT DISTINCT nullif(o_orderstatus, 'O') AS s FROM orders) b ON nullif(a.o_orderstatus, 'O') <=> b.s",
    "SELECT count(*) AS n FROM orders a JOIN (SELECT DISTINCT nullif(o_orderstatus, 'O') AS s FROM orders) b ON nullif(a.o_orderstatus, 'O') IS NOT DISTINCT FROM b.s")


@register(
    "join_range",
    """SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click'
    AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 1 HOUR""",
)
def _range(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    left = e.filter("event_type = 'click'").select(F.col("event_id").alias("a"), "user_id", F.col("ts").alias("start"))
    right = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("b"), "user_id", F.col("ts").alias("at"))
    left = left.withColumn("until", F.expr("start + INTERVAL 1 HOUR"))
    return R.range_join(left, right, "start", "until", "at", ["user_id"], width_seconds=3600).select("a", "b")


_ASOF = """SELECT a.event_id, a.user_id, b.event_id AS last_view, b.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') a {how} JOIN (SELECT * FROM events WHERE event_type = 'view') b
ON a.user_id = b.user_id AND a.ts >= b.ts"""


@register("join_asof", _ASOF.format(how="ASOF LEFT"))
def _asof(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    left = e.filter("event_type = 'purchase'").drop("event_type", "value")
    right = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("last_view"), F.col("value").alias("view_value"))
    return R.asof_join(left, right, ["user_id"], "ts", "ts").select("event_id", "user_id", "last_view", "view_value")


# ---- aggregation

sql("agg_hash", "SELECT o_orderstatus, count(*) AS n, count(nullif(o_orderpriority, '1-URGENT')) AS n2, sum(o_orderkey) AS s, round(avg(o_totalprice), 4) AS a, min(o_orderdate) AS lo, max(o_orderpriority) AS hi FROM orders GROUP BY o_orderstatus")
sql("agg_global_empty", "SELECT count(*) AS n, sum(o_orderkey) AS s, max(o_totalprice) AS m FROM orders WHERE o_orderkey < 0")
sql("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, sum(DISTINCT o_custkey) AS s FROM orders GROUP BY o_orderstatus")
sql("agg_stddev_variance", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag")
sql("agg_correlation_covariance", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_extendedprice), 2) AS c FROM lineitem GROUP BY l_returnflag")
sql("agg_first_last", "SELECT user_id, min_by(event_type, ts) AS first, max_by(event_type, ts) AS last FROM events GROUP BY user_id", "SELECT user_id, arg_min(event_type, ts) AS first, arg_max(event_type, ts) AS last FROM events GROUP BY user_id")
sql("agg_having_order", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 5 ORDER BY n DESC, o_custkey")
sql("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS g1, grouping(o_orderpriority) AS g2 FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS gid FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, sum(o_orderkey) AS s FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql("agg_filter_clause", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS bought FROM events GROUP BY user_id")
sql("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql("agg_time_weight", """SELECT user_id, round(sum(value * w) / sum(w), 6) AS time_weighted FROM (SELECT user_id, value, CAST(unix_micros(CAST(lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS timestamp)) - unix_micros(CAST(ts AS timestamp)) AS double) AS w FROM events) t WHERE w IS NOT NULL GROUP BY user_id""",
    """SELECT user_id, round(sum(value * w) / sum(w), 6) AS time_weighted FROM (SELECT user_id, value, CAST(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts) AS double) AS w FROM events) t WHERE w IS NOT NULL GROUP BY user_id""")


@register("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def _distinct_on(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.distinct_on(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@register("agg_user_defined", "SELECT o_orderstatus, CAST(sum(o_orderkey % 100 * (o_orderkey % 100)) AS bigint) AS squares FROM orders GROUP BY o_orderstatus")
def _user_aggregate(spark, sf_dir):
    """A user-defined aggregate: initial state, step, combine, final."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_orderkey") % 100).alias("x"))
    return R.user_aggregate(o, ["o_orderstatus"], "x", 0, lambda s, x: s + x * x, lambda a, b: a + b, lambda s: s, "long", "squares")


# ---- windows

_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
sql("window_ranking", f"""SELECT o_orderkey, row_number() OVER ({_W}) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk,
  dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, round(percent_rank() OVER ({_W}), 6) AS pr, round(cume_dist() OVER ({_W}), 6) AS cd,
  ntile(4) OVER ({_W}) AS nt FROM orders""")
sql("window_ntile_even", f"""SELECT o_orderkey, CAST(floor((row_number() OVER ({_W}) - 1) * 4 / count(*) OVER (PARTITION BY o_custkey)) AS bigint) + 1 AS bucket FROM orders""")
sql("window_lag_lead", f"SELECT o_orderkey, lag(o_totalprice) OVER ({_W}) AS lag1, lead(o_totalprice, 2) OVER ({_W}) AS lead2 FROM orders")
sql("window_first_last_nth", f"""SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS second FROM orders
  WINDOW w AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
sql("window_running_aggregates", f"""SELECT o_orderkey, count(*) OVER w AS n, sum(o_custkey) OVER w AS s, round(sum(o_totalprice) OVER w, 2) AS t, min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi
  FROM orders WINDOW w AS ({_W})""")
sql("window_rows_frame", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s FROM orders")
sql("window_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events")
sql("window_range_numeric", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM part")
sql("window_stddev_variance", f"SELECT o_orderkey, round(stddev_samp(o_totalprice) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS sd FROM orders")
sql("window_delta", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts), 6) AS delta FROM events")
sql("window_rate", """SELECT event_id, round((value - lag(value) OVER w) / ((unix_micros(CAST(ts AS timestamp)) - unix_micros(CAST(lag(ts) OVER w AS timestamp))) / 1000000.0D), 6) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
    """SELECT event_id, round((value - lag(value) OVER w) / ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0::DOUBLE), 6) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
sql("window_moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS ma FROM events")
sql("window_qualify", f"SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER ({_W}) AS rn FROM orders) t WHERE rn = 2", f"SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER ({_W}) = 2")
sql("window_zscore", """SELECT event_id, round(CASE WHEN stddev_pop(value) OVER w = 0 THEN 0 ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)""")

# ---- sorting and limits

sql("sort_nulls_last", "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders ORDER BY s DESC NULLS LAST, o_orderkey LIMIT 50")
sql("sort_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql("sort_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30")
sql("sort_alias_ordinal", "SELECT o_orderkey AS k, o_custkey * 2 AS c FROM orders ORDER BY c, 1 LIMIT 40")


@register("sort_with_ties", "SELECT o_orderkey, p FROM (SELECT o_orderkey, o_orderpriority AS p, rank() OVER (ORDER BY o_orderpriority, o_custkey) AS r FROM orders) t WHERE r <= 10")
def _ties(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"), "o_custkey")
    return R.limit_with_ties(o, ["p", "o_custkey"], 10).select("o_orderkey", "p")


# ---- set operations and common table expressions

_A, _B = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'"


def _of_sets(name: str, a: str, word: str, b: str) -> None:
    """INTERSECT and EXCEPT are joins of rows: both sides are made distinct first, so a frequent value is one row."""

    def run(spark, sf_dir):
        views(spark, sf_dir, f"{a} {b}")
        left, right = spark.sql(a).distinct(), spark.sql(b).distinct()
        return left.intersect(right) if word == "INTERSECT" else left.subtract(right)

    register(name, f"({a}) {word} ({b})")(run)


for name, word in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    (_of_sets if word in ("INTERSECT", "EXCEPT") else lambda n, a, w, b: sql(n, f"({a}) {w} ({b})"))(f"set_{name}", _A, word, _B)
_of_sets("set_nulls_equal", "SELECT nullif(o_orderstatus, 'O') AS s FROM orders", "INTERSECT", "SELECT nullif(o_orderstatus, 'F') AS s FROM orders")
sql("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS c FROM per GROUP BY n")
sql("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS bigint), CAST(1 AS bigint) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")


@register("view_over_view", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 4 GROUP BY n_regionkey")
def _view(spark, sf_dir):
    table(spark, sf_dir, "nation").filter("n_nationkey > 4").createOrReplaceTempView("some_nations")
    return spark.sql("SELECT n_regionkey, count(*) AS n FROM some_nations GROUP BY n_regionkey")
