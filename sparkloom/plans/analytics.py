"""Analytics table functions, features, models and causal estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from .catalog import register, table

_COHORT = """WITH f AS (SELECT user_id, date_trunc('week', min(ts)) AS cohort FROM events GROUP BY 1), r AS (SELECT cohort, date_diff('day', cohort, date_trunc('week', ts)) // 7 AS period, e.user_id, value FROM events e JOIN f USING (user_id)),
  g AS (SELECT cohort, unnest(range(0, 5)) AS period FROM (SELECT DISTINCT cohort FROM f) t), v AS (SELECT cohort, period, {value} AS value FROM r GROUP BY 1, 2)
  SELECT g.cohort, g.period, coalesce(v.value, 0) AS value FROM g LEFT JOIN v ON g.cohort = v.cohort AND g.period = v.period"""


@register("cohort_retention", _COHORT.format(value="count(DISTINCT user_id)"))
def _cohort(spark, sf_dir):
    return A.cohort_retention(table(spark, sf_dir, "events"), "user_id", "ts", "week", 5).withColumn("cohort", F.col("cohort").cast("timestamp_ntz"))


@register("cohort_revenue", _COHORT.format(value="round(sum(value), 2)"))
def _cohort_revenue(spark, sf_dir):
    got = A.cohort_retention(table(spark, sf_dir, "events"), "user_id", "ts", "week", 5, "value")
    return got.select(F.col("cohort").cast("timestamp_ntz").alias("cohort"), "period", F.round("value", 2).alias("value"))


_FUNNEL = """WITH s1 AS (SELECT user_id, min(ts) AS t1 FROM events WHERE event_type = 'view' GROUP BY 1),
 s2 AS (SELECT s1.user_id, t1, min(ts) AS t2 FROM s1 JOIN events e ON e.user_id = s1.user_id AND e.event_type = 'click' AND e.ts > t1 AND e.ts <= t1 + INTERVAL 1 DAY GROUP BY 1, 2),
 s3 AS (SELECT s2.user_id, t1, t2, min(ts) AS t3 FROM s2 JOIN events e ON e.user_id = s2.user_id AND e.event_type = 'purchase' AND e.ts > t2 AND e.ts <= t1 + INTERVAL 1 DAY GROUP BY 1, 2, 3),
 n AS (SELECT (SELECT count(*) FROM s1) AS a, (SELECT count(*) FROM s2) AS b, (SELECT count(*) FROM s3) AS c, (SELECT avg((epoch_us(t2) - epoch_us(t1)) / 1000) FROM s2) AS g1, (SELECT avg((epoch_us(t3) - epoch_us(t2)) / 1000) FROM s3) AS g2)
 SELECT 1 AS step, a AS users_count, 1.0::DOUBLE AS conversion_rate, round(1 - b / a::DOUBLE, 6) AS drop_off_rate, round(g1, 2) AS avg_time_to_next_ms FROM n
 UNION ALL SELECT 2, b, round(b / a::DOUBLE, 6), round(1 - c / b::DOUBLE, 6), round(g2, 2) FROM n UNION ALL SELECT 3, c, round(c / a::DOUBLE, 6), 0.0, NULL FROM n"""


@register("funnel_analysis", _FUNNEL)
def _funnel(spark, sf_dir):
    got = A.funnel(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", ["view", "click", "purchase"], tie="event_id")
    return got.select("step", "users_count", *[F.round(c, n).alias(c) for c, n in (("conversion_rate", 6), ("drop_off_rate", 6), ("avg_time_to_next_ms", 2))])


@register("data_profile", """SELECT 'o_orderkey' AS column_name, 'bigint' AS data_type, count(*) - count(o_orderkey) AS null_count, count(DISTINCT o_orderkey) AS distinct_count, round(avg(o_orderkey), 4) AS mean, round(quantile_cont(o_orderkey, 0.5), 4) AS median, round(stddev_samp(o_orderkey), 4) AS stddev FROM orders
  UNION ALL SELECT 'o_orderstatus', 'string', count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), NULL, NULL, NULL FROM orders
  UNION ALL SELECT 'o_totalprice', 'double', count(*) - count(o_totalprice), count(DISTINCT o_totalprice), round(avg(o_totalprice), 4), round(quantile_cont(o_totalprice, 0.5), 4), round(stddev_samp(o_totalprice), 4) FROM orders""")
def _profile(spark, sf_dir):
    got = A.data_profile(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    return got.select("column_name", "data_type", "null_count", "distinct_count", *[F.round(c, 4).alias(c) for c in ("mean", "median", "stddev")])


@register("correlation_matrix", """SELECT 'l_quantity' AS col_a, 'l_quantity' AS col_b, 1.0::DOUBLE AS correlation UNION ALL SELECT 'l_quantity', 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 6) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0 UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_tax', 'l_tax', 1.0""")
def _correlations(spark, sf_dir):
    got = A.correlation_matrix(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return got.withColumn("correlation", F.round("correlation", 6))


@register("correlation_spearman", """WITH r AS (SELECT (rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0)::DOUBLE AS a, (rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0)::DOUBLE AS b FROM part)
  SELECT round(corr(a, b), 6) AS rho FROM r""")
def _spearman(spark, sf_dir):
    got = A.correlation_matrix(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], "spearman")
    return got.filter("col_a <> col_b").select(F.round("correlation", 6).alias("rho"))


_DAYS = "WITH d AS (SELECT event_type, ts::DATE AS d, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY 1, 2)"


@register("correlation_kendall", f"""{_DAYS}, p AS (SELECT event_type, sign(a.n - b.n) AS x, sign(a.s - b.s) AS y FROM d a JOIN d b USING (event_type) WHERE a.d < b.d)
  SELECT event_type, round(sum(x * y) / nullif(sqrt(sum(abs(x)) * sum(abs(y))), 0), 6) AS tau FROM p GROUP BY 1""")
def _kendall(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("s"))
    return A.kendall_tau(d, ["event_type"], "n", "s", "d").withColumn("tau", F.round("tau", 6))


@register("mutual_information", """WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem),
  j AS (SELECT least(floor((l_quantity::DOUBLE - a) / (b - a)::DOUBLE * 10), 9) AS i, least(floor((l_extendedprice::DOUBLE - c) / (d - c)::DOUBLE * 10), 9) AS k, count(*)::DOUBLE AS n FROM lineitem, e GROUP BY 1, 2),
  p AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY i) AS px, sum(n) OVER (PARTITION BY k) AS py FROM j) SELECT round(sum(n / t * ln(n * t / (px * py))), 6) AS mutual_information FROM p""")
def _mutual(spark, sf_dir):
    return A.mutual_information(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").withColumn("mutual_information", F.round("mutual_information", 6))


@register("polynomial_features", """SELECT p_partkey, p_size * p_size AS "p_size*p_size", round(p_size * p_retailprice, 4) AS "p_size*p_retailprice" FROM part""")
def _polynomial(spark, sf_dir):
    got = A.polynomial_features(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return got.select("p_partkey", "`p_size*p_size`", F.round("`p_size*p_retailprice`", 4).alias("p_size*p_retailprice"))


@register("features_latest", "SELECT user_id, event_type, arg_max(value, ts) AS value FROM events GROUP BY 1, 2")
def _latest(spark, sf_dir):
    return A.latest_features(table(spark, sf_dir, "events"), "user_id", "event_type", "value", "ts")


@register("features_point_in_time", "SELECT a.event_id, b.value AS feature FROM (SELECT * FROM events WHERE event_type = 'error') a ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'signup') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def _pit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    features = e.filter("event_type = 'signup'").select("user_id", "ts", F.col("value").alias("feature"))
    return A.point_in_time(features, e.filter("event_type = 'error'").select("event_id", "user_id", "ts"), "user_id", "ts", "ts").select("event_id", "feature")


@register("features_parity", "SELECT o_custkey, max(o_totalprice) AS offline, max(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) AS online FROM orders GROUP BY 1 HAVING max(o_totalprice) IS DISTINCT FROM max(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END)")
def _parity(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    offline = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    online = o.groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))).alias("v"))
    return A.feature_parity(offline, online, ["o_custkey"], "v")


@register("trend", "SELECT event_type, round(regr_slope(value, epoch_us(ts) / 1e6), 12) AS slope, round(regr_r2(value, epoch_us(ts) / 1e6), 8) AS r2 FROM events GROUP BY 1")
def _trend(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return A.linear_trend(e, ["event_type"], "x", "value").select("event_type", F.round("slope", 12).alias("slope"), F.round("r2", 8).alias("r2"))


@register("forecast_ses", """WITH RECURSIVE d AS (SELECT event_type, ts::DATE AS d, count(*)::DOUBLE AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts::DATE) AS rn FROM events GROUP BY 1, 2), r AS (SELECT event_type, rn, n AS s FROM d WHERE rn = 1
  UNION ALL SELECT d.event_type, d.rn, 0.3::DOUBLE * d.n + 0.7::DOUBLE * r.s FROM r JOIN d ON d.event_type = r.event_type AND d.rn = r.rn + 1) SELECT event_type, unnest([1, 2, 3]) AS step, round(arg_max(s, rn), 6) AS value FROM r GROUP BY event_type""")
def _forecast(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("n"))
    return A.forecast(d, ["event_type"], "d", "n", 3).withColumn("value", F.round("value", 6))


@register("forecast_holt", """WITH RECURSIVE d AS (SELECT event_type, ts::DATE AS d, count(*)::DOUBLE AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts::DATE) - 1 AS i FROM events GROUP BY 1, 2),
  r AS (SELECT a.event_type, a.i, a.n AS l, coalesce(b.n - a.n, 0) AS b FROM d a LEFT JOIN d b ON b.event_type = a.event_type AND b.i = 1 WHERE a.i = 0
    UNION ALL SELECT event_type, i, l, 0.1::DOUBLE * (l - l0) + 0.9::DOUBLE * b AS b FROM (SELECT d.event_type, d.i, r.l AS l0, r.b, 0.3::DOUBLE * d.n + 0.7::DOUBLE * (r.l + r.b) AS l FROM r JOIN d ON d.event_type = r.event_type AND d.i = r.i + 1) t)
  SELECT event_type, h::INT AS step, round(l + h * b, 6) AS value FROM (SELECT event_type, arg_max(l, i) AS l, arg_max(b, i) AS b FROM r GROUP BY 1) z, range(1, 4) t(h)""")
def _holt(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("n"))
    return A.forecast(d, ["event_type"], "d", "n", 3, "holt").withColumn("value", F.round("value", 6))


@register("autocorrelation", """WITH d AS (SELECT event_type, ts::DATE AS d, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), c AS (SELECT event_type, d, n - avg(n) OVER (PARTITION BY event_type) AS x FROM d),
  l AS (SELECT event_type, x, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2 FROM c WINDOW w AS (PARTITION BY event_type ORDER BY d)) SELECT event_type, 1 AS lag, round(sum(x * l1) / sum(x * x), 6) AS value FROM l GROUP BY 1 UNION ALL SELECT event_type, 2, round(sum(x * l2) / sum(x * x), 6) FROM l GROUP BY 1""")
def _acf(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(F.count("*").cast("double").alias("n"))
    return A.autocorrelation(d, ["event_type"], "d", "n", 2).withColumn("value", F.round("value", 6))


@register("change_points", """WITH RECURSIVE d AS (SELECT event_type, ts::DATE AS d, round(sum(value), 4) AS s FROM events GROUP BY 1, 2),
  x AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY d) - 1 AS i, s - avg(s) OVER (PARTITION BY event_type) AS x FROM d),
  r AS (SELECT event_type, i, x AS t FROM x WHERE i = 0 UNION ALL SELECT x.event_type, x.i, (CASE WHEN abs(r.t) > 100 THEN 0 ELSE r.t END) + x.x FROM r JOIN x ON x.event_type = r.event_type AND x.i = r.i + 1)
  SELECT event_type, i AS idx FROM r WHERE abs(t) > 100""")
def _changes(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(F.round(F.sum("value"), 4).alias("s"))
    return A.change_points(d, ["event_type"], "d", "s", 100.0)


@register("effect_on_treated", """WITH e AS (SELECT value, user_id % 2 AS t, CASE WHEN event_type = 'view' THEN 0.6 ELSE 0.4 END::DOUBLE AS e FROM events)
  SELECT round(avg(value) FILTER (WHERE t = 1) - sum(value * e / (1 - e)) FILTER (WHERE t = 0) / sum(e / (1 - e)) FILTER (WHERE t = 0), 6) AS att FROM e""")
def _att(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("value", (F.col("user_id") % 2).alias("t"), F.when(F.col("event_type") == "view", 0.6).otherwise(0.4).alias("e"))
    return A.effect_on_treated(e, "t", "value", F.col("e")).select(F.round("att", 6).alias("att"))


_TOP = "SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS k FROM part WHERE p_brand IS NOT NULL GROUP BY 1"


@register("column_profile", f"""WITH t AS ({_TOP}) SELECT 'row_count' AS statistic, count(*)::VARCHAR AS value FROM part UNION ALL SELECT 'null_count', (count(*) - count(p_brand))::VARCHAR FROM part
  UNION ALL SELECT 'distinct_count', count(DISTINCT p_brand)::VARCHAR FROM part UNION ALL SELECT 'min', min(p_brand) FROM part UNION ALL SELECT 'max', max(p_brand) FROM part
  UNION ALL SELECT 'top_' || k, p_brand FROM t WHERE k <= 3""")
def _column_profile(spark, sf_dir):
    return A.column_profile(table(spark, sf_dir, "part"), "p_brand")


@register("population_stability", """WITH b AS (SELECT (value >= 25)::INT + (value >= 50)::INT + (value >= 75)::INT AS bin, event_type = 'view' AS e, event_type = 'click' AS a FROM events), c AS (SELECT bin, count(*) FILTER (WHERE e) AS e, count(*) FILTER (WHERE a) AS a FROM b GROUP BY 1),
  t AS (SELECT sum(e) AS se, sum(a) AS sa FROM c) SELECT round(sum((greatest(a, 0.5) / sa - greatest(e, 0.5) / se) * ln((greatest(a, 0.5) / sa) / (greatest(e, 0.5) / se))), 8) AS psi FROM c, t""")
def _psi(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return A.psi(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), "value", [25, 50, 75]).select(F.round("psi", 8).alias("psi"))


@register("ks_test", """WITH u AS (SELECT value, sum((event_type = 'view')::INT) AS x, sum((event_type = 'click')::INT) AS y FROM events WHERE event_type IN ('view', 'click') GROUP BY 1), c AS (SELECT sum(x) OVER (ORDER BY value) / (SELECT sum(x) FROM u) AS cx, sum(y) OVER (ORDER BY value) / (SELECT sum(y) FROM u) AS cy FROM u)
  SELECT round(max(abs(cx - cy)), 8) AS ks FROM c""")
def _ks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return A.ks_test(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), "value").select(F.round("ks", 8).alias("ks"))


@register("diff_in_diff", """SELECT round((avg(value) FILTER (WHERE user_id % 2 = 1 AND ts >= TIMESTAMP '2024-01-15') - avg(value) FILTER (WHERE user_id % 2 = 1 AND ts < TIMESTAMP '2024-01-15')) - (avg(value) FILTER (WHERE user_id % 2 = 0 AND ts >= TIMESTAMP '2024-01-15') - avg(value) FILTER (WHERE user_id % 2 = 0 AND ts < TIMESTAMP '2024-01-15')), 6) AS effect FROM events""")
def _did(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("value", (F.col("user_id") % 2).alias("t"), (F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).cast("int").alias("p"))
    return A.diff_in_diff(e, "t", "p", "value").select(F.round("effect", 6).alias("effect"))


@register("average_treatment_effect", "SELECT round(avg(value) FILTER (WHERE user_id % 2 = 1) - avg(value) FILTER (WHERE user_id % 2 = 0), 6) AS ate FROM events")
def _ate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("value", (F.col("user_id") % 2).alias("t"))
    return A.average_treatment_effect(e, "t", "value", F.lit(0.5)).select(F.round("ate", 6).alias("ate"))


@register("date_features", "SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, extract(dow FROM ts) AS dow, hour(ts) AS hour, extract(dow FROM ts) IN (0, 6) AS is_weekend, dayofyear(ts) AS doy, week(ts) AS woy, quarter(ts) AS quarter FROM events")
def _date_features(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in A.date_features(F.col("ts")).items()])


@register("model_linear", "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem) SELECT round(a, 3) AS slope, round(b, 2) AS intercept FROM m")
def _linear(spark, sf_dir):
    model = A.train(table(spark, sf_dir, "lineitem"), "linear", ["l_quantity"], "l_extendedprice", solver="normal").stages[-1]
    return spark.createDataFrame([(round(float(model.coefficients[0]), 3), round(float(model.intercept), 2))], "slope double, intercept double")


@register("model_tree_predictions")
def _tree(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return A.predict(A.train(part, "tree", ["p_size"], "p_retailprice", maxDepth=4), part).select("p_partkey", "prediction")
