"""Time series: buckets, gaps, smoothing, period comparison, outliers; and windows of streams, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as T
from ..streaming import windows as S
from .catalog import register, table


def _daily(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("n"))


_GAPS = """WITH g AS (SELECT user_id, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1, 2),
 span AS (SELECT user_id, min(bucket) AS lo, max(bucket) AS hi FROM g GROUP BY 1), grid AS (SELECT user_id, unnest(range(lo, hi + INTERVAL 1 SECOND, INTERVAL 12 HOUR)) AS bucket FROM span)
 SELECT user_id, bucket, n, s FROM grid LEFT JOIN g USING (user_id, bucket)"""


def _filled(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return T.gapfill(e, ["user_id"], "ts", 43_200, [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s")])


@register("gapfill", _GAPS)
def _gapfill(spark, sf_dir):
    return _filled(spark, sf_dir).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@register("gapfill_locf", f"WITH f AS ({_GAPS}) SELECT user_id, bucket, last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS s FROM f")
def _locf(spark, sf_dir):
    return _filled(spark, sf_dir).select("user_id", F.col("bucket").cast("timestamp_ntz").alias("bucket"), T.locf("s", ["user_id"], "bucket").alias("s"))


@register("gapfill_interpolate", f"""WITH f AS ({_GAPS}), k AS (SELECT *, max(CASE WHEN s IS NOT NULL THEN bucket END) OVER (PARTITION BY user_id ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS t0,
  min(CASE WHEN s IS NOT NULL THEN bucket END) OVER (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1,
  last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS s0, first_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s1 FROM f)
  SELECT user_id, bucket, round(coalesce(s, s0 + (s1 - s0) * (epoch_us(bucket) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))), 4) AS s FROM k""")
def _interpolate(spark, sf_dir):
    return _filled(spark, sf_dir).select("user_id", F.col("bucket").cast("timestamp_ntz").alias("bucket"), F.round(T.interpolate("s", ["user_id"], "bucket"), 4).alias("s"))


@register("window_ema", """WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  r AS (SELECT event_id, user_id, rn, value::DOUBLE AS s FROM e WHERE rn = 1 UNION ALL SELECT e.event_id, e.user_id, e.rn, 0.5::DOUBLE * e.value + 0.5::DOUBLE * r.s FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
  SELECT event_id, round(s + 1e-9, 3) AS ema FROM r""")
def _ema(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return T.ema(e, ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round(F.col("ema") + 1e-9, 3).alias("ema"))


@register("lttb")
def _lttb(spark, sf_dir):
    return T.lttb(table(spark, sf_dir, "events").select("event_type", "ts", "value"), ["event_type"], "ts", "value", 50)


_DAILY = "WITH d AS (SELECT event_type, ts::DATE AS d, count(*) AS n FROM events GROUP BY 1, 2)"


@register("period_week_over_week", f"{_DAILY} SELECT a.event_type, a.d, a.n, b.n AS prior, round((a.n - b.n) / b.n::DOUBLE, 6) AS growth FROM d a LEFT JOIN d b ON a.event_type = b.event_type AND b.d = a.d - 7")
def _wow(spark, sf_dir):
    got = T.period_compare(_daily(spark, sf_dir), ["event_type"], "d", "n", F.date_sub("d", 7))
    return got.withColumn("growth", F.round((F.col("n") - F.col("prior")) / F.nullif(F.col("prior"), F.lit(0)), 6))


@register("period_month_over_month", """WITH d AS (SELECT o_orderpriority, date_trunc('month', o_orderdate)::DATE AS d, count(*) AS n FROM orders GROUP BY 1, 2)
  SELECT a.o_orderpriority, a.d, a.n, b.n AS prior FROM d a LEFT JOIN d b ON a.o_orderpriority = b.o_orderpriority AND b.d = (a.d - INTERVAL 1 MONTH)::DATE""")
def _mom(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").cast("date").alias("d")).agg(F.count("*").alias("n"))
    return T.period_compare(d, ["o_orderpriority"], "d", "n", F.add_months("d", -1))


@register("period_to_date", f"{_DAILY} SELECT event_type, d, CAST(sum(n) OVER (PARTITION BY event_type, date_trunc('month', d) ORDER BY d) AS BIGINT) AS mtd, CAST(sum(n) OVER (PARTITION BY event_type, date_trunc('year', d) ORDER BY d) AS BIGINT) AS ytd FROM d")
def _to_date(spark, sf_dir):
    d = _daily(spark, sf_dir)
    return d.select("event_type", "d", T.to_date_sum("n", ["event_type"], "d", "month").alias("mtd"), T.to_date_sum("n", ["event_type"], "d", "year").alias("ytd"))


@register("period_yoy_growth", """WITH d AS (SELECT o_orderpriority, date_trunc('month', o_orderdate)::DATE AS d, count(*) AS n FROM orders GROUP BY 1, 2)
  SELECT a.o_orderpriority, a.d, round((a.n - b.n) / nullif(b.n, 0)::DOUBLE, 6) AS growth FROM d a LEFT JOIN d b ON a.o_orderpriority = b.o_orderpriority AND b.d = (a.d - INTERVAL 1 YEAR)::DATE""")
def _yoy_growth(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").cast("date").alias("d")).agg(F.count("*").alias("n"))
    return T.period_growth(d, ["o_orderpriority"], "d", "n", F.add_months("d", -12)).select("o_orderpriority", "d", F.round("growth", 6).alias("growth"))


@register("window_derivative", """SELECT event_id, round((value - lag(value) OVER w) / ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0::DOUBLE), 6) AS slope FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _derivative(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(T.derivative("value", ["user_id"], "ts", "event_id"), 6).alias("slope"))


@register("anomaly_zscore", """WITH m AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)
  SELECT event_id, round(abs(value - m) / nullif(s, 0), 6) AS score, coalesce(abs(value - m) / nullif(s, 0) > 2, false) AS is_anomaly FROM events JOIN m USING (event_type)""")
def _anomaly(spark, sf_dir):
    return T.anomalies(table(spark, sf_dir, "events"), ["event_type"], "value", 2.0).select("event_id", F.round("score", 6).alias("score"), "is_anomaly")


@register("outliers_iqr", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
  SELECT event_id, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS is_outlier FROM events JOIN q USING (event_type)""")
def _iqr(spark, sf_dir):
    return T.iqr_outliers(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_id", "is_outlier")


@register("outliers_mad", """WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1), d AS (SELECT event_id, event_type, abs(value - m) AS d FROM events JOIN m USING (event_type)),
  s AS (SELECT event_type, quantile_cont(d, 0.5) AS mad FROM d GROUP BY 1) SELECT event_id, CASE WHEN mad = 0 THEN false ELSE 0.6745 * d / mad > 1.4 END AS is_outlier FROM d JOIN s USING (event_type)""")
def _mad(spark, sf_dir):
    return T.mad_outliers(table(spark, sf_dir, "events"), ["event_type"], "value", 1.4).select("event_id", "is_outlier")


# ---- windows of streams: a stream over the table's files, run until all is read, against the batch answer

_TUMBLE = "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1, 2"


def _stream(spark, sf_dir):
    return S.file_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@register("stream_tumbling", _TUMBLE)
def _tumbling(spark, sf_dir):
    agg = S.tumbling(_stream(spark, sf_dir), "ts", "6 hours", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s")])
    return S.drain(agg, "complete").withColumn("start", F.col("start").cast("timestamp_ntz")).select("event_type", "start", "n", "s")


@register("stream_hopping", """WITH w AS (SELECT event_type, value, unnest(range(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR, ts + INTERVAL 1 MICROSECOND, INTERVAL 6 HOUR)) AS start, ts FROM events)
  SELECT event_type, start, count(*) AS n FROM w WHERE ts < start + INTERVAL 12 HOUR GROUP BY 1, 2""")
def _hopping(spark, sf_dir):
    agg = S.hopping(_stream(spark, sf_dir), "ts", "12 hours", "6 hours", ["event_type"], [F.count("*").alias("n")])
    return S.drain(agg, "complete").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@register("stream_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def _session(spark, sf_dir):
    agg = S.session(_stream(spark, sf_dir), "ts", "3 hours", ["user_id"], [F.count("*").alias("n")])
    return S.drain(agg, "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@register("stream_cumulative", """SELECT event_type, d + to_hours(6 * k::INT) AS until, count(*) AS n FROM (SELECT event_type, ts, date_trunc('day', ts) AS d, unnest([1, 2, 3, 4]) AS k FROM events) t
  WHERE ts < d + to_hours(6 * k::INT) GROUP BY 1, 2""")
def _cumulative(spark, sf_dir):
    agg = S.cumulative(_stream(spark, sf_dir), "ts", 86_400, 21_600, ["event_type"], [F.count("*").alias("n")])
    return S.drain(agg, "complete").select("event_type", F.col("until").cast("timestamp_ntz").alias("until"), "n")


@register("stream_dedup", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def _dedup(spark, sf_dir):
    s = _stream(spark, sf_dir)
    return S.drain(S.dedup(s.union(s), "event_id", "ts", "40 days"), "append").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@register("stream_interval_join", """SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase'
  AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 2 HOUR""")
def _interval(spark, sf_dir):
    left = _stream(spark, sf_dir).filter("event_type = 'click'").select(F.col("event_id").alias("a"), "user_id", F.col("ts").alias("lt"))
    right = _stream(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("event_id").alias("b"), F.col("user_id").alias("u2"), F.col("ts").alias("rt"))
    return S.drain(S.interval_join(left, right, "user_id = u2", "lt", "rt", "0 hours", "2 hours"), "append").select("a", "b")


@register("stream_lookup_join", "SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey")
def _lookup(spark, sf_dir):
    static = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return S.drain(_stream(spark, sf_dir).join(static, "user_id", "left"), "append").select("event_id", "c_mktsegment")


@register("stream_upsert_sink", "SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY user_id")
def _upsert(spark, sf_dir):
    agg = _stream(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    return S.drain(agg, "update", keys=["user_id"])
