"""Forecasts, decompositions and seasonality over the daily counts of each event type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecasting as P
from .catalog import register, table

_DAILY = "d AS (SELECT event_type, ts::DATE AS d, count(*)::DOUBLE AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts::DATE) - 1 AS i FROM events GROUP BY 1, 2)"


def _daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(F.count("*").cast("double").alias("n"))


def _six(df):
    return df.withColumn("value", F.round("value", 6))


@register("forecast_linear", f"""WITH {_DAILY}, l AS (SELECT event_type, regr_slope(n, i) AS a, regr_intercept(n, i) AS b, count(*) AS c FROM d GROUP BY 1)
  SELECT event_type, h::INT AS step, round(b + a * (c + h - 1), 6) AS value FROM l, range(1, 6) t(h)""")
def _linear(spark, sf_dir):
    return _six(P.forecast_linear(_daily(spark, sf_dir), ["event_type"], "d", "n", 5))


@register("forecast_holt_winters", f"""WITH RECURSIVE {_DAILY}, f AS (SELECT event_type, avg(n) AS m, list(n ORDER BY i) AS v FROM d WHERE i < 7 GROUP BY 1),
  r AS (SELECT f.event_type, 6::BIGINT AS i, m AS l, (d.n - v[1]) / 7 AS b, list_transform(v, lambda x: x - m) AS s FROM f JOIN d ON d.event_type = f.event_type AND d.i = 7
    UNION ALL SELECT event_type, i, l, 0.1::DOUBLE * (l - l0) + 0.9::DOUBLE * b AS b, list_concat(list_concat(s[1:p], [0.1::DOUBLE * (n - l) + 0.9::DOUBLE * s[p + 1]]), s[p + 2:7]) AS s
    FROM (SELECT d.event_type, d.i, d.n, r.l AS l0, r.b, r.s, d.i % 7 AS p, 0.3::DOUBLE * (d.n - r.s[d.i % 7 + 1]) + 0.7::DOUBLE * (r.l + r.b) AS l FROM r JOIN d ON d.event_type = r.event_type AND d.i = r.i + 1) t),
  z AS (SELECT event_type, max(i) AS i, arg_max(l, i) AS l, arg_max(b, i) AS b, arg_max(s, i) AS s FROM r GROUP BY 1)
  SELECT event_type, h::INT AS step, round(l + h * b + s[(i + h) % 7 + 1], 6) AS value FROM z, range(1, 6) t(h)""")
def _holt_winters(spark, sf_dir):
    return _six(P.forecast_series(_daily(spark, sf_dir), ["event_type"], "d", "n", 5, "holt_winters"))


@register("forecast_arima")
def _arima(spark, sf_dir):
    return _six(P.forecast_series(_daily(spark, sf_dir), ["event_type"], "d", "n", 5, "arima"))


_PARTS = f"""{_DAILY}, c AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS c, avg(n) OVER (PARTITION BY event_type ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM d),
  t AS (SELECT *, CASE WHEN i >= 3 AND i < c - 3 THEN m END AS t FROM c), p AS (SELECT event_type, i % 7 AS p, avg(n - t) AS s FROM t GROUP BY 1, 2),
  q AS (SELECT event_type, p, s - avg(s) OVER (PARTITION BY event_type) AS s FROM p),
  o AS (SELECT t.event_type, d, i, c, coalesce(t, n - s) AS trend, s AS seasonal, n - coalesce(t, n - s) - s AS residual FROM t JOIN q ON t.event_type = q.event_type AND t.i % 7 = q.p)"""


@register("seasonal_decompose", f"WITH {_PARTS} SELECT event_type, d, round(trend, 6) AS trend, round(seasonal, 6) + 0.0 AS seasonal, round(residual, 6) + 0.0 AS residual FROM o")
def _decompose(spark, sf_dir):
    got = P.decompose(_daily(spark, sf_dir), ["event_type"], "d", "n")
    return got.select("event_type", "d", F.round("trend", 6).alias("trend"), *[(F.round(c, 6) + 0.0).alias(c) for c in ("seasonal", "residual")])


@register("forecast_seasonal", f"""WITH {_PARTS}, l AS (SELECT event_type, regr_slope(trend, i) AS a, regr_intercept(trend, i) AS b, max(c) AS c FROM o GROUP BY 1)
  SELECT l.event_type, h::INT AS step, round(b + a * (c + h - 1) + s, 6) AS value FROM l CROSS JOIN range(1, 6) t(h) JOIN q ON q.event_type = l.event_type AND q.p = (c + h - 1) % 7""")
def _seasonal(spark, sf_dir):
    return _six(P.forecast_seasonal(_daily(spark, sf_dir), ["event_type"], "d", "n", 5))


_ACF = f"""{_DAILY}, x AS (SELECT event_type, i, n - avg(n) OVER (PARTITION BY event_type) AS x FROM d), v AS (SELECT event_type, sum(x * x) AS v FROM x GROUP BY 1),
  a AS (SELECT p.event_type, q.i - p.i AS lag, sum(p.x * q.x) / max(v) AS r FROM x p JOIN x q ON p.event_type = q.event_type AND q.i > p.i AND q.i - p.i <= 10 JOIN v ON v.event_type = p.event_type GROUP BY 1, 2)"""


@register("partial_autocorrelation", f"""WITH {_ACF}, w AS (SELECT event_type, max(r) FILTER (WHERE lag = 1) AS r1, max(r) FILTER (WHERE lag = 2) AS r2, max(r) FILTER (WHERE lag = 3) AS r3 FROM a GROUP BY 1)
  SELECT event_type, 1 AS lag, round(r1, 6) AS value FROM w UNION ALL SELECT event_type, 2, round((r2 - r1 * r1) / (1 - r1 * r1), 6) FROM w
  UNION ALL SELECT event_type, 3, round((r3 + r1 * r1 * r1 + r1 * r2 * r2 - 2 * r1 * r2 - r1 * r1 * r3) / (1 + 2 * r1 * r1 * r2 - r2 * r2 - 2 * r1 * r1), 6) FROM w""")
def _pacf(spark, sf_dir):
    return _six(P.partial_autocorrelation(_daily(spark, sf_dir), ["event_type"], "d", "n", 3))


@register("seasonality", f"""WITH {_ACF}, b AS (SELECT *, lag(r) OVER w AS p, lead(r) OVER w AS q FROM a WINDOW w AS (PARTITION BY event_type ORDER BY lag))
  SELECT event_type, lag::INT AS period, round(r, 6) AS strength FROM b WHERE lag >= 2 AND r > 0.05 AND r > p AND r > q""")
def _seasonality(spark, sf_dir):
    return P.seasonality(_daily(spark, sf_dir), ["event_type"], "d", "n", 10, 0.05).withColumn("strength", F.round("strength", 6))
