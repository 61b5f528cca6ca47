import numpy as np
import pytest

from sparkloom.operators import analytics, forecasting


def test_arima_follows_an_autoregression():
    rng = np.random.default_rng(3)
    x = [0.0]
    for _ in range(600):
        x.append(0.7 * x[-1] + rng.normal(0, 0.1))
    got = forecasting.arima(np.array(x) + 10, 3, p=1, d=0, q=0)
    want = 10 + x[-1] * 0.7 ** np.arange(1, 4)
    assert np.allclose(got, want, atol=0.05)


def test_arima_continues_a_line():
    assert np.allclose(forecasting.arima(np.arange(40.0) * 2 + 5, 4), [85, 87, 89, 91])
    assert forecasting.arima(np.array([4.0, 6.0]), 2) == [8.0, 10.0]


def test_holt_winters_continues_a_season():
    season = [0, 3, -1, 2, 0, -4, 0]
    v = 20.0 + np.tile(season, 10)
    assert np.allclose(forecasting.holt_winters(v, 9), 20 + np.array(season + season[:2]))
    assert forecasting.holt_winters(v[:7], 3) == []


def test_smoothing_factor_of_a_walk_is_high():
    v = np.cumsum(np.random.default_rng(0).normal(size=400))
    assert forecasting.smoothing_factor(v) >= 0.8


def test_short_and_null_series(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("b", 1, None), (None, 1, 3.0)], "k string, t int, v double")
    line = {r.k: r.value for r in forecasting.forecast_linear(df, ["k"], "t", "v", 1).collect()}
    assert line == {"a": 5.0, None: 3.0}
    parts = forecasting.decompose(df, ["k"], "t", "v").collect()
    assert {(r.k, r.trend, r.seasonal, r.residual) for r in parts} == {("a", 0, 0, 0), (None, 0, 0, 0)}
    assert forecasting.forecast_series(df, ["k"], "t", "v", 2, "holt_winters").count() == 0
    empty = df.filter("false")
    assert forecasting.forecast_series(empty, ["k"], "t", "v", 2, "arima").count() == 0
    assert analytics.change_points(empty, ["k"], "t", "v", 1.0).count() == 0


def test_propensity_follows_the_covariate(spark):
    rows = [(i, float(i % 10), int(i % 10 > 4 or i % 7 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, t int")
    got = analytics.propensity_scores(df, "t", ["x"])
    assert got.columns == ["id", "x", "t", "propensity"]
    p = {r.x: r.propensity for r in got.collect()}
    assert p[9.0] > 0.9 > 0.5 > p[0.0] and min(p.values()) >= 0.01


def test_column_profile_counts(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (3.0,), (None,)], "x double")
    got = {r.statistic: r.value for r in analytics.column_profile(df, "x", 1).collect()}
    assert got["row_count"] == "4" and got["null_count"] == "1" and got["distinct_count"] == "2" and got["top_1"] == "1.0"
    assert float(got["mean"]) == pytest.approx(5 / 3) and float(got["stddev"]) == pytest.approx(np.std([1, 1, 3], ddof=1))
