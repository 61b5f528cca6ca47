"""Forecasts, decompositions and seasonality of many series at once.

A series is the rows of one key in the order of a column. What depends on sums alone (linear trends, partial
autocorrelation, seasonal indices) stays in DataFrame expressions; recursions run in one grouped Arrow call per series,
so a series has to fit in a task and the number of series is what scales.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .analytics import autocorrelation


def per_series(df: DataFrame, keys: Sequence[str], order: str, value: str, rows: Callable[[np.ndarray], list[tuple]], columns: str) -> DataFrame:
    """(keys, columns): ``rows`` turns the ordered values of a series, nulls left out, into tuples."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame[list(keys)].iloc[0].tolist()
        values = frame.sort_values(order, kind="stable")[value].to_numpy(float)
        return pd.DataFrame([(*head, *r) for r in rows(values)], columns=[*keys, *names])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for k in keys for f in df.schema if f.name == k)
    return df.filter(F.col(value).isNotNull()).select(*keys, order, value).groupBy(*keys).applyInPandas(run, kinds + columns)


def _steps(values: Sequence[float]) -> list[tuple]:
    return [(k + 1, float(v)) for k, v in enumerate(values)]


def holt_winters(v: np.ndarray, horizon: int, season: int = 7, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1) -> list[float]:
    """Additive triple smoothing, started from the first season; none for series not longer than a season."""
    season = max(season, 2)
    if len(v) <= season:
        return []
    level = v[:season].mean()
    seasonal = list(v[:season] - level)
    slope = (v[season] - v[0]) / season
    for i in range(season, len(v)):
        phase, before = i % season, level
        level = alpha * (v[i] - seasonal[phase]) + (1 - alpha) * (level + slope)
        slope = beta * (level - before) + (1 - beta) * slope
        seasonal[phase] = gamma * (v[i] - level) + (1 - gamma) * seasonal[phase]
    return [level + h * slope + seasonal[(len(v) + h - 1) % season] for h in range(1, horizon + 1)]


def smoothing_factor(v: np.ndarray) -> float:
    """The factor of 0.05, 0.10, ... 0.95 with the least squared error of one step ahead."""
    grid = np.arange(1, 20) / 20
    level, error = np.full(19, v[0]), np.zeros(19)
    for x in v[1:]:
        error += (x - level) ** 2
        level = grid * x + (1 - grid) * level
    return float(grid[int(np.argmin(error))])


def arima(v: np.ndarray, horizon: int, p: int = 1, d: int = 1, q: int = 1) -> list[float]:
    """Least squares in two steps: a long autoregression gives the shocks, then values on their own lags and the lags
    of the shocks. Short series fall back to the mean of the differences."""
    tails, w = [], v
    for _ in range(d):
        tails.append(w[-1])
        w = np.diff(w)
    mean = float(w.mean()) if len(w) else 0.0
    x, long = w - mean, max(p, q) + 2
    shocks, weights = np.zeros(len(x)), np.zeros(p + q)
    lags = lambda series, n, start: np.column_stack([series[start - k : len(series) - k] for k in range(1, n + 1)]) if n else np.empty((len(series) - start, 0))
    if len(x) > 2 * long + p + q:
        a = lags(x, long, long)
        shocks[long:] = x[long:] - a @ np.linalg.lstsq(a, x[long:], rcond=None)[0]
        start = long + max(p, q)
        weights = np.linalg.lstsq(np.hstack([lags(x, p, start), lags(shocks, q, start)]), x[start:], rcond=None)[0]
    x, shocks, out = list(x), list(shocks), []
    for _ in range(horizon):
        past = [x[-k] if k <= len(x) else 0.0 for k in range(1, p + 1)] + [shocks[-k] if k <= len(shocks) else 0.0 for k in range(1, q + 1)]
        x.append(float(np.dot(weights, past)))
        shocks.append(0.0)
        out.append(x[-1] + mean)
    for last in reversed(tails):
        out = list(last + np.cumsum(out))
    return out


def forecast_series(df: DataFrame, keys: Sequence[str], order: str, value: str, horizon: int, method: str, **settings) -> DataFrame:
    """(keys, step, value) by ``holt_winters``, ``arima`` or ``smoothing`` with a fitted factor."""

    def smooth(v: np.ndarray, horizon: int) -> list[float]:
        a, level = smoothing_factor(v), v[0]
        for x in v[1:]:
            level = a * x + (1 - a) * level
        return [level] * horizon

    run = {"holt_winters": holt_winters, "arima": arima, "smoothing": smooth}[method]
    return per_series(df, keys, order, value, lambda v: _steps(run(v, horizon, **settings)), "step int, value double")


def _numbered(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    rows = df.filter(F.col(value).isNotNull())
    return rows.select(*keys, order, F.col(value).cast("double").alias("_v"), (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).alias("_i"))


def _ahead(keys: Sequence[str], line: DataFrame, horizon: int) -> DataFrame:
    return line.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))


def forecast_linear(df: DataFrame, keys: Sequence[str], order: str, value: str, horizon: int) -> DataFrame:
    """(keys, step, value) on the least-squares line over the row number; a single row repeats."""
    line = _numbered(df, keys, order, value).groupBy(*keys).agg(F.regr_slope("_v", "_i").alias("_a"), F.avg("_v").alias("_m"), F.avg("_i").alias("_x"), F.count("*").alias("_n"))
    at = F.col("_n") + F.col("step") - 1 - F.col("_x")
    return _ahead(keys, line, horizon).select(*keys, "step", (F.col("_m") + F.coalesce("_a", F.lit(0.0)) * at).alias("value"))


def decompose(df: DataFrame, keys: Sequence[str], order: str, value: str, period: int = 7) -> DataFrame:
    """(keys, order, trend, seasonal, residual): a centred moving average over 2 * (period // 2) + 1 rows, the mean of
    what is left for each phase, centred on 0. Rows at the ends, without a whole window, take their value less the
    seasonal part as trend. Series shorter than two periods have no parts but zeros."""
    half = period // 2
    w = Window.partitionBy(*keys).orderBy("_i").rowsBetween(-half, half)
    rows = _numbered(df, keys, order, value).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    inside = (F.col("_i") >= half) & (F.col("_i") < F.col("_n") - half) & (F.col("_n") >= 2 * period)
    rows = rows.select("*", F.when(inside, F.avg("_v").over(w)).alias("_t"), (F.col("_i") % period).alias("_p"))
    phase = Window.partitionBy(*keys, "_p")
    rows = rows.withColumn("_s", F.coalesce(F.avg(F.col("_v") - F.col("_t")).over(phase), F.lit(0.0)))
    # the mean over phases, each once: a phase's first row stands for it
    centre = F.sum(F.when(F.col("_i") < period, F.col("_s"))).over(Window.partitionBy(*keys)) / period
    long = F.col("_n") >= 2 * period
    rows = rows.withColumn("_s", F.when(long, F.col("_s") - centre).otherwise(0.0))
    trend = F.when(long, F.coalesce("_t", F.col("_v") - F.col("_s"))).otherwise(0.0)
    return rows.select(*keys, order, trend.alias("trend"), F.col("_s").alias("seasonal"), F.when(long, F.col("_v") - trend - F.col("_s")).otherwise(0.0).alias("residual"))


def forecast_seasonal(df: DataFrame, keys: Sequence[str], order: str, value: str, horizon: int, period: int = 7) -> DataFrame:
    """(keys, step, value): the line through the trend of ``decompose``, plus the seasonal part of each phase."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    parts = decompose(df, keys, order, value, period).select(*keys, number.alias("_i"), F.col("trend").alias("_v"), "seasonal")
    line = parts.groupBy(*keys).agg(
        F.regr_slope("_v", "_i").alias("_a"), F.avg("_v").alias("_m"), F.avg("_i").alias("_x"), F.count("*").alias("_n"),
        F.map_from_entries(F.collect_list(F.when(F.col("_i") < period, F.struct(F.col("_i"), F.col("seasonal"))))).alias("_s"),
    )
    at = F.col("_n") + F.col("step") - 1
    drift = F.col("_m") + F.coalesce("_a", F.lit(0.0)) * (at - F.col("_x"))
    return _ahead(keys, line, horizon).select(*keys, "step", (drift + F.coalesce(F.try_element_at("_s", (at % period).cast("int")), F.lit(0.0))).alias("value"))


def partial_autocorrelation(df: DataFrame, keys: Sequence[str], order: str, value: str, lags: int) -> DataFrame:
    """(keys, lag, value) by the Durbin recursion over the autocorrelations; constant series give null."""
    r = autocorrelation(df, keys, order, value, lags).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lag", "value"))).alias("r"))
    at: list[Column] = [F.lit(1.0), *[F.get("r", F.lit(k))["value"] for k in range(lags)]]

    # one select per order, so that each coefficient is a column and not a growing expression
    got, names = r.select(*keys, *[c.alias(f"_r{k}") for k, c in enumerate(at)], F.lit(1.0).alias("_e")), []
    for k in range(1, lags + 1):
        num = F.col(f"_r{k}")
        for j, name in enumerate(names, 1):
            num = num - F.col(name) * F.col(f"_r{k - j}")
        got = got.withColumn(f"_k{k}", num / F.nullif("_e", F.lit(0.0)))
        fresh = {f"_phi{k}_{j}": F.col(name) - F.col(f"_k{k}") * F.col(names[k - 1 - j]) for j, name in enumerate(names, 1)}
        got = got.withColumns(fresh | {f"_phi{k}_{k}": F.col(f"_k{k}"), "_e": F.col("_e") * (1 - F.col(f"_k{k}") * F.col(f"_k{k}"))})
        names = [f"_phi{k}_{j}" for j in range(1, k + 1)]
    out = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_k{k}").alias("value")) for k in range(1, lags + 1)])
    return got.select(*keys, F.explode(out).alias("r")).select(*keys, "r.*")


def seasonality(df: DataFrame, keys: Sequence[str], order: str, value: str, most: int, least: float = 0.3) -> DataFrame:
    """(keys, period, strength): lags of 2 or more whose autocorrelation exceeds ``least`` and both neighbours'."""
    w = Window.partitionBy(*keys).orderBy("lag")
    near = autocorrelation(df, keys, order, value, most).select("*", F.lag("value").over(w).alias("_b"), F.lead("value").over(w).alias("_a"))
    peak = (F.col("lag") >= 2) & (F.col("value") > least) & (F.col("value") > F.col("_b")) & (F.col("value") > F.col("_a"))
    return near.filter(peak).select(*keys, F.col("lag").alias("period"), F.col("value").alias("strength"))
