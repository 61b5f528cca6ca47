"""Gap filling, carrying forward, interpolation, smoothing, down-sampling, period comparison and outliers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets that gap filling makes for one key at most; more is an error, not a cut.
MAX_BUCKETS = 5_000_000


def gapfill(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates per key and bucket, with a row for every bucket between each key's first and last."""
    w = seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    got = df.groupBy(*keys, (micros - F.pmod(micros, F.lit(w))).alias("_bucket")).agg(*aggregates)
    span = got.groupBy(*keys).agg(F.min("_bucket").alias("_lo"), F.max("_bucket").alias("_hi"))
    n = (F.col("_hi") - F.col("_lo")) / w + 1
    grid = F.when(n > MAX_BUCKETS, F.raise_error(F.lit("too many buckets to fill")).cast("array<bigint>")).otherwise(F.sequence("_lo", "_hi", F.lit(w)))
    dense = span.select(*keys, F.explode(grid).alias("_bucket"))
    return dense.join(got, [*keys, "_bucket"], "left").withColumn("bucket", F.timestamp_micros("_bucket")).drop("_bucket")


def locf(value: str, keys: Sequence[str], ts: str) -> Column:
    """The last known value; nulls before the first stay."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))


def interpolate(value: str, keys: Sequence[str], ts: str) -> Column:
    """Linear between the known neighbours; outside them null."""
    w = Window.partitionBy(*keys).orderBy(ts)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    known = F.when(F.col(value).isNotNull(), F.struct(at.alias("t"), F.col(value).alias("v")))
    a, b = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(F.col(value), a["v"] + (b["v"] - a["v"]) * (at - a["t"]) / (b["t"] - a["t"]))


def ema(df: DataFrame, keys: Sequence[str], ts: str | list[str], value: str, alpha: float = 0.5, name: str = "ema") -> DataFrame:
    """Exponential smoothing from each key's first value: a recurrence, so one sorted pass per key."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ts)
        frame[name] = frame[value].ewm(alpha=alpha, adjust=False).mean()
        return frame

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(*keys).applyInPandas(run, f"{kinds}, {name} double")


def lttb_indices(t: np.ndarray, v: np.ndarray, n: int) -> list[int]:
    """Places of the points that largest-triangle-three-buckets keeps."""
    size = len(t)
    if n >= size or n < 3:
        return list(range(size))
    edges = np.floor(np.linspace(1, size - 1, n - 1)).astype(int)
    out = [0]
    for k in range(n - 2):
        a, b = edges[k], edges[k + 1]
        c = edges[k + 2] if k + 2 < len(edges) else size
        mt, mv = t[b : max(c, b + 1)].mean(), v[b : max(c, b + 1)].mean()
        area = np.abs((t[out[-1]] - mt) * (v[a:b] - v[out[-1]]) - (t[out[-1]] - t[a:b]) * (mv - v[out[-1]]))
        out.append(int(a + area.argmax()))
    return [*out, size - 1]


def lttb(df: DataFrame, keys: Sequence[str], ts: str, value: str, points: int) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ts).reset_index(drop=True)
        return frame.iloc[lttb_indices(frame[ts].astype("int64").to_numpy(float), frame[value].to_numpy(float), points)]

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def period_compare(df: DataFrame, keys: Sequence[str], day: str, value: str, shift: Column, name: str = "prior") -> DataFrame:
    """The value at exactly the shifted day, else null; ``shift`` is the earlier day as an expression of the row."""
    prior = df.select(*keys, F.col(day).alias("_day"), F.col(value).alias(name))
    return df.withColumn("_day", shift).join(prior, [*keys, "_day"], "left").drop("_day")


def period_growth(df: DataFrame, keys: Sequence[str], day: str, value: str, shift: Column, name: str = "growth") -> DataFrame:
    """(value - prior) / prior, null where the prior is missing or 0."""
    got = period_compare(df, keys, day, value, shift, "_prior")
    return got.withColumn(name, (F.col(value) - F.col("_prior")) / F.nullif(F.col("_prior"), F.lit(0))).drop("_prior")


def derivative(value: str, keys: Sequence[str], ts: str, *ties: str) -> Column:
    """Change per second since the row before; null for the first and where no time has passed."""
    w = Window.partitionBy(*keys).orderBy(ts, *ties)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return (F.col(value) - F.lag(value).over(w)) / F.nullif((at - F.lag(at).over(w)) / 1_000_000, F.lit(0.0))


def anomalies(df: DataFrame, keys: Sequence[str], value: str, threshold: float = 3.0) -> DataFrame:
    """``score``: sample deviations from the key's mean, null where there is no spread; ``is_anomaly``: beyond the threshold."""
    score = F.abs(F.col(value) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    got = df.join(stats, list(keys)).withColumn("score", score)
    return got.withColumn("is_anomaly", F.coalesce(F.col("score") > threshold, F.lit(False))).drop("_mean", "_sd")


def to_date_sum(value: str, keys: Sequence[str], day: str, unit: str) -> Column:
    """Running sum inside the calendar year, quarter or month."""
    return F.sum(value).over(Window.partitionBy(*keys, F.date_trunc(unit, F.col(day))).orderBy(day))


def zscore(value: str, keys: Sequence[str]) -> Column:
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd == 0, F.lit(0.0)).otherwise((F.col(value) - F.avg(value).over(w)) / sd)


def iqr_outliers(df: DataFrame, keys: Sequence[str], value: str, factor: float = 1.5) -> DataFrame:
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    spread = F.col("_q")[1] - F.col("_q")[0]
    out = (F.col(value) < F.col("_q")[0] - factor * spread) | (F.col(value) > F.col("_q")[1] + factor * spread)
    return df.join(q, list(keys)).withColumn("is_outlier", out).drop("_q")


def mad_outliers(df: DataFrame, keys: Sequence[str], value: str, threshold: float = 3.5) -> DataFrame:
    """0.6745 |x - median| / MAD above the threshold."""
    median = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("_m"))
    near = df.join(median, list(keys)).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    mad = near.groupBy(*keys).agg(F.percentile("_d", 0.5).alias("_mad"))
    score = F.when(F.col("_mad") == 0, F.lit(0.0)).otherwise(0.6745 * F.col("_d") / F.col("_mad"))
    return near.join(mad, list(keys)).withColumn("is_outlier", score > threshold).drop("_m", "_d", "_mad")
