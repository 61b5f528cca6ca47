"""Cohorts, funnels, profiles, correlations, forecasts, causal estimates, features and models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import asof_join, running_totals


def cohort_retention(df: DataFrame, user: str, ts: str, period: str = "week", periods: int = 12, revenue: str | None = None) -> DataFrame:
    """(cohort, period, value): users, or revenue, of each cohort so many periods after its first event; zero-filled."""
    days = {"day": 1, "week": 7}
    first = df.groupBy(user).agg(F.date_trunc(period, F.min(ts)).alias("cohort"))
    at = F.date_trunc(period, F.col(ts))
    if period in days:
        offset = F.floor(F.datediff(at, "cohort") / days[period])
    else:
        offset = F.round(F.months_between(at, "cohort") / {"month": 1, "quarter": 3, "year": 12}[period])
    rows = df.join(first, user).withColumn("period", offset.cast("int"))
    value = F.sum(revenue) if revenue else F.count_distinct(user)
    got = rows.filter(F.col("period") < periods).groupBy("cohort", "period").agg(value.alias("value"))
    grid = first.select("cohort").distinct().select("cohort", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))).alias("period"))
    return grid.join(got, ["cohort", "period"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def funnel_steps(df: DataFrame, user: str, ts: str, event: str, steps: Sequence[str], window_ms: int = 86_400_000, tie: str | None = None) -> DataFrame:
    """(user, reached, times): greedy in-order matching inside the window after the first event of the first step."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    order = F.struct(micros.alias("t"), *([F.col(tie).alias("k")] if tie else []), F.col(event).alias("e"))
    events = df.filter(F.col(event).isin(list(steps))).groupBy(user).agg(F.sort_array(F.collect_list(order)).alias("events"))
    names = F.array(*map(F.lit, steps))
    zero = F.struct(F.lit(0).alias("step"), F.array().cast("array<bigint>").alias("times"))

    def advance(acc: Column, x: Column) -> Column:
        fits = (acc["step"] < len(steps)) & (x["e"] == F.element_at(names, F.least(acc["step"] + 1, F.lit(len(steps)))))
        inside = (acc["step"] == 0) | (x["t"] - F.coalesce(F.get(acc["times"], F.lit(0)), x["t"]) <= window_ms * 1000)
        return F.when(fits & inside, F.struct((acc["step"] + 1).alias("step"), F.concat(acc["times"], F.array(x["t"])).alias("times"))).otherwise(acc)

    done = F.aggregate("events", zero, advance)
    return events.select(user, done["step"].alias("reached"), done["times"].alias("times"))


def funnel(df: DataFrame, user: str, ts: str, event: str, steps: Sequence[str], window_ms: int = 86_400_000, tie: str | None = None) -> DataFrame:
    """(step, users_count, conversion_rate, drop_off_rate, avg_time_to_next_ms)."""
    per = funnel_steps(df, user, ts, event, steps, window_ms, tie)
    sums = [F.count(F.when(F.col("reached") > k, 1)).alias(f"n{k}") for k in range(len(steps))]
    gaps = [F.avg(F.when(F.col("reached") > k + 1, (F.col("times")[k + 1] - F.col("times")[k]) / 1000)).alias(f"g{k}") for k in range(len(steps) - 1)]
    total = per.agg(*sums, *gaps)
    rows = [
        F.struct(
            F.lit(k + 1).alias("step"),
            F.col(f"n{k}").alias("users_count"),
            F.when(F.col("n0") == 0, 0.0).otherwise(F.col(f"n{k}") / F.col("n0")).alias("conversion_rate"),
            (F.when(F.col(f"n{k}") == 0, 0.0).otherwise(1 - F.col(f"n{k + 1}") / F.col(f"n{k}")) if k + 1 < len(steps) else F.lit(0.0)).alias("drop_off_rate"),
            (F.col(f"g{k}") if k + 1 < len(steps) else F.lit(None).cast("double")).alias("avg_time_to_next_ms"),
        )
        for k in range(len(steps))
    ]
    return total.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def data_profile(df: DataFrame) -> DataFrame:
    """(column_name, data_type, null_count, distinct_count, mean, median, stddev), exact. Each column's values are counted
    first, which combines before the shuffle and reads one column; the statistics are those of the counts. Nothing
    multiplies the rows by the columns."""
    number = lambda kind: kind in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.startswith("decimal")

    def one(name: str, kind: str) -> DataFrame:
        counts = df.groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
        some, mean, median, spread = F.when(F.col("v").isNotNull(), F.col("n")), *[F.lit(None).cast("double")] * 3
        if number(kind):
            x = F.col("v").cast("double")
            mean = F.sum(x * some) / F.sum(some)
            median = F.percentile(x, 0.5, F.coalesce(some, F.lit(0)))
            # deviations are taken from a value at hand, so that large means do not cancel the spread
            d = x - F.col("_at")
            spread = F.sqrt(F.greatest(F.sum(d * d * some) - F.sum(d * some) * F.sum(d * some) / F.sum(some), F.lit(0.0)) / F.nullif(F.sum(some) - 1, F.lit(0)))
            counts = counts.crossJoin(F.broadcast(df.agg(F.avg(F.col(name).cast("double")).alias("_at"))))  # one row
        told = [F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"), F.count("v").alias("distinct_count")]
        return counts.agg(*told, mean.alias("mean"), median.alias("median"), spread.alias("stddev")).select(F.lit(name).alias("column_name"), F.lit(kind).alias("data_type"), "*")

    return reduce(DataFrame.union, [one(*c) for c in df.dtypes])


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """(col_a, col_b, correlation) of each pair; Spearman is Pearson over average ranks."""
    if method == "spearman":
        # average rank = rows up to the value - (ties - 1) / 2; ranks come from counts per value, summed by ranges
        n = df
        for c in columns:
            counts = df.groupBy(c).agg(F.count("*").alias("_n"))
            ranks = running_totals(counts, c, ["_n"]).select(c, (F.col("_run__n") - (F.col("_n") - 1) / 2).alias(f"_r_{c}"))
            n = n.join(ranks, c)
        df = n.select(*[F.col(f"_r_{c}").alias(c) for c in columns])
    pairs = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.corr(a, b).alias("correlation")) for i, a in enumerate(columns) for b in columns[i:]]
    return df.agg(F.array(*pairs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def kendall_tau(df: DataFrame, keys: Sequence[str], x: str, y: str, row: str) -> DataFrame:
    """tau-b of each key: concordant less discordant pairs, corrected for ties. All pairs of a key's rows are compared,
    so it is meant for short series, such as daily figures; ``row`` tells the rows apart."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, row, x, y)
    a, b = both.alias("a"), both.alias("b")
    on = F.col(f"a.{row}") < F.col(f"b.{row}")
    for k in keys:
        on &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    dx, dy = F.signum(F.col(f"a.{x}") - F.col(f"b.{x}")), F.signum(F.col(f"a.{y}") - F.col(f"b.{y}"))
    pairs = a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], dx.alias("_dx"), dy.alias("_dy"))
    sums = pairs.groupBy(*keys).agg(F.sum(F.col("_dx") * F.col("_dy")).alias("_s"), F.sum(F.abs("_dx")).alias("_x"), F.sum(F.abs("_dy")).alias("_y"))
    return sums.select(*keys, (F.col("_s") / F.nullif(F.sqrt(F.col("_x") * F.col("_y")), F.lit(0.0))).alias("tau"))


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """(mutual_information,) in nats of two columns cut into equal-width bins; 0 where one of them has a single value."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    edges = both.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cut = lambda v: F.least(F.floor((F.col(v) - F.col(f"{v}0")) / F.nullif(F.col(f"{v}1") - F.col(f"{v}0"), F.lit(0.0)) * bins), F.lit(bins - 1))
    joint = both.crossJoin(F.broadcast(edges)).groupBy(F.coalesce(cut("x"), F.lit(0)).alias("i"), F.coalesce(cut("y"), F.lit(0)).alias("j")).agg(F.count("*").alias("n"))
    # at most bins * bins rows from here on
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    p = joint.select("n", total.alias("t"), F.sum("n").over(Window.partitionBy("i")).alias("px"), F.sum("n").over(Window.partitionBy("j")).alias("py"))
    return p.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("px") * F.col("py")))).alias("mutual_information"))


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    """The rows with a column for each product of up to ``degree`` of the columns, named by its factors."""
    terms = [c for d in range(1, degree + 1) for c in combinations_with_replacement(columns, d)]
    return df.select("*", *[reduce(lambda a, b: a * b, map(F.col, t)).alias("*".join(t)) for t in terms if len(t) > 1])


def point_in_time(features: DataFrame, entities: DataFrame, entity: str, ts: str, feature_ts: str) -> DataFrame:
    """Each entity row with the latest features not after its time."""
    return asof_join(entities, features, [entity], ts, feature_ts)


def latest_features(features: DataFrame, entity: str, name: str, value: str, ts: str) -> DataFrame:
    return features.groupBy(entity, name).agg(F.max_by(value, ts).alias(value))


def feature_parity(offline: DataFrame, online: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys whose values differ between two stores, with both."""
    a, b = offline.select(*keys, F.col(value).alias("offline")), online.select(*keys, F.col(value).alias("online"))
    return a.join(b, list(keys), "full").filter(~F.col("offline").eqNullSafe(F.col("online")))


def linear_trend(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def forecast(df: DataFrame, keys: Sequence[str], order: str, value: str, horizon: int, method: str = "ses", alpha: float = 0.3, beta: float = 0.1) -> DataFrame:
    """(keys, step, value): simple exponential smoothing or Holt's linear trend for each series."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v = frame.sort_values(order)[value].to_numpy(float)
        level, slope = v[0], (v[1] - v[0] if method == "holt" and len(v) > 1 else 0.0)
        for x in v[1:]:
            before = level
            level = alpha * x + (1 - alpha) * (level + slope)
            slope = beta * (level - before) + (1 - beta) * slope if method == "holt" else 0.0
        head = frame[list(keys)].iloc[0].tolist()
        return pd.DataFrame([(*head, k, level + k * slope) for k in range(1, horizon + 1)], columns=[*keys, "step", "value"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, f"{kinds}, step int, value double")


def autocorrelation(df: DataFrame, keys: Sequence[str], order: str, value: str, lags: int) -> DataFrame:
    """(keys, lag, value): covariance at each lag over the variance."""
    w = Window.partitionBy(*keys)
    centred = df.withColumn("_x", F.col(value) - F.avg(value).over(w))
    o = w.orderBy(order)
    lagged = centred.select(*keys, "_x", *[F.lag("_x", k).over(o).alias(f"_l{k}") for k in range(1, lags + 1)])
    sums = lagged.groupBy(*keys).agg(F.sum(F.col("_x") * F.col("_x")).alias("_v"), *[F.sum(F.col("_x") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_c{k}") / F.col("_v")).alias("value")) for k in range(1, lags + 1)])
    return sums.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def change_points(df: DataFrame, keys: Sequence[str], order: str, value: str, threshold: float) -> DataFrame:
    """(keys, idx): rows, from 0, where the running sum of deviations from the mean passes the threshold; it then
    starts anew."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v = frame.sort_values(order, kind="stable")[value].to_numpy(float)
        total, found = 0.0, []
        for i, x in enumerate(v - v.mean()):
            total += x
            if abs(total) > threshold:
                found.append(i)
                total = 0.0
        head = frame[list(keys)].iloc[0].tolist()
        return pd.DataFrame([(*head, i) for i in found], columns=[*keys, "idx"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for k in keys for f in df.schema if f.name == k)
    return df.filter(F.col(value).isNotNull()).select(*keys, order, value).groupBy(*keys).applyInPandas(run, f"{kinds}, idx int")


def psi(expected: DataFrame, actual: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Population stability index over fixed bins, with half a count against empty ones."""
    bin_of = sum((F.when(F.col(value) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    count = lambda df, n: df.groupBy(bin_of.alias("bin")).agg(F.count("*").alias(n))
    both = count(expected, "e").join(count(actual, "a"), "bin", "full").fillna(0)
    total = both.agg(F.sum("e").alias("se"), F.sum("a").alias("sa"))
    p, q = F.greatest("e", F.lit(0.5)) / F.col("se"), F.greatest("a", F.lit(0.5)) / F.col("sa")
    return both.crossJoin(F.broadcast(total)).agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))


def ks_test(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """The largest distance between the two distribution functions."""
    both = a.select(value, F.lit(1.0).alias("x"), F.lit(0.0).alias("y")).union(b.select(value, F.lit(0.0), F.lit(1.0)))
    per = both.groupBy(value).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    run = running_totals(per, value, ["x", "y"])
    total = per.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    return run.select(F.col("_run_x").alias("cx"), F.col("_run_y").alias("cy")).crossJoin(F.broadcast(total)).agg(F.max(F.abs(F.col("cx") / F.col("nx") - F.col("cy") / F.col("ny"))).alias("ks"))


def diff_in_diff(df: DataFrame, treated: str, post: str, outcome: str) -> DataFrame:
    cell = lambda t, p: F.avg(F.when((F.col(treated) == t) & (F.col(post) == p), F.col(outcome)))
    return df.agg(((cell(1, 1) - cell(1, 0)) - (cell(0, 1) - cell(0, 0))).alias("effect"))


def average_treatment_effect(df: DataFrame, treated: str, outcome: str, propensity: Column) -> DataFrame:
    """Inverse propensity weighting with normalised weights; the propensity is kept within 0.01 and 0.99."""
    e = F.least(F.greatest(propensity, F.lit(0.01)), F.lit(0.99))
    t, y = F.col(treated), F.col(outcome)
    one = F.sum(t * y / e) / F.sum(t / e)
    zero = F.sum((1 - t) * y / (1 - e)) / F.sum((1 - t) / (1 - e))
    return df.agg((one - zero).alias("ate"))


def effect_on_treated(df: DataFrame, treated: str, outcome: str, propensity: Column) -> DataFrame:
    """(att,): the treated rows' mean less that of the others weighted by e / (1 - e); null without treated rows, the
    treated mean alone without others."""
    e = F.least(F.greatest(propensity, F.lit(0.01)), F.lit(0.99))
    t, y, w = F.col(treated), F.col(outcome), e / (1 - e)
    other = F.sum(F.when(t == 0, w * y)) / F.sum(F.when((t == 0) & F.col(outcome).isNotNull(), w))
    return df.agg((F.avg(F.when(t == 1, y)) - F.coalesce(other, F.lit(0.0))).alias("att"))


def propensity_scores(df: DataFrame, treated: str, covariates: Sequence[str], name: str = "propensity", **settings) -> DataFrame:
    """The rows with the probability of treatment by logistic regression, kept within 0.01 and 0.99."""
    from pyspark.ml.functions import vector_to_array

    model = train(df, "logistic", covariates, treated, **settings)
    kept = [c for c in df.columns if c != name]
    score = F.least(F.greatest(vector_to_array("probability")[1], F.lit(0.01)), F.lit(0.99))
    return model.transform(df).select(*kept, score.alias(name))


def column_profile(df: DataFrame, column: str, top: int = 3) -> DataFrame:
    """(statistic, value) of one column as text: rows, nulls, distinct values, extremes, mean and spread of numbers, and
    the most frequent values, ties to the smaller. Values are counted first, so the statistics read the counts."""
    kind = dict(df.dtypes)[column]
    number = kind in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.startswith("decimal")
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    some = F.col("v").isNotNull()
    told = {
        "row_count": F.coalesce(F.sum("n"), F.lit(0)), "null_count": F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)), "distinct_count": F.count("v"),
        "min": F.min("v"), "max": F.max("v"),
    }
    if number:
        x, n = F.col("v").cast("double"), F.when(some, F.col("n"))
        mean = F.sum(x * n) / F.sum(n)
        told |= {"mean": mean, "stddev": F.sqrt(F.greatest((F.sum(x * x * n) - mean * mean * F.sum(n)) / F.nullif(F.sum(n) - 1, F.lit(0)), F.lit(0.0)))}
    rows = [F.struct(F.lit(k).alias("statistic"), c.cast("string").alias("value")) for k, c in told.items()]
    stats = counts.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    first = counts.filter(some).orderBy(F.desc("n"), "v").limit(top)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "v"))  # at most ``top`` rows
    return stats.union(first.select(F.concat(F.lit("top_"), place).alias("statistic"), F.col("v").cast("string")))


def date_features(ts: Column) -> dict[str, Column]:
    return {
        "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "dow": F.dayofweek(ts) - 1, "hour": F.hour(ts), "is_weekend": F.dayofweek(ts).isin(1, 7),
        "doy": F.dayofyear(ts), "woy": F.weekofyear(ts), "quarter": F.quarter(ts),
    }


def train(df: DataFrame, kind: str, features: Sequence[str], target: str | None = None, **settings):
    """A fitted pipeline of assembling the features and one of Spark's learners."""
    from pyspark.ml import Pipeline, classification, clustering, regression
    from pyspark.ml.feature import VectorAssembler

    makers = {
        "linear": regression.LinearRegression, "logistic": classification.LogisticRegression, "tree": regression.DecisionTreeRegressor, "tree_classifier": classification.DecisionTreeClassifier,
        "forest": regression.RandomForestRegressor, "forest_classifier": classification.RandomForestClassifier, "gbt": regression.GBTRegressor, "gbt_classifier": classification.GBTClassifier, "kmeans": clustering.KMeans,
    }
    learner = makers[kind](featuresCol="_features", **settings)
    if target:
        learner = learner.setLabelCol(target)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), learner]).fit(df)


def predict(model, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("_features")


def isolation_forest_scores(frame: np.ndarray, trees: int = 50, sample: int = 256, seed: int = 0) -> np.ndarray:
    """Anomaly scores of the rows of a matrix: 2 ** (-mean depth / expected depth)."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(frame))
    limit = int(np.ceil(np.log2(max(size, 2))))
    c = lambda n: 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)
    total = np.zeros(len(frame))

    def walk(rows: np.ndarray, chosen: np.ndarray, depth: int) -> None:
        if depth >= limit or len(chosen) <= 1 or not len(rows):
            total[rows] += depth + c(len(chosen))
            return
        k = rng.integers(frame.shape[1])
        lo, hi = chosen[:, k].min(), chosen[:, k].max()
        if lo == hi:
            total[rows] += depth + c(len(chosen))
            return
        cut = rng.uniform(lo, hi)
        walk(rows[frame[rows, k] < cut], chosen[chosen[:, k] < cut], depth + 1)
        walk(rows[frame[rows, k] >= cut], chosen[chosen[:, k] >= cut], depth + 1)

    for _ in range(trees):
        walk(np.arange(len(frame)), frame[rng.choice(len(frame), size, replace=False)], 0)
    return 2 ** (-(total / trees) / max(c(size), 1e-9))
