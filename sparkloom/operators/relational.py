"""Relational operators that Spark has no single word for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str) -> DataFrame:
    """For each left row the right row of the same key with the latest time not after it, or nulls.

    Both sides are put in one sequence per key and the last right row is carried forward: one shuffle by key and one
    sort, and never a pair more than the result. Right rows of one time are ordered by their values.
    """
    payload = [c for c in right.columns if c not in keys and c != right_ts]
    one = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).alias("_right"))
    two = right.select(*keys, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.lit(None).alias("_left"), F.struct(*payload).alias("_right"))
    w = Window.partitionBy(*keys).orderBy("_ts", "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = one.unionByName(two).withColumn("_found", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select("_left.*", *[F.col(f"_found.{c}").alias(c) for c in payload])


def range_join(left: DataFrame, right: DataFrame, start: str, end: str, at: str, keys: Sequence[str] = (), width_seconds: int = 3600) -> DataFrame:
    """Pairs with ``start <= at < end``: left rows go to each cell of the width that they touch, right rows to their
    one cell, and an equi-join on keys and cell replaces the nested loop."""
    cell = lambda c: F.floor(F.unix_micros(c) / (width_seconds * 1_000_000)).cast("long")
    one = left.withColumn("_cell", F.explode(F.sequence(cell(F.col(start).cast("timestamp")), cell(F.col(end).cast("timestamp")))))
    two = right.withColumn("_cell", cell(F.col(at).cast("timestamp")))
    joined = one.join(two, [*keys, "_cell"])
    return joined.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def limit_with_ties(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in order and all that tie with the last of them. The limit comes first, so only its last key
    is compared with the table: no sort of the whole in one task."""
    last = df.orderBy(*order).limit(n).agg(F.max(F.struct(*order)).alias("_last"))
    return df.crossJoin(F.broadcast(last)).filter(F.struct(*order) <= F.col("_last")).drop("_last")


def running_totals(df: DataFrame, order: str, values: Sequence[str], name: str = "_run_{}", ranges: int = 256) -> DataFrame:
    """The rows with the total of each column up to and with the row in ascending ``order``, which is unique or null once.

    No task sees the whole table: approximate quantiles cut the order into ranges, totals run inside each range, and
    the totals of the ranges before (at most ``ranges`` rows, hence broadcast) are added."""
    edges = df.agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 10_000).alias("e")).first()["e"] or []
    cut = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e <= F.col(order))) if edges else F.lit(0)
    rows = df.withColumn("_range", cut)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_range").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    base = sums.select("_range", *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_base_{v}") for v in values])
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = [(F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_base_{v}")).alias(name.format(v)) for v in values]
    return rows.join(F.broadcast(base), "_range").select(*df.columns, *totals)


def user_aggregate(df: DataFrame, keys: Sequence[str], value: str, initial, step: Callable, combine: Callable, final: Callable, kind: str, name: str) -> DataFrame:
    """A user-defined aggregate in two phases: states per partition and key, then combined by key."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys)

    def partial(frames):
        states: dict = {}
        for frame in frames:
            for key, x in zip(frame[list(keys)].itertuples(index=False, name=None), frame[value], strict=True):
                states[key] = step(states.get(key, initial), x)
        yield pd.DataFrame([(*k, s) for k, s in states.items()], columns=[*keys, "_state"])

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        state = frame["_state"].iloc[0]
        for other in frame["_state"].iloc[1:]:
            state = combine(state, other)
        return pd.DataFrame([(*frame[list(keys)].iloc[0], final(state))], columns=[*keys, name])

    states = df.select(*keys, value).mapInPandas(partial, f"{fields}, _state {kind}")
    return states.groupBy(*keys).applyInPandas(whole, f"{fields}, {name} {kind}")


def pivot(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, aggregate: Column) -> DataFrame:
    """One column per value; the values are named, so no extra pass looks for them."""
    return df.groupBy(*keys).pivot(column, list(values)).agg(aggregate)
