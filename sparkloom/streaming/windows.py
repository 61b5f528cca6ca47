"""Windows, joins, deduplication and sinks of streams.

``drain`` runs a stream over everything there is (availableNow) into files and returns them: for tests, backfills and
queries. Production jobs start the same plans with their own trigger and sink.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; made here only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over Parquet files with the schema of those that are there; ``path`` may be one file."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")


def _windowed(df: DataFrame, window: Column, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    got = df.groupBy(window.alias("_w"), *keys).agg(*aggregates)
    return got.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *[c for c in got.columns if c not in ("_w", *keys)])


def tumbling(df: DataFrame, ts: str, size: str, keys: Sequence[str], aggregates: Sequence[Column], delay: str | None = None) -> DataFrame:
    """Windows [start, end); with a delay, a watermark closes them and late rows are dropped."""
    df = df.withWatermark(ts, delay) if delay else df
    return _windowed(df, F.window(ts, size), keys, aggregates)


def hopping(df: DataFrame, ts: str, size: str, slide: str, keys: Sequence[str], aggregates: Sequence[Column], delay: str | None = None) -> DataFrame:
    df = df.withWatermark(ts, delay) if delay else df
    return _windowed(df, F.window(ts, size, slide), keys, aggregates)


def session(df: DataFrame, ts: str, gap: str, keys: Sequence[str], aggregates: Sequence[Column], delay: str | None = None) -> DataFrame:
    df = df.withWatermark(ts, delay) if delay else df
    return _windowed(df, F.session_window(ts, gap), keys, aggregates)


def cumulative(df: DataFrame, ts: str, size: int, step: int, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Windows of ``size`` seconds, each seen after every ``step``: a row belongs to the ends after it."""
    at = F.unix_micros(ts)
    start = at - F.pmod(at, F.lit(size * 1_000_000))
    ends = F.filter(F.sequence(start + step * 1_000_000, start + size * 1_000_000, F.lit(step * 1_000_000)), lambda e: e > at)
    return df.withColumn("until", F.explode(F.transform(ends, F.timestamp_micros))).groupBy("until", *keys).agg(*aggregates)


def dedup(df: DataFrame, key: str, ts: str, keep: str) -> DataFrame:
    """The first row of each key within the time that is kept."""
    return df.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])


def interval_join(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, after: str, within: str, how: str = "inner", delay: str = "1 hour") -> DataFrame:
    """Pairs with ``left + after <= right <= left + within``; both watermarks bound the state."""
    a, b = left.withWatermark(left_ts, delay), right.withWatermark(right_ts, delay)
    return a.join(b, F.expr(f"{on} AND {right_ts} >= {left_ts} + INTERVAL {after} AND {right_ts} <= {left_ts} + INTERVAL {within}"), how)


def temporal_join(stream: DataFrame, versions: DataFrame, key: str, ts: str, valid_from: str) -> DataFrame:
    """The version valid at each row's time: versions get their end from the next one, then a join by range."""
    until = F.lead(valid_from).over(Window.partitionBy(key).orderBy(valid_from))
    v = versions.withColumn("_until", until).withColumnRenamed(key, "_key")
    valid = (F.col(ts) >= F.col(valid_from)) & (F.col("_until").isNull() | (F.col(ts) < F.col("_until")))
    return stream.join(v, (F.col(key) == F.col("_key")) & valid, "left").drop("_key", "_until")


def late_split(batch: DataFrame, ts: str, watermark) -> tuple[DataFrame, DataFrame]:
    """(on time, late) of a batch, for a side output inside foreachBatch."""
    return batch.filter(F.col(ts) >= F.lit(watermark)), batch.filter(F.col(ts) < F.lit(watermark))


def upsert(path_of: Callable[[], str], keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps each key's newest row, as numbered versions so a repeated batch writes the same."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path_of()}/_batch_at={number}")

    return write


def drain(df: DataFrame, mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """Runs the stream over all input and returns its result table. ``complete`` gives the last full result, ``append``
    all rows, ``update`` each key's newest row."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    writer.foreachBatch(upsert(lambda: f"{path}/out", keys)).start().awaitTermination()
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/out")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # no batch came
        return spark.createDataFrame([], fields)
    out = spark.read.parquet(f"{path}/out")
    if mode == "complete":
        last = out.agg(F.max("_batch")).first()[0]
        return out.filter(F.col("_batch") == last).select(*schema.names)
    if mode == "update":
        w = Window.partitionBy(*keys).orderBy(F.desc("_batch"))
        return out.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*schema.names)
    return out.select(*schema.names)
