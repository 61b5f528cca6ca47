"""Sinks for ``foreachBatch``: late rows aside, windows that reopen, dead letters and retries.

Each batch writes folders of its own number, so a batch that runs again after a failure replaces what it wrote and
nothing is counted twice. What a batch must know of those before is read from their folders, not kept in the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


class LateSplit:
    """Rows with a flag ``late``: those behind the watermark when their batch came.

    The watermark of a batch is the latest time in the batches before less the delay; the first batch has none. On-time
    rows and the side output are the two folders of ``rows``."""

    def __init__(self, path: str, ts: str, delay_seconds: int):
        self.path, self.ts, self.delay = path.rstrip("/"), ts, delay_seconds

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{self.path}/latest/_batch_at={number - 1}"
        high = spark.read.parquet(before).first()["high"] if number and _there(spark, before) else None
        at = F.unix_micros(F.col(self.ts).cast("timestamp"))
        late = at < (high - self.delay * 1_000_000) if high is not None else F.lit(False)
        rows = f"{self.path}/rows/_batch_at={number}"
        batch.withColumn("late", F.coalesce(late, F.lit(False))).write.mode("overwrite").parquet(rows)
        top = spark.read.schema(batch.schema).parquet(rows).agg(F.greatest(F.max(at), F.lit(high).cast("long")).alias("high"))
        top.write.mode("overwrite").parquet(f"{self.path}/latest/_batch_at={number}")

    def rows(self, spark: SparkSession, late: bool | None = None) -> DataFrame:
        found = spark.read.parquet(f"{self.path}/rows")
        return found if late is None else found.filter(F.col("late") == late)


class ReopenWindows:
    """Changes of counts and sums of tumbling windows, late rows included.

    A window's first rows give ``+I``; rows that come later give the pair ``-U`` with the old and ``+U`` with the new
    figures, so readers who apply the changes in order always hold the whole answer. Partial figures of each batch are
    kept, and only windows that a batch touches are summed again."""

    def __init__(self, path: str, ts: str, size: str, keys: Sequence[str], value: str):
        self.path, self.ts, self.size, self.keys, self.value = path.rstrip("/"), ts, size, list(keys), value

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        group = ["start", *self.keys]
        part = batch.select(F.window(self.ts, self.size)["start"].alias("start"), *self.keys, F.col(self.value).alias("_v"))
        mine = f"{self.path}/parts/_batch_at={number}"
        part.groupBy(*group).agg(F.count("*").alias("n"), F.sum("_v").alias("s")).write.mode("overwrite").parquet(mine)
        delta = spark.read.parquet(mine)
        fits = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in group]
        touched = spark.read.parquet(f"{self.path}/parts").filter(F.col("_batch_at") < number).alias("p").join(delta.select(*group).alias("d"), fits("p", "d"), "left_semi")
        old = touched.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        both = delta.alias("d").join(old.alias("o"), fits("d", "o"), "left")
        plus = lambda c: F.when(F.col(f"o.{c}").isNull(), F.col(f"d.{c}")).otherwise(F.coalesce(F.col(f"d.{c}"), F.lit(0)) + F.col(f"o.{c}"))
        row = lambda op, n, s: F.struct(F.lit(op).alias("op"), n.alias("n"), s.alias("s"))
        new = F.array(row("+I", F.col("d.n"), F.col("d.s")))
        again = F.array(row("-U", F.col("o.n"), F.col("o.s")), row("+U", plus("n"), plus("s")))
        changes = both.select(*[F.col(f"d.{c}").alias(c) for c in group], F.explode(F.when(F.col("o.n").isNull(), new).otherwise(again)).alias("x"))
        changes.select(*group, "x.*").write.mode("overwrite").parquet(f"{self.path}/changes/_batch_at={number}")

    def changes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/changes")


def parse_or_divert(df: DataFrame, text: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(parsed, dead letters) of JSON texts; a null or a text that does not parse is a dead letter with its reason."""
    wanted = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">")
    fields = StructType.fromDDL(wanted).add("_bad", "string")
    read = df.withColumn("_row", F.from_json(text, fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    broken = F.col(text).isNull() | F.col("_row._bad").isNotNull()
    kept = [c for c in df.columns if c != text]
    good = read.filter(~broken).select(*kept, *[F.col(f"_row.{f}").alias(f) for f in StructType.fromDDL(wanted).names])
    reason = F.when(F.col(text).isNull(), "no text").otherwise("not of the schema")
    return good, read.filter(broken).select(*df.columns, reason.alias("reason"))


def replay(letters: DataFrame, text: str, schema: StructType | str, mend: Column) -> tuple[DataFrame, DataFrame]:
    """Dead letters once more, after ``mend`` has made a new text of each."""
    return parse_or_divert(letters.drop("reason").withColumn(text, mend), text, schema)


def retried(sink: Callable[[DataFrame, int], None], attempts: int = 3, wait_seconds: float = 1.0, fails: type[Exception] = Exception) -> Callable[[DataFrame, int], None]:
    """The sink, run again after a failure with twice the wait each time; the last failure is raised."""

    def run(batch: DataFrame, number: int) -> None:
        for k in range(attempts):
            try:
                return sink(batch, number)
            except fails:
                if k + 1 == attempts:
                    raise
                time.sleep(wait_seconds * 2**k)

    return run
