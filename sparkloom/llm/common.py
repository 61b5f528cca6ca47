"""What the operators of this subpackage share: shared storage, batches, session settings."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import posixpath
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Rows of an Arrow batch: with texts of a few KB, a few MB; memory follows the batch, not the partition.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one made here if that is unset and all runs
    on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read from there: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_counted(df: DataFrame, name: str, **facts: Column) -> tuple[DataFrame, dict]:
    """As ``settle``, and aggregates of the rows that are taken while they are written, without a job of their own."""
    seen = Observation()
    out = settle(df.observe(seen, *[c.alias(k) for k, c in facts.items()]), name)
    return out, seen.get


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches are small. Plans run later than they are made, so this stays set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_caches: list[dict] = []


def cache() -> dict:
    """A worker's cache of large objects, which lasts until a task of an operator without it calls ``release``."""
    _caches.append({})
    return _caches[-1]


def release() -> None:
    """Lets go what tasks of other operators have left in this worker, and gives the memory back."""
    if any(_caches):
        for c in _caches:
            c.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def _local(path: str) -> str | None:
    parts = urlparse(path)
    return (parts.path or path) if parts.scheme in ("", "file") else None


def write_bytes(path: str, blocks) -> None:
    """Writes a file of the shared folder whole or not at all: under another name first, then renamed, so that a
    task that is tried again or twice leaves one complete file."""
    local = _local(path)
    mine = f"{path}.{uuid.uuid4().hex}"
    if local is not None:
        mine = _local(mine)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(mine, "wb") as f:
            for block in blocks:
                f.write(block)
        os.replace(mine, local)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(posixpath.dirname(inner), recursive=True)
    temp = f"{inner}.{uuid.uuid4().hex}"
    with store.open_output_stream(temp) as f:
        for block in blocks:
            f.write(block)
    store.move(temp, inner)


def open_bytes(path: str):
    """A readable, seekable binary file of the shared folder."""
    local = _local(path)
    if local is not None:
        return open(local, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)
