"""File formats by name: JSON, JSON lines, CSV, Parquet, ORC, text, Arrow IPC, and Avro where its package is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_OPTIONS = {"json": ("json", {"multiLine": "true"}), "jsonl": ("json", {}), "csv": ("csv", {"header": "true"}), "parquet": ("parquet", {}), "orc": ("orc", {}), "text": ("text", {}), "avro": ("avro", {})}


def read(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options: str) -> DataFrame:
    """With a schema nothing is inferred, so the files are read once."""
    if kind == "arrow":
        return _read_arrow(spark, path, schema)
    name, given = _OPTIONS[kind]
    reader = spark.read.format(name).options(**given | options)
    if schema:
        reader = reader.schema(schema)
    elif kind == "csv":
        reader = reader.option("inferSchema", "true")
    return reader.load(path)


def write(df: DataFrame, path: str, kind: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options: str) -> None:
    if kind == "arrow":
        return _write_arrow(df, path)
    name, given = _OPTIONS["jsonl" if kind == "json" else kind]
    writer = df.write.format(name).options(**given | options).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return None


def copy(spark: SparkSession, source: str, source_kind: str, target: str, target_kind: str, schema: str | None = None) -> None:
    write(read(spark, source, source_kind, schema), target, target_kind)


def _write_arrow(df: DataFrame, path: str) -> None:
    """Arrow IPC streams, one row of bytes per partition chunk, held in Parquet's committed folder layout so that
    writing is atomic on any store."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as w:
                w.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["ipc"])

    df.mapInArrow(run, "ipc binary").write.parquet(path)


def _read_arrow(spark: SparkSession, path: str, schema: str | None) -> DataFrame:
    import pyarrow as pa

    if not schema:
        raise ValueError("Arrow streams are read with a schema")

    def run(batches):
        for batch in batches:
            for x in batch.column(0):
                yield from pa.ipc.open_stream(x.as_buffer())

    return spark.read.parquet(path).mapInArrow(run, schema)
