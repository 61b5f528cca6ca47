"""Change data: decoders of two public envelope formats and changes applied to tables.

Decoded changes have the table's columns, ``_change_type`` (insert, update, delete) and what the envelope carries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def _named(kind):
    return F.when(kind.isin("c", "r"), "insert").when(kind == "u", "update").when(kind == "d", "delete")


def decode_debezium(messages: DataFrame, value: str, columns: str) -> DataFrame:
    """Rows of envelopes of before, after and op, with or without a payload around; ``columns`` is their DDL. Deletes
    carry the row before. Messages without a known op, such as tombstones, give no row."""
    inner = f"before struct<{_ddl(columns)}>, after struct<{_ddl(columns)}>, op string"
    read = messages.withColumn("_m", F.from_json(value, f"payload struct<{_ddl(inner)}>, {inner}"))
    part = lambda c: F.coalesce(f"_m.payload.{c}", f"_m.{c}")
    told = read.withColumn("_change_type", _named(part("op"))).filter("_change_type IS NOT NULL")
    kept = [c for c in messages.columns if c != value]
    row = F.when(F.col("_change_type") == "delete", part("before")).otherwise(part("after"))
    return told.select(*kept, row.alias("_row"), "_change_type").select(*kept, "_row.*", "_change_type")


def _ddl(columns: str) -> str:
    return StructType.fromDDL(columns).simpleString().removeprefix("struct<").removesuffix(">")


def decode_wal2json(messages: DataFrame, value: str, columns: str) -> DataFrame:
    """Rows of transactions with a list of changes, each of kind, column names and values; deletes give the old keys and
    nulls. ``_place`` is a change's place in its transaction."""
    change = "struct<kind:string,table:string,columnnames:array<string>,columnvalues:array<string>,oldkeys:struct<keynames:array<string>,keyvalues:array<string>>>"
    read = messages.withColumn("_m", F.from_json(value, f"change array<{change}>"))
    kept = [c for c in messages.columns if c != value]
    each = read.select(*kept, F.posexplode("_m.change").alias("_place", "_c")).filter(F.col("_c.kind").isin("insert", "update", "delete"))
    gone = F.col("_c.kind") == "delete"
    pairs = F.map_from_arrays(F.when(gone, F.col("_c.oldkeys.keynames")).otherwise(F.col("_c.columnnames")), F.when(gone, F.col("_c.oldkeys.keyvalues")).otherwise(F.col("_c.columnvalues")))
    fields = [F.try_element_at(pairs, F.lit(f.name)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(columns)]
    return each.select(*kept, "_place", *fields, F.col("_c.kind").alias("_change_type"))


def apply_changes(table: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], on_conflict: str = "overwrite") -> DataFrame:
    """The table after the last change of each key. ``on_conflict`` says what an insert of a key that is there does:
    ``overwrite`` or ``ignore``. One shuffle by key; null keys count as one key."""
    values = table.columns
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    new = changes.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").select(*values, F.col("_change_type").alias("_op"))
    both = table.withColumn("_op", F.lit("there")).unionByName(new)
    w = Window.partitionBy(*keys)
    known, change = F.max(F.col("_op") == "there").over(w), F.max(F.when(F.col("_op") != "there", F.col("_op"))).over(w)
    told = both.select("*", known.alias("_known"), change.alias("_change"))
    refused = F.col("_known") & (F.col("_change") == "insert") & F.lit(on_conflict == "ignore")
    stays = F.when(F.col("_op") == "there", F.col("_change").isNull() | refused).otherwise((F.col("_op") != "delete") & ~refused)
    return told.filter(stays).select(*values)


def returning(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, old, new) of every row that a change of a table inserted, deleted or altered; one side is null for the
    first two. Keys are unique in each table."""
    a, b = old.select(*keys, F.struct(*old.columns).alias("old")), new.select(*keys, F.struct(*new.columns).alias("new"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.alias("a").join(b.alias("b"), on, "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], "old", "new")


def as_of_system_time(history: DataFrame, at, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """The rows of a versioned table that were current at a time: from <= at < to, an open end counting as for ever."""
    return history.filter((F.col(valid_from) <= at) & (F.col(valid_to).isNull() | (at < F.col(valid_to))))


def for_portion(history: DataFrame, start, end, changes: dict, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """The rows after an update of the part of their period inside [start, end): a row is cut in up to three pieces, of
    which the middle one takes the new values."""
    lo, hi = F.col(valid_from), F.col(valid_to)
    hit = (lo < end) & (hi.isNull() | (start < hi))
    inside = F.struct(F.greatest(lo, start).alias("a"), F.when(hi.isNull(), end).otherwise(F.least(hi, end)).alias("b"), F.lit(True).alias("c"))
    before = F.when(hit & (lo < start), F.struct(lo.alias("a"), start.alias("b"), F.lit(False).alias("c")))
    after = F.when(hit & (hi.isNull() | (end < hi)), F.struct(end.alias("a"), hi.alias("b"), F.lit(False).alias("c")))
    whole = F.when(~hit, F.struct(lo.alias("a"), hi.alias("b"), F.lit(False).alias("c")))
    pieces = F.filter(F.array(before, F.when(hit, inside), after, whole), lambda p: p.isNotNull())
    cut = history.withColumn("_p", F.explode(pieces))
    new = {c: F.when(F.col("_p.c"), v).otherwise(F.col(c)) for c, v in changes.items()}
    return cut.withColumns(new | {valid_from: F.col("_p.a"), valid_to: F.col("_p.b")}).drop("_p")
