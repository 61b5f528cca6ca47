"""Labelled rows, all or a bounded sample, and the folds that a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo FOLDS; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def held_out(id_col: str) -> Column:
    return F.coalesce(fold(id_col) == 0, F.lit(False))


def usable_labels(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """(key, label) of the rows that a classifier may learn from."""
    found = labels.select(F.col(id_col).alias("key"), F.col(label).cast("int").alias("label"))
    return found.filter(F.col("label").isNotNull() & (fold("key") != 0))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str, text_col: str) -> DataFrame:
    """(key, text, label) of about ``bound`` labelled rows at most, none of them held out.

    The rows are chosen by a hash of the id, so the choice is the same in every run. Their ids, bounded by
    ``bound``, are what is broadcast; the texts are not shuffled.
    """
    usable = usable_labels(labels, label, id_col)
    n = usable.count()
    share = min(1.0, bound / n) if n else 1.0
    chosen = usable.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "key")
