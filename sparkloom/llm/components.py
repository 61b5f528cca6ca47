"""Connected components of a graph held as a DataFrame of edges, by alternating large and small stars.

Edges are rewritten until they are stars around each component's smallest node. Every round is written to the shared
folder, so lineage stays short and lost executors cost one round at most; neither links nor components reach the
driver, only a count and a checksum of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle_counted

MAX_ROUNDS = 50


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest node of the component."""
    mark = {"n": F.count("*"), "h": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    stars, before = settle_counted(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", **mark)
    for _ in range(MAX_ROUNDS):
        if not before["n"]:
            break
        both = stars.union(stars.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars, after = settle_counted(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges", **mark)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    roots = stars.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
