"""What must not gather in a few tasks."""

from pyspark.sql import functions as F

from sparkloom.operators import tables
from sparkloom.plans import catalog


def test_sets_meet_as_distinct_rows(spark, sf_dir):
    plan = catalog.queries()["set_nulls_equal"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Join") :].count("Aggregate [") >= 1, plan  # below the join


def test_z_order_grows_by_partitions(spark):
    df = spark.range(4000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    for frame in (df, df.withColumn("a", F.lit(1).cast("long") * (F.col("a") % 2)).withColumn("b", F.col("b") + F.monotonically_increasing_id())):
        out = tables.z_order(frame, ["a", "b"], 4, 2, most=250)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 12 and max(sizes) < 500 and sum(sizes) == 4000
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, frame.collect()))
    assert tables.z_order(df, ["a", "b"], 4, 2).rdd.getNumPartitions() == 4


def test_edges_by_cells_of_time(spark, sf_dir):
    """The next event of a type is found across cells, also where a cell has none of that type."""
    from pyspark.sql.window import Window

    from sparkloom.plans import search

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    want = e.select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst")).filter("dst IS NOT NULL").distinct()
    for most in (7, 100, 250_000):
        got = search._edges(spark, sf_dir, most)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pattern_joins_on_the_condition(spark):
    from sparkloom.operators import graph

    e = spark.createDataFrame([(1, 2), (3, 2), (4, 2)], "src long, dst long")
    n = spark.createDataFrame([(1, 5), (2, 9), (3, 5), (4, 6)], "id long, events long")
    got = graph.match_pattern(e, ["a", "b", "c"], ["out", "in"], n, "a < c AND a_node.events = c_node.events")
    assert [tuple(r) for r in got.select("a", "b", "c", "b_node.events").collect()] == [(1, 2, 3, 9)]
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert "events" in joins[0], joins  # the chain's join itself, so that no row is made for each pair of neighbours
