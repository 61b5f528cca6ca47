import pytest
from pyspark.sql import functions as F

from sparkloom.operators import relational
from sparkloom.operators.tables import audit_chain
from sparkloom.sources.lake import Lake


@pytest.fixture
def lake(spark, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}/t")
    lake.append(spark.range(0, 10))
    lake.append(spark.range(10, 20))
    return lake


def ids(df):
    return sorted(r.id for r in df.collect())


def test_only_folders_with_a_hit_are_rewritten(lake):
    first, second = lake._manifest("main", None)["folders"]
    lake.delete_where(F.col("id") == 3)
    now = lake._manifest("main", None)["folders"]
    assert second in now and first not in now
    assert ids(lake.read()) == [i for i in range(20) if i != 3]
    lake.update_where(F.col("id") == 15, {"id": F.lit(100)})
    assert ids(lake.read()) == [i for i in range(20) if i not in (3, 15)] + [100]
    before = lake._manifest("main", None)["folders"]
    lake.delete_where(F.col("id") < 0)
    assert lake._manifest("main", None)["folders"] == before
    assert ids(lake.read(version=1)) == list(range(20))


def test_fast_forward_needs_an_unmoved_base(lake, spark):
    lake.create_branch("work")
    lake.delete_where(F.col("id") < 5, "work")
    lake.fast_forward("main", "work")
    assert ids(lake.read()) == list(range(5, 20))
    lake.delete_where(F.col("id") == 7, "work")
    lake.append(spark.range(50, 51))
    with pytest.raises(RuntimeError):
        lake.fast_forward("main", "work")
    assert 50 in ids(lake.read())


def test_running_totals(spark):
    rows = [(i * 7 % 1000, 1) for i in range(1000)]
    got = relational.running_totals(spark.createDataFrame(rows, "v int, n int"), "v", ["n"])
    assert all(r._run_n == r.v + 1 for r in got.collect())
    some = spark.createDataFrame([(None, 2), (5, 3)], "v int, n int")
    assert {r.v: r._run_n for r in relational.running_totals(some, "v", ["n"]).collect()} == {None: 2, 5: 5}
    assert relational.running_totals(some.filter("false"), "v", ["n"]).count() == 0


def test_audit_chain_sees_every_change(spark):
    df = spark.createDataFrame([(k, i, f"x{i}") for k in ("a", None) for i in range(50)], "k string, i int, x string")
    digests = lambda d: {(r.k, r.i): r.digest for r in audit_chain(d, ["k"], "i", ["x"]).collect()}
    one, two = digests(df), digests(df.withColumn("x", F.when((F.col("i") == 20) & F.col("k").isNull(), "y").otherwise(F.col("x"))))
    assert len(one) == 100 and {key for key in one if one[key] != two[key]} == {(None, i) for i in range(20, 50)}
