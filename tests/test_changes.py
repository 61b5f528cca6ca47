import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import cdc
from sparkloom.streaming import sinks


def test_apply_changes_policies_and_null_keys(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    c = spark.createDataFrame([(1, "x", "insert", 1), (2, None, "delete", 1), (3, "n", "update", 1), (3, "m", "insert", 2), (None, "z", "update", 1)], "k int, v string, _change_type string, at int")
    rows = lambda policy: {(r.k, r.v) for r in cdc.apply_changes(t, c, ["k"], ["at"], policy).collect()}
    assert rows("overwrite") == {(1, "x"), (3, "m"), (None, "z")}
    assert rows("ignore") == {(1, "a"), (3, "m"), (None, "z")}
    assert cdc.apply_changes(t, c.filter("false"), ["k"], ["at"]).count() == 3


def test_decoders_leave_out_what_is_no_change(spark):
    m = spark.createDataFrame([(None,), ("",), ("{}",), ('{"op":"x"}',), ('{"op":"r","after":{"k":1}}',), ("not json",)], "m string")
    assert [tuple(r) for r in cdc.decode_debezium(m, "m", "k int").collect()] == [(1, "insert")]
    w = spark.createDataFrame([(None,), ('{"change":[]}',), ('{"change":[{"kind":"message"}]}',)], "m string")
    assert cdc.decode_wal2json(w, "m", "k int").count() == 0


def test_portion_of_an_open_and_an_empty_overlap(spark):
    day = lambda d: dt.date(2024, 1, d)
    h = spark.createDataFrame([(1, "a", day(1), None), (2, "b", day(1), day(5)), (3, "c", day(12), day(20))], "k int, v string, valid_from date, valid_to date")
    got = cdc.for_portion(h, F.lit(day(5)), F.lit(day(10)), {"v": F.lit("X")})
    assert sorted((r.k, r.v, r.valid_from.day, r.valid_to and r.valid_to.day) for r in got.collect() if r.valid_to) == [(1, "X", 5, 10), (1, "a", 1, 5), (2, "b", 1, 5), (3, "c", 12, 20)]
    assert [(r.k, r.v, r.valid_from.day) for r in got.filter("valid_to IS NULL").collect()] == [(1, "a", 10)]


def test_returning_tells_inserts_deletes_and_changes(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string"), spark.createDataFrame([(1, "a"), (2, "c"), (4, "d"), (3, None)], "k int, v string")
    got = {r.k: (r.old and r.old.v, r.new and r.new.v) for r in cdc.returning(a, b, ["k"]).collect()}
    assert got == {2: ("b", "c"), 4: (None, "d")}


def test_retried_sinks_run_again_and_raise_at_last():
    seen = []

    def sink(batch, number):
        seen.append(number)
        if len(seen) < 3:
            raise OSError("gone")

    sinks.retried(sink, 3, 0)(None, 7)
    assert seen == [7, 7, 7]
    with pytest.raises(OSError):
        sinks.retried(lambda b, n: (_ for _ in ()).throw(OSError()), 2, 0)(None, 0)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d)
    batch = lambda rows: spark.createDataFrame(rows, "ts timestamp, k string, v double")
    one, two = batch([(day(10), "a", 1.0), (day(3), "a", None)]), batch([(day(2), "a", 2.0), (day(10), "a", 4.0), (None, None, 1.0)])
    late = sinks.LateSplit(f"file://{tmp_path}/l", "ts", 86_400)
    windows = sinks.ReopenWindows(f"file://{tmp_path}/w", "ts", "1 day", ["k"], "v")
    for number, rows in ((0, one), (1, two), (1, two), (2, one.filter("false"))):
        late(rows, number)
        windows(rows, number)
    assert late.rows(spark).count() == 5 and [r.ts.day for r in late.rows(spark, True).collect()] == [2]
    got = sorted((r.start.day, r.op, r.n, r.s) for r in windows.changes(spark).filter("start IS NOT NULL").collect())
    assert got == [(2, "+I", 1, 2.0), (3, "+I", 1, None), (10, "+I", 1, 1.0), (10, "+U", 2, 5.0), (10, "-U", 1, 1.0)]
