"""Hand-made cases of operators and functions: errors, ties, nulls and published test vectors."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import bits, domain, numeric, text
from sparkloom.operators import analytics, relational, search, tables, timeseries
from sparkloom.sources.lake import Lake


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_checksum_vectors():
    assert bits.crc32c.plain(b"123456789") == 0xE3069283
    assert bits.fnv1a_64.plain("a") == bits.signed(0xAF63DC4C8601EC8C)
    assert bits.murmur3_32.plain(b"hello", 0) == 0x248BFA47
    assert bits.xxhash64.plain(b"") == bits.signed(0xEF46DB3751D8E999)
    assert bits.base58_encode.plain(b"Hello World!") == "2NEpo7TZRRrLZSi2U"
    assert bits.base58_decode.plain(bits.base58_encode.plain(b"\0\0ab")) == b"\0\0ab"
    assert bits.hmac_sha256.plain(b"key", b"The quick brown fox jumps over the lazy dog").hex().startswith("f7bc83f430538424")
    assert {bits.consistent_hash.plain(str(k), 5) for k in range(200)} == set(range(5))


def test_distances():
    assert text.damerau_levenshtein.plain("ca", "ac") == 1
    assert round(text.jaro_winkler.plain("MARTHA", "MARHTA"), 4) == 0.9611
    assert round(text.jaro_similarity.plain("DIXON", "DICKSONX"), 4) == 0.7667


def test_json_patches():
    assert text.json_merge_patch.plain('{"a":{"b":1},"c":2}', '{"a":{"b":null,"d":3}}') == '{"a": {"d": 3}, "c": 2}'
    a, b = '{"a": [1, 2], "k/x": {"z": 1}}', '{"a": [1, 3], "n": null, "k/x": {}}'
    assert text.json_equals.plain(text.json_patch.plain(a, text.json_diff.plain(a, b)), b)


def test_cron():
    at = dt.datetime(2024, 2, 28, 23, 59, 30)
    assert domain.cron_next.plain("0 0 29 2 *", at) == dt.datetime(2024, 2, 29)
    assert domain.cron_prev.plain("*/15 * * * *", at) == dt.datetime(2024, 2, 28, 23, 45)
    assert domain.cron_matches.plain("59 23 * * 3", at)


def test_finance_and_ratings():
    assert round(numeric.irr.plain([-100, 60, 60]), 6) == 0.130662
    rating, rd, volatility = numeric.glicko2_update.plain(1500, 200, 0.06, [(1400, 30, 1), (1550, 100, 0), (1700, 300, 0)])
    assert abs(rating - 1464.06) < 0.1 and abs(rd - 151.52) < 0.1 and abs(volatility - 0.05999) < 1e-4


def test_array_functions(spark):
    a = F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4, 10)])
    assert one(spark, numeric.moving_average(a, 2)) == [1.0, 1.5, 2.5, 3.5, 7.0]
    assert one(spark, numeric.exponential_smoothing(a, 0.5)) == [1.0, 1.5, 2.25, 3.125, 6.5625]
    assert one(spark, numeric.outlier_detect_iqr(a, 1.5)) == [False] * 4 + [True]
    v = np.array([1, 2, 3, 4, 10.0])
    m, sd = v.mean(), v.std(ddof=1)
    assert abs(one(spark, numeric.skewness(a)) - ((v - m) ** 3).mean() / sd**3) < 1e-9
    assert abs(one(spark, numeric.kurtosis(a)) - (((v - m) ** 4).mean() / sd**4 - 3)) < 1e-9


def test_natural_order(spark):
    rows = spark.createDataFrame([("file10",), ("file9",), ("file100",), ("a",)], "x string")
    assert [r.x for r in rows.orderBy(text.natural_sort_key(F.col("x"))).collect()] == ["a", "file9", "file10", "file100"]


def test_merge_refuses_two_matches(spark):
    t = spark.createDataFrame([(1, 1)], "k int, v int")
    s = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="two source rows"):
        tables.merge(t, s, ["k"], {"v": F.col("s.v")}).collect()


def test_three_way_conflict(spark):
    make = lambda v: spark.createDataFrame([(1, v), (2, "same")], "k int, v string")
    merged, conflicts = tables.three_way_merge(make("base"), make("ours"), make("theirs"), ["k"])
    assert [r.k for r in merged.collect()] == [2] and [r.k for r in conflicts.collect()] == [1]


def test_lake_race_and_times(spark, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}/t")
    lake.append(spark.range(3))
    with pytest.raises(Exception):
        lake._write("_manifest/main/000000000.json", {})
    lake.overwrite(spark.range(5))
    assert lake.read().count() == 5 and lake.read(0).count() == 3
    assert lake.history().count() == 2


def test_gapfill_guard(spark):
    df = spark.createDataFrame([(1, dt.datetime(1970, 1, 1)), (1, dt.datetime(2024, 1, 1))], "k int, ts timestamp")
    with pytest.raises(Exception, match="too many buckets"):
        timeseries.gapfill(df, ["k"], "ts", 60, [F.count("*").alias("n")]).collect()


def test_asof_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 1, "x")], "k int, t int, v string")
    assert {(r.k, r.t, r.v) for r in relational.asof_join(left, right, ["k"], "t", "t").collect()} == {(1, 5, "b"), (1, 0, None), (2, 5, None)}


def test_limit_with_ties(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,)], "x int")
    assert sorted(r.x for r in relational.limit_with_ties(df, ["x"], 2).collect()) == [1, 2, 2]


def test_query_language(spark):
    d = spark.createDataFrame([(1, "quick brown fox"), (2, "brown quick dog"), (3, "slow foxes")], "id int, t string")
    found = lambda q: {r.id for r in d.filter(search.matches(F.col("t"), q)).collect()}
    assert found('"quick brown"') == {1} and found("+brown -dog") == {1} and found("fox*") == {1, 3} and found("quikc~2") == {1, 2}
    assert found("f?x") == {1} and found('"quick dog"~0') == {2}


def test_expectations(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "x int")
    with pytest.raises(Exception, match="expectation"):
        tables.expect(df, F.col("x") > 0, "fail")[0].collect()
    good, bad = tables.expect(df, F.col("x") > 2, "quarantine")
    assert good.count() == 1 and bad.count() == 2


def test_isolation_forest_finds_the_odd_one():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(300, 2)), [[9, 9]]])
    assert analytics.isolation_forest_scores(x).argmax() == 300


def test_parity_of_ids(spark):
    got = spark.range(20).select(domain.ulid().alias("u"), domain.nanoid().alias("n"), domain.uuid_v7().alias("v")).collect()
    assert len({r.u for r in got}) == 20 and all(len(r.u) == 26 and len(r.n) == 21 and r.v[14] == "7" for r in got)


def test_merge_inserts_rows_with_a_null_key(spark):
    from sparkloom.operators import tables

    target = spark.createDataFrame([(1, "a"), (None, "b")], "k long, v string")
    source = spark.createDataFrame([(1, "x"), (None, "y"), (None, "z")], "k long, v string")
    got = tables.merge(target, source, ["k"], update={"v": F.col("s.v")}).collect()
    assert sorted((r.k or 0, r.v) for r in got) == [(0, "b"), (0, "y"), (0, "z"), (1, "x")]


def test_scd3_takes_a_new_null(spark):
    from sparkloom.operators import tables

    dim = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    got = tables.scd3(dim, spark.createDataFrame([(1, None)], "k long, v string"), ["k"], ["v"]).collect()
    assert sorted((r.k, r.v, r.previous_v) for r in got) == [(1, None, "a"), (2, "b", None)]
