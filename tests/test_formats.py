import duckdb

from sparkloom.functions import text
from sparkloom.plans import catalog


def test_truncation_formatting_of_large_keys(spark, tmp_path):
    """Keys of a million bytes and more, and halves: the SQL has no unit above KB."""
    keys = [1, 3, 4, 11, 39, 40, 41, 399, 401, 402, 3999, 4000, 4001, 20000, 120001, 4000001]
    rows = [(k, "a name", k % 50 + 1) for k in keys]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["truncation_formatting"])
    got = catalog.queries()["truncation_formatting"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_bytes_up_to_the_largest_unit(spark):
    x = spark.range(1).selectExpr("12000000L AS n")
    assert tuple(x.select(text.format_bytes(x.n), text.format_bytes(x.n, "KB")).first()) == ("12.0 MB", "12000 KB")
