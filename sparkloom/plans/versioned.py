"""Merges, updates, slowly changing dimensions, change feeds, versions, quality, masking and formats."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import tables as T
from ..sources import formats
from ..sources.lake import Lake
from ..streaming.windows import shared_dir
from .catalog import register, table

_TARGET = "SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 3 <> 0"
_SOURCE = "SELECT c_custkey AS k, c_nationkey + 100 AS v FROM customer WHERE c_custkey % 2 = 0"


def _pair(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.filter("c_custkey % 3 <> 0").selectExpr("c_custkey AS k", "c_nationkey AS v"), c.filter("c_custkey % 2 = 0").selectExpr("c_custkey AS k", "c_nationkey + 100 AS v")


@register("merge_update_insert_delete", f"""WITH t AS ({_TARGET}), s AS ({_SOURCE}) SELECT coalesce(t.k, s.k) AS k, CASE WHEN t.k IS NOT NULL AND s.k IS NOT NULL THEN s.v ELSE coalesce(t.v, s.v) END AS v FROM t FULL JOIN s ON t.k = s.k
  WHERE NOT coalesce(t.k IS NOT NULL AND s.k IS NOT NULL AND s.v = 105, false)""")
def _merge(spark, sf_dir):
    t, s = _pair(spark, sf_dir)
    return T.merge(t, s, ["k"], {"v": F.col("s.v")}, delete=F.col("s.v") == 105)


@register("update_where", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders")
def _update(spark, sf_dir):
    return T.update_where(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("o_orderstatus") == "O", {"o_custkey": F.col("o_custkey") + 1}).drop("o_orderstatus")


@register("delete_where", "SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'O') = 'F', false)")
def _delete(spark, sf_dir):
    return T.delete_where(table(spark, sf_dir, "orders"), F.nullif("o_orderstatus", F.lit("O")) == "F").select("o_orderkey")


@register("table_diff", f"""WITH t AS ({_TARGET}), s AS ({_SOURCE}) SELECT coalesce(t.k, s.k) AS k, CASE WHEN t.k IS NULL THEN 'inserted' WHEN s.k IS NULL THEN 'deleted' ELSE 'modified' END AS change, t.v AS old, s.v AS new
  FROM t FULL JOIN s ON t.k = s.k WHERE t.v IS DISTINCT FROM s.v""")
def _diff(spark, sf_dir):
    return T.diff(*_pair(spark, sf_dir), ["k"]).select("k", "change", F.col("old.v").alias("old"), F.col("new.v").alias("new"))


@register("change_feed", f"""WITH t AS ({_TARGET}), s AS ({_SOURCE}) SELECT k, v, CASE WHEN k IN (SELECT k FROM s) THEN 'update_preimage' ELSE 'delete' END AS _change_type, 2 AS _version FROM t
  UNION ALL SELECT k, v, CASE WHEN k IN (SELECT k FROM t) THEN 'update_postimage' ELSE 'insert' END, 2 FROM s""")
def _feed(spark, sf_dir):
    return T.change_feed(*_pair(spark, sf_dir), ["k"], 2)


@register("change_envelopes", f"""WITH t AS ({_TARGET}), s AS ({_SOURCE}) SELECT op, count(*) AS n FROM (SELECT CASE WHEN t.k IS NULL THEN 'c' WHEN s.k IS NULL THEN 'd' ELSE 'u' END AS op FROM t FULL JOIN s ON t.k = s.k) x GROUP BY op""")
def _envelopes(spark, sf_dir):
    e = T.debezium(T.change_feed(*_pair(spark, sf_dir), ["k"], 2), ["k"], "customer")
    return e.groupBy(F.get_json_object("value", "$.op").alias("op")).agg(F.count("*").alias("n"))


def _dimension(spark, sf_dir):
    t, s = _pair(spark, sf_dir)
    dim = t.selectExpr("*", "CAST(DATE '2020-01-01' AS date) AS valid_from", "CAST(NULL AS date) AS valid_to", "true AS is_current")
    return dim, s


@register("scd_type_1", f"WITH t AS ({_TARGET}), s AS ({_SOURCE}) SELECT * FROM t WHERE k NOT IN (SELECT k FROM s) UNION ALL SELECT * FROM s")
def _scd1(spark, sf_dir):
    return T.scd1(*_pair(spark, sf_dir), ["k"])


@register("scd_type_2", f"""WITH t AS ({_TARGET}), s AS ({_SOURCE}) SELECT k, v, DATE '2020-01-01' AS valid_from, CASE WHEN k IN (SELECT k FROM s) THEN DATE '2024-06-01' END AS valid_to, k NOT IN (SELECT k FROM s) AS is_current FROM t
  UNION ALL SELECT k, v, DATE '2024-06-01', NULL, true FROM s""")
def _scd2(spark, sf_dir):
    return T.scd2(*_dimension(spark, sf_dir), ["k"], ["v"], F.lit("2024-06-01").cast("date"))


@register("scd_type_4", f"WITH t AS ({_TARGET}), s AS ({_SOURCE}) SELECT t.k, t.v, DATE '2024-06-01' AS valid_to FROM t JOIN s ON t.k = s.k WHERE t.v IS DISTINCT FROM s.v")
def _scd4(spark, sf_dir):
    return T.scd4(*_pair(spark, sf_dir)[:1], None, _pair(spark, sf_dir)[1], ["k"], F.lit("2024-06-01").cast("date"))[1]


@register("scd_type_6", f"""WITH t AS ({_TARGET}), s AS ({_SOURCE}) SELECT t.k, t.v, DATE '2020-01-01' AS valid_from, CASE WHEN s.k IS NOT NULL THEN DATE '2024-06-01' END AS valid_to, s.k IS NULL AS is_current, CASE WHEN s.k IS NULL THEN t.v ELSE s.v END AS current_v FROM t LEFT JOIN s ON t.k = s.k
  UNION ALL SELECT k, v, DATE '2024-06-01', NULL, true, v FROM s""")
def _scd6(spark, sf_dir):
    return T.scd6(*_dimension(spark, sf_dir), ["k"], ["v"], F.lit("2024-06-01").cast("date"))


@register("scd_type_3", f"WITH t AS ({_TARGET}), s AS ({_SOURCE}) SELECT t.k, coalesce(s.v, t.v) AS v, CASE WHEN s.k IS NOT NULL THEN t.v END AS previous_v FROM t LEFT JOIN s ON t.k = s.k")
def _scd3(spark, sf_dir):
    return T.scd3(*_pair(spark, sf_dir), ["k"], ["v"])


@register("materialized_view_increment", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS o_custkey FROM orders WHERE o_orderkey % 5 <> 1 GROUP BY 1")
def _view(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    view = o.filter("o_orderkey % 5 <> 0").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("o_custkey"))
    delta = o.filter("o_orderkey % 5 = 0").withColumn("_sign", F.lit(1)).union(o.filter("o_orderkey % 5 = 1").withColumn("_sign", F.lit(-1)))
    return T.refresh_sums(view, delta.drop("o_orderkey"), ["o_orderstatus"], ["o_custkey"])


def _lake(spark, sf_dir):
    lake = Lake(spark, f"{shared_dir(spark)}/lake-{uuid.uuid4().hex}")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    lake.append(o.filter("o_orderkey % 2 = 0"))
    lake.append(o.filter("o_orderkey % 2 = 1"))
    lake.delete_where(F.col("o_orderstatus") == "F")
    lake.create_branch("work")
    lake.update_where(F.col("o_orderstatus") == "O", {"o_custkey": F.lit(0).cast("long")}, "work")
    return lake


@register("lake_time_travel", """SELECT 'v0' AS version, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'v1', count(*) FROM orders UNION ALL SELECT 'v2', count(*) FROM orders WHERE o_orderstatus <> 'F'
  UNION ALL SELECT 'work', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'main', count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_custkey = 0""")
def _travel(spark, sf_dir):
    lake = _lake(spark, sf_dir)
    one = lambda name, df: df.agg(F.lit(name).alias("version"), F.count("*").alias("n"))
    out = one("v0", lake.read(0)).union(one("v1", lake.read(1))).union(one("v2", lake.read(2)))
    zero = "o_custkey = 0 AND o_orderstatus = 'O'"
    return out.union(one("work", lake.read(branch="work").filter(zero))).union(one("main", lake.read().filter("o_custkey = 0")))


@register("lake_restore_optimize", "SELECT o_orderkey, o_custkey FROM orders")
def _restore(spark, sf_dir):
    lake = _lake(spark, sf_dir)
    lake.restore(1)
    lake.optimize(2)
    lake.vacuum(1)
    return lake.read().select("o_orderkey", "o_custkey")


@register("three_way_merge", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'ours' WHEN n_nationkey % 3 = 1 THEN 'theirs' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 24")
def _three(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    ours = n.withColumn("n_name", F.expr("CASE WHEN n_nationkey % 3 = 0 THEN 'ours' ELSE n_name END"))
    theirs = n.filter("n_nationkey <> 24 OR false").withColumn("n_name", F.expr("CASE WHEN n_nationkey % 3 = 1 THEN 'theirs' ELSE n_name END"))
    return T.three_way_merge(n, ours, theirs, ["n_nationkey"])[0]


@register("foreign_key_check", "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def _fk(spark, sf_dir):
    return T.unmatched_references(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 0"), "c_custkey").agg(F.count("*").alias("n"))


@register("quality_checks", """SELECT 'nn' AS "check", 0 AS failed, true AS passed UNION ALL SELECT 'rg', count(*), count(*) = 0 FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 400000 UNION ALL SELECT 'pt', count(*), count(*) = 0 FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[12]')
  UNION ALL SELECT 'un', count(o_custkey) - count(DISTINCT o_custkey), count(o_custkey) = count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'rc', 0, true""")
def _quality(spark, sf_dir):
    checks = {"nn": ("not_null", "o_orderkey"), "rg": ("range", "o_totalprice", 1000, 400000), "pt": ("pattern", "o_orderpriority", "^[12]"), "un": ("unique", "o_custkey"), "rc": ("row_count", 1, 10**9)}
    return T.quality(table(spark, sf_dir, "orders"), checks)


@register("expectation_quarantine", "SELECT count(*) FILTER (WHERE o_totalprice > 50000) AS good, count(*) FILTER (WHERE NOT o_totalprice > 50000) AS bad FROM orders")
def _expect(spark, sf_dir):
    good, bad = T.expect(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 50000, "quarantine")
    return good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("bad")))


@register("masking", """SELECT c_custkey, left(c_name, 2) || repeat('*', length(c_name) - 2) AS part, repeat('*', greatest(length(c_name) - 4, 0)) || right(c_name, 4) AS card, sha256(c_name) AS hashed, floor(c_acctbal / 100) * 100 AS bucket,
  left(c_name, 1) || repeat('#', length(c_name) - 3) || right(c_name, 2) AS ends, '[REDACTED]' AS gone FROM customer""")
def _masking(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", T.mask(n, "partial", 2).alias("part"), T.mask(n, "credit_card").alias("card"), T.mask(n, "hash").alias("hashed"), T.mask(F.col("c_acctbal"), "bucket", 100).cast("double").alias("bucket"), T.mask(n, "partial_mask", 1, 2, "#").alias("ends"), T.mask(n, "redact").alias("gone"))


@register("row_security", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2) AND c_acctbal > 0")
def _rls(spark, sf_dir):
    secured = table(spark, sf_dir, "customer").filter("c_nationkey IN (1, 2)")
    return secured.filter("c_acctbal > 0").select("c_custkey")


@register("audit_chain", "WITH RECURSIVE n AS (SELECT n_regionkey, n_nationkey, sha256('{\"n_name\":\"' || n_name || '\"}') AS b, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation), r AS (SELECT n_regionkey, n_nationkey, rn, sha256('' || b) AS digest FROM n WHERE rn = 1 UNION ALL SELECT n.n_regionkey, n.n_nationkey, n.rn, sha256(r.digest || n.b) FROM r JOIN n ON n.n_regionkey = r.n_regionkey AND n.rn = r.rn + 1) SELECT n_nationkey, digest FROM r")
def _audit(spark, sf_dir):
    return T.audit_chain(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey", ["n_name"]).select("n_nationkey", "digest")


@register("z_order", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def _z(spark, sf_dir):
    return T.z_order(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), ["l_orderkey", "l_partkey"], 4, 4)


@register("retention_erasure", "SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN NULL ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-12-31' - INTERVAL 1200 DAY OR o_orderstatus = 'P'")
def _retention(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    kept = T.retained(o, "o_orderdate", 1200, F.lit("2001-12-31").cast("timestamp_ntz"), F.col("o_orderstatus") == "P")
    return T.erase(kept, F.col("o_custkey") == 7, ["o_custkey"]).select("o_orderkey", "o_custkey")


@register("hybrid_scan", "SELECT o_orderkey FROM orders")
def _hybrid(spark, sf_dir):
    """Base files and newer rows read as one table."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.filter("o_orderkey % 10 <> 0").unionByName(o.filter("o_orderkey % 10 = 0"))


@register("format_round_trips", "SELECT kind, n, s FROM (SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation) t, (VALUES ('arrow'), ('csv'), ('jsonl'), ('orc'), ('parquet')) v(kind)")
def _formats(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    out = None
    for kind in ("arrow", "csv", "jsonl", "orc", "parquet"):
        path = f"{shared_dir(spark)}/format-{uuid.uuid4().hex}"
        formats.write(n, path, kind)
        one = formats.read(spark, path, kind, "n_nationkey int, n_name string").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("n_nationkey").alias("s"))
        out = one if out is None else out.union(one)
    return out
