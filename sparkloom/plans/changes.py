"""Late rows, dead letters, change decoders, periods and functions defined in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cdc as C
from ..streaming import sinks as K
from ..streaming import windows as S
from .catalog import register, table


def _in_parts(spark, sf_dir, sink, parts: int = 3) -> str:
    """All events as a stream that stops and starts again after each part has come; the folder of the run."""
    base = f"{S.shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    write = sink(f"{base}/out")
    for k in range(parts):
        e.filter(F.col("event_id") % parts == k).write.parquet(f"{base}/in/p{k}")
        stream = spark.readStream.schema(e.schema).parquet(f"{base}/in/*")
        stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return write


@register("stream_late_side_output", """SELECT event_id, coalesce(ts < (SELECT max(b.ts) FROM events b WHERE b.event_id % 3 < a.event_id % 3) - INTERVAL 10 DAY, false) AS late FROM events a""")
def _late(spark, sf_dir):
    return _in_parts(spark, sf_dir, lambda p: K.LateSplit(p, "ts", 864_000)).rows(spark).select("event_id", "late")


@register("stream_reopen_windows", """WITH p AS (SELECT event_type, date_trunc('day', ts) AS start, event_id % 3 AS k, count(*) AS n, sum(value) AS s FROM events GROUP BY 1, 2, 3),
  t AS (SELECT *, sum(n) OVER w AS tn, sum(s) OVER w AS ts FROM p WINDOW w AS (PARTITION BY event_type, start ORDER BY k)), o AS (SELECT *, lag(tn) OVER w AS pn, lag(ts) OVER w AS ps FROM t WINDOW w AS (PARTITION BY event_type, start ORDER BY k))
  SELECT CASE WHEN pn IS NULL THEN '+I' ELSE '+U' END AS op, event_type, start, tn::BIGINT AS n, round(ts, 4) AS s FROM o UNION ALL SELECT '-U', event_type, start, pn::BIGINT, round(ps, 4) FROM o WHERE pn IS NOT NULL""")
def _reopen(spark, sf_dir):
    got = _in_parts(spark, sf_dir, lambda p: K.ReopenWindows(p, "ts", "1 day", ["event_type"], "value")).changes(spark)
    return got.select("op", "event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("s", 4).alias("s"))


@register("stream_temporal_join", """SELECT a.event_id, b.value AS version FROM (SELECT * FROM events WHERE event_type = 'click') a
  ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'signup') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def _temporal(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    versions = e.filter("event_type = 'signup'").select(F.col("user_id"), F.col("ts").alias("valid_from"), F.col("value").alias("version"))
    clicks = S.file_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).filter("event_type = 'click'")
    return S.drain(S.temporal_join(clicks, versions, "user_id", "ts", "valid_from").select("event_id", "version"), "append")


@register("stream_window_join", """SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view'
  AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR""")
def _window_join(spark, sf_dir):
    e = lambda: S.file_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    left = e().filter("event_type = 'click'").select(F.col("event_id").alias("a"), "user_id", F.col("ts").alias("lt"))
    right = e().filter("event_type = 'view'").select(F.col("event_id").alias("b"), F.col("user_id").alias("u2"), F.col("ts").alias("rt"))
    return S.drain(S.interval_join(left, right, "user_id = u2", "lt", "rt", "-1 hours", "1 hours"), "append").select("a", "b")


@register("dead_letters", """SELECT CASE WHEN event_id % 7 = 0 THEN 'dead' ELSE 'good' END AS kind, count(*) AS n, sum(CASE WHEN event_id % 7 <> 0 THEN (props->>'$.k')::BIGINT END)::BIGINT AS k FROM events GROUP BY 1""")
def _dead(spark, sf_dir):
    torn = F.when(F.col("event_id") % 7 == 0, F.left("props", F.length("props") - 1)).otherwise(F.col("props"))
    good, dead = K.parse_or_divert(table(spark, sf_dir, "events").select("event_id", torn.alias("props")), "props", "k bigint")
    told = good.select(F.lit("good").alias("kind"), "k").union(dead.select(F.lit("dead"), F.lit(None).cast("bigint")))
    return told.groupBy("kind").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@register("dead_letter_replay", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE event_id % 7 = 0")
def _replay(spark, sf_dir):
    torn = F.when(F.col("event_id") % 7 == 0, F.left("props", F.length("props") - 1)).otherwise(F.col("props"))
    _, dead = K.parse_or_divert(table(spark, sf_dir, "events").select("event_id", torn.alias("props")), "props", "k bigint")
    return K.replay(dead, "props", "k bigint", F.concat("props", F.lit("}")))[0]


_OPS = "CASE o_orderstatus WHEN 'F' THEN {0} WHEN 'O' THEN {1} ELSE {2} END"
_FIELDS = "o_orderkey bigint, o_custkey bigint"


@register("decode_debezium", f"SELECT o_orderkey, o_custkey, {_OPS.format(*(repr(x) for x in ('delete', 'update', 'insert')))} AS _change_type FROM orders")
def _debezium(spark, sf_dir):
    row = F.struct("o_orderkey", "o_custkey")
    op = F.when(F.col("o_orderstatus") == "F", "d").when(F.col("o_orderstatus") == "O", "u").otherwise("c")
    message = F.struct(F.when(op != "c", row).alias("before"), F.when(op != "d", row).alias("after"), op.alias("op"))
    wrapped = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(message.alias("payload")))).otherwise(F.to_json(message))
    return C.decode_debezium(table(spark, sf_dir, "orders").select(wrapped.alias("m")), "m", _FIELDS)


@register("decode_wal2json", f"SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS o_custkey, {_OPS.format(*(repr(x) for x in ('delete', 'update', 'insert')))} AS _change_type FROM orders")
def _wal(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "delete").when(F.col("o_orderstatus") == "O", "update").otherwise("insert")
    names, values = F.array(F.lit("o_orderkey"), F.lit("o_custkey")), F.array("o_orderkey", "o_custkey")
    old = F.struct(F.array(F.lit("o_orderkey")).alias("keynames"), F.array("o_orderkey").alias("keyvalues"))
    live = kind != "delete"
    change = F.struct(kind.alias("kind"), F.lit("orders").alias("table"), F.when(live, names).alias("columnnames"), F.when(live, values).alias("columnvalues"), F.when(~live, old).alias("oldkeys"))
    messages = table(spark, sf_dir, "orders").select((F.col("o_orderkey") / 10).cast("long").alias("g"), change.alias("c")).groupBy("g").agg(F.to_json(F.struct(F.collect_list("c").alias("change"))).alias("m"))
    return C.decode_wal2json(messages.select("m"), "m", _FIELDS).drop("_place")


@register("apply_changes", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT -c_custkey, 'fresh' FROM customer WHERE c_custkey % 3 = 2""")
def _apply(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    change = lambda m, key, value, op, at: t.filter(F.col("c_custkey") % 3 == m).select(key.alias("c_custkey"), F.lit(value).alias("c_mktsegment"), F.lit(op).alias("_change_type"), F.lit(at).alias("at"))
    k = F.col("c_custkey")
    changes = change(0, k, "old", "update", 1).union(change(0, k, None, "delete", 2)).union(change(1, k, "new", "update", 1)).union(change(2, -k, "fresh", "insert", 1)).union(change(2, k, "lost", "insert", 1))
    return C.apply_changes(t, changes, ["c_custkey"], ["at"], "ignore")


@register("returning_old_new", "SELECT s_suppkey, s_acctbal AS old, CASE WHEN s_acctbal >= 0 THEN s_acctbal + 1 END AS new FROM supplier WHERE s_suppkey % 2 = 0 OR s_acctbal < 0")
def _returning(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    new = s.filter("s_acctbal >= 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return C.returning(s, new, ["s_suppkey"]).select("s_suppkey", F.col("old.s_acctbal").alias("old"), F.col("new.s_acctbal").alias("new"))


def _history(spark, sf_dir):
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders").withColumn("valid_from", F.col("o_orderdate"))
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "valid_from", F.lead("valid_from").over(Window.partitionBy("o_custkey").orderBy("valid_from", "o_orderkey")).alias("valid_to"))


_HISTORY = "h AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)"


@register("system_time_as_of", f"WITH {_HISTORY} SELECT o_orderkey, o_custkey FROM h WHERE valid_from <= TIMESTAMP '1996-07-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-07-01')")
def _system_time(spark, sf_dir):
    return C.as_of_system_time(_history(spark, sf_dir), F.lit("1996-07-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey")


@register("portion_of_period", f"""WITH {_HISTORY}, b AS (SELECT TIMESTAMP '1995-01-01' AS s, TIMESTAMP '1996-01-01' AS e), x AS (SELECT *, valid_from < e AND (valid_to IS NULL OR s < valid_to) AS hit FROM h, b)
  SELECT o_orderkey, o_orderstatus, valid_from, valid_to FROM x WHERE NOT hit UNION ALL SELECT o_orderkey, o_orderstatus, valid_from, s FROM x WHERE hit AND valid_from < s
  UNION ALL SELECT o_orderkey, 'X', greatest(valid_from, s), least(coalesce(valid_to, e), e) FROM x WHERE hit UNION ALL SELECT o_orderkey, o_orderstatus, e, valid_to FROM x WHERE hit AND (valid_to IS NULL OR e < valid_to)""")
def _portion(spark, sf_dir):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return C.for_portion(_history(spark, sf_dir), day("1995-01-01"), day("1996-01-01"), {"o_orderstatus": F.lit("X")}).drop("o_custkey")


@register("sql_scalar_function", "SELECT o_orderkey, round(o_totalprice * 1.08 + 5, 2) AS gross FROM orders")
def _scalar_function(spark, sf_dir):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION with_tax(x DOUBLE, rate DOUBLE DEFAULT 0.08D) RETURNS DOUBLE RETURN x * (1 + rate)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION delivered(x DOUBLE) RETURNS DOUBLE RETURN with_tax(x) + 5")
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "round(delivered(o_totalprice), 2) AS gross")


@register("sql_table_function", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice >= 100000 AND c_acctbal > 0")
def _table_function(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_of_functions")
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer_of_functions")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION large_orders(least DOUBLE) RETURNS TABLE (o_orderkey BIGINT, o_custkey BIGINT)
      RETURN SELECT o_orderkey, o_custkey FROM orders_of_functions WHERE o_totalprice >= large_orders.least""")
    return spark.sql("SELECT c_custkey, o_orderkey FROM customer_of_functions JOIN large_orders(100000D) ON o_custkey = c_custkey WHERE c_acctbal > 0")
