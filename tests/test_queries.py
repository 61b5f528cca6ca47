"""Every registered query of the library against DuckDB on the same tables, and what has no SQL against facts."""

import collections
import datetime
import decimal
import math
import re

import duckdb
import pytest

from sparkloom.operators.analyzers import STOP, porter
from sparkloom.plans import catalog

TABLES = catalog.TABLES
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v) + 0.0, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(float(v)) if isinstance(v, int) else str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(want.columns, want.fetchall())


#: What has no SQL: columns, and a fact that the rows must fit.
FACTS = {
    "lttb": lambda rows, t: max(collections.Counter(r.event_type for r in rows).values()) <= 50 and {r.event_type for r in rows} == t("events", "event_type"),
    "sketches": lambda rows, t: {r.event_type for r in rows} == t("events", "event_type") and all(0 < r.users <= 1.1 * len(t("events", "user_id")) for r in rows),
    "graph_communities": lambda rows, t: len({r.id for r in rows}) == len(rows) and {r.community for r in rows} <= {r.id for r in rows},
    "forecast_arima": lambda rows, t: len(rows) == 5 * len(t("events", "event_type")) and all(math.isfinite(r.value) for r in rows),
    "graph_betweenness": lambda rows, t: {r.id for r in rows} <= t("events", "user_id") and len({r.id for r in rows}) == len(rows) and min(r.centrality for r in rows) >= 0,
    "graph_shortest_routes": lambda rows, t: all(r.route[0] == 3 and r.route[-1] == r.id and len(set(r.route)) == len(r.route) and r.distance >= len(r.route) - 1 for r in rows),
    "fulltext_fragments": lambda rows, t: {r.doc_id for r in rows} == t("documents", "doc_id"),
    # a stem may equal a stop word (thes): those go before stemming
    "analyze_standard": lambda rows, t: {r.term for r in rows} == {porter(w) for x in t("benchmark", "text") for w in re.findall(r"[^\W_]+", x.lower()) if w not in STOP["en"]},
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_oracle(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    column = lambda table, c: {r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(c).distinct().collect()}
    assert rows and FACTS.get(name, lambda rows, t: True)(rows, column)
    again = QUERIES[name](spark, sf_dir).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
