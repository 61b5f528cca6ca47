import random

import numpy as np
import pytest

from sparkloom.operators import search


def by_hand(a, b, metric):
    if a is None or b is None or len(a) != len(b):
        return None
    dot = lambda x, y: sum((p * q for p, q in zip(x, y, strict=True)), 0.0)
    if metric == "cosine":
        return 1 - max(-1.0, min(1.0, dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5)) if any(a) and any(b) else float("nan")
    if metric == "dot":
        return -dot(a, b)
    apart = [abs(p - q) for p, q in zip(a, b, strict=True)]
    return sum(apart) if metric == "manhattan" else dot(apart, apart) ** 0.5


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot", "manhattan"])
def test_blocks_equal_all_pairs(spark, metric):
    r = random.Random(4)
    rows = [(i, [r.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(90)]  # many ties, and scaled copies
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    last = lambda d: (d is None, d is not None and d != d, d if d is not None and d == d else 0)
    want = {}
    for i, a in rows:
        if i % 5 == 0 or i > 199:
            for n, (d, j) in enumerate(sorted(((by_hand(b, a, metric), j) for j, b in rows), key=lambda x: (*last(x[0]), x[1]))[:4], 1):
                want[i, n] = j
    for block in (16384, 20):
        got = search.knn_join(df.filter("id % 5 = 0 OR id > 199"), df, "id", "v", 4, metric, block=block).collect()
        assert {(x["query"], x["rank"]): x["id"] for x in got} == want


def test_plan_compares_blocks(spark):
    df = spark.range(3000).selectExpr("id", "array(sin(id), cos(id * 3)) AS v")
    plan = search.knn_join(df.filter("id % 20 = 0"), df, "id", "v", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # no row for each pair


def test_ties_stand_anywhere():
    r = np.random.default_rng(1)
    v = np.repeat(r.normal(size=(7, 64)), 11, axis=0)
    for row, col, d in search._nearest(v[:3], v, np.arange(len(v)), 5, "cosine", cells=100):
        assert all(len(set(d[row == x])) == 1 and sorted(col[row == x]) == list(range(5)) for x in set(row))
