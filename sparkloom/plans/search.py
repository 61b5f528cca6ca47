"""Search, vectors and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import search as S
from .catalog import register, table

_TERMS = ["theaner", "edonti", "ingtion", "ofthat", "onthe"]


@register("fulltext_bm25", """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents), tot AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
  e AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM e WHERE term IN ('the', 'of', 'que', 'und') GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
  SELECT doc_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term), tot GROUP BY doc_id""")
def _bm25(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return S.bm25(d, "doc_id", "text", ["the", "of", "que", "und"]).withColumn("score", F.round("score", 6))


@register("fulltext_postings", """WITH e AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark) SELECT term, item_id, count(*) AS tf FROM e GROUP BY 1, 2""")
def _postings(spark, sf_dir):
    return S.postings(table(spark, sf_dir, "benchmark"), "item_id", "text").select("term", "item_id", "tf")


@register("fulltext_query", """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents) SELECT doc_id FROM t
  WHERE list_contains(t, 'the') AND NOT list_contains(t, 'que') AND contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')""")
def _query(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(S.matches(F.col("text"), '+the -que "of the"')).select("doc_id")


@register("fulltext_autocomplete", """SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) t WHERE starts_with(term, 'the') GROUP BY 1 ORDER BY n DESC, term LIMIT 10""")
def _autocomplete(spark, sf_dir):
    return S.autocomplete(table(spark, sf_dir, "documents"), "text", "the", 10)


@register("fulltext_highlight", "SELECT item_id, regexp_replace(text, '\\b([Tt]he|[Tt]HE|THE)\\b', '<b>\\1</b>', 'g') AS marked FROM benchmark")
def _highlight(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", S.highlight(F.col("text"), ["the"]).alias("marked"))


_QUERY = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 7)"


def _vector(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e, e.filter("vec_id = 7").first().embedding


for _metric, _duck in (("cosine", "list_cosine_distance(embedding::DOUBLE[], q::DOUBLE[])"), ("l2", "list_distance(embedding::DOUBLE[], q::DOUBLE[])"), ("dot", "-list_inner_product(embedding::DOUBLE[], q::DOUBLE[])")):

    def _knn(spark, sf_dir, metric=_metric):
        e, q = _vector(spark, sf_dir)
        return S.knn(e, "vec_id", "embedding", q, 10, metric).withColumn("distance", F.round("distance", 4) + 0.0)

    register(f"vector_knn_{_metric}", f"SELECT vec_id, round({_duck}, 4) + 0.0 AS distance FROM embeddings, {_QUERY} x ORDER BY {_duck}, vec_id LIMIT 10")(_knn)


@register("vector_knn_join", """WITH p AS (SELECT a.vec_id AS query, b.vec_id, list_cosine_distance(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS rank FROM p) SELECT query, vec_id, rank FROM r WHERE rank BETWEEN 2 AND 5""")
def _knn_join(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return S.knn_join(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 5).filter("rank >= 2").select("query", "vec_id", "rank")


@register("hybrid_search")
def _hybrid(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    e, q = _vector(spark, sf_dir)
    v = S.knn(e, "vec_id", "embedding", q, 100, "l2").withColumnRenamed("vec_id", "doc_id")
    return S.hybrid(v, S.bm25(d, "doc_id", "text", ["the", "of"]), "doc_id", 0.5)


# ---- graphs: customers and the parts they bought would do, but nations and users are smaller worlds


def _edges(spark, sf_dir, most: int = 250_000):
    """user -> the user of the next event, within a type; events at the same time follow by id. Time is cut into cells
    of about ``most`` events, and the first event of a type's next cell closes each cell. Written once, as the
    algorithms read the edges often."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "user_id")
    cells = max(-(-e.count() // most), 1)
    bounds = e.agg(F.percentile_approx("ts", [k / cells for k in range(1, cells)], 10_000).cast("array<string>")).first()[0] if cells > 1 else []
    kind = e.schema["ts"].dataType

    def cell(low, high):
        mid = (low + high) // 2
        return F.lit(low) if low == high else F.when(F.col("ts") <= F.lit(bounds[mid]).cast(kind), cell(low, mid)).otherwise(cell(mid + 1, high))

    # a time that is null comes last, as in DuckDB
    e = e.withColumn("cell", cell(0, len(bounds or []))).withColumn("at", F.struct(F.col("ts").isNull().alias("none"), "ts", "event_id"))
    first = e.groupBy("event_type", "cell").agg(F.min(F.struct("at", "user_id")).alias("f"))
    before = F.lag("cell").over(Window.partitionBy("event_type").orderBy("cell"))
    closing = first.withColumn("cell", before).filter("cell IS NOT NULL").select("event_type", "cell", "f.at", "f.user_id", F.lit(True).alias("closing"))
    both = e.select("event_type", "cell", "at", "user_id", F.lit(False).alias("closing")).union(closing)
    w = Window.partitionBy("event_type", "cell").orderBy("at", "closing")
    return G._settle(both.select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"), "closing").filter("dst IS NOT NULL AND NOT closing").select("src", "dst").distinct())


_EDGES = "SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts) AS dst FROM events) t WHERE dst IS NOT NULL"


@register("graph_pagerank", f"""WITH RECURSIVE e AS ({_EDGES}), o AS (SELECT src, count(*) AS deg FROM e GROUP BY 1), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) AS n FROM v),
  p AS (SELECT 0 AS k, id, 1.0::DOUBLE / n AS rank FROM v, n UNION ALL
    SELECT k, id, (SELECT 0.15::DOUBLE / n FROM n) + 0.85::DOUBLE * coalesce(s, 0) FROM (SELECT p.k + 1 AS k, v.id, sum(CASE WHEN e.dst = v.id THEN p.rank / o.deg END) AS s FROM p JOIN e ON e.src = p.id JOIN o ON o.src = p.id CROSS JOIN v WHERE p.k < 20 GROUP BY p.k, v.id) t)
  SELECT id, round(rank, 8) AS rank FROM p WHERE k = 20""")
def _pagerank(spark, sf_dir):
    return G.pagerank(_edges(spark, sf_dir)).withColumn("rank", F.round("rank", 8))


@register("graph_components", f"""WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src AS id, src AS c FROM b UNION SELECT b.dst, r.c FROM r JOIN b ON b.src = r.id)
  SELECT id, min(c) AS component FROM r GROUP BY id""")
def _components(spark, sf_dir):
    return G.connected_components(_edges(spark, sf_dir))


@register("graph_bfs", f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT 3::BIGINT AS id, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE depth < 4) SELECT id, min(depth) AS depth FROM r GROUP BY id""")
def _bfs(spark, sf_dir):
    return G.bfs(_edges(spark, sf_dir), 3, 4)


@register("graph_shortest_paths", f"""WITH RECURSIVE e AS ({_EDGES}), w AS (SELECT src, dst, 1.0::DOUBLE + (src + dst) % 5 AS w FROM e), r AS (SELECT 3::BIGINT AS id, 0.0::DOUBLE AS d, 0 AS k UNION SELECT w.dst, min(r.d + w.w), r.k + 1 FROM r JOIN w ON w.src = r.id WHERE k < 12 GROUP BY w.dst, r.k)
  SELECT id, min(d) AS distance FROM r GROUP BY id""")
def _shortest(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumn("w", 1.0 + (F.col("src") + F.col("dst")) % 5)
    return G.shortest_paths(e, 3, "w")


@register("graph_triangles", f"""WITH e AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM ({_EDGES}) x WHERE src <> dst) SELECT p.u AS a, p.v AS b, q.v AS c FROM e p JOIN e q ON p.v = q.u JOIN e r ON r.u = p.u AND r.v = q.v""")
def _triangles(spark, sf_dir):
    return G.triangles(_edges(spark, sf_dir))


@register("graph_pattern_hops", f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT src, dst, 1 AS hops FROM e UNION SELECT r.src, e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.dst WHERE hops < 2) SELECT src, dst, min(hops) AS hops FROM r GROUP BY 1, 2")
def _hops(spark, sf_dir):
    return G.paths(_edges(spark, sf_dir), 2)


@register("graph_communities")
def _communities(spark, sf_dir):
    return G.communities(_edges(spark, sf_dir))


@register("graph_pattern", f"""WITH e AS ({_EDGES}), n AS (SELECT user_id AS id, count(*) AS events FROM events GROUP BY 1)
  SELECT p.src AS a, p.dst AS b, q.src AS c FROM e p JOIN e q ON q.dst = p.dst JOIN n x ON x.id = p.src JOIN n y ON y.id = q.src WHERE p.src < q.src AND x.events = y.events AND p.dst <> p.src AND p.dst <> q.src""")
def _pattern(spark, sf_dir):
    nodes = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("events"))
    where = "a < c AND a_node.events = c_node.events AND b <> a AND b <> c"
    return G.match_pattern(_edges(spark, sf_dir), ["a", "b", "c"], ["out", "in"], nodes, where).select("a", "b", "c")


@register("graph_betweenness")
def _betweenness(spark, sf_dir):
    return G.betweenness(_edges(spark, sf_dir)).withColumn("centrality", F.round("centrality", 6))


@register("graph_shortest_routes")
def _routes(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumn("w", 1.0 + (F.col("src") + F.col("dst")) % 5)
    return G.shortest_routes(e, 3, "w")
