"""Full-text, vector and hybrid search."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

K1, B = 1.2, 0.75


def tokens(text: Column, stop: Sequence[str] = ()) -> Column:
    """Lower-cased runs of letters and digits, less stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.filter(found, lambda t: ~t.isin(list(stop))) if stop else found


def ngrams(term: Column, n: int) -> Column:
    count = F.length(term) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(term, i, F.lit(n)))).otherwise(F.array(term))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The inverted index: (term, key, tf, dl, positions); written partitioned by term hash it serves many queries."""
    each = docs.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "term"), F.size(tokens(F.col(text))).alias("dl"))
    return each.groupBy("term", key, "dl").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def bm25(docs: DataFrame, key: str, text: str, query: Sequence[str], boost: float = 1.0) -> DataFrame:
    """(key, score) of documents with any query term. Only the query's terms are exploded; totals come from one
    aggregate; nothing is sorted."""
    terms = [t.lower() for t in query]
    found = docs.select(key, tokens(F.col(text)).alias("t"))
    sized = found.select(key, F.size("t").alias("dl"), F.filter("t", lambda x: x.isin(terms)).alias("hits"))
    total = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = sized.filter(F.size("hits") > 0).select(key, "dl", F.explode("hits").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # the query's terms bound df, and total is one row
    return tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(total)).groupBy(key).agg((F.sum(weight) * boost).alias("score"))


def parse_query(query: str) -> list[tuple[str, str, int]]:
    """(kind, value, number) of each part: must, not, phrase, fuzzy, prefix, wildcard, term."""
    out = []
    for sign, phrase, near, word in re.findall(r'([+-]?)(?:"([^"]*)"(?:~(\d+))?|(\S+))', query):
        if phrase:
            out.append(("proximity" if near else "phrase", phrase.lower(), int(near or 0)))
        elif "~" in word:
            term, _, n = word.partition("~")
            out.append(("fuzzy", term.lower(), int(n or 1)))
        else:
            kind = {"+": "must", "-": "not"}.get(sign) or ("prefix" if word.endswith("*") and "*" not in word[:-1] else "wildcard" if set(word) & {"*", "?"} else "term")
            out.append((kind, word.rstrip("*").lower() if kind == "prefix" else word.lower(), 0))
    return out


def matches(text: Column, query: str) -> Column:
    """Whether a document fits a query: all musts, phrases and no nots; any of the others, if there are any."""
    t = tokens(text)
    joined = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    need, any_of = [], []
    for kind, value, n in parse_query(query):
        if kind == "must":
            need.append(F.array_contains(t, value))
        elif kind == "not":
            need.append(~F.array_contains(t, value))
        elif kind == "phrase":
            need.append(F.contains(joined, F.lit(f" {value} ")))
        elif kind == "proximity":
            a, b = value.split()[:2]
            places = lambda w: F.filter(F.transform(t, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
            need.append(F.exists(places(a), lambda i: F.exists(places(b), lambda j: F.abs(i - j) <= n + 1)))  # noqa: B023
        elif kind == "fuzzy":
            any_of.append(F.exists(t, lambda x: F.levenshtein(x, F.lit(value)) <= n))  # noqa: B023
        elif kind == "prefix":
            any_of.append(F.exists(t, lambda x: F.startswith(x, F.lit(value))))  # noqa: B023
        elif kind == "wildcard":
            pattern = "^" + re.escape(value).replace(r"\*", ".*").replace(r"\?", ".") + "$"
            any_of.append(F.exists(t, lambda x: x.rlike(pattern)))  # noqa: B023
        else:
            any_of.append(F.array_contains(t, value))
    out = F.lit(True)
    for c in need:
        out = out & c
    if any_of:
        some = any_of[0]
        for c in any_of[1:]:
            some = some | c
        out = out & some
    return out


def highlight(text: Column, terms: Sequence[str], tag: str = "b") -> Column:
    return F.regexp_replace(text, r"(?i)\b(" + "|".join(map(re.escape, terms)) + r")\b", f"<{tag}>$1</{tag}>")


def autocomplete(docs: DataFrame, text: str, prefix: str, n: int) -> DataFrame:
    """The n most frequent terms with a prefix."""
    found = docs.select(F.explode(F.filter(tokens(F.col(text)), lambda t: F.startswith(t, F.lit(prefix)))).alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(n)


# ---- vectors


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def distance(a: Column, b: Column, metric: str) -> Column:
    """cosine, l2, dot (negated) or manhattan."""
    if metric == "cosine":
        return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    if metric == "dot":
        return -dot(a, b)
    if metric == "manhattan":
        return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def knn(vectors: DataFrame, key: str, column: str, query: Sequence[float], k: int, metric: str = "cosine") -> DataFrame:
    """The k nearest rows: a scan and a bounded top-k per partition."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, distance(F.col(column), q, metric).alias("distance")).orderBy("distance", key).limit(k)


def _nearest(q: np.ndarray, v: np.ndarray, order: np.ndarray, k: int, metric: str, cells: int = 1 << 21):
    """(query row, vector row, distance) of the k nearest of ``v`` for each of ``q``, ties by ``order``. A product of
    matrices leaves those that may be among the k within its rounding; their distances are then summed in the order of
    the elements, so equal vectors have equal distances wherever they stand."""
    dims = q.shape[1]
    square = lambda x: sum((x[:, j] * x[:, j] for j in range(dims)), np.zeros(len(x)))
    qq, vv, slack = square(q), square(v), 4e-15 * (dims + 16)
    for at in range(0, len(q), max(1, cells // max(1, len(v)))):
        a = q[at : at + max(1, cells // max(1, len(v)))]
        aa = qq[at : at + len(a)]
        with np.errstate(divide="ignore", invalid="ignore"):
            if metric == "cosine":
                rough, within = -(a / np.sqrt(aa)[:, None]) @ (v / np.sqrt(vv)[:, None]).T, np.full(len(a), slack)
            elif metric == "dot":
                rough, within = -(a @ v.T), slack * np.sqrt(aa * vv.max(initial=0))
            elif metric == "manhattan":
                rough, within = np.zeros((len(a), len(v))), np.zeros(len(a))
                for j in range(dims):
                    rough += np.abs(a[:, j, None] - v[None, :, j])
            else:
                rough, within = aa[:, None] + vv - 2 * (a @ v.T), slack * (aa + vv.max(initial=0))
            rough[np.isnan(rough)] = np.inf
            least = np.partition(rough, k - 1, axis=1)[:, k - 1] + within if len(v) > k else np.full(len(a), np.inf)
            row, col = np.nonzero(~(rough > least[:, None]))
            total = np.zeros(len(row))
            for j in range(dims):
                x, y = a[row, j], v[col, j]
                total += x * y if metric in ("cosine", "dot") else np.abs(x - y) if metric == "manhattan" else (x - y) * (x - y)
            if metric == "cosine":
                total = 1 - np.clip(total / np.sqrt(aa[row] * vv[col]), -1, 1)
            elif metric == "dot":
                total = -total
            elif metric != "manhattan":
                total = np.sqrt(total)
        by = np.lexsort((order[col], total, row))  # a distance that is no number is the greatest
        row, col, total = row[by], col[by], total[by]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield at + row[kept], col[kept], total[kept]


def _matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the rows with vectors of that length, and these. Vectors with a null have none."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    ends = np.cumsum(np.maximum(sizes, 0))
    gaps = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    sizes[gaps[ends] > gaps[ends - np.maximum(sizes, 0)]] = -1
    values, out = flat.to_numpy(zero_copy_only=False).astype(np.float64), {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        out[n] = rows, values[(ends[rows] - n)[:, None] + np.arange(n)]
    return out


def knn_join(queries: DataFrame, vectors: DataFrame, key: str, column: str, k: int, metric: str = "cosine", block: int = 16384) -> DataFrame:
    """(query key, key, distance, rank) of the k nearest for each query, ties by key. All pairs are compared, a block of
    queries with a block of vectors in a task, so its memory does not grow with the tables. Vectors that cannot be
    compared (null, other length) have no distance and come last."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType
    n, m = vectors.count(), queries.count()
    parts = max(-(-n // block), min(2 * spark.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    turns = max(-(-m // block), 1)
    v = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("_t"), F.pmod(F.xxhash64(key), F.lit(parts)).alias("_v"), F.col(key).alias("_key"), F.col(column).alias("_vector"))
    v = v.select((F.col("_v") * turns + F.col("_t")).alias("_pair"), "_key", "_vector")
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_v"), F.pmod(F.xxhash64(key), F.lit(turns)).alias("_t"), F.col(key).alias("_key"), F.col(column).alias("_vector"))
    q = q.select((F.col("_v") * turns + F.col("_t")).alias("_pair"), "_key", "_vector")

    def near(left, right):
        names, here = left["_key"], right["_key"]
        order = np.empty(len(names), np.int64)
        order[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        vs, qs, out = _matrices(left["_vector"]), _matrices(right["_vector"]), []
        for dims, (rows, a) in qs.items():
            if dims in vs:
                out += [(rows[x], vs[dims][0][y], d) for x, y, d in _nearest(a, vs[dims][1], order[vs[dims][0]], k, metric)]
        lengths = np.zeros(len(names), np.int64)
        for dims, (rows, _) in vs.items():
            lengths[rows] = dims
        for dims, rows in [*((d, r) for d, (r, _) in qs.items()), (-1, np.setdiff1d(np.arange(len(here)), np.concatenate([np.zeros(0, np.int64), *(r for r, _ in qs.values())])))]:
            other = np.flatnonzero(lengths != dims)
            other = other[np.argsort(order[other])[:k]]
            out.append((np.repeat(rows, len(other)), np.tile(other, len(rows)), None))
        return pa.table({
            "query": here.take(pa.array(np.concatenate([x for x, _, _ in out]))),
            key: names.take(pa.array(np.concatenate([y for _, y, _ in out]))),
            "distance": pa.chunked_array([pa.nulls(len(x), pa.float64()) if d is None else pa.array(d) for x, _, d in out]),
        })

    shape = T.StructType([T.StructField("query", kind), T.StructField(key, kind), T.StructField("distance", T.DoubleType())])
    pairs = v.groupBy("_pair").cogroup(q.groupBy("_pair")).applyInArrow(near, shape)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.asc_nulls_last("distance"), key))  # limited in each partition first
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", key, "distance", "rank")


def quantize(v: Column, low: float, high: float) -> Column:
    """Bytes 0 to 255 between two bounds."""
    return F.transform(v, lambda x: F.least(F.greatest(F.round((x - low) / (high - low) * 255), F.lit(0)), F.lit(255)).cast("int"))


def hybrid(vector: DataFrame, text: DataFrame, key: str, alpha: float) -> DataFrame:
    """alpha (1 - d / dmax) + (1 - alpha) minmax(BM25); a side that lacks a document counts as 0."""
    v = vector.crossJoin(F.broadcast(vector.agg(F.max("distance").alias("_m")))).select(key, (1 - F.col("distance") / F.col("_m")).alias("v"))
    t = text.crossJoin(F.broadcast(text.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))))
    t = t.select(key, F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).alias("t"))
    both = v.join(t, key, "full")
    return both.select(key, (alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("t", F.lit(0.0))).alias("score"))


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
