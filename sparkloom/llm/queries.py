"""The registered queries of this subpackage: ``queries()`` and ``oracle_sql()``.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    repo = F.concat_ws("/", "source", "lang")
    return scan(_table(spark, sf_dir, "documents"), repo=repo, owner=F.col("source"))


def op2_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_order_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


_SECRET_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, source, lang FROM documents),
p(kind, pattern, g, least) AS (VALUES
  (0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 8),
  (1, '(AKIA[A-Z0-9]+)', 1, 16), (2, '([0-9a-f]{32,})', 1, 32), (3, '([A-Za-z0-9+/_-]{20,})', 1, 20)),
m AS (SELECT rid, kind, least, regexp_extract_all(t, pattern, 0) AS w, regexp_extract_all(t, pattern, 1) AS v, string_split_regex(t, pattern) AS b FROM d, p),
e AS (SELECT rid, kind, least, w, v, b, unnest(range(1, len(w) + 1)) AS i FROM m WHERE len(w) > 0),
x AS (SELECT rid, kind, v[i] AS val, CAST(coalesce(list_sum(list_transform(b[1:i], lambda q: length(q))), 0) + coalesce(list_sum(list_transform(w[1:i - 1], lambda q: length(q))), 0) AS BIGINT) AS s, length(w[i]) AS n
  FROM e WHERE length(v[i]) >= least),
y AS (SELECT rid, kind, s, s + n AS z, sha256(val) AS h, (kind = 1 OR (regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]'))) AND len(list_distinct(string_split(val, ''))) >= 8 AS rnd FROM x),
k AS (SELECT * FROM y WHERE kind < 3 OR (rnd AND NOT EXISTS (SELECT 1 FROM y q WHERE q.rid = y.rid AND q.kind < 3 AND y.s < q.z AND q.s < y.z))),
o AS (SELECT h, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT concat_ws('/', source, lang)) AS repos FROM k JOIN d USING (rid) GROUP BY h),
f AS (SELECT k.*, rnd AND owners < 3 AND repos < 12 AS live, owners, repos, ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || s || ':' || z AS txt FROM k JOIN o USING (h)),
g AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS c, count(*) FILTER (WHERE kind = 2) AS x, string_agg(txt, ',' ORDER BY s, kind, z) FILTER (WHERE kind < 3) AS base,
  string_agg(txt, ',' ORDER BY s, kind, z) FILTER (WHERE kind < 3 OR live) AS spans, count(*) FILTER (WHERE live) AS nl, count(*) FILTER (WHERE (owners >= 3 OR repos >= 12) AND (kind < 3 OR live)) AS nc,
  max(owners) FILTER (WHERE kind < 3 OR live) AS mo, max(repos) FILTER (WHERE kind < 3 OR live) AS mr FROM f GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(x, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(nl, 0) AS n_live, coalesce(nc, 0) AS n_copied,
  coalesce(mo, 0) AS most_owners, coalesce(mr, 0) AS most_repos
FROM d LEFT JOIN g USING (rid)
"""

_WARC_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
s AS (SELECT payload_digest, min(page_id) AS first FROM h WHERE payload_bytes >= 100 GROUP BY payload_digest
      HAVING count(*) > 1 AND min(page_id) IS NOT NULL)
SELECT page_id, url, payload_bytes, h.payload_digest,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM h LEFT JOIN s ON h.payload_digest = s.payload_digest
"""


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.read(spark, warc.write(_table(spark, sf_dir, "pages")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokenfiles

    manifest = tokenfiles.write(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return tokenfiles.summary(spark, manifest)


def op6_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import repetition_coverage

    return repetition_coverage(_table(spark, sf_dir, "documents"))


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_host_suffix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_ownership": _SECRET_SQL,
        "op4_warc_revisits": _WARC_SQL,
    }
