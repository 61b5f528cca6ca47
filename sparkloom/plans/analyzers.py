"""Tokenizers, filters, highlighting and scores over several fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyzers as Z
from .catalog import register, table

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def _benchmark(spark, sf_dir, terms):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))


@register("analyze_whitespace", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS n FROM documents")
def _whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(Z.whitespace(F.col("text"))).alias("n"))


@register("analyze_stop_words", f"SELECT doc_id, len(list_filter({_WORDS}, lambda t: t NOT IN ({', '.join(map(repr, Z.STOP['en']))}))) AS n FROM documents")
def _stop(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(Z.drop_stop_words(Z.tokens(F.col("text")))).alias("n"))


@register("analyze_edge_grams", f"SELECT item_id, term[1:k] AS term, count(*) AS n FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) t, range(2, 5) r(k) WHERE len(term) >= k GROUP BY 1, 2")
def _edges(spark, sf_dir):
    return _benchmark(spark, sf_dir, Z.custom(Z.tokens, lambda t: Z.edge_grams(t, 2, 4)))


@register("analyze_grams", f"""WITH w AS (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark), g AS (SELECT item_id, term, k, unnest(range(1, len(term) - k + 2)) AS i FROM w, range(2, 4) r(k) WHERE len(term) >= k)
  SELECT item_id, term[i:i + k - 1] AS term, count(*) AS n FROM g GROUP BY 1, 2""")
def _grams(spark, sf_dir):
    return _benchmark(spark, sf_dir, Z.custom(Z.tokens, lambda t: Z.gram_filter(t, 2, 3)))


@register("analyze_synonyms", f"""WITH w AS (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark), s AS (SELECT unnest(['the', 'the', 'of', 'of', 'from', 'from']) AS a, unnest(['der', 'le', 'from', 'von', 'of', 'von']) AS b)
  SELECT item_id, term, count(*) AS n FROM (SELECT * FROM w UNION ALL SELECT item_id, b FROM w JOIN s ON term = a) t GROUP BY 1, 2""")
def _synonyms(spark, sf_dir):
    book = Z.synonym_groups(["of", "from", "von"])
    book = {"the": ["der", "le"], "of": book["of"], "from": book["from"]}
    return _benchmark(spark, sf_dir, Z.custom(Z.tokens, lambda t: Z.expand_synonyms(t, book)))


@register("analyze_standard")
def _standard(spark, sf_dir):
    return _benchmark(spark, sf_dir, Z.standard)


_STOPS = ", ".join(f"len(list_filter(t, lambda x: x IN ({', '.join(map(repr, Z.STOP[k]))}))) AS {k}" for k in ("en", "es", "fr", "de"))


@register("detect_language", f"""WITH w AS (SELECT doc_id, text, {_WORDS} AS t, greatest(length(text), 1) AS n FROM documents), c AS (SELECT doc_id, text, n, {_STOPS} FROM w)
  SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[{Z.CJK}]')) * 100 > 30 * n THEN CASE WHEN regexp_matches(text, '[぀-ヿ]') THEN 'ja' ELSE 'zh' END WHEN strlen(text) < 20 THEN 'en'
  WHEN en >= greatest(es, fr, de) THEN 'en' WHEN es >= greatest(fr, de) THEN 'es' WHEN fr >= de THEN 'fr' ELSE 'de' END AS language FROM c""")
def _language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", Z.detect_language(F.col("text")).alias("language"))


@register("fulltext_fragments")
def _fragments(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", Z.fragments(F.col("text"), ["the", "of"]).alias("marked"))


_SCORE = """SELECT conv_id, turn, round(sum(b * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score"""


@register("fulltext_multi_field", f"""WITH f AS (SELECT conv_id, turn, 1 AS f, 1.0::DOUBLE AS b, {_WORDS} AS t FROM conversations UNION ALL SELECT conv_id, turn, 2, 2.5, regexp_extract_all(lower(role), '[\\p{{L}}\\p{{N}}]+') FROM conversations),
  tot AS (SELECT f, count(*) AS n, avg(len(t)) AS avgdl FROM f GROUP BY 1), e AS (SELECT conv_id, turn, f, b, len(t) AS dl, unnest(t) AS term FROM f),
  tf AS (SELECT conv_id, turn, f, b, dl, term, count(*) AS tf FROM e WHERE term IN ('the', 'user') GROUP BY ALL), df AS (SELECT f, term, count(*) AS df FROM tf GROUP BY 1, 2)
  {_SCORE} FROM tf JOIN df USING (f, term) JOIN tot USING (f) GROUP BY 1, 2""")
def _multi(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("k", F.struct("conv_id", "turn"))
    got = Z.multi_field(c, "k", {"text": 1.0, "role": 2.5}, ["the", "user"])
    return got.select("k.conv_id", "k.turn", F.round("score", 6).alias("score"))
