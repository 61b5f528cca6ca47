"""Secret scan with corpus-wide ownership frequency, in DataFrame expressions alone.

Base candidates are found per kind in every whole text; opaque tokens (long runs of key characters that mix letters
and digits) are candidates too. Hashes of all candidates' values are aggregated over the corpus by distinct owners
and repositories: a value of EXAMPLE_OWNERS owners or EXAMPLE_REPOS repositories or more is a widely copied example, any
other that looks random is live. Live opaque tokens that touch no base span are added as spans of kind ``opaque``; base spans all stay.

Positions are in code points: the pieces between matches and the matches, in turn, make up the text, so a match
starts after the lengths of all that come before it. Candidates are aggregated before they are shuffled by hash, so a
value copied to a third of all rows is a few rows for each task; the verdicts are joined back to the candidates.

Defined cases: a null or empty text has no spans; a null ``doc_id`` stays null, a null repository or owner counts as
one; repeated rows each get the row's result; an empty table gives an empty result. ``scan`` reads no other column;
``redact`` hands all columns on, whatever their names, a null text as null. Matches are walked in chunks, so a text of
many matches costs little more than their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

KINDS = ("assign", "access", "hex", "opaque")
# Patterns of the kinds, the group that holds the value, its least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"
OPAQUE = "[A-Za-z0-9+/_-]{20,}"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, OPAQUE_LEAST = 8, 16, 32, 20
#: Owners, and repositories of any owners, from which on a value counts as a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 12
#: Matches that are put together at a time.
CHUNK = 128
#: Distinct characters that a live-looking value has at least.
LIVE_DISTINCT = 8
MARK = "[SECRET]"

_SPAN = "array<struct<start:int,end:int,kind:int,hash:string,random:boolean>>"


def _spans(text: Column, kind: str, pattern: str, group: int, least: int, hint: Column) -> Column:
    """The matches of a pattern whose value is long enough, as an array of spans."""
    regexp = F.lit(pattern)
    whole = F.regexp_extract_all(text, regexp, 0)
    rows = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("before"), whole.alias("whole"), F.regexp_extract_all(text, regexp, group).alias("value")
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["whole"])
        value = x["value"]
        mixed = F.lit(kind == "access") | (value.rlike("[0-9]") & value.rlike("[A-Za-z]"))
        random = mixed & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT)
        span = F.struct(
            start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), F.sha2(value.cast("binary"), 256).alias("hash"), random.alias("random")
        )
        out = F.when(F.length(value) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    none = F.array().cast(_SPAN)
    chunks = F.transform(F.sequence(F.lit(0), F.size(rows), F.lit(CHUNK)), lambda k: F.slice(rows, k + 1, CHUNK))

    def chunk(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.when(hint, F.aggregate(chunks, zero, chunk, lambda acc: F.flatten(acc["out"]))).otherwise(none)


def base_spans(text: Column) -> Column:
    return F.concat(
        _spans(text, "assign", ASSIGN, 1, ASSIGN_LEAST, text.rlike(ASSIGN_HINT)),
        _spans(text, "access", ACCESS, 0, ACCESS_LEAST, F.contains(text, F.lit("AKIA"))),
        _spans(text, "hex", HEX, 0, HEX_LEAST, text.rlike(HEX)),
    )


def opaque_spans(text: Column) -> Column:
    return _spans(text, "opaque", OPAQUE, 0, OPAQUE_LEAST, text.rlike(f"(?=[A-Za-z+/_-]*[0-9]){OPAQUE}"))


def candidates(docs: DataFrame, id_col: str, text_col: str, repo: Column, owner: Column) -> DataFrame:
    """One row per document: its base spans, and its opaque tokens that look random and touch no base span."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        repo.cast("string").alias("repo"),
        owner.cast("string").alias("owner"),
        base_spans(text).alias("base"),
        opaque_spans(text).alias("opaque"),
    )
    free = F.filter("opaque", lambda x: x["random"] & ~F.exists("base", lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
    return found.withColumn("opaque", F.when(F.size("opaque") > 0, free).otherwise(F.col("opaque")))


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos) from (hash, repo, owner)."""
    return (
        spans.groupBy("hash", "owner", "repo")
        .agg(F.lit(1).alias("one"))
        .groupBy("hash")
        .agg(F.count_distinct(F.coalesce("owner", F.lit(""))).alias("n_owners"), F.count_distinct(F.coalesce("repo", F.lit(""))).alias("n_repos"))
    )


def _copied(owners: Column, repos: Column) -> Column:
    return (owners >= EXAMPLE_OWNERS) | (repos >= EXAMPLE_REPOS)


def verdicts(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans) of the documents that have candidates: each span with its owners and whether it is live."""
    each = found.filter(F.size("base") + F.size("opaque") > 0).select("doc_id", "text_key", "repo", "owner", F.explode(F.concat("base", "opaque")).alias("x"))
    each = each.select("doc_id", "text_key", "repo", "owner", "x.*")
    live = F.col("random") & ~_copied(F.col("n_owners"), F.col("n_repos"))
    return (
        each.join(ownership(each.select("hash", "repo", "owner")), "hash")
        .select("doc_id", "text_key", F.struct("start", "kind", "end", live.alias("live"), "n_owners", "n_repos").alias("x"))
        .groupBy("doc_id", "text_key")
        .agg(F.sort_array(F.collect_set("x")).alias("spans"))
    )


def _listed(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """Per document: counts and digest of the base spans, all spans, and how many are live or widely copied."""
    repo, owner = F.col("source") if repo is None else repo, F.col("source") if owner is None else owner
    found = settle(candidates(docs, id_col, text_col, repo, owner), "secret-candidates")
    judged = verdicts(found)
    rows = found.select("doc_id", "text_key").alias("l").join(
        judged.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_key") == F.col("r.text_key")), "left"
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,n_owners:bigint,n_repos:bigint>>")
    rows = rows.select("l.doc_id", F.coalesce("r.spans", none).alias("all"))
    kept = rows.select("doc_id", F.filter("all", lambda x: (x["kind"] < 3) | x["live"]).alias("all"), F.filter("all", lambda x: x["kind"] < 3).alias("base"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return kept.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("all", lambda x: _copied(x["n_owners"], x["n_repos"]))).cast("long").alias("n_copied"),
        *(F.coalesce(F.array_max(F.col(f"all.{c}")), F.lit(0)).cast("long").alias(a) for c, a in (("n_owners", "most_owners"), ("n_repos", "most_repos"))),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """The rows of ``docs`` with every live secret replaced by MARK; widely copied examples and all else stay. Rows
    without candidates pass in a narrow branch, so only texts with candidates are shuffled."""
    repo, owner = F.col("source") if repo is None else repo, F.col("source") if owner is None else owner
    found = settle(candidates(docs, id_col, text_col, repo, owner).filter(F.size("base") + F.size("opaque") > 0), "secret-candidates")
    live = settle(verdicts(found).select("doc_id", "text_key", F.filter("spans", lambda x: x["live"]).alias("spans")).filter(F.size("spans") > 0), "secret-verdicts")
    # each row as one struct: its columns can't clash with the operator's own
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col(f"row.`{text_col}`")
    hint = F.coalesce(text.rlike(ASSIGN_HINT) | F.contains(text, F.lit("AKIA")) | text.rlike(HEX) | text.rlike(f"(?=[A-Za-z+/_-]*[0-9]){OPAQUE}"), F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        part = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        new = x["start"] >= acc["at"]
        out = F.when(new, F.concat(acc["out"], F.array(part, F.lit(MARK)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    def close(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.when(F.col("spans").isNull(), text).otherwise(F.aggregate("spans", zero, step, close))
    hit = rows.filter(hint).select("row", F.col(f"row.`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("key"))
    hit = hit.join(live, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left").withColumn("clean", clean)
    counted = F.when(F.col("spans").isNull(), F.col(f"row.`{count_col}`")).otherwise(F.length("clean").cast("long")) if count_col in docs.columns else None
    new = {text_col: F.col("clean"), **({} if counted is None else {count_col: counted})}
    kept = rows.filter(~hint).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return kept.unionAll(hit.select(*[new.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]))
