"""Main text of web pages: markup rules, and a host suffix array for what a host repeats.

Every page's markup is parsed into blocks, each inside an article, inside boilerplate (menus, headers, footers,
sidebars, notices, adverts, forms, comments) or open. A page with an article is the text of its article, another one its
open blocks; pages of a host with equal texts count as one text. Then

- open tokens go that lie in a run of MIN_RUN tokens or more that distinct texts of the host share; stretches of
  COPY_RUN tokens or more stay, for so long a run is a copied text;
- a block of an article of MIN_RUN tokens or more goes if NOTICE_TEXTS distinct texts at least, and NOTICE_PERCENT of
  all, hold it, and most of the article is not of this kind: then it is a copied article.

What a host repeats is read from its suffix array. The host's texts are dealt out to shards of about SHARD_PAGES by their
hash, so equal ones meet. The token streams of a shard's texts are concatenated and their suffixes sorted by prefix
doubling, with the lengths of the longest common prefixes of neighbours. The groups of neighbours that share MIN_RUN open
tokens, or a whole block of articles, are handed on with the texts that they lie on, groups of one included; the shards'
groups with the same tokens are put together, which are then the groups of one suffix array of the whole host. Both
decisions are taken on these, over all texts of the host, and go back to the texts concerned; so the cut into shards
doesn't show in the result.

Defined cases: a null or empty page has an empty text; all null addresses count as one host; a null ``page_id`` stays
null; repeated rows are each extracted and count as one text; unclosed elements end where their parent ends, unclosed
comments and scripts at the end of the page. Other columns are not read.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import settle, small_batches

SHARD_PAGES = 250
#: Least length in tokens of a repeated run, and of one that is a copied text.
MIN_RUN, COPY_RUN = 8, 120
#: A block of articles is a notice if so many distinct texts of a host, and so many of a hundred, hold it.
NOTICE_TEXTS, NOTICE_PERCENT = 8, 80

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|select|svg|iframe|object|canvas|button|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<head\b[^>]*>(?:.*?</head\s*>)?"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/a-zA-Z][^<>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
# Elements that part blocks, that hold boilerplate, that hold the article, and that have no end tag.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
_BOILER = frozenset("nav footer aside form menu dialog".split())
_ARTICLE = frozenset("article main".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar widget cookie cookies consent notice notices gdpr popup modal "
    "newsletter subscribe signup login search searchbox share sharing social related recommended comment comments reply replies "
    "disqus respond toolbar pagination pager copyright disclaimer contentinfo complementary alert".split()
)
# Words that a name of boilerplate may hold besides.
_NEUTRAL = frozenset(
    "site page global main top bottom left right upper lower primary secondary inner outer wrap wrapper container content box block "
    "area bar column col row section list item items group panel slot unit form field button buttons link links post posts article "
    "articles story stories text title inline fixed sticky mobile desktop js the and of for".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def boiler_name(name: str) -> bool:
    """Whether a class, id or role is one of boilerplate as a whole: all its words are, but for neutral ones."""
    parts = {x.lower() for x in _PART.findall(name)}
    return not _BOILER_NAMES.isdisjoint(parts) and all(x in _BOILER_NAMES or x in _NEUTRAL or x.isdigit() for x in parts)


def blocks(page: str) -> tuple[list[tuple[str, str]], bool]:
    """(kind, text) of each block with text, in page order; kind is main, boiler or open. And whether there is an article."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, int]] = []  # element, and what it adds: 1 boilerplate, 2 article, 0 neither
    boiler = article = 0
    seen_article = False
    parts: list[str] = []
    at = 0

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(("boiler" if boiler else "main" if article else "open", text))

    def leave(k: int):
        nonlocal boiler, article
        while len(stack) > k:
            _, what = stack.pop()
            boiler -= what == 1
            article -= what == 2

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        block = name in _BLOCKS
        if block:
            flush()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if not block and any(stack[j][1] for j in range(k + 1, len(stack))):
                        break  # an inline end tag doesn't end a container
                    if stack[k][1]:
                        flush()
                    leave(k)
                    break
            continue
        attributes = m[4]
        what = 0
        if name in _BOILER or (name == "header" and not article):
            what = 1
        elif attributes and not attributes.isspace():
            names = [x for f in _NAMES.findall(attributes) for x in f.strip("\"'").split()]
            if article and name in _HEADINGS:
                names = []
            if any(boiler_name(x) and not (article and x.lower().endswith("header")) for x in names):
                what = 1
            elif _HIDDEN.search(attributes):
                what = 1
        if not what and name in _ARTICLE:
            what = 2
            seen_article = seen_article or not boiler
        if name in _VOID or attributes.endswith("/"):
            continue
        if not block and not what:
            continue
        if name in ("p", "li", "tr", "td", "th", "dd", "dt", "option"):
            # a new one ends an open one of its kind, unless a container stands between
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    leave(k)
                    break
                if stack[k][0] in ("ul", "ol", "table", "div", "section", "article", "main", "aside", "nav", "form", "blockquote", "dl"):
                    break
        elif block and stack and stack[-1][0] == "p":
            leave(len(stack) - 1)
        if what == 1:
            flush()
        stack.append((name, what))
        boiler += what == 1
        article += what == 2
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out, seen_article


def suffix_array(tokens: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, each no longer than its page, and the length of the longest common prefix of each with
    the one before it. ``tokens`` are numbers from 1 on; suffixes are ranked by their first 1, 2, 4 ... tokens."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    levels, width = [rank.astype(np.int64) + 1], 1
    while n and levels[-1].max() < n and width < n:
        rank = levels[-1]
        after = np.zeros(n, np.int64)
        after[:-width] = np.where(page[width:] == page[:-width], rank[width:], 0)
        _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        if rank.max() == levels[-1].max():
            break  # no longer prefix tells more apart: what is equal is so to the pages' ends
        levels.append(rank)
        width *= 2
    order = np.argsort(levels[-1], kind="stable")
    left = np.searchsorted(page, page, "right") - np.arange(n)  # tokens to the page's end
    common = np.zeros(n, np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    most = np.minimum(left[a], left[b])
    length = np.where(levels[-1][a] == levels[-1][b], most, 0)
    for k in range(len(levels) - 2, -1, -1):
        fits = np.flatnonzero(length + (1 << k) <= most)
        same = fits[levels[k][a[fits] + length[fits]] == levels[k][b[fits] + length[fits]]]
        length[same] += 1 << k
    common[1:] = length
    return order, common


def _groups(order: np.ndarray, common: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The first suffixes of the groups that share ``run`` tokens, and whether a group lies on distinct pages."""
    first = np.flatnonzero(common < run)
    return first, np.minimum.reduceat(page[order], first) != np.maximum.reduceat(page[order], first)


def repeated_starts(tokens: np.ndarray, page: np.ndarray, run: int = MIN_RUN) -> np.ndarray:
    """Whether the ``run`` tokens from each place on are on distinct pages; such a run never leaves its page."""
    out = np.zeros(len(tokens), bool)
    if len(tokens):
        order, common = suffix_array(tokens, page)
        first, several = _groups(order, common, page, run)
        out[order] = np.repeat(several, np.diff(np.append(first, len(order))))
        out &= np.searchsorted(page, page, "right") - np.arange(len(page)) >= run
    return out


def covered_by(starts: np.ndarray, run: int = MIN_RUN) -> np.ndarray:
    """Which tokens lie in a run of ``run`` tokens that starts at one of ``starts``."""
    edge = np.zeros(len(starts) + 1, np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    np.subtract.at(edge, np.minimum(at + run, len(starts)), 1)
    return np.cumsum(edge[:-1]) > 0


class Page:
    """The blocks of a page's text, and hashes of the tokens that a suffix array may decide on."""

    def __init__(self, article: bool, whole: str):
        self.article, self.whole = article, whole
        self.blocks = whole.split("\n") if whole else []

    @classmethod
    def parse(cls, page: str | None) -> Page:
        found, article = blocks(page) if page else ([], False)
        kind = "main" if article and any(k == "main" for k, _ in found) else "open"
        return cls(kind == "main", "\n".join(t for k, t in found if k == kind))

    @functools.cached_property
    def hashed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the tokens, the places of the blocks' first tokens, and hashes of the blocks."""
        data = np.frombuffer(self.whole.encode(), np.uint8)
        starts, ends, _ = K.spans(~K.WHITE[data], np.array([0, len(data)]))
        breaks = np.flatnonzero(data == 10)
        if not self.blocks:
            return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64)
        hashes = K.hash_spans(K.prefix_sums(data), np.concatenate([starts, [0], breaks + 1]), np.concatenate([ends, breaks, [len(data)]]))
        return hashes[: len(starts)], np.concatenate([[0], np.searchsorted(starts, breaks), [len(starts)]]), hashes[len(starts) :].astype(np.int64)

    @property
    def words(self) -> np.ndarray:
        return self.hashed[0]

    @property
    def edges(self) -> np.ndarray:
        return self.hashed[1]

    @property
    def keys(self) -> np.ndarray:
        return self.hashed[2]

    def long_blocks(self) -> list[int]:
        return np.flatnonzero(np.diff(self.edges) >= MIN_RUN).tolist()

    def runs(self) -> np.ndarray:
        return K.windows(self.words, MIN_RUN).astype(np.int64)

    def without(self, keys: np.ndarray) -> str:
        """The text without the runs or notices whose hashes are ``keys``."""
        if not len(keys):
            return self.whole
        if self.article:
            return self.result(np.zeros(0, bool), {k for k in self.long_blocks() if self.keys[k] in keys})
        starts = np.zeros(len(self.words), bool)
        own = self.runs()
        starts[: len(own)] = np.isin(own, keys)
        return self.result(starts, set())

    def result(self, starts: np.ndarray, notices: set[int]) -> str:
        """The text without the open runs that start at ``starts``, or without the ``notices`` among an article's blocks."""
        if self.article:
            if notices:
                sizes = np.diff(self.edges)
                if 2 * sum(int(sizes[k]) for k in notices) >= self.edges[-1]:
                    notices = set()
            return "\n".join(t for k, t in enumerate(self.blocks) if k not in notices)
        gone = covered_by(starts)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= COPY_RUN:
                gone[a:b] = False
        out = []
        for k, text in enumerate(self.blocks):
            here = gone[self.edges[k] : self.edges[k + 1]]
            left = text.split() if not here.any() else [w for w, g in zip(text.split(), here.tolist(), strict=True) if not g]
            if left:
                out.append(" ".join(left))
        return "\n".join(out)


def extract(pages: list[str | None]) -> list[str]:
    """The main texts of the pages of a host, by one suffix array."""
    parsed = [Page.parse(p) for p in pages]
    texts = {(p.article, p.whole): p for p in parsed if p.blocks}  # each distinct text once
    found = list(groups(list(texts.values())))
    n_articles = sum(article for article, _ in texts)
    keys: dict[tuple[bool, str], list[int]] = {}
    for article, key, members in found:
        if len(members) >= (max(NOTICE_TEXTS, -(-NOTICE_PERCENT * n_articles // 100)) if article else 2):
            for p in members:
                keys.setdefault((article, p.whole), []).append(key)
    out = {x: p.without(np.array(keys.get(x, []), np.int64)) for x, p in texts.items()}
    return [out.get((p.article, p.whole), "") for p in parsed]


def _stream(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token streams of the pages in a row, the page of each token, and where each page begins."""
    words = np.concatenate([p.words for p in pages] + [np.zeros(0, np.uint64)])
    sizes = [len(p.words) for p in pages]
    return words, np.repeat(np.arange(len(pages)), sizes), np.cumsum([0, *sizes])


def groups(pages: list[Page]):
    """(article, hash of the shared tokens, pages) for the neighbours in the suffix arrays of distinct texts that share
    MIN_RUN tokens of open text, or a block of articles as a block; groups of one page as well."""
    articles, opened = ([p for p in pages if p.article == kind] for kind in (True, False))
    if opened:
        words, owner, _ = _stream(opened)
        order, common = suffix_array(words, owner)
        first, _ = _groups(order, common, owner, MIN_RUN)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        whole = np.searchsorted(owner, owner[order], "right") - order >= MIN_RUN  # a shorter suffix shares none
        runs = np.append(K.windows(words, MIN_RUN).astype(np.int64), np.zeros(MIN_RUN, np.int64))
        yield from ((False, key, [opened[k] for k in members]) for key, members in _members(group[whole], owner[order[whole]], runs[order[whole]]))
    if articles:
        words, owner, first = _stream(articles)
        order, common = suffix_array(words, owner)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        starts = np.concatenate([first[k] + p.edges[:-1] for k, p in enumerate(articles)])
        sizes, keys = (np.concatenate(x) for x in zip(*((np.diff(p.edges), p.keys) for p in articles), strict=True))
        for size in np.unique(sizes[sizes >= MIN_RUN]).tolist():
            some = np.flatnonzero(sizes == size)
            group = np.searchsorted(np.flatnonzero(common < size), rank[starts[some]], "right")
            yield from ((True, key, [articles[k] for k in members]) for key, members in _members(group, owner[starts[some]], keys[some]))


def _members(group: np.ndarray, page: np.ndarray, key: np.ndarray):
    """The key and the distinct pages of each group."""
    if not len(group):
        return
    order = np.lexsort((page, group))
    group, page, key = group[order], page[order], key[order]
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (page[1:] != page[:-1])
    ends = np.append(edges[1:], len(group))
    for a, b, k in zip(edges.tolist(), ends.tolist(), key[edges].tolist(), strict=True):
        yield k, page[a:b][new[a:b]].tolist()


SCHEMA = "page_id long, url string, text string, n_chars long"


def _parsed(rows: DataFrame, once: bool) -> DataFrame:
    """``rows`` (page_id, url, html, host, ...) with (article, whole) instead of the markup; with ``once`` a task leaves
    out the repeats of a text within a host, and empty ones."""

    def run(batches):
        seen: set[tuple[str, bool, int]] = set()
        for batch in batches:
            pages = [Page.parse(x) for x in batch.column("html").to_pylist()]
            if once:
                same = [(h, p.article, hash(p.whole)) for h, p in zip(batch.column("host").to_pylist(), pages, strict=True)]
                keep = [bool(p.whole) and not (x in seen or seen.add(x)) for x, p in zip(same, pages, strict=True)]
                batch, pages = batch.filter(pa.array(keep, pa.bool_())), [p for p, k in zip(pages, keep, strict=True) if k]
            rest = batch.drop_columns("html")
            found = [pa.array([p.article for p in pages], pa.bool_()), pa.array([p.whole for p in pages], pa.string())]
            yield pa.RecordBatch.from_arrays([*rest.columns, *found], names=[*rest.schema.names, "article", "whole"])

    left = rows.drop("html").schema
    return rows.mapInArrow(run, left.add("article", "boolean").add("whole", "string")).withColumn("text", F.xxhash64("whole"))


def _shard_groups(texts: DataFrame) -> DataFrame:
    """(host, article, key, texts): the groups of the suffix arrays of each shard, with the texts that they lie on; and,
    with a null key, all articles. ``texts``: (host, shard, article, text, whole)."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = texts.select("host", "shard", "article", "text", "whole").repartition(parts, "host", "shard").sortWithinPartitions("host", "shard", "article", "text")

    def run(batches):
        key, pages = None, {}

        def close():
            ids = {id(p): text for (_, text), p in pages.items()}
            found = [(article, k, [ids[id(p)] for p in members]) for article, k, members in groups(list(pages.values()))]
            found.append((True, None, [text for article, text in pages if article]))
            for k in range(0, len(found), 10_000):
                some = list(zip(*found[k : k + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * len(some[0]), pa.string()), pa.array(some[0], pa.bool_()), pa.array(some[1], pa.int64()), pa.array(some[2], pa.list_(pa.int64()))],
                    names=["host", "article", "key", "texts"],
                )

        for batch in batches:
            for h, s, article, text, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h, s) != key:
                    if key is not None:
                        yield from close()
                    key, pages = (h, s), {}
                if (article, text) not in pages:
                    pages[article, text] = Page(article, whole)
        if key is not None:
            yield from close()

    return met.mapInArrow(run, "host string, article boolean, key long, texts array<long>")


def _repeats(found: DataFrame) -> DataFrame:
    """(host, article, text, keys): the runs and notices that go from a text. ``found``: the shards' groups; a text is in
    one shard, so the numbers of texts add up."""
    articles = found.filter("key is null").groupBy("host").agg(F.sum(F.size("texts")).alias("articles"))
    merged = found.filter("key is not null").groupBy("host", "article", "key").agg(F.sum(F.size("texts")).alias("n"))
    merged = merged.filter(F.col("n") >= F.when(F.col("article"), NOTICE_TEXTS).otherwise(2)).join(articles, "host")
    gone = merged.filter(~F.col("article") | (100 * F.col("n") >= NOTICE_PERCENT * F.col("articles")))
    members = found.join(gone, ["host", "article", "key"], "left_semi").select("host", "article", "key", F.explode("texts").alias("text"))
    return members.groupBy("host", "article", "text").agg(F.collect_list("key").alias("keys"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    spark = pages.sparkSession
    small_batches(spark)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host)
    large = settle(rows.groupBy("host").count().filter(F.col("count") > SHARD_PAGES).withColumn("shards", F.ceil(F.col("count") / SHARD_PAGES)), "large-hosts")
    dealt = _parsed(rows.select("host", "html"), True).join(large.select("host", "shards"), "host", "left")
    dealt = dealt.withColumn("shard", F.coalesce(F.pmod("text", "shards"), F.lit(0)))
    repeats = settle(_repeats(settle(_shard_groups(dealt), "shard-groups")), "repeats")
    met = _parsed(rows, False).join(repeats, ["host", "article", "text"], "left").select("page_id", "url", "article", "whole", "keys")

    def run(batches):
        for batch in batches:
            ids, urls, *rest = batch.columns
            found = [Page(a, w).without(np.array(k or [], np.int64)) for a, w, k in zip(*(c.to_pylist() for c in rest), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return met.mapInArrow(run, SCHEMA)
