"""Text analysis: tokenizers, token filters, stemming, language detection and highlighted fragments.

Tokenizers and filters are column functions from text to an array of terms and compose to analyzers. Only the stemmer
is Python, over Arrow batches; it remembers words it has seen.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import bm25, tokens

# ---- fixed values: scripts written without spaces, and stop words

CJK = r"一-鿿㐀-䶿぀-ゟ゠-ヿ豈-﫿가-힯"
STOP = {
    "en": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split(),
}


def whitespace(text: Column) -> Column:
    """Runs of what is not white space, as they stand."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def char_bigrams(text: Column) -> Column:
    """Words, and for scripts without spaces every two neighbours; the last character of a run stands alone as well."""
    return F.regexp_extract_all(_paired(text), F.lit(rf"([{CJK}]{{1,2}}|[\p{{L}}\p{{N}}_&&[^{CJK}]]+)"), 1)


def _paired(text: Column) -> Column:
    # each character of such a script is followed by its successor and a blank, so that pairs overlap
    return F.regexp_replace(text, rf"([{CJK}])(?=([{CJK}]?))", "$1$2 ")


def lowercase(terms: Column) -> Column:
    return F.transform(terms, F.lower)


def drop_stop_words(terms: Column, language: str = "en") -> Column:
    return F.filter(terms, lambda t: ~t.isin(STOP[language]))


def gram_filter(terms: Column, least: int, most: int) -> Column:
    """All substrings of the lengths ``least`` to ``most`` of each term, by length and then place."""
    sizes = F.sequence(F.lit(least), F.lit(most))

    def grams(t: Column) -> Column:
        at = lambda n: F.when(F.length(t) >= n, F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(sizes, lambda n: F.transform(at(n), lambda i: F.substring(t, i, n))))

    return F.flatten(F.transform(terms, grams))


def edge_grams(terms: Column, least: int, most: int) -> Column:
    """The prefixes of the lengths ``least`` to ``most`` of each term."""
    sizes = F.sequence(F.lit(least), F.lit(most))
    return F.flatten(F.transform(terms, lambda t: F.transform(F.filter(sizes, lambda n: n <= F.length(t)), lambda n: F.left(t, n))))


def synonym_groups(*groups: Sequence[str]) -> dict[str, list[str]]:
    """Each term of a group stands for all others of it."""
    found: dict[str, set[str]] = {}
    for group in groups:
        low = [t.lower() for t in group]
        for t in low:
            found.setdefault(t, set()).update(x for x in low if x != t)
    return {t: sorted(x) for t, x in found.items()}


def expand_synonyms(terms: Column, synonyms: Mapping[str, Sequence[str]]) -> Column:
    """Each term with its synonyms before it."""
    if not synonyms:
        return terms
    book = F.create_map(*[c for t, x in synonyms.items() for c in (F.lit(t), F.array(*map(F.lit, x)))])
    return F.flatten(F.transform(terms, lambda t: F.concat(F.coalesce(F.try_element_at(book, t), F.array().cast("array<string>")), F.array(t))))


# ---- stemming, after the published algorithm (Porter, 1980)

_FIRST = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous")]
_FIRST += [("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_SECOND = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_LAST = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(stem: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and len(stem) >= 3 and stem[-1] not in "wxy"


def _longest(word: str, rules: Sequence[tuple[str, str]], least: int) -> str:
    fits = [(a, b) for a, b in rules if word.endswith(a)]
    if fits:
        a, b = max(fits, key=lambda r: len(r[0]))
        if _measure(word[: -len(a)]) > least:
            return word[: -len(a)] + b
    return word


@functools.lru_cache(maxsize=100_000)
def porter(word: str) -> str:
    """The stem of a lower-case English word; words of other letters or up to two letters stay."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((e for e in ("ed", "ing") if w.endswith(e) and "v" in _shape(w[: -len(e)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w[-2:-1] == w[-1:] and _shape(w)[-1:] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _longest(_longest(w, _FIRST, 0), _SECOND, 0)
    ends = [e for e in _LAST if w.endswith(e)]
    if ends:
        stem = w[: -len(max(ends, key=len))]
        if _measure(stem) > 1 and (not w.endswith("ion") or stem[-1:] in ("s", "t")):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def stem(terms: Column) -> Column:
    @F.pandas_udf("array<string>")
    def batch(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ts: None if ts is None else [t if t is None else porter(t) for t in ts])

    return batch(terms)


# ---- analyzers


def standard(text: Column, language: str = "en") -> Column:
    """Words, lower-cased, less stop words; English ones stemmed."""
    kept = drop_stop_words(tokens(text), language)
    return stem(kept) if language == "en" else kept


def simple(text: Column) -> Column:
    """Runs of letters, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def cjk(text: Column) -> Column:
    return lowercase(char_bigrams(text))


def custom(tokenizer: Callable[[Column], Column], *filters: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda text: functools.reduce(lambda terms, f: f(terms), filters, tokenizer(text))


def detect_language(text: Column) -> Column:
    """en, es, fr, de, zh or ja: scripts without spaces by their share and kana, others by the most stop words; en for
    short texts and where none occurs. Ties go to the first in this order."""
    n = F.greatest(F.length(text), F.lit(1))
    without = F.length(text) - F.length(F.regexp_replace(text, rf"[{CJK}]", ""))
    words = tokens(text)
    stops = lambda k: F.size(words) - F.size(drop_stop_words(words, k))
    hits = [F.struct(stops(k).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(("en", "es", "fr", "de"))]
    kana = text.rlike(r"[぀-ヿ]")
    return F.when(without * 100 / n > 30, F.when(kana, "ja").otherwise("zh")).when(F.octet_length(text) < 20, "en").otherwise(F.greatest(*hits)["k"])


def fragments(text: Column, terms: Sequence[str], size: int = 150, most: int = 3, tag: str = "b") -> Column:
    """Up to ``most`` pieces of the text with the most hits, in text order, hits marked, joined by an ellipsis. Pieces
    end at a white space within ``size`` characters, or after ``size`` characters without any."""
    if not terms:
        return F.left(text, F.lit(size))
    word = r"(?i)(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, terms)) + r")(?![\p{L}\p{N}])"
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)(.{{1,{size}}}(?=\s|$)|.{{{size}}})"), 1)
    scored = F.transform(pieces, lambda p, i: F.struct((-F.regexp_count(p, F.lit(word))).alias("n"), i.alias("i"), p.alias("p")))
    best = F.slice(F.array_sort(scored), 1, most)
    ordered = F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p"))))
    return F.array_join(F.transform(ordered, lambda x: F.regexp_replace(F.trim(x["p"]), word, f"<{tag}>$1</{tag}>")), " ... ")


def multi_field(docs: DataFrame, key: str, boosts: Mapping[str, float], query: Sequence[str]) -> DataFrame:
    """(key, score): the sum of each field's BM25 score times its boost."""
    scored = [bm25(docs, key, field, query, boost) for field, boost in boosts.items()]
    return functools.reduce(DataFrame.union, scored).groupBy(key).agg(F.sum("score").alias("score"))
