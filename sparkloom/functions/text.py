"""Strings: case, distance, phonetics, validation, extraction, diff, JSON and regular expressions."""

from __future__ import annotations

import difflib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import vectorized

# ---- semantics that differ from the builtins


def concat_skip(*columns: Column) -> Column:
    """Concatenation that skips nulls."""
    return F.concat_ws("", *columns)


def substring_overlap(x: Column, start: int, length: int | None = None) -> Column:
    """SQL's substring: a start before 1 eats into the length."""
    if length is None:
        return F.substring(x, max(start, 1), 2**31 - 1)
    end = start + length
    return F.substring(x, max(start, 1), max(end - max(start, 1), 0))


def like_plain(x: Column, pattern: str) -> Column:
    """LIKE with % and _ alone; a backslash is itself."""
    return x.like(pattern.replace("\\", "\\\\"))


# ---- case


def words(x: Column) -> Column:
    """The words of an identifier or a phrase: parted by other characters, by a capital after a small letter,
    and before the last capital of several that a small letter follows."""
    parted = F.regexp_replace(F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z])([A-Z][a-z])", "$1 $2")
    parted = F.regexp_replace(parted, r"[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.trim(parted), " "), lambda w: w != "")


def _title(w: Column) -> Column:
    return F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 2**31 - 1)))


def snake_case(x: Column) -> Column:
    return F.lower(F.array_join(words(x), "_"))


def kebab_case(x: Column) -> Column:
    return F.lower(F.array_join(words(x), "-"))


def pascal_case(x: Column) -> Column:
    return F.array_join(F.transform(words(x), _title), "")


def camel_case(x: Column) -> Column:
    whole = pascal_case(x)
    return F.concat(F.lower(F.left(whole, F.lit(1))), F.substring(whole, 2, 2**31 - 1))


def title_case(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, " "), _title), " ")


def slug(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-"))


def strip_html(x: Column) -> Column:
    return F.regexp_replace(x, "<[^>]*>", "")


def truncate_chars(x: Column, n: int, suffix: str = "...") -> Column:
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.left(x, F.lit(n)), F.lit(suffix)))


def truncate_words(x: Column, n: int) -> Column:
    parts = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(parts, 1, n), " ")


# ---- distance


def levenshtein_similarity(a: Column, b: Column) -> Column:
    size = F.greatest(F.length(a), F.length(b))
    return F.when(size == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / size)


@vectorized("int")
def damerau_levenshtein(a, b):
    """Edits with transposition of neighbours (optimal string alignment)."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        two, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
    return row[-1]


def _jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, (y for y, u in zip(b, used, strict=True) if u), strict=True)) / 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


@vectorized("double")
def jaro_similarity(a, b):
    return _jaro(a, b)


@vectorized("double")
def jaro_winkler(a, b):
    j = _jaro(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j)


def hamming(a: Column, b: Column) -> Column:
    """Places that differ; null for texts of different lengths."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def _sizes(a: Column, b: Column):
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.size(F.array_intersect(a, b)), F.size(a), F.size(b)


def jaccard_similarity(a: Column, b: Column) -> Column:
    both, x, y = _sizes(a, b)
    return F.when(x + y == 0, F.lit(1.0)).otherwise(both / (x + y - both))


def sorensen_dice(a: Column, b: Column) -> Column:
    both, x, y = _sizes(a, b)
    return F.when(x + y == 0, F.lit(1.0)).otherwise(2 * both / (x + y))


def overlap_coefficient(a: Column, b: Column) -> Column:
    both, x, y = _sizes(a, b)
    return F.when(F.least(x, y) == 0, F.lit(0.0)).otherwise(both / F.least(x, y))


def ngram_similarity(a: Column, b: Column, n: int) -> Column:
    from .bits import shingle

    return jaccard_similarity(shingle(a, n), shingle(b, n))


# ---- validation


def validate_email(x: Column) -> Column:
    return x.rlike(r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+$") & ~F.contains(x, F.lit(".."))


def validate_url(x: Column) -> Column:
    return x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+[^\s]*$")


def validate_uuid(x: Column) -> Column:
    return x.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def validate_json(x: Column) -> Column:
    return F.call_function("try_parse_json", x).isNotNull()


def _digits(x: Column) -> Column:
    return F.transform(F.split(x, ""), lambda c: c.cast("int"))


def _weighted(digits: Column, weight) -> Column:
    return F.aggregate(F.transform(digits, lambda d, i: d * weight(i)), F.lit(0), lambda s, v: s + v)


def validate_credit_card(x: Column) -> Column:
    bare = F.regexp_replace(x, "[ -]", "")
    return F.when(bare.rlike("^[0-9]{13,19}$"), F.call_function("luhn_check", bare)).otherwise(F.lit(False))


def validate_ean(x: Column) -> Column:
    """EAN-8 or EAN-13: weights 1 and 3 from the right."""
    good = x.rlike("^([0-9]{8}|[0-9]{13})$")
    total = _weighted(_digits(F.reverse(x)), lambda i: F.when(i % 2 == 1, 3).otherwise(1))
    return F.when(good, total % 10 == 0).otherwise(F.lit(False))


def validate_isbn(x: Column) -> Column:
    bare = F.upper(F.regexp_replace(x, "[ -]", ""))
    ten = F.transform(F.split(bare, ""), lambda c: F.when(c == "X", 10).otherwise(F.expr("int(0)") + c.try_cast("int")))
    return (
        F.when(bare.rlike("^[0-9]{9}[0-9X]$"), _weighted(ten, lambda i: F.lit(10) - i) % 11 == 0)
        .when(bare.rlike("^97[89][0-9]{10}$"), validate_ean(bare))
        .otherwise(F.lit(False))
    )


def validate_issn(x: Column) -> Column:
    bare = F.upper(F.regexp_replace(x, "-", ""))
    values = F.transform(F.split(bare, ""), lambda c: F.when(c == "X", 10).otherwise(c.try_cast("int")))
    return F.when(bare.rlike("^[0-9]{7}[0-9X]$"), _weighted(values, lambda i: F.lit(8) - i) % 11 == 0).otherwise(F.lit(False))


def validate_iban(x: Column) -> Column:
    bare = F.upper(F.regexp_replace(x, " ", ""))
    moved = F.concat(F.substring(bare, 5, 40), F.left(bare, F.lit(4)))
    value = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.try_cast("int"))
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda s, c: F.when(c.rlike("[A-Z]"), (s * 100 + value(c)) % 97).otherwise((s * 10 + value(c)) % 97))
    return F.when(bare.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1).otherwise(F.lit(False))


def validate_swift(x: Column) -> Column:
    return x.rlike("^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?$")


def validate_ssn(x: Column) -> Column:
    return x.rlike(r"^(?!000|666|9\d\d)\d{3}-?(?!00)\d{2}-?(?!0000)\d{4}$")


_VIN = {c: v for v, group in enumerate(["", "AJ", "BKS", "CLT", "DMU", "ENV", "FW", "GPX", "HY", "RZ"]) for c in group} | {str(d): d for d in range(10)}


@vectorized("boolean")
def validate_vin(x):
    """17 characters without I, O, Q and the right check digit."""
    x = x.upper()
    if len(x) != 17 or any(c not in _VIN for c in x):
        return False
    rest = sum(_VIN[c] * w for c, w in zip(x, (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2), strict=True)) % 11
    return x[8] == ("X" if rest == 10 else str(rest))


def is_valid_date(x: Column, pattern: str) -> Column:
    return F.try_to_timestamp(x, F.lit(pattern)).isNotNull()


# ---- regular expressions and extraction


def regex_match(x: Column, p: str) -> Column:
    return x.rlike(p)


def regex_find_all(x: Column, p: str) -> Column:
    return F.regexp_extract_all(x, F.lit(p), 0)


def regex_capture(x: Column, p: str, groups: int) -> Column:
    return F.array(*[F.regexp_extract(x, p, g) for g in range(groups + 1)])


def regex_split(x: Column, p: str) -> Column:
    return F.split(x, p)


def regex_count(x: Column, p: str) -> Column:
    return F.regexp_count(x, F.lit(p))


def regex_replace(x: Column, p: str, by: str) -> Column:
    """The first match alone."""
    return F.regexp_replace(x, f"^([\\s\\S]*?)(?:{p})", "$1" + by.replace("$", "\\$"))


def regex_replace_all(x: Column, p: str, by: str) -> Column:
    return F.regexp_replace(x, p, by)


def extract_emails(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), 0)


def extract_urls(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"https?://[^\s<>\"')\]]+"), 0)


def extract_phone_numbers(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?<![0-9])\+?[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"), 0)


def markdown_headers(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?m)^(#{1,6}\s+.+)$"), 1)


def markdown_links(x: Column) -> Column:
    found = F.arrays_zip(F.regexp_extract_all(x, F.lit(r"\[([^\]]*)\]\(([^)]*)\)"), 1).alias("text"), F.regexp_extract_all(x, F.lit(r"\[([^\]]*)\]\(([^)]*)\)"), 2).alias("url"))
    return found


# ---- diff and JSON


@vectorized("string")
def text_diff(a, b):
    """Unified diff of lines."""
    return "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), lineterm="", n=3))


@vectorized("array<struct<op:string,text:string>>")
def text_diff_words(a, b):
    """Runs of words that are equal, deleted or inserted."""
    x, y, out = a.split(), b.split(), []
    for tag, i, j, k, m in difflib.SequenceMatcher(a=x, b=y, autojunk=False).get_opcodes():
        if tag == "equal":
            out.append({"op": "equal", "text": " ".join(x[i:j])})
        else:
            out += [{"op": op, "text": " ".join(t)} for op, t in (("delete", x[i:j]), ("insert", y[k:m])) if t]
    return out


def _escape(p: str) -> str:
    return str(p).replace("~", "~0").replace("/", "~1")


def _diff(a, b, path: str = "") -> list[dict]:
    if isinstance(a, dict) and isinstance(b, dict):
        out = [{"op": "remove", "path": f"{path}/{_escape(k)}"} for k in a if k not in b]
        for k, v in b.items():
            out += _diff(a[k], v, f"{path}/{_escape(k)}") if k in a else [{"op": "add", "path": f"{path}/{_escape(k)}", "value": v}]
        return out
    return [] if a == b and type(a) is type(b) else [{"op": "replace", "path": path, "value": b}]


@vectorized("string")
def json_diff(a, b):
    """A JSON Patch (RFC 6902) from one document to the other."""
    return json.dumps(_diff(json.loads(a), json.loads(b)))


def _place(doc, path: str):
    parts = [p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]
    for p in parts[:-1]:
        doc = doc[int(p)] if isinstance(doc, list) else doc[p]
    return doc, parts[-1] if parts else None


@vectorized("string")
def json_patch(target, patch):
    """Applies a JSON Patch."""
    root = {"": json.loads(target)}
    for op in json.loads(patch):
        whole = lambda p: "/" + p if p else "/"
        read = lambda p: (lambda d, k: d[int(k)] if isinstance(d, list) else d[k])(*_place(root, "/" + p if p else "/"))
        where, key = _place(root, whole(op["path"]) if not op["path"].startswith("/") else "/" + op["path"])
        value = op.get("value")
        if op["op"] in ("move", "copy"):
            value = read(op["from"])
            if op["op"] == "move":
                d, k = _place(root, "/" + op["from"])
                d.pop(int(k) if isinstance(d, list) else k)
        if op["op"] == "test":
            if read(op["path"]) != value:
                return None
        elif op["op"] == "remove":
            where.pop(int(key) if isinstance(where, list) else key)
        elif isinstance(where, list):
            if op["op"] == "replace":
                where[int(key)] = value
            else:
                where.insert(len(where) if key == "-" else int(key), value)
        else:
            where[key] = value
    return json.dumps(root[""])


def _merge(a, b):
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _merge(out.get(k), v)
    return out


@vectorized("string")
def json_merge_patch(target, patch):
    """Applies a merge patch (RFC 7386)."""
    return json.dumps(_merge(json.loads(target), json.loads(patch)))


@vectorized("boolean")
def json_equals(a, b):
    return json.loads(a) == json.loads(b)


def _contains(a, b) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _contains(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return all(any(_contains(x, y) for x in a) for y in (b if isinstance(b, list) else [b]))
    return a == b


@vectorized("boolean")
def jsonb_contains(a, b):
    return _contains(json.loads(a), json.loads(b))


def json_get(x: Column, key: str) -> Column:
    return F.get_json_object(x, f"$.{key}")


def jsonb_exists(x: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(x), key), F.lit(False))


def jsonb_exists_any(x: Column, keys: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.json_object_keys(x), F.array(*map(F.lit, keys))), F.lit(False))


def jsonb_exists_all(x: Column, keys: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, keys)), F.coalesce(F.json_object_keys(x), F.array().cast("array<string>")))) == 0


# ---- natural order


def natural_sort_key(x: Column) -> Column:
    """Digit runs padded to 20 places, so plain order is natural order."""
    return F.regexp_replace(F.regexp_replace(x, r"([0-9]+)", "00000000000000000000$1"), r"0*([0-9]{20})(?![0-9])", "$1")


def compare(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def natural_compare(a: Column, b: Column) -> Column:
    return compare(natural_sort_key(a), natural_sort_key(b))


def version_compare(a: Column, b: Column) -> Column:
    parts = lambda x: F.transform(F.split(x, r"\."), lambda p: F.regexp_extract(p, r"([0-9]+)", 1).cast("int"))
    return compare(parts(a), parts(b))


def custom_order_rank(x: Column, order: list[str], unknown: int = 2**31 - 1) -> Column:
    at = F.array_position(F.array(*map(F.lit, order)), x).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.lit(unknown))


def format_bytes(x: Column, largest: str = "EB") -> Column:
    """Decimal prefixes up to the largest: no decimals from 100 on, one from 10 on, else two without trailing zeros."""
    out, units = F.concat(x.cast("string"), F.lit(" B")), ("KB", "MB", "GB", "TB", "PB", "EB")
    for k, unit in enumerate(units[: units.index(largest) + 1], 1):
        v = x / 1000.0**k
        short = F.regexp_replace(F.format_string("%.2f", v), r"\.?0+$", "")
        shown = F.when(v >= 100, F.format_string("%.0f", v)).when(v >= 10, F.format_string("%.1f", v)).otherwise(short)
        out = F.when(x >= 1000**k, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return out


def format_ordinal(x: Column) -> Column:
    tens, ones = F.abs(x) % 100, F.abs(x) % 10
    ending = F.when(tens.between(11, 13), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")
    return F.concat(x.cast("string"), ending)


def format_percentage(x: Column, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}f%%", x * 100)


_MARKS = re.compile(r"[^\d.-]")


def parse_number(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9.eE+-]", "").try_cast("double")
