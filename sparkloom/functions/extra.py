"""The remaining members of the families: colours, identifiers, quantities, closure tables, JSON schemas and others."""

from __future__ import annotations

import difflib
import html
import json
import math
import re
import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bits, domain, numeric, text
from .common import vectorized

# ---- colours

color_rgb, color_rgba, color_hex = bits.color_from_rgb, bits.color_from_rgba, bits.color_from_hex


def _hue(r: Column, g: Column, b: Column, high: Column, span: Column) -> Column:
    h = F.when(high == r, F.pmod((g - b) / span, F.lit(6.0))).when(high == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    return F.when(span == 0, F.lit(0.0)).otherwise(h * 60)


def color_to_hsl(c: Column) -> Column:
    """(hue in degrees, saturation, lightness), the latter from 0 to 1."""
    r, g, b = ((F.shiftrightunsigned(c, s).bitwiseAND(F.lit(255))) / 255.0 for s in (24, 16, 8))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span, light = high - low, (high + low) / 2
    sat = F.when(span == 0, F.lit(0.0)).otherwise(span / (1 - F.abs(2 * light - 1)))
    return F.struct(_hue(r, g, b, high, span).alias("h"), sat.alias("s"), light.alias("l"))


def color_from_hsl(h: Column, s: Column, l: Column) -> Column:  # noqa: E741
    def channel(n: int) -> Column:
        k = F.pmod(F.lit(n) + h / 30.0, F.lit(12.0))
        a = s * F.least(l, 1 - l)
        return F.round((l - a * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))) * 255).cast("long")

    return bits.color_from_rgba(channel(0), channel(8), channel(4), F.lit(255))


color_hsl = color_from_hsl


def color_lighten(c: Column, by: Column) -> Column:
    x = color_to_hsl(c)
    return color_from_hsl(x["h"], x["s"], F.least(x["l"] + by, F.lit(1.0)))


def color_darken(c: Column, by: Column) -> Column:
    x = color_to_hsl(c)
    return color_from_hsl(x["h"], x["s"], F.greatest(x["l"] - by, F.lit(0.0)))


def color_palette(c: Column, kind: str) -> Column:
    """complementary, triadic, analogous or tetradic: the colour turned by fixed angles."""
    x = color_to_hsl(c)
    turns = {"complementary": [0, 180], "triadic": [0, 120, 240], "analogous": [0, 30, 330], "tetradic": [0, 90, 180, 270]}[kind]
    return F.array(*[color_from_hsl(F.pmod(x["h"] + t, F.lit(360.0)), x["s"], x["l"]) for t in turns])


# ---- similarity


def cosine_similarity(a: Column, b: Column) -> Column:
    """Over the counts of two lists of terms."""
    terms = F.array_distinct(F.concat(a, b))
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t)).cast("double")
    total = lambda f: F.aggregate(F.transform(terms, f), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(total(lambda t: count(a, t) * count(a, t)) * total(lambda t: count(b, t) * count(b, t)))
    return F.when(norm == 0, F.lit(0.0)).otherwise(total(lambda t: count(a, t) * count(b, t)) / norm)


def qgram_distance(a: Column, b: Column, n: int) -> Column:
    """Sum of the differences of the counts of n-grams."""
    x, y = bits.shingle(a, n), bits.shingle(b, n)
    grams = F.array_distinct(F.concat(x, y))
    count = lambda xs, t: F.size(F.filter(xs, lambda g: g == t))
    return F.aggregate(F.transform(grams, lambda t: F.abs(count(x, t) - count(y, t))), F.lit(0), lambda s, v: s + v)


@vectorized("binary")
def minhash_encode(signature):
    return struct.pack(f"<{len(signature)}q", *signature)


@vectorized("array<long>")
def minhash_decode(raw):
    return list(struct.unpack(f"<{len(raw) // 8}q", raw))


# ---- calendars and schedules


def day_of_week(d: Column) -> Column:
    """Monday is 0."""
    return F.weekday(d)


def week_of_fiscal_year(d: Column, start_month: int) -> Column:
    first = F.make_date(F.year(d) - F.when(F.month(d) < start_month, 1).otherwise(0), F.lit(start_month), F.lit(1))
    return F.floor(F.datediff(d, first) / 7).cast("int") + 1


@vectorized("boolean")
def cron_parse(expression):
    """Whether it is a schedule of five fields."""
    try:
        domain._cron(expression)
    except (ValueError, IndexError):
        return False
    return True


@vectorized("array<timestamp_ntz>")
def cron_list(expression, after, count):
    out, at = [], after
    while len(out) < count and at is not None:
        at = domain._step(expression, at, 1)
        out.append(at)
    return [a for a in out if a is not None]


@vectorized("array<timestamp_ntz>")
def cron_between(expression, start, end):
    """The times after start and before end."""
    out, at = [], domain._step(expression, start, 1)
    while at is not None and at < end:
        out.append(at)
        at = domain._step(expression, at, 1)
    return out


@vectorized("string")
def cron_human_readable(expression):
    names = ("minute", "hour", "day of month", "month", "day of week")
    parts = [f"{n} {f}" for f, n in zip(expression.split(), names, strict=True) if f != "*"]
    return "every minute" if not parts else "at " + ", ".join(parts)


def time_bucket_calendar(months: int, ts: Column) -> Column:
    """The start of the bucket of so many months, counted from 1970-01."""
    n = (F.year(ts) - 1970) * 12 + F.month(ts) - 1
    return F.add_months(F.lit("1970-01-01").cast("date"), (n - F.pmod(n, F.lit(months))).cast("int"))


def time_bucket_gapfill_calendar(months: int, start: Column, end: Column) -> Column:
    return F.sequence(time_bucket_calendar(months, start), time_bucket_calendar(months, end), F.make_interval(months=F.lit(months)))


# ---- finance and statistics


@vectorized("double")
def xirr(days, flows):
    value = lambda r: sum(f / (1 + r) ** ((d - days[0]) / 365) for d, f in zip(days, flows, strict=True))
    low, high = -0.9999, 10.0
    if value(low) * value(high) > 0:
        return None
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if value(low) * value(mid) > 0 else (low, mid)
    return (low + high) / 2


@vectorized("double")
def bond_yield(face, coupon, price, periods):
    worth = lambda y: sum(face * coupon / (1 + y) ** k for k in range(1, int(periods) + 1)) + face / (1 + y) ** periods
    low, high = -0.99, 10.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if worth(mid) > price else (low, mid)
    return (low + high) / 2


@vectorized("double")
def depreciation_db(cost, salvage, life, period):
    """Fixed declining balance: the rate takes cost to salvage over the life."""
    rate = 1 - (salvage / cost) ** (1 / life)
    return cost * (1 - rate) ** (period - 1) * rate


def forecast_linear(x: Column, y: Column, future: Column) -> Column:
    fit = numeric.linear_regression(x, y)
    return F.transform(future, lambda v: fit["intercept"] + fit["slope"] * v)


def weighted_moving_average(a: Column, weights: Column) -> Column:
    """For each full window, the last value under the last weight."""
    n = F.size(weights)
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    at = F.sequence(F.lit(1), F.size(a) - n + 1)
    return F.transform(at, lambda i: F.aggregate(F.zip_with(F.slice(a, i, n), weights, lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v) / total)


@vectorized("double")
def matrix_norm(rows, cols, data, kind):
    """frobenius, 1, inf or max."""
    m = numeric._matrix(rows, cols, data)
    return float({"frobenius": lambda: np.linalg.norm(m), "1": lambda: np.abs(m).sum(0).max(), "inf": lambda: np.abs(m).sum(1).max(), "max": lambda: np.abs(m).max()}[kind]())


@vectorized("struct<u:array<double>,s:array<double>,vt:array<double>>")
def svd(rows, cols, data):
    u, s, vt = np.linalg.svd(numeric._matrix(rows, cols, data), full_matrices=False)
    return {"u": u.ravel().tolist(), "s": s.tolist(), "vt": vt.ravel().tolist()}


@vectorized("struct<components:array<double>,projected:array<double>,variance:array<double>>")
def pca(rows, cols, data, k):
    """The first k components of centred rows, largest variance first."""
    m = numeric._matrix(rows, cols, data)
    m = m - m.mean(0)
    _, s, vt = np.linalg.svd(m, full_matrices=False)
    return {"components": vt[:k].ravel().tolist(), "projected": (m @ vt[:k].T).ravel().tolist(), "variance": (s[:k] ** 2 / max(len(m) - 1, 1)).tolist()}


@vectorized("array<struct<mu:double,sigma:double>>")
def trueskill_update(ratings, ranks):
    """Pairwise updates of (mean, deviation) in order of rank, performance deviation 25/6, draw margin 0."""
    beta2 = (25 / 6) ** 2
    mu, s2 = [float(r[0]) for r in ratings], [float(r[1]) ** 2 for r in ratings]
    order = sorted(range(len(mu)), key=lambda i: ranks[i])
    pdf = lambda t: math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    cdf = lambda t: max(0.5 * math.erfc(-t / math.sqrt(2)), 1e-12)
    for a, b in zip(order, order[1:], strict=False):
        if ranks[a] == ranks[b]:
            continue
        c = math.sqrt(2 * beta2 + s2[a] + s2[b])
        t = (mu[a] - mu[b]) / c
        v = pdf(t) / cdf(t)
        w = v * (v + t)
        mu[a], mu[b] = mu[a] + s2[a] / c * v, mu[b] - s2[b] / c * v
        s2[a], s2[b] = s2[a] * max(1 - s2[a] / c**2 * w, 1e-6), s2[b] * max(1 - s2[b] / c**2 * w, 1e-6)
    return [{"mu": m, "sigma": math.sqrt(s)} for m, s in zip(mu, s2, strict=True)]


# ---- identifiers


def iban_country(x: Column) -> Column:
    return F.left(F.upper(F.regexp_replace(x, " ", "")), F.lit(2))


def iban_bban(x: Column) -> Column:
    return F.substring(F.upper(F.regexp_replace(x, " ", "")), 5, 40)


def isbn_to_13(x: Column) -> Column:
    body = F.concat(F.lit("978"), F.left(F.regexp_replace(x, "[ -]", ""), F.lit(9)))
    total = F.aggregate(F.transform(F.split(body, ""), lambda d, i: d.cast("int") * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda s, v: s + v)
    return F.when(F.length(F.regexp_replace(x, "[ -]", "")) == 13, F.regexp_replace(x, "[ -]", "")).otherwise(F.concat(body, F.pmod(-total, F.lit(10)).cast("string")))


# First characters of a vehicle number and where it was made; the letters of model years from 1980 on.
VIN_REGIONS = {"1": "United States", "4": "United States", "5": "United States", "2": "Canada", "3": "Mexico", "J": "Japan", "K": "South Korea", "L": "China", "S": "United Kingdom", "V": "France", "W": "Germany", "Y": "Sweden", "Z": "Italy", "9": "Brazil"}
VIN_YEARS = "ABCDEFGHJKLMNPRSTVWXY123456789"


def vin_country(x: Column) -> Column:
    return F.create_map(*[F.lit(v) for p in VIN_REGIONS.items() for v in p])[F.left(F.upper(x), F.lit(1))]


def vin_manufacturer(x: Column) -> Column:
    return F.left(F.upper(x), F.lit(3))


def vin_year(x: Column) -> Column:
    """A letter in the seventh place puts the year from 2010 on."""
    at = F.instr(F.lit(VIN_YEARS), F.substring(F.upper(x), 10, 1))
    return F.when(at > 0, at + 1979 + F.when(F.substring(x, 7, 1).rlike("[A-Za-z]"), 30).otherwise(0))


# ---- networks, URLs, versions, ranges


def cidr_parse(x: Column) -> Column:
    return F.struct(domain.inet_host(x).alias("addr"), domain.inet_prefix(x).alias("prefix"), domain.inet_family(x).alias("family"))


inet_parse = cidr_parse


def macaddr_parse(x: Column) -> Column:
    return F.unhex(F.regexp_replace(x, "[^0-9A-Fa-f]", ""))


def ip_compare(a: Column, b: Column) -> Column:
    return text.compare(domain.ip_sort_key(a), domain.ip_sort_key(b))


def path_compare(a: Column, b: Column) -> Column:
    """Part by part, in natural order."""
    key = lambda x: F.transform(F.split(x, "/"), text.natural_sort_key)
    return text.compare(key(a), key(b))


def url_parse(x: Column) -> Column:
    return F.struct(domain.url_scheme(x).alias("scheme"), domain.url_host(x).alias("host"), domain.url_port(x).alias("port"), domain.url_path(x).alias("path"), F.try_parse_url(x, F.lit("QUERY")).alias("query"), domain.url_fragment(x).alias("fragment"))


def semver_compare(a: Column, b: Column) -> Column:
    return text.compare(domain.semver_parse(a), domain.semver_parse(b))


def range_lower(r: Column) -> Column:
    return r["lower"]


def range_upper(r: Column) -> Column:
    return r["upper"]


def range_lower_inclusive(r: Column) -> Column:
    return r["lower_inc"]


def range_upper_inclusive(r: Column) -> Column:
    return r["upper_inc"]


def range_union(a: Column, b: Column) -> Column:
    """Null where the ranges neither overlap nor touch."""
    low, high = F.least(a["lower"], b["lower"]), F.greatest(a["upper"], b["upper"])
    inc = lambda v, bound, flag: F.coalesce((a[bound] == v) & a[flag], F.lit(False)) | F.coalesce((b[bound] == v) & b[flag], F.lit(False))
    low = F.when(a["lower"].isNotNull() & b["lower"].isNotNull(), low)
    high = F.when(a["upper"].isNotNull() & b["upper"].isNotNull(), high)
    both = F.struct(low.alias("lower"), high.alias("upper"), inc(low, "lower", "lower_inc").alias("lower_inc"), inc(high, "upper", "upper_inc").alias("upper_inc"))
    return F.when(domain.range_overlaps(a, b) | domain.range_adjacent(a, b), both)


# ---- money and quantities: struct(value, unit)

# Code -> number, symbol, name.
CURRENCIES = {"USD": (840, "$", "US Dollar"), "EUR": (978, "€", "Euro"), "GBP": (826, "£", "Pound Sterling"), "JPY": (392, "¥", "Yen"), "CHF": (756, "CHF", "Swiss Franc"), "CNY": (156, "¥", "Yuan Renminbi"), "INR": (356, "₹", "Indian Rupee"), "KRW": (410, "₩", "Won"), "KWD": (414, "KD", "Kuwaiti Dinar")}


def _currency(code: Column, k: int) -> Column:
    return F.create_map(*[F.lit(v) for c, row in CURRENCIES.items() for v in (c, row[k])])[code]


def currency_lookup(code: Column) -> Column:
    return F.struct(_currency(code, 0).alias("numeric"), _currency(code, 1).alias("symbol"), _currency(code, 2).alias("name"), numeric.money_minor_digits(code).alias("minor_digits"))


def currency_by_numeric(number: Column) -> Column:
    return F.create_map(*[F.lit(v) for c, row in CURRENCIES.items() for v in (row[0], c)])[number]


def money_currency_code(m: Column) -> Column:
    return m["currency"]


def money_currency_symbol(m: Column) -> Column:
    return F.coalesce(_currency(m["currency"], 1), m["currency"])


def money_convert(m: Column, currency: str, rate: Column) -> Column:
    return numeric.money_create(numeric.money_amount(m) * rate, F.lit(currency))


def money_format(m: Column) -> Column:
    digits = numeric.money_minor_digits(m["currency"])
    amount = numeric.money_amount(m)
    shown = F.when(digits == 0, F.format_number(amount, 0)).when(digits == 3, F.format_number(amount, 3)).otherwise(F.format_number(amount, 2))
    return F.concat(money_currency_symbol(m), shown)


def format_currency(value: Column, currency: str) -> Column:
    return money_format(numeric.money_create(value, F.lit(currency)))


def quantity_create(value: Column, unit: str) -> Column:
    if unit not in numeric.UNITS:
        raise ValueError(f"{unit} is no unit")
    return F.struct(value.cast("double").alias("value"), F.lit(unit).alias("unit"))


def _factor(unit: Column) -> Column:
    return F.create_map(*[F.lit(v) for u, (_, f) in numeric.UNITS.items() for v in (u, f)])[unit]


def quantity_dimension(q: Column) -> Column:
    return F.create_map(*[F.lit(v) for u, (d, _) in numeric.UNITS.items() for v in (u, d)])[q["unit"]]


def quantity_unit_name(q: Column) -> Column:
    return q["unit"]


def _joined(a: Column, b: Column, value: Column) -> Column:
    good = F.when(quantity_dimension(a) == quantity_dimension(b), value).otherwise(F.raise_error(F.lit("quantities of different dimensions")).cast("double"))
    return F.struct(good.alias("value"), a["unit"].alias("unit"))


def quantity_add(a: Column, b: Column) -> Column:
    return _joined(a, b, a["value"] + b["value"] * _factor(b["unit"]) / _factor(a["unit"]))


def quantity_subtract(a: Column, b: Column) -> Column:
    return _joined(a, b, a["value"] - b["value"] * _factor(b["unit"]) / _factor(a["unit"]))


def quantity_scale(a: Column, k: Column) -> Column:
    return F.struct((a["value"] * k).alias("value"), a["unit"].alias("unit"))


def quantity_multiply(a: Column, b: Column) -> Column:
    """In base units, the unit named as a product."""
    return F.struct((a["value"] * _factor(a["unit"]) * b["value"] * _factor(b["unit"])).alias("value"), F.concat_ws("*", quantity_dimension(a), quantity_dimension(b)).alias("unit"))


def quantity_convert(a: Column, unit: str) -> Column:
    return F.when(quantity_dimension(a) == numeric.UNITS[unit][0], a["value"] * _factor(a["unit"]) / numeric.UNITS[unit][1])


def quantity_format(a: Column) -> Column:
    return F.concat_ws(" ", a["value"], a["unit"])


# ---- closure tables: array of (ancestor, descendant, depth); leaky buckets; nested sets


def closure_table_ancestors(rows: Column, node: Column) -> Column:
    return F.transform(F.filter(rows, lambda r: (r["descendant"] == node) & (r["depth"] > 0)), lambda r: r["ancestor"])


def closure_table_descendants(rows: Column, node: Column) -> Column:
    return F.transform(F.filter(rows, lambda r: (r["ancestor"] == node) & (r["depth"] > 0)), lambda r: r["descendant"])


def closure_table_depth(rows: Column, node: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.filter(rows, lambda r: r["descendant"] == node), lambda r: r["depth"])), F.lit(0))


def closure_table_insert(rows: Column, node: Column, parent: Column) -> Column:
    row = lambda a, d, n: F.struct(a.alias("ancestor"), d.alias("descendant"), n.cast("int").alias("depth"))
    above = F.transform(F.filter(rows, lambda r: r["descendant"] == parent), lambda r: row(r["ancestor"], node, r["depth"] + 1))
    return F.concat(rows, above, F.array(row(node, node, F.lit(0))))


def nested_set_subtree(rows: Column, node: Column) -> Column:
    own = F.filter(rows, lambda r: r["node"] == node)[0]
    return F.transform(F.filter(rows, lambda r: (r["lft"] >= own["lft"]) & (r["rgt"] <= own["rgt"])), lambda r: r["node"])


def leaky_bucket_create(capacity: Column, leak_per_second: Column) -> Column:
    return F.struct(capacity.alias("capacity"), leak_per_second.alias("rate"), F.lit(0.0).alias("level"), F.lit(0).cast("long").alias("at_ms"))


def leaky_bucket_add(bucket: Column, n: Column, now_ms: Column) -> Column:
    level = F.greatest(F.lit(0.0), bucket["level"] - bucket["rate"] * (now_ms - bucket["at_ms"]) / 1000.0)
    fits = level + n <= bucket["capacity"]
    new = F.struct(bucket["capacity"].alias("capacity"), bucket["rate"].alias("rate"), F.when(fits, level + n).otherwise(level).alias("level"), now_ms.alias("at_ms"))
    return F.struct(fits.alias("allowed"), new.alias("bucket"))


# ---- JSON, documents, regular expressions, geometry


def json_get_text(x: Column, key: str) -> Column:
    return F.get_json_object(x, f"$.{key}")


def json_get_path(x: Column, path: list[str]) -> Column:
    return F.get_json_object(x, "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path))


json_get_path_text = json_get_path


def jsonb_contained_by(a: Column, b: Column) -> Column:
    return text.jsonb_contains(b, a)


@vectorized("array<struct<op:string,path:string,value:string>>")
def json_diff_table(a, b):
    return [{"op": r["op"], "path": r["path"], "value": json.dumps(r["value"]) if "value" in r else None} for r in text._diff(json.loads(a), json.loads(b))]


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int}


def _schema_errors(v, s: dict, path: str) -> list[str]:
    out = []
    kinds = s.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not any(isinstance(v, _TYPES[k]) and not (isinstance(v, bool) and k in ("number", "integer")) for k in kinds):
            return [f"{path}: not of type {'/'.join(kinds)}"]
    if "enum" in s and v not in s["enum"]:
        out.append(f"{path}: not in enum")
    if isinstance(v, dict):
        out += [f"{path}: lacks {k}" for k in s.get("required", []) if k not in v]
        for k, x in v.items():
            if k in s.get("properties", {}):
                out += _schema_errors(x, s["properties"][k], f"{path}/{k}")
            elif s.get("additionalProperties") is False:
                out.append(f"{path}: {k} is not allowed")
    if isinstance(v, list):
        out += [e for i, x in enumerate(v) for e in _schema_errors(x, s.get("items", {}), f"{path}/{i}")]
        out += [f"{path}: too few items"] * (len(v) < s.get("minItems", 0)) + [f"{path}: too many items"] * (len(v) > s.get("maxItems", len(v)))
    if isinstance(v, str):
        out += [f"{path}: too short"] * (len(v) < s.get("minLength", 0)) + [f"{path}: too long"] * (len(v) > s.get("maxLength", len(v)))
        out += [f"{path}: doesn't match"] * bool("pattern" in s and not re.search(s["pattern"], v))
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        out += [f"{path}: too small"] * (v < s.get("minimum", v)) + [f"{path}: too large"] * (v > s.get("maximum", v))
    return out


@vectorized("array<string>")
def json_schema_errors(document, schema):
    return _schema_errors(json.loads(document), json.loads(schema), "")


def json_schema_validate(document: Column, schema: Column) -> Column:
    return F.size(json_schema_errors(document, schema)) == 0


validate_json_schema = json_schema_validate


@vectorized("array<struct<column:string,old:string,new:string>>")
def row_diff(old, new):
    """Columns whose values differ between two JSON rows."""
    a, b = json.loads(old), json.loads(new)
    show = lambda r, k: None if r.get(k) is None else str(r[k])
    return [{"column": k, "old": show(a, k), "new": show(b, k)} for k in dict.fromkeys([*a, *b]) if a.get(k) != b.get(k)]


@vectorized("string")
def text_patch(original, target_diff):
    """Applies a unified diff as ``text_diff`` makes it; null if it doesn't fit."""
    lines, out, at = original.splitlines(), [], 0
    for row in target_diff.split("\n"):
        if m := re.match(r"@@ -(\d+)", row):
            start = int(m[1]) - 1
            out += lines[at:start]
            at = start
        elif row.startswith(("---", "+++")) and not out and at == 0:
            continue
        elif row[:1] in ("-", " "):
            if at >= len(lines) or lines[at] != row[1:]:
                return None
            if row[0] == " ":
                out.append(lines[at])
            at += 1
        elif row.startswith("+"):
            out.append(row[1:])
    return "\n".join(out + lines[at:])


@vectorized("string")
def sanitize_html(page, allowed):
    """Keeps the allowed tags, without attributes; scripts and styles go with their content."""
    bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "", page)
    keep = set(allowed)
    return re.sub(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>", lambda m: f"<{m[1]}{m[2].lower()}>" if m[2].lower() in keep else "", bare)


@vectorized("string")
def html_to_markdown(page):
    out = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "", page)
    out = re.sub(r"(?is)<h([1-6])[^>]*>(.*?)</h\1>", lambda m: f"\n{'#' * int(m[1])} {m[2].strip()}\n", out)
    for pattern, by in ((r"<(?:strong|b)>(.*?)</(?:strong|b)>", r"**\1**"), (r"<(?:em|i)>(.*?)</(?:em|i)>", r"*\1*"), (r"<code>(.*?)</code>", r"`\1`"), (r'<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', r"[\2](\1)"), (r"<li[^>]*>(.*?)</li>", r"\n- \1"), (r"</p>|<br\s*/?>", "\n")):
        out = re.sub("(?is)" + pattern, by, out)
    return re.sub(r"\n{3,}", "\n\n", html.unescape(re.sub(r"<[^>]*>", "", out))).strip()


markdown_extract_headers, markdown_extract_links = text.markdown_headers, text.markdown_links


def markdown_extract_code_blocks(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?s)```[^\n]*\n(.*?)```"), 1)


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


@vectorized("boolean")
def is_binary(data):
    head = bytes(data)[:8192]
    return b"\0" in head or sum(b < 9 or 13 < b < 32 for b in head) > 0.3 * max(len(head), 1)


@vectorized("string")
def detect_encoding(data):
    raw = bytes(data)
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if raw.startswith(mark):
            return name
    for name in ("ascii", "utf-8"):
        try:
            raw.decode(name)
            return name
        except UnicodeDecodeError:
            pass
    return "latin-1"


def regex_find(x: Column, p: str) -> Column:
    """(start, end) of the first match, from 0; null if there is none."""
    at, found = F.regexp_instr(x, F.lit(p)), F.regexp_extract(x, p, 0)
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(found)).alias("end")))


regex_find_compiled, regex_match_compiled = regex_find, text.regex_match


def regex_compile(pattern: str) -> str:
    """Checks the pattern once; the engine keeps compiled patterns itself."""
    re.compile(pattern)
    return pattern


def sm_parse(machine: Column) -> Column:
    return F.from_json(machine, "struct<initial:string,transitions:map<string,map<string,string>>>")


def st_dwithin(ax: Column, ay: Column, bx: Column, by: Column, distance: Column) -> Column:
    """The box first, so that a scan can prune by it; then the distance."""
    return (F.abs(ax - bx) <= distance) & (F.abs(ay - by) <= distance) & (numeric.st_distance(ax, ay, bx, by) <= distance)


def uuid_to_string(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(x)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def format_duration(seconds: Column) -> Column:
    """Days, hours, minutes and seconds, without zeros; 0s for none."""
    s = F.round(F.abs(seconds)).cast("long")
    parts = ((F.floor(s / 86400), "d"), (F.floor(s % 86400 / 3600), "h"), (F.floor(s % 3600 / 60), "m"), (s % 60, "s"))
    shown = F.concat_ws(" ", *[F.when(v > 0, F.concat(v.cast("string"), F.lit(u))) for v, u in parts])
    return F.concat(F.when(seconds < 0, "-").otherwise(""), F.when(s == 0, "0s").otherwise(shown))


def words_alike(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a.split(), b.split(), autojunk=False).ratio()


@vectorized("string")
def metaphone(word):
    """Philips's original code: consonants by their sound, vowels only at the start."""
    w = re.sub("[^A-Z]", "", word.upper())
    w = re.sub(r"([^C])\1+", r"\1", w)
    for start, by in (("KN", "N"), ("GN", "N"), ("PN", "N"), ("AE", "E"), ("WR", "R"), ("X", "S"), ("WH", "W")):
        if w.startswith(start):
            w = by + w[len(start) :]
            break
    if w.endswith("MB"):
        w = w[:-1]
    out, i, vowels, front = "", 0, set("AEIOU"), set("EIY")
    at = lambda k: w[k] if 0 <= k < len(w) else ""
    while i < len(w):
        c, n = w[i], at(i + 1)
        if c in vowels:
            out += c if i == 0 else ""
        elif c in "FJLMNR":
            out += c
        elif c == "B":
            out += "B"
        elif c == "C":
            if w[i : i + 3] == "CIA" or (n == "H" and at(i - 1) != "S"):
                out += "X"
                i += n == "H"
            elif n in front:
                out += "" if at(i - 1) == "S" else "S"
            else:
                out += "K"
                i += n in ("K", "H")
        elif c == "D":
            out += "J" if n == "G" and at(i + 2) in front else "T"
            i += n == "G" and at(i + 2) in front
        elif c == "G":
            if n == "H":
                out += "K" if at(i + 2) in vowels else ""
                i += 1
            elif n == "N":
                out += "" if i + 2 >= len(w) or w[i:] == "GNED" else "K"
            else:
                out += "J" if n in front else "K"
        elif c == "H":
            out += "H" if n in vowels and at(i - 1) not in set("CSPTG") else ""
        elif c == "K":
            out += "K"
        elif c == "P":
            out += "F" if n == "H" else "P"
            i += n == "H"
        elif c == "Q":
            out += "K"
        elif c == "S":
            if n == "H" or w[i : i + 3] in ("SIO", "SIA"):
                out += "X"
                i += n == "H"
            else:
                out += "S"
        elif c == "T":
            if n == "H":
                out += "0"
                i += 1
            elif w[i : i + 3] in ("TIO", "TIA"):
                out += "X"
            else:
                out += "" if w[i : i + 3] == "TCH" else "T"
        elif c == "V":
            out += "F"
        elif c in "WY":
            out += c if n in vowels else ""
        elif c == "X":
            out += "KS"
        elif c == "Z":
            out += "S"
        i += 1
    return out
