"""Sketches held as bytes, geometry text, phonetics, documents, natural dates, name matching and sortable ids."""

from __future__ import annotations

import datetime as dt
import html
import json
import math
import re
import secrets as _random
import struct
import time

import xxhash as _xx
from pyspark.sql import functions as F

from .bits import signed
from .common import vectorized
from .text import _jaro

# ---- HyperLogLog: one byte of precision, then a byte per register


@vectorized("binary")
def hll_create(precision):
    return bytes([precision]) + bytes(1 << precision)


@vectorized("binary")
def hll_add(sketch, value):
    data, p = bytearray(sketch), sketch[0]
    h = _xx.xxh64_intdigest(value)
    rest = h & ((1 << (64 - p)) - 1)
    rank = 64 - p - rest.bit_length() + 1
    at = 1 + (h >> (64 - p))
    data[at] = max(data[at], rank)
    return bytes(data)


@vectorized("binary")
def hll_merge(a, b):
    if a[0] != b[0]:
        raise ValueError("sketches of different precision")
    return bytes([a[0]]) + bytes(map(max, a[1:], b[1:]))


@vectorized("long")
def hll_count(sketch):
    m = len(sketch) - 1
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    estimate = alpha * m * m / sum(2.0 ** -r for r in sketch[1:])
    empty = sketch[1:].count(0)
    return round(m * math.log(m / empty) if estimate <= 2.5 * m and empty else estimate)


@vectorized("double")
def hll_error(sketch):
    return 1.04 / math.sqrt(len(sketch) - 1)


# ---- Bloom filter: bits (uint32), hashes (uint32), the bit array


@vectorized("binary")
def bloom_create(items, rate):
    bits = max(8, math.ceil(-items * math.log(rate) / math.log(2) ** 2))
    return struct.pack("<II", bits, max(1, round(bits / items * math.log(2)))) + bytes(-(-bits // 8))


def _places(sketch: bytes, value: str):
    bits, hashes = struct.unpack_from("<II", sketch)
    a, b = _xx.xxh64_intdigest(value), _xx.xxh64_intdigest(value, seed=1) | 1
    return [(a + k * b) % bits for k in range(hashes)]


@vectorized("binary")
def bloom_add(sketch, value):
    data = bytearray(sketch)
    for p in _places(sketch, value):
        data[8 + p // 8] |= 1 << p % 8
    return bytes(data)


@vectorized("boolean")
def bloom_contains(sketch, value):
    return all(sketch[8 + p // 8] >> p % 8 & 1 for p in _places(sketch, value))


@vectorized("binary")
def bloom_merge(a, b):
    if a[:8] != b[:8]:
        raise ValueError("filters of different shapes")
    return a[:8] + bytes(x | y for x, y in zip(a[8:], b[8:], strict=True))


@vectorized("double")
def bloom_false_positive_rate(sketch):
    bits, hashes = struct.unpack_from("<II", sketch)
    return (int.from_bytes(sketch[8:], "little").bit_count() / bits) ** hashes


# ---- count-min: width, depth (uint32 each), counters (uint64)


@vectorized("binary")
def cms_create(width, depth):
    return struct.pack("<II", width, depth) + bytes(8 * width * depth)


def _cells(sketch: bytes, value: str):
    width, depth = struct.unpack_from("<II", sketch)
    return [8 + 8 * (d * width + _xx.xxh64_intdigest(value, seed=d) % width) for d in range(depth)]


@vectorized("binary")
def cms_add(sketch, value, count):
    data = bytearray(sketch)
    for at in _cells(sketch, value):
        struct.pack_into("<Q", data, at, struct.unpack_from("<Q", data, at)[0] + count)
    return bytes(data)


@vectorized("long")
def cms_estimate(sketch, value):
    return min(struct.unpack_from("<Q", sketch, at)[0] for at in _cells(sketch, value))


@vectorized("binary")
def cms_merge(a, b):
    if a[:8] != b[:8]:
        raise ValueError("sketches of different shapes")
    n = (len(a) - 8) // 8
    return a[:8] + struct.pack(f"<{n}Q", *(x + y for x, y in zip(struct.unpack_from(f"<{n}Q", a, 8), struct.unpack_from(f"<{n}Q", b, 8), strict=True)))


# ---- t-digest: compression, then (mean, weight) pairs, all doubles


def _compress(points: list[tuple[float, float]], limit: float) -> list[tuple[float, float]]:
    points = sorted(points)
    total, out, done = sum(w for _, w in points), [], 0.0
    for mean, weight in points:
        if out:
            m, w = out[-1]
            q = (done + (w + weight) / 2) / total
            if w + weight <= max(1.0, 4 * total * q * (1 - q) / limit):
                out[-1] = (m + (mean - m) * weight / (w + weight), w + weight)
                continue
            done += w
        out.append((mean, weight))
    return out


def _digest(data: bytes):
    numbers = struct.unpack(f"<{len(data) // 8}d", data)
    return numbers[0], list(zip(numbers[1::2], numbers[2::2], strict=True))


def _pack_digest(limit: float, points) -> bytes:
    return struct.pack(f"<{1 + 2 * len(points)}d", limit, *(x for p in points for x in p))


@vectorized("binary")
def tdigest_create(compression):
    return _pack_digest(float(compression), [])


@vectorized("binary")
def tdigest_add(digest, value):
    limit, points = _digest(digest)
    points.append((float(value), 1.0))
    return _pack_digest(limit, _compress(points, limit) if len(points) > 2 * limit else sorted(points))


@vectorized("binary")
def tdigest_merge(a, b):
    limit, points = _digest(a)
    return _pack_digest(limit, _compress(points + _digest(b)[1], limit))


def _quantile(points, q: float) -> float:
    total = sum(w for _, w in points)
    at, done, before = q * total, 0.0, None
    for mean, weight in points:
        middle = done + weight / 2
        if at <= middle:
            return mean if before is None else before[0] + (mean - before[0]) * (at - before[1]) / (middle - before[1])
        before, done = (mean, middle), done + weight
    return points[-1][0]


@vectorized("double")
def tdigest_quantile(digest, q):
    _, points = _digest(digest)
    return _quantile(points, q) if points else None


@vectorized("double")
def tdigest_cdf(digest, value):
    _, points = _digest(digest)
    if not points:
        return None
    low, high = 0.0, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if _quantile(points, mid) < value else (low, mid)
    return (low + high) / 2


# ---- geometry as text: WKT and GeoJSON of points, lines and polygons


def _parse_wkt(text: str):
    kind, body = re.match(r"\s*([A-Za-z]+)\s*(\(.*\))\s*$", text, re.S).groups()
    pairs = lambda s: [[float(x) for x in p.split()[:2]] for p in s.strip("() ").split(",")]
    kind = kind.upper()
    if kind == "POINT":
        return "Point", pairs(body)[0]
    if kind == "LINESTRING":
        return "LineString", pairs(body)
    return "Polygon", [pairs(r) for r in re.findall(r"\(([^()]*)\)", body)]


def _wkt(kind: str, c) -> str:
    number = lambda v: f"{v:.12g}"
    pairs = lambda ps: "(" + ", ".join(" ".join(map(number, p)) for p in ps) + ")"
    return {"Point": lambda: f"POINT{pairs([c])}", "LineString": lambda: f"LINESTRING{pairs(c)}", "Polygon": lambda: "POLYGON(" + ", ".join(map(pairs, c)) + ")"}[kind]()


@vectorized("string")
def st_as_geojson(wkt):
    kind, c = _parse_wkt(wkt)
    return json.dumps({"type": kind, "coordinates": c})


@vectorized("string")
def st_geom_from_geojson(text):
    g = json.loads(text)
    return _wkt(g["type"], g["coordinates"])


@vectorized("string")
def st_make_point(x, y):
    return _wkt("Point", [x, y])


@vectorized("string")
def st_centroid(wkt):
    """Area-weighted for polygons, length-weighted for lines."""
    kind, c = _parse_wkt(wkt)
    if kind == "Point":
        return _wkt("Point", c)
    ring = c[0] if kind == "Polygon" else c
    sx = sy = total = 0.0
    for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
        w = (x0 * y1 - x1 * y0) if kind == "Polygon" else math.hypot(x1 - x0, y1 - y0)
        k = 3 if kind == "Polygon" else 2
        sx, sy, total = sx + (x0 + x1) * w / k, sy + (y0 + y1) * w / k, total + w
    return _wkt("Point", [sx / total, sy / total])


@vectorized("string")
def st_buffer(wkt, distance):
    """A polygon of 32 corners around a point."""
    _, (x, y) = _parse_wkt(wkt)
    ring = [[x + distance * math.cos(math.tau * k / 32), y + distance * math.sin(math.tau * k / 32)] for k in range(32)]
    return _wkt("Polygon", [[*ring, ring[0]]])


# ---- phonetics


@vectorized("string")
def nysiis(name):
    """The code of the New York State Identification and Intelligence System, whole."""
    w = re.sub("[^A-Z]", "", name.upper())
    if not w:
        return ""
    for a, b in (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")):
        if w.startswith(a):
            w = b + w[len(a) :]
            break
    for ends, b in ((("EE", "IE"), "Y"), (("DT", "RT", "RD", "NT", "ND"), "D")):
        if w.endswith(ends):
            w = w[:-2] + b
    out, i = w[0], 1
    w = list(w)
    vowel = set("AEIOU")
    while i < len(w):
        c, rest = w[i], "".join(w[i:])
        if rest.startswith("EV"):
            new = "AF"
        elif c in vowel:
            new = "A"
        elif c in "QZM":
            new = {"Q": "G", "Z": "S", "M": "N"}[c]
        elif c == "K":
            new = "N" if rest.startswith("KN") else "C"
        elif rest.startswith("SCH"):
            new = "SSS"
        elif rest.startswith("PH"):
            new = "FF"
        elif c == "H" and (w[i - 1] not in vowel or (i + 1 < len(w) and w[i + 1] not in vowel) or i + 1 == len(w)):
            new = w[i - 1]
        elif c == "W" and w[i - 1] in vowel:
            new = w[i - 1]
        else:
            new = c
        w[i : i + len(new)] = new
        if new[-1] != out[-1]:
            out += new[-1] if len(set(new)) == 1 else new
        i += len(new)
    out = out[:-1] if out.endswith("S") and len(out) > 1 else out
    out = out[:-2] + "Y" if out.endswith("AY") else out
    return out[:-1] if out.endswith("A") and len(out) > 1 else out


# ---- names, companies, addresses

# What company names and addresses are cleared of or spelt out to.
COMPANY_WORDS = frozenset("inc incorporated llc ltd limited corp corporation co company gmbh ag sa plc the and".split())
STREET_WORDS = {"st": "street", "ave": "avenue", "rd": "road", "blvd": "boulevard", "dr": "drive", "ln": "lane", "apt": "apartment", "n": "north", "s": "south", "e": "east", "w": "west"}


def _tokens(x: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", x.lower())


def _alike(a: str, b: str) -> float:
    j, same = _jaro(a, b), 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j)


@vectorized("double")
def company_similarity(a, b):
    clear = lambda x: " ".join(t for t in _tokens(x) if t not in COMPANY_WORDS)
    return _alike(clear(a), clear(b))


@vectorized("double")
def address_similarity(a, b):
    spell = lambda x: " ".join(STREET_WORDS.get(t, t) for t in _tokens(x))
    return _alike(spell(a), spell(b))


@vectorized("double")
def name_similarity(a, b):
    """The better of the names as they are and with their parts sorted."""
    return max(_alike(" ".join(f(_tokens(a))), " ".join(f(_tokens(b)))) for f in (list, sorted))


# ---- documents


@vectorized("string")
def markdown_to_html(text):
    """Headings, lists, code blocks, paragraphs, emphasis, code, links."""

    def inline(s: str) -> str:
        s = html.escape(s, quote=False)
        for pattern, by in ((r"`([^`]+)`", r"<code>\1</code>"), (r"\*\*([^*]+)\*\*", r"<strong>\1</strong>"), (r"\*([^*]+)\*", r"<em>\1</em>"), (r"\[([^\]]*)\]\(([^)]*)\)", r'<a href="\2">\1</a>')):
            s = re.sub(pattern, by, s)
        return s

    out, items, para, code = [], [], [], None

    def close():
        if para:
            out.append(f"<p>{inline(' '.join(para))}</p>")
            para.clear()
        if items:
            out.append("<ul>" + "".join(f"<li>{inline(i)}</li>" for i in items) + "</ul>")
            items.clear()

    for line in text.split("\n"):
        if line.startswith("```"):
            if code is None:
                close()
                code = []
            else:
                out.append(f"<pre><code>{html.escape(chr(10).join(code), quote=False)}</code></pre>")
                code = None
        elif code is not None:
            code.append(line)
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            close()
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
        elif m := re.match(r"[-*]\s+(.*)", line):
            items.append(m[1])
        elif line.strip():
            para.append(line.strip())
        else:
            close()
    close()
    return "\n".join(out)


@vectorized("string")
def html_to_text(page):
    bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "", page)
    bare = re.sub(r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n", bare)
    return "\n".join(line for line in (" ".join(x.split()) for x in html.unescape(re.sub(r"<[^>]*>", "", bare)).split("\n")) if line)


@vectorized("string")
def detect_mime_type(data):
    # Leading bytes of common formats.
    for magic, kind in ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"%PDF-", "application/pdf"), (b"PK\x03\x04", "application/zip"), (b"\x1f\x8b", "application/gzip"), (b"PAR1", "application/vnd.apache.parquet"), (b"{", "application/json"), (b"<", "text/html")):
        if bytes(data).startswith(magic):
            return kind
    return "application/octet-stream" if b"\0" in bytes(data)[:512] else "text/plain"


# ---- natural dates and durations

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
_DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()


@vectorized("date")
def parse_natural_date(text, reference):
    """today, tomorrow, yesterday, [in] n units [ago], next/last weekday, or an ISO date; null for anything else."""
    t = text.lower().strip()
    if t in ("today", "now", "tomorrow", "yesterday"):
        return reference + dt.timedelta(days={"tomorrow": 1, "yesterday": -1}.get(t, 0))
    if m := re.fullmatch(r"(?:in )?(\d+) (day|week|month|year)s?( ago)?", t):
        n = int(m[1]) * (-1 if m[3] else 1)
        if m[2] in ("day", "week"):
            return reference + dt.timedelta(days=n * (7 if m[2] == "week" else 1))
        months = reference.year * 12 + reference.month - 1 + n * (12 if m[2] == "year" else 1)
        first = dt.date(months // 12, months % 12 + 1, 1)
        after = dt.date(first.year + first.month // 12, first.month % 12 + 1, 1)
        return first + dt.timedelta(days=min(reference.day, (after - first).days) - 1)
    if m := re.fullmatch(r"(next|last) (\w+)", t):
        if m[2] in _DAYS:
            ahead = (_DAYS.index(m[2]) - reference.weekday()) % 7
            return reference + dt.timedelta(days=(ahead or 7) if m[1] == "next" else (ahead - 7))
        if m[2] == "week":
            return reference + dt.timedelta(days=7 if m[1] == "next" else -7)
    try:
        return dt.date.fromisoformat(t)
    except ValueError:
        return None


@vectorized("long")
def parse_natural_duration(text):
    """Seconds of '1 hour 30 minutes', '2d 4h' and the like; null if anything is left over."""
    names = {k: v for u, v in _UNITS.items() for k in (u, f"{u}s", u[0])} | {"min": 60, "mins": 60, "sec": 1, "secs": 1, "hr": 3600, "hrs": 3600}
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*([a-z]+)", text.lower())
    left = re.sub(r"\d+(?:\.\d+)?\s*[a-z]+|and|,|\s", "", text.lower())
    if not parts or left or any(u not in names for _, u in parts):
        return None
    return round(sum(float(n) * names[u] for n, u in parts))


# ---- sortable ids (not deterministic)


def _ids(f, kind: str):
    """A function without arguments that gives a column of new ids."""
    return lambda: F.udf(f, kind).asNondeterministic()()


_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _base62(n: int, size: int) -> str:
    out = ""
    for _ in range(size):
        n, r = divmod(n, 62)
        out = _B62[r] + out
    return out


ksuid = _ids(lambda: _base62((int(time.time()) - 1_400_000_000) << 128 | _random.randbits(128), 27), "string")
tsid = _ids(lambda: signed((int(time.time() * 1000) - 1_577_836_800_000) << 22 | _random.randbits(22)), "long")
cuid2 = _ids(lambda: _random.choice("abcdefghijklmnopqrstuvwxyz") + "".join(_random.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(23)), "string")
snowflake = _ids(lambda: (int(time.time() * 1000) - 1_288_834_974_657) << 22 | _random.randbits(22), "long")
