"""Ranges, networks, URLs, versions, calendars, schedules, state machines, hierarchies, ids and time series."""

from __future__ import annotations

import datetime as dt
import ipaddress
import json
import secrets as _random
import time
import uuid as _uuid
from urllib.parse import urljoin, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import vectorized

# ---- ranges: struct(lower, upper, lower_inc, upper_inc); a null bound is unbounded


def range_create(lower: Column, upper: Column, lower_inc: bool = True, upper_inc: bool = False) -> Column:
    return F.struct(lower.alias("lower"), upper.alias("upper"), F.lit(lower_inc).alias("lower_inc"), F.lit(upper_inc).alias("upper_inc"))


def range_is_empty(r: Column) -> Column:
    return F.coalesce((r["lower"] > r["upper"]) | ((r["lower"] == r["upper"]) & ~(r["lower_inc"] & r["upper_inc"])), F.lit(False))


def range_contains_value(r: Column, x: Column) -> Column:
    above = r["lower"].isNull() | (x > r["lower"]) | ((x == r["lower"]) & r["lower_inc"])
    below = r["upper"].isNull() | (x < r["upper"]) | ((x == r["upper"]) & r["upper_inc"])
    return above & below


def _before(a: Column, b: Column) -> Column:
    """Whether range a ends before b starts."""
    return F.coalesce((a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~(a["upper_inc"] & b["lower_inc"])), F.lit(False))


def range_overlaps(a: Column, b: Column) -> Column:
    return ~_before(a, b) & ~_before(b, a) & ~range_is_empty(a) & ~range_is_empty(b)


def range_contains_range(a: Column, b: Column) -> Column:
    low = a["lower"].isNull() | F.coalesce((b["lower"] > a["lower"]) | ((b["lower"] == a["lower"]) & (a["lower_inc"] | ~b["lower_inc"])), F.lit(False))
    high = a["upper"].isNull() | F.coalesce((b["upper"] < a["upper"]) | ((b["upper"] == a["upper"]) & (a["upper_inc"] | ~b["upper_inc"])), F.lit(False))
    return range_is_empty(b) | (low & high)


def range_adjacent(a: Column, b: Column) -> Column:
    touch = lambda x, y: F.coalesce((x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"]), F.lit(False))
    return touch(a, b) | touch(b, a)


def range_intersection(a: Column, b: Column) -> Column:
    low, high = F.greatest(a["lower"], b["lower"]), F.least(a["upper"], b["upper"])
    low_inc = range_contains_value(a, low) & range_contains_value(b, low)
    high_inc = range_contains_value(a, high) & range_contains_value(b, high)
    both = F.struct(low.alias("lower"), high.alias("upper"), F.coalesce(low_inc, F.lit(False)).alias("lower_inc"), F.coalesce(high_inc, F.lit(False)).alias("upper_inc"))
    return F.when(range_overlaps(a, b), both)


# ---- networks


def ipv4_number(x: Column) -> Column:
    return F.aggregate(F.split(F.regexp_replace(x, "/.*$", ""), r"\."), F.lit(0).cast("long"), lambda s, p: s * 256 + p.cast("long"))


def inet_prefix(x: Column) -> Column:
    return F.when(F.contains(x, F.lit("/")), F.regexp_extract(x, "/([0-9]+)$", 1).cast("int")).otherwise(F.when(inet_family(x) == 4, 32).otherwise(128))


def inet_family(x: Column) -> Column:
    return F.when(F.contains(x, F.lit(":")), 6).otherwise(4)


def inet_host(x: Column) -> Column:
    return F.regexp_replace(x, "/.*$", "")


def _inet(f, kind: str):
    @vectorized(kind)
    def run(x):
        try:
            return f(ipaddress.ip_interface(x))
        except ValueError:
            return None

    return run


inet_network = _inet(lambda i: str(i.network), "string")
inet_broadcast = _inet(lambda i: f"{i.network.broadcast_address}/{i.network.prefixlen}", "string")
inet_netmask = _inet(lambda i: str(i.netmask), "string")
inet_format = _inet(lambda i: str(i.ip) if i.network.prefixlen == i.max_prefixlen else str(i), "string")
inet_is_private = _inet(lambda i: i.ip.is_private, "boolean")
inet_is_loopback = _inet(lambda i: i.ip.is_loopback, "boolean")
ip_sort_key = _inet(lambda i: (b"\0" * 12 if i.version == 4 else b"") + i.ip.packed, "binary")


@vectorized("boolean")
def inet_contains(net, address):
    """Whether the first network holds the second address or network."""
    a, b = ipaddress.ip_interface(net).network, ipaddress.ip_interface(address).network
    return a.version == b.version and b.subnet_of(a)


def macaddr_format(x: Column) -> Column:
    bare = F.lower(F.regexp_replace(x, "[^0-9A-Fa-f]", ""))
    return F.regexp_replace(bare, "(..)(?!$)", "$1:")


def macaddr_oui(x: Column) -> Column:
    return F.left(macaddr_format(x), F.lit(8))


# ---- URLs


def url_scheme(x: Column) -> Column:
    return F.lower(F.try_parse_url(x, F.lit("PROTOCOL")))


def url_host(x: Column) -> Column:
    return F.lower(F.try_parse_url(x, F.lit("HOST")))


def url_path(x: Column) -> Column:
    return F.try_parse_url(x, F.lit("PATH"))


def url_fragment(x: Column) -> Column:
    return F.try_parse_url(x, F.lit("REF"))


def url_query_param(x: Column, key: str) -> Column:
    return F.try_parse_url(x, F.lit("QUERY"), F.lit(key))


def url_query_params(x: Column) -> Column:
    return F.call_function("str_to_map", F.try_parse_url(x, F.lit("QUERY")), F.lit("&"), F.lit("="))


def url_port(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)(?:[/?#]|$)", 1), F.lit("")).cast("int")


def url_domain(x: Column) -> Column:
    parts = F.split(url_host(x), r"\.")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, F.size(parts) - 1, 2), ".")).otherwise(url_host(x))


def url_tld(x: Column) -> Column:
    return F.element_at(F.split(url_host(x), r"\."), -1)


def url_is_absolute(x: Column) -> Column:
    return x.rlike("^[A-Za-z][A-Za-z0-9+.-]*://")


@vectorized("string")
def url_normalize(x):
    """Lower-case scheme and host, no default port, no dot segments, sorted query, no empty path."""
    u = urlsplit(x)
    port = f":{u.port}" if u.port and u.port != {"http": 80, "https": 443}.get(u.scheme.lower()) else ""
    path = urlsplit(urljoin("http://x/", u.path or "/")).path
    return urlunsplit((u.scheme.lower(), (u.hostname or "") + port, path, "&".join(sorted(u.query.split("&"))) if u.query else "", u.fragment))


@vectorized("string")
def url_resolve(base, reference):
    return urljoin(base, reference)


# ---- versions: packed as major << 41 | minor << 21 | patch << 1 | 1, the last bit 0 for a pre-release


def semver_parse(x: Column) -> Column:
    part = lambda k: F.regexp_extract(x, r"^v?(\d+)\.(\d+)\.(\d+)", k).cast("long")
    release = F.when(x.rlike(r"^v?\d+\.\d+\.\d+-"), 0).otherwise(1)
    return F.when(x.rlike(r"^v?\d+\.\d+\.\d+"), part(1) * (1 << 41) + part(2) * (1 << 21) + part(3) * 2 + release)


def semver_major(v: Column) -> Column:
    return F.shiftright(v, 41)


def semver_minor(v: Column) -> Column:
    return F.shiftright(v, 21).bitwiseAND(F.lit((1 << 20) - 1))


def semver_patch(v: Column) -> Column:
    return F.shiftright(v, 1).bitwiseAND(F.lit((1 << 20) - 1))


def semver_is_prerelease(v: Column) -> Column:
    return v.bitwiseAND(F.lit(1)) == 0


def semver_format(v: Column) -> Column:
    body = F.concat_ws(".", semver_major(v), semver_minor(v), semver_patch(v))
    return F.when(semver_is_prerelease(v), F.concat(body, F.lit("-pre"))).otherwise(body)


def semver_increment_major(v: Column) -> Column:
    return (semver_major(v) + 1) * (1 << 41) + 1


def semver_increment_minor(v: Column) -> Column:
    return semver_major(v) * (1 << 41) + (semver_minor(v) + 1) * (1 << 21) + 1


def semver_increment_patch(v: Column) -> Column:
    return semver_major(v) * (1 << 41) + semver_minor(v) * (1 << 21) + (semver_patch(v) + 1) * 2 + 1


def semver_satisfies(v: Column, constraint: str) -> Column:
    """Comparators (= > >= < <=), caret and tilde, joined by blanks or commas."""
    out = F.lit(True)
    for word in constraint.replace(",", " ").split():
        op = next((o for o in (">=", "<=", ">", "<", "=", "^", "~") if word.startswith(o)), "=")
        numbers = [int(n) for n in (word.removeprefix(op).split(".") + ["0", "0"])[:3]]
        a, b, c = numbers
        low = a << 41 | b << 21 | c << 1 | 1
        high = {"^": (a + 1) << 41 if a else (b + 1) << 21 if b else (c + 1) << 1, "~": a << 41 | (b + 1) << 21}.get(op)
        out = out & {">=": v >= low, "<=": v <= low, ">": v > low, "<": v < low, "=": v == low}.get(op, (v >= low) & (v < high))
    return out


# ---- calendars


def is_business_day(d: Column, holidays: Column | None = None) -> Column:
    week = F.weekday(d) < 5
    return week if holidays is None else week & ~F.array_contains(holidays, d)


def next_business_day(d: Column, holidays: Column | None = None) -> Column:
    return F.filter(F.sequence(F.date_add(d, 1), F.date_add(d, 30)), lambda x: is_business_day(x, holidays))[0]


def add_business_days(d: Column, n: int, holidays: Column | None = None) -> Column:
    if not n:
        return d
    span = abs(n) * 2 + 30
    if n > 0:
        return F.element_at(F.filter(F.sequence(F.date_add(d, 1), F.date_add(d, span)), lambda x: is_business_day(x, holidays)), n)
    return F.element_at(F.filter(F.sequence(F.date_sub(d, span), F.date_sub(d, 1)), lambda x: is_business_day(x, holidays)), n)


def business_days_between(a: Column, b: Column, holidays: Column | None = None) -> Column:
    """Business days from a on, before b."""
    return F.when(b > a, F.size(F.filter(F.sequence(a, F.date_sub(b, 1)), lambda x: is_business_day(x, holidays)))).otherwise(0)


def fiscal_year(d: Column, start_month: int) -> Column:
    """Named by the calendar year in which it starts."""
    return F.year(d) - F.when(F.month(d) < start_month, 1).otherwise(0)


def fiscal_quarter(d: Column, start_month: int) -> Column:
    return F.floor(F.pmod(F.month(d) - start_month, F.lit(12)) / 3).cast("int") + 1


def time_bucket(seconds: int, ts: Column) -> Column:
    """The start of the bucket of this width, counted from 1970-01-01."""
    w = seconds * 1_000_000
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(w)))


def _field(spec: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in spec.split(","):
        body, _, step = part.partition("/")
        a, _, b = body.partition("-")
        first, last = (low, high) if body == "*" else (int(a), int(b) if b else (high if step else int(a)))
        out |= set(range(first, last + 1, int(step or 1)))
    return out


def _cron(expression: str):
    minute, hour, day, month, week = expression.split()
    fields = [_field(minute, 0, 59), _field(hour, 0, 23), _field(day, 1, 31), _field(month, 1, 12), {w % 7 for w in _field(week, 0, 7)}]
    either = day != "*" and week != "*"

    def day_matches(d: dt.datetime) -> bool:
        a, b = d.day in fields[2], (d.weekday() + 1) % 7 in fields[4]
        return d.month in fields[3] and (a or b if either else a and b)

    return fields, day_matches


def _step(expression: str, at: dt.datetime, way: int) -> dt.datetime | None:
    fields, day_matches = _cron(expression)
    d = at.replace(second=0, microsecond=0) + dt.timedelta(minutes=way if way > 0 or at == at.replace(second=0, microsecond=0) else 0)
    for _ in range(366 * 8):
        if day_matches(d):
            times = [(h, m) for h in sorted(fields[1]) for m in sorted(fields[0]) if ((h, m) >= (d.hour, d.minute) if way > 0 else (h, m) <= (d.hour, d.minute))]
            if times:
                h, m = times[0] if way > 0 else times[-1]
                return d.replace(hour=h, minute=m)
        d = (d + dt.timedelta(days=way)).replace(hour=0 if way > 0 else 23, minute=0 if way > 0 else 59)
    return None


@vectorized("timestamp_ntz")
def cron_next(expression, at):
    """The first time after ``at``: minute hour day month weekday."""
    return _step(expression, at, 1)


@vectorized("timestamp_ntz")
def cron_prev(expression, at):
    return _step(expression, at, -1)


@vectorized("boolean")
def cron_matches(expression, at):
    fields, day_matches = _cron(expression)
    return at.minute in fields[0] and at.hour in fields[1] and day_matches(at)


# ---- state machines: JSON {"initial": s, "transitions": {state: {event: state}}}


def sm_transition(machine: Column, state: Column, event: Column) -> Column:
    table = F.from_json(F.get_json_object(machine, "$.transitions"), "map<string,map<string,string>>")
    return table[state][event]


def sm_can_transition(machine: Column, state: Column, event: Column) -> Column:
    return sm_transition(machine, state, event).isNotNull()


def sm_is_terminal(machine: Column, state: Column) -> Column:
    return F.size(sm_available_events(machine, state)) == 0


def sm_available_events(machine: Column, state: Column) -> Column:
    table = F.from_json(F.get_json_object(machine, "$.transitions"), "map<string,map<string,string>>")
    return F.coalesce(F.sort_array(F.map_keys(table[state])), F.array().cast("array<string>"))


def _walk(machine: str, start: str) -> dict[str, list[str]]:
    table = json.loads(machine)["transitions"]
    paths, queue = {start: [start]}, [start]
    for s in queue:
        for _, t in sorted(table.get(s, {}).items()):
            if t not in paths:
                paths[t] = [*paths[s], t]
                queue.append(t)
    return paths


@vectorized("array<string>")
def sm_reachable_states(machine, state):
    return sorted(_walk(machine, state))


@vectorized("array<string>")
def sm_shortest_path(machine, start, goal):
    return _walk(machine, start).get(goal)


# ---- hierarchies: paths /a/b/c, nested sets


def path_ancestors(path: Column) -> Column:
    """From the root to the parent; none for the root itself."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    root = F.array(F.lit("/"))
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).when(F.size(parts) == 1, root).otherwise(F.concat(root, above))


def path_depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda p: p != ""))


def is_ancestor(a: Column, b: Column) -> Column:
    return F.startswith(b, F.concat(F.rtrim(a, F.lit("/")), F.lit("/"))) & (a != b)


def materialized_path(parts: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


@vectorized("array<struct<node:long,lft:int,rgt:int>>")
def nested_set_rebuild(edges):
    """Left and right numbers from (node, parent) pairs; roots have no parent."""
    children: dict = {}
    for e in edges:
        children.setdefault(None if e["parent"] is None or e["parent"] != e["parent"] else int(e["parent"]), []).append(int(e["node"]))
    out, n, left = [], 0, {}
    stack = [(c, False) for c in sorted(children.get(None, []), reverse=True)]
    while stack:
        node, done = stack.pop()
        n += 1
        if done:
            out.append({"node": node, "lft": left[node], "rgt": n})
            continue
        left[node] = n
        stack.append((node, True))
        stack += [(c, False) for c in sorted(children.get(node, []), reverse=True)]
    return sorted(out, key=lambda r: r["lft"])


# ---- ids (not deterministic)


def uuid_v4() -> Column:
    return F.uuid()


def _generator(f):
    """A function without arguments that gives a column of new ids."""
    return lambda: F.udf(f, "string").asNondeterministic()()


def _base32(n: int, size: int) -> str:
    return "".join("0123456789ABCDEFGHJKMNPQRSTVWXYZ"[n >> 5 * k & 31] for k in reversed(range(size)))


uuid_v7 = _generator(lambda: str(_uuid.UUID(int=int(time.time() * 1000) << 80 | 7 << 76 | _random.randbits(12) << 64 | 2 << 62 | _random.randbits(62))))
ulid = _generator(lambda: _base32(int(time.time() * 1000) << 80 | _random.randbits(80), 26))
nanoid = _generator(lambda: "".join(_random.choice("_-0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(21)))
