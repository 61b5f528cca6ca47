"""Finance, statistics of arrays, ratings, rate limits, matrices, points and money."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import vectorized


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _indexed(a: Column, f) -> Column:
    return F.transform(a, f)


# ---- finance


def npv(rate: Column, flows: Column) -> Column:
    """Net present value; the first flow is not discounted."""
    return _sum(F.transform(flows, lambda x, i: x / F.pow(1 + rate, i)))


@vectorized("double")
def irr(flows):
    """The rate at which the present value is zero: bisection of the widest bracket, null if there is none."""
    value = lambda r: sum(x / (1 + r) ** i for i, x in enumerate(flows))
    lo, hi = -0.9999, 10.0
    if value(lo) * value(hi) > 0:
        return None
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(lo) * value(mid) > 0 else (lo, mid)
    return (lo + hi) / 2


def xnpv(rate: Column, days: Column, flows: Column) -> Column:
    """Net present value of flows on days (numbers); years of 365 days from the first."""
    return _sum(F.zip_with(days, flows, lambda d, x: x / F.pow(1 + rate, (d - days[0]) / 365.0)))


def pmt(rate: Column, n: Column, pv: Column) -> Column:
    return F.when(rate == 0, -pv / n).otherwise(-pv * rate / (1 - F.pow(1 + rate, -n)))


def fv(rate: Column, n: Column, pmt: Column, pv: Column) -> Column:
    g = F.pow(1 + rate, n)
    return F.when(rate == 0, -(pv + pmt * n)).otherwise(-(pv * g + pmt * (g - 1) / rate))


def pv(rate: Column, n: Column, pmt: Column, fv: Column) -> Column:
    g = F.pow(1 + rate, n)
    return F.when(rate == 0, -(fv + pmt * n)).otherwise(-(fv + pmt * (g - 1) / rate) / g)


def compound_interest(principal: Column, rate: Column, n: Column, t: Column) -> Column:
    return principal * F.pow(1 + rate / n, n * t)


def depreciation_sl(cost: Column, salvage: Column, life: Column) -> Column:
    return (cost - salvage) / life


def depreciation_syd(cost: Column, salvage: Column, life: Column, period: Column) -> Column:
    return (cost - salvage) * (life - period + 1) / (life * (life + 1) / 2)


def bond_price(face: Column, coupon: Column, yield_rate: Column, periods: Column) -> Column:
    g = F.pow(1 + yield_rate, -periods)
    return F.when(yield_rate == 0, face + face * coupon * periods).otherwise(face * coupon * (1 - g) / yield_rate + face * g)


def amortization_schedule(principal: Column, rate: Column, periods: int) -> Column:
    """For each period (payment, principal part, interest part, balance), in closed form."""
    n = F.lit(float(periods))
    pay = -pmt(rate, n, principal)

    def row(k: Column) -> Column:
        g = F.pow(1 + rate, k - 1)
        before = principal * g - pay * (g - 1) / rate
        interest = before * rate
        return F.struct(pay.alias("payment"), (pay - interest).alias("principal"), interest.alias("interest"), (before - pay + interest).alias("balance"))

    return F.transform(F.sequence(F.lit(1), F.lit(periods)), row)


# ---- statistics of arrays


def mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def variance_pop(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: (x - mean(a)) * (x - mean(a)))) / F.size(a)


def variance_sample(a: Column) -> Column:
    return F.when(F.size(a) > 1, variance_pop(a) * F.size(a) / (F.size(a) - 1))


def stddev_pop(a: Column) -> Column:
    return F.sqrt(variance_pop(a))


def stddev_sample(a: Column) -> Column:
    return F.sqrt(variance_sample(a))


def _moment(a: Column, k: int) -> Column:
    return _sum(F.transform(a, lambda x: F.pow(x - mean(a), F.lit(float(k))))) / F.size(a)


def skewness(a: Column) -> Column:
    """Third central moment over the cube of the sample deviation."""
    return _moment(a, 3) / F.pow(stddev_sample(a), F.lit(3.0))


def kurtosis(a: Column) -> Column:
    """Fourth central moment over the fourth power of the sample deviation, less 3."""
    return _moment(a, 4) / F.pow(stddev_sample(a), F.lit(4.0)) - 3


def covariance(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: (a - mean(x)) * (b - mean(y)))) / (F.size(x) - 1)


def correlation(x: Column, y: Column) -> Column:
    return covariance(x, y) / (stddev_sample(x) * stddev_sample(y))


def percentile(a: Column, p: Column) -> Column:
    """Linear interpolation at p (n - 1)."""
    s = F.sort_array(a)
    at = p * (F.size(a) - 1)
    low = F.floor(at).cast("int")
    return F.element_at(s, low + 1) + (at - low) * (F.element_at(s, F.least(low + 2, F.size(a))) - F.element_at(s, low + 1))


def linear_regression(x: Column, y: Column) -> Column:
    slope = covariance(x, y) / variance_sample(x)
    r = correlation(x, y)
    return F.struct(slope.alias("slope"), (mean(y) - slope * mean(x)).alias("intercept"), (r * r).alias("r2"))


def moving_average(a: Column, n: int) -> Column:
    """Means of the last n values, of fewer at the start."""
    return F.transform(a, lambda x, i: mean(F.slice(a, F.greatest(i - (n - 2), F.lit(1)), F.least(i + 1, F.lit(n)))))


def exponential_smoothing(a: Column, alpha: float) -> Column:
    step = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(alpha * x + (1 - alpha) * F.element_at(acc, -1))))
    return F.aggregate(F.transform(a, lambda x: x.cast("double")), F.array().cast("array<double>"), lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(step(acc, x)))


def outlier_detect_zscore(a: Column, threshold: float) -> Column:
    sd = stddev_pop(a)
    return F.transform(a, lambda x: F.when(sd == 0, F.lit(False)).otherwise(F.abs((x - mean(a)) / sd) > threshold))


def outlier_detect_iqr(a: Column, factor: float) -> Column:
    q1, q3 = percentile(a, F.lit(0.25)), percentile(a, F.lit(0.75))
    return F.transform(a, lambda x: (x < q1 - factor * (q3 - q1)) | (x > q3 + factor * (q3 - q1)))


# ---- ratings and rate limits


def elo_expected(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def elo_update(rating: Column, expected: Column, actual: Column, k: Column) -> Column:
    return rating + k * (actual - expected)


def bayesian_average(avg: Column, count: Column, overall: Column, least: Column) -> Column:
    return (count * avg + least * overall) / (count + least)


def win_rate(wins: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(wins / total)


def wilson_score(positive: Column, total: Column, z: float = 1.959963984540054) -> Column:
    """The lower bound of the Wilson interval."""
    p = positive / total
    return F.when(total == 0, F.lit(0.0)).otherwise(
        (p + z * z / (2 * total) - z * F.sqrt((p * (1 - p) + z * z / (4 * total)) / total)) / (1 + z * z / total)
    )


@vectorized("array<double>")
def glicko2_update(rating, rd, volatility, opponents):
    """(rating, deviation, volatility) after games against (rating, deviation, score), system constant 0.5."""
    mu, phi, tau = (rating - 1500) / 173.7178, rd / 173.7178, 0.5
    if not len(opponents):
        return [rating, math.sqrt(phi * phi + volatility * volatility) * 173.7178, volatility]
    v = delta = 0.0
    for r, d, s in opponents:
        g = 1 / math.sqrt(1 + 3 * (d / 173.7178) ** 2 / math.pi**2)
        e = 1 / (1 + math.exp(-g * (mu - (r - 1500) / 173.7178)))
        v += g * g * e * (1 - e)
        delta += g * (s - e)
    v = 1 / v
    d2 = (v * delta) ** 2
    a = math.log(volatility**2)
    f = lambda x: math.exp(x) * (d2 - phi**2 - v - math.exp(x)) / (2 * (phi**2 + v + math.exp(x)) ** 2) - (x - a) / tau**2
    lo, hi = a, math.log(d2 - phi**2 - v) if d2 > phi**2 + v else a - tau
    while d2 <= phi**2 + v and f(hi) < 0:
        hi -= tau
    fl, fh = f(lo), f(hi)
    while abs(hi - lo) > 1e-6:
        mid = lo + (lo - hi) * fl / (fh - fl)
        fm = f(mid)
        if fm * fh <= 0:
            lo, fl = hi, fh
        else:
            fl /= 2
        hi, fh = mid, fm
    sigma = math.exp(lo / 2)
    phi = 1 / math.sqrt(1 / (phi**2 + sigma**2) + 1 / v)
    return [(mu + phi**2 * delta) * 173.7178 + 1500, phi * 173.7178, sigma]


def token_bucket_create(capacity: Column, per_second: Column) -> Column:
    return F.struct(capacity.alias("capacity"), per_second.alias("rate"), capacity.alias("tokens"), F.lit(0).cast("long").alias("at_ms"))


def token_bucket_available(bucket: Column, now_ms: Column) -> Column:
    return F.least(bucket["capacity"], bucket["tokens"] + bucket["rate"] * (now_ms - bucket["at_ms"]) / 1000.0)


def token_bucket_consume(bucket: Column, n: Column, now_ms: Column) -> Column:
    have = token_bucket_available(bucket, now_ms)
    left = F.when(have >= n, have - n).otherwise(have)
    return F.struct((have >= n).alias("allowed"), F.struct(bucket["capacity"].alias("capacity"), bucket["rate"].alias("rate"), left.alias("tokens"), now_ms.alias("at_ms")).alias("bucket"))


def sliding_window_count(times: Column, width: Column, now: Column) -> Column:
    """Times not before the window's start."""
    return F.size(F.filter(times, lambda t: t >= now - width))


def sliding_window_check(times: Column, width: Column, most: Column, now: Column) -> Column:
    return sliding_window_count(times, width, now) < most


def fixed_window_count(at: Column, width: Column) -> Column:
    """The number of the fixed window that holds the time."""
    return F.floor(at / width)


# ---- matrices: struct(rows, cols, data)


def matrix_create(rows: int, cols: int, data: Column) -> Column:
    return F.struct(F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), data.alias("data"))


def matrix_identity(n: int) -> Column:
    cells = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: F.when(i % (n + 1) == 0, 1.0).otherwise(0.0))
    return matrix_create(n, n, cells)


def _with(m: Column, data: Column) -> Column:
    return F.struct(m["rows"].alias("rows"), m["cols"].alias("cols"), data.alias("data"))


def matrix_add(a: Column, b: Column) -> Column:
    return _with(a, F.zip_with(a["data"], b["data"], lambda x, y: x + y))


def matrix_subtract(a: Column, b: Column) -> Column:
    return _with(a, F.zip_with(a["data"], b["data"], lambda x, y: x - y))


def matrix_scalar_multiply(a: Column, k: Column) -> Column:
    return _with(a, F.transform(a["data"], lambda x: x * k))


def matrix_transpose(m: Column) -> Column:
    at = F.sequence(F.lit(0), m["rows"] * m["cols"] - 1)
    data = F.transform(at, lambda i: F.element_at(m["data"], ((i % m["rows"]) * m["cols"] + F.floor(i / m["rows"])).cast("int") + 1))
    return F.struct(m["cols"].alias("rows"), m["rows"].alias("cols"), data.alias("data"))


def matrix_multiply(a: Column, b: Column) -> Column:
    at = F.sequence(F.lit(0), a["rows"] * b["cols"] - 1)

    def cell(i: Column) -> Column:
        r, c = F.floor(i / b["cols"]).cast("int"), i % b["cols"]
        each = F.transform(F.sequence(F.lit(0), a["cols"] - 1), lambda k: F.element_at(a["data"], r * a["cols"] + k + 1) * F.element_at(b["data"], k * b["cols"] + c + 1))
        return _sum(each)

    return F.struct(a["rows"].alias("rows"), b["cols"].alias("cols"), F.transform(at, cell).alias("data"))


def matrix_trace(m: Column) -> Column:
    return _sum(F.transform(F.sequence(F.lit(0), m["rows"] - 1), lambda i: F.element_at(m["data"], i * (m["cols"] + 1) + 1)))


def _matrix(rows, cols, data) -> np.ndarray:
    return np.asarray(data, float).reshape(rows, cols)


@vectorized("double")
def matrix_determinant(rows, cols, data):
    return float(np.linalg.det(_matrix(rows, cols, data)))


@vectorized("array<double>")
def matrix_inverse(rows, cols, data):
    """Row-major inverse; null for a singular matrix."""
    try:
        return np.linalg.inv(_matrix(rows, cols, data)).ravel().tolist()
    except np.linalg.LinAlgError:
        return None


@vectorized("array<double>")
def eigenvalues(rows, cols, data):
    """Real parts, descending."""
    return sorted(np.linalg.eigvals(_matrix(rows, cols, data)).real.tolist(), reverse=True)


@vectorized("array<double>")
def singular_values(rows, cols, data):
    return np.linalg.svd(_matrix(rows, cols, data), compute_uv=False).tolist()


def dot_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x * y).cast("double")))


def cross_product(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


# ---- points on the plane and the globe


def st_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def st_distance_sphere(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine metres."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.lit(2.0))
    a = a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return 2 * 6371008.8 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def st_area(ring: Column) -> Column:
    """Area of a closed ring, an array of (x, y)."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.abs(_sum(pairs)) / 2


def st_contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether the point is inside the closed ring, by crossings."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def crosses(e: Column) -> Column:
        px, py, qx, qy = e["p"][0], e["p"][1], e["q"][0], e["q"][1]
        return ((py > y) != (qy > y)) & (x < (qx - px) * (y - py) / F.nullif(qy - py, F.lit(0.0)) + px)

    return F.size(F.filter(pairs, crosses)) % 2 == 1


def geohash_cell(lon: Column, lat: Column, degrees: float) -> Column:
    """A grid cell: what a spatial join is partitioned and bucketed by."""
    return F.struct(F.floor(lon / degrees).alias("x"), F.floor(lat / degrees).alias("y"))


# ---- money: struct(minor, currency)

# Currencies whose minor unit is not a hundredth.
MINOR_DIGITS = {"JPY": 0, "KRW": 0, "VND": 0, "CLP": 0, "ISK": 0, "BHD": 3, "KWD": 3, "OMR": 3, "TND": 3, "JOD": 3}


def money_minor_digits(currency: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MINOR_DIGITS.items() for x in pair])
    return F.coalesce(table[currency], F.lit(2))


def money_create(amount: Column, currency: Column) -> Column:
    return F.struct(F.round(amount * F.pow(F.lit(10.0), money_minor_digits(currency))).cast("long").alias("minor"), currency.alias("currency"))


def _same(a: Column, b: Column, minor: Column) -> Column:
    good = F.when(a["currency"] == b["currency"], minor).otherwise(F.raise_error(F.lit("currencies differ")).cast("long"))
    return F.struct(good.alias("minor"), a["currency"].alias("currency"))


def money_add(a: Column, b: Column) -> Column:
    return _same(a, b, a["minor"] + b["minor"])


def money_subtract(a: Column, b: Column) -> Column:
    return _same(a, b, a["minor"] - b["minor"])


def money_multiply(a: Column, factor: Column) -> Column:
    return F.struct(F.round(a["minor"] * factor).cast("long").alias("minor"), a["currency"].alias("currency"))


def money_amount(a: Column) -> Column:
    return a["minor"] / F.pow(F.lit(10.0), money_minor_digits(a["currency"]))


# Unit -> dimension and factor to the base unit.
UNITS = {
    "m": ("length", 1.0), "km": ("length", 1000.0), "cm": ("length", 0.01), "mm": ("length", 0.001), "mi": ("length", 1609.344),
    "yd": ("length", 0.9144), "ft": ("length", 0.3048), "in": ("length", 0.0254), "kg": ("mass", 1.0), "g": ("mass", 0.001),
    "lb": ("mass", 0.45359237), "oz": ("mass", 0.028349523125), "s": ("time", 1.0), "min": ("time", 60.0), "h": ("time", 3600.0),
    "d": ("time", 86400.0), "l": ("volume", 0.001), "ml": ("volume", 0.000001), "gal": ("volume", 0.003785411784),
}


def convert_units(value: Column, a: str, b: str) -> Column:
    if UNITS[a][0] != UNITS[b][0]:
        raise ValueError(f"{a} and {b} are of different dimensions")
    return value * (UNITS[a][1] / UNITS[b][1])
