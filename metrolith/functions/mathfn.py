"""Scalar and array mathematics over Columns, with the edges of IEEE arithmetic rather than NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def div(a, b) -> Column:
    """IEEE division: signed infinities and NaN instead of an error."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when(a > 0, INF).when(a < 0, -INF).otherwise(NAN)


def mod(a, b) -> Column:
    """Sign of the divisor."""
    a, b = _c(a), _c(b)
    return F.when(b == 0, a).otherwise(a - b * F.floor(a / F.nullif(b, F.lit(0))))


def rem(a, b) -> Column:
    """Sign of the dividend; NaN for a zero divisor."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(b == 0, NAN).otherwise(a % F.nullif(b, F.lit(0.0)))


def sign(x) -> Column:
    """+1 at zero."""
    return F.when(_c(x) < 0, -1.0).otherwise(1.0)


def _log(f, x, low: float = 0.0) -> Column:
    x = _c(x).cast("double")
    return F.when(x > low, f(x)).when(x == low, -INF).otherwise(NAN)


def ln(x) -> Column:
    return _log(F.ln, x)


def log2(x) -> Column:
    return _log(F.log2, x)


def log10(x) -> Column:
    return _log(F.log10, x)


def log1p(x) -> Column:
    return _log(F.log1p, x, -1.0)


def sqrt(x) -> Column:
    return F.sqrt(_c(x))


def round_(x, digits: int = 0) -> Column:
    return F.round(_c(x), digits)


def fix(x) -> Column:
    x = _c(x)
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def maximum(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def minimum(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))


def clip(x, lo=None, hi=None) -> Column:
    x = _c(x)
    x = F.greatest(x, F.lit(lo)) if lo is not None else x
    return F.least(x, F.lit(hi)) if hi is not None else x


def where(c: Column, a, b) -> Column:
    return F.when(c, _c(a)).otherwise(_c(b))


def gcd(a, b) -> Column:
    """Euclid's steps on a bounded array of rounds; 64-bit operands need at most 92."""
    state = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(F.abs(_c(a).cast("bigint")).alias("a"), F.abs(_c(b).cast("bigint")).alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b"))))
    return state["a"]


def lcm(a, b) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("bigint")).otherwise(F.abs(_c(a).cast("bigint") / F.nullif(g, F.lit(0)) * _c(b).cast("bigint")).cast("bigint"))


def sec(x) -> Column:
    return 1 / F.cos(_c(x))


def coth(x) -> Column:
    return 1 / F.tanh(_c(x))


def sech(x) -> Column:
    return 1 / F.cosh(_c(x))


def csch(x) -> Column:
    return 1 / F.sinh(_c(x))


def exp2(x) -> Column:
    return F.pow(F.lit(2.0), _c(x))


def dbfs(x, full_scale: float = 1.0) -> Column:
    return 20 * log10(F.abs(_c(x)) / full_scale)


def db2mag(x) -> Column:
    return F.pow(F.lit(10.0), _c(x) / 20)


def mag2db(x) -> Column:
    return 20 * log10(x)


def db2pow(x) -> Column:
    return F.pow(F.lit(10.0), _c(x) / 10)


def pow2db(x) -> Column:
    return 10 * log10(x)


def bitcmp(x) -> Column:
    return F.bitwise_not(_c(x))


def bitshift(x, n: int) -> Column:
    return F.shiftleft(_c(x), n) if n >= 0 else F.shiftrightunsigned(_c(x), -n)


# arrays of doubles


def asum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)


def amean(a) -> Column:
    a = _c(a)
    return asum(a) / F.nullif(F.size(a), F.lit(0))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a, p: float = 2.0) -> Column:
    a = F.transform(_c(a), lambda x: F.abs(x.cast("double")))
    if p == INF:
        return F.array_max(a)
    if p == 1:
        return asum(a)
    if p == 2:
        return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    return F.pow(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(x, F.lit(p))), F.lit(1 / p))


def cosine(a, b) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def scale(a, k) -> Column:
    return F.transform(_c(a), lambda x: x * k)


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def let(value: Column, f) -> Column:
    """f of a value that is computed once; inside a lambda an outer expression is computed for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lse(a) -> Column:
    a = _c(a)
    return let(F.array_max(a), lambda m: m + F.ln(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - m))))


def softmax(a) -> Column:
    a = _c(a)
    shifted = let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m)))
    return let(shifted, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda t: F.transform(e, lambda x: x / t)))


def argmax(a) -> Column:
    a = _c(a)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a) -> Column:
    a = _c(a)
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def rms(a) -> Column:
    a = _c(a)
    return norm(a) / F.sqrt(F.size(a))


def crest_factor(a) -> Column:
    return norm(a, INF) / F.nullif(rms(a), F.lit(0.0))


def polyval(p: list[float], x) -> Column:
    """Highest power first, by Horner's rule."""
    x = _c(x)
    out = F.lit(0.0)
    for k in p:
        out = out * x + F.lit(float(k))
    return out


def conv(a, b) -> Column:
    a, b = _c(a), _c(b)
    n = F.size(a) + F.size(b) - 1
    at = lambda v, i: F.coalesce(F.when(i >= 0, F.get(v, i.cast("int"))), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.lit(0.0), lambda s, i: s + at(a, i) * at(b, k - i)))


def cumulative(a) -> Column:
    return F.aggregate(_c(a), F.array().cast("array<double>"), lambda s, x: F.concat(s, F.array(x + F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)))))


def unique(a) -> Column:
    return F.array_sort(F.array_distinct(_c(a)))


def take(a, n: int) -> Column:
    return F.slice(_c(a), 1, n)


def skip(a, n: int) -> Column:
    a = _c(a)
    return F.slice(a, F.lit(n + 1), F.greatest(F.size(a) - n, F.lit(0)))


def reverse(a) -> Column:
    return F.reverse(_c(a))


def first(a) -> Column:
    return F.try_element_at(_c(a), F.lit(1))


def last(a) -> Column:
    return F.try_element_at(_c(a), F.lit(-1))


def linspace(a: float, b: float, n: int) -> Column:
    return F.array(*[F.lit(a + (b - a) * i / max(1, n - 1)) for i in range(n)])


# complex numbers as struct<re, im>


def complex_(re, im) -> Column:
    return F.struct(_c(re).cast("double").alias("re"), _c(im).cast("double").alias("im"))


def cmul(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def cabs(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def angle(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def conj(a: Column) -> Column:
    return complex_(a["re"], -a["im"])


# densities of common families


def normpdf(x, mu=0.0, sigma=1.0) -> Column:
    z = (_c(x) - mu) / sigma
    return F.exp(-z * z / 2) / (sigma * math.sqrt(2 * math.pi))


def unifpdf(x, a=0.0, b=1.0) -> Column:
    return F.when((_c(x) >= a) & (_c(x) <= b), 1.0 / (b - a)).otherwise(0.0)


def unifcdf(x, a=0.0, b=1.0) -> Column:
    return clip((_c(x) - a) / (b - a), 0.0, 1.0)


def exppdf(x, mu=1.0) -> Column:
    return F.when(_c(x) < 0, 0.0).otherwise(F.exp(-_c(x) / mu) / mu)


def expcdf(x, mu=1.0) -> Column:
    return F.when(_c(x) < 0, 0.0).otherwise(1 - F.exp(-_c(x) / mu))


def expinv(p, mu=1.0) -> Column:
    return -mu * log1p(-_c(p))


def wblcdf(x, a=1.0, b=1.0) -> Column:
    return F.when(_c(x) < 0, 0.0).otherwise(1 - F.exp(-F.pow(_c(x) / a, F.lit(b))))


def wblpdf(x, a=1.0, b=1.0) -> Column:
    x = _c(x)
    return F.when(x < 0, 0.0).otherwise(b / a * F.pow(x / a, F.lit(b - 1)) * F.exp(-F.pow(x / a, F.lit(b))))


def lognpdf(x, mu=0.0, sigma=1.0) -> Column:
    x = _c(x)
    return F.when(x <= 0, 0.0).otherwise(normpdf(F.ln(x), mu, sigma) / F.nullif(x, F.lit(0.0)))


def geopdf(k, p: float) -> Column:
    return F.when(_c(k) < 0, 0.0).otherwise(p * F.pow(F.lit(1 - p), _c(k)))


def geocdf(k, p: float) -> Column:
    return F.when(_c(k) < 0, 0.0).otherwise(1 - F.pow(F.lit(1 - p), F.floor(_c(k)) + 1))


def berncdf(k, p: float) -> Column:
    return F.when(_c(k) < 0, 0.0).when(_c(k) < 1, 1 - p).otherwise(1.0)
