"""Special functions, distributions and small-matrix algebra as Arrow-batched UDFs over numpy."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_vector = lambda f: np.vectorize(f, otypes=[float])


def _lgamma(x: float) -> float:
    return math.inf if x <= 0 and x == int(x) else math.lgamma(x)


def _gamma(x: float) -> float:
    try:
        return math.gamma(x)
    except (ValueError, OverflowError):
        return math.inf


def gammainc(x: float, a: float) -> float:
    """Regularised lower incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    if math.isinf(x):
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return min(1.0, front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(0.0, 1 - front * h)


def betainc(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction, on the side where it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or 1e-300)
            c = 1 + k / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def _invert(cdf: Callable[[float], float], p: float, lo: float, hi: float) -> float:
    """Bisection to machine precision; the bracket widens until it holds p."""
    if not 0 <= p <= 1:
        return math.nan
    while math.isfinite(hi) and cdf(hi) < p and hi < 1e300:
        hi = hi * 2 + 1
    while cdf(lo) > p and lo > -1e300:
        lo = lo * 2 - 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def _normcdf(x, mu=0.0, sigma=1.0):
    return 0.5 * math.erfc(-(x - mu) / (sigma * math.sqrt(2)))


def _tcdf(t, v):
    tail = 0.5 * betainc(v / (v + t * t), v / 2, 0.5)
    return tail if t < 0 else 1 - tail


def _logchoose(n, k):
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _pmf(f):
    return lambda k, *p: f(k, *p) if k >= 0 and k == int(k) else 0.0


def _sum(f):
    return lambda k, *p: min(1.0, math.fsum(f(i, *p) for i in range(int(math.floor(k)) + 1))) if k >= 0 else 0.0


_binopdf = _pmf(lambda k, n, p: math.exp(_logchoose(n, k) + (k * math.log(p) if k else 0) + ((n - k) * math.log1p(-p) if n > k else 0)) if k <= n and 0 < p < 1 else float(k == (n if p >= 1 else 0)))
_poisspdf = _pmf(lambda k, m: math.exp(k * math.log(m) - m - math.lgamma(k + 1)) if m > 0 else float(k == 0))
_nbinpdf = _pmf(lambda k, r, p: math.exp(math.lgamma(k + r) - math.lgamma(k + 1) - math.lgamma(r) + r * math.log(p) + k * math.log1p(-p)))
_hygepdf = _pmf(lambda k, m, n, d: math.exp(_logchoose(n, k) + _logchoose(m - n, d - k) - _logchoose(m, d)) if k <= min(n, d) and d - k <= m - n else 0.0)

#: name: (pdf, cdf, mean, variance); parameters follow the argument.
FAMILIES: dict[str, tuple] = {
    "norm": (lambda x, m=0.0, s=1.0: math.exp(-(((x - m) / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi)), _normcdf, lambda m=0.0, s=1.0: (m, s * s)),
    "unif": (lambda x, a=0.0, b=1.0: 1 / (b - a) if a <= x <= b else 0.0, lambda x, a=0.0, b=1.0: min(1.0, max(0.0, (x - a) / (b - a))), lambda a=0.0, b=1.0: ((a + b) / 2, (b - a) ** 2 / 12)),
    "exp": (lambda x, m=1.0: math.exp(-x / m) / m if x >= 0 else 0.0, lambda x, m=1.0: -math.expm1(-x / m) if x > 0 else 0.0, lambda m=1.0: (m, m * m)),
    "gam": (lambda x, a, b=1.0: math.exp((a - 1) * math.log(x / b) - x / b - math.lgamma(a)) / b if x > 0 else 0.0, lambda x, a, b=1.0: gammainc(x / b, a), lambda a, b=1.0: (a * b, a * b * b)),
    "beta": (lambda x, a, b: math.exp((a - 1) * math.log(x) + (b - 1) * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) if 0 < x < 1 else 0.0, betainc, lambda a, b: (a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1)))),
    "chi2": (lambda x, v: math.exp((v / 2 - 1) * math.log(x / 2) - x / 2 - math.lgamma(v / 2)) / 2 if x > 0 else 0.0, lambda x, v: gammainc(x / 2, v / 2), lambda v: (v, 2 * v)),
    "t": (lambda t, v: math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - (v + 1) / 2 * math.log1p(t * t / v)) / math.sqrt(v * math.pi), _tcdf, lambda v: (0.0 if v > 1 else math.nan, v / (v - 2) if v > 2 else math.inf)),
    "f": (lambda x, a, b: math.exp(a / 2 * math.log(a / b) + (a / 2 - 1) * math.log(x) - (a + b) / 2 * math.log1p(a * x / b) + math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2)) if x > 0 else 0.0, lambda x, a, b: betainc(a * x / (a * x + b), a / 2, b / 2) if x > 0 else 0.0, lambda a, b: (b / (b - 2) if b > 2 else math.nan, 2 * b * b * (a + b - 2) / (a * (b - 2) ** 2 * (b - 4)) if b > 4 else math.nan)),
    "logn": (lambda x, m=0.0, s=1.0: math.exp(-(((math.log(x) - m) / s) ** 2) / 2) / (x * s * math.sqrt(2 * math.pi)) if x > 0 else 0.0, lambda x, m=0.0, s=1.0: _normcdf(math.log(x), m, s) if x > 0 else 0.0, lambda m=0.0, s=1.0: (math.exp(m + s * s / 2), math.expm1(s * s) * math.exp(2 * m + s * s))),
    "wbl": (lambda x, a=1.0, b=1.0: b / a * (x / a) ** (b - 1) * math.exp(-((x / a) ** b)) if x > 0 else 0.0, lambda x, a=1.0, b=1.0: -math.expm1(-((x / a) ** b)) if x > 0 else 0.0, lambda a=1.0, b=1.0: (a * math.gamma(1 + 1 / b), a * a * (math.gamma(1 + 2 / b) - math.gamma(1 + 1 / b) ** 2))),
    "bino": (_binopdf, _sum(_binopdf), lambda n, p: (n * p, n * p * (1 - p))),
    "bern": (_pmf(lambda k, p: p if k == 1 else 1 - p if k == 0 else 0.0), lambda k, p: 0.0 if k < 0 else 1 - p if k < 1 else 1.0, lambda p: (p, p * (1 - p))),
    "poiss": (_poisspdf, lambda k, m: 1 - gammainc(m, math.floor(k) + 1) if k >= 0 else 0.0, lambda m: (m, m)),
    "geo": (_pmf(lambda k, p: p * (1 - p) ** k), lambda k, p: 1 - (1 - p) ** (math.floor(k) + 1) if k >= 0 else 0.0, lambda p: ((1 - p) / p, (1 - p) / p**2)),
    "nbin": (_nbinpdf, lambda k, r, p: betainc(p, r, math.floor(k) + 1) if k >= 0 else 0.0, lambda r, p: (r * (1 - p) / p, r * (1 - p) / p**2)),
    "hyge": (_hygepdf, _sum(_hygepdf), lambda m, n, d: (d * n / m, d * n / m * (1 - n / m) * (m - d) / (m - 1))),
    "unid": (_pmf(lambda k, n: 1 / n if 1 <= k <= n else 0.0), lambda k, n: min(1.0, max(0.0, math.floor(k) / n)), lambda n: ((n + 1) / 2, (n * n - 1) / 12)),
}
_DISCRETE = ("bino", "bern", "poiss", "geo", "nbin", "hyge", "unid")


def _udf(f: Callable[[float], float], x: Column) -> Column:
    @pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([math.nan if v is None or v != v else f(v) for v in s], dtype=float)

    return run(x.cast("double"))


def pdf(family: str, x: Column, *p: float) -> Column:
    f = FAMILIES[family][0]
    return _udf(lambda v: f(v, *p), x)


def cdf(family: str, x: Column, *p: float) -> Column:
    f = FAMILIES[family][1]
    return _udf(lambda v: f(v, *p), x)


def support(family: str, *p: float) -> tuple[float, float]:
    """The least and the greatest value of a family, infinite where it has none."""
    if family in ("norm", "t"):
        return -math.inf, math.inf
    if family == "hyge":
        return max(0.0, p[1] + p[2] - p[0]), min(p[1], p[2])
    known = {"unif": p, "beta": (0.0, 1.0), "bern": (0.0, 1.0), "unid": (1.0, *p), "bino": (0.0, p[0])}
    return known.get(family, (0.0, math.inf))


def inv(family: str, q: Column, *p: float) -> Column:
    """The least value of the support whose cdf reaches q; the bounds of the support for 0 and 1."""
    f = FAMILIES[family][1]
    low, high = support(family, *p)
    ends = {0.0: low, 1.0: high}
    if family in _DISCRETE:

        def least(v: float) -> float:
            if v in ends:
                return ends[v]
            if not 0 <= v <= 1:
                return math.nan
            lo, hi = int(low) - 1, int(low) + 1
            while hi < min(high, 1 << 53) and f(hi, *p) < v:
                hi = int(min(2 * hi + 1, high))
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if f(mid, *p) >= v else (mid, hi)
            return float(hi)

        return _udf(least, q)
    positive = family not in ("norm", "t", "unif")
    return _udf(lambda v: ends[v] if v in ends else _invert(lambda x: f(x, *p), v, 0.0 if positive else -1.0, 1.0), q)


def stat(family: str, *p: float) -> tuple[float, float]:
    return FAMILIES[family][2](*p)


def fit_moments(family: str, mean: Column, var: Column) -> list[Column]:
    """Parameters of a family from a mean and variance (aggregates): norm, unif, exp, gam, beta, poiss, geo, bern."""
    common = mean * (1 - mean) / var - 1
    return {
        "norm": [mean, F.sqrt(var)], "exp": [mean], "poiss": [mean], "bern": [mean], "geo": [1 / (1 + mean)],
        "unif": [mean - F.sqrt(3 * var), mean + F.sqrt(3 * var)], "gam": [mean * mean / var, var / mean], "beta": [mean * common, (1 - mean) * common],
    }[family]


def erf(x: Column) -> Column:
    return _udf(math.erf, x)


def erfc(x: Column) -> Column:
    return _udf(math.erfc, x)


def erfinv(x: Column) -> Column:
    return _udf(lambda v: _invert(math.erf, v, -7.0, 7.0) if -1 < v < 1 and v >= 0 else -_invert(math.erf, -v, -7.0, 7.0) if -1 < v < 0 else math.copysign(math.inf, v) if abs(v) == 1 else math.nan, x)


def gamma(x: Column) -> Column:
    return _udf(_gamma, x)


def lgamma(x: Column) -> Column:
    return _udf(_lgamma, x)


def beta(a: Column, b: Column) -> Column:
    return F.exp(lgamma(a) + lgamma(b) - lgamma(a + b))


def factorial(n: Column) -> Column:
    return _udf(lambda v: float(math.factorial(int(v))) if 0 <= v <= 170 else math.nan, n)


def nchoosek(n: Column, k: int) -> Column:
    return _udf(lambda v: float(math.comb(int(v), k)), n)


def isprime(n: Column) -> Column:
    def test(v: float) -> float:
        n = int(v)
        return float(n > 1 and all(n % d for d in range(2, math.isqrt(n) + 1)))

    return _udf(test, n) == 1


def ellipke_of(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Complete elliptic integrals of the first and second kind of the parameter m = k^2, by arithmetic-geometric means."""
    m = np.asarray(m, float)
    if np.any(m > 1):
        raise ValueError("the parameter is 1 at most")
    a, b, weight, lost = np.ones_like(m), np.sqrt(1 - m), 0.5, m / 2
    for _ in range(40):
        a, b, c = (a + b) / 2, np.sqrt(a * b), ((a - b) / 2) ** 2
        weight *= 2
        lost = lost + weight * c
        if np.all(~(c > 1e-34)):
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        k = np.where(m == 1, np.inf, np.pi / (2 * a))
        return k, np.where(m == 1, 1.0, k * (1 - lost))


def ellipk(m: Column) -> Column:
    return pandas_udf(lambda s: pd.Series(ellipke_of(s.to_numpy(float))[0]), "double")(m.cast("double"))


def ellipe(m: Column) -> Column:
    return pandas_udf(lambda s: pd.Series(ellipke_of(s.to_numpy(float))[1]), "double")(m.cast("double"))


# The Bernoulli numbers of even index from 2 on
_BERNOULLI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6, -3617 / 510, 43867 / 798, -174611 / 330)


def zeta_of(s: np.ndarray) -> np.ndarray:
    """Riemann's zeta: a sum of 20 terms and Euler and Maclaurin's rest, below 0 by reflection. At 1 there is no value: an error."""
    s = np.asarray(s, float)
    if np.any(s == 1):
        raise ValueError("zeta has a pole at 1")
    t = np.where(s < 0, 1 - s, s)
    n, safe = 20, np.where(np.isfinite(t), t, 2.0)
    out = (np.arange(1, n)[:, None] ** -safe.reshape(1, -1)).sum(0).reshape(safe.shape) + n ** (1 - safe) / (safe - 1) + n**-safe / 2
    rising = safe * n ** (-safe - 1)
    for k, b in enumerate(_BERNOULLI, 1):
        out = out + b / math.factorial(2 * k) * rising
        rising = rising * (safe + 2 * k - 1) * (safe + 2 * k) / n**2
    out = np.where(np.isnan(t), np.nan, np.where(t == np.inf, 1.0, out))
    low = s < 0
    if low.any():
        gamma_ = np.array([math.gamma(v) if l and v < 171 else np.inf for v, l in zip(t.reshape(-1), low.reshape(-1), strict=True)]).reshape(t.shape)
        below = np.where(low, s, 0.0)
        wave = np.where(below % 2 == 0, 0.0, np.sin(np.pi * below / 2))
        with np.errstate(invalid="ignore"):
            out = np.where(low, np.where(wave == 0, 0.0, 2**below * np.pi ** (below - 1) * wave * gamma_ * out), out)
    return out


def zeta(s: Column) -> Column:
    return pandas_udf(lambda v: pd.Series(zeta_of(v.to_numpy(float))), "double")(s.cast("double"))


# matrices as array<array<double>>


def _matrix(f: Callable[[np.ndarray], object], kind: str) -> Callable[[Column], Column]:
    def run(s: pd.Series) -> pd.Series:
        out = []
        for m in s:
            try:
                r = f(np.array([list(x) for x in m], float))
            except np.linalg.LinAlgError:
                r = None
            out.append(r.tolist() if isinstance(r, np.ndarray) else None if r is None else float(r))
        return pd.Series(out)

    return lambda m: pandas_udf(run, kind)(m)


_M, _V, _S = "array<array<double>>", "array<double>", "double"
det = _matrix(np.linalg.det, _S)
inverse = _matrix(np.linalg.inv, _M)
pinv = _matrix(np.linalg.pinv, _M)
trace = _matrix(np.trace, _S)
matrix_rank = _matrix(np.linalg.matrix_rank, _S)
cond = _matrix(np.linalg.cond, _S)
chol = _matrix(np.linalg.cholesky, _M)
svdvals = _matrix(lambda a: np.linalg.svd(a, compute_uv=False), _V)
eig_symmetric = _matrix(np.linalg.eigvalsh, _V)
transpose = _matrix(lambda a: a.T, _M)
qr_r = _matrix(lambda a: np.linalg.qr(a)[1], _M)
triu = _matrix(np.triu, _M)
tril = _matrix(np.tril, _M)
null_space = _matrix(lambda a: (lambda u, s, v: v[(s > 1e-12 * s.max()).sum() :].T)(*np.linalg.svd(a)), _M)
frobenius = _matrix(np.linalg.norm, _S)


def expm_of(a: np.ndarray) -> np.ndarray:
    """Scaling and squaring of a Taylor series."""
    k = max(0, int(math.ceil(math.log2(max(1e-300, np.abs(a).sum(1).max())))) + 4)
    x = a / 2**k
    out = term = np.eye(len(a))
    for i in range(1, 19):
        term = term @ x / i
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


expm = _matrix(expm_of, _M)


def logm(a: Column) -> Column:
    """Principal logarithm; null where an eigenvalue on the closed negative axis leaves none."""
    from metrolith.operators.solve import logm as of

    def run(m: np.ndarray) -> np.ndarray | None:
        try:
            return of(m)
        except ValueError:
            return None

    return _matrix(run, _M)(a)


def schur(a: Column) -> Column:
    """The quasi-triangular factor of the real Schur form."""
    from metrolith.operators.solve import schur as of

    return _matrix(lambda m: of(m)[0], _M)(a)


def matmul(a: Column, b: Column) -> Column:
    """Product of matrix columns in the JVM, for small matrices."""
    row = lambda r: F.transform(F.sequence(F.lit(0), F.size(F.get(b, F.lit(0))) - 1), lambda j: F.aggregate(F.zip_with(r, b, lambda x, y: x * F.get(y, j)), F.lit(0.0), lambda s, v: s + v))
    return F.transform(a, row)
