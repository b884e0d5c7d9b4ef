"""More estimators. Fits are aggregates whose size depends on columns and classes alone; per-series models are kernels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.operators import ml, table


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision and recall at each distinct score, from counts by score."""
    c = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(label).cast("double")).alias("p"), F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("p").alias("t")).first()["t"] or 0.0
    c = table.prefix_sums(c.withColumn("down", -F.col("threshold")), "down", {"p": "hit", "n": "all"})
    return c.select("threshold", (F.col("hit") / F.col("all")).alias("precision"), (F.col("hit") / F.lit(float(total) or None)).alias("recall"))


def brier(df: DataFrame, label: str, probability: str) -> DataFrame:
    e = F.col(probability) - F.col(label)
    return df.agg(F.avg(e * e).alias("brier"))


def calibration(df: DataFrame, label: str, probability: str, bins: int = 10) -> DataFrame:
    b = F.least(F.lit(bins - 1), F.floor(F.col(probability) * bins))
    return df.groupBy(b.alias("bin")).agg(F.avg(probability).alias("mean_probability"), F.avg(label).alias("share"), F.count(F.lit(1)).alias("n"))


def conformal(df: DataFrame, residual: str, alpha: float = 0.1) -> float:
    """Half width that covers 1 - alpha of new residuals: the ceil((n + 1)(1 - alpha))-th smallest; infinite for too few."""
    n = df.count()
    k = math.ceil((n + 1) * (1 - alpha))
    if k > n:
        return math.inf
    return float(df.agg(F.expr(f"percentile_disc({(k - 0.5) / n}) within group (order by abs(`{residual}`))").alias("q")).first()["q"])


def stratified_split(df: DataFrame, label: str, part: float, *key: str, seed: int = 0) -> DataFrame:
    """A column `test`: in each class the given part of the rows, those of least hash."""
    # by class and cell of the hash: no task holds a class
    rows = df.withColumn("__h", F.xxhash64(F.lit(seed), *key)).withColumn("__cell", F.shiftright(F.col("__h"), 52))
    cells = rows.groupBy(label, "__cell").agg(F.count(F.lit(1)).alias("__n"))  # 4096 a class at most
    w = Window.partitionBy(label)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(F.col(label).alias("__label"), F.col("__cell").alias("__c"), (F.round(F.sum("__n").over(w) * part) - before).alias("__left"))
    joined = rows.join(cells, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__cell") == F.col("__c")))
    place = F.row_number().over(Window.partitionBy(label, "__cell").orderBy("__h", *key))
    return joined.withColumn("test", place <= F.col("__left")).drop("__h", "__cell", "__label", "__c", "__left")


def quantile_normalize(df: DataFrame, x: str) -> DataFrame:
    """Mean rank over (n - 1), from counts by value; one value alone is 0."""
    c = df.groupBy(x).agg(F.count(F.lit(1)).alias("__n"))
    n = df.count()
    c = table.prefix_sum(c, x, "__n", "__last")
    q = (F.col("__last") - (F.col("__n") + 1) / 2) / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)
    return df.join(c.select(x, q.alias("quantile")), x)


def class_moments(df: DataFrame, x: list[str], label: str) -> dict:
    """label -> (n, mean, scatter matrix), all in one aggregate by label."""
    k = len(x)
    want = [F.avg(c).alias(f"m{i}") for i, c in enumerate(x)] + [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    out = {}
    for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *want).collect():
        s = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) * r["n"]
        out[r[label]] = (r["n"], np.array([r[f"m{i}"] for i in range(k)]), s)
    return out


def _best(scores: dict) -> Column:
    top = F.greatest(*[F.struct(s.alias("s"), F.lit(-i).alias("i")) for i, s in enumerate(scores.values())])["i"] if len(scores) > 1 else F.lit(0)
    out = F.lit(None)
    for i, k in enumerate(scores):
        out = F.when(top == -i, F.lit(k)).otherwise(out)
    return out


def _quadratic(x: list[str], a: np.ndarray, b: np.ndarray, c: float) -> Column:
    """c + b x + x a x."""
    out = F.lit(float(c))
    for i, p in enumerate(x):
        out = out + F.lit(float(b[i])) * F.col(p)
        for j in range(i, len(x)):
            v = float(a[i, j] + (a[j, i] if j > i else 0))
            if v:
                out = out + F.lit(v) * F.col(p) * F.col(x[j])
    return out


def discriminant(df: DataFrame, x: list[str], label: str, kind: str = "lda") -> DataFrame:
    """`prediction` of normal classes: one covariance for all (lda) or one each (qda)."""
    m = dict(sorted(class_moments(df, x, label).items()))
    total = sum(n for n, _, _ in m.values())
    pooled = sum(s for _, _, s in m.values()) / max(1, total - len(m))
    scores = {}
    for k, (n, mean, s) in m.items():
        cov = pooled if kind == "lda" else s / max(1, n - 1)
        inv = np.linalg.pinv(cov)
        a = np.zeros_like(inv) if kind == "lda" else -inv / 2
        rest = math.log(n / total) - mean @ inv @ mean / 2 - (0 if kind == "lda" else np.linalg.slogdet(cov)[1] / 2)
        scores[k] = _quadratic(x, a, inv @ mean, rest)
    return df.withColumn("prediction", _best(scores))


def pls(df: DataFrame, x: list[str], y: str, parts: int = 2) -> np.ndarray:
    """Intercept and slopes of partial least squares, from centred cross products alone."""
    g, b = ml.gram(df, x, F.col(y))
    n, mean, ymean = g[0, 0], g[0, 1:] / g[0, 0], b[0] / g[0, 0]
    s, c = g[1:, 1:] - n * np.outer(mean, mean), b[1:] - n * mean * ymean
    w_all, p_all, q_all, small = [], [], [], 1e-12 * max(1.0, np.linalg.norm(c))
    for _ in range(min(parts, len(x))):
        if np.linalg.norm(c) < small:
            break
        w = c / np.linalg.norm(c)
        t = w @ s @ w
        p, q = s @ w / t, c @ w / t
        s, c = s - t * np.outer(p, p), c - p * q * t
        w_all.append(w)
        p_all.append(p)
        q_all.append(q)
    w, p = np.array(w_all).T, np.array(p_all).T
    coef = w @ np.linalg.solve(p.T @ w, np.array(q_all)) if w_all else np.zeros(len(x))
    return np.r_[ymean - mean @ coef, coef]


def whiten(df: DataFrame, x: list[str]) -> tuple[DataFrame, list[str], np.ndarray, np.ndarray]:
    """Columns z0.. of unit covariance; with the mean and the matrix."""
    mean, comp, value = ml.pca(df, x, len(x))
    m = comp / np.sqrt(value)[:, None]
    names = [f"z{i}" for i in range(len(x))]
    out = df
    for i, nme in enumerate(names):
        out = out.withColumn(nme, sum((F.lit(float(m[i, j])) * (F.col(c) - float(mean[j])) for j, c in enumerate(x)), F.lit(0.0)))
    return out, names, mean, m


def ica(df: DataFrame, x: list[str], rounds: int = 40, seed: int = 0) -> np.ndarray:
    """Rows that unmix the columns; each round of the fixed point is one aggregate (cubic contrast, symmetric)."""
    z, names, _, m = whiten(df.select(*x), x)
    k = len(x)
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((k, k)))[0]
    for _ in range(rounds):
        dots = [sum((F.lit(float(w[i, j])) * F.col(c) for j, c in enumerate(names)), F.lit(0.0)) for i in range(k)]
        r = z.agg(*[F.avg(F.col(c) * dots[i] * dots[i] * dots[i]).alias(f"e{i}_{j}") for i in range(k) for j, c in enumerate(names)]).first()
        new = np.array([[r[f"e{i}_{j}"] for j in range(k)] for i in range(k)]) - 3 * w
        u, _, vt = np.linalg.svd(new)
        new = u @ vt
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < 1e-9
        w = new
        if done:
            break
    return w @ m


def nmf(a: np.ndarray, k: int, rounds: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Factors without negative entries, by multiplicative steps."""
    g = np.random.default_rng(seed)
    w, h = g.random((a.shape[0], k)) + 0.1, g.random((k, a.shape[1])) + 0.1
    for _ in range(rounds):
        h *= (w.T @ a) / (w.T @ w @ h + 1e-12)
        w *= (a @ h.T) / (w @ h @ h.T + 1e-12)
    return w, h


def isolation_forest(df: DataFrame, x: list[str], trees: int = 50, sample: int = 256, seed: int = 0) -> DataFrame:
    """`anomaly` of 0 to 1: mean depth at which random cuts set a row apart.

    Each tree is grown on `sample` rows, a documented bound; all rows are scored.
    """
    n = df.count()
    part = min(1.0, 2.0 * trees * sample / max(1, n))
    u = F.pmod(F.xxhash64(F.lit(seed), *x), F.lit(1 << 30))
    data = df.select(*x).filter(u < int(part * (1 << 30))).limit(trees * sample).toPandas().to_numpy(float)
    g, size = np.random.default_rng(seed), min(sample, len(data))
    deep = max(1, math.ceil(math.log2(max(2, size))))
    path = lambda m: 2 * (math.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m if m > 2 else float(m == 2)

    def grow(d: np.ndarray, depth: int):
        j = int(g.integers(d.shape[1]))
        lo, hi = (d[:, j].min(), d[:, j].max()) if len(d) else (0.0, 0.0)
        if depth >= deep or len(d) < 2 or lo == hi:
            return depth + path(len(d))
        at = g.uniform(lo, hi)
        return j, at, grow(d[d[:, j] < at], depth + 1), grow(d[d[:, j] >= at], depth + 1)

    forest = [grow(data[g.choice(len(data), size, replace=False)], 0) for _ in range(trees)] if size else []

    def depth(tree, d: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(d), float(tree))
        j, at, left, right = tree
        out, low = np.empty(len(d)), d[:, j] < at
        out[low], out[~low] = depth(left, d[low]), depth(right, d[~low])
        return out

    def score(*cols: pd.Series) -> pd.Series:
        d = np.column_stack([c.to_numpy(float) for c in cols])
        return pd.Series(2.0 ** (-np.mean([depth(t, d) for t in forest], 0) / max(path(size), 1e-9)))

    return df.withColumn("anomaly", F.pandas_udf(score, "double")(*[F.col(c).cast("double") for c in x]))


# per-series models


def viterbi(obs: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Most likely states of observed symbols."""
    with np.errstate(divide="ignore"):
        s, m, e = np.log(start), np.log(move), np.log(emit)
    o = np.asarray(obs, int)
    v, back = s + e[:, o[0]], []
    for k in o[1:]:
        t = v[:, None] + m
        back.append(t.argmax(0))
        v = t.max(0) + e[:, k]
    out = [int(v.argmax())]
    for b in back[::-1]:
        out.append(int(b[out[-1]]))
    return np.array(out[::-1])


def hmm_likelihood(obs: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
    """Log likelihood by the scaled forward pass."""
    a, total = None, 0.0
    for k in np.asarray(obs, int):
        a = (start if a is None else a @ move) * emit[:, k]
        c = a.sum()
        total += math.log(c)
        a = a / c
    return total


def arma(x: np.ndarray, p: int = 2, q: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(constant and lags, error lags, residuals) by two regressions: a long one for the errors, then on lags and errors."""
    n, long = len(x), max(p, q) + max(3, min(20, len(x) // 10))
    if n <= 2 * long + p + q + 1:
        return np.full(p + 1, np.nan), np.full(q, np.nan), np.full(n, np.nan)
    lags = lambda v, k, lo: np.column_stack([v[lo - i : n - i] for i in range(1, k + 1)]) if k else np.empty((n - lo, 0))
    a = np.column_stack([np.ones(n - long), lags(x, long, long)])
    e = np.r_[np.zeros(long), x[long:] - a @ np.linalg.lstsq(a, x[long:], rcond=None)[0]]
    lo = long + max(p, q)
    b = np.column_stack([np.ones(n - lo), lags(x, p, lo), lags(e, q, lo)])
    c = np.linalg.lstsq(b, x[lo:], rcond=None)[0]
    return c[: p + 1], c[p + 1 :], np.r_[np.full(lo, np.nan), x[lo:] - b @ c]


def particle_filter(x: np.ndarray, q: float = 1.0, r: float = 1.0, particles: int = 500, seed: int = 0) -> np.ndarray:
    """Means of a random-walk state seen with noise; resampled by even steps through the weights."""
    g = np.random.default_rng(seed)
    p, out = x[0] + r * g.standard_normal(particles), np.empty(len(x))
    for i, v in enumerate(x):
        p = p + q * g.standard_normal(particles)
        w = np.exp(-0.5 * ((v - p) / r) ** 2 + 0.5 * (((v - p) / r) ** 2).min())
        w /= w.sum()
        out[i] = w @ p
        p = p[np.minimum(particles - 1, np.searchsorted(np.cumsum(w), (g.random() + np.arange(particles)) / particles))]
    return out


def arima(x: np.ndarray, p: int = 1, d: int = 0, q: int = 0) -> dict:
    """Differenced d times, then `arma`: ar, ma, mu (mean of the differences), residuals and what a forecast starts from."""
    levels, z = [], np.asarray(x, float)
    for _ in range(d):
        levels.append(z[-1] if len(z) else np.nan)
        z = np.diff(z)
    c, ma, e = arma(z, p, q)
    rest = 1 - c[1:].sum()
    return {"ar": c[1:], "ma": ma, "mu": float(c[0] / rest) if rest else float(c[0]), "constant": float(c[0]), "residuals": e, "history": z[len(z) - p :], "shocks": e[len(e) - q :], "levels": levels}


def forecast(model: dict, steps: int) -> np.ndarray:
    """Further values of a fitted `arima`, without shocks to come."""
    z, e = list(model["history"]), list(model["shocks"])
    out = []
    for _ in range(steps):
        v = model["constant"] + sum(a * z[-1 - i] for i, a in enumerate(model["ar"])) + sum(b * e[-1 - i] for i, b in enumerate(model["ma"]))
        z.append(v)
        e.append(0.0)
        out.append(v)
    y = np.array(out)
    for last in reversed(model["levels"]):
        y = last + np.cumsum(y)
    return y


def kmedians(df: DataFrame, x: list[str], k: int, iterations: int = 20, seed: int = 0) -> np.ndarray:
    """Centres of least summed distance along the axes: exact medians by column of the rows nearest to each, found by narrowing."""
    from metrolith.operators import ranks

    start = df.select(*x).distinct().orderBy(F.xxhash64(F.lit(seed), *x)).limit(k).collect()
    centres = np.array([[float(v) for v in r] for r in start])
    for _ in range(iterations):
        near, new = nearest_median(df, x, centres), centres.copy()
        for i in range(len(centres)):
            found = ranks.quantiles(near.filter(F.col("cluster") == i), x, [0.5])
            new[i] = [centres[i][j] if found[c][0] is None else float(found[c][0]) for j, c in enumerate(x)]
        if np.allclose(new, centres, atol=1e-12):
            break
        centres = new
    return centres


def nearest_median(df: DataFrame, x: list[str], centres: np.ndarray) -> DataFrame:
    """Adds `cluster`: the centre of least summed distance along the axes, the first of equals."""
    d = [sum((F.abs(F.col(c) - F.lit(float(v))) for c, v in zip(x, centre, strict=True)), F.lit(0.0)) for centre in centres]
    return df.withColumn("cluster", F.array_min(F.array(*[F.struct(e.alias("d"), F.lit(i).alias("i")) for i, e in enumerate(d)]))["i"])


def grid_search(df: DataFrame, make: Callable[..., ml.Estimator], grid: dict[str, list], fold: Column, folds: int = 5) -> dict:
    """Every combination scored on the same folds (`fold`: 0 to folds - 1 of a row); the last name varies fastest, the best is the first of equals."""
    import itertools

    combinations = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    if not 1 <= len(combinations) <= 10000:
        raise ValueError("1 to 10000 combinations")
    cut = df.withColumn("__fold", fold)
    results = []
    for params in combinations:
        scores = [make(**params).fit(cut.filter(F.col("__fold") != f).drop("__fold")).score(cut.filter(F.col("__fold") == f).drop("__fold")) for f in range(folds)]
        results.append({"params": params, "mean": float(np.mean(scores)), "std": float(np.std(scores))})
    best = max(range(len(results)), key=lambda i: (results[i]["mean"], -i))
    return {"best_params": results[best]["params"], "best_score": results[best]["mean"], "best_index": best, "results": results}


def mrmr(df: DataFrame, x: list[str], y: str, n: int) -> list[str]:
    """The n columns of greatest mean correlation with y less their mean correlation among each other (absolute values).

    One aggregate gives all correlations; a best-first search with the greatest further relevance as
    bound then finds the best set.
    """
    import heapq

    if not 1 <= n <= len(x):
        raise ValueError("1 to all columns")
    g, _ = ml.gram(df, [*x, y])
    m = g[1:, 1:] / g[0, 0] - np.outer(g[0, 1:], g[0, 1:]) / g[0, 0] ** 2
    s = np.sqrt(np.maximum(np.diag(m), 0))
    r = np.abs(m / np.where(np.outer(s, s) > 0, np.outer(s, s), np.inf))
    relevance, red, pairs = r[:-1, -1] / n, r[:-1, :-1], max(1, n * (n - 1) / 2)

    def bound(value: float, size: int, after: int) -> float:
        return value + float(np.sort(relevance[after:])[::-1][: n - size].sum())

    heap = [(-bound(0.0, 0, 0), (), 0.0)]
    while heap:
        _, chosen, value = heapq.heappop(heap)
        if len(chosen) == n:
            return [x[i] for i in chosen]
        first = chosen[-1] + 1 if chosen else 0
        for i in range(first, len(x) - (n - len(chosen)) + 1):
            v = value + float(relevance[i]) - sum(float(red[i, j]) for j in chosen) / pairs
            heapq.heappush(heap, (-bound(v, len(chosen) + 1, i + 1), (*chosen, i), v))
    raise AssertionError
