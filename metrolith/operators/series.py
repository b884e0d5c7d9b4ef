"""Ordered series: every verb works on the rows of a key in a total order, by windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.functions.mathfn import let


@dataclass(frozen=True)
class Series:
    """How the rows of one series are told apart and ordered."""

    key: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def window(self):
        return Window.partitionBy(*self.key).orderBy(*self.order)

    def centred(self, n: int):
        if n < 1 or n % 2 == 0:
            raise ValueError("a centred window has an odd number of rows")
        return self.window.rowsBetween(-(n // 2), n // 2)

    @property
    def so_far(self):
        return self.window.rowsBetween(Window.unboundedPreceding, 0)


def rolling_mean(s: Series, x: Column, n: int = 5) -> Column:
    return F.avg(x).over(s.centred(n))


def rolling_rms(s: Series, x: Column, n: int = 5) -> Column:
    return F.sqrt(F.avg(x * x).over(s.centred(n)))


def rolling_std(s: Series, x: Column, n: int = 5) -> Column:
    return F.coalesce(F.stddev_samp(x).over(s.centred(n)), F.lit(0.0))


def rolling_min(s: Series, x: Column, n: int = 5) -> Column:
    return F.min(x).over(s.centred(n))


def rolling_max(s: Series, x: Column, n: int = 5) -> Column:
    return F.max(x).over(s.centred(n))


def _median(a: Column) -> Column:
    return let(F.array_sort(a), _middle)


def _middle(b: Column) -> Column:
    n = F.size(b)
    return F.when(n == 0, F.lit(None).cast("double")).otherwise((F.get(b, ((n - 1) / 2).cast("int")) + F.get(b, (n / 2).cast("int"))) / 2)


def medfilt(s: Series, x: Column, n: int = 3) -> Column:
    return _median(F.collect_list(x).over(s.centred(n)))


def hampel(s: Series, x: Column, n: int = 7, sigma: float = 3.0) -> Column:
    """The running median where x is further from it than sigma scaled median deviations, else x."""
    a = F.collect_list(x).over(s.centred(n))
    m = _median(a)
    mad = 1.4826 * let(m, lambda c: _median(F.transform(a, lambda v: F.abs(v - c))))
    return F.when(F.abs(x - m) > sigma * mad, m).otherwise(x)


def cumsum(s: Series, x: Column) -> Column:
    return F.sum(x).over(s.so_far)


def cumprod(s: Series, x: Column) -> Column:
    """Running product by logarithms of sizes and a count of signs; 0 from the first zero on."""
    w = s.so_far
    zero = F.max(F.when(x == 0, 1).otherwise(0)).over(w)
    sign = F.when(F.pmod(F.sum(F.when(x < 0, 1).otherwise(0)).over(w), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    size = F.exp(F.sum(F.when(x != 0, F.log(F.abs(x))).otherwise(0.0)).over(w))
    return F.when(zero == 1, F.lit(0.0)).otherwise(sign * size)


def diff(s: Series, x: Column) -> Column:
    return x - F.lag(x).over(s.window)


def delay(s: Series, x: Column, n: int = 1) -> Column:
    return F.coalesce(F.lag(x, n).over(s.window), F.lit(0.0))


def cumtrapz(s: Series, t: Column, x: Column) -> Column:
    area = (t - F.lag(t).over(s.window)) * (x + F.lag(x).over(s.window)) / 2
    return area  # summed by the caller over so_far: windows don't nest


def gradient(s: Series, x: Column, h: float = 1.0) -> Column:
    before, after = F.lag(x).over(s.window), F.lead(x).over(s.window)
    return F.when(before.isNull(), (after - x) / h).when(after.isNull(), (x - before) / h).otherwise((after - before) / (2 * h))


def tkeo(s: Series, x: Column) -> Column:
    return x * x - F.lag(x).over(s.window) * F.lead(x).over(s.window)


def trapz(df: DataFrame, s: Series, t: Column, x: Column, name: str = "area") -> DataFrame:
    parts = df.withColumn("__a", cumtrapz(s, t, x))
    return parts.groupBy(*s.key).agg(F.coalesce(F.sum("__a"), F.lit(0.0)).alias(name))


def zero_crossings(s: Series, x: Column, level: float = 0.0) -> Column:
    before = F.lag(x).over(s.window)
    return ((before < level) & (x >= level)) | ((before >= level) & (x < level))


def rising_edges(s: Series, x: Column, level: float) -> Column:
    return (F.lag(x).over(s.window) < level) & (x >= level)


def falling_edges(s: Series, x: Column, level: float) -> Column:
    return (F.lag(x).over(s.window) >= level) & (x < level)


def edges(df: DataFrame, s: Series, x: str, low: float, high: float) -> DataFrame:
    """Adds `edge`, 1 or -1 where the state with hysteresis turns high or low, else 0."""
    mark = F.when(F.col(x) >= high, 1).when(F.col(x) <= low, 0)
    state = df.withColumn("__s", F.last(mark, ignorenulls=True).over(s.so_far))
    before = F.lag("__s").over(s.window)
    return state.withColumn("edge", F.when(before.isNull() | F.col("__s").isNull(), 0).otherwise(F.col("__s") - before)).drop("__s")


def find_pulses(df: DataFrame, s: Series, x: str, level: float, time: Column) -> DataFrame:
    """Each rising edge with the falling edge after it and the time between."""
    rise, fall = rising_edges(s, F.col(x), level), falling_edges(s, F.col(x), level)
    marked = df.withColumns({"__t": time, "__e": F.when(rise, 1).when(fall, -1)}).filter("__e is not null")
    after = F.struct(F.lead("__e").over(s.window).alias("e"), F.lead("__t").over(s.window).alias("t"))
    return marked.withColumn("__n", after).filter("__e = 1 and __n.e = -1").select(*s.key, F.col("__t").alias("start"), F.col("__n.t").alias("end"), (F.col("__n.t") - F.col("__t")).alias("width"))


def runs(df: DataFrame, s: Series, flag: Column) -> DataFrame:
    """Runs of rows where flag holds: gaps and islands. key, run, n, first and last of the first order column."""
    start = F.when(flag & ~F.coalesce(F.lag(flag).over(s.window), F.lit(False)), 1).otherwise(0)
    numbered = df.withColumns({"__f": flag, "__b": start}).withColumn("run", F.sum("__b").over(s.so_far)).filter("__f")
    return numbered.groupBy(*s.key, "run").agg(F.count(F.lit(1)).alias("n"), F.min(s.order[0]).alias("first"), F.max(s.order[0]).alias("last"))


def is_peak(s: Series, x: Column, height: float | None = None) -> Column:
    p = (x > F.lag(x).over(s.window)) & (x > F.lead(x).over(s.window))
    return p & (x >= height) if height is not None else p


def rank(s: Series) -> Column:
    return F.row_number().over(s.window) - 1


def missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def fill_missing(df: DataFrame, s: Series, x: str, method: str = "linear", value: float | None = None) -> DataFrame:
    """x with missing values filled: linear (ends hold), previous, next, nearest (the earlier of ties), mean, median or a value."""
    w, back, ahead = s.window, s.so_far, s.window.rowsBetween(0, Window.unboundedFollowing)
    good = F.when(~missing(F.col(x)), F.col(x))
    if method == "value":
        return df.withColumn(x, F.coalesce(good, F.lit(value)))
    if method in ("mean", "median"):
        fill = df.groupBy(*s.key).agg((F.avg(good) if method == "mean" else F.median(good)).alias("__fill"))
        return df.join(fill, list(s.key)).withColumn(x, F.coalesce(good, F.col("__fill"))).drop("__fill")
    at = df.withColumn("__i", F.row_number().over(w))
    good = F.when(~missing(F.col(x)), F.struct(F.col("__i").alias("i"), F.col(x).alias("v")))
    at = at.withColumns({"__p": F.last(good, ignorenulls=True).over(back), "__n": F.first(good, ignorenulls=True).over(ahead)})
    p, n, i = F.col("__p"), F.col("__n"), F.col("__i")
    if method == "previous":
        out = p["v"]
    elif method == "next":
        out = n["v"]
    elif method == "nearest":
        out = F.when(n.isNull() | (i - p["i"] <= n["i"] - i), p["v"]).otherwise(n["v"])
    elif method == "linear":
        out = F.when(n.isNull(), p["v"]).when(p.isNull() | (p["i"] == n["i"]), n["v"]).otherwise(p["v"] + (i - p["i"]) * (n["v"] - p["v"]) / F.nullif(n["i"] - p["i"], F.lit(0)))
    else:
        raise ValueError(f"no method {method}")
    return at.withColumn(x, out).drop("__i", "__p", "__n")


def outliers(df: DataFrame, key: tuple[str, ...], x: str, method: str = "zscore", threshold: float | None = None) -> DataFrame:
    """Adds `outlier`: zscore (3, N - 1), modified_zscore (3.5) or iqr (1.5). NaN and constant series are never flagged.

    The statistics of a key are one aggregate, joined back; Spark broadcasts it only if it is small.
    """
    v = F.when(~missing(F.col(x)), F.col(x))
    if method == "zscore":
        stats = df.groupBy(*key).agg(F.avg(v).alias("__m"), F.stddev_samp(v).alias("__s"))
        flag = (F.col("__s") > 0) & (F.abs(v - F.col("__m")) > (threshold or 3.0) * F.col("__s"))
    elif method == "iqr":
        stats = df.groupBy(*key).agg(F.percentile(v, F.lit(0.25)).alias("__m"), F.percentile(v, F.lit(0.75)).alias("__s"))
        far = (threshold or 1.5) * (F.col("__s") - F.col("__m"))
        flag = (v < F.col("__m") - far) | (v > F.col("__s") + far)
    elif method == "modified_zscore":
        upper = lambda c: F.expr(f"percentile_disc(0.5) within group (order by {c} desc)")  # noqa: E731  of an even number the upper middle
        middle = df.withColumn("__v", v.cast("double")).groupBy(*key).agg(upper("__v").alias("__m"))
        far = df.join(middle, list(key)).withColumn("__d", F.abs(v - F.col("__m"))).groupBy(*key).agg(upper("__d").alias("__mad"), F.avg("__d").alias("__mean"))
        stats = middle.join(far, list(key)).select(*key, "__m", F.when(F.col("__mad") > 0, F.col("__mad") / 0.6745).otherwise(F.col("__mean") * 1.253314).alias("__s"))
        flag = (F.col("__s") > 0) & (F.abs(v - F.col("__m")) > (threshold or 3.5) * F.col("__s"))
    else:
        raise ValueError(f"no method {method}")
    return df.join(stats, list(key)).withColumn("outlier", F.coalesce(flag, F.lit(False))).drop("__m", "__s")


def remove_outliers(df: DataFrame, key: tuple[str, ...], x: str, method: str = "zscore", threshold: float | None = None) -> DataFrame:
    """Without the rows that `outliers` flags."""
    return outliers(df, key, x, method, threshold).filter("not outlier").drop("outlier")


def replace_outliers(df: DataFrame, s: Series, x: str, method: str = "zscore", threshold: float | None = None, fill: str = "linear", value: float | None = None) -> DataFrame:
    """Flagged values are taken as missing and filled from those that are left, as fill_missing does."""
    bad = outliers(df, s.key, x, method, threshold)
    return fill_missing(bad.withColumn(x, F.when(~F.col("outlier"), F.col(x))).drop("outlier"), s, x, fill, value)


def fifo(df: DataFrame, s: Series, x: str, size: int) -> DataFrame:
    """Adds `fifo`: the last `size` values, the oldest first, as a queue of that size holds them at each row."""
    return df.withColumn("fifo", F.collect_list(x).over(s.window.rowsBetween(1 - size, 0)))


def acf(df: DataFrame, s: Series, x: str, lags: int) -> DataFrame:
    """Autocorrelation by lag for each key, 1 at lag 0: one window pass, one aggregate."""
    mean = df.groupBy(*s.key).agg(F.avg(x).alias("__m"))
    d = df.join(mean, list(s.key)).withColumn("__d", F.col(x) - F.col("__m"))
    d = d.withColumns({f"__l{k}": F.col("__d") * F.lag("__d", k).over(s.window) for k in range(lags + 1)})
    one = d.groupBy(*s.key).agg(*[F.sum(f"__l{k}").alias(f"s{k}") for k in range(lags + 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.when(F.col("s0") > 0, F.coalesce(F.col(f"s{k}"), F.lit(0.0)) / F.col("s0")).alias("acf")) for k in range(lags + 1)])
    return one.select(*s.key, F.explode(rows).alias("r")).select(*s.key, "r.*")


def blocks(df: DataFrame, s: Series, n: int, hop: int | None = None) -> DataFrame:
    """Adds `block`: consecutive blocks of n rows, a row repeated for each block that holds it; the last may be short."""
    hop = hop or n
    i = df.withColumn("__i", F.row_number().over(s.window) - 1)
    first = F.greatest(F.lit(0), F.floor((F.col("__i") - n) / hop) + 1)
    return i.withColumn("block", F.explode(F.sequence(first, F.floor(F.col("__i") / hop)))).drop("__i")
