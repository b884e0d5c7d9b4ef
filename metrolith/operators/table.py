"""Table verbs: DataFrame in, DataFrame out. Row order is a column or key that the caller names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from metrolith.operators.ranks import bounds, quantiles, range_of

AGGREGATES = ("mean", "sum", "count", "min", "max", "std", "median", "var", "first", "last")


def _need(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)}")


def select(df: DataFrame, *names: str) -> DataFrame:
    _need(df, *names)
    return df.select(*names)


def drop(df: DataFrame, *names: str) -> DataFrame:
    _need(df, *names)
    return df.drop(*names)


def filter_mask(df: DataFrame, mask: Column) -> DataFrame:
    return df.filter(mask)


def insert_column(df: DataFrame, name: str, value: Column, pos: int | None = None) -> DataFrame:
    names = [c for c in df.columns if c != name]
    names.insert(len(names) if pos is None else pos, name)
    return df.withColumn(name, value).select(*names)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def at(df: DataFrame, i: int, *order: str) -> DataFrame:
    """Row i, from 0; a top-(i + 1) selection rather than a global numbering."""
    return df.orderBy(*order).offset(i).limit(1)


def lookup(df: DataFrame, index: str, key) -> DataFrame:
    return df.filter(F.col(index) == F.lit(key))


def insert_row(df: DataFrame, pos: str, i: int, row: DataFrame) -> DataFrame:
    """The row at position i; those behind move on by one."""
    moved = df.withColumn(pos, F.when(F.col(pos) >= i, F.col(pos) + 1).otherwise(F.col(pos)))
    return moved.unionByName(row.withColumn(pos, F.lit(i).cast(df.schema[pos].dataType)))


def drop_row(df: DataFrame, pos: str, rows: list[int]) -> DataFrame:
    """Without the rows at these positions; those behind move up."""
    before = sum((F.when(F.col(pos) > i, 1).otherwise(0) for i in sorted(rows)), F.lit(0))
    return df.filter(~F.col(pos).isin(rows)).withColumn(pos, (F.col(pos) - before).cast(df.schema[pos].dataType))


def sort_by(df: DataFrame, key: str, *tie: str, descending: bool = False) -> DataFrame:
    """Stable ascending; descending is its reverse, ties included."""
    turn = F.desc_nulls_last if descending else F.asc_nulls_last
    return df.orderBy(turn(key), *[F.desc(t) if descending else F.asc(t) for t in tie])


def _aggregate(name: str, c: str) -> Column:
    x = F.col(c)
    real = F.when(~F.isnan(x.cast("double")), x)
    found = {
        "mean": F.avg(x), "sum": F.sum(x), "count": F.count(F.lit(1)), "std": F.stddev_pop(x), "var": F.var_pop(x), "median": F.median(x),
        "min": F.coalesce(F.min(real), F.lit(float("inf"))), "max": F.coalesce(F.max(real), F.lit(float("-inf"))),
        "first": F.first(x), "last": F.last(x),
    }
    if name not in found:
        raise ValueError(f"no aggregate {name}; there are {', '.join(AGGREGATES)}")
    return found[name]


def group_by_agg(df: DataFrame, key: str, specs: list[tuple[str, str]], pos: str | None = None) -> DataFrame:
    """One pass of (column, aggregate) pairs by key; the key is returned as text. std is the population's, NaN never wins min or max.

    With `pos`, a column of row positions, groups come in the order they are first seen.
    """
    if not specs:
        raise ValueError("no aggregates")
    _need(df, key, *[c for c, _ in specs])
    aggs = [_aggregate(a, c).alias(f"{a}_{c}") for c, a in specs]
    if pos is None:
        return df.groupBy(F.col(key).cast("string").alias(key)).agg(*aggs)
    return df.groupBy(F.col(key).cast("string").alias(key)).agg(*aggs, F.min(pos).alias("__first")).orderBy("__first").drop("__first")


def literal(spark, **columns: list) -> DataFrame:
    """A table from columns of one length; a shorter one is an error."""
    import pyarrow as pa

    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    return spark.createDataFrame(pa.table({k: pa.array(v) for k, v in columns.items()}))


def dict_get(df: DataFrame, key: str, entries: dict, default, name: str) -> DataFrame:
    """Adds the entry of a dictionary for each key, or the default: a join with the entries, which Spark sizes."""
    kind = df.schema[key].dataType.simpleString()
    made = df.sparkSession.createDataFrame([(k, v) for k, v in entries.items() if k is not None]).toDF("__k", "__v").select(F.col("__k").cast(kind), "__v")
    return df.join(made, F.col(key) == F.col("__k"), "left").withColumn(name, F.coalesce("__v", F.lit(default))).drop("__k", "__v")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def describe(df: DataFrame, *names: str) -> DataFrame:
    """One row per column: count, mean, std (N - 1), min, quartiles, max. Quartiles are exact, by `ranks.quantiles`."""
    names = names or tuple(numeric_columns(df))
    stats = {"count": lambda c: F.count(c).cast("double"), "mean": F.avg, "std": lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)), "min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double")}
    one = df.agg(*[f(F.col(c)).alias(f"{c}\x00{s}") for c in names for s, f in stats.items()]).first()
    q = quantiles(df, list(names), [0.25, 0.5, 0.75])
    rows = [(c, *(one[f"{c}\x00{s}"] for s in ("count", "mean", "std", "min")), *q[c], one[f"{c}\x00max"]) for c in names]
    return df.sparkSession.createDataFrame(rows, "column string, count double, mean double, std double, min double, q25 double, q50 double, q75 double, max double")


def corr_matrix(df: DataFrame, *names: str) -> DataFrame:
    """Pearson correlation of all pairs, in one aggregate: columns a, b, corr."""
    names = names or tuple(numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def unique(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).distinct().orderBy(c)


def distinct_first(df: DataFrame, c: str, pos: str) -> DataFrame:
    """Distinct values with the position each was first seen at."""
    return df.groupBy(c).agg(F.min(pos).alias("first_pos"))


def mode(df: DataFrame, c: str, *by: str) -> DataFrame:
    """Most frequent value, the smallest of ties: counted first, then reduced by a maximum."""
    counts = df.groupBy(*by, c).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.col(c), F.struct((-F.col("n")).alias("n"), F.col(c))).alias(f"mode_{c}")
    return counts.groupBy(*by).agg(best, F.max("n").alias("n")) if by else counts.agg(best, F.max("n").alias("n"))


def histogram(df: DataFrame, c: str, bins: int) -> DataFrame:
    """Equal-width bins from the least to the greatest value; both ends counted. The range is one small aggregate."""
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    if lo is None:
        return df.select(F.lit(0).alias("bin"), F.lit(0.0).alias("lo"), F.lit(0).cast("bigint").alias("n")).limit(0)
    width = (hi - lo) / bins or 1.0
    b = F.least(F.floor((F.col(c) - lo) / width), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(c).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("lo", F.lit(lo) + F.col("bin") * width).select("bin", "lo", "n")


def ecdf(df: DataFrame, c: str) -> DataFrame:
    """Share of rows not above each distinct value; only distinct values are ordered."""
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    return prefix_sum(counts, c, "n", "below").select(c, (F.col("below") / F.lit(max(1, total))).alias("p"))


def prefix_sums(df: DataFrame, order: str, values: dict[str, str], parts: int | None = None) -> DataFrame:
    """Global running sums (value column -> new column) without one global window: ranges, sums of ranges, then sums within each.

    The bounds of the ranges are fixed first, so the sums of ranges and the rows always agree.
    """
    cuts = bounds(df, order, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.withColumn("__part", range_of(df, order, cuts))
    sums = ranged.groupBy("__part").agg(*[F.sum(v).alias(f"__s{i}") for i, v in enumerate(values)])  # one row a range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__part", *[F.coalesce(F.sum(f"__s{i}").over(before), F.lit(0)).alias(f"__b{i}") for i, _ in enumerate(values)])
    w = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", *[F.sum(v).over(w).alias(f"__in{i}") for i, v in enumerate(values)]).join(F.broadcast(offsets), "__part")
    return out.select(*[f"`{c}`" for c in df.columns if c not in values.values()], *[(F.col(f"__in{i}") + F.col(f"__b{i}")).alias(n) for i, n in enumerate(values.values())])


def prefix_sum(df: DataFrame, order: str, value: str, name: str, parts: int | None = None) -> DataFrame:
    """One running sum, as prefix_sums."""
    return prefix_sums(df, order, {value: name}, parts)


def periodic_profile(df: DataFrame, seconds: Column, value: str, period: float, bins: int, agg: str = "mean") -> DataFrame:
    """Time folded by a period into bins, then aggregated."""
    b = F.floor(F.pmod(seconds, F.lit(period)) / F.lit(period / bins)).cast("int")
    return df.groupBy(F.least(b, F.lit(bins - 1)).alias("bin")).agg(_aggregate(agg, value).alias(f"{agg}_{value}"), F.count(F.lit(1)).alias("n"))


def dropna(df: DataFrame, *names: str) -> DataFrame:
    for c in names:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def fillna(df: DataFrame, value: float, *names: str) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(F.col(c)), F.lit(value)).otherwise(F.col(c)) for c in names})


def pivot(df: DataFrame, key: str, column: str, value: str, agg: str, values: list[str]) -> DataFrame:
    """One column for each listed value: conditional aggregates in one pass."""
    part = [_aggregate_if(agg, value, F.col(column) == v).alias(f"{v}") for v in values]
    return df.groupBy(key).agg(*part)


def _aggregate_if(agg: str, value: str, cond: Column) -> Column:
    x = F.when(cond, F.col(value))
    return {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}[agg](x)


def unpivot(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "variable", "value")


def join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Catalyst picks the strategy from sizes; no side is forced to be broadcast."""
    return left.join(right, on, how)


def interp1(knots: DataFrame, queries: DataFrame, key: str, x: str, y: str, q: str) -> DataFrame:
    """Linear interpolation of each query between the knots of its key; the end segments go on beyond the ends.

    Knots and queries are merged into one ordered stream by key, and the knots around each query
    are carried to it by windows: no range join, and rows are only ordered within a key.
    """
    a = knots.select(key, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), F.lit(0).alias("__kind"))
    b = queries.select(key, F.col(q).cast("double").alias("__x"), F.lit(None).cast("double").alias("__y"), F.lit(1).alias("__kind"))
    w = Window.partitionBy(key).orderBy("__x", "__kind")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    # each knot knows the one before and after it among knots
    kw = Window.partitionBy(key).orderBy("__x")
    ks = a.withColumns({"__p": F.lag(F.struct("__x", "__y")).over(kw), "__n": F.lead(F.struct("__x", "__y")).over(kw)})
    pack = F.when(F.col("__kind") == 0, F.struct("__x", "__y", "__p", "__n"))
    both = ks.unionByName(b.withColumns({"__p": F.lit(None).cast(ks.schema["__p"].dataType), "__n": F.lit(None).cast(ks.schema["__n"].dataType)})).withColumn("__k", pack)
    both = both.withColumns({"__lo": F.last("__k", ignorenulls=True).over(back), "__hi": F.first("__k", ignorenulls=True).over(ahead)})
    lo, hi = F.col("__lo"), F.col("__hi")
    x0 = F.coalesce(lo["__x"], hi["__x"])
    y0 = F.coalesce(lo["__y"], hi["__y"])
    x1 = F.when(lo.isNull(), hi["__n"]["__x"]).when(hi.isNull(), lo["__p"]["__x"]).otherwise(hi["__x"])
    y1 = F.when(lo.isNull(), hi["__n"]["__y"]).when(hi.isNull(), lo["__p"]["__y"]).otherwise(hi["__y"])
    value = F.when(x1.isNull() | (x1 == x0), y0).otherwise(y0 + (F.col("__x") - x0) * (y1 - y0) / F.nullif(x1 - x0, F.lit(0.0)))
    return both.withColumn("__v", value).filter("__kind = 1").select(key, F.col("__x").alias(q), F.col("__v").alias(y))


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each left row with the last right value at or before its time, by a merged ordered stream."""
    a = left.withColumns({"__kind": F.lit(1), "__v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(key, time, F.col(value).alias("__v"), F.lit(0).alias("__kind"))
    w = Window.partitionBy(key).orderBy(time, "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("__v", ignorenulls=True).over(w)).filter("__kind = 1").drop("__kind", "__v")


def range_join(points: DataFrame, ranges: DataFrame, x: str, lo: str, hi: str, width: float) -> DataFrame:
    """Points in [lo, hi): both sides are dealt to cells of `width`, so it is an equi-join with a check."""
    cells = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return points.withColumn("__cell", F.floor(F.col(x) / width)).join(cells, "__cell").filter((F.col(x) >= F.col(lo)) & (F.col(x) < F.col(hi))).drop("__cell")


def exact_sum(df: DataFrame, c: str) -> float:
    """The sum of a column rounded once, whatever the order of rows; nulls left out.

    A task keeps its sum as a few doubles that add up exactly; these, a handful a partition, reach the driver.
    """
    import math

    import pyarrow as pa

    def run(batches):
        parts: list[float] = []
        for batch in batches:
            x = batch.column(0).drop_null().to_pylist()
            if not all(map(math.isfinite, x)):
                parts.append(sum(v for v in x if not math.isfinite(v)))
                x = [v for v in x if math.isfinite(v)]
            odd = [v for v in parts if not math.isfinite(v)]
            x += [v for v in parts if math.isfinite(v)]
            parts = odd
            while r := math.fsum(x):
                parts.append(r)
                x.append(-r)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.float64())], names=["s"])

    got = [r["s"] for r in df.select(F.col(c).cast("double")).mapInArrow(run, "s double").collect()]
    odd = [v for v in got if not math.isfinite(v)]
    return sum(odd) if odd else math.fsum(got)
