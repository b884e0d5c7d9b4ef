"""Queries of the ordered-series verbs over events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrolith.operators import series as S
from metrolith.plans.table_queries import holed, query, rounded

ONE = S.Series(("user_id",), ("ts", "event_id"))
_W = "partition by user_id order by ts, event_id"


def column(name: str, sql: str, digits: int = 6, source: str = "events"):
    """Registers one window column over events, beside its SQL."""

    def put(f):
        query(f"series_{name}", "events", f"select event_id, {sql} as y from {source}")(lambda df: rounded(df.select("event_id", f(F.col("value")).alias("y")), digits))
        return f

    return put


def _frame(n):
    return f"over ({_W} rows between {n // 2} preceding and {n // 2} following)"


column("rolling_mean", f"round(avg(value) {_frame(5)}, 6)")(lambda x: S.rolling_mean(ONE, x, 5))
column("rolling_rms", f"round(sqrt(avg(value * value) {_frame(5)}), 6)")(lambda x: S.rolling_rms(ONE, x, 5))
column("rolling_std", f"round(coalesce(stddev_samp(value) {_frame(7)}, 0), 5)", 5)(lambda x: S.rolling_std(ONE, x, 7))
column("rolling_min", f"min(value) {_frame(5)}")(lambda x: S.rolling_min(ONE, x, 5))
column("rolling_max", f"max(value) {_frame(5)}")(lambda x: S.rolling_max(ONE, x, 5))
column("medfilt", f"round(median(value) {_frame(3)}, 6)")(lambda x: S.medfilt(ONE, x, 3))
column("cumsum", f"round(sum(value) over ({_W}), 4)", 4)(lambda x: S.cumsum(ONE, x))
column("diff", f"round(value - lag(value) over ({_W}), 6)")(lambda x: S.diff(ONE, x))
column("delay", f"coalesce(lag(value, 3) over ({_W}), 0)")(lambda x: S.delay(ONE, x, 3))
column("tkeo", f"round(value * value - lag(value) over ({_W}) * lead(value) over ({_W}), 4)", 4)(lambda x: S.tkeo(ONE, x))
column("gradient", f"round(case when lag(value) over ({_W}) is null then lead(value) over ({_W}) - value when lead(value) over ({_W}) is null then value - lag(value) over ({_W}) else (lead(value) over ({_W}) - lag(value) over ({_W})) / 2 end, 6)")(lambda x: S.gradient(ONE, x))
column("crossings", f"((lag(value) over ({_W}) < 50 and value >= 50) or (lag(value) over ({_W}) >= 50 and value < 50))")(lambda x: S.zero_crossings(ONE, x, 50.0))
column("rising_edges", f"(lag(value) over ({_W}) < 40 and value >= 40)")(lambda x: S.rising_edges(ONE, x, 40.0))
column("falling_edges", f"(lag(value) over ({_W}) >= 40 and value < 40)")(lambda x: S.falling_edges(ONE, x, 40.0))
column("peaks", f"(value > lag(value) over ({_W}) and value > lead(value) over ({_W}) and value >= 20)")(lambda x: S.is_peak(ONE, x, 20.0))
column("rank", f"row_number() over ({_W}) - 1")(lambda x: S.rank(ONE))
_FACTOR = "(1 + sin(event_id) / 10) * case when event_id % 3 = 0 then -1 else 1 end"
column("cumprod", f"round((case when sum(case when event_id % 3 = 0 then 1 else 0 end) over ({_W}) % 2 = 0 then 1 else -1 end) * exp(sum(ln(1 + sin(event_id) / 10)) over ({_W})), 6)")(lambda x: S.cumprod(ONE, F.expr(_FACTOR)))


@query("series_hampel", "events", f"""
    with a as (select event_id, value, list(value) {_frame(7)} as l, median(value) {_frame(7)} as m from events)
    select event_id, round(case when abs(value - m) > 3 * 1.4826 * list_median(list_transform(l, lambda v: abs(v - m))) then m else value end, 6) as y from a""".replace("list_median(", "list_aggregate(").replace("lambda v: abs(v - m))) then", "lambda v: abs(v - m)), 'median') then"))
def _(df):
    return rounded(df.select("event_id", S.hampel(ONE, F.col("value"), 7, 3.0).alias("y")), 6)


@query("series_trapz", "events", f"select user_id, round(coalesce(sum(a), 0), 2) as area from (select user_id, (epoch(ts) - lag(epoch(ts)) over ({_W})) * (value + lag(value) over ({_W})) / 2 as a from events) group by 1")
def _(df):
    from metrolith.plans.table_queries import seconds

    return rounded(S.trapz(df, ONE, seconds(), F.col("value")), 2)


@query("series_hysteresis_edges", "events", f"""
    with s as (select *, last_value(case when value >= 60 then 1 when value <= 30 then 0 end ignore nulls) over ({_W} rows unbounded preceding) as s from events)
    select event_id, case when s is null or lag(s) over ({_W}) is null then 0 else s - lag(s) over ({_W}) end as edge from s""")
def _(df):
    return S.edges(df, ONE, "value", 30.0, 60.0).select("event_id", "edge")


@query("series_pulses", "events", f"""
    with e as (select *, lag(value) over ({_W}) as p from events),
         m as (select user_id, ts, event_id, case when p < 50 and value >= 50 then 1 when p >= 50 and value < 50 then -1 end as e from e),
         n as (select user_id, event_id as s, e, lead(event_id) over ({_W}) as t, lead(e) over ({_W}) as f from m where e is not null)
    select user_id, s as start, t as "end", t - s as width from n where e = 1 and f = -1""")
def _(df):
    return S.find_pulses(df, ONE, "value", 50.0, F.col("event_id"))


@query("series_clipping_runs", "events", f"""
    with a as (select *, value >= 30 as f, coalesce(lag(value >= 30) over ({_W}), false) as g from events),
         b as (select *, sum(case when f and not g then 1 else 0 end) over ({_W}) as run from a)
    select user_id, run, count(*) as n, min(ts) as first, max(ts) as last from b where f group by 1, 2""")
def _(df):
    return S.runs(df, ONE, F.col("value") >= 30)


_HOLED = "(select *, case when event_id % 7 = 0 then null else value end as v, row_number() over (partition by user_id order by ts, event_id) as i from events)"
_AROUND = f"""(select *, last_value(v ignore nulls) over ({_W} rows unbounded preceding) as pv, last_value(case when v is not null then i end ignore nulls) over ({_W} rows unbounded preceding) as pi,
    first_value(v ignore nulls) over ({_W} rows between current row and unbounded following) as nv, first_value(case when v is not null then i end ignore nulls) over ({_W} rows between current row and unbounded following) as ni from {_HOLED})"""
_FILLS = {
    "previous": "pv", "next": "nv", "nearest": "case when ni is null or i - pi <= ni - i then pv else nv end",
    "linear": "case when ni is null then pv when pi is null or pi = ni then nv else pv + (i - pi) * (nv - pv) / (ni - pi) end",
    "mean": "coalesce(v, avg(v) over (partition by user_id))", "median": "coalesce(v, median(v) over (partition by user_id))", "value": "coalesce(v, -1)",
}
for _method, _sql in _FILLS.items():
    query(f"series_fill_{_method}", "events", f"select event_id, round({_sql}, 5) as value from {_AROUND}")(lambda df, m=_method: rounded(S.fill_missing(df.withColumn("value", holed()), ONE, "value", m, -1.0).select("event_id", "value"), 5))


@query("series_outliers_zscore", "events", "select event_id, coalesce(s > 0 and abs(value - m) > 2.5 * s, false) as outlier from (select *, avg(value) over (partition by event_type) as m, stddev_samp(value) over (partition by event_type) as s from events)")
def _(df):
    return S.outliers(df, ("event_type",), "value", "zscore", 2.5).select("event_id", "outlier")


@query("series_outliers_iqr", "events", "select event_id, value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a) as outlier from events join (select event_type, quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events group by 1) using (event_type)")
def _(df):
    return S.outliers(df, ("event_type",), "value", "iqr").select("event_id", "outlier")


@query("series_outliers_modified_zscore", "events", """
    with m as (select user_id, list_sort(list(value))[len(list(value)) // 2 + 1] as m from events group by 1),
         d as (select user_id, any_value(m) as m, list_sort(list(abs(value - m))) as d, avg(abs(value - m)) as ad from events join m using (user_id) group by 1),
         s as (select user_id, m, case when d[len(d) // 2 + 1] > 0 then d[len(d) // 2 + 1] / 0.6745 else ad * 1.253314 end as s from d)
    select event_id, s > 0 and abs(value - m) > 3.5 * s as outlier from events join s using (user_id)""")
def _(df):
    return S.outliers(df, ("user_id",), "value", "modified_zscore").select("event_id", "outlier")


@query("series_acf", "events", f"""
    with d as (select user_id, ts, event_id, value - avg(value) over (partition by user_id) as d from events),
         l as (select user_id, d * d as s0, d * lag(d, 1) over ({_W}) as s1, d * lag(d, 2) over ({_W}) as s2 from d),
         s as (select user_id, sum(s0) as s0, coalesce(sum(s1), 0) as s1, coalesce(sum(s2), 0) as s2 from l group by 1)
    select user_id, unnest([0, 1, 2]) as lag, round(unnest([case when s0 > 0 then 1.0::double end, case when s0 > 0 then s1 / s0 end, case when s0 > 0 then s2 / s0 end]), 6) as acf from s""")
def _(df):
    return rounded(S.acf(df, ONE, "value", 2), 6)


@query("series_block_means", "events", f"""
    with i as (select *, row_number() over ({_W}) - 1 as i from events)
    select user_id, b as block, count(*) as n, round(avg(value), 6) as mean from i, (select unnest(range(0, 1000)) as b) where i.i >= b * 10 and i.i < b * 10 + 20 group by 1, 2""")
def _(df):
    return S.blocks(df, ONE, 20, 10).groupBy("user_id", "block").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("series_session_windows", "events", f"""
    with g as (select *, case when ts - lag(ts) over ({_W}) < interval 6 hour then 0 else 1 end as b from events), s as (select *, sum(b) over ({_W}) as k from g)
    select user_id, min(ts) as start, count(*) as n, round(sum(value), 4) as total from s group by user_id, k""")
def _(df):
    return df.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", "start", "n", "total")


@query("series_tumbling_windows", "events", "select event_type, time_bucket(interval 1 day, ts) as day, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def _(df):
    return df.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).select("event_type", F.col("w.start").alias("day"), "n", "mean")


_Z = "(select *, coalesce(s > 0 and abs(value - m) > 1.5 * s, false) as bad from (select *, avg(value) over (partition by user_id) as m, stddev_samp(value) over (partition by user_id) as s from events))"


@query("series_remove_outliers", "events", f"select event_id, value from {_Z} where not bad")
def _(df):
    return S.remove_outliers(df, ("user_id",), "value", "zscore", 1.5).select("event_id", "value")


@query("series_replace_outliers", "events", f"select event_id, round(coalesce(last_value(case when not bad then value end ignore nulls) over ({_W} rows between unbounded preceding and current row)), 6) as value from {_Z}")
def _(df):
    return rounded(S.replace_outliers(df, ONE, "value", "zscore", 1.5, "previous").select("event_id", "value"), 6)


@query("series_fifo", "events", f"select event_id, list(value) over ({_W} rows between 3 preceding and current row) as fifo from events")
def _(df):
    return S.fifo(df, ONE, "value", 4).select("event_id", "fifo")
