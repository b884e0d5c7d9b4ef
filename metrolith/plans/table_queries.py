"""Queries of the table verbs, joins, aggregates and sets, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.catalog import register
from metrolith.operators import table as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def seconds():
    """Seconds since 1970 of `ts`, whatever the session's time zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6


def query(name: str, source: str, sql: str | None = None):
    """Registers f(df) over one table."""

    def put(f):
        register(name, sql)(lambda spark, d: f(read(spark, d, source)))
        return f

    return put


@query("table_filter_group_sort", "lineitem", """
    select l_returnflag, round(avg(l_extendedprice), 4) as mean_l_extendedprice, round(stddev_pop(l_extendedprice), 4) as std_l_extendedprice,
           cast(count(*) as bigint) as count_l_extendedprice from lineitem where l_discount > 0.05 group by 1""")
def _(df):
    x = "l_extendedprice"
    out = T.group_by_agg(T.filter_mask(df, F.col("l_discount") > 0.05), "l_returnflag", [(x, "mean"), (x, "std"), (x, "count")])
    return T.sort_by(rounded(out), "l_returnflag")


@query("table_select_drop_insert", "part", "select p_partkey, p_size * 2 as double_size, p_name from part")
def _(df):
    return T.select(T.insert_column(T.drop(df, "p_brand", "p_type"), "double_size", F.col("p_size") * 2, 1), "p_partkey", "double_size", "p_name")


@query("table_group_all_aggregates", "lineitem", """
    select cast(l_linenumber as varchar) as l_linenumber, round(avg(l_quantity), 4) as mean_l_quantity, round(sum(l_quantity), 2) as sum_l_quantity,
           count(*) as count_l_quantity, min(l_quantity) as min_l_quantity, max(l_quantity) as max_l_quantity, round(stddev_pop(l_quantity), 4) as std_l_quantity,
           round(var_pop(l_quantity), 4) as var_l_quantity, median(l_quantity) as median_l_quantity from lineitem group by 1""")
def _(df):
    return rounded(T.group_by_agg(df, "l_linenumber", [("l_quantity", a) for a in ("mean", "sum", "count", "min", "max", "std", "var", "median")]))


@query("table_head", "orders", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def _(df):
    return df.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("table_tail", "orders", "select o_orderkey, o_totalprice from orders order by o_orderkey desc limit 15")
def _(df):
    return T.tail(df.select("o_orderkey", "o_totalprice"), 15, "o_orderkey")


@query("table_at", "customer", "select c_custkey, c_name from customer order by c_custkey limit 1 offset 41")
def _(df):
    return T.at(df.select("c_custkey", "c_name"), 41, "c_custkey")


@query("table_lookup", "orders", "select o_orderkey, o_custkey from orders where o_custkey = 7")
def _(df):
    return T.lookup(df.select("o_orderkey", "o_custkey"), "o_custkey", 7)


@query("table_sort_desc", "part", "select p_partkey, p_size from part order by p_size desc, p_partkey desc")
def _(df):
    return T.sort_by(df.select("p_partkey", "p_size"), "p_size", "p_partkey", descending=True)


@query("table_drop_row", "supplier", "select s_suppkey, case when s_suppkey > 5 then s_suppkey - 2 when s_suppkey > 3 then s_suppkey - 1 else s_suppkey end as pos from supplier where s_suppkey not in (3, 5)")
def _(df):
    return T.drop_row(df.select("s_suppkey", F.col("s_suppkey").alias("pos")), "pos", [3, 5])


@query("table_insert_row", "supplier", "select s_suppkey, case when s_suppkey >= 4 then s_suppkey + 1 else s_suppkey end as pos from supplier union all select -1, 4")
def _(df):
    row = df.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("s_suppkey"))
    return T.insert_row(df.select("s_suppkey", F.col("s_suppkey").alias("pos")), "pos", 4, row)


_DESCRIBE = "select '{c}' as \"column\", cast(count({c}) as double) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, cast(min({c}) as double) as min, round(quantile_cont({c}, 0.25), 4) as q25, round(quantile_cont({c}, 0.5), 4) as q50, round(quantile_cont({c}, 0.75), 4) as q75, cast(max({c}) as double) as max from lineitem"


@query("table_describe", "lineitem", " union all ".join(_DESCRIBE.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def _(df):
    return rounded(T.describe(df, "l_quantity", "l_extendedprice", "l_discount", "l_tax"))


_PAIRS = [(a, b) for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount")) for b in ("l_quantity", "l_extendedprice", "l_discount")[i:]]


@query("table_corr_matrix", "lineitem", " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as corr from lineitem" for a, b in _PAIRS))
def _(df):
    return rounded(T.corr_matrix(df, "l_quantity", "l_extendedprice", "l_discount"), 6)


@query("table_cov", "lineitem", "select round(covar_samp(l_quantity, l_extendedprice), 2) as cov, round(var_samp(l_quantity), 6) as var from lineitem")
def _(df):
    return df.agg(F.round(F.covar_samp("l_quantity", "l_extendedprice"), 2).alias("cov"), F.round(F.var_samp("l_quantity"), 6).alias("var"))


@query("table_unique", "part", "select distinct p_type from part order by 1")
def _(df):
    return T.unique(df, "p_type")


@query("table_distinct_first", "events", "select event_type, min(event_id) as first_pos from events group by 1")
def _(df):
    return T.distinct_first(df, "event_type", "event_id")


@query("table_mode", "lineitem", "select l_returnflag, arg_min(l_quantity, struct_pack(a := -n, b := l_quantity)) as mode_l_quantity, max(n) as n from (select l_returnflag, l_quantity, count(*) as n from lineitem group by all) group by 1")
def _(df):
    return T.mode(df, "l_quantity", "l_returnflag")


@query("table_histogram", "customer", """
    with r as (select min(c_acctbal) as lo, (max(c_acctbal) - min(c_acctbal)) / 12 as w from customer)
    select least(cast(floor((c_acctbal - lo) / w) as int), 11) as bin, round(min(lo + least(floor((c_acctbal - lo) / w), 11) * w), 6) as lo, count(*) as n from customer, r group by 1""")
def _(df):
    return rounded(T.histogram(df, "c_acctbal", 12), 6)


@query("table_ecdf", "part", "select p_size, round(sum(n) over (order by p_size) / sum(n) over (), 8) as p from (select p_size, count(*) as n from part group by 1)")
def _(df):
    return rounded(T.ecdf(df, "p_size"), 8)


@query("table_prefix_sum", "orders", "select o_orderkey, round(sum(o_totalprice) over (order by o_orderkey), 2) as total from orders")
def _(df):
    return rounded(T.prefix_sum(df.select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", "total").select("o_orderkey", "total"), 2)


@query("table_hourly_profile", "events", "select cast(floor((epoch(ts) % 86400) / 3600) as int) as bin, round(avg(value), 6) as mean_value, count(*) as n from events group by 1")
def _(df):
    return rounded(T.periodic_profile(df, seconds(), "value", 86400.0, 24), 6)


@query("table_weekly_profile_max", "events", "select cast(floor((epoch(ts) % 604800) / 86400) as int) as bin, max(value) as max_value, count(*) as n from events group by 1")
def _(df):
    return T.periodic_profile(df, seconds(), "value", 604800.0, 7, "max")


def holed():
    return F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))


@query("table_dropna", "events", "select event_id, value from events where event_id % 7 <> 0")
def _(df):
    return T.dropna(df.select("event_id", holed().alias("value")), "value")


@query("table_fillna", "events", "select event_id, case when event_id % 7 = 0 then 0.5 else value end as value from events")
def _(df):
    return T.fillna(df.select("event_id", holed().alias("value")), 0.5, "value")


@query("table_pivot", "orders", "select o_orderpriority, round(sum(case when o_orderstatus = 'F' then o_totalprice end), 2) as F, round(sum(case when o_orderstatus = 'O' then o_totalprice end), 2) as O, round(sum(case when o_orderstatus = 'P' then o_totalprice end), 2) as P from orders group by 1")
def _(df):
    return rounded(T.pivot(df, "o_orderpriority", "o_orderstatus", "o_totalprice", "sum", ["F", "O", "P"]), 2)


@query("table_unpivot", "lineitem", "select l_orderkey, l_linenumber, 'l_quantity' as variable, l_quantity as value from lineitem union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem")
def _(df):
    return T.unpivot(df.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])


@query("table_rollup", "orders", "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by rollup (1, 2)")
def _(df):
    return df.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("table_cube", "lineitem", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (1, 2)")
def _(df):
    return df.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("table_having", "lineitem", "select l_suppkey, round(sum(l_quantity), 2) as q from lineitem group by 1 having sum(l_quantity) > 500")
def _(df):
    return df.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("s")).filter("s > 500").select("l_suppkey", F.round("s", 2).alias("q"))


@query("table_moments", "lineitem", "select round(skew, 5) as skewness, round(kurt, 5) as kurtosis, round(rms, 5) as rms from (select avg((x - m) ^ 3) / pow(avg((x - m) ^ 2), 1.5) as skew, avg((x - m) ^ 4) / pow(avg((x - m) ^ 2), 2) as kurt, sqrt(avg(x * x)) as rms from (select l_extendedprice as x, (select avg(l_extendedprice) from lineitem) as m from lineitem))")
def _(df):
    x = "l_extendedprice"
    return df.agg(F.round(F.skewness(x), 5).alias("skewness"), F.round(F.kurtosis(x) + 3, 5).alias("kurtosis"), F.round(F.sqrt(F.avg(F.col(x) * F.col(x))), 5).alias("rms"))


@query("table_quantiles", "lineitem", "select l_shipmode_, quantile_cont(l_extendedprice, 0.1) as p10, quantile_cont(l_extendedprice, 0.9) as p90, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) as iqr from (select *, l_linestatus as l_shipmode_ from lineitem) group by 1".replace("quantile_cont(l_extendedprice, 0.1) as p10", "round(quantile_cont(l_extendedprice, 0.1), 4) as p10").replace("quantile_cont(l_extendedprice, 0.9) as p90", "round(quantile_cont(l_extendedprice, 0.9), 4) as p90").replace("quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) as iqr", "round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) as iqr").replace("l_shipmode_", "status"))
def _(df):
    x = F.col("l_extendedprice")
    q = lambda p: F.percentile(x, F.lit(p))
    return df.groupBy(F.col("l_linestatus").alias("status")).agg(F.round(q(0.1), 4).alias("p10"), F.round(q(0.9), 4).alias("p90"), F.round(q(0.75) - q(0.25), 4).alias("iqr"))


@query("table_where_conditional", "part", "select p_partkey, case when p_size > 25 then 'big' else 'small' end as kind, coalesce(nullif(p_brand, 'Brand#11'), 'none') as brand from part")
def _(df):
    return df.select("p_partkey", F.when(F.col("p_size") > 25, "big").otherwise("small").alias("kind"), F.coalesce(F.nullif("p_brand", F.lit("Brand#11")), F.lit("none")).alias("brand"))


# joins


@register("join_inner", "select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def _(spark, d):
    c = read(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    n = read(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return T.join(T.join(read(spark, d, "orders"), c, "o_custkey"), n, "c_nationkey").select("o_orderkey", "c_name", "n_name")


@register("join_left", "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by 1")
def _(spark, d):
    o = read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return T.join(read(spark, d, "customer"), o, "c_custkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@register("join_full", "select coalesce(a.k, b.k) as k, a.n as suppliers, b.n as customers from (select s_nationkey as k, count(*) as n from supplier group by 1) a full join (select c_nationkey as k, count(*) as n from customer where c_acctbal > 9000 group by 1) b on a.k = b.k")
def _(spark, d):
    a = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    b = read(spark, d, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    return T.join(a, b, "k", "full").select("k", "suppliers", "customers")


@register("join_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def _(spark, d):
    o = read(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return T.join(read(spark, d, "customer"), o, "c_custkey", "left_semi").select("c_custkey")


@register("join_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def _(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return T.join(read(spark, d, "customer"), o, "c_custkey", "left_anti").select("c_custkey")


@register("join_asof", "select a.event_id, b.value as last_purchase from (select * from events where event_type <> 'purchase') a asof left join (select user_id, ts, last(value order by event_id) as value from events where event_type = 'purchase' group by all) b on a.user_id = b.user_id and a.ts >= b.ts")
def _(spark, d):
    e = read(spark, d, "events")
    buys = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("last_purchase"))
    return T.asof_join(e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts"), buys, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@register("join_range", "select p_partkey, b.i as band from part join (select i, i * 100.0 as lo, i * 100.0 + 150 as hi from range(0, 30) t(i)) b on p_retailprice >= lo and p_retailprice < hi")
def _(spark, d):
    bands = spark.range(30).select(F.col("id").alias("band"), (F.col("id") * 100.0).alias("lo"), (F.col("id") * 100.0 + 150).alias("hi"))
    return T.range_join(read(spark, d, "part"), bands, "p_retailprice", "lo", "hi", 100.0).select("p_partkey", "band")


@register("join_interp1", """
    with k as (select user_id, event_id * 1.0 as x, value as y, lag(event_id * 1.0) over w as px, lag(value) over w as py, lead(event_id * 1.0) over w as nx, lead(value) over w as ny
               from events where event_id % 2 = 0 window w as (partition by user_id order by event_id)),
         q as (select user_id, event_id::double as q from events where event_id % 2 = 1)
    select q.user_id, q.q, round(case
        when a.x is null and b.x is null then null
        when a.x is null then case when b.nx is null then b.y else b.y + (q.q - b.x) * (b.ny - b.y) / (b.nx - b.x) end
        when b.x is null then case when a.px is null then a.y else a.y + (q.q - a.x) * (a.py - a.y) / (a.px - a.x) end
        else a.y + (q.q - a.x) * (b.y - a.y) / (b.x - a.x) end, 3) as y
    from q left join k a on a.user_id = q.user_id and a.x = (select max(x) from k where k.user_id = q.user_id and k.x <= q.q)
           left join k b on b.user_id = q.user_id and b.x = (select min(x) from k where k.user_id = q.user_id and k.x > q.q)""")
def _(spark, d):
    e = read(spark, d, "events").withColumn("x", F.col("event_id") * 1.0)
    return T.interp1(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1").withColumnRenamed("x", "q"), "user_id", "x", "value", "q").select("user_id", "q", F.round("value", 3).alias("y"))


# sets


@register("set_union", "select c_nationkey as k from customer union select s_nationkey from supplier")
def _(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, d, "supplier").select("s_nationkey")).distinct()


@register("set_intersect", "select c_nationkey as k from customer where c_acctbal < 0 intersect select s_nationkey from supplier")
def _(spark, d):
    return read(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).intersect(read(spark, d, "supplier").select("s_nationkey"))


@register("set_except", "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 5000")
def _(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(read(spark, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("table_lookup_default", "nation", "select n_name, case n_regionkey when 1 then 'west' when 2 then 'east' else 'other' end as side from nation")
def _(df):
    return T.dict_get(df, "n_regionkey", {1: "west", 2: "east", 77: "none"}, "other", "side").select("n_name", "side")


@query("table_group_first_seen", "orders", "select o_orderpriority, round(sum(o_totalprice), 2) as sum_o_totalprice from orders group by 1 order by min(o_orderkey)")
def _(df):
    return rounded(T.group_by_agg(df, "o_orderpriority", [("o_totalprice", "sum")], "o_orderkey"), 2)


@register("table_literal", "select * from (values (1, 'a'), (2, 'b'), (3, null)) t(k, v)")
def _(spark, d):
    return T.literal(spark, k=[1, 2, 3], v=["a", "b", None]).select(F.col("k").cast("int").alias("k"), "v")


@query("table_zip", "customer", "select c_custkey, list_zip(string_split(c_name, '#'), string_split(c_mktsegment, 'I')) as pairs from customer")
def _(df):
    # the pairs go by position, as SQL's do, so their members bear no names; a null is an empty list
    a, b = (F.coalesce(F.split(c, mark, -1), F.array().cast("array<string>")).alias(k) for k, c, mark in (("a", "c_name", "#"), ("b", "c_mktsegment", "I")))
    return df.select("c_custkey", F.transform(F.arrays_zip(a, b), lambda p: F.array(p["a"], p["b"])).alias("pairs"))
