"""Queries of exact sums, codes, special functions, searches, filters, image kernels and array files."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from metrolith.catalog import register
from metrolith.functions import codes, special
from metrolith.operators import control, image, learn, ml, signal, table
from metrolith.plans.physical_queries import _pixels
from metrolith.plans.table_queries import query, read, rounded
from metrolith.sources import files
from metrolith.streaming import streams


@query("table_exact_sum", "lineitem", "select cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) as total from lineitem")
def _(df):
    return df.sparkSession.range(1).select(F.round(F.lit(table.exact_sum(df, "l_extendedprice")), 2).alias("total"))


@query("special_zeta", "part", "select p_partkey, round(case p_size % 4 when 0 then pi() * pi() / 6 when 1 then pow(pi(), 4) / 90 when 2 then -1 / 12.0::double else -0.5 end, 10) as zeta from part")
def _(df):
    s = F.element_at(F.array(*[F.lit(v) for v in (2.0, 4.0, -1.0, 0.0)]), (F.col("p_size") % 4 + 1).cast("int"))
    return rounded(df.select("p_partkey", special.zeta(s).alias("zeta")), 10)


@query("special_elliptic", "part", "select p_partkey, round(pi() / 2, 8) as legendre from part")
def _(df):
    # Legendre's relation holds for every parameter
    m = F.col("p_size") / 60
    k, e, kc, ec = special.ellipk(m), special.ellipe(m), special.ellipk(1 - m), special.ellipe(1 - m)
    return rounded(df.select("p_partkey", (e * kc + ec * k - k * kc).alias("legendre")), 8)


@query("matrix_logarithm", "part", "select p_partkey, round(p_size / 100.0::double, 8) as a, 0.1::double as b, 0.2::double as c, round(-p_size / 200.0::double, 8) + 0.0 as d from part")
def _(df):
    size, at = F.col("p_size"), lambda i, j: F.col("m")[i][j]
    m = F.array(F.array(size / 100, F.lit(0.1).cast("double")), F.array(F.lit(0.2).cast("double"), -size / 200))
    return rounded(df.select("p_partkey", special.logm(special.expm(m)).alias("m")).select("p_partkey", at(0, 0).alias("a"), at(0, 1).alias("b"), at(1, 0).alias("c"), at(1, 1).alias("d")), 8)


@query("matrix_schur", "part", "select p_partkey, round(p_size / 10.0::double + 1, 8) as trace, round(p_size / 10.0::double - 0.06, 8) as det from part")
def _(df):
    t = F.col("t")
    m = F.array(F.array(F.col("p_size") / 10, F.lit(0.2).cast("double")), F.array(F.lit(0.3).cast("double"), F.lit(1.0)))
    return rounded(df.select("p_partkey", special.schur(m).alias("t")).select("p_partkey", (t[0][0] + t[1][1]).alias("trace"), (t[0][0] * t[1][1] - t[0][1] * t[1][0]).alias("det")), 8)


for _name, _to, _from in (("huffman", codes.huffman_encode, codes.huffman_decode), ("rans", codes.rans_encode, codes.rans_decode)):

    @query(f"code_{_name}", "part", "select p_partkey, p_name as text, cast(strlen(p_name) as bigint) as symbols from part")
    def _(df, to=_to, back=_from):
        return df.select("p_partkey", to(F.col("p_name")).alias("e")).select("p_partkey", back(F.col("e")).cast("string").alias("text"), F.col("e.symbol_count").alias("symbols"))


@register("npy_round_trip", "select row_number() over (order by o_orderkey) - 1 as i, o_totalprice as value from orders")
def _(spark, d):
    at = streams.shared_folder(spark).removeprefix("file:")
    os.makedirs(at)
    files.write_npy(read(spark, d, "orders"), f"{at}/orders.npy", "o_orderkey", "o_totalprice")
    return files.read_npy(spark, at).select("i", "value")


_FEATURES = ["l_discount", "l_linenumber", "l_quantity", "l_tax"]
_CORR = "abs(corr({0}, {1}))"


@query("ml_mrmr", "lineitem", "with s as (" + " union all ".join(
    f"select '{a}' as a, '{b}' as b, (abs(corr({a}, l_extendedprice)) + abs(corr({b}, l_extendedprice))) / 2 - abs(corr({a}, {b})) as v from lineitem"
    for i, a in enumerate(_FEATURES) for b in _FEATURES[i + 1 :]) + ") select arg_max(a, v) as a, arg_max(b, v) as b from s")
def _(df):
    a, b = learn.mrmr(df, _FEATURES, "l_extendedprice", 2)
    return df.sparkSession.range(1).select(F.lit(a).alias("a"), F.lit(b).alias("b"))


@query("ml_grid_search", "lineitem", """
    with t as (select name, q, l_extendedprice as y, l_orderkey % 3 as fold from (unpivot (select l_extendedprice, l_orderkey, l_discount::double as l_discount, l_quantity::double as l_quantity, l_tax::double as l_tax from lineitem)
               on l_discount, l_quantity, l_tax into name name value q)),
         r as (select name, a.f, regr_slope(y, q) filter (fold <> a.f) as s, regr_intercept(y, q) filter (fold <> a.f) as i, avg(y) filter (fold = a.f) as m from t, range(3) a(f) group by all),
         v as (select name, r.f, 1 - sum(pow(y - s * q - i, 2)) / sum(pow(y - m, 2)) as v from r join t using (name) where fold = r.f group by all)
    select arg_max(name, score) as best, round(max(score), 6) as score from (select name, avg(v) as score from v group by 1)""")
def _(df):
    got = learn.grid_search(df, lambda x: ml.linear_estimator([x], "l_extendedprice"), {"x": ["l_discount", "l_quantity", "l_tax"]}, F.pmod("l_orderkey", F.lit(3)), 3)
    return df.sparkSession.range(1).select(F.lit(got["best_params"]["x"]).alias("best"), F.round(F.lit(got["best_score"]), 6).alias("score"))


@query("ml_kmedians", "customer")
def _(df):
    centres = learn.kmedians(df, ["c_acctbal"], 3, 10)
    return rounded(learn.nearest_median(df, ["c_acctbal"], centres).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean")), 6)


@query("ml_kmedians_centre", "customer", "select round(quantile_cont(c_acctbal, 0.5), 6) as centre from customer")
def _(df):
    return df.sparkSession.range(1).select(F.round(F.lit(float(learn.kmedians(df, ["c_acctbal"], 1)[0, 0])), 6).alias("centre"))


def _arima(x: np.ndarray) -> dict[str, np.ndarray]:
    return {"y": learn.forecast(learn.arima(x, 1, 1, 0), 5)}


def _cqt(x: np.ndarray) -> dict[str, np.ndarray]:
    return signal.cqt(x, 1.0, 1 / 16, hop=16)


_ELLIPTIC = control.ellip(4, 1.0, 40.0, 0.3)
for _name, _kernel, _columns in (
    ("elliptic", signal.same(lambda x: signal.lfilter(_ELLIPTIC.num, _ELLIPTIC.den, x)), "y double"),
    ("equiripple", signal.same(lambda x: signal.lfilter(control.remez(31, [0, 0.3, 0.4, 1], [1, 0]), np.ones(1), x)), "y double"),
    ("vmd", lambda x: signal.vmd(x, 2, rounds=50), "mode bigint, i bigint, centre double, y double"),
    ("cqt", _cqt, "frame bigint, freq double, magnitude double"),
    ("arima", _arima, "y double"),
):
    query(f"signal_{_name}", "events")(lambda df, k=_kernel, c=_columns: rounded(signal.per_series(df, "user_id", ["ts", "event_id"], "value", k, c), 6))

query("image_canny", "lineitem")(lambda df: image.per_image(_pixels(df), lambda m: image.canny(m, 1.0, 3.0)))
query("image_clahe", "lineitem")(lambda df: image.per_image(_pixels(df), lambda m: image.clahe(m, 8)))


@query("image_watershed", "lineitem")
def _(df):
    return image.watershed(_pixels(df).withColumn("marker", F.when((F.col("y") % 12 == 6) & (F.col("x") % 12 == 6), F.col("y") * 24 + F.col("x")).otherwise(0)))
