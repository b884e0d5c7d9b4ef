"""Queries of further estimators, signal measures, control systems, networks, workbooks and text converters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from metrolith.catalog import register
from metrolith.operators import control, learn, measure, ml, nn, signal, solve
from metrolith.plans import checks_sql as C
from metrolith.plans.model_queries import _SCORED, _scored
from metrolith.plans.table_queries import query, read, rounded
from metrolith.sources import documents


@query("ml_pr_curve", "labels", f"""
    with c as (select s, sum(y)::double as p, count(*) as n from {_SCORED} group by 1)
    select round(s, 8) as threshold, round(sum(p) over w / sum(n) over w, 8) as precision, round(sum(p) over w / sum(p) over (), 8) as recall from c window w as (order by s desc)""")
def _(df):
    return rounded(learn.pr_curve(_scored(df), "y", "s"), 8)


@query("ml_brier", "labels", "select round(avg(pow(greatest(0, least(1, doc_id % 10 / 10.0::double)) - quality, 2)), 8) as brier from labels")
def _(df):
    return rounded(learn.brier(df.withColumn("p", F.col("doc_id") % 10 / F.lit(10.0)), "quality", "p"), 8)


@query("ml_calibration", "labels", "select doc_id % 10 as bin, round(avg((doc_id % 10 + 0.5) / 10.0), 8) as mean_probability, round(avg(quality), 8) as share, count(*) as n from labels group by 1")
def _(df):
    return rounded(learn.calibration(df.withColumn("p", (F.col("doc_id") % 10 + 0.5) / F.lit(10.0)), "quality", "p"), 8)


@query("ml_conformal", "orders", "select round(o_totalprice, 2) as width from (select o_totalprice, row_number() over (order by o_totalprice) as k, count(*) over () as n from orders) where k = ceil((n + 1) * 0.9)")
def _(df):
    return df.sparkSession.range(1).select(F.round(F.lit(learn.conformal(df, "o_totalprice", 0.1)), 2).alias("width"))


@query("ml_quantile_normalize", "orders", """
    select o_orderkey, round((rank() over (order by o_custkey) - 1 + (count(*) over (partition by o_custkey) - 1) / 2.0) / (count(*) over () - 1)::double, 8) as quantile from orders""")
def _(df):
    return rounded(learn.quantile_normalize(df.select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "quantile"), 8)


@query("ml_stratified_split", "orders", "select o_orderstatus, count(*) as n, cast(round(count(*) * 0.25) as bigint) as test from orders group by 1")
def _(df):
    s = learn.stratified_split(df, "o_orderstatus", 0.25, "o_orderkey")
    return s.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("test").cast("bigint")).alias("test"))


_X = ["l_quantity", "l_discount", "l_tax"]


def _priced(df):
    return df.select("l_orderkey", "l_linenumber", *_X, "l_extendedprice", F.when(F.col("l_extendedprice") > 40000, 1).otherwise(0).alias("y"))


for _kind in ("lda", "qda"):
    query(f"ml_{_kind}", "lineitem")(lambda df, k=_kind: learn.discriminant(_priced(df), _X, "y", k).select("l_orderkey", "l_linenumber", "prediction"))


@query("ml_isolation_forest", "lineitem")
def _(df):
    return rounded(learn.isolation_forest(_priced(df), _X).select("l_orderkey", "l_linenumber", "anomaly"), 8)


def _coefficients(df, names, values):
    return df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, values, strict=True)], "name string, value double")


@query("ml_pls", "lineitem", "select 'const' as name, round(regr_intercept(l_extendedprice, l_quantity), 2) as value from lineitem union all select 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 2) from lineitem")
def _(df):
    return rounded(_coefficients(df, ["const", "l_quantity"], learn.pls(df, ["l_quantity"], "l_extendedprice", 1)), 2)


@query("ml_ica", "lineitem")
def _(df):
    u = learn.ica(df, _X)
    return df.sparkSession.createDataFrame([(i, j, float(v)) for i, r in enumerate(u) for j, v in enumerate(r)], "i int, j int, v double")


for _name, _options in (("random_forest", {"numTrees": 5, "maxDepth": 4, "seed": 1}), ("gradient_boosting", {"maxIter": 3, "maxDepth": 3, "seed": 1}), ("svm", {"maxIter": 10}), ("mlp", {"layers": [3, 4, 2], "maxIter": 15, "seed": 1})):
    query(f"ml_{_name}", "lineitem")(lambda df, n=_name, o=_options: ml.spark_model(_priced(df), n, _X, "y", **o)[1].select("l_orderkey", "l_linenumber", "prediction"))
query("ml_gmm", "lineitem")(lambda df: ml.spark_model(_priced(df), "gmm", _X, "", k=2, maxIter=10, seed=1)[1].select("l_orderkey", "l_linenumber", "prediction"))


@query("nn_layer_norm_relu", "embeddings", C.LAYER_NORM)
def _(df):
    net = nn.sequential(nn.layer_norm, nn.relu)
    return nn.apply_network(df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), net, "embedding").select("vec_id", F.transform("output", lambda v: F.round(v, 6)).alias("output"))


@query("nn_trained_line", "lineitem")
def _(df):
    d = df.select((F.col("l_quantity") / 50).alias("q"), (F.col("l_extendedprice") / 1e5).alias("p"))
    line = lambda w, x, y: np.r_[2 * x.T @ (x @ w[:1] + w[1] - y), 2 * (x @ w[:1] + w[1] - y).sum()]
    return _coefficients(df, ["slope", "const"], nn.train(d, ["q"], "p", line, np.zeros(2), 10, "adam", lr=0.1))


def _levels(x: np.ndarray) -> dict[str, np.ndarray]:
    a, b = measure.overshoot(x)
    return {"rise": np.array([measure.transition_time(x)]), "fall": np.array([measure.transition_time(x, rising=False)]), "overshoot": np.array([a]), "undershoot": np.array([b])}


def _modes(x: np.ndarray) -> dict[str, np.ndarray]:
    m = measure.emd(x)
    return {"mode": np.repeat(np.arange(len(m)), len(x)), "at": np.tile(np.arange(len(x)), len(m)), "y": np.concatenate(m)}


def _decay(x: np.ndarray) -> dict[str, np.ndarray]:
    t = np.arange(len(x), dtype=float)
    return dict(zip(("level", "slope"), (np.array([v]) for v in solve.curve_fit(lambda t, a, b: a + b * t, t, x, [0.0, 0.0])), strict=True))


def _states(x: np.ndarray) -> dict[str, np.ndarray]:
    return {"state": learn.viterbi((x > np.median(x)).astype(int), np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[0.8, 0.2], [0.2, 0.8]]))}


_CHEBY, _BESSEL = control.cheby2(4, 40.0, 0.4), control.bessel(3, 0.3)
_LAG = control.c2d(control.tf([1.0], [4.0, 1.0]), 1.0)
for _name, _f, _columns in (
    ("tone", measure.tone, "freq double, snr double, sinad double, sfdr double, thd_n double, enob double"), ("pulses", measure.pulses, "width double, period double, frequency double, duty double, count double"),
    ("steps", _levels, "rise double, fall double, overshoot double, undershoot double"), ("emd", _modes, "mode bigint, at bigint, y double"), ("curve_fit", _decay, "level double, slope double"), ("viterbi", _states, "state bigint"),
    ("energy_frames", lambda x: {"y": measure.short_time_energy(x, 8)}, "y double"), ("instantaneous_phase", lambda x: {"y": np.angle(measure.hilbert(x))}, "y double"), ("resampled_3_2", lambda x: {"y": measure.resample(x, 3, 2)}, "y double"),
    ("cheby2", signal.same(lambda x: control.sosfilt(control.sos(_CHEBY), x)), "y double"), ("bessel", signal.same(lambda x: signal.lfilter(_BESSEL.num, _BESSEL.den, x)), "y double"), ("lag", signal.same(lambda x: control.lsim(_LAG, x, 1.0)), "y double"),
    ("firls", signal.same(lambda x: np.convolve(x, control.firls(15, [0, 0.3, 0.5, 1], [1, 1, 0, 0]))[: len(x)]), "y double"), ("lms", lambda x: {"y": measure.lms(x / (np.abs(x).max() or 1), np.roll(x, -1) / (np.abs(x).max() or 1), 4, 0.01)[0]}, "y double"),
    ("arma", lambda x: {"y": learn.arma(x, 1, 1)[2]}, "y double"), ("particle_filter", lambda x: {"y": learn.particle_filter(x, 1.0, 5.0, 200)}, "y double"),
):
    query(f"signal_{_name}", "events", C.SERIES.get(_name))(lambda df, k=_f, c=_columns: rounded(signal.per_series(df, "user_id", ["ts", "event_id"], "value", k, c), 6))


@register("control_step", C.STEP)
def _(spark, d):
    t = np.linspace(0, 10, 201)
    y = control.step(control.feedback(control.tf([4.0], [1.0, 1.0, 0.0])), t)
    return rounded(spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, y, strict=True)], "t double, y double"), 6)


@register("control_bode", "select i, round(-10 * log10(1 + pow(pow(10.0, i / 10.0 - 2), 2)), 6) as db, round(degrees(-atan(pow(10.0, i / 10.0 - 2))), 6) as phase from (select i from range(41) r(i))")
def _(spark, d):
    b = control.bode(control.tf([1.0], [1.0, 1.0]), 10.0 ** (np.arange(41) / 10 - 2))
    return rounded(spark.createDataFrame([(i, float(x), float(p)) for i, (x, p) in enumerate(zip(b["db"], b["phase"], strict=True))], "i bigint, db double, phase double"), 6)


@query("text_json_edited", "events", "select event_id, json_extract_string(props, '$.' || json_keys(props)[1]) as first_value, 'kg' as unit from events")
def _(df):
    from metrolith.functions import text as X

    e = df.select("event_id", documents.json_set("props", "meta.unit", "kg").alias("j"))
    return e.select("event_id", F.expr("get_json_object(j, concat('$.', json_object_keys(j)[0]))").alias("first_value"), X.json_get("j", "meta.unit").alias("unit"))


@query("text_converters", "region", "select r_regionkey, r_regionkey || ',' || r_name as csv, r_name as name, r_name as name2 from region")
def _(df):
    schema = "r_regionkey int, r_name string"
    j = df.select("r_regionkey", documents.to_json("r_regionkey", "r_name").alias("j"))
    j = j.withColumn("csv", documents.json2csv("j", schema)).withColumn("xml", documents.json2xml("j", schema))
    return j.select("r_regionkey", "csv", F.get_json_object(documents.csv2json("csv", schema), "$.r_name").alias("name"), F.get_json_object(documents.xml2json("xml", schema), "$.r_name").alias("name2"))
