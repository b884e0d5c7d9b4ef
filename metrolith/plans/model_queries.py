"""Queries of estimators, evaluation, sparse algebra, graphs, signals and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrolith.catalog import register
from metrolith.operators import image, ml, signal, sparse
from metrolith.plans import checks_sql as C
from metrolith.plans.table_queries import query, read, rounded
from metrolith.streaming import streams


def predicted(df):
    return df.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000).alias("p"))


@query("ml_regression_scores", "lineitem", "select round(avg(abs(e)), 3) as mae, round(avg(e * e), 1) as mse, round(sqrt(avg(e * e)), 3) as rmse, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) as r2 from (select l_extendedprice as y, l_extendedprice - l_quantity * 2000 as e from lineitem)")
def _(df):
    r = ml.regression_scores(predicted(df), "y", "p")
    return r.select(F.round("mae", 3).alias("mae"), F.round("mse", 1).alias("mse"), F.round("rmse", 3).alias("rmse"), F.round("r2", 6).alias("r2"))


_CLASS = "(select doc_id, quality as a, case when doc_id % 5 = 0 then 1 - quality else quality end as p from labels)"


def _classes(df):
    return df.select("doc_id", F.col("quality").alias("a"), F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("p"))


@query("ml_confusion_matrix", "labels", f"select a as actual, p as predicted, count(*) as n from {_CLASS} group by 1, 2")
def _(df):
    return ml.confusion_matrix(_classes(df), "a", "p")


@query("ml_classification_scores", "labels", f"""
    with m as (select a, p, count(*) as n from {_CLASS} group by 1, 2), r as (select a as l, sum(case when a = p then n else 0 end) as h, sum(n) as t from m group by 1), q as (select p as l, sum(case when a = p then n else 0 end) as h, sum(n) as t from m group by 1),
         b as (select r.h, r.t, coalesce(q.h / q.t, 0) as p, r.h / r.t as r from r left join q using (l))
    select round(avg(p), 8) as precision, round(avg(r), 8) as recall, round(avg(case when p + r > 0 then 2 * p * r / (p + r) else 0 end), 8) as f1, round(sum(h) / sum(t), 8) as accuracy from b""")
def _(df):
    return rounded(ml.classification_scores(_classes(df), "a", "p"), 8)


_SCORED = "(select quality as y, (doc_id * 7919 % 101) / 101.0 + quality * 0.3 as s from labels)"


def _scored(df):
    return df.select(F.col("quality").alias("y"), ((F.col("doc_id") * 7919 % 101) / F.lit(101.0) + F.col("quality") * 0.3).alias("s"))


@query("ml_auc", "labels", f"select round(sum(case when a.s > b.s then 1.0 when a.s = b.s then 0.5 else 0 end) / count(*), 8) as auc from {_SCORED} a, {_SCORED} b where a.y = 1 and b.y = 0")
def _(df):
    return rounded(ml.auc(_scored(df), "y", "s"), 8)


@query("ml_scaler_standard", "customer", "select c_custkey, round((c_acctbal - avg(c_acctbal) over ()) / stddev_samp(c_acctbal) over (), 6) as c_acctbal from customer")
def _(df):
    return rounded(ml.scaler(df, ["c_acctbal"]).select("c_custkey", "c_acctbal"), 6)


@query("ml_scaler_minmax", "customer", "select c_custkey, round((c_acctbal - min(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ()), 6) as c_acctbal from customer")
def _(df):
    return rounded(ml.scaler(df, ["c_acctbal"], "minmax").select("c_custkey", "c_acctbal"), 6)


@query("ml_scaler_robust", "customer", "select c_custkey, round((c_acctbal - median(c_acctbal) over ()) / (select quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) from customer), 6) as c_acctbal from customer")
def _(df):
    return rounded(ml.scaler(df, ["c_acctbal"], "robust").select("c_custkey", "c_acctbal"), 6)


@query("ml_k_fold", "customer")
def _(df):
    return ml.k_fold(df, 5, "c_nationkey").select("c_custkey", "fold")


@query("ml_ols", "lineitem", "select round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_slope(l_extendedprice, l_quantity), 4) as slope from lineitem")
def _(df):
    c = ml.ols(df, ["l_quantity"], "l_extendedprice")
    return df.sparkSession.createDataFrame([(round(float(c[0]), 3), round(float(c[1]), 4))], "intercept double, slope double")


@query("ml_ridge", "lineitem", C.RIDGE)
def _(df):
    return rounded(df.sparkSession.createDataFrame([tuple(float(v) for v in ml.ols(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 1.0))], "b0 double, b1 double, b2 double, b3 double"))


@query("ml_polyfit", "part", C.POLYFIT)
def _(df):
    return rounded(df.sparkSession.createDataFrame([tuple(float(v) for v in ml.polyfit(df, "p_size", "p_retailprice", 2))], "a double, b double, c double"))


@query("ml_logistic", "lineitem")
def _(df):
    x = df.withColumns({"q": F.col("l_quantity") / 50, "y": (F.col("l_extendedprice") > 40000).cast("double")})
    return df.sparkSession.createDataFrame([tuple(float(v) for v in ml.logistic(x, ["q", "l_discount"], "y"))], "b0 double, b1 double, b2 double")


@query("ml_pca", "lineitem")
def _(df):
    _, comp, var = ml.pca(df, ["l_quantity", "l_discount", "l_tax"], 2)
    return df.sparkSession.createDataFrame([(i, float(v), [float(x) for x in c]) for i, (v, c) in enumerate(zip(var, comp, strict=True))], "i int, variance double, component array<double>")


@query("ml_naive_bayes", "lineitem", "select l_returnflag, count(*) as n, round(avg(l_quantity), 4) as mean_l_quantity, round(avg(l_tax), 4) as mean_l_tax, round(var_pop(l_quantity), 4) as var_l_quantity, round(var_pop(l_tax), 4) as var_l_tax from lineitem group by 1")
def _(df):
    return rounded(ml.naive_bayes(df, ["l_quantity", "l_tax"], "l_returnflag"))


@query("ml_kmeans", "part")
def _(df):
    x = ["p_size", "p_retailprice"]
    return ml.nearest_centre(df, x, ml.kmeans(df, x, 4)).select("p_partkey", "cluster")


@query("ml_knn", "embeddings", """
    select q, id, rank, round(dist, 4) as dist from (select a.vec_id as q, b.vec_id as id, list_distance(a.embedding::double[], b.embedding::double[]) as dist,
        row_number() over (partition by a.vec_id order by list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) as rank from embeddings a, embeddings b where a.vec_id % 100 = 0) where rank <= 5""")
def _(df):
    q = df.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return ml.knn(q, df, 5).select("q", "id", "rank", F.round("dist", 4).alias("dist"))


@query("ml_bootstrap", "customer")
def _(df):
    return ml.bootstrap(df.select("c_custkey", "c_acctbal"), "c_acctbal", 20, key=("c_custkey",))


@query("ml_decision_tree", "lineitem")
def _(df):
    x = df.withColumn("y", (F.col("l_extendedprice") > 40000).cast("double")).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "y")
    return ml.spark_model(x, "tree", ["l_quantity", "l_tax"], "y", maxDepth=3)[1].select("l_orderkey", "l_linenumber", "prediction")


_ENTRIES = "(select o_custkey % 40 as i, o_orderkey % 40 as j, sum(o_totalprice / 1000) as v from orders group by 1, 2)"


def _entries(df):
    return df.groupBy((F.col("o_custkey") % 40).alias("i"), (F.col("o_orderkey") % 40).alias("j")).agg(F.sum(F.col("o_totalprice") / 1000).alias("v"))


@query("sparse_multiply", "orders", f"select a.i, b.j, round(sum(a.v * b.v), 2) as v from {_ENTRIES} a join {_ENTRIES} b on a.j = b.i group by 1, 2")
def _(df):
    e = _entries(df)
    return rounded(sparse.multiply(e, e), 2)


@query("sparse_add_transpose", "orders", f"select i, j, round(sum(v), 2) as v from (select i, j, v from {_ENTRIES} union all select j, i, v from {_ENTRIES}) group by 1, 2")
def _(df):
    e = _entries(df)
    return rounded(sparse.add(e, sparse.transpose(e)), 2)


@query("graph_neighbors", "orders", "select src, count(*) as degree, round(sum(weight), 2) as weight from (select o_custkey as src, o_orderkey % 500 + 100000 as dst, o_totalprice as weight from orders union all select o_orderkey % 500 + 100000, o_custkey, o_totalprice from orders) group by 1")
def _(df):
    return rounded(sparse.neighbors(df.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 500 + 100000).alias("dst"), F.col("o_totalprice").alias("weight"))), 2)


@query("graph_shortest_paths", "nation", """
    with recursive e as (select n_nationkey as a, (n_nationkey * 7 + 3) % 25 as b, 1.0 + n_nationkey as w from nation), u as (select a, b, w from e union all select b, a, w from e),
        p(node, dist, hops) as (select 0, 0.0::double, 0 union all select b, min(dist + w), hops + 1 from p join u on a = node where hops < 12 group by b, hops)
    select node, min(dist) as dist from p group by 1""")
def _(df):
    e = df.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"), (1.0 + F.col("n_nationkey")).alias("weight"))
    return sparse.shortest_paths(e, 0)


_FILTER = signal.butter(2, 0.2)
for _name, _kernel, _columns in (
    ("fft", signal.spectrum, "freq double, re double, im double"), ("periodogram", signal.periodogram, "freq double, psd double"), ("welch", lambda x: signal.welch(x, n=16), "freq double, psd double"), ("stft", lambda x: signal.stft(x, n=16), "frame double, freq double, magnitude double"),
    ("detrend", signal.same(signal.detrend), "y double"), ("savgol", signal.same(signal.savgol), "y double"), ("lowpass", signal.same(lambda x: signal.lfilter(*_FILTER, x)), "y double"), ("filtfilt", signal.same(lambda x: signal.filtfilt(*_FILTER, x)), "y double"),
    ("fir", signal.same(lambda x: signal.lfilter(signal.fir1(8, 0.3), [1.0], x)), "y double"), ("envelope", signal.same(signal.hilbert_envelope), "y double"), ("resample", signal.same(lambda x: signal.resample_linear(x, 64)), "y double"), ("dct", signal.same(signal.dct2), "y double"),
    ("haar", signal.haar, "approx double, detail double"), ("peaks", lambda x: signal.find_peaks(x, distance=3, prominence=5.0), "at double, height double, prominence double"), ("kalman", signal.same(signal.kalman), "y double"),
    ("cheby1", signal.same(lambda x: signal.lfilter(*signal.cheby1(3, 1.0, 0.3), x)), "y double"), ("notch", signal.same(lambda x: signal.lfilter(*signal.notch(0.4), x)), "y double"), ("features", signal.features, "rms double, crest double, entropy double, dominant double, ar1 double, hurst double"),
    ("dwt", signal.daubechies4, "approx double, detail double"), ("cwt", signal.cwt, "scale double, value double"), ("tv_denoise", signal.same(signal.tv_denoise), "y double"),
):
    query(f"signal_{_name}", "events", C.SERIES.get(_name))(lambda df, k=_kernel, c=_columns, d=C.DIGITS.get(_name, 6): rounded(signal.per_series(df, "user_id", ["ts", "event_id"], "value", k, c), d))


def _stream(spark, d):
    df = read(spark, d, "events")
    return streams.read_files(spark, f"{d}/events.parquet*", df.schema)


@register("stream_tumbling", "select event_type, time_bucket(interval 1 day, ts) as day, count(*) as n from events group by 1, 2")
def _(spark, d):
    out = streams.tumbling(_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz").cast("timestamp")), "ts", "1 day", "0 seconds", ["event_type"], F.count(F.lit(1)).alias("n"))
    got = streams.available_now(out, "complete")
    return got.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


@register("stream_exponential_filter", C.EXPONENTIAL)
def _(spark, d):
    src = _stream(spark, d).select("user_id", "event_id", "value")
    out = streams.stateful(src, "user_id", ["event_id"], streams.exponential_step(0.25, "user_id", "value", "event_id"), (0.0, 0), "y double, n bigint", "user_id bigint, event_id bigint, y double")
    return streams.available_now(out)


@register("csv_round_trip", "select cast(p_partkey as double) as p_partkey, p_name, p_retailprice from part")
def _(spark, d):
    from metrolith.sources import files

    at = streams.shared_folder(spark)
    files.write_csv(read(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), at)
    return files.read_csv(spark, at)


_PIXELS = "(select l_linenumber as image, cast(l_orderkey % 24 as int) as y, cast(l_partkey % 24 as int) as x, avg(l_quantity) as v from lineitem group by 1, 2, 3)"


def _pixels(df):
    return df.groupBy(F.col("l_linenumber").alias("image"), (F.col("l_orderkey") % 24).cast("int").alias("y"), (F.col("l_partkey") % 24).cast("int").alias("x")).agg(F.avg("l_quantity").alias("v"))


for _kind, _sql in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max")):
    query(f"image_{_kind}", "lineitem", f"with p as {_PIXELS} select a.image, a.y, a.x, round({_sql}(b.v), 5) as v from p a join p b on a.image = b.image and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by 1, 2, 3")(lambda df, k=_kind: rounded(image.local(_pixels(df), k), 5))


@query("image_sobel", "lineitem", f"with p as {_PIXELS} select a.image, a.y, a.x, round(sum(b.v * (b.x - a.x) * case when b.y = a.y then 2 else 1 end), 4) + 0.0::double as v from p a join p b on a.image = b.image and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by 1, 2, 3")
def _(df):
    return rounded(image.convolve(_pixels(df), [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]))


@query("image_otsu", "lineitem", C.otsu(_PIXELS))
def _(df):
    # floor gives a bigint, which has no NaN and no infinities
    v = F.col("v")
    return image.otsu(_pixels(df).withColumn("v", F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)))


@query("image_equalised", "lineitem", f"with p as (select image, y, x, floor(v) as v from {_PIXELS}), c as (select image, v, count(*) as n from p group by 1, 2), e as (select image, v, round(sum(n) over (partition by image order by v) / sum(n) over (partition by image) * 255) as e from c) select p.image, p.y, p.x, e as v from p join e using (image, v)")
def _(df):
    return image.histogram_equalised(_pixels(df).withColumn("v", F.floor("v")))


@query("series_markov_transitions", "events", "select a, b, count(*) as n, round(count(*) / sum(count(*)) over (partition by a), 8) as p from (select event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b from events) where b is not null group by 1, 2")
def _(df):
    from pyspark.sql import Window

    steps = df.select(F.col("event_type").alias("a"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("b")).filter("b is not null")
    counts = steps.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("a")), 8))


@query("ml_roc_curve", "labels", f"""
    with c as (select s, sum(y) as p, sum(1 - y) as q from {_SCORED} group by 1)
    select round(s, 8) as threshold, round(sum(q) over w / (select sum(q) from c), 8) as fpr, round(sum(p) over w / (select sum(p) from c), 8) as tpr from c window w as (order by s desc)""")
def _(df):
    s = df.select(F.col("quality").alias("y"), ((F.col("doc_id") * 7919 % 101) / 101.0 + F.col("quality") * 0.3).alias("s"))
    return rounded(ml.roc_curve(s, "y", "s"), 8)


@query("ml_time_folds", "events", "with n as (select *, row_number() over (order by event_id) - 1 as k, count(*) over () as n from events) select f.f as fold, case when k < n - (4 - f.f) * (n // 5) - 7 then 'train' else 'test' end as role, count(*) as rows, sum(event_id)::bigint as ids from n, (select unnest([0, 1, 2, 3]) as f) f where k < n - (4 - f.f) * (n // 5) - 7 or (k >= n - (4 - f.f) * (n // 5) and k < n - (3 - f.f) * (n // 5)) group by 1, 2")
def _(df):
    out = ml.time_folds(df.select("event_id", "value"), "event_id", 4, gap=7)
    return out.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"))


@query("ml_estimator", "lineitem", "select round(regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * l_quantity, 3) as prediction, count(*) as n, (select round(regr_r2(l_extendedprice, l_quantity), 6) from lineitem) as score from lineitem a, (select 1) group by l_quantity".replace("regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * l_quantity", "(select regr_intercept(l_extendedprice, l_quantity) from lineitem) + (select regr_slope(l_extendedprice, l_quantity) from lineitem) * l_quantity"))
def _(df):
    m = ml.linear_estimator(["l_quantity"], "l_extendedprice").fit(df)
    out = m.predict(df).groupBy("l_quantity").agg(F.round(F.first("prediction"), 3).alias("prediction"), F.count(F.lit(1)).alias("n"))
    return out.select("prediction", "n", F.lit(round(m.score(df), 6)).alias("score"))
