"""Hand-computed cases and invariants."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrolith.functions import mathfn as M
from metrolith.functions import special as P
from metrolith.functions import text as X
from metrolith.operators import ml, signal, sparse
from metrolith.operators import series as S
from metrolith.operators import table as T
from metrolith.sources import files
from metrolith.streaming import streams

ONE = S.Series(("k",), ("i",))


def series(spark, xs):
    return spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(xs)], "k int, i int, x double")


def values(df, name="y"):
    return [r[name] for r in df.orderBy("i").collect()]


def test_group_mean_and_population_std(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 10.0), ("a", 3.0), ("b", 20.0), ("b", 30.0)], "g string, v double")
    out = {r["g"]: r for r in T.group_by_agg(df, "g", [("v", "mean"), ("v", "std"), ("v", "count")]).collect()}
    assert out["a"]["mean_v"] == 2 and out["b"]["std_v"] == pytest.approx(math.sqrt(200 / 3)) and out["b"]["count_v"] == 3


def test_nan_never_wins_a_group(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 2.0), ("b", float("nan"))], "g string, v double")
    out = {r["g"]: (r["min_v"], r["max_v"]) for r in T.group_by_agg(df, "g", [("v", "min"), ("v", "max")]).collect()}
    assert out == {"a": (2.0, 2.0), "b": (math.inf, -math.inf)}


def test_unknown_names_are_errors(spark):
    df = spark.range(2)
    for call in (lambda: T.select(df, "x"), lambda: T.drop(df, "x"), lambda: T.group_by_agg(df, "id", []), lambda: T.group_by_agg(df, "id", [("id", "nope")])):
        with pytest.raises(ValueError):
            call()


def test_empty_tables(spark):
    df = series(spark, [])
    assert T.describe(df, "x").first()["count"] == 0
    assert T.histogram(df, "x", 4).count() == 0
    assert S.fill_missing(df, ONE, "x").count() == 0
    assert S.outliers(df, ("k",), "x").count() == 0


def test_regression_and_macro_scores(spark):
    r = ml.regression_scores(spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 3.0), (4.0, 7.0)], "a double, p double"), "a", "p").first()
    assert (r["mae"], r["mse"]) == (1.0, 2.5) and r["rmse"] == pytest.approx(1.58114, abs=1e-5)
    pairs = list(zip([1] * 6 + [0] * 4, [1] * 5 + [0, 1] + [0] * 3, strict=True))
    s = ml.classification_scores(spark.createDataFrame(pairs, "a int, p int"), "a", "p").first()
    assert s["precision"] == s["recall"] == s["f1"] == pytest.approx(0.7916667, abs=1e-6)


def test_folds_partition_the_rows_and_keep_groups(spark):
    f = ml.k_fold(spark.range(230).withColumn("g", F.col("id") % 23), 5, "g")
    assert f.count() == 230 and f.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0


def test_rolling_shrinks_at_the_ends(spark):
    df = series(spark, [1, 2, 3])
    assert values(df.withColumn("y", S.rolling_mean(ONE, F.col("x"), 101))) == [2, 2, 2]
    with pytest.raises(ValueError):
        S.rolling_mean(ONE, F.col("x"), 4)


def test_outliers_by_criterion(spark):
    df = series(spark, [i % 3 for i in range(18)] + [10000] * 3)
    flagged = lambda m: [r["i"] for r in S.outliers(df, ("k",), "x", m).filter("outlier").orderBy("i").collect()]
    assert flagged("zscore") == [] and flagged("modified_zscore") == [18, 19, 20] and flagged("iqr") == [18, 19, 20]
    assert all(S.outliers(series(spark, [7] * 10), ("k",), "x", m).filter("outlier").count() == 0 for m in ("zscore", "modified_zscore", "iqr"))
    assert [r["i"] for r in S.outliers(series(spark, [1, 2, math.nan, 3, 2, 1, 500]), ("k",), "x", "iqr").filter("outlier").collect()] == [6]


def test_fill_missing(spark):
    df = series(spark, [math.nan, 1, math.nan, math.nan, 4, math.nan])
    fill = lambda m: values(S.fill_missing(df, ONE, "x", m), "x")
    assert fill("linear") == [1, 1, 2, 3, 4, 4] and fill("nearest") == [None, 1, 1, 4, 4, 4] or fill("nearest")[1:] == [1, 1, 4, 4, 4]
    assert fill("mean") == [2.5, 1, 2.5, 2.5, 4, 2.5]


def test_cumsum_undoes_diff(spark):
    xs = [3.0, 1.0, 4.0, 1.0, 5.0]
    df = series(spark, xs).withColumn("d", F.coalesce(S.diff(ONE, F.col("x")), F.col("x"))).withColumn("y", S.cumsum(ONE, F.col("d")))
    assert values(df) == pytest.approx(xs)


def test_prefix_sum_over_many_partitions(spark):
    out = T.prefix_sum(spark.range(1000), "id", "id", "s", 7).orderBy("id").collect()
    assert [r["s"] for r in out] == np.cumsum(range(1000)).tolist()


def test_prefix_sum_of_a_wide_table_over_many_partitions(spark):
    """Columns that the sum does not need are pruned from one use of the ranges only; the totals agree all the same."""
    df = spark.range(200_000).selectExpr("id", "pmod(hash(id), 1000003) * 200000L + id as o", "id % 7 as v", "cast(id as string) as w").repartition(9)
    out = T.prefix_sum(df, "o", "v", "s", 16)
    rows = out.select("id", "o", "v", "s", "w").toPandas().sort_values("o")
    assert (rows["s"] == rows["v"].cumsum()).all() and len(rows) == 200_000
    odd = spark.createDataFrame([(None, 2), ("b", 1), ("a", 5), ("a", 1)], "o string, v int")
    assert sorted(r["s"] for r in T.prefix_sum(odd, "o", "v", "s", 3).collect())[-1] == 9


def test_roc_curve_of_many_scores_is_monotone(spark):
    df = spark.range(100_000).selectExpr("cast(hash(id) % 3 = 0 as int) as y", "id / 100000.0 as s")
    r = ml.roc_curve(df, "y", "s").toPandas().sort_values("threshold", ascending=False)
    assert r["fpr"].is_monotonic_increasing and r["tpr"].is_monotonic_increasing and r["tpr"].iloc[-1] == r["fpr"].iloc[-1] == 1
    pdf = df.toPandas()
    rank = pdf["s"].rank()
    n1 = pdf["y"].sum()
    want = (rank[pdf["y"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(pdf) - n1))
    assert ml.auc(df, "y", "s").first()["auc"] == pytest.approx(want)


@pytest.mark.parametrize("few", [100_000, 50])
def test_quantiles_are_exact(spark, monkeypatch, few):
    from metrolith.operators import ranks

    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "ACCURACY", 100)
    g = np.random.default_rng(3)
    a, b = g.normal(size=20_000), g.integers(0, 4, 20_000)
    df = spark.createDataFrame([(float(x), int(y), None, float(y) if y else None) for x, y in zip(a, b, strict=True)], "a double, b int, c double, d double")
    got = ranks.quantiles(df, ["a", "b", "c", "d"], [0.0, 0.25, 0.5, 0.999, 1.0])
    assert got["a"] == pytest.approx(np.quantile(a, [0, 0.25, 0.5, 0.999, 1]).tolist())
    assert got["b"] == pytest.approx(np.quantile(b, [0, 0.25, 0.5, 0.999, 1]).tolist()) and got["c"] == [None] * 5
    assert got["d"] == pytest.approx(np.quantile(b[b > 0], [0, 0.25, 0.5, 0.999, 1]).tolist())


def test_ties_and_copies(spark):
    """Of equal distances the least ids win; copies get weights and centres of their own."""
    data = spark.createDataFrame([(i, [1.0, 0.0]) for i in (9, 8, 7, 6, 5, 4, 3, 2, 1)], "vec_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(0, [0.0, 0.0])], "query_id long, embedding array<double>")
    assert sorted(r["id"] for r in ml.knn(q, data, 3).collect()) == [1, 2, 3]
    same = spark.createDataFrame([(1.0,)] * 50 + [(0.0,)] * 50, "x double")
    means = [r["mean"] for r in ml.bootstrap(same, "x", 40).collect()]
    assert len({round(m, 6) for m in means}) > 10 and abs(np.mean(means) - 0.5) < 0.1
    c = ml.kmeans(spark.createDataFrame([(1.0, 1.0)] * 20 + [(5.0, 5.0)] * 20, "a double, b double"), ["a", "b"], 2)
    assert sorted(map(tuple, c.tolist())) == [(1.0, 1.0), (5.0, 5.0)]


def test_estimator_protocol(spark):
    df = spark.range(100).selectExpr("cast(id as double) as x", "3.0 * id + 1 as y")
    m = ml.linear_estimator(["x"], "y")
    with pytest.raises(ValueError):
        m.predict(df)
    assert m.fit(df).score(df) == pytest.approx(1) and m.predict(df).filter("x = 10").first()["prediction"] == pytest.approx(31)
    assert ml.centre_estimator(["x"], 2).fit(df).transform(df).select("prediction").distinct().count() == 2


def test_text_edges(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    s = F.lit("a-b-c")
    assert [get(f(s, "-")) for f in (X.before, X.after, X.before_last, X.after_last)] == ["a", "b-c", "a-b", "c"]
    assert [get(f(s, "?")) for f in (X.before, X.after, X.before_last, X.after_last)] == ["a-b-c"] * 4
    assert get(X.lines(F.lit("a\r\nb\n"))) == ["a", "b"] and get(X.pad_left(F.lit("abcdef"), 3)) == "abcdef"
    assert get(X.like(F.lit("file12.txt"), "file##.*")) and not get(X.like(F.lit("xfile12.txt"), "file##.*"))
    assert get(X.index_of(s, "z")) is None and get(X.regex_groups(F.lit("k=1"), r"(\w)=(\d)(x)?")) == ["k", "1", ""]
    assert get(X.split(F.lit("a.b.c"), ".", 2)) == ["a", "b.c"] and get(X.right(s, 99)) == "a-b-c"


def test_math_edges(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    assert get(M.div(1.0, 0.0)) == math.inf and math.isnan(get(M.div(0.0, 0.0))) and get(M.mod(-7, 3)) == 2 and get(M.rem(-7.0, 3.0)) == -1
    assert math.isnan(get(M.ln(-1.0))) and get(M.ln(0.0)) == -math.inf and get(M.sign(0.0)) == 1 and get(M.gcd(F.lit(48), F.lit(36))) == 12
    assert get(M.conv(F.array(*map(F.lit, (1.0, 2.0))), F.array(*map(F.lit, (1.0, 1.0, 1.0))))) == [1, 3, 3, 2]
    assert get(P.matmul(F.array(F.array(F.lit(1.0), F.lit(2.0))), F.array(F.array(F.lit(3.0)), F.array(F.lit(4.0))))) == [[11.0]]


def test_distributions():
    assert P._normcdf(1.959963985) == pytest.approx(0.975) and P._tcdf(2.0, 5) == pytest.approx(0.949030, abs=1e-6)
    assert P.gammainc(2.0, 1.0) == pytest.approx(1 - math.exp(-2)) and P.betainc(0.5, 2, 2) == pytest.approx(0.5)
    for name, p in {"bino": (12, 0.4), "poiss": (3.5,), "geo": (0.3,), "nbin": (3, 0.4), "hyge": (40, 15, 10), "unid": (9,)}.items():
        pdf, cdf, _ = P.FAMILIES[name]
        assert math.fsum(pdf(k, *p) for k in range(8)) == pytest.approx(cdf(7, *p), abs=1e-9)


def test_signal_identities():
    x = np.sin(np.arange(64) * 0.4)
    assert signal.lfilter(*signal.butter(3, 0.3), np.ones(400))[-1] == pytest.approx(1)
    assert signal.savgol(np.arange(20.0) ** 2) == pytest.approx(np.arange(20.0) ** 2)
    s = signal.spectrum(x)
    assert (2 * (s["re"] ** 2 + s["im"] ** 2).sum() - s["re"][0] ** 2 - s["re"][-1] ** 2) / 64 == pytest.approx((x**2).sum())
    assert (signal.dct2(x) ** 2).sum() == pytest.approx((x**2).sum()) and np.abs(signal.detrend(3 + 2 * np.arange(30.0))).max() < 1e-9
    assert signal.find_peaks(np.array([0, 2, 0, 1, 0, 3, 0.0]))["at"].tolist() == [1, 3, 5]


def test_more_kernels():
    assert signal.tv_denoise(np.array([0.0, 4, 0, 4]), 100.0, 2000) == pytest.approx([2, 2, 2, 2], abs=1e-3)
    b, a = signal.cheby1(3, 1.0, 0.4)
    assert abs(signal.freqz(b, a)[1][0]) == pytest.approx(1) and abs(signal.freqz(*signal.notch(0.5))[1][256]) < 1e-9
    d = signal.daubechies4(np.arange(16.0) % 5)
    assert (d["approx"] ** 2).sum() + (d["detail"] ** 2).sum() == pytest.approx(((np.arange(16.0) % 5) ** 2).sum())
    assert signal.dominant_frequency(np.sin(2 * np.pi * 0.125 * np.arange(64))) == pytest.approx(0.125)
    x = [1.0, 0.5]
    for _ in range(400):
        x.append(0.6 * x[-1] - 0.3 * x[-2] + math.sin(len(x) ** 2))
    assert signal.ar_model(np.array(x), 2) == pytest.approx([0.6, -0.3], abs=0.12)


def test_otsu(spark):
    from metrolith.operators import image

    df = spark.createDataFrame([(1, y, x, float(v)) for y in range(4) for x, v in enumerate([1, 2, 9, 10])], "image int, y int, x int, v double")
    assert image.otsu(df).first()["threshold"] == 2.0


def test_shortest_path_and_sparse(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (4, 5, 1.0)], "src int, dst int, weight double")
    assert {r["node"]: r["dist"] for r in sparse.shortest_paths(e, 1).collect()} == {1: 0.0, 2: 1.0, 3: 2.0}
    m = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (1, 1, 3.0)], "i int, j int, v double")
    assert {(r["i"], r["j"]): r["v"] for r in sparse.multiply(m, m).collect()} == {(0, 0): 4.0, (0, 1): 5.0, (1, 1): 9.0}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name;value\nx;3,14\ny;2,50\n")
    out = files.read_csv(spark, str(tmp_path / "a.csv"), sep=";", decimal=",")
    assert [r["value"] for r in out.orderBy("name").collect()] == [3.14, 2.5] and dict(out.dtypes)["name"] == "string"
    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(2, 3))
    assert [r["value"] for r in files.read_npy(spark, str(tmp_path)).orderBy("i").collect()] == [0, 1, 2, 3, 4, 5]
    (tmp_path / "r.bin").write_bytes(struct.pack("<hd", 1, 2.5) + struct.pack("<hd", 3, 4.5))
    assert [tuple(r)[1:] for r in files.read_structs(spark, str(tmp_path), "<hd", ["a", "b"], "*.bin").orderBy("a").collect()] == [(1.0, 2.5), (3.0, 4.5)]


def test_floats_survive_csv(spark, tmp_path):
    xs = [1 / 3, 1e-300, 5e-324, -0.0, 2.0**53, 1.7976931348623157e308]
    files.write_csv(spark.createDataFrame([(float(i), x) for i, x in enumerate(xs)], "i double, x double"), str(tmp_path / "f"))
    assert [r["x"] for r in files.read_csv(spark, str(tmp_path / "f")).orderBy("i").collect()] == xs


def test_state_is_kept_between_batches(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(1, k * 2 + j, float(k * 2 + j)) for j in range(2)], "u long, i long, x double").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    src = streams.read_files(spark, str(tmp_path / "in" / "*"), "u long, i long, x double", per_trigger=1)
    out = streams.stateful(src, "u", ["i"], streams.exponential_step(0.5, "u", "x", "i"), (0.0, 0), "y double, n long", "u long, i long, y double")
    got = [r["y"] for r in streams.available_now(out, checkpoint=str(tmp_path / "cp"), out=str(tmp_path / "out")).orderBy("i").collect()]
    y, want = 0.0, []
    for x in range(6):
        y = x if x == 0 else y + 0.5 * (x - y)
        want.append(y)
    assert got == pytest.approx(want)


def test_entry_imports_without_the_llm_folder():
    import __spark_entry__ as e

    assert len(e.queries()) >= len(e.oracle_sql()) > 100
