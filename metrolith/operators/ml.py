"""Estimators and evaluation. Fits are aggregates over the whole table (normal equations, counts, moments) or pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regression_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """mae, mse, rmse, r2 in one aggregate."""
    e = F.col(actual) - F.col(predicted)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop(actual) * F.count(F.lit(1)))).alias("r2"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Macro precision, recall and f1 and accuracy, from the confusion matrix (one row a pair of labels)."""
    m = confusion_matrix(df, actual, predicted)
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    p = m.groupBy(F.col("predicted").alias("label")).agg(hit.alias("h"), F.sum("n").alias("np"))
    r = m.groupBy(F.col("actual").alias("label")).agg(hit.alias("hr"), F.sum("n").alias("nr"))
    both = r.join(p, "label", "left").select(F.col("nr"), F.col("hr"), F.coalesce(F.col("hr") / F.col("np"), F.lit(0.0)).alias("p"), (F.col("hr") / F.col("nr")).alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0))).otherwise(0.0)
    return both.agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg(f1).alias("f1"), (F.sum("hr") / F.sum("nr")).alias("accuracy"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, fpr, tpr at every distinct score: counts by score, then a prefix sum over distinct scores."""
    from metrolith.operators.table import prefix_sums

    c = df.groupBy(score).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.sum((1 - F.col(label)).cast("bigint")).alias("q")).withColumn("__o", -F.col(score))
    total = c.agg(F.sum("p").alias("P"), F.sum("q").alias("Q")).first()
    out = prefix_sums(c, "__o", {"p": "tp", "q": "fp"})
    return out.select(F.col(score).alias("threshold"), (F.col("fp") / F.lit(max(1, total["Q"] or 0))).alias("fpr"), (F.col("tp") / F.lit(max(1, total["P"] or 0))).alias("tpr"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by trapezoids: a sum over distinct scores, once the counts above each are known."""
    from metrolith.operators.table import prefix_sums

    c = df.groupBy((-F.col(score)).alias("o")).agg(F.sum(F.col(label).cast("double")).alias("p"), F.sum(1 - F.col(label).cast("double")).alias("q"))
    out = prefix_sums(c, "o", {"p": "tp"})
    return out.agg((F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)) / F.nullif(F.sum("p") * F.sum("q"), F.lit(0.0))).alias("auc"))


def scaler(df: DataFrame, names: list[str], kind: str = "standard") -> DataFrame:
    """Columns scaled: standard (N - 1), minmax or robust. Zero spread divides by one. Two values a column reach the driver."""
    stats = {"standard": lambda c: (F.avg(c), F.stddev_samp(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)), "robust": lambda c: (F.median(c), F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25)))}[kind]
    found = df.agg(*[x.alias(f"{i}_{c}") for c in names for i, x in zip("ab", stats(c), strict=True)]).first()
    return df.withColumns({c: (F.col(c) - F.lit(found[f"a_{c}"])) / F.lit(found[f"b_{c}"] or 1.0) for c in names})


def k_fold(df: DataFrame, k: int, *group: str, seed: int = 0) -> DataFrame:
    """Adds `fold`, 0 to k - 1, by a hash of the group: rows of a group stay together and no shuffle is needed."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), *group), F.lit(k)).cast("int"))


def train_test_split(df: DataFrame, part: float, *key: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    u = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30))
    return df.filter(u >= int(part * (1 << 30))), df.filter(u < int(part * (1 << 30)))


def gram(df: DataFrame, x: list[str | Column], y: Column | None = None, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y with a constant, in one aggregate; their size depends on the columns alone."""
    cols = [F.lit(1.0)] + [F.col(c) if isinstance(c, str) else c for c in x]
    w = weight if weight is not None else F.lit(1.0)
    n = len(cols)
    want = [F.sum(cols[i] * cols[j] * w).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
    if y is not None:
        want += [F.sum(cols[i] * y * w).alias(f"y{i}") for i in range(n)]
    r = df.agg(*want).first()
    g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
    return g, np.array([r[f"y{i}"] for i in range(n)], float) if y is not None else np.zeros(0)


def ols(df: DataFrame, x: list[str], y: str, ridge: float = 0.0) -> np.ndarray:
    """Intercept and slopes; with `ridge` on the slopes."""
    g, b = gram(df, x, F.col(y))
    return np.linalg.solve(g + ridge * np.diag([0.0] + [1.0] * len(x)), b)


def polyfit(df: DataFrame, x: str, y: str, degree: int) -> np.ndarray:
    """Coefficients, highest power first."""
    g, b = gram(df, [F.pow(F.col(x), F.lit(k)) for k in range(1, degree + 1)], F.col(y))
    return np.linalg.solve(g, b)[::-1]


def linear(df: DataFrame, x: list[str], coef: np.ndarray, name: str = "prediction") -> DataFrame:
    out = F.lit(float(coef[0]))
    for c, k in zip(x, coef[1:], strict=True):
        out = out + F.col(c) * F.lit(float(k))
    return df.withColumn(name, out)


def logistic(df: DataFrame, x: list[str], y: str, steps: int = 12, ridge: float = 1e-6) -> np.ndarray:
    """Newton's iterations; each is one aggregate."""
    coef = np.zeros(len(x) + 1)
    for _ in range(steps):
        z = linear(df, x, coef, "__z").withColumn("__p", 1 / (1 + F.exp(-F.col("__z"))))
        w = F.col("__p") * (1 - F.col("__p"))
        g, b = gram(z, x, F.col("__z") + (F.col(y) - F.col("__p")) / F.greatest(w, F.lit(1e-9)), w)
        new = np.linalg.solve(g + ridge * np.eye(len(g)), b)
        if np.abs(new - coef).max() < 1e-9:
            return new
        coef = new
    return coef


def pca(df: DataFrame, x: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components as rows, explained variance)."""
    g, _ = gram(df, x)
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    value, vector = np.linalg.eigh((g[1:, 1:] - n * np.outer(mean, mean)) / max(1, n - 1))
    top = np.argsort(value)[::-1][:k]
    return mean, vector[:, top].T, value[top]


def naive_bayes(df: DataFrame, x: list[str], label: str) -> DataFrame:
    """Per label: prior count, and mean and variance of each column."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in x], *[F.var_pop(c).alias(f"var_{c}") for c in x])


def kmeans(df: DataFrame, x: list[str], k: int, iterations: int = 20, seed: int = 0) -> np.ndarray:
    """Lloyd's steps as aggregates; starts from the k distinct rows of least hash. k centres are all that reaches the driver."""
    start = df.select(*x).distinct().orderBy(F.xxhash64(F.lit(seed), *x)).limit(k).collect()
    centres = np.array([[float(v) for v in r] for r in start])
    for _ in range(iterations):
        rows = nearest_centre(df, x, centres).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in x]).collect()
        new = centres.copy()
        for r in rows:
            new[r["cluster"]] = [r[c] for c in x]
        if np.allclose(new, centres, atol=1e-12):
            break
        centres = new
    return centres


def nearest_centre(df: DataFrame, x: list[str], centres: np.ndarray) -> DataFrame:
    d = [sum(((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(x, centre, strict=True)), F.lit(0.0)) for centre in centres]
    pairs = F.array(*[F.struct(e.alias("d"), F.lit(i).alias("i")) for i, e in enumerate(d)])
    return df.withColumn("cluster", F.array_min(pairs)["i"])


def knn(queries: DataFrame, data: DataFrame, k: int, vector: str = "embedding", query_id: str = "query_id", id_: str = "vec_id", block: int = 1024) -> DataFrame:
    """The k nearest rows of `data` for every query, exactly: queries in blocks against all rows.

    A block of queries is broadcast (its size is fixed), scored against each batch of rows by a matrix
    product, and only the best k of a batch leave it; a top-k by query merges them.
    """
    import pyarrow as pa

    outs, held = [], []
    spark = data.sparkSession

    def against(rows):
        ids = np.array([r[query_id] for r in rows], np.int64)
        q = np.array([list(r[vector]) for r in rows], np.float64)
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches):
            ids, q = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                mine = np.asarray(b.column(0))
                order = np.argsort(mine, kind="stable")  # of equal distances the least ids come first
                mine, v = mine[order], np.array(b.column(1).to_pylist(), np.float64)[order]
                d = ((q**2).sum(1)[:, None] - 2 * q @ v.T + (v**2).sum(1)[None, :]).clip(0)
                best = min(k, len(mine))
                far = np.partition(d, best - 1, 1)[:, best - 1]
                near = [np.flatnonzero(row <= x) for row, x in zip(d, far, strict=True)]
                top = np.stack([n[np.argsort(row[n], kind="stable")[:best]] for n, row in zip(near, d, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, top.shape[1])), pa.array(mine[top].reshape(-1)), pa.array(np.sqrt(np.take_along_axis(d, top, 1)).reshape(-1))], names=["q", "id", "dist"])

        return data.select(F.col(id_).cast("bigint"), vector).mapInArrow(run, "q bigint, id bigint, dist double")

    for row in queries.select(query_id, vector).toLocalIterator():
        held.append(row)
        if len(held) == block:
            outs.append(against(held))
            held = []
    if held or not outs:
        outs.append(against(held) if held else data.sparkSession.createDataFrame([], "q bigint, id bigint, dist double"))
    every = outs[0]
    for o in outs[1:]:
        every = every.unionByName(o)
    w = Window.partitionBy("q").orderBy("dist", "id")
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bootstrap(df: DataFrame, value: str, rounds: int = 200, seed: int = 0, key: tuple[str, ...] = ()) -> DataFrame:
    """Means of Poisson resamples, all in one pass: weight of a row in a round from the hash of its key.

    Without a key rows are told apart by their place, so equal rows still get weights of their own.
    """
    u = lambda r: F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.col("__row")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    cdf = np.cumsum([np.exp(-1) / np.prod(range(1, i + 1)) if i else np.exp(-1) for i in range(8)])
    weight = lambda r: sum((F.when(u(r) >= float(c), 1).otherwise(0) for c in cdf), F.lit(0))
    rows = df.withColumn("__row", F.xxhash64(*key) if key else F.xxhash64(F.monotonically_increasing_id()))
    one = rows.agg(*[(F.sum(F.col(value) * weight(r)) / F.sum(weight(r))).alias(f"m{r}") for r in range(rounds)])
    return one.select(F.explode(F.array(*[f"m{r}" for r in range(rounds)])).alias("mean"))


def pipeline(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = s(df)
        return df

    return run


def spark_model(df: DataFrame, kind: str, x: list[str], y: str, **options):
    """Tree ensembles, support vectors, mixtures and networks from pyspark.ml on an assembled vector."""
    from pyspark.ml import classification, clustering, regression
    from pyspark.ml.feature import VectorAssembler

    made = {
        "tree": classification.DecisionTreeClassifier, "random_forest": classification.RandomForestClassifier, "gradient_boosting": classification.GBTClassifier,
        "svm": classification.LinearSVC, "logistic": classification.LogisticRegression, "mlp": classification.MultilayerPerceptronClassifier,
        "forest_regressor": regression.RandomForestRegressor, "boosting_regressor": regression.GBTRegressor, "gmm": clustering.GaussianMixture, "bisecting_kmeans": clustering.BisectingKMeans,
    }[kind]
    wide = VectorAssembler(inputCols=x, outputCol="features").transform(df)
    model = made(**({"labelCol": y} if y and kind not in ("gmm", "bisecting_kmeans") else {}), **options).fit(wide)
    return model, model.transform(wide)


def time_folds(df: DataFrame, order: str, k: int, gap: int = 0) -> DataFrame:
    """Time-ordered folds: `fold` k trains on all rows before its block and tests on the block, less `gap` rows between.

    Rows of one fold and role are told by columns fold and role (train or test). Row numbers come from a
    running count over ranges of the order, which must be unique.
    """
    from metrolith.operators.table import prefix_sum

    n = df.count()
    size = n // (k + 1)
    if not size:
        raise ValueError("fewer rows than folds")
    at = prefix_sum(df.withColumn("__one", F.lit(1)), order, "__one", "__at").withColumn("__at", F.col("__at") - 1).drop("__one")
    out = None
    for f in range(k):
        start, end = n - (k - f) * size, n - (k - f - 1) * size
        role = F.when((F.col("__at") >= start) & (F.col("__at") < end), "test").when(F.col("__at") < start - gap, "train")
        part = at.withColumns({"fold": F.lit(f), "role": role}).filter("role is not null")
        out = part if out is None else out.unionByName(part)
    return out.drop("__at")


class Estimator:
    """fit, predict, score and transform around a fitting and an applying function.

    `fit(df)` gives the fitted state, small and on the driver; `apply(df, state)` adds columns, of which
    `prediction` is scored against `target`.
    """

    def __init__(self, fit: Callable, apply: Callable, target: str | None = None, regression: bool = True):
        self._fit, self._apply, self.target, self.regression, self.state = fit, apply, target, regression, None

    def fit(self, df: DataFrame) -> Estimator:
        self.state = self._fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.state is None:
            raise ValueError("not fitted")
        return self._apply(df, self.state)

    predict = transform

    def score(self, df: DataFrame) -> float:
        """R squared of a regression, else the share of right predictions."""
        out, y, p = self.predict(df), F.col(self.target), F.col("prediction")
        if not self.regression:
            return float(out.agg(F.avg((y == p).cast("double")).alias("s")).first()["s"])
        return float(out.agg((1 - F.sum((y - p) ** 2) / (F.var_pop(y) * F.count(y))).alias("s")).first()["s"])


def linear_estimator(x: list[str], y: str) -> Estimator:
    def apply(df: DataFrame, coef) -> DataFrame:
        return df.withColumn("prediction", sum((F.lit(float(b)) * F.col(c) for b, c in zip(coef[1:], x, strict=True)), F.lit(float(coef[0]))))

    return Estimator(lambda df: ols(df, x, y), apply, y)


def centre_estimator(x: list[str], k: int) -> Estimator:
    return Estimator(lambda df: kmeans(df, x, k), lambda df, c: nearest_centre(df, x, c).withColumn("prediction", F.col("cluster")), regression=False)
