"""Matrices and graphs as tables of entries (i, j, v) and edges (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of the product: an equi-join on the inner index, then sums with map-side combine."""
    right = b.select(F.col("i").alias("k"), F.col("j"), F.col("v").alias("w"))
    left = a.select(F.col("i"), F.col("j").alias("k"), "v")
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("i", "j", "v").unionByName(b.select("i", "j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def apply(a: DataFrame, x: DataFrame) -> DataFrame:
    """Matrix times vector (j, x)."""
    return a.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def neighbors(edges: DataFrame, directed: bool = False) -> DataFrame:
    if not directed:
        edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight"))


def shortest_paths(edges: DataFrame, source, rounds: int = 100, directed: bool = False) -> DataFrame:
    """Least total weight from a source to every node reached: relaxation of the frontier to a fixpoint.

    Each round joins only the nodes whose distance fell; state is cut off by checkpoints where a
    checkpoint folder is set.
    """
    if not directed:
        edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    spark = edges.sparkSession
    safe = spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    kind = edges.schema["src"].dataType
    best = front = spark.range(1).select(F.lit(source).cast(kind).alias("node"), F.lit(0.0).alias("dist"))
    for _ in range(rounds):
        step = front.join(edges, front["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("weight")).alias("new"))
        merged = best.join(step, "node", "full").withColumn("fell", F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist"))))
        merged = merged.select("node", F.least("dist", "new").alias("dist"), "fell")
        merged = merged.checkpoint() if safe else merged.persist()
        best, front = merged.select("node", "dist"), merged.filter("fell").select("node", "dist")
        if front.isEmpty():
            return best
    raise RuntimeError(f"distances did not settle in {rounds} rounds")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, scale(b, -1.0))


def scale(a: DataFrame, k: float) -> DataFrame:
    return a.select("i", "j", (F.col("v") * k).alias("v"))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Elementwise product; only entries of both."""
    return a.join(b.select("i", "j", F.col("v").alias("w")), ["i", "j"]).select("i", "j", (F.col("v") * F.col("w")).alias("v"))


def kron(a: DataFrame, b: DataFrame, rows: int, columns: int) -> DataFrame:
    """Kronecker product; b is rows x columns. Every entry of one meets every entry of the other by definition."""
    other = b.select(F.col("i").alias("k"), F.col("j").alias("m"), F.col("v").alias("w"))
    return a.join(other).select((F.col("i") * rows + F.col("k")).alias("i"), (F.col("j") * columns + F.col("m")).alias("j"), (F.col("v") * F.col("w")).alias("v"))


def measures(a: DataFrame) -> DataFrame:
    """nnz, sum, trace, Frobenius norm and bandwidth in one aggregate."""
    v, off = F.col("v"), F.abs(F.col("i") - F.col("j"))
    return a.filter("v <> 0").agg(F.count(F.lit(1)).alias("nnz"), F.sum("v").alias("sum"), F.coalesce(F.sum(F.when(off == 0, v)), F.lit(0.0)).alias("trace"), F.sqrt(F.sum(v * v)).alias("frobenius"), F.max(off).alias("bandwidth"))


def solve(a: DataFrame, b: DataFrame, rounds: int = 200, tolerance: float = 1e-10) -> DataFrame:
    """x of a symmetric positive definite system a x = b (b is i, x), by conjugate gradients.

    Vectors are tables; a step is one product, two sums and three updates. Each iterate is
    checkpointed where a checkpoint folder is set.
    """
    safe = a.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    keep = lambda d: d.checkpoint() if safe else d.persist()
    s = keep(b.select("i", F.lit(0.0).alias("x"), F.col("x").cast("double").alias("r"), F.col("x").cast("double").alias("p")))
    rr = first = s.agg(F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0)).alias("q")).first()["q"]
    for _ in range(rounds):
        if rr <= tolerance**2 * first:
            break
        ap = apply(a, s.select(F.col("i").alias("j"), F.col("p").alias("x"))).withColumnRenamed("x", "ap")
        t = keep(s.join(ap, "i", "left").fillna({"ap": 0.0}))
        alpha = rr / t.agg(F.sum(F.col("p") * F.col("ap")).alias("q")).first()["q"]
        t = t.select("i", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p")
        new = t.agg(F.sum(F.col("r") * F.col("r")).alias("q")).first()["q"]
        s = keep(t.select("i", "x", "r", (F.col("r") + new / rr * F.col("p")).alias("p")))
        rr = new
    return s.select("i", "x")


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) with the least node reachable, for the nodes of undirected edges (src, dst).

    Every node takes the least label of its neighbours, then the label of its label, which halves
    the way left; neighbours are reduced by a minimum and never collected.
    """
    safe = edges.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    keep = lambda d: d.checkpoint() if safe else d.persist()
    both = keep(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = keep(both.select(F.col("src").alias("node")).distinct().withColumn("root", F.col("node")))
    for _ in range(rounds):
        near = both.join(label, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("root").alias("near"))
        hook = label.join(near, F.col("node") == F.col("src"), "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("new"))
        jump = hook.select(F.col("node").alias("at"), F.col("new").alias("far"))
        new = keep(hook.join(jump, F.col("new") == F.col("at"), "left").select("node", F.col("root").alias("old"), F.least("new", F.coalesce("far", "new")).alias("root")))
        done = new.filter("old <> root").isEmpty()
        label = new.select("node", "root")
        if done:
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")
