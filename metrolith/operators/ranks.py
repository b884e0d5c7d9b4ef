"""Ranks over a whole table without one task that holds it: range bounds, and exact quantiles by narrowing."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct values between two bounds that are counted one by one, and the accuracy of a step that narrows them.
FEW, ACCURACY = 100_000, 5_000


def bounds(df: DataFrame, order: str, parts: int) -> list:
    """Least values of `parts` ranges of about as many rows; they are fixed here, so whatever uses them agrees."""
    ranged = df.select(order).filter(F.col(order).isNotNull()).repartitionByRange(parts, order)
    return sorted(r["b"] for r in ranged.groupBy(F.spark_partition_id()).agg(F.min(order).alias("b")).collect())


def range_of(df: DataFrame, order: str, cuts: list) -> Column:
    """The number of the range a row lies in, as a bound tells it; nulls come first."""
    if not cuts:
        return F.lit(0)
    kind = df.schema[order].dataType
    return F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: c <= F.col(order)))


def quantiles(df: DataFrame, names: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles (linear between neighbours) of numeric columns, nulls left out.

    Sketches of a fixed size bracket each wanted rank; the bracket is narrowed by further sketches
    until it holds few values, and only these are counted. Every step is an aggregate of all columns
    together, so no task holds the values of a column.
    """
    span = 3 / ACCURACY
    asked = [x for p in shares for x in (max(0.0, p - span), min(1.0, p + span))]
    one = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(names)], *[F.percentile_approx(c, asked, ACCURACY).alias(f"q{i}") for i, c in enumerate(names)]).first()
    todo = {}  # (column, rank) -> [low, high]
    for i, _ in enumerate(names):
        n = one[f"n{i}"]
        for k, p in enumerate(shares if n else []):
            at = p * (n - 1)
            for rank in {floor(at), ceil(at)}:
                todo.setdefault((i, rank), [one[f"q{i}"][2 * k], one[f"q{i}"][2 * k + 1]])
    done: dict[tuple[int, int], float] = {}
    ties: set[tuple[int, int]] = set()  # brackets that a sketch can't narrow: repeated values fill them, few others
    while todo:
        keys = list(todo)
        inside = [(F.col(names[i]) >= F.lit(lo)) & (F.col(names[i]) <= F.lit(hi)) for (i, _), (lo, hi) in todo.items()]
        got = df.agg(*[F.count(F.when(F.col(names[i]) < F.lit(todo[i, r][0]), 1)).alias(f"b{j}") for j, (i, r) in enumerate(keys)], *[F.count(F.when(x, 1)).alias(f"m{j}") for j, x in enumerate(inside)]).first()
        ready, again = [], []
        for j, key in enumerate(keys):
            lo, hi = todo[key]
            below, within = got[f"b{j}"], got[f"m{j}"]
            if key[1] < below:  # the sketch missed: widen
                todo[key][0] = float("-inf")
            elif key[1] >= below + within:
                todo[key][1] = float("nan")  # which is above all others
            elif lo == hi:
                done[key] = lo
            elif within <= FEW or key in ties:
                ready.append((j, below))
            else:
                again.append((j, (key[1] - below) / within))
        if ready:
            pairs = F.filter(F.array(*[F.when(inside[j], F.struct(F.lit(j).alias("j"), F.col(names[keys[j][0]]).cast("double").alias("v"))) for j, _ in ready]), lambda x: x.isNotNull())
            hit = inside[ready[0][0]]
            for j, _ in ready[1:]:
                hit = hit | inside[j]
            counts = df.filter(hit).select(F.explode(pairs).alias("x")).groupBy("x.j", "x.v").count().toArrow()
            rows = sorted(zip(*(counts.column(c).to_pylist() for c in ("j", "v", "count")), strict=True), key=lambda r: (r[0], r[1] != r[1], r[1]))
            for j, below in ready:
                at = below
                for k, v, n in rows:
                    if k == j:
                        at += n
                        if keys[j][1] < at:
                            done[keys[j]] = v
                            break
        if again:
            got = df.agg(*[F.percentile_approx(F.when(inside[j], F.col(names[keys[j][0]])), [max(0.0, p - span), min(1.0, p + span)], ACCURACY).alias(f"q{j}") for j, p in again]).first()
            for j, _ in again:
                if todo[keys[j]] == list(got[f"q{j}"]):
                    ties.add(keys[j])
                todo[keys[j]] = list(got[f"q{j}"])
        todo = {k: v for k, v in todo.items() if k not in done}
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        n, mine = one[f"n{i}"], []
        for p in shares:
            if not n:
                mine.append(None)
                continue
            at = p * (n - 1)
            lo, hi = float(done[i, floor(at)]), float(done[i, ceil(at)])
            mine.append(lo if lo == hi else lo + (at - floor(at)) * (hi - lo))
        out[c] = mine
    return out
