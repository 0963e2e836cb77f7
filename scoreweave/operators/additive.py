"""Additive-model discovery: boosted one-variable functions and the pairs that they leave unexplained.

Variables are cut into at most BINS quantile bins and rows become bin numbers, written once.  A cycle gives one variable after the other a
step towards what its bins' residuals ask for.  What a step does to the other variables' residuals depends on joint counts only, so
the rows are read once per Newton step, for the weighted joint tables of all pairs of bins; all cycles of that step run on these tables.
Their size follows from the numbers of variables and bins, not from the rows: they are added up within tasks, then by table in two levels.

*Importance* of a variable: the mean size of its function over all rows.  *Interactions*: per pair, the residuals of the
additive model in the joint table of coarser bins, less what the margins still hold; the magnitude is the mean size of the fitted surface.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .ordered import quantiles

#: Bins of a variable, coarser bins in a pair, Newton steps, cycles in each, share of a step that is taken, added to each bin's weight.
BINS, COARSE, STEPS, CYCLES, RATE, RIDGE = 32, 16, 6, 60, 0.3, 1.0
SALT = 32


@dataclass
class Additive:
    columns: list[str]
    edges: dict[str, list[float]]
    base: float
    shapes: list[np.ndarray]
    counts: list[np.ndarray]
    pairs: list[tuple[int, int, float]] = field(default_factory=list)

    def importance(self) -> list[tuple[str, float]]:
        return sorted(((c, float((n * np.abs(s)).sum() / max(n.sum(), 1))) for c, s, n in zip(self.columns, self.shapes, self.counts)), key=lambda x: (-x[1], x[0]))

    def importances(self, spark) -> DataFrame:
        return spark.createDataFrame(self.importance(), "variable string, importance double")

    def interactions(self, spark, top: int = 20) -> DataFrame:
        first = sorted(((self.columns[a], self.columns[b], f"{self.columns[a]} x {self.columns[b]}", m) for a, b, m in self.pairs), key=lambda x: (-x[3], x[2]))[:top]
        return spark.createDataFrame(first, "variable_1 string, variable_2 string, interaction string, magnitude double")


def _summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """rows (k, v): packed numbers per task -> their sum per k; tasks are added up in SALT groups first."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["k"][:1], "salt": 0, "v": [sum(np.frombuffer(x, float) for x in pdf["v"]).tobytes()]})

    shape = "k int, salt int, v binary"
    some = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALT))).groupBy("k", "salt").applyInPandas(add, shape)
    return {r["k"]: np.frombuffer(r["v"], float).copy() for r in some.groupBy("k").applyInPandas(add, shape).collect()}  # a table per pair of variables


def encoded(df: DataFrame, target: str, columns: list[str], bins: int = BINS) -> tuple[DataFrame, dict[str, list[float]]]:
    """(codes, y): a byte per variable, its bin; missing values count as the median.  And the inner edges of the bins."""
    shares = [k / bins for k in range(1, bins)]
    found = quantiles(df.where(F.col(target).isNotNull()), {c: [*shares, 0.5] for c in columns})
    edges, middle = {c: sorted(set(q[:-1])) for c, q in found.items()}, {c: q[-1] if q else 0.0 for c, q in found.items()}
    values = [F.coalesce(F.when(~F.isnan(x), x), F.lit(middle[c])).alias(f"x{k}") for k, c in enumerate(columns) for x in [F.col(f"`{c}`").cast("double")]]
    rows, inner = df.where(F.col(target).isNotNull()).select(*values, F.col(target).cast("double").alias("y")), [np.array(edges[c]) for c in columns]

    def encode(frames):
        for pdf in frames:
            codes = np.column_stack([np.searchsorted(e, pdf[f"x{k}"].to_numpy(), side="left") for k, e in enumerate(inner)]).astype(np.uint8)
            yield pd.DataFrame({"codes": [x.tobytes() for x in codes], "y": pdf["y"].to_numpy()})

    return materialize(rows.mapInPandas(encode, "codes binary, y double"), "codes"), edges


def _tables(rows: DataFrame, p: int, base: float, shapes: list[np.ndarray], bins: int, pairs: bool) -> dict[int, np.ndarray]:
    """One pass: for table k = a * p + b, the joint weights of bins of a and b; on the diagonal counts, weights and residuals.  With
    `pairs`, residuals too, over coarse bins."""

    def tally(frames):
        held = {a * p + b: np.zeros((3 if a == b else 1 + pairs) * (bins if a == b else bins * bins)) for a in range(p) for b in range(a, p)}
        for pdf in frames:
            codes = np.frombuffer(b"".join(pdf["codes"]), np.uint8).reshape(-1, p).astype(np.int64)
            score = base + sum(s[codes[:, k]] for k, s in enumerate(shapes))
            hit = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            w, r = hit * (1 - hit), pdf["y"].to_numpy() - hit
            for a in range(p):
                held[a * p + a] += np.concatenate([np.bincount(codes[:, a], v, bins) for v in (None, w, r)])
                for b in range(a + 1, p):
                    both = codes[:, a] * bins + codes[:, b]
                    held[a * p + b] += np.concatenate([np.bincount(both, v, bins * bins) for v in ((w, r) if pairs else (w,))])
        yield pd.DataFrame({"k": list(held), "v": [x.tobytes() for x in held.values()]})

    return _summed(rows.mapInPandas(tally, "k int, v binary"))


def fit(df: DataFrame, target: str, columns: list[str], bins: int = BINS, steps: int = STEPS, cycles: int = CYCLES) -> Additive:
    """The additive model of a 0/1 outcome, with all pairs of variables ranked by what it leaves unexplained."""
    p = len(columns)
    rows, edges = encoded(df, target, columns, bins)
    n, events = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or not 0 < events < n:
        return Additive(columns, edges, 0.0, [np.zeros(bins)] * p, [np.zeros(bins)] * p)
    base, shapes = float(np.log(events / (n - events))), [np.zeros(bins) for _ in range(p)]
    for _ in range(steps):
        t = _tables(rows, p, base, shapes, bins, False)
        weight, rest = [t[a * p + a][bins : 2 * bins] for a in range(p)], [t[a * p + a][2 * bins :].copy() for a in range(p)]
        joint = {(a, b): t[a * p + b].reshape(bins, bins) for a in range(p) for b in range(a + 1, p)}
        moved = 0.0
        for _ in range(cycles):
            for a in range(p):
                step = RATE * rest[a] / (weight[a] + RIDGE)
                shapes[a] = shapes[a] + step
                rest[a] -= weight[a] * step
                for b in range(p):
                    if b != a:
                        rest[b] -= joint[a, b].T @ step if a < b else joint[b, a] @ step
                moved = max(moved, float(np.abs(step).max()))
        counts = [t[a * p + a][:bins] for a in range(p)]
        for a in range(p):  # the mean of a function belongs to the base
            mean = float((counts[a] * shapes[a]).sum() / n)
            shapes[a], base = shapes[a] - mean, base + mean
        if moved < 1e-4:
            break
    t = _tables(rows, p, base, shapes, bins, True)
    return Additive(columns, edges, base, shapes, [t[a * p + a][:bins] for a in range(p)], [(a, b, _magnitude(t[a * p + b], bins, n)) for a in range(p) for b in range(a + 1, p)])


def _magnitude(table: np.ndarray, bins: int, n: int) -> float:
    """The mean size of the surface that a pair's residuals ask for, its margins taken out."""
    weight, rest = table.reshape(2, bins, bins)
    each = -(-bins // COARSE)
    coarse = lambda x: np.add.reduceat(np.add.reduceat(x, np.arange(0, bins, each), axis=0), np.arange(0, bins, each), axis=1)
    weight, rest = coarse(weight), coarse(rest)
    surface = rest / (weight + RIDGE)
    for _ in range(20):
        surface = surface - (surface * weight).sum(axis=1, keepdims=True) / np.maximum(weight.sum(axis=1, keepdims=True), 1e-12)
        surface = surface - (surface * weight).sum(axis=0, keepdims=True) / np.maximum(weight.sum(axis=0, keepdims=True), 1e-12)
    return float((np.abs(surface) * weight).sum() / max(weight.sum(), 1e-12))


def with_importance(measures: DataFrame, importance: DataFrame, apart: float = 20.0) -> DataFrame:
    """The table of measures with each variable's importance (its name with or without WOE_), its rank (missing ones last), the distance to the average rank
    and whether the two disagree by more than `apart`."""
    from pyspark.sql.window import Window

    plain = lambda c: F.regexp_replace(c, "^WOE_", "")
    known = importance.groupBy(plain("variable").alias("_plain")).agg(F.max("importance").alias("importance"))
    t = measures.join(known, plain("var") == F.col("_plain"), "left").drop("_plain")
    order, tie = Window.orderBy(F.col("importance").desc_nulls_last()), F.count("*").over(Window.partitionBy("importance"))  # a row per variable
    t = t.withColumn("importance_rank", F.rank().over(order) + (tie - 1) / 2)
    if "avg_rank" in t.columns:
        t = t.withColumn("rank_diff", F.abs(F.col("importance_rank") - F.col("avg_rank"))).withColumn("disagrees", F.col("rank_diff") > apart)
    return t
