"""Weight-of-evidence binning.

One pass makes a fine histogram of all variables: distinct values where there are few, quantile classes (at most CLASSES, from a
mergeable quantile sketch) where there are many.  A splitter runs per variable on its histogram, the final bins' counts are
sums of classes, and rows are labelled by a generated CASE expression.  The data is read twice (sketch, histogram) and
shuffled once, as (variable, class) counts after partial aggregation.

A bin is a set of intervals (low, high], a set of values, or the missing rows: merging bins unites these sets, so no label
is ever parsed and nothing falls between bins.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from . import splitters as P

CLASSES, FEW, MAX_CATEGORIES = 512, 10, 50
#: Distinct values, by a sketch, above which no limit is near.
SURE = 1_000
STATS = "var string, bin_no int, bin string, count long, bads long, goods long, propn double, bad_rate double, good_cap double, bad_cap double, iv double, ent double, pure string, trend string, woe double"


@dataclass(frozen=True)
class Bin:
    n: int
    bads: int
    intervals: tuple[tuple[float, float], ...] = ()
    values: tuple = ()
    missing: bool = False

    @property
    def rate(self) -> float:
        return self.bads / self.n if self.n else 0.0

    @property
    def pure(self) -> bool:
        return self.bads in (0, self.n)

    def label(self) -> str:
        parts = []
        for low, high in self.intervals:
            if low == -np.inf and high == np.inf:
                parts.append("all")
            elif low == -np.inf:
                parts.append(f"<= {high:g}")
            elif high == np.inf:
                parts.append(f"> {low:g}")
            else:
                parts.append(f"({low:g}, {high:g}]")
        if self.values:
            parts.append("{" + ", ".join(map(str, self.values)) + "}")
        return " | ".join(parts + ["NA"] * self.missing)

    def holds(self, c: Column) -> Column:
        test = F.lit(False)
        for low, high in self.intervals:
            inside = F.lit(True) if low == -np.inf else c > F.lit(float(low))
            inside = inside if high == np.inf else inside & (c <= F.lit(float(high)))
            test = test | (inside & c.isNotNull())
        if self.values:
            test = test | c.isin(*self.values)
        return test | c.isNull() if self.missing else test


def united(a: Bin, b: Bin) -> Bin:
    spans: list[tuple[float, float]] = []
    for low, high in sorted(a.intervals + b.intervals):
        if spans and spans[-1][1] == low:
            spans[-1] = (spans[-1][0], high)
        else:
            spans.append((low, high))
    return Bin(a.n + b.n, a.bads + b.bads, tuple(spans), tuple(sorted(set(a.values + b.values), key=str)), a.missing or b.missing)


@dataclass
class Bins:
    """The bins of each variable.  Edits return new objects; `reset` gives the first ones back."""

    by_var: dict[str, list[Bin]]
    kinds: dict[str, str]
    first: dict[str, list[Bin]] = field(default=None)
    too_many: list[str] = field(default_factory=list)  # factors with more categories than the limit
    categories: dict[str, list[Bin]] = field(default_factory=dict)  # a factor's bins before categories were grouped

    def __post_init__(self) -> None:
        self.first = self.first or {v: list(b) for v, b in self.by_var.items()}

    def _edited(self, change, variables=None) -> Bins:
        return replace(self, by_var={v: change(list(b)) if variables is None or v in variables else list(b) for v, b in self.by_var.items()})

    def reset(self, variables=None) -> Bins:
        return replace(self, by_var={v: list(self.first[v] if variables is None or v in variables else b) for v, b in self.by_var.items()})

    def na_combine(self, variables=None) -> Bins:
        """The missing bin joins the bin nearest in bad rate, unless only one other bin is there."""

        def change(bins: list[Bin]) -> list[Bin]:
            na = [b for b in bins if b.missing and not b.intervals and not b.values]
            rest = [b for b in bins if b not in na]
            if not na or len(rest) <= 1:
                return bins
            k = min(range(len(rest)), key=lambda i: abs(rest[i].rate - na[0].rate))
            rest[k] = united(rest[k], na[0])
            return rest

        return self._edited(change, variables)

    def merge_pure(self, variables=None) -> Bins:
        """A bin of one class joins the nearest mixed one in bad rate; if all are pure, the one nearest in size."""

        def change(bins: list[Bin]) -> list[Bin]:
            while len(bins) > 1 and any(b.pure for b in bins):
                k = next(i for i, b in enumerate(bins) if b.pure)
                others = [i for i in range(len(bins)) if i != k]
                mixed = [i for i in others if not bins[i].pure]
                to = min(mixed, key=lambda i: abs(bins[i].rate - bins[k].rate)) if mixed else min(others, key=lambda i: abs(bins[i].n - bins[k].n))
                bins[to] = united(bins[to], bins[k])
                del bins[k]
            return bins

        return self._edited(change, variables)

    def validate(self, p: float = 0.10, floor: int = 2, variables=None) -> Bins:
        """Neighbours that do not differ (chi-square p above the bound) are merged, the likest first."""

        def change(bins: list[Bin]) -> list[Bin]:
            na, bins = [b for b in bins if b.missing], [b for b in bins if not b.missing]
            while len(bins) > floor:
                ps = [P.p_value(float(P.chi_square(a.n, a.bads, b.n, b.bads))) for a, b in zip(bins, bins[1:])]
                k = int(np.argmax(ps))
                if ps[k] <= p:
                    break
                bins[k : k + 2] = [united(bins[k], bins[k + 1])]
            return bins + na

        return self._edited(change, variables)

    def force_trend(self, increasing: bool, variables=None) -> Bins:
        """Neighbours against the trend of the bad rate are merged; the missing bin stays out of it."""

        def change(bins: list[Bin]) -> list[Bin]:
            na, out = [b for b in bins if b.missing and not b.intervals], []
            for b in (b for b in bins if b not in na):
                out.append(b)
                while len(out) > 1 and (out[-1].rate < out[-2].rate if increasing else out[-1].rate > out[-2].rate):
                    last = out.pop()
                    out[-1] = united(out[-1], last)
            return out + na

        return self._edited(change, variables)

    def optimise(self) -> Bins:
        """Missing rows joined, then every variable forced along its own trend."""
        out = self.na_combine()
        up = {v for v, b in out.by_var.items() if summary_of(v, b, self.kinds[v])["trend"] == "I"}
        return out.force_trend(True, up).force_trend(False, set(out.by_var) - up)

    def break_bin(self, variable: str) -> Bins:
        """One bin per category, also where categories were grouped from the start (a number: back to its first bins)."""
        one = self.categories.get(variable)
        return replace(self, by_var=self.by_var | {variable: list(one)}) if one else self.reset({variable})

    def table(self, spark, shrink: float = 0.0, bayes: float = 0.0) -> DataFrame:
        rows = [r for v, bins in self.by_var.items() for r in stats_of(v, bins, shrink, bayes)]
        return spark.createDataFrame(rows, STATS)

    def summary(self, spark) -> DataFrame:
        rows = [summary_of(v, bins, self.kinds[v]) for v, bins in self.by_var.items()]
        return spark.createDataFrame(rows, "var string, var_type string, iv double, ent double, trend string, mon_trend string, flip_ratio double, num_bins int, pure string")

    def woes(self, variable: str, shrink: float = 0.0, bayes: float = 0.0) -> list[float]:
        return [r["woe"] for r in stats_of(variable, self.by_var[variable], shrink, bayes)]

    def apply(self, df: DataFrame, shrink: float = 0.0, bayes: float = 0.0) -> DataFrame:
        """df with b_<var> (label) and WOE_<var> for every variable: one projection, no join, no shuffle."""
        labels, values = [], []
        for v, bins in self.by_var.items():
            label, woe = F.lit(None).cast("string"), F.lit(0.0)
            for b, w in zip(reversed(bins), reversed(self.woes(v, shrink, bayes))):
                test = b.holds(F.col(f"`{v}`"))
                label, woe = F.when(test, b.label()).otherwise(label), F.when(test, w).otherwise(woe)
            labels.append(label.alias(f"b_{v}"))
            values.append(woe.alias(f"WOE_{v}"))
        return df.select("*", *labels, *values)


def stats_of(v: str, bins: list[Bin], shrink: float = 0.0, bayes: float = 0.0) -> list[dict]:
    n, b = np.array([x.n for x in bins], float), np.array([x.bads for x in bins], float)
    g, rows, out, before = n - b, float(n.sum()), [], None
    cap_b, cap_g = (np.where(x > 0, x / x.sum() if x.sum() else 0.0, 0.0) for x in (b, g))
    if bayes and b.sum() and g.sum():
        r = b.sum() / rows
        alpha, beta = max(bayes * r, 0.5), max(bayes * (1 - r), 0.5)
        top, low = (b + alpha * n / rows) / (b.sum() + alpha), (g + beta * n / rows) / (g.sum() + beta)
        woe = np.log(np.maximum(top, S.SMALL) / np.maximum(low, S.SMALL))
    elif b.sum() and g.sum():
        woe = np.log(np.where(b > 0, cap_b, S.SMALL) / np.where(g > 0, cap_g, S.SMALL))
        woe = woe * n / (n + shrink * rows / len(bins)) if shrink else woe
    else:
        woe = np.zeros(len(bins))
    for k, x in enumerate(bins):
        p = x.rate
        trend = None if before is None or x.missing and not x.intervals else "I" if p >= before else "D"
        ent = -(p * np.log2(p) + (1 - p) * np.log2(1 - p)) if 0 < p < 1 else 0.0
        out.append(
            {"var": v, "bin_no": k + 1, "bin": x.label(), "count": x.n, "bads": x.bads, "goods": x.n - x.bads, "propn": round(100 * x.n / rows, 2) if rows else 0.0, "bad_rate": round(100 * p, 2), "good_cap": float(cap_g[k]), "bad_cap": float(cap_b[k]), "iv": round(float((cap_b[k] - cap_g[k]) * woe[k]), 4), "ent": round(float(ent), 4), "pure": "Y" if x.pure else "N", "trend": trend, "woe": round(float(woe[k]), 5)}
        )
        before = p
    return out


def summary_of(v: str, bins: list[Bin], kind: str) -> dict:
    rows = stats_of(v, bins)
    n = sum(r["count"] for r in rows)
    steps = [r["trend"] for r in rows if r["trend"]]
    up, down = steps.count("I"), steps.count("D")
    return {"var": v, "var_type": kind, "iv": round(sum(r["iv"] for r in rows), 4), "ent": round(float(sum(r["ent"] * r["count"] for r in rows)) / n, 4) if n else 0.0, "trend": "I" if up >= down else "D", "mon_trend": "Y" if min(up, down) == 0 else "N", "flip_ratio": min(up, down) / len(steps) if steps else 0.0, "num_bins": len(rows), "pure": "Y" if any(r["pure"] == "Y" for r in rows) else "N"}


def credible_interval(b: Bin, all_bads: int, all_n: int, prior: float = 10.0, draws: int = 1000, seed: int = 1) -> tuple[float, float]:
    """95 % interval of a bin's WOE from Beta draws around the overall rate."""
    r = all_bads / all_n
    x = np.random.default_rng(seed).beta(b.bads + max(prior * r, 0.5), b.n - b.bads + max(prior * (1 - r), 0.5), draws)
    low, high = np.percentile(np.log(x / (1 - x)) - np.log(r / (1 - r)), [2.5, 97.5])
    return round(float(low), 5), round(float(high), 5)


# ---------------------------------------------------------------- from data to bins


def kinds_of(df: DataFrame, variables: list[str], few: int = FEW) -> tuple[dict[str, str], dict[str, int]]:
    """variable -> factor or numeric (a number with at most `few` distinct values is a factor), and distinct counts.

    A sketch tells the variables with many values apart (its error is far below the margin); the others are counted exactly, in one
    pass over all of them with some hundred values each."""
    row = df.agg(*(F.approx_count_distinct(f"`{v}`", 0.02).alias(str(k)) for k, v in enumerate(variables))).first()
    counts = {v: row[k] for k, v in enumerate(variables)}
    near = [v for v in variables if counts[v] <= SURE]
    if near:
        pairs = F.array(*(F.struct(F.lit(v).alias("var"), F.col(f"`{v}`").cast("string").alias("value")) for v in near))
        exact = df.select(F.explode(pairs).alias("x")).where("x.value is not null").groupBy("x.var", "x.value").agg(F.count("*")).groupBy("var").count()
        counts |= {v: 0 for v in near} | {r["var"]: r["count"] for r in exact.collect()}  # a row per variable
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    return {v: "numeric" if v in numeric and counts[v] > few else "factor" for v in variables}, counts


def fine_histogram(df: DataFrame, target: str, variables: list[str], distinct: dict[str, int], classes: int = CLASSES) -> DataFrame:
    """(var, high, count, bads, low): each numeric variable's classes (the missing rows have a null high)."""
    many = [v for v in variables if distinct[v] > classes]
    edges: dict[str, list[float]] = {}
    if many:
        at = [k / classes for k in range(1, classes)]
        row = df.agg(*(F.percentile_approx(F.col(f"`{v}`").cast("double"), at, 20 * classes).alias(str(k)) for k, v in enumerate(many))).first()
        edges = {v: sorted(set(row[k] or [])) for k, v in enumerate(many)}

    x = {v: F.when(~F.isnan(F.col(f"`{v}`").cast("double")), F.col(f"`{v}`").cast("double")) for v in variables}
    t = df.where(F.col(target).isNotNull()).select(F.col(target).alias("y"), *(x[v].alias(f"x{k}") for k, v in enumerate(variables)), *((-x[v]).alias(f"n{k}") for k, v in enumerate(variables) if v in edges))
    found = [k for k, v in enumerate(variables) if v in edges]
    if found:  # the classes are closed on the right, those of the bucketizer on the left: it looks at the negative values
        splits = [[-np.inf, *(-e for e in reversed(edges[variables[k]])), np.inf] for k in found]
        t = Bucketizer(splitsArray=splits, inputCols=[f"n{k}" for k in found], outputCols=[f"c{k}" for k in found], handleInvalid="keep").transform(t)

    def classed(k: int, v: str) -> Column:
        if v not in edges:
            return F.col(f"x{k}")
        highs = F.array(*(F.lit(float(h)) for h in [np.inf, *reversed(edges[v])]))
        return F.when(F.col(f"x{k}").isNotNull(), F.element_at(highs, (F.col(f"c{k}") + 1).cast("int")))

    pairs = F.array(*(F.struct(F.lit(v).alias("var"), classed(k, v).alias("high"), F.col(f"x{k}").alias("x")) for k, v in enumerate(variables)))
    long = t.select("y", F.explode(pairs).alias("p")).select("y", "p.var", "p.high", "p.x")
    return long.groupBy("var", "high").agg(F.count("*").alias("count"), F.sum(F.col("y").cast("long")).alias("bads"), F.min("x").alias("low"))


def get_bins(df: DataFrame, target: str, variables: list[str], config: P.Split = P.Split(), splits: dict[str, list[float]] | None = None, max_categories: int = MAX_CATEGORIES) -> Bins:
    """Bins of all variables; `splits` fixes the upper ends of a variable's bins (manual splitting)."""
    splits = splits or {}
    kinds, distinct = kinds_of(df, variables)
    numeric = [v for v in variables if kinds[v] == "numeric"]
    by_var: dict[str, list[Bin]] = {}
    categories: dict[str, list[Bin]] = {}
    if numeric:
        fine = fine_histogram(df, target, numeric, distinct)

        def cut(pdf: pd.DataFrame) -> pd.DataFrame:
            v, known = pdf["var"].iloc[0], pdf[pdf["high"].notna()].sort_values("high")
            n, b, high = known["count"].to_numpy(), known["bads"].to_numpy(), known["high"].to_numpy()
            if v in splits:
                cuts = sorted({int(k) - 1 for k in np.searchsorted(high, splits[v], side="right") if 0 < k < len(n)})
            else:
                cuts = P.split(n, b, config)
            start, rows = [0, *(k + 1 for k in cuts)], []
            for a, z in zip(start, [*start[1:], len(n)]):
                if z > a:
                    rows.append((v, -np.inf if a == 0 else float(high[a - 1]), np.inf if z == len(n) else float(high[z - 1]), False, int(n[a:z].sum()), int(b[a:z].sum())))
            na = pdf[pdf["high"].isna()]
            if len(na):
                rows.append((v, np.nan, np.nan, True, int(na["count"].sum()), int(na["bads"].sum())))
            return pd.DataFrame(rows, columns=["var", "low", "high", "missing", "count", "bads"])

        found = fine.groupBy("var").applyInPandas(cut, "var string, low double, high double, missing boolean, count long, bads long").collect()  # max_bins rows a variable
        for r in sorted(found, key=lambda r: (r["missing"], r["low"])):
            by_var.setdefault(r["var"], []).append(Bin(r["count"], r["bads"], () if r["missing"] else ((r["low"], r["high"]),), (), r["missing"]))
    for v in (v for v in variables if kinds[v] == "factor" and distinct[v] <= max_categories):
        counts = df.where(F.col(target).isNotNull()).groupBy(F.col(f"`{v}`").alias("value")).agg(F.count("*").alias("n"), F.sum(F.col(target).cast("long")).alias("bads")).collect()  # at most max_categories rows
        one = [Bin(r["n"], r["bads"], (), (r["value"],)) for r in sorted((r for r in counts if r["value"] is not None), key=lambda r: str(r["value"]))]
        missing = [Bin(r["n"], r["bads"], missing=True) for r in counts if r["value"] is None]
        by_var[v], categories[v] = _grouped(one, config.max_bins) + missing, one + missing
    too_many = [v for v in variables if kinds[v] == "factor" and distinct[v] > max_categories]
    return Bins({v: by_var[v] for v in variables if by_var.get(v)}, {v: kinds[v] for v in variables if by_var.get(v)}, too_many=too_many, categories=categories)


def _grouped(one: list[Bin], most: int) -> list[Bin]:
    """A bin per category, or categories of like WOE together if there are more than `most`."""
    if len(one) <= most:
        return one
    woe = P._woe([b.n for b in one], [b.bads for b in one])[0]
    edges, out = np.unique(np.quantile(woe, np.linspace(0, 1, most + 1)))[1:-1], {}
    for k, b in zip(np.searchsorted(edges, woe, side="left"), one):
        out[k] = united(out[k], b) if k in out else b
    return [out[k] for k in sorted(out)]
