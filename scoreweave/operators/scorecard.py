"""Point scorecards: building, applying and summarizing them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .ordered import quantiles


def interaction_parts(name: str) -> tuple[str, str] | None:
    """(a, b) of `WOE_a_x_WOE_b` or `a_x_b`; the first separator counts."""
    left, found, right = name.partition("_x_")
    return (left.removeprefix("WOE_"), right.removeprefix("WOE_")) if found and left and right else None


def interaction_bins(bins: DataFrame, a: str, b: str) -> DataFrame:
    """All pairs of two variables' bins with the product of their WOEs: two short lists, at most some hundred pairs."""
    side = lambda v, n: bins.where(F.col("var") == v).select(F.col("bin").alias(f"bin{n}"), F.coalesce("woe", F.lit(0.0)).alias(f"woe{n}"))
    both = side(a, 1).crossJoin(F.broadcast(side(b, 2)))
    label = F.concat(F.lit(f"{a}:"), "bin1", F.lit(f" x {b}:"), "bin2")
    return both.select(F.lit(f"{a}_x_{b}").alias("var"), label.alias("bin"), F.bround(F.col("woe1") * F.col("woe2"), 6).alias("woe"))


def build(bins: DataFrame, coefficients: dict[str, float], points: float = 600, odds: float = 20, pdo: float = 50, base_zero: bool = False) -> DataFrame:
    """(var, bin, woe, points) with the base points first.  coefficients: (Intercept), WOE_<var>, WOE_<a>_x_WOE_<b>."""
    a, b = S.scaling(points, odds, pdo)
    spark, card = bins.sparkSession, None
    base = 0.0 if base_zero else round(a - b * coefficients.get("(Intercept)", 0.0))
    card = spark.createDataFrame([("basepoints", None, None, float(base))], "var string, bin string, woe double, points double")
    for name, coefficient in coefficients.items():
        if name == "(Intercept)":
            continue
        pair = interaction_parts(name)
        rows = interaction_bins(bins, *pair) if pair else bins.where(F.col("var") == name.removeprefix("WOE_")).select("var", "bin", F.coalesce("woe", F.lit(0.0)).alias("woe"))
        card = card.unionByName(rows.withColumn("points", F.bround(F.lit(-b * coefficient) * F.col("woe"), 0)))
    return card


#: Forms of a bin's label: ours, and expressions of a variable x as other tools write them (fixed patterns).
INTERVAL = re.compile(r"\((?P<low>[^,\]]+), (?P<high>[^\]]+)\]")
NUMBER = r"(-?[0-9.]+(?:[eE][+-]?[0-9]+)?|-?[Ii]nf)"
COMPARED = re.compile(rf"(<=|>=|<|>|==)\s*{NUMBER}")
LISTED = re.compile(r"%in%\s*c?\(([^)]*)\)|==\s*['\"]([^'\"]*)['\"]")


def parsed_bin(label: str, value: Column) -> Column:
    """Whether a value lies in the bin that a label names: `(a, b]`, `<= a`, `> a`, `{u, v}`, `NA`, `all`, several of them joined by `|`, or an
    expression such as `x > 1 & x <= 2 | is.na(x)`, `x %in% c('u', 'v')`, `x == 'u'`."""
    number, text, test = S.number(value), value.cast("string"), F.lit(False)
    for part in re.split(r"\s*\|\s*", label.strip()):
        part = part.strip()
        if part in ("NA", "Missing") or "is.na" in part:
            one = value.isNull()
        elif part == "all":
            one = value.isNotNull()
        elif m := INTERVAL.fullmatch(part):
            one = (number > float(m["low"])) & (number <= float(m["high"]))
        elif part.startswith("{") and part.endswith("}"):
            one = text.isin(*(x.strip() for x in part[1:-1].split(",")))
        elif found := LISTED.findall(part):
            one = text.isin(*(x.strip().strip("'\"") for listed, single in found for x in (listed.split(",") if listed else [single])))
        elif found := COMPARED.findall(part):
            one = F.lit(True)
            for sign, bound in found:
                bound = F.lit(float(bound))
                one = one & {"<=": number <= bound, ">=": number >= bound, "<": number < bound, ">": number > bound, "==": number == bound}[sign]
        else:
            raise ValueError(f"not a bin: {label!r}")
        test = test | F.coalesce(one, F.lit(False))
    return test


def apply_values(df: DataFrame, card: DataFrame, keep: bool = True) -> DataFrame:
    """Scores raw values: each variable's bins are read from their labels, no b_ columns are needed."""
    rows = card.where("var <> 'basepoints'").collect()  # a row per bin
    labels: dict[str, Column] = {}
    for r in rows:
        if r["var"] in df.columns:
            test = parsed_bin(r["bin"], F.col(f"`{r['var']}`"))
            labels[r["var"]] = labels[r["var"]].when(test, r["bin"]) if r["var"] in labels else F.when(test, r["bin"])
    out = apply(df.withColumns({f"b_{v}": c for v, c in labels.items()}), card, keep)
    return out.drop(*(f"b_{v}" for v in labels if f"b_{v}" not in df.columns))


def apply(df: DataFrame, card: DataFrame, keep: bool = True, missing_null: bool = False) -> DataFrame:
    """df with <var>_points, basescore and Score.  The card is a few hundred rows: it becomes maps in one projection.

    Unknown labels give null points and count 0 in the sum; variables whose b_ columns are missing are left out, or with missing_null get
    null points."""
    for c in ("var", "bin", "points"):
        if c not in card.columns:
            raise ValueError(f"the card has no column {c}")
    rows = card.collect()  # a row per bin
    if len({(r["var"], r["bin"]) for r in rows}) < len(rows):
        raise ValueError("the card has a bin twice")
    base = [r["points"] for r in rows if r["var"] == "basepoints"]
    if len(base) != 1:
        raise ValueError("the card needs one row of base points")
    by_var: dict[str, dict[str, float]] = {}
    for r in rows:
        if r["var"] != "basepoints":
            by_var.setdefault(r["var"], {})[r["bin"]] = r["points"]
    names, points = [], []
    for v, known in by_var.items():
        pair = None if f"b_{v}" in df.columns else interaction_parts(v)
        if pair and all(f"b_{x}" in df.columns for x in pair):
            label = F.concat(F.lit(f"{pair[0]}:"), F.col(f"`b_{pair[0]}`"), F.lit(f" x {pair[1]}:"), F.col(f"`b_{pair[1]}`"))
        elif f"b_{v}" in df.columns:
            label = F.col(f"`b_{v}`")
        else:
            if missing_null:
                names.append(f"{v}_points")
                points.append(F.lit(None).cast("double").alias(f"{v}_points"))
            continue
        table = F.create_map(*(x for k, p in known.items() for x in (F.lit(k), F.lit(p))))
        names.append(f"{v}_points")
        points.append(table[label].alias(f"{v}_points"))
    if not names:
        raise ValueError("no column of the card is in the data")
    kept = [F.col(f"`{c}`") for c in df.columns] if keep else []
    out = df.select(*kept, *points, F.lit(base[0]).alias("basescore"))
    return out.withColumn("Score", sum((F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for n in names), F.col("basescore")))


def achievable(card: DataFrame) -> DataFrame:
    """Least and greatest score."""
    return card.groupBy("var").agg(F.min("points").alias("lo"), F.max("points").alias("hi")).agg(F.sum("lo").alias("min_score"), F.sum("hi").alias("max_score"))


def score_summary(df: DataFrame, score: str = "Score") -> DataFrame:
    c = F.col(score)
    found = quantiles(df, {score: [0.5]})[score]
    return df.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.bround(F.avg(c), 4).alias("mean"), F.lit(float(found[0]) if found else None).cast("double").alias("median"), F.bround(F.stddev_samp(c), 4).alias("std"))


def score_histogram(df: DataFrame, score: str = "Score") -> DataFrame:
    """Counts in buckets whose width is a tenth of the range, at least 50."""
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    with_ends = df.select(score).crossJoin(F.broadcast(ends))  # one row
    width = F.greatest(F.lit(50), F.floor((F.col("hi") - F.col("lo")) / 10))
    start = F.floor(F.col(score) / width) * width
    return with_ends.where(F.col(score).isNotNull()).groupBy(start.alias("bucket")).agg(F.count("*").alias("n"))
