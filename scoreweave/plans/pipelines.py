"""Whole flows: binning and the modelling chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import additive, binning, cleaning, logistic, scorecard, selection
from ..sources.shared import materialize
from .presets import WoeConfig, woe_config


@dataclass
class WoeResult:
    woe: DataFrame
    bins: DataFrame
    summary: DataFrame
    kept: binning.Bins
    dropped: list[str]
    warnings: list[tuple[str, str]]


def run_woe(df: DataFrame, target: str, variables: list[str] | None = None, config: WoeConfig | str = "default") -> WoeResult:
    """Constant columns out, bins, edits in their order, labels and WOE columns, diagnostics."""
    config = woe_config(config) if isinstance(config, str) else config
    variables = [v for v in (variables or df.columns) if v != target]
    constant = cleaning.constant_columns(df, variables)
    bins = binning.get_bins(df, target, [v for v in variables if v not in constant], config.split, max_categories=config.max_categories)
    if config.merge_pure:
        bins = bins.merge_pure()
    if config.validate:
        bins = bins.validate(config.validate_p)
    if config.group_na:
        bins = bins.na_combine()
    if config.optimise:
        bins = bins.optimise()
    spark, found = df.sparkSession, [(v, "more categories than the limit, left out") for v in bins.too_many]
    for v, own in bins.by_var.items():
        facts = binning.summary_of(v, own, bins.kinds[v])
        n = sum(b.n for b in own)
        found += [(v, "one bin")] * (len(own) == 1) + [(v, "IV below 0.02")] * (facts["iv"] < 0.02)
        found += [(v, "more than 80 % missing")] * (sum(b.n for b in own if b.missing and not b.intervals) > 0.8 * n)
        found += [(v, "no weight")] * all(abs(w) < 1e-4 for w in bins.woes(v, config.shrink, config.bayes))
    return WoeResult(bins.apply(df, config.shrink, config.bayes), bins.table(spark, config.shrink, config.bayes), bins.summary(spark), bins, constant, found)


@dataclass
class SelectionResult:
    measures: DataFrame
    chosen: list[str]
    missed: list[str]
    interactions: DataFrame
    collinear: list[tuple[str, float]]
    table: DataFrame


def run_selection(woe: WoeResult, target: str, top: int = 10, degree: int = 1, most_missed: int = 25, top_interactions: int = 10, limit: float = selection.HIGH) -> SelectionResult:
    """Measures with ranks and discovered importances, the filter, variables that only discovery finds, interactions, collinearity, and the table for
    the regression."""
    ranked = selection.ranks(selection.measures(woe.bins))
    names = [c for c in woe.woe.columns if c.startswith("WOE_")]
    weights = materialize(woe.woe.select(target, *names), "weights")  # long CASE expressions: computed once for all passes that follow
    model = additive.fit(weights, target, names)
    spark = woe.woe.sparkSession
    importance, pairs = model.importances(spark), model.interactions(spark)
    measures = additive.with_importance(ranked, importance)
    chosen = sorted(r["var"] for r in selection.choose(ranked, top, degree).collect())
    missed = [r["variable"] for r in selection.missed(importance, chosen).orderBy(F.col("importance").desc(), "variable").collect()]  # `top` rows at most
    pairs_list = [(r["variable_1"], r["variable_2"]) for r in pairs.collect()]  # 20 rows at most
    table = selection.assemble(weights, target, chosen, missed, pairs_list, most_missed, top_interactions)
    kept, gone = selection.drop_collinear(table, [c for c in table.columns if c != target], limit)
    return SelectionResult(measures, chosen, missed, pairs, gone, table.select(target, *kept))


@dataclass
class ModelResult:
    measures: DataFrame
    chosen: list[str]
    collinear: list[tuple[str, float]]
    model: logistic.Logit
    card: DataFrame
    scored: DataFrame


def run_model(woe: WoeResult, target: str, top: int = 10, degree: int = 1, direction: str = "both", points: float = 600, odds: float = 20, pdo: float = 50) -> ModelResult:
    """Measures, filter, collinearity, stepwise regression, scorecard, scores."""
    table = selection.measures(woe.bins)
    chosen = sorted(r["var"] for r in selection.choose(table, top, degree).collect())
    kept, gone = selection.drop_collinear(woe.woe, [f"WOE_{v}" for v in chosen])
    model = logistic.stepwise(woe.woe, target, kept, direction)
    card = scorecard.build(woe.bins, model.coefficients, points, odds, pdo)
    scored = scorecard.apply(logistic.predict(woe.woe, model.coefficients), card) if model.variables else logistic.predict(woe.woe, model.coefficients)
    return ModelResult(table, chosen, gone, model, card, scored)
