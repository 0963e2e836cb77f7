"""Production monitoring: business metrics, drift against a baseline, calibration, deciles, recommendation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from . import evaluation as E


@dataclass(frozen=True)
class Columns:
    score: str = "score"
    bad: str = "isBad"
    approved: str = "isApproved"
    funded: str = "isFunded"
    roi: str | None = "ROI"


@dataclass(frozen=True)
class Thresholds:
    psi_warning: float = 0.10
    psi_critical: float = 0.25
    auc_warning: float = 0.03
    auc_critical: float = 0.05
    ks_warning: float = 0.05
    ks_critical: float = 0.10
    bad_rate_warning: float = 0.02
    calibration_warning: float = 0.05
    least_funded: int = 500


def business(df: DataFrame, c: Columns = Columns()) -> DataFrame:
    """One row of counts and rates; performance is measured on funded loans."""
    funded = F.col(c.funded) == 1
    roi = F.when(funded, F.col(c.roi)) if c.roi else F.lit(None).cast("double")
    r = lambda x, name: F.bround(x, 6).alias(name)
    found = E.quantiles(df.select(roi.cast("double").alias("roi")), {"roi": [0.5]})["roi"] if c.roi else []
    middle = float(found[0]) if found else None
    return df.agg(
        F.count("*").alias("total_applications"), F.sum(c.approved).alias("approvals"), r(F.avg(c.approved), "approval_rate"), F.sum(c.funded).alias("funded"), r(F.avg(c.funded), "funding_rate"),
        F.count_if(funded).alias("funded_count"), F.sum(F.when(funded, F.col(c.bad))).alias("bads_funded"), r(F.avg(F.when(funded, F.col(c.bad))), "bad_rate_funded"),
        r(F.avg(roi), "avg_roi"), F.bround(F.lit(middle).cast("double"), 6).alias("median_roi"), r(F.stddev_samp(roi), "roi_std"), F.count_if(funded & (roi < 1)).alias("losses_count"), r(F.count_if(funded & (roi < 1)) / F.nullif(F.count_if(funded), F.lit(0)), "loss_rate"),
    )


def with_probability(df: DataFrame, a: float, b: float, c: Columns = Columns()) -> DataFrame:
    return df.withColumn("probability", S.probability_from_score(F.col(c.score), a, b))


def calibration(df: DataFrame, actual: str, p: str = "probability", bins: int = 10) -> DataFrame:
    """(bin, count, actual_bads, observed_rate, predicted_rate, difference, calibrated) over quantile bins."""
    kept = df.where(F.col(actual).isNotNull() & F.col(p).isNotNull())
    inner = E.quantile_edges(kept, p, bins)[1:-1]
    t = kept.groupBy((E.bucket(F.col(p), inner) + 1).alias("bin")).agg(F.count("*").alias("count"), F.sum(actual).cast("long").alias("actual_bads"), F.avg(actual).alias("o"), F.avg(p).alias("p"))
    return t.select("bin", "count", "actual_bads", F.bround("o", 6).alias("observed_rate"), F.bround("p", 6).alias("predicted_rate"), F.bround(F.col("o") - F.col("p"), 6).alias("difference"), (F.abs(F.col("o") - F.col("p")) < 0.05).alias("calibrated"))


def score_decile(df: DataFrame, c: Columns = Columns()):
    """The quantile group of a score, 1 the highest; groups whose edges coincide are one."""
    inner = E.quantile_edges(df.where(F.col(c.score).isNotNull()), c.score, 10)[1:-1]
    return F.lit(len(inner) + 1) - E.bucket(F.col(c.score), inner)


def diagnostics(df: DataFrame, c: Columns = Columns()) -> DataFrame:
    """df with prediction_correct (funded loans only) and score_decile (1 the highest scores of all loans)."""
    right = ((F.col("probability") > 0.5).cast("int") == F.col(c.bad)).cast("int")
    return df.withColumns({"prediction_correct": F.when(F.col(c.funded) == 1, right), "score_decile": score_decile(df, c)})


def deciles(df: DataFrame, c: Columns = Columns()) -> DataFrame:
    """Quantile groups of the score, 1 the highest; groups whose edges coincide are one."""
    at = score_decile(df, c)
    run = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    r = lambda x, name: F.bround(x, 4).alias(name)
    roi = [r(F.avg(c.roi), "avg_roi")] if c.roi else []
    t = df.where(F.col(c.score).isNotNull()).groupBy(at.alias("decile")).agg(F.count("*").alias("count"), F.min(c.score).alias("score_min"), F.max(c.score).alias("score_max"), F.bround(F.avg(c.score), 0).alias("score_avg"), r(F.avg(c.bad), "bad_rate"), F.sum(c.bad).cast("long").alias("bad_count"), r(F.avg(c.approved), "approval_rate"), *roi)
    t = t.withColumns({"cumulative_bads": F.sum("bad_count").over(run), "cumulative_count": F.sum("count").over(run)})
    return t.withColumn("cumulative_bad_rate", F.bround(F.col("cumulative_bads") / F.col("cumulative_count"), 4))


def recommendation(metrics: dict[str, float | None], t: Thresholds = Thresholds()) -> str:
    """RETRAIN if any metric is critical, MONITOR if any is in its warning range, else OK."""
    get = lambda k: metrics[k] if metrics.get(k) is not None and metrics[k] == metrics[k] else None
    psi, auc, ks, bad, cal = (get(k) for k in ("PSI", "AUC_Delta", "KS_Delta", "BadRate_Delta", "Calibration_Error"))
    critical = (psi is not None and psi >= t.psi_critical, auc is not None and auc <= -t.auc_critical, ks is not None and ks <= -t.ks_critical)
    warning = (
        psi is not None and psi >= t.psi_warning,
        auc is not None and auc <= -t.auc_warning,
        ks is not None and ks <= -t.ks_warning,
        bad is not None and bad >= t.bad_rate_warning,
        cal is not None and cal >= t.calibration_warning,
    )
    return "RETRAIN" if any(critical) else "MONITOR" if any(warning) else "OK"


def advice(psi, auc_delta, ks_delta, bad_rate_delta, t: Thresholds = Thresholds()):
    """`recommendation` over columns: nulls raise no alarm."""
    said = lambda *checks: F.coalesce(F.greatest(*(F.coalesce(c, F.lit(False)) for c in checks)), F.lit(False))
    critical = said(psi >= t.psi_critical, auc_delta <= -t.auc_critical, ks_delta <= -t.ks_critical)
    warning = said(psi >= t.psi_warning, auc_delta <= -t.auc_warning, ks_delta <= -t.ks_warning, bad_rate_delta >= t.bad_rate_warning)
    return F.when(critical, "RETRAIN").when(warning, "MONITOR").otherwise("OK")


@dataclass
class Report:
    summary: DataFrame
    deciles: DataFrame
    calibration: DataFrame
    diagnostics: DataFrame
    recommendation: str


def monitor(current: DataFrame, baseline: DataFrame | None = None, points: float = 600, odds: float = 20, pdo: float = 50, c: Columns = Columns(), t: Thresholds = Thresholds()) -> Report:
    """The whole report.  Aggregates are a row each; the diagnostics stay lazy, one row per loan."""
    a, b = S.scaling(points, odds, pdo)
    now = with_probability(current, a, b, c)
    funded = now.where(F.col(c.funded) == 1)
    facts = business(now, c).first().asDict()

    def measured(df: DataFrame) -> dict:
        return E.discrimination(E.histogram(df, c.bad, "probability"), 4).first().asDict() if df.limit(10).count() == 10 else {}

    mine, theirs, metrics = measured(funded), {}, {}
    cal = calibration(funded, c.bad)
    error = cal.agg(F.sum(F.abs("difference") * F.col("count")) / F.sum("count")).first()[0]
    metrics["Calibration_Error"], base_rate, base_n = error, None, None
    if baseline is not None:
        before = with_probability(baseline, a, b, c).where(F.col(c.funded) == 1)
        theirs = measured(before)
        base_rate, base_n = before.agg(F.avg(c.bad), F.count("*")).first()
        metrics["PSI"] = E.psi(baseline, current, c.score, mode="add", eps=1e-4, right=True, digits=6).first()[0]
        diff = lambda k: mine[k] - theirs[k] if mine.get(k) is not None and theirs.get(k) is not None else None
        metrics |= {"AUC_Delta": diff("auc"), "Gini_Delta": diff("gini"), "KS_Delta": diff("ks")}
        if base_rate is not None and facts["bad_rate_funded"] is not None:
            metrics["BadRate_Delta"] = facts["bad_rate_funded"] - base_rate
    advice = recommendation(metrics, t)

    def fall(delta, warn, crit):
        return "OK" if delta is None or delta > -warn else "CRITICAL" if delta <= -crit else "WARNING"

    psi, auc, ks, bad = (metrics.get(k) for k in ("PSI", "AUC_Delta", "KS_Delta", "BadRate_Delta"))
    auc_status = fall(auc, t.auc_warning, t.auc_critical)
    rows = [
        ("Sample Size (Funded)", facts["funded_count"], base_n, None, "OK" if facts["funded_count"] >= t.least_funded else "WARNING", None),
        ("AUC", mine.get("auc"), theirs.get("auc"), auc, auc_status, None),
        ("Gini", mine.get("gini"), theirs.get("gini"), metrics.get("Gini_Delta"), auc_status, None),
        ("K-S Statistic", mine.get("ks"), theirs.get("ks"), ks, fall(ks, t.ks_warning, t.ks_critical), None),
        ("PSI (Score)", psi, None, None, "OK" if psi is None or psi < t.psi_warning else "CRITICAL" if psi >= t.psi_critical else "WARNING", None),
        ("Approval Rate", facts["approval_rate"], None, None, "INFO", None),
        ("Bad Rate (Funded)", facts["bad_rate_funded"], base_rate, bad, "WARNING" if bad is not None and bad >= t.bad_rate_warning else "OK", None),
        ("Avg ROI (Funded)", facts["avg_roi"], None, None, "INFO", None),
        ("Calibration Error", error, None, None, "WARNING" if error is not None and error >= t.calibration_warning else "OK", None),
        ("Recommendation", None, None, None, advice, advice),
    ]
    rows = [(m, *(None if x is None else float(x) for x in v), s, text) for m, *v, s, text in rows]
    summary = current.sparkSession.createDataFrame(rows, "metric string, current double, baseline double, delta double, status string, text string")
    return Report(summary, deciles(funded, c), cal, diagnostics(now, c), advice)
