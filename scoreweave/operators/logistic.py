"""Logistic regression on grouped rows, with stepwise selection by AIC.

WOE columns hold few distinct values, so rows are grouped to distinct patterns with (n, events) once; every fit reads the
patterns.  A fit is Newton's method where each step is one aggregate that Spark sums: gradient and Hessian, p * p numbers,
come to the driver, rows never do.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import erfc, exp, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

#: The 97.5 % point of the normal distribution (fixed value).
NORMAL_95 = 1.959963984540054


@dataclass
class Logit:
    variables: list[str]
    beta: np.ndarray
    loglik: float
    errors: np.ndarray
    separated: bool = False  # the likelihood has no maximum: an L1 penalty keeps the coefficients finite
    steps: list[tuple[str, str, float]] = field(default_factory=list)

    def aic(self, k: float = 2.0) -> float:
        return -2 * self.loglik + k * (len(self.variables) + 1)

    @property
    def coefficients(self) -> dict[str, float]:
        return dict(zip(["(Intercept)", *self.variables], (float(b) for b in self.beta)))

    def table(self, spark) -> DataFrame:
        """Coefficients with standard error, z, two-sided p-value, odds ratio and its 95 % interval."""
        rows = []
        for (v, b), e in zip(self.coefficients.items(), map(float, self.errors)):
            ratio = [exp(min(x, 700.0)) for x in (b, b - NORMAL_95 * e, b + NORMAL_95 * e)]
            rows.append((v, b, e, b / e if e else None, erfc(abs(b / e) / sqrt(2)) if e else None, *ratio))
        return spark.createDataFrame(rows, "Variable string, coefficient double, std_error double, z double, p_value double, odds_ratio double, odds_low double, odds_high double")


def choose_columns(df: DataFrame, target: str) -> list[str]:
    """All WOE_ columns if there are any, else all but the labels."""
    woe = [c for c in df.columns if c.startswith("WOE_") and c != target]
    return woe or [c for c in df.columns if not c.startswith("b_") and c != target]


def patterns(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Distinct complete patterns with rows and events; persisted, as every step reads them."""
    full = df.select(F.col(f"`{target}`").alias("_y"), *(F.col(f"`{c}`").cast("double").alias(c) for c in columns)).dropna()
    return full.groupBy(*(F.col(f"`{c}`") for c in columns)).agg(F.count("*").cast("double").alias("_n"), F.sum("_y").cast("double").alias("_e")).persist()


#: Patterns that are looked at on the driver, once they are counted to be so few.
FEW = 20_000


class Local:
    """Few patterns as arrays: the same sums as over the table, without a job for each."""

    def __init__(self, grouped: DataFrame, columns: list[str]) -> None:
        rows = np.array([tuple(map(float, r)) for r in grouped.select(*(F.col(f"`{c}`") for c in columns), "_n", "_e").collect()]).reshape(-1, len(columns) + 2)
        self.values, self.n, self.e = dict(zip(columns, rows.T)), rows[:, -2], rows[:, -1]

    def sums(self, columns: list[str], beta: np.ndarray) -> tuple[float | None, np.ndarray, np.ndarray]:
        if not len(self.n):
            return None, np.zeros(len(beta)), np.eye(len(beta))
        x = np.column_stack([np.ones(len(self.n)), *(self.values[c] for c in columns)])
        mu = 1 / (1 + np.exp(-x @ beta))
        q = np.clip(mu, 1e-15, 1 - 1e-15)
        loglik = float((self.e * np.log(q) + (self.n - self.e) * np.log(1 - q)).sum())
        return loglik, x.T @ (self.e - self.n * mu), (x * (self.n * mu * (1 - mu))[:, None]).T @ x


def _sums(grouped: DataFrame, columns: list[str], beta: np.ndarray) -> tuple[float | None, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and Hessian in one aggregate."""
    x = [F.lit(1.0), *(F.col(f"`{c}`") for c in columns)]
    at = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    eta = sum((F.lit(float(b)) * v for b, v in zip(beta[1:], x[1:])), F.lit(float(beta[0])))
    mu = S.sigmoid(eta)
    q = F.greatest(F.least(mu, F.lit(1 - 1e-15)), F.lit(1e-15))
    held = grouped.select(*(v.alias(f"x{i}") for i, v in enumerate(x)), (F.col("_e") - F.col("_n") * mu).alias("r"), (F.col("_n") * mu * (1 - mu)).alias("w"), (F.col("_e") * F.log(q) + (F.col("_n") - F.col("_e")) * F.log(1 - q)).alias("l"))
    row = held.agg(F.sum("l").alias("l"), *(F.sum(F.col(f"x{i}") * F.col("r")).alias(f"g{i}") for i in range(len(x))), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}") * F.col("w")).alias(f"h{i}_{j}") for i, j in at)).first()
    hessian = np.zeros((len(x), len(x)))
    if row["l"] is None:
        return None, np.zeros(len(x)), hessian
    for i, j in at:
        hessian[i, j] = hessian[j, i] = row[f"h{i}_{j}"]
    return row["l"], np.array([row[f"g{i}"] for i in range(len(x))]), hessian


def sums_of(grouped: DataFrame | Local, columns: list[str], beta: np.ndarray) -> tuple[float | None, np.ndarray, np.ndarray]:
    return grouped.sums(columns, beta) if isinstance(grouped, Local) else _sums(grouped, columns, beta)


#: Share of its first weight below which a coefficient's information counts as lost; weight of the L1 penalty (fixed value).
SEPARATED, ALPHA = 1e-5, 0.01


def fit_l1(grouped: DataFrame | Local, columns: list[str], alpha: float = ALPHA, most: int = 200) -> Logit:
    """The greatest log-likelihood less alpha times the sizes of all coefficients, the intercept's too.

    Each round reads gradient and Hessian (the weighted Gram matrix of the patterns) in one aggregate and solves the penalised
    quadratic by coordinate descent; steps are halved until the objective grows.  Errors are those of the coefficients that are not 0."""
    beta = np.zeros(len(columns) + 1)
    now, gradient, hessian = sums_of(grouped, columns, beta)
    if now is None:
        return Logit(list(columns), beta, 0.0, np.zeros(len(beta)), True)
    goal = now - alpha * np.abs(beta).sum()
    for _ in range(most):
        damped = hessian + 1e-10 * np.eye(len(beta)) * max(1.0, float(np.trace(hessian)))
        aim, slack = beta.copy(), gradient.copy()  # slack: gradient of the quadratic at aim
        for _ in range(1_000):
            moved = 0.0
            for j in range(len(beta)):
                z = slack[j] + damped[j, j] * aim[j]
                new = float(np.sign(z) * max(abs(z) - alpha, 0.0) / damped[j, j])
                if new != aim[j]:
                    slack -= damped[:, j] * (new - aim[j])
                    moved, aim[j] = max(moved, abs(new - aim[j])), new
            if moved < 1e-10:
                break
        step = aim - beta
        for _ in range(30):
            tried, gradient, hessian = sums_of(grouped, columns, beta + step)
            if tried - alpha * np.abs(beta + step).sum() >= goal:
                break
            step = step / 2
        else:
            break
        gain, goal, beta, now = tried - alpha * np.abs(beta + step).sum() - goal, tried - alpha * np.abs(beta + step).sum(), beta + step, tried
        if gain < 1e-12 * (abs(goal) + 1) or np.abs(step).max() < 1e-9:
            break
    live = beta != 0
    errors = np.zeros(len(beta))
    errors[live] = np.sqrt(np.maximum(np.diag(np.linalg.pinv(hessian[np.ix_(live, live)])), 0))
    return Logit(list(columns), beta, float(now), errors, True)


def fit(grouped: DataFrame | Local, columns: list[str], start: dict[str, float] | None = None, ridge: float = 1e-8, most: int = 50) -> Logit:
    """Newton's method, from the coefficients in `start` (others 0) if given.  Where the outcome is separated, the L1-penalised fit."""
    beta = np.array([(start or {}).get(c, 0.0) for c in ("(Intercept)", *columns)])
    hessian, loglik, first, step = np.eye(len(beta)), -np.inf, None, np.zeros(len(beta))
    for _ in range(most):
        now, gradient, hessian = sums_of(grouped, columns, beta)
        if now is None:
            return Logit(list(columns), beta, 0.0, np.zeros(len(beta)))
        first = np.diag(hessian) if first is None else np.maximum(first, np.diag(hessian))
        gain = now - loglik
        if abs(gain) < 1e-9 * (abs(now) + 1):
            loglik = now
            break
        if gain < 0:  # too far: back half of the way
            step = step / 2
            beta = beta - step
            continue
        loglik, step = now, np.linalg.solve(hessian + ridge * np.eye(len(beta)), gradient)
        beta = beta + step
    if first is not None and (np.diag(hessian) < SEPARATED * first).any() or not np.isfinite(beta).all():
        return fit_l1(grouped, columns)
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(hessian)), 0))
    return Logit(list(columns), beta, float(loglik), errors)


def stepwise(df: DataFrame, target: str, columns: list[str], direction: str = "both", k: float = 2.0) -> Logit:
    """forward starts empty; backward and both start full.  A step is taken while it lowers AIC (penalty k) strictly."""
    grouped = patterns(df, target, columns)
    try:
        known = Local(grouped, columns) if grouped.count() <= FEW else grouped
        model = fit(known, [] if direction == "forward" else columns)
        steps = [("start", "", model.aic(k))]
        for _ in range(2 * len(columns) + 1):
            moves = []
            if direction != "backward":
                moves += [("add", v, [*model.variables, v]) for v in columns if v not in model.variables]
            if direction != "forward":
                moves += [("drop", v, [x for x in model.variables if x != v]) for v in model.variables]
            tried = [(fit(known, vs, model.coefficients), what, v) for what, v, vs in moves]
            best = min(tried, key=lambda t: t[0].aic(k), default=None)
            if best is None or best[0].aic(k) >= model.aic(k):
                break
            model = best[0]
            steps.append((best[1], best[2], model.aic(k)))
        model.steps = steps
        return model
    finally:
        grouped.unpersist()


def diagnose(df: DataFrame, columns: list[str], limit: float = 0.85, high: float = 10.0, least: float = 1e-10) -> DataFrame:
    """(issue, a, b, value): variables of next to no variance, pairs correlated above `limit` (by size) and variables whose VIF is above
    `high`; what stands in the way of a stable fit."""
    from . import selection as V

    low = V.variances(df, columns, least).where("low").select(F.lit("low variance").alias("issue"), F.col("variable").alias("a"), F.lit(None).cast("string").alias("b"), F.col("variance").alias("value"))
    if len(columns) < 2:
        return low
    pairs = V.correlated_pairs(df, columns, limit).select(F.lit("high correlation").alias("issue"), "a", "b", F.abs("r").alias("value"))
    inflated = V.vif(df, columns).where(F.col("vif") > high).select(F.lit("high vif").alias("issue"), F.col("variable").alias("a"), F.lit(None).cast("string").alias("b"), F.col("vif").alias("value"))
    return low.union(pairs).union(inflated)


def predict(df: DataFrame, coefficients: dict[str, float], cut: float = 0.5, inclusive: bool = False, missing_zero: bool = False) -> DataFrame:
    """df with probability (6 digits) and predicted; rows with a missing input get null unless missing counts as 0.

    The regression cuts at p > 0.5, coefficient scoring at p >= 0.5 (`inclusive`)."""
    eta = F.lit(float(coefficients.get("(Intercept)", 0.0)))
    for v, b in coefficients.items():
        if v != "(Intercept)" and v in df.columns:
            c = F.col(f"`{v}`").cast("double")
            eta = eta + F.lit(float(b)) * (F.coalesce(c, F.lit(0.0)) if missing_zero else c)
    p = S.sigmoid(eta)
    hit = p >= cut if inclusive else p > cut
    return df.withColumns({"probability": F.bround(p, 6), "predicted": hit.cast("int")})
