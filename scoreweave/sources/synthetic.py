"""Synthetic loans for monitoring: one lazy projection over keys, so any number of rows is a distributed job.

All draws depend on the seed and the key only; reruns on any cluster agree.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import evaluation as E

#: Mean shift and noise by drift level; centre and width of approval and funding by score; bounds of scores and returns (fixed values).
LEVELS = {"none": 0.0, "slight": 0.15, "moderate": 0.35, "significant": 0.60, "severe": 0.60}
APPROVAL, FUNDING, SCORES, GOOD_RETURN, BAD_RETURN, MOST_RETURN = (550, 30), (500, 50), (300, 850), (1.0, 1.3), 0.9, 1.5
SCORE_NOISE, RETURN_NOISE = 15, 0.05


def normal(seed: str, key: Column) -> Column:
    """A standard normal number (Box and Muller)."""
    u, v = S.draw(f"{seed}u", key), S.draw(f"{seed}v", key)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * pi * v)


def of_keys(keys: DataFrame, key: str, seed: int = 42, drift: str = "none", degradation: str = "none", points: float = 600, odds: float = 20, pdo: float = 50) -> DataFrame:
    """(loan_id, score, isApproved, isFunded, isBad, ROI) per key: risk drives the outcome; drift moves risk, degradation blurs scores.

    Loans are approved and funded with a probability that rises with the score; good ones return 1.0 to 1.3, bad ones more the higher
    their score."""
    a, b = S.scaling(points, odds, pdo)
    draw = lambda what: S.draw(f"{seed}{what}", F.col(key))
    spread = lambda what: normal(f"{seed}{what}", F.col(key))
    risk = spread("risk") + LEVELS[drift]
    t = keys.select(F.concat(F.lit("L"), F.col(key).cast("string")).alias("loan_id"), F.col(key), risk.alias("risk"))
    p, seen = S.sigmoid(F.col("risk")), S.sigmoid(F.col("risk") + LEVELS[degradation] * spread("blur"))
    low, high = SCORES
    score = F.greatest(F.least(S.score_from_probability(seen, a, b) + SCORE_NOISE * spread("noise"), F.lit(high)), F.lit(low)).cast("int")
    t = t.withColumns({"isBad": (draw("bad") < p).cast("int"), "score": score})
    chance = lambda rule: S.sigmoid((F.col("score") - rule[0]) / rule[1])
    t = t.withColumn("isApproved", (draw("approve") < chance(APPROVAL)).cast("int"))
    t = t.withColumn("isFunded", ((F.col("isApproved") == 1) & (draw("fund") < chance(FUNDING))).cast("int"))
    good = GOOD_RETURN[0] + (GOOD_RETURN[1] - GOOD_RETURN[0]) * draw("good")
    bad = F.greatest(F.least((F.col("score") - low) / (high - low) * BAD_RETURN, F.lit(BAD_RETURN)), F.lit(0.0))
    roi = F.when(F.col("isBad") == 1, bad).otherwise(good) + RETURN_NOISE * spread("return")
    roi = F.when(F.col("isFunded") == 1, F.bround(F.greatest(F.least(roi, F.lit(MOST_RETURN)), F.lit(0.0)), 4))
    return t.select("loan_id", "score", "isApproved", "isFunded", "isBad", roi.alias("ROI"))


def loans(spark: SparkSession, n: int = 5000, seed: int = 42, drift: str = "none", degradation: str = "none", points: float = 600, odds: float = 20, pdo: float = 50) -> DataFrame:
    """n loans, by number."""
    return of_keys(spark.range(n), "id", seed, drift, degradation, points, odds, pdo)


def expected(baseline: DataFrame, production: DataFrame) -> DataFrame:
    """(metric, baseline, production, change): what the monitor should find; PSI over deciles of the baseline's scores, and the advice that follows from it."""
    facts = F.count_if(F.col("isFunded") == 1).alias("n"), F.avg("score").alias("score"), F.avg(F.when(F.col("isFunded") == 1, F.col("isBad"))).alias("bad"), F.avg(F.when(F.col("isFunded") == 1, F.col("ROI"))).alias("roi")
    one, two = baseline.agg(*facts).first(), production.agg(*facts).first()
    psi = E.psi(baseline, production, "score", mode="add", eps=1e-4, right=False, digits=6).first()[0]
    rows = [(name, float(one[c]), float(two[c]), float(two[c] - one[c]), None) for name, c in (("funded", "n"), ("mean_score", "score"), ("bad_rate_funded", "bad"), ("avg_roi_funded", "roi"))]
    rows.append(("psi", None, psi, None, "RETRAIN" if psi >= 0.25 else "MONITOR" if psi >= 0.10 else "OK"))
    return baseline.sparkSession.createDataFrame(rows, "metric string, baseline double, production double, change double, advice string")
