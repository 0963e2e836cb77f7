"""Model evaluation from one score histogram.

Rows are first aggregated to (score: n, events): every curve and every measure that depends on the order of scores is a
running sum over that table (``ordered.running``: sorted parts and their offsets), never over rows.  Several data sets are
measured in one pass: their scores are segments of the same histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..sources.shared import materialize
from .ordered import numbered, quantiles, running


def whole():
    """A window over all rows of a short table."""
    return Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def as_probability(df: DataFrame, column: str) -> DataFrame:
    """Log-odds (any value outside 0 to 1) become probabilities."""
    odd = df.agg(F.coalesce(F.bool_or((F.col(column) < 0) | (F.col(column) > 1)), F.lit(False))).first()[0]
    return df.withColumn(column, S.sigmoid(F.col(column))) if odd else df


def histogram(df: DataFrame, actual: str, score: str, digits: int | None = None, by: list[str] = ()) -> DataFrame:
    """(by, p, n, events), nulls and NaN left out; with digits the scores are rounded first."""
    p = F.col(score).cast("double")
    kept = df.where(F.col(actual).isNotNull() & p.isNotNull() & ~F.isnan(p))
    return kept.groupBy(*by, (F.bround(p, digits) if digits is not None else p).alias("p")).agg(F.count("*").alias("n"), F.sum(F.col(actual).cast("long")).alias("events"))


def cumulated(hist: DataFrame, by: list[str] = ()) -> DataFrame:
    """hist with running rows and events from the highest score down, and totals (of each group `by`)."""
    t = running(hist, "p", ["n", "events"], by)
    t = t.select(*by, "p", "n", "events", F.col("n_in").alias("rows_in"), F.col("events_in").alias("tp"), F.col("n_all").alias("rows"), F.col("events_all").alias("pos"))
    return t.withColumns({"fp": F.col("rows_in") - F.col("tp"), "neg": F.col("rows") - F.col("pos")})


def precision_recall(hist: DataFrame) -> DataFrame:
    """(p, precision, recall): the curve's points."""
    return cumulated(hist).select("p", (F.col("tp") / F.col("rows_in")).alias("precision"), (F.col("tp") / F.nullif("pos", F.lit(0))).alias("recall"))


def ks_curve(hist: DataFrame) -> DataFrame:
    """(p, event_share, non_event_share, distance): the cumulative shares whose greatest distance is K-S."""
    tpr, fpr = F.col("tp") / F.nullif("pos", F.lit(0)), F.col("fp") / F.nullif("neg", F.lit(0))
    return cumulated(hist).select("p", tpr.alias("event_share"), fpr.alias("non_event_share"), (tpr - fpr).alias("distance"))


def score_distribution(df: DataFrame, actual: str, score: str, bins: int = 20) -> DataFrame:
    """(bin, n, events, share): rows and events per equal-width bin of a probability, the last bin closed."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    t = df.where(F.col(actual).isNotNull() & F.col(score).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(actual).cast("long")).alias("events"))
    return t.withColumn("share", F.bround(F.col("n") / F.sum("n").over(whole()), 6))  # at most `bins` rows


def roc(hist: DataFrame) -> DataFrame:
    """(p, fpr, tpr): the curve's points, without (0, 0)."""
    return cumulated(hist).select("p", (F.col("fp") / F.nullif("neg", F.lit(0))).alias("fpr"), (F.col("tp") / F.nullif("pos", F.lit(0))).alias("tpr"))


def discrimination(hist: DataFrame, digits: int = 5, by: list[str] = ()) -> DataFrame:
    """One row (of each group `by`): auc, gini, ks (row level), pr_auc, average_precision, h_measure, brier, log_loss, rows and events.

    Ties share a point of the curve (trapezoid)."""
    c = cumulated(hist, by)
    back = lambda x: F.col(x) - F.col("events" if x == "tp" else "misses")
    c = c.withColumn("misses", F.col("n") - F.col("events"))
    tpr, fpr = F.col("tp") / F.nullif("pos", F.lit(0)), F.col("fp") / F.nullif("neg", F.lit(0))
    tpr0, fpr0 = back("tp") / F.nullif("pos", F.lit(0)), back("fp") / F.nullif("neg", F.lit(0))
    precision = F.col("tp") / F.col("rows_in")
    precision0 = F.when(back("tp") + back("fp") > 0, back("tp") / (back("tp") + back("fp"))).otherwise(1.0)
    pi0, pi1 = F.col("neg") / F.col("rows"), F.col("pos") / F.col("rows")
    cost = fpr * pi0 / (fpr * pi0 + (1 - tpr) * pi1 + 1e-10)
    weight = F.when((cost > 0) & (cost < 1), cost * (1 - cost)).otherwise(0.0)
    loss = weight * (pi0 * fpr + pi1 * (1 - tpr)) * F.abs(fpr - fpr0) / (pi0 + 1e-10)
    q = F.greatest(F.least("p", F.lit(1 - 1e-15)), F.lit(1e-15))
    one = c.groupBy(*by).agg(
        F.sum("n").alias("rows"),
        F.sum("events").alias("events"),
        F.sum((fpr - fpr0) * (tpr + tpr0) / 2).alias("auc"),
        F.max(tpr - fpr).alias("ks"),
        F.sum((tpr - tpr0) * (precision + precision0) / 2).alias("pr"),
        F.sum((tpr - tpr0) * precision).alias("ap"),
        F.sum(loss).alias("loss"),
        F.min(F.least(pi0, pi1)).alias("worst"),
        (F.sum(F.col("events") * (1 - F.col("p")) ** 2 + F.col("misses") * F.col("p") ** 2) / F.sum("n")).alias("brier"),
        (-F.sum(F.col("events") * F.log(q) + F.col("misses") * F.log(1 - q)) / F.sum("n")).alias("log_loss"),
    )
    return one.select(
        *by,
        "rows",
        "events",
        F.bround("auc", digits).alias("auc"),
        F.bround(2 * F.col("auc") - 1, digits).alias("gini"),
        F.bround("ks", 4).alias("ks"),
        F.bround("pr", digits).alias("pr_auc"),
        F.bround("ap", digits).alias("average_precision"),
        F.bround(F.greatest(F.least(1 - F.col("loss") / (F.col("worst") + 1e-10), F.lit(1.0)), F.lit(0.0)), 5).alias("h_measure"),
        F.bround("brier", 6).alias("brier"),
        F.bround("log_loss", 6).alias("log_loss"),
    )


def quantile_edges(df: DataFrame, column: str, q: int, exact: bool = True) -> list[float]:
    """Distinct quantiles 0, 1/q, ..., 1; exact (``ordered.quantiles``) or a sketch's."""
    at = [k / q for k in range(q + 1)]
    return sorted(set(quantiles(df, {column: at})[column] if exact else df.agg(F.percentile_approx(F.col(column), at, 10_000)).first()[0] or []))


def bucket(c: Column, inner: list[float], right: bool = True) -> Column:
    """0, 1, ...: the number of inner edges below the value (right-closed) or not above it (left-closed)."""
    out = F.lit(0)
    for e in inner:
        out = out + (c > F.lit(float(e)) if right else c >= F.lit(float(e))).cast("int")
    return F.when(c.isNotNull(), out)


def row_deciles(df: DataFrame, score: str, groups: int = 10, ties: list[str] = (), by: list[str] = ()) -> DataFrame:
    """df with decile 1 (highest scores) to `groups`, by row position: the first and the last row's positions are 0 and 1."""
    at = positions(df, score, ties, by)
    decile = F.greatest(F.lit(1), F.ceil(groups * (F.col("_at") - 1) / F.greatest(F.col("_rows") - 1, F.lit(1)))).cast("int")
    return at.withColumn("decile", decile).drop("_at", "_rows")


def positions(df: DataFrame, score: str, ties: list[str] = (), by: list[str] = ()) -> DataFrame:
    """df without null scores, with _at (1: the highest score; ties in order of `ties`, or else of a hash of the row) and _rows, of each
    group `by`.

    Rows are sorted by score and ties together, so a score that many rows share is split like any other stretch."""
    order = [F.col(c) for c in ties] or [F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))]
    return numbered(df.where(F.col(score).isNotNull()), [F.col(score).desc(), *order], by)


def gains(df: DataFrame, actual: str, score: str, groups: int = 10, ties: list[str] = (), by: list[str] = ()) -> DataFrame:
    """Gains table of equal groups of rows, the highest scores first (of each group `by`)."""
    grouped = row_deciles(df.where(F.col(actual).isNotNull()), score, groups, ties, by).groupBy(*by, "decile")
    t = grouped.agg(F.count("*").alias("n"), F.sum(F.col(actual).cast("long")).alias("events"), F.min(score).alias("lo"), F.max(score).alias("hi"), F.avg(score).alias("mean"))
    own = Window.partitionBy(*by)  # `groups` rows each
    run = own.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("non_events", F.col("n") - F.col("events")).withColumns(
        {"cum_events": F.sum("events").over(run), "cum_non_events": F.sum("non_events").over(run), "pos": F.sum("events").over(own), "neg": F.sum("non_events").over(own)}
    )
    part = lambda x, of: F.coalesce(F.col(x) / F.nullif(of, F.lit(0)), F.lit(0.0))
    tp, fp = part("cum_events", "pos"), part("cum_non_events", "neg")
    r = lambda c, name: F.bround(c, 4).alias(name)
    return t.select(
        *by, "decile", "n", "events", "non_events", r(F.col("events") / F.col("n"), "event_rate"), r(part("events", "pos"), "pct_events"), r(part("non_events", "neg"), "pct_non_events"),
        "cum_events", "cum_non_events", r(tp, "cum_pct_events"), r(fp, "cum_pct_non_events"), r(F.abs(tp - fp), "ks"), r(tp * groups / F.col("decile"), "lift"), r(F.col("lo"), "min_prob"), r(F.col("hi"), "max_prob"), r(F.col("mean"), "avg_prob"),
    )


def ks_by_decile(table: DataFrame, by: list[str] = ()) -> DataFrame:
    """The greatest K-S of a gains table and its (first) decile."""
    return table.groupBy(*by).agg(F.max("ks").alias("ks"), F.min_by("decile", F.struct(-F.col("ks"), "decile")).alias("ks_decile"))


def confusion(df: DataFrame, actual: str, score: str, cut: float = 0.5) -> DataFrame:
    """Counts at p >= cut with the measures that follow from them."""
    y, hit = F.col(actual) == 1, F.col(score) >= cut
    return _rates(df.agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn")))


def _rates(t: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts (tp, fp, fn, tn) with the measures that follow from them."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    margin = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    r = lambda c, name: F.bround(c, 5).alias(name)
    return t.select(
        *by, "tp", "fp", "fn", "tn", r(div(tp + tn, tp + fp + fn + tn), "accuracy"), r(div(tp, tp + fn), "sensitivity"), r(div(tn, tn + fp), "specificity"), r(div(tp, tp + fp), "precision"),
        r(div(2 * tp, 2 * tp + fp + fn), "f1"), r(div(5 * tp, 5 * tp + fp + 4 * fn), "f2"), r(div(tp.cast("double") * tn - fp.cast("double") * fn, margin), "mcc"),
    )


def calibration_error(df: DataFrame, actual: str, score: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins, the last one closed."""
    b = bucket(F.col(score), [k / bins for k in range(1, bins)], right=False)
    t = df.where(F.col(actual).isNotNull() & F.col(score).isNotNull()).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.avg(actual).alias("y"), F.avg(score).alias("p"))
    return t.agg(F.bround(F.sum(F.col("n") * F.abs(F.col("y") - F.col("p"))) / F.sum("n"), 6).alias("ece"))


def precision_at(df: DataFrame, actual: str, score: str, shares: tuple[float, ...] = (0.1, 0.2), ties: list[str] = (), by: list[str] = ()) -> DataFrame:
    """For the top share of rows, in order of score and ties: precision and the share of all events in it."""
    at = positions(df.where(F.col(actual).isNotNull()), score, ties, by)
    k = {share: F.greatest(F.lit(1), F.floor(F.col("_rows") * F.lit(share))).cast("long") for share in shares}
    y = F.col(actual).cast("long")
    got = [x for i, s in enumerate(shares) for x in (F.sum(F.when(F.col("_at") <= k[s], y).otherwise(0)).alias(f"got{i}"), F.max(k[s]).alias(f"k{i}"))]
    one = at.groupBy(*by).agg(F.sum(y).alias("pos"), *got)
    each = [F.struct(F.lit(s).alias("share"), F.col(f"k{i}").alias("k"), F.bround(F.col(f"got{i}") / F.col(f"k{i}"), 5).alias("precision"), F.bround(F.try_divide(f"got{i}", "pos"), 5).alias("capture")) for i, s in enumerate(shares)]
    return one.select(*by, F.explode(F.array(*each)).alias("x")).select(*by, "x.*")


#: Column names that are tried, in this order, where none is given (fixed values).
SCORES = ("probability", "prob", "probs", "score", "pred_prob", "log_odds")
EXPOSURES = ("loan_amount", "LoanAmount", "exposure", "Exposure", "amount", "Amount", "principal", "Principal", "balance", "Balance", "EAD")


def detect(df: DataFrame, given: str | None, names: tuple[str, ...]) -> str | None:
    """The given column if the table has it, else the first of `names` that it has."""
    return given if given in df.columns else next((c for c in names if c in df.columns), None)


def best_profit_per_application(hist: DataFrame, revenue: float = 100.0, loss: float = 500.0, cost: float = 0.0, by: list[str] = ()) -> DataFrame:
    """(by, max_profit, threshold): the greatest profit per application if every score from the threshold up is rejected (threshold 1:
    none is); scores that are equal are rejected together."""
    c = cumulated(hist, by)
    worth = lambda good, bad: (good * revenue - bad * loss) / F.col("rows") - cost
    one = c.groupBy(*by).agg(F.max_by(F.struct(worth(F.col("neg") - F.col("fp"), F.col("pos") - F.col("tp")).alias("profit"), "p"), F.struct(worth(F.col("neg") - F.col("fp"), F.col("pos") - F.col("tp")), "p")).alias("x"), F.max(worth(F.col("neg"), F.col("pos"))).alias("all"))
    some = F.col("x.profit") > F.col("all")
    return one.select(*by, F.bround(F.greatest("x.profit", "all"), 4).alias("max_profit"), F.bround(F.when(some, F.col("x.p")).otherwise(1.0), 4).alias("threshold"))


def all_metrics(df: DataFrame, actual: str, score: str, by: list[str] = (), ties: list[str] = (), cut: float = 0.5, bins: int = 10, groups: int = 10) -> DataFrame:
    """One row of all measures (of each group `by`, e.g. the data set).

    Measures of the order of scores come from one segmented histogram, deciles and top shares from one segmented sort; the groups are
    not looped over."""
    by, kept = list(by), df.where(F.col(actual).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    hist = materialize(histogram(kept, actual, score, by=by), "scores")
    hit, misses = F.col("p") >= cut, F.col("n") - F.col("events")
    count = lambda x, test: F.sum(F.when(test, x).otherwise(0))
    rates = _rates(hist.groupBy(*by).agg(count(F.col("events"), hit).alias("tp"), count(misses, hit).alias("fp"), count(F.col("events"), ~hit).alias("fn"), count(misses, ~hit).alias("tn")), by)
    cells = hist.groupBy(*by, bucket(F.col("p"), [k / bins for k in range(1, bins)], right=False).alias("b")).agg(F.sum("n").alias("n"), F.sum("events").alias("y"), F.sum(F.col("p") * F.col("n")).alias("q"))
    ece = cells.groupBy(*by).agg(F.bround(F.sum(F.abs(F.col("y") - F.col("q"))) / F.sum("n"), 6).alias("ece"))
    placed = materialize(positions(kept.select(*by, actual, score, *[c for c in ties if c not in (actual, score, *by)]), score, ties, by).select(*by, actual, F.col(score).alias("_p"), "_at", "_rows"), "places")
    y, at, rows = F.col(actual).cast("long"), F.col("_at"), F.col("_rows")
    top = [x for s in (10, 20) for k in [F.greatest(F.lit(1), F.floor(rows * F.lit(s / 100)))] for x in (F.sum(F.when(at <= k, y).otherwise(0)).alias(f"got{s}"), F.max(k).alias(f"k{s}"))]
    first = placed.groupBy(*by).agg(F.sum(y).alias("pos"), *top)
    first = first.select(*by, *(x for s in (10, 20) for x in (F.bround(F.col(f"got{s}") / F.col(f"k{s}"), 5).alias(f"precision_top_{s}pct"), F.bround(F.coalesce(F.try_divide(f"got{s}", "pos"), F.lit(0.0)), 5).alias(f"capture_rate_top_{s}pct"))))
    decile = F.greatest(F.lit(1), F.ceil(groups * (at - 1) / F.greatest(rows - 1, F.lit(1)))).cast("int")
    tenths = placed.groupBy(*by, decile.alias("decile")).agg(F.count("*").alias("n"), F.sum(y).alias("e"))
    own = Window.partitionBy(*by)  # `groups` rows each
    run = own.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda x: F.coalesce(F.try_divide(F.sum(x).over(run), F.sum(x).over(own)), F.lit(0.0))
    ks = ks_by_decile(tenths.withColumn("g", F.col("n") - F.col("e")).withColumn("ks", F.bround(F.abs(share("e") - share("g")), 4)), by).withColumnRenamed("ks", "ks_statistic")
    order = discrimination(hist, by=by).drop("ks").withColumn("event_rate", F.bround(F.col("events") / F.col("rows"), 5))
    profit = best_profit_per_application(hist, by=by).withColumnRenamed("threshold", "profit_threshold")
    out = order
    for part in (rates, ece, first, ks, profit):  # a row per group
        renamed = part.select(*(F.col(c).alias(f"_its_{c}") if c in by else F.col(c) for c in part.columns))
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_its_{c}"))
        out = out.join(renamed, same).drop(*(f"_its_{c}" for c in by))
    return out


def psi(expected: DataFrame, actual: DataFrame, column: str, bins: int = 10, mode: str = "clip", eps: float = 1e-6, right: bool = False, digits: int = 4) -> DataFrame:
    """Population stability index over quantile bins of the expected sample.

    mode clip: shares of at least eps; mode add: eps added to each share.  right: bins closed on the right."""
    inner = quantile_edges(expected.where(F.col(column).isNotNull()), column, bins)[1:-1]
    side = lambda df, name: df.where(F.col(column).isNotNull()).groupBy(bucket(F.col(column), inner, right).alias("b")).agg(F.count("*").alias(name))
    every = expected.sparkSession.range(len(inner) + 1).select(F.col("id").cast("int").alias("b"))
    t = every.join(side(expected, "e"), "b", "left").join(side(actual, "a"), "b", "left").fillna(0)
    share = lambda c: F.col(c) / F.sum(c).over(whole())
    e, a = share("e"), share("a")
    e, a = (F.greatest(e, F.lit(eps)), F.greatest(a, F.lit(eps))) if mode == "clip" else (e + eps, a + eps)
    t = t.select("b", e.alias("expected"), a.alias("actual"))
    return t.withColumn("part", (F.col("actual") - F.col("expected")) * F.log(F.col("actual") / F.col("expected"))).agg(F.bround(F.sum("part"), digits).alias("psi"))


def csi(expected: DataFrame, actual: DataFrame, columns: list[str], low: float = 0.10, high: float = 0.25, bins: int = 10, mode: str = "clip", eps: float = 1e-6, right: bool = False, digits: int = 4) -> DataFrame:
    """Stability of each variable with its status; all variables are counted in one pass over either sample."""
    at = [k / bins for k in range(bins + 1)]
    inner = {c: sorted(set(q))[1:-1] for c, q in quantiles(expected, {c: at for c in columns}).items()}

    def side(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*(F.struct(F.lit(c).alias("variable"), bucket(F.col(f"`{c}`"), inner[c], right).alias("b")) for c in columns))
        return df.select(F.explode(cells).alias("x")).where("x.b is not null").groupBy("x.variable", "x.b").agg(F.count("*").alias(name))

    every = expected.sparkSession.createDataFrame([(c, b) for c in columns for b in range(len(inner[c]) + 1)], "variable string, b int")
    t = every.join(side(expected, "e"), ["variable", "b"], "left").join(side(actual, "a"), ["variable", "b"], "left").fillna(0, ["e", "a"])
    own = Window.partitionBy("variable")  # `bins` rows each
    e, a = (F.try_divide(F.col(c), F.sum(c).over(own)) for c in ("e", "a"))
    e, a = (F.greatest(e, F.lit(eps)), F.greatest(a, F.lit(eps))) if mode == "clip" else (e + eps, a + eps)
    parts = t.select("variable", e.alias("e"), a.alias("a"))
    out = parts.groupBy("variable").agg(F.bround(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))), digits).alias("psi"))
    return out.withColumn("status", F.when(F.col("psi") < low, "stable").when(F.col("psi") < high, "moderate").otherwise("shifted"))


def label_psi(expected: DataFrame, actual: DataFrame, label: str) -> DataFrame:
    """Stability over labels: shares of the expected sample's labels, at least 1e-4 each."""
    side = lambda df, name: df.groupBy(F.col(label).alias("b")).agg(F.count("*").alias(name))
    t = side(expected, "e").join(side(actual, "a"), "b", "left").fillna(0, ["a"])
    e, a = F.greatest(F.col("e") / F.sum("e").over(whole()), F.lit(1e-4)), F.greatest(F.col("a") / F.sum("a").over(whole()), F.lit(1e-4))
    return t.select(e.alias("e"), a.alias("a")).agg(F.bround(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))), 4).alias("psi"))


def profit(df: DataFrame, actual: str, score: str, exposure: Column | float = 1000.0, lgd: float = 0.45, margin: float = 0.05, term: float = 3.0, origination: float = 50.0, servicing: float = 20.0, recovery: float = 0.1) -> DataFrame:
    """The profit curve: (threshold, profit, approval_rate, rejected) for rejecting every score from the threshold up.

    A good loan earns margin over its term less costs; a bad one loses lgd of its exposure with recovery costs, after a
    quarter of the margin was earned."""
    e = exposure if isinstance(exposure, Column) else F.lit(float(exposure))
    good = e * margin * term - origination - servicing * term
    bad = -(e * lgd * (1 + recovery) - e * margin * term * 0.25 + origination)
    t = df.where(F.col(actual).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.sum(F.when(F.col(actual) == 1, bad).otherwise(good)).alias("worth"), F.sum(F.col(actual).cast("long")).alias("bads"))
    t = running(t, "threshold", ["worth", "n", "bads"])
    return t.select("threshold", F.bround(F.col("worth_all") - F.col("worth_in"), 2).alias("profit"), (1 - F.col("n_in") / F.col("n_all")).alias("approval_rate"), F.col("n_in").alias("rejected"), F.col("bads_in").alias("rejected_bads"), F.bround("worth_all", 2).alias("profit_of_all"))


def best_profit(curve: DataFrame) -> DataFrame:
    """The threshold of the greatest profit (approving all counts as threshold null)."""
    return curve.agg(F.max_by(F.struct("threshold", "profit", "approval_rate", "rejected"), F.struct("profit", -F.col("rejected"))).alias("x"), F.max("profit_of_all").alias("all")).select(
        F.when(F.col("x.profit") > F.col("all"), F.col("x.threshold")).alias("threshold"), F.greatest("x.profit", "all").alias("profit"), F.when(F.col("x.profit") > F.col("all"), F.col("x.approval_rate")).otherwise(1.0).alias("approval_rate"), "all"
    ).withColumnRenamed("all", "profit_of_all")


def expected_loss(df: DataFrame, pd_col: str, ead: str, lgd: float = 0.45) -> DataFrame:
    return df.agg(F.bround(F.sum(F.col(pd_col) * F.col(ead) * lgd), 2).alias("expected_loss"), F.bround(F.sum(ead), 2).alias("exposure"), F.bround(F.sum(F.col(pd_col) * F.col(ead) * lgd) / F.sum(ead), 6).alias("loss_rate"))


def risk_adjusted_return(df: DataFrame, actual: str, pd_col: str, ead: str, margin: float = 0.05, lgd: float = 0.45, term: float = 3.0, capital: float = 0.08, cost: float = 0.10) -> DataFrame:
    """One row: exposure, revenue, expected and actual loss, capital and its charge, net profit, return on that capital (raroc) and on the exposure (roa)."""
    e, p, y = (F.col(c).cast("double") for c in (ead, pd_col, actual))
    t = df.where(e.isNotNull() & p.isNotNull() & y.isNotNull()).agg(F.sum(e).alias("e"), F.bround(F.sum(p * e * lgd), 2).alias("el"), F.sum(e * y * lgd).alias("al"))
    e, el = F.col("e"), F.col("el")
    revenue, held = e * margin * term, e * capital
    charge = held * cost * term
    net = revenue - el - charge
    r = lambda x, digits, name: F.bround(x, digits).alias(name)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return t.select(
        r(e, 2, "total_exposure"), r(revenue, 2, "expected_revenue"), r(el, 2, "expected_loss"), r(F.col("al"), 2, "actual_loss"), r(held, 2, "economic_capital"), r(charge, 2, "capital_charge"),
        r(net, 2, "net_profit"), r(ratio(net, held), 4, "raroc"), r(ratio(net, e), 4, "roa"), r(ratio(el, revenue), 4, "loss_ratio"),
    )


def lorenz(hist: DataFrame) -> DataFrame:
    """(share of rows, share of events), from the highest score down."""
    return cumulated(hist).select((F.col("rows_in") / F.col("rows")).alias("rows_share"), (F.col("tp") / F.nullif("pos", F.lit(0))).alias("events_share"))
