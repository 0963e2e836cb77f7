"""Splitters on histograms against plain step-by-step versions, edits of bins, and the parsing of bin labels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreweave.operators import binning, logistic, scorecard, selection, splitters
from scoreweave.plans import pipelines, presets
from scoreweave.sources import synthetic


def grouped(n, most):
    """Neighbouring classes, put together to about equal counts."""
    out, seen = [], 0
    for k, x in enumerate(n):
        seen += x
        out.append(min((seen - 1) * most // sum(n), most - 1))
    return [[k for k in range(len(n)) if out[k] == g] for g in sorted(set(out))]


def joined(bins, k):
    return bins[:k] + [[bins[k][0] + bins[k + 1][0], bins[k][1] + bins[k + 1][1], bins[k + 1][2]]] + bins[k + 2 :]


def chi(a, b):
    """Yates-corrected statistic of two (rows, bads)."""
    table = [[a[0] - a[1], a[1]], [b[0] - b[1], b[1]]]
    n, total = a[0] + b[0], 0.0
    for i in range(2):
        for j in range(2):
            expected = sum(table[i]) * (table[0][j] + table[1][j]) / n
            if expected == 0:
                return math.inf
            total += max(abs(table[i][j] - expected) - 0.5, 0) ** 2 / expected
    return total


def plain_chi_merge(n, b, c):
    bins = [[sum(n[k] for k in g), sum(b[k] for k in g), g[-1]] for g in grouped(n, 100)]
    while len(bins) > c.min_bins:
        x = [chi(p, q) for p, q in zip(bins, bins[1:])]
        k = x.index(min(x))
        if math.isinf(x[k]) or math.erfc(math.sqrt(x[k] / 2)) < c.chi_p and len(bins) <= c.max_bins:
            break
        bins = joined(bins, k)
    least = max(int(sum(n) * c.min_share), c.min_count)
    while len(bins) > c.min_bins and any(x[0] < least for x in bins):
        k = next(i for i, x in enumerate(bins) if x[0] < least)
        bins = joined(bins, max(k - 1, 0))
    while len(bins) > c.max_bins:
        x = [chi(p, q) for p, q in zip(bins, bins[1:])]
        bins = joined(bins, x.index(min(x)))
    return [x[2] for x in bins[:-1]]


def plain_iv_optimal(n, b, c):
    start = len(n) if len(n) <= 20 else min(max(20, len(n) // 5), min(100, max(2, sum(n) // 50)), len(n) - 1)
    bins, bads, goods = [[sum(n[k] for k in g), sum(b[k] for k in g), g[-1]] for g in grouped(n, start)], sum(b), sum(n) - sum(b)
    cap = lambda x: (x[1] / bads if x[1] else 1e-4, (x[0] - x[1]) / goods if x[0] > x[1] else 1e-4)
    woe = lambda x: math.log(cap(x)[0] / cap(x)[1])
    iv = lambda x: (cap(x)[0] - cap(x)[1]) * woe(x)
    while len(bins) > c.min_bins and any(x[1] in (0, x[0]) for x in bins):
        k = next(i for i, x in enumerate(bins) if x[1] in (0, x[0]))
        right = k == 0 or k < len(bins) - 1 and abs(woe(bins[k + 1]) - woe(bins[k])) < abs(woe(bins[k]) - woe(bins[k - 1]))
        bins = joined(bins, k if right else k - 1)
    while len(bins) > c.max_bins:
        loss = [iv(p) + iv(q) - iv([p[0] + q[0], p[1] + q[1]]) for p, q in zip(bins, bins[1:])]
        k = loss.index(min(loss))
        if loss[k] > c.min_iv_loss and len(bins) <= 2 * c.max_bins:
            break
        bins = joined(bins, k)
    least = max(int(sum(n) * c.min_share), c.min_count)
    while len(bins) > c.min_bins and any(x[0] < least for x in bins):
        k = next(i for i, x in enumerate(bins) if x[0] < least)
        smaller = 0 if k == 0 else k - 1 if k == len(bins) - 1 or bins[k - 1][0] <= bins[k + 1][0] else k
        bins = joined(bins, smaller)
    return [x[2] for x in bins[:-1]]


@pytest.mark.parametrize("method, plain", [("chi_merge", plain_chi_merge), ("iv_optimal", plain_iv_optimal)])
def test_mergers_step_by_step(method, plain):
    r = random.Random(7)
    for trial in range(60):
        size = r.randrange(3, 160)
        n = [r.randrange(5, 60) for _ in range(size)]
        slope = r.choice([0.0, 0.3, 0.6])
        b = [sum(r.random() < 0.2 + slope * abs(k / size - 0.4) for _ in range(x)) for k, x in enumerate(n)]
        c = splitters.Split(method, max_bins=r.choice([3, 6, 10]), min_share=r.choice([0.01, 0.1]))
        got = splitters.METHODS[method](np.array(n), np.array(b), c)
        assert got == plain(n, b, c), trial


def test_equal_frequency_groups():
    got = splitters.equal_frequency(np.array([10] * 40), np.array([1] * 40), splitters.Split(max_bins=4))
    assert got == [9, 19, 29]


def test_trend_drops_the_first_wrong_cut():
    n, b = np.array([100] * 5), np.array([10, 20, 15, 30, 40])
    assert splitters.with_trend(n, b, [0, 1, 2, 3], "ascending") == [0, 2, 3]
    assert splitters.with_trend(n, b, [0, 1, 2, 3], "none") == [0, 1, 2, 3]
    assert splitters.with_trend(n, np.array([10, 20, 30, 20, 10]), [0, 1, 2, 3], "peak") == [0, 1, 2, 3]


# ---------------------------------------------------------------- edits


def test_grouped_factor_is_broken_up(spark):
    df = spark.createDataFrame([(f"c{k % 14}", int(k % 14 < 5 and k % 3 == 0)) for k in range(1400)] + [(None, 1)] * 7, "f string, y int")
    bins = binning.get_bins(df, "y", ["f"], splitters.Split(max_bins=4))
    assert len([b for b in bins.by_var["f"] if not b.missing]) <= 4
    broken = bins.break_bin("f")
    assert [len(b.values) for b in broken.by_var["f"] if not b.missing] == [1] * 14 and sum(b.n for b in broken.by_var["f"]) == 1407
    assert bins.by_var["f"] != broken.by_var["f"] and broken.reset().by_var == bins.by_var


def test_kinds_follow_from_exact_counts(spark):
    df = spark.range(3000).select((F.col("id") % 10).alias("ten"), (F.col("id") % 11).alias("eleven"), F.when(F.col("id") % 7 > 0, F.col("id") % 50).cast("string").alias("fifty"), (F.col("id") % 51).cast("string").alias("over"), F.col("id").alias("many"), (F.col("id") % 2).cast("int").alias("y"))
    kinds, distinct = binning.kinds_of(df, ["ten", "eleven", "fifty", "over", "many"])
    assert kinds == {"ten": "factor", "eleven": "numeric", "fifty": "factor", "over": "factor", "many": "numeric"}
    assert [distinct[v] for v in ("ten", "eleven", "fifty", "over")] == [10, 11, 50, 51]
    assert binning.get_bins(df, "y", ["fifty", "over"]).too_many == ["over"]


def test_classes_hold_their_rows(spark):
    """Many values: every class is closed on the right, missing rows stay apart."""
    r = np.random.default_rng(0)
    x = [None if k % 40 == 0 else float("nan") if k % 41 == 0 else float(v) for k, v in enumerate(r.normal(size=4000))]
    df = spark.createDataFrame([(v, k % 2) for k, v in enumerate(x)], "x double, y int")
    t = binning.fine_histogram(df, "y", ["x"], {"x": 4000}, classes=32).toPandas()
    high = np.sort(t["high"].dropna().to_numpy())
    known = np.array([v for v in x if v is not None and v == v])
    want = np.bincount(np.searchsorted(high, known, side="left"), minlength=len(high))
    assert t[t["high"].notna()].sort_values("high")["count"].tolist() == want.tolist()
    assert t[t["high"].isna()]["count"].tolist() == [4000 - len(known)]


# ---------------------------------------------------------------- labels, assembly, diagnostics


@pytest.mark.parametrize(
    "label, inside, outside",
    [
        ("(1, 2.5]", ["1.1", "2.5"], ["1", "2.6", None, "x"]),
        ("<= 10", ["10", "-3"], ["10.5", None]),
        ("> 1e+06 | NA", ["1000001", None], ["1000000"]),
        ("{a, b}", ["a", "b"], ["c", None]),
        ("x >= 0 & x < 10", ["0", "9.9"], ["10", "-1", None]),
        ("x > 3 & x <= 4 | is.na(x)", ["4", None], ["3"]),
        ("x %in% c('u', 'v w')", ["u", "v w"], ["v", None]),
        ("x == 'u'", ["u"], ["v"]),
        ("all", ["1", "z"], [None]),
        ("NA", [None], ["1"]),
    ],
)
def test_bin_labels(spark, label, inside, outside):
    df = spark.createDataFrame([(v, True) for v in inside] + [(v, False) for v in outside], "x string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", scorecard.parsed_bin(label, F.col("x"))).collect())


def test_labels_of_our_bins_are_read_back(spark):
    df = spark.range(900).select(F.when(F.col("id") % 9 > 0, (F.col("id") % 90).cast("double")).alias("x"), F.concat(F.lit("k"), F.col("id") % 4).alias("f"), ((F.col("id") % 90) > 40).cast("int").alias("y"))
    bins = binning.get_bins(df, "y", ["x", "f"], splitters.Split(max_bins=4, min_share=0.05)).na_combine()
    card = scorecard.build(bins.table(spark), {"(Intercept)": -1.0, "WOE_x": 0.5, "WOE_f": 0.3})
    raw, labelled = scorecard.apply_values(df, card), scorecard.apply(bins.apply(df), card)
    assert [r["Score"] for r in raw.orderBy("x", "f", "y").collect()] == [r["Score"] for r in labelled.orderBy("x", "f", "y").collect()] and "b_x" not in raw.columns
    with pytest.raises(ValueError, match="not a bin"):
        scorecard.parsed_bin("?", F.col("x"))


def test_missing_columns_of_a_card(spark):
    card = spark.createDataFrame([("basepoints", None, None, 500.0), ("a", "x", 0.1, 1.0), ("gone", "y", 0.1, 2.0)], "var string, bin string, woe double, points double")
    df = spark.createDataFrame([("x",)], "b_a string")
    assert scorecard.apply(df, card).columns == ["b_a", "a_points", "basescore", "Score"]
    row = scorecard.apply(df, card, missing_null=True).first()
    assert row["gone_points"] is None and row["Score"] == 501.0
    with pytest.raises(ValueError, match="no column points"):
        scorecard.apply(df, card.drop("points"))


def test_assembled_table(spark):
    df = spark.range(5).select(F.lit(1).alias("y"), *(F.lit(2.0 + k).alias(c) for k, c in enumerate(("WOE_a", "WOE_b", "c", "WOE_d", "e"))))
    t = selection.assemble(df, "y", ["a", "c", "none"], ["WOE_d", "e"], [("WOE_a", "c"), ("a", "b"), ("WOE_a", "d")], most_missed=1, top=5)
    assert t.columns == ["y", "WOE_a", "c", "WOE_d", "WOE_a_x_c", "WOE_a_x_WOE_d"] and t.first()["WOE_a_x_c"] == 8.0


def test_ties_at_the_cut_off(spark):
    t = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 2.0), ("d", 1.0)], "var string, iv double")
    assert {r["var"] for r in selection.choose(t, 2, 1, ("iv",)).collect()} == {"a", "b"}
    assert {r["var"] for r in selection.choose(t, 2, 1, ("iv",), ties=True).collect()} == {"a", "b", "c"}


def test_diagnostics_of_one_variable(spark):
    df = spark.range(50).select(F.lit(3.0).alias("one"), F.rand(1).alias("x"))
    assert [(r["issue"], r["a"]) for r in logistic.diagnose(df, ["one"]).collect()] == [("low variance", "one")]
    assert {(r["issue"], r["a"]) for r in logistic.diagnose(df, ["one", "x"]).collect()} >= {("low variance", "one")}


# ---------------------------------------------------------------- configuration, flows, synthetic loans


def test_configuration_tables(spark):
    """What is written as a table is read back; other rows change nothing."""
    for config in (presets.woe_config("credit", max_bins=7, shrink=0.2), presets.SelectionConfig(top=3), presets.RegressionConfig("forward", 3.0), presets.ScorecardConfig(base_zero=True), presets.monitor_preset("aggressive")):
        base = type(config)()
        assert presets.configured(base, presets.as_table(spark, config)) == config
    rows = spark.createDataFrame([("top", "missing"), ("degree", "2"), ("other", "1"), ("limit", None)], "name string, value string")
    assert presets.configured(presets.SelectionConfig(), rows) == presets.SelectionConfig(degree=2)


def test_selection_flow_keeps_what_matters(spark):
    r = np.random.default_rng(2)
    x = r.integers(0, 40, (4000, 4)).astype(float)
    y = (r.random(4000) < 1 / (1 + np.exp(3 - 0.15 * x[:, 0]))).astype(int)
    df = spark.createDataFrame([(*map(float, row), float(row[0] * 2), int(v)) for row, v in zip(x, y)], "a double, b double, c double, d double, twin double, y int")
    found = pipelines.run_selection(pipelines.run_woe(df, "y", config="default"), "y", top=2)
    assert {"a", "twin"} & set(found.chosen) and found.table.columns[0] == "y"
    assert len({"WOE_a", "WOE_twin"} & set(found.table.columns)) == 1 and any(v in ("WOE_a", "WOE_twin") for v, _ in found.collinear)
    top = found.measures.orderBy("importance_rank").first()
    assert top["var"] in ("a", "twin") and "disagrees" in found.measures.columns


def test_synthetic_loans_follow_their_rules(spark):
    """Reruns agree, whatever the partitions; higher scores are approved more often and fail less; drift raises PSI."""
    keys = spark.range(4000)
    one, two = (synthetic.of_keys(k, "id").orderBy("loan_id").collect() for k in (keys, keys.repartition(7)))
    assert one == two
    rows = [r.asDict() for r in one]
    half = sorted(r["score"] for r in rows)[2000]
    rate = lambda what, test: float(np.mean([r[what] for r in rows if test(r)]))
    low, high = (lambda r: r["score"] < half), (lambda r: r["score"] >= half)
    assert rate("isApproved", high) > 5 * rate("isApproved", low) and rate("isBad", high) < rate("isBad", low) - 0.2
    assert all(r["isApproved"] or not r["isFunded"] for r in rows) and all((r["ROI"] is not None) == bool(r["isFunded"]) for r in rows)
    assert all(300 <= r["score"] <= 850 for r in rows) and rate("ROI", lambda r: r["isFunded"] and not r["isBad"]) > 1.1
    said = {r["metric"]: r for r in synthetic.expected(synthetic.of_keys(keys, "id"), synthetic.of_keys(keys, "id", drift="severe")).collect()}
    assert said["psi"]["production"] > 0.1 and said["psi"]["advice"] != "OK" and said["mean_score"]["change"] < 0


def test_selection_computes_weights_once(spark, monkeypatch):
    """All passes of the selection read the written weights, not the CASE expressions."""
    written, write = [], pipelines.materialize
    monkeypatch.setattr(pipelines, "materialize", lambda df, name: written.append(df.columns) or write(df, name))
    df = spark.createDataFrame([(float(k % 40), float(k % 7), int(k % 40 > 15 + k % 11)) for k in range(3000)], "a double, b double, y int")
    found = pipelines.run_selection(pipelines.run_woe(df, "y", config="default"), "y", top=2)
    assert written == [["y", "WOE_a", "WOE_b"]] and "CASE" not in found.table._jdf.queryExecution().optimizedPlan().toString()
