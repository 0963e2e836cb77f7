import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreweave.functions import scalar as S
from scoreweave.operators import binning, evaluation, logistic, scorecard, selection, splitters
from scoreweave.plans import pipelines, presets


def test_scaling():
    a, b = S.scaling(600, 20, 50)
    assert (round(a, 6), round(b, 6)) == (387.603624, 72.134752)


def test_names():
    assert S.sanitized("a#1 (x)-") == "a_NUM_1_x"
    assert S.r_names(["a b", "a-b", "1x"]) == ["a.b", "a.b.1", "X1x"]


@given(st.lists(st.tuples(st.integers(1, 500), st.floats(0, 1)), min_size=2, max_size=80), st.sampled_from(sorted(splitters.METHODS)))
@settings(max_examples=60, deadline=None)
def test_splits_are_valid(classes, method):
    n = np.array([c[0] for c in classes])
    b = np.array([int(c[0] * c[1]) for c in classes])
    cuts = splitters.split(n, b, splitters.Split(method, max_bins=5, min_share=0.05, monotone="auto"))
    assert cuts == sorted(set(cuts)) and all(0 <= k < len(n) - 1 for k in cuts)
    if method in ("cart", "chi_merge", "isotonic", "equal_frequency"):
        assert len(cuts) < 5


def test_cart_finds_the_step():
    n, b = np.full(100, 100), np.where(np.arange(100) < 30, 5, 40)
    assert 29 in splitters.split(n, b, splitters.Split("cart", max_bins=2))


def test_trend():
    n, b = np.full(6, 100), np.array([5, 10, 8, 20, 18, 30])
    cuts = splitters.with_trend(n, b, [0, 1, 2, 3, 4], "ascending")
    rate = splitters._bins(b, cuts) / splitters._bins(n, cuts)
    assert (np.diff(rate) >= 0).all()


def test_bins_cover_all_rows(spark):
    df = spark.range(2000).select((F.col("id") % 97).cast("double").alias("x"), F.when(F.col("id") % 11 != 0, F.col("id") % 7).alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    bins = binning.get_bins(df, "y", ["x", "k"])
    for v in ("x", "k"):
        assert sum(b.n for b in bins.by_var[v]) == 2000
    for edited in (bins, bins.na_combine(), bins.merge_pure(), bins.validate(), bins.force_trend(True), bins.optimise()):
        counts = {r["b_k"]: r["count"] for r in edited.apply(df).groupBy("b_k").count().collect()}
        assert counts == {b.label(): b.n for b in edited.by_var["k"]} and None not in counts
        assert edited.apply(df).where("b_x is null").count() == 0
    assert bins.validate().reset().by_var == bins.by_var


def test_perfect_order(spark):
    rows = [(float(900 - 50 * k), int(k >= 5)) for k in range(10)]
    df = spark.createDataFrame(rows, "score double, y int").withColumn("p", -F.col("score"))
    one = evaluation.discrimination(evaluation.histogram(df, "y", "p")).first()
    assert (one["auc"], one["gini"], one["ks"]) == (1.0, 1.0, 1.0)


def test_decile_sizes(spark):
    df = spark.range(25).select(F.col("id").cast("double").alias("p"), (F.col("id") % 2).alias("y"))
    got = evaluation.gains(df, "y", "p").orderBy("decile").collect()
    assert [r["n"] for r in got] == [3, 2, 3, 2, 3, 2, 2, 3, 2, 3]


def test_psi_of_itself(spark):
    df = spark.range(500).select(F.col("id").cast("double").alias("x"))
    assert evaluation.psi(df, df, "x").first()[0] == 0


def test_row_sum_ignores_null(spark):
    card = spark.createDataFrame([("basepoints", None, None, 0.0), ("a", "x", 0.1, 1.0), ("b", "y", 0.1, 2.0)], "var string, bin string, woe double, points double")
    df = spark.createDataFrame([("x", None), (None, None)], "b_a string, b_b string")
    assert [r["Score"] for r in scorecard.apply(df, card).collect()] == [1.0, 0.0]
    with pytest.raises(ValueError):
        scorecard.apply(df, card.union(card))


def test_logistic_recovers(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, (20000, 3)) / 2
    y = rng.random(20000) < 1 / (1 + np.exp(1.0 - 0.8 * x[:, 0] + 0.5 * x[:, 1]))
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, y int")
    for direction in ("forward", "backward", "both"):
        model = logistic.stepwise(df, "y", ["a", "b", "c"], direction)
        assert abs(model.coefficients["a"] - 0.8) < 0.08 and abs(model.coefficients["b"] + 0.5) < 0.08


def test_collinear(spark):
    df = spark.range(300).select(F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("c", F.col("a") + 0.001 * F.col("b"))
    kept, gone = selection.drop_collinear(df, ["a", "b", "c"])
    assert len(gone) == 1 and gone[0][0] in ("a", "c") and "b" in kept


def test_presets():
    c = presets.woe_config("fraud", max_bins="6", group_na="false", bayes="missing")
    assert (c.split.max_bins, c.group_na, c.bayes) == (6, False, 20.0)


def test_modelling_chain(spark):
    df = spark.range(3000).select((F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 13).cast("double").alias("z"), ((F.col("id") % 50) + 30 * F.rand(5) > 45).cast("int").alias("y"))
    woe = pipelines.run_woe(df, "y", config="default")
    model = pipelines.run_model(woe, "y", top=2)
    assert "WOE_x" in model.model.variables and model.scored.where("Score is null").count() == 0


def test_stepwise_report_against_newton(spark):
    """Few patterns are fitted on the driver, many over the table: the same coefficients, and those of plain Newton steps."""
    import numpy as np

    from scoreweave.operators import logistic

    r = np.random.default_rng(0)
    x = r.integers(0, 4, (3000, 3)).astype(float)
    y = (r.random(3000) < 1 / (1 + np.exp(-(-1 + 0.8 * x[:, 0] - 0.5 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "u double, v double, w double, y int")
    grouped = logistic.patterns(df, "y", ["u", "v", "w"])
    near, far = logistic.fit(logistic.Local(grouped, ["u", "v", "w"]), ["u", "v"]), logistic.fit(grouped, ["u", "v"])
    grouped.unpersist()
    full, beta = np.column_stack((np.ones(3000), x[:, :2])), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-full @ beta))
        hessian = (full * (p * (1 - p))[:, None]).T @ full
        beta = beta + np.linalg.solve(hessian, full.T @ (y - p))
    assert np.allclose(near.beta, beta, atol=1e-6) and np.allclose(far.beta, beta, atol=1e-6)
    assert np.allclose(near.errors, np.sqrt(np.diag(np.linalg.inv(hessian))), atol=1e-6)
    model = logistic.stepwise(df, "y", ["u", "v", "w"])
    assert set(model.variables) >= {"u", "v"}
    row = {t["Variable"]: t for t in model.table(spark).collect()}["u"]
    assert row["odds_low"] < row["odds_ratio"] < row["odds_high"] and row["p_value"] < 1e-6 and abs(np.log(row["odds_ratio"]) - row["coefficient"]) < 1e-9


def test_running_sums(spark):
    from scoreweave.operators import evaluation

    df = spark.createDataFrame([(k / 7.0, k % 5) for k in range(1000)], "p double, n long").repartition(5)
    got = {r["p"]: (r["n_in"], r["n_all"]) for r in evaluation.running(df, "p", ["n"]).collect()}
    assert got == {k / 7.0: (sum(j % 5 for j in range(k, 1000)), 2000) for k in range(1000)}


def test_quotes_and_categories(spark):
    from pyspark.sql import functions as F

    from scoreweave.functions import scalar
    from scoreweave.operators import binning

    deep = "\"'" * 6 + "x" + "'\"" * 6
    assert spark.createDataFrame([(deep,)], "t string").select(scalar.clean_text(F.col("t"))).first()[0] == "x"
    df = spark.createDataFrame([(f"c{k}", float(k), k % 2) for k in range(60)], "f string, x double, y int")
    assert binning.get_bins(df, "y", ["f", "x"]).too_many == ["f"]


def test_covariances_are_merged_from_tasks(spark):
    """One row a task leaves the rows, and the matrix is that of all rows."""
    x = np.random.default_rng(6).normal(size=(3000, 4)) @ np.diag([1, 10, 0.1, 0]) + 1000
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double, d double").repartition(7)
    assert np.allclose(selection._covariances(df, 4), np.cov(x.T, bias=True), rtol=1e-9, atol=1e-9)
    assert (selection._covariances(df.where("a < 0"), 4) == 0).all()
