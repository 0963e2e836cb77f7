"""Additive discovery, tree pairs, the penalised regression and the streaming binner against planted effects, walks and plain numpy."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from scoreweave.operators import additive, logistic, selection, splitters
from scoreweave.streaming import sketch


@pytest.fixture(scope="module")
def planted(spark):
    r = np.random.default_rng(4)
    x = r.random((6000, 4)) * 10
    eta = 0.4 * (x[:, 0] - 5) + 1.2 * (x[:, 1] > 7) - 1 + 1.5 * np.sign(x[:, 2] - 5) * np.sign(x[:, 3] - 5)
    y = (r.random(6000) < 1 / (1 + np.exp(-eta))).astype(int)
    return spark.createDataFrame([(*map(float, row), int(v)) for row, v in zip(x, y)], "steep double, step double, left double, right double, isBad int").repartition(3)


def test_additive_model_finds_what_was_planted(spark, planted):
    model = additive.fit(planted, "isBad", ["steep", "step", "left", "right"])
    assert [v for v, _ in model.importance()[:2]] == ["steep", "step"]
    first = model.interactions(spark).collect()
    assert first[0]["interaction"] == "left x right" and first[0]["magnitude"] > 3 * first[1]["magnitude"] and len(first) == 6
    shape = model.shapes[0][: len(model.edges["steep"]) + 1]
    assert np.corrcoef(shape, np.arange(len(shape)))[0, 1] > 0.97


def test_additive_model_is_the_regression_on_bins(spark, planted):
    """Cycles end where the regression on indicators of the bins does (up to the ridge)."""
    model = additive.fit(planted, "isBad", ["step", "left"], bins=4, steps=20, cycles=200)
    rows, _ = additive.encoded(planted, "isBad", ["step", "left"], 4)
    data = [(*r["codes"], r["y"]) for r in rows.collect()]
    codes, y = np.array([d[:2] for d in data]), np.array([d[2] for d in data])
    x = np.column_stack([np.ones(len(y)), *(codes[:, k] == c for k in (0, 1) for c in (1, 2, 3))]).astype(float)
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    want = beta[0] + np.append(0, beta[1:4])[codes[:, 0]] + np.append(0, beta[4:])[codes[:, 1]]
    got = model.base + model.shapes[0][codes[:, 0]] + model.shapes[1][codes[:, 1]]
    assert np.abs(got - want).max() < 0.02


def test_importance_joined_with_measures(spark):
    measures = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 30.0)], "var string, avg_rank double")
    got = {r["var"]: r for r in additive.with_importance(measures, spark.createDataFrame([("WOE_a", 0.1), ("b", 0.9)], "variable string, importance double")).collect()}
    assert [got[v]["importance_rank"] for v in "abc"] == [2.0, 1.0, 3.0] and [got[v]["disagrees"] for v in "abc"] == [False, False, True] and got["c"]["importance"] is None


def test_tree_pairs_equal_a_walk(spark, planted):
    columns = ["steep", "step", "left", "right"]
    links = {(r["parent"], r["child"]): r["times"] for r in selection.boosted_importance(planted, "isBad", columns, trees=4, depth=3)[1].collect()}
    assert links and all(a != b for a, b in links)
    nodes = spark.createDataFrame([(0, 0, 1, 2, 0), (0, 1, 3, 4, 1), (0, 2, 5, 6, 0), (1, 0, 1, 2, 1), (1, 2, 3, 4, 0)], "tree int, node int, left int, right int, feature int")
    names = spark.createDataFrame([(0, "x"), (1, "y")], "feature int, variable string")
    assert {tuple(r) for r in selection.tree_pairs(nodes, names).collect()} == {("x", "y", 1), ("y", "x", 1)}


@pytest.mark.parametrize("few", [True, False])
def test_separated_outcome(spark, few):
    """Separated rows end with finite coefficients, those of a proximal-gradient solution of the same objective."""
    x = np.arange(40) / 10.0
    y, z = (x > 2.05).astype(int), np.sin(np.arange(40))
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, z, y)], "x double, z double, y int")
    grouped = logistic.patterns(df, "y", ["x", "z"])
    model = logistic.fit(logistic.Local(grouped, ["x", "z"]) if few else grouped, ["x", "z"])
    assert model.separated and np.isfinite(model.beta).all() and np.abs(model.beta).max() < 200
    data, beta = np.column_stack([np.ones(40), x, z]), model.beta
    goal = lambda b: np.logaddexp(0, (1 - 2 * y) * (data @ b)).sum() + logistic.ALPHA * np.abs(b).sum()
    slope = data.T @ (y - 1 / (1 + np.exp(-data @ beta)))
    assert all(abs(s) <= logistic.ALPHA * (1 + 1e-3) if b == 0 else abs(s - logistic.ALPHA * np.sign(b)) < 1e-4 for s, b in zip(slope, beta))
    r = np.random.default_rng(0)
    assert all(goal(beta) <= goal(beta + r.normal(size=3) * s) + 1e-9 for s in (0.01, 0.1, 1, 5) for _ in range(50))
    plain = logistic.fit(logistic.Local(logistic.patterns(df.withColumn("y", (F.col("z") > F.col("x") / 4 - 0.5).cast("int") * 0 + F.pmod(F.floor(F.col("x") * 10), F.lit(2)).cast("int")), "y", ["x"]), ["x"]), ["x"])
    assert not plain.separated


# ---------------------------------------------------------------- sketch and stream


def test_sketch_ranks():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=150_000), np.full(50_000, 0.25), [np.nan] * 10])
    one, parts = sketch.Sketch().add(x), [sketch.Sketch().add(p) for p in np.array_split(r.permutation(x), 7)]
    for p in parts[1:]:
        parts[0].merge(p)
    x = np.sort(x[~np.isnan(x)])
    for s in (one, parts[0]):
        assert s.n == 200_000 and sum(map(len, s.levels)) < 4 * sketch.K and sum(len(v) * 2**i for i, v in enumerate(s.levels)) == 200_000
        for q, v in zip(at := np.arange(1, 100) / 100, s.quantile(at)):
            low, high = np.searchsorted(x, v, "left") / 200_000, np.searchsorted(x, v, "right") / 200_000
            assert low - 0.01 <= q <= high + 0.01
    assert np.isnan(sketch.Sketch().quantile([0.5])).all()


def test_stream_in_batches_and_after_a_restart(spark, tmp_path):
    """Several micro-batches, then a restart from the checkpoint with more files: counts are those of all rows, quantiles within the error."""
    r = np.random.default_rng(1)
    x = r.gamma(2, 50, 9000)
    y = (r.random(9000) < x / 400).astype(int)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "value double, isBad int")
    source, folder = f"{tmp_path}/in", f"{tmp_path}/state"
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    edges = [50.0, 100.0, 200.0]
    rows.limit(5000).repartition(3).write.parquet(source)
    sketch.run(stream(), "value", "isBad", folder, edges=edges, shards=3)
    half = sketch.load(spark, folder)
    rows.subtract(rows.limit(5000)).repartition(2).write.mode("append").parquet(source)
    sketch.run(stream(), "value", "isBad", folder, edges=edges, shards=3)
    got = sketch.load(spark, folder)
    assert half.exact[0].sum() == 5000
    at = np.searchsorted(edges, x, side="left")
    assert got.exact[0].tolist() == np.bincount(at, minlength=4).tolist() and got.exact[1].tolist() == np.bincount(at[y == 1], minlength=4).tolist()
    for q, v in zip((0.1, 0.5, 0.9), sketch.Sketch().merge(got.events).merge(got.others).quantile([0.1, 0.5, 0.9])):
        assert abs((x <= v).mean() - q) < 0.02
    splits = got.splits(splitters.Split("iv_optimal", max_bins=5, min_share=0.05))
    assert 1 <= len(splits) <= 9 and splits == sorted(splits)
    assert spark.read.parquet(f"{folder}/shards").select("batch").distinct().count() >= 5


def test_trees_are_grown_on_parts_of_bounded_size(spark, planted, monkeypatch):
    seen, parts = [], selection.tree_parts
    monkeypatch.setattr(selection, "TREE_ROWS", 100)
    monkeypatch.setattr(selection, "tree_parts", lambda data, n: seen.append(parts(data, n)) or seen[-1])
    gain = selection.boosted_importance(planted, "isBad", ["steep", "step"], trees=1, depth=1)[0]
    assert gain.count() == 2 and max(seen[0].rdd.glom().map(len).collect()) <= 200 and seen[0].count() == planted.count()
    assert selection.tree_parts(planted, 100) is planted


@pytest.fixture(scope="module")
def coarse(spark):
    """Few values a column, some null, one of them rare and found in one cell only."""
    r = np.random.default_rng(8)
    x = np.column_stack([r.integers(0, 9, 8000), r.integers(0, 5, 8000), r.integers(0, 3, 8000)]).astype(float)
    x[:200] = 20.0, 0.0, 0.0
    eta = 0.5 * (x[:, 0] - 4) + 1.1 * (x[:, 1] > 2) * (x[:, 2] - 1) - 1
    y = (r.random(8000) < 1 / (1 + np.exp(-np.clip(eta, -4, 4)))).astype(int)
    some = lambda v, k: None if k % 97 == 0 else float(v)
    return spark.createDataFrame([(some(a, k), float(b), float(c), int(v)) for k, ((a, b, c), v) in enumerate(zip(x, y))], "first double, `sec.ond` double, third double, isBad int").repartition(3)


def _trees(df, columns, **more):
    gain, pairs = selection.boosted_importance(df, "isBad", columns, **more)
    return {r["variable"]: r["importance"] for r in gain.collect()}, {(r["parent"], r["child"]): r["times"] for r in pairs.collect()}


def test_trees_on_cells_are_those_on_rows(spark, coarse, monkeypatch):
    """Without samples, trees grown on cells are GBTClassifier's on the rows, and tasks see cells only."""
    monkeypatch.setattr(selection, "SHARE", 1.0)
    monkeypatch.setattr(selection, "SUBSET", "all")
    columns, seen, parts = ["first", "sec.ond", "third"], [], selection.tree_parts
    monkeypatch.setattr(selection, "tree_parts", lambda data, n: seen.append(data.count()) or parts(data, n))
    rows = _trees(coarse, columns, trees=5, depth=3)
    assert seen == [8000]
    monkeypatch.setattr(selection, "CELL_ROWS", 100)
    monkeypatch.setattr(selection, "DRAWN", 50)
    cells = _trees(coarse, columns, trees=5, depth=3)
    assert len(seen) == 6 and max(seen[1:]) <= 2 * 12 * 6 * 4
    assert cells[1] == rows[1] and len(rows[1]) >= 3 and rows[0] == pytest.approx(cells[0], rel=1e-6) and sum(cells[0].values()) == pytest.approx(1)


def test_samples_of_cells(spark, coarse, monkeypatch):
    """Samples are of the wanted size, differ from tree to tree and do not depend on how the rows lie."""
    monkeypatch.setattr(selection, "CELL_ROWS", 100)
    monkeypatch.setattr(selection, "DRAWN", 50)
    drawn, parts = [], selection.tree_parts
    monkeypatch.setattr(selection, "tree_parts", lambda data, n: drawn.append(data.agg(F.sum("w")).first()[0]) or parts(data, n))
    one = _trees(coarse, ["first", "sec.ond", "third"], trees=4, depth=2)
    two = _trees(coarse.repartition(7, "third"), ["first", "sec.ond", "third"], trees=4, depth=2)
    assert drawn[:4] == drawn[4:] and len(set(drawn[:4])) > 1 and all(abs(w - 6400) < 6 * 36 for w in drawn)
    assert one[1] == two[1] and one[0] == pytest.approx(two[0], rel=1e-9)
    with pytest.raises(ValueError):
        _trees(coarse.withColumn("isBad", F.when(F.col("third") > 0, F.col("isBad"))), ["first"], trees=1)
    assert _trees(coarse.withColumn("same", F.lit(7.0)), ["same", "third"], trees=1)[0]["same"] == 0.0


def test_edges_of_tree_bins(spark):
    r = np.random.default_rng(2)
    rows = [(float(k % 500 == 0) + float(k % 1000 == 0), 0.0 if k % 2 else float(v), 3.0, float("nan")) for k, v in enumerate(r.random(4000) + 1)]
    edges = selection.tree_edges(spark.createDataFrame(rows, "rare double, half double, same double, none double").repartition(4), ["rare", "half", "same", "none"])
    assert edges["rare"] == [0.0, 1.0] and edges["same"] == [] and edges["none"] == []
    low, at, *rest = edges["half"]
    assert low < 0 == at and -1e-300 < low and 14 <= len(rest) <= 16 and np.allclose(np.quantile([x[1] for x in rows], np.arange(17, 32) / 32), rest[-15:])


def test_gain_of_nodes_is_sparks_importance(spark, planted, tmp_path):
    columns = ["steep", "step", "left", "right"]
    model = GBTClassifier(labelCol="isBad", maxIter=3, maxDepth=3, seed=1).fit(VectorAssembler(inputCols=columns, outputCol="features").transform(planted))
    model.write().save(f"{tmp_path}/trees")
    named = spark.createDataFrame([*enumerate(columns), (4, "unused")], "feature int, variable string")
    got = {r["variable"]: r["importance"] for r in selection.tree_gain(selection.tree_nodes(spark, f"{tmp_path}/trees"), named).collect()}
    assert got == pytest.approx(dict(zip(columns, model.featureImportances.toArray())) | {"unused": 0.0}) and max(got.values()) > 0.3
