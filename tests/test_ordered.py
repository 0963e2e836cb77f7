"""Distributed order-dependent work and exact splits against one-pass brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreweave.operators import exact_splits, ordered, splitters

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    """A value that a third of the rows hold, nulls, two groups of unlike size."""
    r = random.Random(3)
    rows = [("a" if k % 7 else "b", 5.0 if k % 3 == 0 else None if k % 50 == 1 else float(r.randrange(200)), k, r.randrange(3)) for k in range(2000)]
    return spark.createDataFrame(rows, "g string, x double, k int, y int"), rows


@pytest.mark.parametrize("part_rows", [None, 150])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_numbered(skewed, by, part_rows):
    df, rows = skewed
    got = {r["k"]: (r["_at"], r["_rows"]) for r in ordered.numbered(df, [F.col("x").desc_nulls_last(), F.col("k")], by, part_rows).collect()}
    for g in "ab" if by else [None]:
        mine = sorted((r for r in rows if g in (None, r[0])), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert all(got[r[2]] == (i, len(mine)) for i, r in enumerate(mine, 1))


@pytest.mark.parametrize("part_rows", [None, 20])
@pytest.mark.parametrize("descending", [True, False])
def test_running(skewed, descending, part_rows):
    df, rows = skewed
    hist = df.where("x is not null").groupBy("g", "x").agg(F.count("*").alias("n"), F.sum("y").alias("e"))
    got = {(r["g"], r["x"]): (r["n_in"], r["e_in"], r["n_all"], r["e_all"]) for r in ordered.running(hist, "x", ["n", "e"], ["g"], descending, part_rows).collect()}
    for g, x, _, _ in rows:
        if x is not None:
            mine = [r for r in rows if r[0] == g and r[1] is not None]
            upto = [r for r in mine if (r[1] >= x if descending else r[1] <= x)]
            assert got[g, x] == (len(upto), sum(r[3] for r in upto), len(mine), sum(r[3] for r in mine))


@pytest.mark.parametrize("width", [1, 4, 5, 900, 5000])
@pytest.mark.parametrize("part_rows", [None, 300])
def test_rolling_mean(skewed, width, part_rows):
    df, rows = skewed
    got = {r["k"]: r["rolling"] for r in ordered.rolling_mean(df, "x", [F.col("k").desc()], width, ["g"], part_rows=part_rows).collect()}
    for g in "ab":
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: -r[2])
        for i, r in enumerate(mine):
            near = [s[1] for s in mine[max(0, i - width // 2) : i + (width - 1) // 2 + 1] if s[1] is not None]
            assert got[r[2]] == pytest.approx(sum(near) / len(near)) if near else got[r[2]] is None


def test_quantiles(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CLASSES", 8)
    monkeypatch.setattr(ordered, "FEW", 20)
    r = np.random.default_rng(1)
    columns = {"normal": r.normal(size=3000), "hot": np.where(r.random(3000) < 0.4, 7.0, r.integers(0, 50, 3000)), "wide": 10.0 ** r.integers(-30, 30, 3000), "one": np.full(3000, 2.5)}
    columns["holes"] = np.where(r.random(3000) < 0.1, np.nan, columns["normal"])
    df = spark.createDataFrame([tuple(float(x) for x in row) for row in zip(*columns.values())], list(columns)).repartition(5)
    at = [0.0, 0.001, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = ordered.quantiles(df, {c: at for c in columns}, small=10)
    for c, v in columns.items():
        assert np.allclose(got[c], np.quantile(v[~np.isnan(v)], at), rtol=1e-12), c
    plain = ordered.quantiles(df, {c: at for c in columns})
    assert all(np.allclose(got[c], plain[c], rtol=1e-12) for c in columns)
    assert ordered.quantiles(df.limit(0), {"one": [0.5]}) == {"one": []}


# ---------------------------------------------------------------- exact splits

NAMES = ["l_extendedprice", "l_quantity", "l_partkey"]


@pytest.fixture(scope="module")
def loans(spark):
    odd = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31) % 1000
    t = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("isBad", (odd < 50 + 6 * F.col("l_quantity")).cast("int"))
    return t.withColumn("l_partkey", F.when(F.col("l_partkey") % 9 != 0, F.col("l_partkey"))).select(*NAMES, "isBad")


@pytest.fixture(scope="module")
def rungs(loans):
    return exact_splits.ladder(loans, "isBad", NAMES)


@pytest.fixture(scope="module")
def arrays(loans):
    t = loans.toPandas()
    out = {}
    for v in NAMES:
        g = t[t[v].notna()].groupby(v)["isBad"].agg(["count", "sum"]).sort_index()
        out[v] = g.index.to_numpy(float), g["count"].to_numpy(), g["sum"].to_numpy()
    return out


@pytest.mark.parametrize("config", [splitters.Split(max_bins=6, min_share=0.05), splitters.Split(max_bins=10), splitters.Split(max_bins=4, min_share=0.45, retry=False), splitters.Split(adaptive=True, min_events=True)])
def test_cart_is_the_tree_over_all_values(rungs, arrays, config):
    got = exact_splits.cart(rungs, config)
    for v, (x, n, b) in arrays.items():
        assert got[v] == [float(x[k]) for k in splitters.cart(n, b, config)]


def test_least_leaf():
    assert splitters.least_leaf(10_000, 5_000, splitters.Split()) == 100
    assert splitters.least_leaf(400, 200, splitters.Split(min_share=0.1, adaptive=True)) == 20
    assert splitters.least_leaf(10_000, 100, splitters.Split(adaptive=True)) == 400  # 20 bins of five events, a fifth off
    assert splitters.least_leaf(1_000, 10, splitters.Split(min_events=True)) == 500


def isotonic_fit(n, b, sign):
    """max over begins of min over ends of the mean: the monotone fit by its definition."""
    cn, cb = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(sign * b))
    mean = lambda i, j: (cb[j] - cb[i]) / (cn[j] - cn[i])
    return [max(min(mean(i, j) for j in range(k + 1, len(cn))) for i in range(k + 1)) for k in range(len(n))]


@pytest.mark.parametrize("part_rows", [None, 40])
def test_isotonic_blocks(spark, part_rows):
    r = np.random.default_rng(5)
    rows, want = [], {}
    for v, sign, slope in (("up", 1, 0.4), ("down", -1, -0.4), ("flat", 1, 0.0)):
        x = np.sort(r.choice(1000, 150, replace=False)).astype(float)
        n = r.integers(1, 9, 150)
        b = r.binomial(n, np.clip(0.5 + slope * (x / 1000 - 0.5), 0, 1))
        rows += [(v, *map(float, p)) for p in zip(x, n, b)]
        want[v] = x, isotonic_fit(n, b, sign)
    df = spark.createDataFrame(rows, "var string, x double, n double, b double").select("var", "x", F.col("n").cast("long").alias("n"), F.col("b").cast("long").alias("b")).repartition(4)
    got = exact_splits.blocks(df, {"up": 1, "down": -1, "flat": 1}, part_rows).collect()
    for v, (x, fit) in want.items():
        mine = sorted((g["low"], g["high"], g["b"] / g["n"]) for g in got if g["var"] == v)
        level = [next(rate for low, high, rate in mine if low <= z <= high) for z in x]
        assert np.allclose(level, fit if v != "down" else [-f for f in fit])
        assert len({round(f, 12) for f in fit}) == len(mine)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 9])
def test_nearest_means_are_optimal(k):
    r = random.Random(k)
    for _ in range(30):
        p = sorted(r.choice([0, 100]) + r.random() * r.choice([1, 40]) for _ in range(9))
        cost = lambda cut: sum(float(((v := np.array(p[i:j])) - v.mean()) @ (v - v.mean())) for i, j in zip((0, *cut), (*cut, 9)))
        best = min(itertools.combinations(range(1, 9), k - 1), key=cost)
        want = [np.mean(p[i:j]) for i, j in zip((0, *best), (*best, 9))]
        assert np.allclose(exact_splits.nearest_means(np.array(p), k), want)


def test_isotonic_and_spline_bins(loans, rungs, arrays):
    """All rows are in a bin, bins have rows enough, cuts are those of the whole arrays."""
    for method in ("isotonic", "spline", "cart"):
        config = splitters.Split(method, max_bins=6, min_share=0.05)
        bins = exact_splits.get_bins(loans, "isBad", NAMES, config)
        for v, (x, n, b) in arrays.items():
            made = [z for z in bins.by_var[v] if not z.missing]
            assert 1 < len(made) <= 6 and sum(z.n for z in made) == n.sum() and sum(z.bads for z in made) == b.sum()
            for z in made:
                low, high = z.intervals[0]
                inside = (x > low) & (x <= high)
                assert (z.n, z.bads) == (n[inside].sum(), b[inside].sum())
        assert [z.n for z in bins.by_var["l_partkey"] if z.missing] == [loans.where("l_partkey is null").count()]


def test_rolling_rates_of_rows(spark):
    """Distinct values: the rates are those of a rolling mean over the sorted rows."""
    r = np.random.default_rng(8)
    y = (r.random(1200) < np.linspace(0.1, 0.8, 1200)).astype(int)
    df = spark.createDataFrame([(float(k), int(v)) for k, v in enumerate(y)], "x double, isBad int")
    rungs = exact_splits.ladder(df, "isBad", ["x"])
    x, rate = exact_splits.rolling_rates(rungs, {"x": 1200})["x"]
    width = 1200 // 30
    want = [y[max(0, int(p) - width // 2) : int(p) + (width - 1) // 2 + 1].mean() for p in x]
    assert len(x) == 500 and np.allclose(rate, want)


def test_smoothing_spline_is_that_of_a_dense_solve():
    r = np.random.default_rng(2)
    x = np.sort(r.random(60)) * 50
    y = np.sin(x / 6) + 0.1 * r.normal(size=60)
    values, bend = exact_splits.smoothing_spline(x, y, bound := 0.4)
    assert ((y - values) ** 2).sum() <= bound and ((y - values) ** 2).sum() > 0.99 * bound
    h = np.diff(x)
    q, rr = np.zeros((60, 58)), np.zeros((58, 58))
    for k in range(58):
        q[k, k], q[k + 1, k], q[k + 2, k] = 1 / h[k], -1 / h[k] - 1 / h[k + 1], 1 / h[k + 1]
        rr[k, k] = (h[k] + h[k + 1]) / 3
        if k < 57:
            rr[k, k + 1] = rr[k + 1, k] = h[k + 1] / 6
    weight = np.linalg.lstsq((q @ bend[1:-1])[:, None], y - values, rcond=None)[0][0]
    assert np.allclose(bend[1:-1], np.linalg.solve(rr + weight * q.T @ q, q.T @ y), atol=1e-6)
    assert len(exact_splits.inflections(x, y, smoothing=0.01)) > 1


def test_inflection_of_a_cubic():
    x = np.linspace(0, 10, 200)
    assert exact_splits.inflections(x, 0.5 + ((x - 4) ** 3) / 600) == pytest.approx([4.0])


def test_rolling_rate_writes_narrow_tables(spark, monkeypatch):
    """Two intermediate tables, with the columns that are wanted: not five with all of lineitem."""
    from scoreweave import suite

    written, write = [], ordered.materialize
    monkeypatch.setattr(ordered, "materialize", lambda df, name: written.append(df.columns) or write(df, name))
    monkeypatch.setattr(ordered, "PART_ROWS", 1000)
    assert suite.QUERIES["rolling_rate"](spark, "/root/testdata/sf0.001").count() > 5000
    assert len(written) == 2 and max(map(len, written)) <= 12


def test_quantile_classes_are_counted_within_tasks(spark):
    """A row per class and task leaves the tasks, whatever their rows; the counts are those of the sorted values."""
    r = np.random.default_rng(4)
    v = np.concatenate([r.normal(size=4000), np.repeat(0.5, 1000), [np.nan] * 50])
    t = spark.createDataFrame([(None if np.isnan(x) else float(x), float(k)) for k, x in enumerate(v)], "x0 double, x1 double")
    known = v[~np.isnan(v)]
    got = ordered._classes(t, 2, [(0, known.min(), 0.5, True), (1, 10.0, 19.0, False)]).collect()
    first = [g for g in got if g["i"] == 0]
    assert len(first) <= ordered.CLASSES and sum(g["n"] for g in first) == (known <= 0.5).sum()
    assert all(g["n"] == ((known >= g["lo"]) & (known <= g["hi"])).sum() for g in first)
    assert sorted((g["cls"], g["n"]) for g in got if g["i"] == 1) == [(float(k), 1) for k in range(10, 20)]
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    assert np.allclose(ordered.quantiles(t, {"x0": shares}, small=10)["x0"], np.quantile(known, shares), rtol=0, atol=1e-12)


def reads_of(spark, monkeypatch, run):
    """How often rows leave a table for the driver while `run` runs."""
    cls, reads = type(spark.range(1)), []
    for name in ("collect", "count"):  # `first` collects
        plain = getattr(cls, name)
        monkeypatch.setattr(cls, name, lambda df, plain=plain: reads.append(df) or plain(df))
    return run(), len(reads)


@pytest.mark.parametrize("small", [10, 200_000])
def test_least_and_greatest_take_one_read(spark, monkeypatch, small):
    """They are known with the counts: no pass over classes and no percentile; nulls, NaN and infinite values stay left out."""
    x = [None, float("nan"), float("inf"), -float("inf"), *(float(k % 40) - 3.5 for k in range(200)), 99.25]
    df = spark.createDataFrame([(v, None, 7.0) for v in x], "x double, none double, one double").repartition(3)
    monkeypatch.setattr(ordered, "_classes", None)
    got = ordered.quantiles(df, {"x": [0.0, 1.0], "none": [1.0], "one": [0.0, 1.0]}, small)
    assert got == {"x": [-3.5, 99.25], "none": [], "one": [7.0, 7.0]}
    assert ordered.quantiles(df.where("x is null"), {"x": [1.0], "one": [1.0]}, small) == {"x": [], "one": [7.0]}
    assert ordered.quantiles(df.limit(0), {"x": [1.0]}, small) == {"x": []}
    assert reads_of(spark, monkeypatch, lambda: ordered.quantiles(df, {"x": [1.0]}, small)) == ({"x": [99.25]}, 1)


def test_bins_read_the_rows_once(spark, monkeypatch):
    """Missing rows are counted with the values: the table itself is read by one job, nulls, NaN and infinite values have one bin."""
    inf, seen = float("inf"), spark.sparkContext.accumulator(0)
    rows = [(float(k % 50) if k % 7 else [None, float("nan"), inf, -inf][k % 4], None, None if k % 11 == 0 else int(k % 50 > 20 + k % 9)) for k in range(1000)]
    rows += [(None, 2.0, None)]  # without an outcome it counts nowhere

    def watched(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    df = spark.createDataFrame(rows, "x double, none double, isBad int").mapInPandas(watched, "x double, none double, isBad int")
    for method in ("cart", "isotonic", "spline"):
        before = seen.value
        bins = exact_splits.get_bins(df, "isBad", ["x", "none"], splitters.Split(method, max_bins=4)).by_var
        assert seen.value - before == len(rows)
        known = [(x, y) for x, _, y in rows if y is not None and x is not None and abs(x) < inf]
        gone = [y for x, _, y in rows if y is not None and not (x is not None and abs(x) < inf)]
        assert [(z.n, z.bads) for z in bins["x"] if z.missing] == [(len(gone), sum(gone))]
        assert [(z.n, z.bads, z.missing) for z in bins["none"]] == [(len(known) + len(gone), sum(y for _, y in known) + sum(gone), True)]
        made = [z for z in bins["x"] if not z.missing]
        assert len(made) > 1 and sum(z.n for z in made) == len(known)
        for z in made:
            low, high = z.intervals[0]
            assert (z.n, z.bads) == (len(inside := [y for x, y in known if low < x <= high]), sum(inside))
    empty = exact_splits.get_bins(df.limit(0), "isBad", ["x"], splitters.Split(max_bins=4))
    assert empty.by_var == {}
