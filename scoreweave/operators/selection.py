"""Variable selection: measures over bins, ranks, filters, collinearity and interaction screening.

Boosted trees of a large table are grown on its cells: trees of 32 bins see of a row its bins and its outcome only, so rows alike in both become one
cell with their number.  A tree's sample of 0.8 of the rows is drawn as binomial numbers of the cells, as if each row had been drawn.
"""

from __future__ import annotations

import uuid
from math import inf, isqrt

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..sources.shared import materialize, shared_dir
from .ordered import quantiles

MEASURES = ("iv", "entropy", "gini", "chi_square", "likelihood_ratio", "odds_ratio")
HIGH, MODERATE, CAP = 10.0, 5.0, 999.99
#: Rows of a part of the table that trees are grown on: each task reads its part from memory again and again, some 300 bytes a row.
TREE_ROWS = 1_000_000
#: Tables of more rows are grown on cells, if these are at most a quarter of the rows; cells that one task draws samples of.
CELL_ROWS, SHRUNK, DRAWN = 1_000_000, 4, 25_000
#: Bins of a variable, rate of learning, share of the rows that a tree is grown on, share of the variables that a node may split on (GBTClassifier's).
TREE_BINS, RATE, SHARE, SUBSET = 32, 0.1, 0.8, "0.5"
#: Groups in which tasks' co-moments are merged.
SALT = 32


def measures(bins: DataFrame) -> DataFrame:
    """bins (var, bin, count, bads, goods, woe...) -> a row per variable with all measures, from one aggregate."""
    by = Window.partitionBy("var")
    t = bins.select("var", "bin", F.col("count").cast("double").alias("n"), F.col("bads").cast("double").alias("b"), F.col("goods").cast("double").alias("g"))
    t = t.withColumns({"all_n": F.sum("n").over(by), "all_b": F.sum("b").over(by), "all_g": F.sum("g").over(by)})
    bits = lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
    h_in = bits(F.col("all_b") / F.col("all_n")) + bits(F.col("all_g") / F.col("all_n"))
    h = F.col("n") / F.col("all_n") * (bits(F.col("b") / F.col("n")) + bits(F.col("g") / F.col("n")))
    impure_in = 1 - (F.col("all_b") / F.col("all_n")) ** 2 - (F.col("all_g") / F.col("all_n")) ** 2
    impure = F.col("n") / F.col("all_n") * (1 - (F.col("b") / F.col("n")) ** 2 - (F.col("g") / F.col("n")) ** 2)
    eb, eg = F.col("n") * F.col("all_b") / F.col("all_n"), F.col("n") * F.col("all_g") / F.col("all_n")
    chi = F.when(eb > 0, (F.col("b") - eb) ** 2 / eb).otherwise(0.0) + F.when(eg > 0, (F.col("g") - eg) ** 2 / eg).otherwise(0.0)
    ratio = lambda o, e: F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0)
    db, dg = (F.when(F.col(x) > 0, F.col(x) / F.col(y)).otherwise(1e-4) for x, y in (("b", "all_b"), ("g", "all_g")))
    iv = (F.col("b") / F.col("all_b") - F.col("g") / F.col("all_g")) * F.log(db / dg)
    first, last = (F.min_by(F.col(x), "bin") for x in ("g", "b")), (F.max_by(F.col(x), "bin") for x in ("g", "b"))
    (g1, b1), (g2, b2) = first, last
    odds = F.when((F.count("*") == 2) & (g2 > 0) & (b2 > 0) & (b1 > 0), F.try_divide(F.try_divide(g1, g2), F.try_divide(b1, b2)))
    one = t.groupBy("var").agg(
        F.bround(F.sum(iv), 4).alias("iv"),
        F.bround(F.max(h_in), 5).alias("h_in"),
        F.bround(F.sum(h), 5).alias("h_out"),
        F.bround(F.max(impure_in), 5).alias("g_in"),
        F.bround(F.sum(impure), 5).alias("g_out"),
        F.bround(F.sum(chi), 5).alias("chi_square"),
        F.bround(2 * F.sum(ratio(F.col("b"), eb) + ratio(F.col("g"), eg)), 5).alias("likelihood_ratio"),
        F.bround(odds, 5).alias("odds_ratio"),
    )
    explained = lambda out, into, name: F.bround(F.when(F.col(into) > 0, 1 - F.col(out) / F.col(into)).otherwise(0.0), 5).alias(name)
    return one.select("var", "iv", explained("h_out", "h_in", "entropy"), explained("g_out", "g_in", "gini"), "chi_square", "likelihood_ratio", "odds_ratio")


def ranks(table: DataFrame, names: tuple[str, ...] = MEASURES) -> DataFrame:
    """Average ranks (1: highest; ties share the mean rank; null last), their mean, and the standard deviation as agreement."""
    out = table
    for m in names:
        order = Window.orderBy(F.col(m).desc_nulls_last())
        tie = F.count("*").over(Window.partitionBy(m))
        out = out.withColumn(f"{m}_rank", F.rank().over(order) + (tie - 1) / 2)
    r = F.array(*(F.col(f"{m}_rank").cast("double") for m in names))
    mean = F.aggregate(r, F.lit(0.0), lambda a, x: a + x) / len(names)
    spread = F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + (x - mean) ** 2) / max(1, len(names) - 1))
    return out.withColumns({"avg_rank": F.bround(mean, 2), "rank_agreement": F.bround(spread, 2)})


def choose(table: DataFrame, top: int, degree: int = 1, names: tuple[str, ...] = MEASURES, ties: bool = False) -> DataFrame:
    """Variables in the top lists of at least `degree` measures (1: union; all: intersection), with the number of lists.  With ties, all
    that equal the last of a list are in it."""
    long = table.unpivot(["var"], [F.col(m) for m in names], "measure", "value").where("value is not null")
    own = Window.partitionBy("measure")
    at = F.rank().over(own.orderBy(F.col("value").desc())) if ties else F.row_number().over(own.orderBy(F.col("value").desc(), "var"))
    return long.withColumn("at", at).where(F.col("at") <= top).groupBy("var").agg(F.count("*").alias("lists")).where(F.col("lists") >= degree)


def assemble(df: DataFrame, target: str, chosen: list[str], missed_too: list[str] = (), pairs: list[tuple[str, str]] = (), most_missed: int = 25, top: int = 10) -> DataFrame:
    """The table that goes on to the regression: the outcome, the chosen variables (as WOE where there is one), up to `most_missed` variables
    that discovery found beside them, and the products of the `top` interactions whose two variables are in."""
    at = lambda v: next((c for c in (v if v.startswith("WOE_") else f"WOE_{v}", v) if c in df.columns), None)
    names = dict.fromkeys(c for c in (at(v) for v in [*chosen, *list(missed_too)[:most_missed]]) if c and c != target)
    out = df.select(F.col(f"`{target}`"), *(F.col(f"`{c}`") for c in names))
    return add_interactions(out, [(a, b) for a, b in ((at(a), at(b)) for a, b in pairs) if a in names and b in names], top)


def correlations(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """(a, b, r) for all pairs, null pairs left out pair by pair, from one aggregate; null where a variable does not vary."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]

    def r(a: str, b: str):
        x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    row = df.agg(*(F.bround(r(a, b), digits).alias(str(k)) for k, (a, b) in enumerate(pairs))).first()
    return df.sparkSession.createDataFrame([(a, b, row[k]) for k, (a, b) in enumerate(pairs)], "a string, b string, r double")


def correlated_pairs(df: DataFrame, columns: list[str], limit: float = 0.85) -> DataFrame:
    """The pairs of `correlations` whose correlation is above the limit in size."""
    return correlations(df, columns).where(F.abs("r") > limit)


def variances(df: DataFrame, columns: list[str], least: float = 1e-10) -> DataFrame:
    """(variable, variance, low): sample variances, and whether one is too small to fit on."""
    row = df.agg(*(F.var_samp(f"`{c}`").alias(str(k)) for k, c in enumerate(columns)))
    each = F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"`{k}`").alias("variance"), F.coalesce(F.col(f"`{k}`") < least, F.lit(True)).alias("low")) for k, c in enumerate(columns)))
    return row.select(F.explode(each).alias("x")).select("x.*")


def overlaps(table: DataFrame, top: int, names: tuple[str, ...] = MEASURES) -> DataFrame:
    """(a, b, shared): how many variables the top lists of two measures share (a = b: the list's length)."""
    long = table.unpivot(["var"], [F.col(m) for m in names], "measure", "value").where("value is not null")
    at = F.row_number().over(Window.partitionBy("measure").orderBy(F.col("value").desc(), "var"))
    listed = long.withColumn("at", at).where(F.col("at") <= top).select("var", "measure")
    return listed.withColumnRenamed("measure", "a").join(listed.withColumnRenamed("measure", "b"), "var").groupBy("a", "b").agg(F.count("*").alias("shared"))


def _covariances(full: DataFrame, p: int) -> np.ndarray:
    """Population covariances of p columns without nulls.  Each task keeps its rows, means and co-moments only; tasks are merged in groups first."""

    def merged(parts):
        n, mean, co = 0, np.zeros(p), np.zeros((p, p))
        for rows, m, c in parts:
            delta, n = m - mean, n + rows
            co += c + np.outer(delta, delta) * ((n - rows) * rows / n)
            mean += delta * (rows / n)
        return pd.DataFrame({"n": [n], "mean": [mean.tobytes()], "co": [co.tobytes()]})

    def tally(frames):
        arrays = (pdf.to_numpy(float) for pdf in frames if len(pdf))
        yield merged((len(x), m, (x - m).T @ (x - m)) for x in arrays for m in [x.mean(axis=0)])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return merged((n, np.frombuffer(m, float), np.frombuffer(c, float).reshape(p, p)) for n, m, c in zip(pdf["n"], pdf["mean"], pdf["co"]) if n)

    shape = "n long, mean binary, co binary"
    some = full.mapInPandas(tally, shape).groupBy(F.pmod(F.spark_partition_id(), F.lit(SALT))).applyInPandas(add, shape)
    row = some.groupBy().applyInPandas(add, shape).first()
    return np.frombuffer(row["co"], float).reshape(p, p) / row["n"] if row and row["n"] else np.zeros((p, p))


def _matrix(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Correlation matrix and standard deviations with medians for nulls: two passes, whatever follows."""
    mid = df.agg(*(F.percentile_approx(f"`{c}`", 0.5, 10_000).alias(str(k)) for k, c in enumerate(columns))).first()
    full = df.select(*(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(mid[k] or 0))).alias(f"c{k}") for k, c in enumerate(columns)))
    cov = _covariances(full, len(columns))
    sd = np.sqrt(np.diag(cov))
    return cov / np.outer(np.where(sd > 0, sd, 1), np.where(sd > 0, sd, 1)), sd


def _vif(r: np.ndarray, sd: np.ndarray) -> np.ndarray:
    out, live = np.full(len(sd), CAP), np.flatnonzero(sd > 1e-10)
    if len(live):
        part = r[np.ix_(live, live)]
        if np.linalg.matrix_rank(part) == len(live):
            out[live] = np.minimum(np.diag(np.linalg.inv(part)), CAP)
        else:
            for k, i in enumerate(live):
                rest = np.delete(np.arange(len(live)), k)
                fit = part[k, rest] @ np.linalg.pinv(part[np.ix_(rest, rest)]) @ part[rest, k] if len(rest) else 0.0
                out[i] = min(1 / max(1 - fit, 1e-9), CAP)
    return np.round(out, 4)


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    values = _vif(*_matrix(df, columns))
    rows = [(c, float(v), "HIGH" if v > HIGH else "MODERATE" if v > MODERATE else "OK") for c, v in zip(columns, values)]
    return df.sparkSession.createDataFrame(rows, "variable string, vif double, status string")


def drop_collinear(df: DataFrame, columns: list[str], limit: float = HIGH) -> tuple[list[str], list[tuple[str, float]]]:
    """Removes the variable with the highest VIF until none reaches the limit; the data is read for the matrix only."""
    r, sd = _matrix(df, columns)
    left, gone = list(range(len(columns))), []
    while len(left) > 1:
        values = _vif(r[np.ix_(left, left)], sd[left])
        k = int(np.argmax(values))
        if values[k] < limit:
            break
        gone.append((columns[left.pop(k)], float(values[k])))
    return [columns[i] for i in left], gone


def add_interactions(df: DataFrame, pairs: list[tuple[str, str]], top: int = 10) -> DataFrame:
    held = [(a, b) for a, b in pairs if a in df.columns and b in df.columns][:top]
    return df.withColumns({f"{a}_x_{b}": F.col(f"`{a}`") * F.col(f"`{b}`") for a, b in held}) if held else df


def tree_parts(data: DataFrame, n: int, part_rows: int | None = None) -> DataFrame:
    """data (n rows) in parts of at most TREE_ROWS rows or so; small tables as they are."""
    part_rows = part_rows or TREE_ROWS
    return data if n <= part_rows else data.repartition(max(-(-n // part_rows), data.sparkSession.sparkContext.defaultParallelism))


def boosted_importance(df: DataFrame, target: str, columns: list[str], trees: int = 30, depth: int = 4, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(variable, importance) and (parent, child, times) of boosted trees: which variables split below which."""
    spark, n, path = df.sparkSession, df.count(), f"{shared_dir(df.sparkSession)}/trees-{uuid.uuid4().hex}"
    names = [f"x{k}" for k in range(len(columns))]
    rows = df.select(F.col(f"`{target}`").cast("double").alias("y"), *(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(x) for x, c in zip(names, columns)))
    cells = tree_cells(rows, names) if n > CELL_ROWS else None
    if cells is not None and cells.count() * SHRUNK <= n:
        grow_on_cells(cells, names, path, trees, depth, seed)
        nodes = tree_nodes(spark, f"{path}/tree-*")
    else:
        data = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(rows).select("features", "y")
        model = GBTClassifier(labelCol="y", maxIter=trees, maxDepth=depth, maxBins=TREE_BINS, stepSize=RATE, subsamplingRate=SHARE, featureSubsetStrategy=SUBSET, seed=seed).fit(tree_parts(data, n))
        model.write().overwrite().save(path)
        nodes = tree_nodes(spark, path)
    named = spark.createDataFrame(list(enumerate(columns)), "feature int, variable string")
    return tree_gain(nodes, named), tree_pairs(nodes, named)


def tree_edges(rows: DataFrame, names: list[str], bins: int = TREE_BINS) -> dict[str, list[float]]:
    """The inner edges of each variable's bins (a bin holds what is above one edge and not above the next): every value has its bin if there are `bins`
    at most, else quantiles, and a value that holds several of them has its bin."""
    about = rows.agg(*(F.approx_count_distinct(x).alias(x) for x in names)).first()
    some = [F.collect_set(x).alias(x) for x in names if about[x] <= 2 * bins]
    few = rows.agg(*some).first().asDict() if some else {}  # some 2 * bins values a variable
    edges = {x: sorted(v for v in few[x] if v == v)[:-1] if x in few else [] for x in names}
    cut = quantiles(rows, {x: [k / bins for k in range(1, bins)] for x in names if x not in few or len(edges[x]) >= bins})
    return edges | {x: sorted({*q, *(float(np.nextafter(v, -inf)) for v, w in zip(q, q[1:]) if v == w)}) for x, q in cut.items()}


def tree_cells(rows: DataFrame, names: list[str]) -> DataFrame:
    """(names, y, n): the rows' bins, from 1 up, their outcome and number; NaN is an error, as it is to GBTClassifier."""
    edges, out = tree_edges(rows, names), [f"{x}_bin" for x in names]
    splits = [[-inf, *sorted({float(np.nextafter(e, inf)) for e in edges[x]} - {inf} or {0.0}), inf] for x in names]
    binned = Bucketizer(splitsArray=splits, inputCols=names, outputCols=out, handleInvalid="error").transform(rows)
    return materialize(binned.select("y", *((F.col(b) + 1).cast("byte").alias(x) for x, b in zip(names, out))).groupBy(*names, "y").agg(F.count("*").alias("n")), "cells")


def grow_on_cells(cells: DataFrame, names: list[str], path: str, trees: int, depth: int, seed: int) -> None:
    """Saves the boosted trees (logistic loss, as GBTClassifier grows them) of cells (names, y, n) under `path`/tree-0, tree-1, ...

    Samples are drawn by part, from cells in one order, so that they do not depend on tasks."""
    count, odd = cells.agg(F.count("*"), F.count_if(~F.coalesce(F.col("y").isin(0.0, 1.0), F.lit(False)))).first()
    if odd:
        raise ValueError("the outcome must be 0 or 1 in every row")
    keys, sign, parts, share = [*names, "y"], 2 * F.col("y") - 1, -(-count // DRAWN), SHARE
    vector = VectorAssembler(inputCols=names, outputCol="features")
    t = cells.withColumns({"part": F.pmod(F.hash(*keys), F.lit(parts)), "score": F.lit(0.0)})
    held = t.columns
    shape = StructType([*t.schema.fields, StructField("w", LongType())])
    for m in range(trees):

        def draw(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(keys)
            return pdf.assign(w=np.random.default_rng([seed % 2**32, m, pdf["part"].iloc[0]]).binomial(pdf["n"], share))  # noqa: B023 (drawn at once)

        t = vector.transform(materialize(t.repartition(parts, "part").groupBy("part").applyInPandas(draw, shape), "drawn"))
        label = sign if m == 0 else 4 * sign / (1 + F.exp(2 * sign * F.col("score")))  # the outcome first, then what the trees so far leave of it
        data = t.where("w > 0").select("features", "w", label.alias("label"))
        # with this many bins Spark looks at all cells for the values to split between, and at all of these values
        forest = RandomForestRegressor(weightCol="w", numTrees=1, maxDepth=depth, maxBins=max(2 * TREE_BINS, isqrt(count) + 1), featureSubsetStrategy=SUBSET, subsamplingRate=1.0, bootstrap=False, seed=seed + m)
        model = forest.fit(tree_parts(data, count))
        model.write().save(f"{path}/tree-{m}")
        t = model.transform(t).withColumn("score", F.col("score") + (RATE if m else 1.0) * F.col("prediction")).select(*held)


def tree_nodes(spark, path: str) -> DataFrame:
    """(tree, node, left, right, feature, gain) of saved ensembles of trees (`path` may be a pattern): their inner nodes, with the gain of all rows."""
    t = spark.read.parquet(f"{path}/data").select(F.struct(F.regexp_extract("_metadata.file_path", "(.*)/[^/]*$", 1), "treeID").alias("tree"), "nodeData.*")
    gain = F.col("gain") * F.col("impurityStats")[0]
    return t.where("leftChild >= 0").select("tree", F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"), gain.alias("gain"))


def tree_gain(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(variable, importance): each variable's share of the gain of all nodes."""
    own = names.join(nodes.groupBy("feature").agg(F.sum("gain").alias("gain")), "feature", "left").select("feature", "variable", F.coalesce("gain", F.lit(0.0)).alias("gain"))
    return own.crossJoin(own.agg(F.sum("gain").alias("all"))).select("variable", F.coalesce(F.try_divide("gain", "all"), F.lit(0.0)).alias("importance"))  # a row per variable


def tree_pairs(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(parent, child, times): how often a variable splits right below another one; a self-join of the node table."""
    child = nodes.select("tree", F.col("node").alias("below"), F.col("feature").alias("child_feature"))
    ends = nodes.select("tree", "feature", F.explode(F.array("left", "right")).alias("below"))
    pairs = ends.join(child, ["tree", "below"]).where("feature <> child_feature").groupBy("feature", "child_feature").agg(F.count("*").cast("int").alias("times"))
    known = pairs.join(names.withColumnRenamed("variable", "parent"), "feature")
    return known.join(names.select(F.col("feature").alias("child_feature"), F.col("variable").alias("child")), "child_feature").select("parent", "child", "times")


def missed(importance: DataFrame, chosen: list[str], top: int = 25, share: float = 0.05) -> DataFrame:
    """Important variables that the measures left out: the top ones with at least the share of the greatest importance."""
    known = importance.sparkSession.createDataFrame([(c.removeprefix("WOE_"),) for c in chosen] or [("",)], "known string")
    most = importance.agg(F.max("importance")).first()[0] or 0.0
    first = importance.where(F.col("importance") >= share * most).orderBy(F.col("importance").desc(), "variable").limit(top)
    return first.join(known, F.regexp_replace("variable", "^WOE_", "") == F.col("known"), "left_anti")


def pair_gain(df: DataFrame, target: str, columns: list[str], top: int = 20) -> DataFrame:
    """Interaction screen: what a pair's joint cells explain of the outcome beyond the two variables alone.

    Columns hold few distinct values (binned or WOE).  Additive information per cell count; one aggregate per pair over grouped
    cells, not over rows."""
    cells = df.groupBy(*(F.col(f"`{c}`") for c in columns)).agg(F.count("*").alias("_n"), F.sum(F.col(target).cast("long")).alias("_b"))

    def explained(keys: list[str]):
        t = cells.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.sum("_n").alias("n"), F.sum("_b").alias("b"))
        return t.agg(F.sum(F.col("b") * F.col("b") / F.col("n"))).first()[0]

    cells = cells.cache()
    one = {c: explained([c]) for c in columns}
    rows = [(a, b, float(explained([a, b]) - max(one[a], one[b]))) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells.unpersist()
    return df.sparkSession.createDataFrame(rows, "a string, b string, gain double").orderBy(F.col("gain").desc()).limit(top)
