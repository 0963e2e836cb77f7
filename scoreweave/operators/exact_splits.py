"""Splits over all distinct values of a variable, however many there are.

Rows are read once and aggregated to (var, x, n, b) per distinct value, missing rows as one null (``counted``).  The values become one
*ladder*, with running sums cn and cb from the lowest value up (``ordered.running``).  A split is a place on the ladder, and what lies between two places is the difference of their running sums, so
no value is ever put into a class.

*CART.*  A node is a stretch of the ladder.  One aggregate finds the best cut of all open nodes of all variables: the greatest
Gini gain, by maximum, after partial aggregation.  The driver keeps the nodes (max_bins per variable) and cuts the best first.

*Isotonic.*  Pool-adjacent-violators on each part of the ladder gives a stack of blocks; stacks of neighbouring parts are joined and
pooled again, sixteen at a time, until a variable has one.  Blocks have rising rates, and N rows allow some N ** (2/3) different rates at
most (N ** (1/3) for noisy outcomes), so what a later round gathers is a vanishing share.  Too many blocks are brought to max_bins by the optimal one-dimensional
k-means of their borders.

*Spline.*  The rolling event rate around up to POINTS places of the ladder is the difference of two running sums.  It is fitted by a cubic polynomial and,
where that leaves more than the residual bound, by the cubic smoothing spline that meets the bound.  Cuts are the inflections, with
percentiles between 10 and 90 where these are few.

Nulls, NaN and infinite values are no part of the ladder; the bins of a variable hold its missing rows apart.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .binning import Bin, Bins
from .ordered import parted, running
from .splitters import Split, least_leaf

#: Places of the rolling rate at most (fixed value), parts joined at a time, borders up to which k-means looks at every one.
POINTS, TOGETHER = 500, 16


def counted(df: DataFrame, target: str, variables: list[str]) -> tuple[DataFrame, dict[str, Row]]:
    """(var, x, n, b), written once: rows and bads of each distinct value of each variable, its missing rows (null, NaN, infinite) at a null;
    and by variable its values (rungs), their rows and bads (n, b) and those that are missing (gone, gone_b)."""
    number = lambda v: F.col(f"`{v}`").cast("double")
    pairs = F.array(*(F.struct(F.lit(v).alias("var"), F.when(F.abs(number(v)) < float("inf"), number(v)).alias("x")) for v in variables))
    long = df.where(F.col(target).isNotNull()).select(F.col(target).cast("long").alias("y"), F.explode(pairs).alias("p")).select("p.var", "p.x", "y")
    counts = materialize(long.groupBy("var", "x").agg(F.count("*").alias("n"), F.sum("y").alias("b")), "counts")
    known, gone = F.col("x").isNotNull(), F.col("x").isNull()
    sums = [F.sum(F.when(rows, F.col(c))).alias(name) for rows, c, name in ((known, "n", "n"), (known, "b", "b"), (gone, "n", "gone"), (gone, "b", "gone_b"))]
    return counts, {r["var"]: r for r in counts.groupBy("var").agg(F.count("x").alias("rungs"), *sums).collect()}  # a row per variable


def ladder(df: DataFrame, target: str, variables: list[str], counts: tuple[DataFrame, dict[str, Row]] | None = None) -> DataFrame:
    """(var, x, n, b, cn, cb): the distinct values of each variable with rows and bads, and their running sums from below.

    counts: what `counted` gives, if it is there already."""
    counts, facts = counts or counted(df, target, variables)
    sums = running(counts.where("x is not null"), "x", ["n", "b"], ["var"], descending=False, n=sum(r["rungs"] for r in facts.values()))
    return materialize(sums.select("var", "x", "n", "b", F.col("n_in").alias("cn"), F.col("b_in").alias("cb")), "ladder")


def totals(rungs: DataFrame) -> dict[str, tuple[int, int]]:
    return {r["var"]: (r["n"], r["b"]) for r in rungs.groupBy("var").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).collect()}  # a row per variable


# ---------------------------------------------------------------- CART


def best_cuts(rungs: DataFrame, nodes: list[tuple[str, int, int, int, int, int]]) -> dict[tuple[str, int, int], tuple[float, int, int, float]]:
    """nodes (var, rows below, bads below, rows up to its end, bads up to its end, least rows) -> (var, below, end): the best
    cut's (gain, rows up to it, bads up to it, value); nodes without a gain are left out."""
    asked = rungs.sparkSession.createDataFrame(nodes, "its_var string, n0 long, b0 long, n1 long, b1 long, leaf long")
    inside = rungs.join(F.broadcast(asked), (F.col("var") == F.col("its_var")) & (F.col("cn") > F.col("n0")) & (F.col("cn") < F.col("n1")))  # some max_bins nodes a variable
    impure = lambda n, b: 2.0 * b * (n - b) / n
    left, right = (F.col("cn") - F.col("n0"), F.col("cb") - F.col("b0")), (F.col("n1") - F.col("cn"), F.col("b1") - F.col("cb"))
    gain = impure(F.col("n1") - F.col("n0"), F.col("b1") - F.col("b0")) - impure(*left) - impure(*right)
    fit = inside.where((left[0] >= F.col("leaf")) & (right[0] >= F.col("leaf"))).withColumn("gain", gain)
    one = fit.where("gain > 1e-12").groupBy("var", "n0", "n1").agg(F.max_by(F.struct("gain", "cn", "cb", "x"), F.struct("gain", -F.col("cn"))).alias("best"))
    return {(r["var"], r["n0"], r["n1"]): tuple(r["best"]) for r in one.collect()}


def cart(rungs: DataFrame, config: Split = Split(), all_rows: dict[str, tuple[int, int]] | None = None) -> dict[str, list[float]]:
    """variable -> the values after which its best-first tree cuts; all_rows: the totals, if they are there already."""
    all_rows = totals(rungs) if all_rows is None else all_rows
    leaf = {v: least_leaf(n, b, config) for v, (n, b) in all_rows.items()}
    cuts: dict[str, list[float]] = {v: [] for v in all_rows}
    trying = {v for v, (n, _) in all_rows.items() if n > 1}
    known: dict[tuple, tuple | None] = {}  # (var, below, end, least rows) -> best cut
    while trying:
        wanted, done = [], set()
        for v in trying:
            n, b = all_rows[v]
            heap, chosen, stuck = [], [], False

            def push(node: tuple[int, int, int, int]) -> bool:
                key = (v, node[0], node[2], leaf[v])
                if key not in known:
                    wanted.append((v, *node, leaf[v]))
                    return False
                if known[key]:
                    heapq.heappush(heap, (-known[key][0], node))
                return True

            stuck = not push((0, 0, n, b))
            while heap and len(chosen) < config.max_bins - 1 and not stuck:
                _, node = heapq.heappop(heap)
                _, cn, cb, x = known[v, node[0], node[2], leaf[v]]
                chosen.append(x)
                if len(chosen) < config.max_bins - 1:
                    stuck = not all([push((node[0], node[1], cn, cb)), push((cn, cb, node[2], node[3]))])
            if stuck:
                for _, node in heap:  # their halves are likely to be asked for next
                    _, cn, cb, _ = known[v, node[0], node[2], leaf[v]]
                    wanted += [(v, *h, leaf[v]) for h in ((node[0], node[1], cn, cb), (cn, cb, node[2], node[3])) if (v, h[0], h[2], leaf[v]) not in known]
            elif chosen or not config.retry or leaf[v] <= 10:
                cuts[v] = sorted(chosen)
                done.add(v)
            else:
                leaf[v] //= 2
        if wanted:
            found = best_cuts(rungs, sorted(set(wanted)))
            known |= {(v, n0, n1, least): found.get((v, n0, n1)) for v, n0, _, n1, _, least in wanted}
        trying -= done
    return cuts


# ---------------------------------------------------------------- isotonic


def pooled(n: np.ndarray, b: np.ndarray, sign: int) -> np.ndarray:
    """Where the blocks of the monotone fit begin: neighbours against the direction (or equal) are pooled."""
    rows, bads, first = [], [], []
    for k, (x, y) in enumerate(zip(n.tolist(), (sign * b).tolist())):
        rows.append(x), bads.append(y), first.append(k)
        while len(rows) > 1 and bads[-2] * rows[-1] >= bads[-1] * rows[-2]:
            x, y = rows.pop(), bads.pop()
            first.pop()
            rows[-1] += x
            bads[-1] += y
    return np.array(first, np.int64)


def blocks(rungs: DataFrame, signs: dict[str, int], part_rows: int | None = None) -> DataFrame:
    """(var, low, high, n, b): the blocks of each variable's monotone fit; signs: 1 rising, -1 falling."""
    shape = "var string, _part int, low double, high double, n long, b long"

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("low")
        first = pooled(pdf["n"].to_numpy(), pdf["b"].to_numpy(), signs[pdf["var"].iloc[0]])
        last = np.append(first[1:], len(pdf)) - 1
        one = pdf.iloc[first][["var", "_part", "low"]].reset_index(drop=True)
        return one.assign(high=pdf["high"].to_numpy()[last], n=np.add.reduceat(pdf["n"].to_numpy(), first), b=np.add.reduceat(pdf["b"].to_numpy(), first))

    t = parted(rungs.select("var", F.col("x").alias("low"), F.col("x").alias("high"), "n", "b"), ["var"], [F.col("low").asc()], rungs.count(), part_rows)
    while True:
        t = materialize(t.groupBy("var", "_part").applyInPandas(pool, shape), "blocks")
        if t.agg(F.max("_part")).first()[0] in (None, 0):
            return t.drop("_part")
        t = t.withColumn("_part", F.floor(F.col("_part") / TOGETHER).cast("int"))


def direction(rungs: DataFrame) -> dict[str, int]:
    """variable -> -1 if its correlation with the outcome is below -0.01, else 1."""
    n, b, x = (F.col(c).cast("double") for c in ("n", "b", "x"))
    sums = rungs.groupBy("var").agg(F.sum(n).alias("n"), F.sum(b).alias("b"), F.avg("x").alias("mid"))
    t = rungs.join(F.broadcast(sums.select("var", "mid")), "var").withColumn("z", x - F.col("mid"))  # centred: a row per variable is broadcast
    one = t.groupBy("var").agg(F.sum(n).alias("n"), F.sum(b).alias("b"), F.sum(n * F.col("z")).alias("z"), F.sum(n * F.col("z") ** 2).alias("zz"), F.sum(b * F.col("z")).alias("bz"))
    out = {}
    for r in one.collect():
        cov, spread = r["bz"] / r["n"] - r["z"] / r["n"] * r["b"] / r["n"], (r["zz"] / r["n"] - (r["z"] / r["n"]) ** 2) * r["b"] / r["n"] * (1 - r["b"] / r["n"])
        out[r["var"]] = -1 if spread > 0 and cov / np.sqrt(spread) < -0.01 else 1
    return out


def nearest_means(points: np.ndarray, k: int) -> np.ndarray:
    """The centres of the optimal k-means of sorted numbers (least sum of squares, by dynamic programming).

    The best last cluster's begin never moves back as points are added, so each layer is filled by halves: candidates in all, some
    len(points) per level."""
    p = np.asarray(points, float)
    m, shift = len(p), p.mean()
    s, q = np.append(0, np.cumsum(p - shift)), np.append(0, np.cumsum((p - shift) ** 2))
    cost = lambda i, j: np.maximum(q[j] - q[i] - (s[j] - s[i]) ** 2 / np.maximum(j - i, 1), 0)  # noqa: E731  of points i..j-1
    best, begins = cost(np.zeros(m + 1, np.int64), np.arange(m + 1)), []
    for c in range(1, min(k, m)):
        now, begin = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        todo = [(c + 1, m, c, m - 1)]  # ends a..z whose last cluster begins at lo..hi
        while todo:
            a, z, lo, hi = (np.array(x) for x in zip(*todo))
            mid = (a + z) // 2
            top = np.minimum(hi, mid - 1)
            size = top - lo + 1
            first = np.cumsum(size) - size
            i = np.arange(size.sum()) - np.repeat(first - lo, size)
            value = best[i] + cost(i, np.repeat(mid, size))
            low = np.minimum.reduceat(value, first)
            at = np.minimum.reduceat(np.where(value == np.repeat(low, size), i, m + 1), first)
            now[mid], begin[mid] = low, at
            todo = [x for x in [*zip(a, mid - 1, lo, at), *zip(mid + 1, z, at, hi)] if x[0] <= x[1]]
        best = now
        begins.append(begin)
    ends = [m]
    for begin in reversed(begins):
        ends.append(int(begin[ends[-1]]))
    ends = [*ends, 0] if ends[-1] else ends
    return np.array([p[i:j].mean() for j, i in zip(ends, ends[1:])][::-1])


def isotonic(rungs: DataFrame, config: Split = Split("isotonic"), part_rows: int | None = None, all_rows: dict[str, tuple[int, int]] | None = None) -> dict[str, list[float]]:
    """variable -> cuts midway between the blocks of its monotone fit; all_rows: as in `cart`."""
    all_rows = totals(rungs) if all_rows is None else all_rows
    up = {"ascending": 1, "descending": -1}.get(config.monotone)
    signs = {v: up for v in all_rows} if up else direction(rungs)
    found = blocks(rungs, signs, part_rows)

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("low")
        cuts = (pdf["high"].to_numpy()[:-1] + pdf["low"].to_numpy()[1:]) / 2
        if len(cuts) > config.max_bins - 1:
            cuts = nearest_means(cuts, config.max_bins - 1)
        return pd.DataFrame({"var": pdf["var"].iloc[0], "cut": cuts})

    cuts: dict[str, list[float]] = {v: [] for v in signs}
    for r in found.groupBy("var").applyInPandas(borders, "var string, cut double").collect():  # max_bins a variable
        cuts[r["var"]].append(r["cut"])
    return enough(rungs, {v: sorted(c) for v, c in cuts.items()}, config, all_rows)


# ---------------------------------------------------------------- spline


def at_ranks(rungs: DataFrame, ranks: dict[str, list[float]]) -> dict[str, list[tuple[float, float]]]:
    """variable -> for each rank r (0 to its rows): (the value of row ceil(r), the bads in the first r rows, those of one
    value spread evenly over its rows)."""
    asked = rungs.sparkSession.createDataFrame([(v, k, float(r)) for v, rs in ranks.items() for k, r in enumerate(rs)], "its_var string, k int, r double")
    r, before = F.col("r"), F.col("cn") - F.col("n")
    hit = rungs.join(F.broadcast(asked), (F.col("var") == F.col("its_var")) & (r <= F.col("cn")) & ((r > before) | (r <= 0) & (before == 0)))  # some POINTS a variable
    bads = F.col("cb") - F.col("b") + (F.greatest(r, F.lit(0.0)) - before) * F.col("b") / F.col("n")
    out: dict[str, list] = {v: [None] * len(rs) for v, rs in ranks.items()}
    for x in hit.select("var", "k", "x", bads.alias("bads")).collect():
        out[x["var"]][x["k"]] = (x["x"], x["bads"])
    return out


def rolling_rates(rungs: DataFrame, rows: dict[str, int], points: int = POINTS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """variable -> (x, rate): the centred rolling event rate at up to `points` rows, evenly spread over all rows."""
    at, ranks = {}, {}
    for v, n in rows.items():
        width, rank = max(n // 30, 10), np.unique(np.linspace(1, n, min(points, n)).astype(int))
        low, high = np.maximum(rank - width // 2 - 1, 0), np.minimum(rank + (width - 1) // 2, n)
        at[v], ranks[v] = (high - low), [*rank, *low, *high]
    found, out = at_ranks(rungs, ranks), {}
    for v, width in at.items():
        m = len(width)
        x = np.array([p[0] for p in found[v][:m]])
        low, high = (np.array([p[1] for p in found[v][a : a + m]]) for a in (m, 2 * m))
        first = np.append(True, np.diff(x) > 0)
        out[v] = x[first], ((high - low) / width)[first]
    return out


def smoothing_spline(x: np.ndarray, y: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(values, second derivatives) at x of the natural cubic spline of least curvature whose squared residuals sum to `bound` at most.

    Each weight of the curvature needs one banded solve; the weight that meets the bound is found by bisection of its logarithm."""
    h = np.diff(x)
    m = len(x) - 2
    q = np.zeros((3, m))  # second divided differences: rows are the entries of one column
    q[0], q[1], q[2] = 1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]
    right = q[0] * y[:-2] + q[1] * y[1:-1] + q[2] * y[2:]
    r0, r1 = (h[:-1] + h[1:]) / 3, h[1:-1] / 6
    qq0 = (q**2).sum(axis=0)
    qq1 = q[1, :-1] * q[0, 1:] + q[2, :-1] * q[1, 1:]
    qq2 = q[2, :-2] * q[0, 2:]

    def solve(weight: float) -> tuple[np.ndarray, np.ndarray]:
        bend = np.append(np.append(0, banded(r0 + weight * qq0, r1 + weight * qq1, weight * qq2, right)), 0)
        back = np.zeros(len(x))
        back[:-2] += q[0] * bend[1:-1]
        back[1:-1] += q[1] * bend[1:-1]
        back[2:] += q[2] * bend[1:-1]
        return y - weight * back, bend

    low, high = -40.0, 40.0
    scale = np.log(max(float((x[-1] - x[0]) ** 3 / len(x)), 1e-300))
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if ((y - solve(np.exp(mid + scale))[0]) ** 2).sum() <= bound else (low, mid)
    return solve(np.exp(low + scale))


def banded(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves a symmetric positive system with two side diagonals, by its Cholesky factor."""
    n = len(d0)
    a, b, c, z = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        low2 = c[k - 2] if k > 1 else 0.0
        low1 = b[k - 1] if k else 0.0
        a[k] = np.sqrt(max(d0[k] - low1**2 - low2**2, 1e-300))
        b[k] = (d1[k] - (low1 * c[k - 1] if k else 0.0)) / a[k] if k < n - 1 else 0.0
        c[k] = d2[k] / a[k] if k < n - 2 else 0.0
        z[k] = (right[k] - (low1 * z[k - 1] if k else 0.0) - (low2 * z[k - 2] if k > 1 else 0.0)) / a[k]
    out = np.zeros(n)
    for k in range(n - 1, -1, -1):
        out[k] = (z[k] - (b[k] * out[k + 1] if k < n - 1 else 0.0) - (c[k] * out[k + 2] if k < n - 2 else 0.0)) / a[k]
    return out


def inflections(x: np.ndarray, y: np.ndarray, smoothing: float = 0.5) -> list[float]:
    """Where the second derivative of the smooth rate changes its sign; the residual bound is smoothing * number of points."""
    bound = smoothing * len(x)
    middle, half = (x[0] + x[-1]) / 2, (x[-1] - x[0]) / 2 or 1.0
    cubic = np.polynomial.Polynomial.fit((x - middle) / half, y, 3)
    if ((cubic((x - middle) / half) - y) ** 2).sum() <= bound:
        bend = cubic.deriv(2)
        roots = [float(r.real) for r in bend.roots() if abs(r.imag) < 1e-12 and -1 < r.real < 1] if abs(bend.coef[-1]) > 1e-12 else []
        return [middle + half * r for r in roots]
    second = smoothing_spline(x, y, bound)[1]
    k = np.flatnonzero(second[:-1] * second[1:] < 0)
    return (x[k] + (x[k + 1] - x[k]) * second[k] / (second[k] - second[k + 1])).tolist()


def spline(rungs: DataFrame, config: Split = Split("spline"), smoothing: float = 0.5, all_rows: dict[str, tuple[int, int]] | None = None) -> dict[str, list[float]]:
    """variable -> cuts at the inflections of its smooth event rate, padded with percentiles; few rows or values: the tree's cuts.

    all_rows: as in `cart`."""
    all_rows = totals(rungs) if all_rows is None else all_rows
    rates = rolling_rates(rungs, {v: n for v, (n, _) in all_rows.items() if n >= 20})
    rates = {v: xy for v, xy in rates.items() if len(xy[0]) >= 4}
    cuts = {v: inflections(*xy, smoothing) for v, xy in rates.items()}
    shares = {v: np.linspace(10, 90, config.max_bins - 1 - len(c)) / 100 for v, c in cuts.items() if len(c) < config.max_bins - 1}
    place = {v: s * (all_rows[v][0] - 1) for v, s in shares.items()}
    if place:
        near = at_ranks(rungs, {v: [r for p in ps for r in (np.floor(p) + 1, np.ceil(p) + 1)] for v, ps in place.items()})
        for v, ps in place.items():
            low, high = (np.array([p[0] for p in near[v][i::2]]) for i in (0, 1))
            cuts[v] = [*cuts[v], *(low + (high - low) * (ps - np.floor(ps)))]
    short = [v for v in all_rows if v not in rates]
    found = enough(rungs, {v: sorted(set(c)) for v, c in cuts.items()}, config, all_rows)
    found = {v: c[: config.max_bins - 1] for v, c in found.items()}
    return found | (cart(rungs.where(F.col("var").isin(short)), config, {v: all_rows[v] for v in short}) if short else {})


# ---------------------------------------------------------------- bins


def sums_at(rungs: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """variable -> (rows, bads) up to each cut."""
    flat = [(v, k, float(c)) for v, cs in cuts.items() for k, c in enumerate(cs)]
    out = {v: [(0, 0)] * len(cs) for v, cs in cuts.items()}
    if flat:
        asked = rungs.sparkSession.createDataFrame(flat, "its_var string, k int, cut double")
        hit = rungs.join(F.broadcast(asked), (F.col("var") == F.col("its_var")) & (F.col("x") <= F.col("cut")))  # max_bins cuts a variable
        for r in hit.groupBy("var", "k").agg(F.max("cn").alias("n"), F.max("cb").alias("b")).collect():
            out[r["var"]][r["k"]] = (r["n"], r["b"])
    return out


def enough(rungs: DataFrame, cuts: dict[str, list[float]], config: Split, all_rows: dict[str, tuple[int, int]]) -> dict[str, list[float]]:
    """The cuts after which at least max(min_share of the rows, 20) rows lie since the last one kept."""
    sums, out = sums_at(rungs, cuts), {}
    for v, cs in cuts.items():
        least, before, out[v] = max(int(all_rows[v][0] * config.min_share), 20), 0, []
        for c, (n, _) in zip(cs, sums[v]):
            if n - before >= least:
                out[v].append(c)
                before = n
    return out


SPLITTERS = {"cart": cart, "isotonic": isotonic, "spline": spline}


def get_bins(df: DataFrame, target: str, variables: list[str], config: Split = Split(), cuts: dict[str, list[float]] | None = None) -> Bins:
    """Bins of numeric variables, cut between any two distinct values; missing rows (null, NaN, infinite) have a bin of their own.

    cuts: a splitter's result, if it is there already."""
    counts, facts = counted(df, target, variables)
    rungs = ladder(df, target, variables, (counts, facts))
    all_rows = {v: (r["n"], r["b"]) for v, r in facts.items() if r["rungs"]}
    cuts = SPLITTERS[config.method](rungs, config, all_rows=all_rows) if cuts is None else cuts
    sums = sums_at(rungs, cuts)
    by_var: dict[str, list[Bin]] = {}
    for v in variables:
        made, low, before = [], -np.inf, (0, 0)
        if v in all_rows:
            for high, upto in zip([*cuts.get(v, []), np.inf], [*sums.get(v, []), all_rows[v]]):
                if upto[0] > before[0]:
                    made.append(Bin(upto[0] - before[0], upto[1] - before[1], ((low, float(high)),)))
                    low, before = float(high), upto
        if made and made[-1].intervals[0][1] != np.inf:
            made[-1] = Bin(made[-1].n, made[-1].bads, ((made[-1].intervals[0][0], np.inf),))
        if v in facts and facts[v]["gone"]:
            made.append(Bin(facts[v]["gone"], facts[v]["gone_b"], missing=True))
        if made:
            by_var[v] = made
    return Bins(by_var, {v: "numeric" for v in by_var})
