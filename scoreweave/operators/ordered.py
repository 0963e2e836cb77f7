"""Work that depends on the order of rows, without a window over all of them.

Rows are range-sorted into parts of PART_ROWS or more, at most MOST_PARTS of them, and written with their part's number, so that the numbers cannot change between
two reads.  Sums and counts run within a part; what lies in earlier parts is added from one number per part.  The range keys
include what breaks ties, so a value that a third of the rows hold is spread over many parts.  Tables that are counted to have
PART_ROWS rows at most are one part, and a plain window does.
"""

from __future__ import annotations

from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import materialize

PART_ROWS, MOST_PARTS = 200_000, 10_000


def parted(df: DataFrame, by: list[str], order: list[Column], n: int, part_rows: int | None = None) -> DataFrame:
    """df (n rows), sorted by (by, order) into parts, with _part (0, 1, ...) in that order; written once."""
    parts = max(1, min(MOST_PARTS, -(-n // (part_rows or PART_ROWS))))
    if parts == 1:
        return materialize(df.withColumn("_part", F.lit(0)), "part")
    keys = [*(F.col(c).asc_nulls_first() for c in by), *order]
    return materialize(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "parts")


def _ahead(t: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """(_part, by, {c}_ahead, {c}_all): what lies in earlier parts of the same group, and in all; a row per part and group."""
    one = t.groupBy("_part", *by).agg(*(x.alias(c) for c, x in sums.items()))
    own = Window.partitionBy(*by)
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    out = [x for c in sums for x in (F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_ahead"), F.sum(c).over(own).alias(f"{c}_all"))]
    return one.select(F.col("_part").alias("_its_part"), *(F.col(c).alias(f"_its_{c}") for c in by), *out)


def _with_ahead(t: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    same = F.col("_part") == F.col("_its_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_its_{c}"))
    return t.join(_ahead(t, by, sums), same).drop("_its_part", *(f"_its_{c}" for c in by))


def running(df: DataFrame, key: str, columns: list[str], by: list[str] = (), descending: bool = True, part_rows: int | None = None, n: int | None = None) -> DataFrame:
    """df with running sums `{c}_in` from the highest key down (or from the lowest up) and totals `{c}_all`, within each group
    `by`; keys must not repeat within a group.  df is computed once; n: its rows, where it is an intermediate table that is counted already."""
    by, order = list(by), F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    t = materialize(df, "ordered") if n is None else df
    n = t.count() if n is None else n
    own = Window.partitionBy(*by)
    if n <= (part_rows or PART_ROWS):
        upto = own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return t.withColumns({f"{c}_in": F.sum(c).over(upto) for c in columns} | {f"{c}_all": F.sum(c).over(own) for c in columns})
    t = _with_ahead(parted(t, by, [order], n, part_rows), by, {c: F.sum(c) for c in columns})
    upto = Window.partitionBy("_part", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumns({f"{c}_in": F.col(f"{c}_ahead") + F.sum(c).over(upto) for c in columns}).drop("_part", *(f"{c}_ahead" for c in columns))


def numbered(df: DataFrame, order: list[Column], by: list[str] = (), part_rows: int | None = None) -> DataFrame:
    """df with _at (1, 2, ... in the given order, within each group `by`) and _rows (of the group).

    Rows alike in all of `order` are numbered in any order; give what tells them apart."""
    by, n = list(by), df.count()
    own = Window.partitionBy(*by)
    if n <= (part_rows or PART_ROWS):
        return df.withColumns({"_at": F.row_number().over(own.orderBy(*order)).cast("long"), "_rows": F.count("*").over(own)})
    t = _with_ahead(parted(df, by, order, n, part_rows), by, {"_n": F.count("*")})
    at = F.col("_n_ahead") + F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    return t.withColumns({"_at": at, "_rows": F.col("_n_all")}).drop("_part", "_n_ahead", "_n_all")


def rolling_mean(df: DataFrame, value: str, order: list[Column], width: int, by: list[str] = (), name: str = "rolling", part_rows: int | None = None) -> DataFrame:
    """df with the mean of `width` rows around each row (width // 2 before it, the rest behind; fewer at the ends).

    A window's sum is the difference of two running sums, looked up by position, so the width may be any part of the table; one sort
    gives positions and running sums.  All columns of df travel with the rows: leave out what is not wanted.  Nulls count neither as value nor as row."""
    by, own = list(by), Window.partitionBy(*by)
    y, n = F.col(value).cast("double"), df.count()
    t = df.withColumns({"_y": F.coalesce(y, F.lit(0.0)), "_c": y.isNotNull().cast("long")})
    if n <= (part_rows or PART_ROWS):
        ahead, along, rows = (lambda c: F.lit(0)), own.orderBy(*order), F.count("*").over(own)
    else:
        t = _with_ahead(parted(t, by, order, n, part_rows), by, {"_n": F.count("*"), "_y": F.sum("_y"), "_c": F.sum("_c")})
        ahead, along, rows = (lambda c: F.col(f"{c}_ahead")), Window.partitionBy("_part", *by).orderBy(*order), F.col("_n_all")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    at = ahead("_n") + F.row_number().over(along)
    t = t.withColumns({"_at": at.cast("long"), "_rows": rows, "_y_in": ahead("_y") + F.sum("_y").over(upto), "_n_in": ahead("_c") + F.sum("_c").over(upto)})
    t = materialize(t.select(*df.columns, "_at", "_rows", "_y_in", "_n_in"), "numbered")
    sums, t = t.select(*by, "_at", "_y_in", "_n_in"), t.drop("_y_in", "_n_in")
    before, behind = width // 2, (width - 1) // 2

    def look(t: DataFrame, at: Column, suffix: str) -> DataFrame:
        found = sums.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_at").alias("_its"), F.col("_y_in").alias(f"_y{suffix}"), F.col("_n_in").alias(f"_n{suffix}"))
        same = at == F.col("_its")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        return t.join(found, same, "left").drop("_its", *(f"_by_{c}" for c in by))

    t = look(look(t, F.least(F.col("_at") + behind, F.col("_rows")), "1"), F.col("_at") - before - 1, "0")
    zero = lambda c: F.coalesce(c, F.lit(0))
    mean = F.try_divide(F.col("_y1") - zero("_y0"), F.col("_n1") - zero("_n0"))
    return t.withColumn(name, mean).drop("_at", "_rows", "_y0", "_y1", "_n0", "_n1")


#: Classes of an interval in a pass; rows of an interval whose values are looked at one by one.
CLASSES, FEW = 1_024, 10_000


def _classes(t: DataFrame, p: int, spans: list[tuple[int, float, float, bool]]) -> DataFrame:
    """(i, cls, n, lo, hi): rows, least and greatest value of each class of the intervals (column, low, high, whether it is cut into CLASSES; else
    each value is a class).  Intervals of a column do not overlap; rows are counted within tasks first, by one look-up per value."""
    plan = []
    for k in range(p):
        own = sorted((low, high, cut, i) for i, (c, low, high, cut) in enumerate(spans) if c == k)
        if own:
            plan.append((k, *(np.array(x) for x in zip(*own))))

    def tally(frames):
        held = {k: (np.zeros(len(low) * CLASSES, np.int64), np.full(len(low) * CLASSES, np.inf), np.full(len(low) * CLASSES, -np.inf)) for k, low, _, _, _ in plan}
        few = [(np.empty(0, np.int64), np.empty(0))]  # (interval, value) of intervals of few rows
        for pdf in frames:
            for k, low, high, cut, ids in plan:
                v = pdf[f"x{k}"].to_numpy(float)
                at = np.minimum(np.searchsorted(high, v), len(high) - 1)
                inside = np.flatnonzero((v >= low[at]) & (v <= high[at]))
                v, at = v[inside], at[inside]
                fine = cut[at]
                few.append((ids[at[~fine]], v[~fine]))
                v, at = v[fine], at[fine]
                cls = np.minimum(np.floor((v / 2 - low[at] / 2) / (high[at] / 2 - low[at] / 2) * CLASSES), CLASSES - 1).astype(np.int64)
                n, lo, hi = held[k]
                n += np.bincount(at * CLASSES + cls, minlength=len(n))
                np.minimum.at(lo, at * CLASSES + cls, v)
                np.maximum.at(hi, at * CLASSES + cls, v)
        for k, _, _, _, ids in plan:
            n, lo, hi = held[k]
            some = np.flatnonzero(n)
            yield pd.DataFrame({"i": ids[some // CLASSES], "cls": (some % CLASSES).astype(float), "n": n[some], "lo": lo[some], "hi": hi[some]})
        i, v = (np.concatenate(x) for x in zip(*few))
        yield pd.DataFrame({"i": i, "cls": v, "n": 1, "lo": v, "hi": v}).groupby(["i", "cls"], as_index=False).agg({"n": "sum", "lo": "min", "hi": "max"})

    return t.mapInPandas(tally, "i int, cls double, n long, lo double, hi double").groupBy("i", "cls").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def quantiles(df: DataFrame, shares: dict[str, list[float]], small: int = PART_ROWS) -> dict[str, list[float]]:
    """Exact quantiles (linear between neighbours) of several columns at once; nulls, NaN and infinite values are left out.

    Each pass counts, in all columns together, the rows per class of the intervals in which the wanted ranks lie, and the
    classes that hold the ranks are the next intervals.  An interval of one value or of few rows ends the search.  Only counts are
    kept, never a buffer of values.  Tables of `small` rows at most are left to one aggregate.  The least and the greatest value
    are known before the first pass."""
    names = list(shares)
    if not names:
        return {}
    x = {c: F.when(F.abs(F.col(f"`{c}`").cast("double")) < float("inf"), F.col(f"`{c}`").cast("double")) for c in names}
    t = df.select(*(x[c].alias(f"x{k}") for k, c in enumerate(names)))
    facts = t.agg(*(f(f"x{k}").alias(f"{name}{k}") for k in range(len(names)) for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max)))).first()
    place = {(k, s): s * (facts[f"n{k}"] - 1) for k, c in enumerate(names) if facts[f"n{k}"] for s in shares[c]}
    known: dict[tuple[int, int], float] = {}
    for k in range(len(names)):
        if facts[f"n{k}"]:
            known |= {(k, 0): facts[f"lo{k}"], (k, facts[f"n{k}"] - 1): facts[f"hi{k}"]}
    unknown = [(k, r) for (k, _), at in place.items() for r in (floor(at), ceil(at)) if (k, r) not in known]
    if unknown and max(facts[f"n{k}"] for k in range(len(names))) <= small:
        row = t.agg(*(F.percentile(f"x{k}", list(shares[c])).alias(str(k)) for k, c in enumerate(names))).first()
        return {c: list(row[k] or []) for k, c in enumerate(names)}
    open_: dict[tuple[int, float, float], tuple[int, int, set[int]]] = {}  # (column, low, high) -> (rows below, rows, ranks)
    for k, r in unknown:
        open_.setdefault((k, facts[f"lo{k}"], facts[f"hi{k}"]), (0, facts[f"n{k}"], set()))[2].add(r)
    while open_:
        for key in [key for key in open_ if key[1] == key[2]]:
            known |= {(key[0], r): key[1] for r in open_.pop(key)[2]}
        spans = list(open_)
        if not spans:
            break

        found: dict[int, list] = {}
        for r in _classes(t, len(names), [(*span, open_[span][1] > FEW) for span in spans]).collect():  # CLASSES (or FEW) rows an interval at most
            found.setdefault(r["i"], []).append(r)
        for i, span in enumerate(spans):
            below, _, ranks = open_.pop(span)
            left = sorted(ranks)
            for r in sorted(found[i], key=lambda r: r["lo"]):
                inside = {x for x in left if x < below + r["n"]}
                if inside:
                    open_[span[0], r["lo"], r["hi"]] = (below, r["n"], inside)
                    left = left[len(inside) :]
                below += r["n"]
    out = {}
    for k, c in enumerate(names):
        at = [place[k, s] for s in shares[c]] if facts[f"n{k}"] else []
        out[c] = [known[k, floor(p)] + (known[k, ceil(p)] - known[k, floor(p)]) * (p - floor(p)) for p in at]
    return out
