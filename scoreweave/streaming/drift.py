"""Streams: binning in mergeable pieces, and drift per window.

A stream's micro-batches are reduced to (class, n, events) over fixed edges and added to a table; bins and measures are made from
that table at any time.  Event-time windows with a watermark bound the state of the drift monitor.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import splitters as P


def sketch_edges(df: DataFrame, column: str, target: str, classes: int = 64) -> list[float]:
    """Edges from one mergeable sketch per class of the outcome, so that rare events shape them as well."""
    at = [k / classes for k in range(1, classes)]
    rows = df.where(F.col(column).isNotNull()).groupBy(target).agg(F.percentile_approx(F.col(column).cast("double"), at, 10_000).alias("q")).collect()  # two rows
    return sorted({x for r in rows for x in r["q"] or []})


def partial_counts(df: DataFrame, column: str, target: str, edges: list[float]) -> DataFrame:
    """(class, n, events) of a batch or a stream."""
    return df.groupBy(E.bucket(F.col(column), edges).alias("class")).agg(F.count("*").alias("n"), F.sum(F.col(target).cast("long")).alias("events"))


def merged(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("class").agg(F.sum("n").alias("n"), F.sum("events").alias("events"))


def streaming_splits(counts: DataFrame, edges: list[float], config: P.Split = P.Split("iv_optimal")) -> list[float]:
    """Split points from merged counts: at most len(edges) + 2 rows come to the driver."""
    rows = sorted((r["class"], r["n"], r["events"]) for r in counts.collect() if r["class"] is not None)
    cuts = P.split(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), config)
    return [edges[rows[k][0]] for k in cuts if rows[k][0] < len(edges)]


def windowed_drift(events: DataFrame, time: str, column: str, edges: list[float], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window start, class, n) with a watermark: the same on a stream and on a table."""
    by = F.window(F.col(time), width)
    return events.withWatermark(time, late).groupBy(by.alias("w"), E.bucket(F.col(column), edges).alias("class")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "class", "n")


def window_psi(counts: DataFrame, expected: dict[int, float], eps: float = 1e-4) -> DataFrame:
    """Stability of each window's shares against expected shares (a few classes)."""
    known = counts.sparkSession.createDataFrame(list(expected.items()), "class int, share double")
    total = counts.groupBy("start").agg(F.sum("n").alias("rows"))
    grid = total.crossJoin(F.broadcast(known))  # windows by a few classes
    a = F.greatest(F.coalesce("n", F.lit(0)) / F.col("rows"), F.lit(eps))
    e = F.greatest(F.col("share"), F.lit(eps))
    t = grid.join(counts, ["start", "class"], "left").select("start", "rows", ((a - e) * F.log(a / e)).alias("part"))
    return t.groupBy("start").agg(F.max("rows").alias("rows"), F.bround(F.sum("part"), 4).alias("psi"))
