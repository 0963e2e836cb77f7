"""A mergeable quantile sketch and a binner that keeps it as state of a stream.

*Sketch* (KLL).  Values enter level 0; a level that is full is sorted and every other value moves up, where it counts twice.  Lower
levels are smaller, so a sketch of K holds some 3 K numbers whatever it has seen; the rank of any value is off by less than 2.3 / K ** 0.9
of the rows in 99 of 100 sketches.  Merging joins level by level and compacts what is too full.

*Binner.*  Rows of a stream are dealt to SHARDS by a hash of the row, so no state meets all rows.  Each shard's state
holds a sketch of events and one of non-events, with exact counts, and exact counts per class of fixed edges if these are given.
Structured Streaming keeps the state; each micro-batch writes the shards that changed, under the batch's number, so a batch
that is repeated after a failure replaces its own files.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import splitters as P

K, SHRINK, SHARDS = 512, 2 / 3, 16


class Sketch:
    """Quantiles of the numbers added so far; null and NaN are left out."""

    def __init__(self, k: int = K) -> None:
        self.k, self.n, self.levels, self.odd = k, 0, [np.empty(0)], 0

    def _room(self, level: int) -> int:
        return max(8, int(self.k * SHRINK ** (len(self.levels) - 1 - level)))

    def _compact(self) -> None:
        while sum(map(len, self.levels)) > sum(self._room(i) for i in range(len(self.levels))):
            at = next(i for i, x in enumerate(self.levels) if len(x) > self._room(i))
            if at + 1 == len(self.levels):
                self.levels.append(np.empty(0))
            full = np.sort(self.levels[at])
            even = len(full) // 2 * 2
            self.odd ^= 1  # whether odd or even places move up takes turns
            self.levels[at] = full[even:]
            self.levels[at + 1] = np.append(self.levels[at + 1], full[self.odd : even : 2])

    def add(self, values) -> Sketch:
        values = np.asarray(values, float)
        values = values[~np.isnan(values)]
        self.n += len(values)
        for a in range(0, len(values), 4 * self.k):
            self.levels[0] = np.append(self.levels[0], values[a : a + 4 * self.k])
            self._compact()
        return self

    def merge(self, other: Sketch) -> Sketch:
        self.n += other.n
        self.levels += [np.empty(0) for _ in range(len(other.levels) - len(self.levels))]
        for i, x in enumerate(other.levels):
            self.levels[i] = np.append(self.levels[i], x)
        self._compact()
        return self

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """The values held, sorted, and how many rows each stands for."""
        x, w = np.concatenate(self.levels), np.repeat(2.0 ** np.arange(len(self.levels)), [len(v) for v in self.levels])
        order = np.argsort(x, kind="stable")
        return x[order], w[order]

    def quantile(self, shares) -> np.ndarray:
        x, w = self.weighted()
        if not len(x):
            return np.full(len(shares), np.nan)
        upto = np.cumsum(w)
        return x[np.minimum(np.searchsorted(upto, np.asarray(shares) * upto[-1], side="left"), len(x) - 1)]

    def counts(self, edges: list[float]) -> np.ndarray:
        """Rows in (-inf, e0], (e0, e1], ..., scaled to the number seen."""
        x, w = self.weighted()
        held = np.bincount(np.searchsorted(edges, x, side="left"), w, len(edges) + 1) if len(x) else np.zeros(len(edges) + 1)
        return held * (self.n / held.sum()) if held.sum() else held


class Binner:
    """Sketches of events and non-events, and exact counts per class of fixed edges."""

    def __init__(self, k: int = K, edges: list[float] = ()) -> None:
        self.events, self.others, self.edges = Sketch(k), Sketch(k), list(edges)
        self.exact = np.zeros((2, len(self.edges) + 1), np.int64)

    def add(self, x, y) -> Binner:
        x, y = np.asarray(x, float), np.asarray(y, float)
        known = ~np.isnan(x) & ~np.isnan(y)
        x, hit = x[known], y[known] == 1
        self.events.add(x[hit]), self.others.add(x[~hit])
        at = np.searchsorted(self.edges, x, side="left")
        self.exact += np.array([np.bincount(at, minlength=len(self.edges) + 1), np.bincount(at[hit], minlength=len(self.edges) + 1)])
        return self

    def merge(self, other: Binner) -> Binner:
        self.events.merge(other.events), self.others.merge(other.others)
        self.exact = self.exact + other.exact
        return self

    def prebins(self, n: int = 20) -> list[float]:
        """Inner edges at the quantiles of all rows."""
        both = Sketch(self.events.k).merge(self.events).merge(self.others)
        return sorted({float(q) for q in both.quantile(np.arange(1, n) / n) if q == q})

    def splits(self, config: P.Split = P.Split("iv_optimal"), n: int = 20) -> list[float]:
        """Cuts among the prebins, from the sketches' counts."""
        edges = self.prebins(n)
        bad, good = self.events.counts(edges), self.others.counts(edges)
        rows = np.rint(bad + good)
        kept = np.flatnonzero(rows > 0)
        cuts = P.split(rows[kept], np.rint(bad)[kept], config)
        return [edges[kept[k]] for k in cuts if kept[k] < len(edges)]

    def packed(self) -> bytes:
        return pickle.dumps((self.events.__dict__, self.others.__dict__, self.edges, self.exact))

    @staticmethod
    def unpacked(data: bytes) -> Binner:
        out, (events, others, out.edges, out.exact) = Binner(), pickle.loads(data)
        out.events.__dict__.update(events), out.others.__dict__.update(others)
        return out


def binned(stream: DataFrame, column: str, target: str, k: int = K, edges: list[float] = (), shards: int = SHARDS) -> DataFrame:
    """(shard, n, binner): each shard's state after every micro-batch in which it changed; for output mode update."""
    x, y = F.col(f"`{column}`").cast("double"), F.col(f"`{target}`").cast("double")
    rows = stream.select(F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in stream.columns)), F.lit(shards)).cast("int").alias("shard"), x.alias("x"), y.alias("y"))

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Binner.unpacked(bytes(state.get[0])) if state.exists else Binner(k, edges)
        for pdf in frames:
            held.add(pdf["x"], pdf["y"])
        state.update((held.packed(),))
        yield pd.DataFrame({"shard": [key[0]], "n": [held.events.n + held.others.n], "binner": [held.packed()]})

    return rows.groupBy("shard").applyInPandasWithState(update, "shard int, n long, binner binary", "binner binary", "update", GroupStateTimeout.NoTimeout)


def run(stream: DataFrame, column: str, target: str, folder: str, k: int = K, edges: list[float] = (), shards: int = SHARDS) -> None:
    """Takes in what the stream has now and stops; the state goes on from `folder` next time."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/shards/batch={number}")

    query = binned(stream, column, target, k, edges, shards).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def load(spark: SparkSession, folder: str) -> Binner:
    """The shards' last states, merged; `shards` rows at most come to the driver."""
    rows = spark.read.option("basePath", f"{folder}/shards").parquet(f"{folder}/shards")
    last = rows.groupBy("shard").agg(F.max_by("binner", "batch").alias("binner")).orderBy("shard").collect()
    out = Binner.unpacked(bytes(last[0]["binner"])) if last else Binner()
    for r in last[1:]:
        out.merge(Binner.unpacked(bytes(r["binner"])))
    return out
