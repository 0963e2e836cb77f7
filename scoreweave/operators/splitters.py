"""Where to cut a variable: splitters over a fine histogram.

A histogram is three arrays in order of value: the classes' upper ends, their rows n and their bads b.  A splitter returns the
indexes of the classes after which it cuts.  Histograms have at most some hundred classes (see ``binning``), so a splitter is a
small numpy function whatever the size of the data.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Split:
    method: str = "cart"
    max_bins: int = 10
    min_bins: int = 2
    min_share: float = 0.01
    min_count: int = 50
    chi_p: float = 0.05
    min_iv_loss: float = 1e-3
    monotone: str = "none"  # none, auto, ascending, descending, peak, valley
    adaptive: bool = False  # smaller leaves for small data and rare events
    min_events: bool = False  # leaves that expect at least five events
    retry: bool = True  # halve the leaf size while nothing can be cut


def chi_square(n1, b1, n2, b2):
    """2 x 2 statistic with Yates' correction; infinite if a margin is empty."""
    g1, g2 = n1 - b1, n2 - b2
    n, b, g = n1 + n2, b1 + b2, g1 + g2
    off = np.maximum(np.abs(b1 * g2 - b2 * g1) - n / 2, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = n * off**2 / (n1 * n2 * b * g)
    return np.where(n1 * n2 * b * g == 0, np.inf, x)


def p_value(chi2: float) -> float:
    """One degree of freedom; an infinite statistic says nothing (1)."""
    return 1.0 if math.isinf(chi2) else math.erfc(math.sqrt(chi2 / 2))


def critical(p: float) -> float:
    """The statistic whose p-value is p, by bisection."""
    low, high = 0.0, 1e3
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if p_value(mid) > p else (low, mid)
    return high


def _merged(v: np.ndarray, k: int) -> np.ndarray:
    out = np.delete(v, k + 1)
    out[k] = v[k] + v[k + 1]
    return out


def _woe(n, b):
    n, b = np.asarray(n, float), np.asarray(b, float)
    db = np.where(b > 0, b / max(b.sum(), 1), 1e-4)
    dg = np.where(n - b > 0, (n - b) / max((n - b).sum(), 1), 1e-4)
    return np.log(db / dg), db, dg


def _iv(n, b):
    w, db, dg = _woe(n, b)
    return (db - dg) * w


#: Below these rows and this event rate leaves may be smaller; the least share, what a share of events allows (fixed values).
SMALL_DATA, RARE, LEAST_SHARE, LEAF_EVENTS, RELAXED = 500, 0.05, 0.005, 5, 0.8


def least_leaf(rows: int, events: int, c: Split) -> int:
    """The rows that a leaf of the tree has at least."""
    rate, share = events / rows if rows else 0.0, c.min_share
    if c.adaptive and rows:
        if rows < SMALL_DATA:
            share = max(share / 2, LEAST_SHARE)
        if rate < RARE and events:
            share = max(share, RELAXED / max(events // LEAF_EVENTS, 2))
    leaf = max(int(rows * share), 1)
    if c.min_events and events:
        leaf = max(leaf, int(LEAF_EVENTS / max(rate, 1e-3)))
    return max(1, min(leaf, rows // 2))


def cart(n: np.ndarray, b: np.ndarray, c: Split) -> list[int]:
    """Best-first tree: the leaf whose best cut lowers Gini impurity most is cut next, up to max_bins leaves."""
    rows, events = n.sum(), b.sum()
    if rows < 2 or len(n) < 2:
        return []
    leaf = least_leaf(int(rows), int(events), c)
    cn, cb = np.concatenate(([0], np.cumsum(n))).astype(float), np.concatenate(([0], np.cumsum(b))).astype(float)

    def impurity(n, b):
        return 2 * b * (n - b) / np.maximum(n, 1)

    def best(low: int, high: int, leaf: int):
        k = np.arange(low + 1, high)
        ln, lb = cn[k] - cn[low], cb[k] - cb[low]
        rn, rb = cn[high] - cn[k], cb[high] - cb[k]
        gain = impurity(cn[high] - cn[low], cb[high] - cb[low]) - impurity(ln, lb) - impurity(rn, rb)
        gain = np.where((ln >= leaf) & (rn >= leaf), gain, -1)
        return (-gain[at], low, high, int(k[at])) if len(k) and gain[at := int(np.argmax(gain))] > 1e-12 else None

    while True:
        queue = [x for x in [best(0, len(n), leaf)] if x]
        cuts: list[int] = []
        while queue and len(cuts) < c.max_bins - 1:
            _, low, high, k = heapq.heappop(queue)
            cuts.append(k - 1)
            for part in (best(low, k, leaf), best(k, high, leaf)):
                if part:
                    heapq.heappush(queue, part)
        if cuts or not c.retry or leaf <= 10:
            return sorted(cuts)
        leaf //= 2


def _coarse(n: np.ndarray, most: int) -> list[np.ndarray]:
    """About `most` groups of neighbouring classes with like counts: index arrays."""
    edge = np.minimum((np.cumsum(n) - 1) * most // max(n.sum(), 1), most - 1)
    return [g for g in np.split(np.arange(len(n)), np.flatnonzero(np.diff(edge)) + 1) if len(g)]


def _small_merged(n, b, last, least: int, floor: int, to: str):
    """Groups below `least` join a neighbour while more than `floor` are left: the left one, the nearer in bad `rate`, or the smaller in `size`."""
    while len(n) > floor and (n < least).any():
        k = int(np.argmax(n < least))
        if k == 0:
            at = 0
        elif k == len(n) - 1 or to == "left":
            at = k - 1
        elif to == "size":
            at = k - 1 if n[k - 1] <= n[k + 1] else k
        else:
            rate = b / n
            at = k if abs(rate[k + 1] - rate[k]) < abs(rate[k] - rate[k - 1]) else k - 1
        n, b, last = _merged(n, at), _merged(b, at), np.delete(last, at)
    return n, b, last


def chi_merge(n: np.ndarray, b: np.ndarray, c: Split) -> list[int]:
    """Neighbours that differ least are merged until all differ and at most max_bins are left."""
    groups = _coarse(n, 100)
    gn, gb = np.array([n[g].sum() for g in groups], float), np.array([b[g].sum() for g in groups], float)
    last, limit = np.array([g[-1] for g in groups]), critical(c.chi_p)
    while len(gn) > c.min_bins:
        x = chi_square(gn[:-1], gb[:-1], gn[1:], gb[1:])
        k = int(np.argmin(x))
        if np.isinf(x[k]) or x[k] > limit and len(gn) <= c.max_bins:
            break
        gn, gb, last = _merged(gn, k), _merged(gb, k), np.delete(last, k)
    least = max(int(n.sum() * c.min_share), c.min_count)
    gn, gb, last = _small_merged(gn, gb, last, least, c.min_bins, "left")
    while len(gn) > c.max_bins:
        k = int(np.argmin(chi_square(gn[:-1], gb[:-1], gn[1:], gb[1:])))
        gn, gb, last = _merged(gn, k), _merged(gb, k), np.delete(last, k)
    return last[:-1].tolist()


def iv_optimal(n: np.ndarray, b: np.ndarray, c: Split) -> list[int]:
    """From many groups, the merge that loses least information value is made until max_bins are left (or until a merge would lose more
    than min_iv_loss: then up to twice max_bins stay).  Small bins join their smaller neighbour."""
    start = len(n) if len(n) <= 20 else min(max(20, len(n) // 5), min(100, max(2, int(n.sum()) // 50)), len(n) - 1)
    groups = _coarse(n, start)
    gn, gb = np.array([n[g].sum() for g in groups], float), np.array([b[g].sum() for g in groups], float)
    last = np.array([g[-1] for g in groups])

    def join(k: int):
        return _merged(gn, k), _merged(gb, k), np.delete(last, k)

    while len(gn) > c.min_bins and ((gb == 0) | (gb == gn)).any():  # pure groups go to the neighbour nearer in WOE
        k, w = int(np.argmax((gb == 0) | (gb == gn))), _woe(gn, gb)[0]
        right = k == 0 or k < len(gn) - 1 and abs(w[k + 1] - w[k]) < abs(w[k] - w[k - 1])
        gn, gb, last = join(k if right else k - 1)
    while len(gn) > c.max_bins:
        iv = _iv(gn, gb)
        loss = [iv[k] + iv[k + 1] - _iv(_merged(gn, k), _merged(gb, k))[k] for k in range(len(gn) - 1)]
        k = int(np.argmin(loss))
        if loss[k] > c.min_iv_loss and len(gn) <= 2 * c.max_bins:
            break
        gn, gb, last = join(k)
    least = max(int(n.sum() * c.min_share), c.min_count)
    gn, gb, last = _small_merged(gn, gb, last, least, c.min_bins, "size")
    return last[:-1].tolist()


def isotonic(n: np.ndarray, b: np.ndarray, c: Split) -> list[int]:
    """Blocks of the monotone fit of the bad rate (pool adjacent violators); too many are merged where rates are nearest."""
    sign = 1 if _direction(n, b) >= 0 else -1
    blocks: list[list[float]] = []
    for k, (x, y) in enumerate(zip(n.astype(float), b.astype(float))):
        blocks.append([x, y, k])
        while len(blocks) > 1 and sign * blocks[-2][1] / blocks[-2][0] >= sign * blocks[-1][1] / blocks[-1][0]:
            x2, y2, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + x2, blocks[-1][1] + y2, last]
    gn, gb, last = (np.array([x[i] for x in blocks]) for i in range(3))
    least = max(int(n.sum() * c.min_share), c.min_count)
    gn, gb, last = _small_merged(gn, gb, last, least, c.min_bins, "rate")
    while len(gn) > c.max_bins:
        k = int(np.argmin(np.abs(np.diff(gb / gn))))
        gn, gb, last = _merged(gn, k), _merged(gb, k), np.delete(last, k)
    return [int(x) for x in last[:-1]]


def spline(n: np.ndarray, b: np.ndarray, c: Split) -> list[int]:
    """Cuts where the curvature of the smoothed bad rate changes its sign (penalized second differences)."""
    groups = _coarse(n, 200)
    if n.sum() < 20 or len(groups) < 8:
        return cart(n, b, c)
    gn, gb = np.array([n[g].sum() for g in groups], float), np.array([b[g].sum() for g in groups], float)
    d = np.diff(np.eye(len(gn)), n=2, axis=0)
    smooth = np.linalg.solve(np.diag(gn / gn.mean()) + 50 * d.T @ d, gn / gn.mean() * gb / gn)
    bend = np.sign(np.diff(smooth, n=2))
    cuts = (np.flatnonzero(bend[1:] * bend[:-1] < 0) + 1).tolist()
    if not cuts:
        cuts = [len(gn) * k // 10 - 1 for k in (2, 4, 6, 8)]
    if len(cuts) > c.max_bins - 1:
        cuts = [cuts[len(cuts) * k // (c.max_bins - 1)] for k in range(c.max_bins - 1)]
    ends = np.append(cuts, len(gn) - 1)
    sn, sb = (np.add.reduceat(v, np.concatenate(([0], ends[:-1] + 1))) for v in (gn, gb))
    last = np.array([groups[k][-1] for k in ends])
    least = max(int(n.sum() * c.min_share), 20)
    _, _, last = _small_merged(sn, sb, last, least, c.min_bins, "rate")
    return last[:-1].tolist()


def equal_frequency(n: np.ndarray, b: np.ndarray, c: Split) -> list[int]:
    return [int(g[-1]) for g in _coarse(n, c.max_bins)][:-1]


METHODS = {"cart": cart, "chi_merge": chi_merge, "iv_optimal": iv_optimal, "isotonic": isotonic, "spline": spline, "equal_frequency": equal_frequency}


def _direction(n, b) -> float:
    """Correlation of the class number with the outcome."""
    k, n = np.arange(len(n)), np.asarray(n, float)
    mean_k, rate = (k * n).sum() / n.sum(), b.sum() / n.sum()
    cov = (k * b).sum() / n.sum() - mean_k * rate
    spread = ((k - mean_k) ** 2 * n).sum() / n.sum() * rate * (1 - rate)
    return cov / math.sqrt(spread) if spread > 0 else 0.0


def _bins(v: np.ndarray, cuts: list[int]) -> np.ndarray:
    return np.add.reduceat(v, [0, *(k + 1 for k in cuts)])


def with_trend(n: np.ndarray, b: np.ndarray, cuts: list[int], trend: str) -> list[int]:
    """Cuts are dropped at the first bin that breaks the trend, until none does."""
    if trend in ("none", "concave", "convex") or not cuts:
        return cuts
    if trend == "auto":
        r = _direction(n, b)
        if abs(r) < 0.01:
            return cuts
        trend = "ascending" if r > 0 else "descending"
    cuts = list(cuts)
    while cuts:
        rate = _bins(b, cuts) / _bins(n, cuts)
        step = np.diff(rate)
        if trend in ("peak", "valley"):
            top = int(np.argmax(rate) if trend == "peak" else np.argmin(rate))
            want = np.where(np.arange(len(step)) < top, 1, -1) * (1 if trend == "peak" else -1)
        else:
            want = np.full(len(step), 1 if trend == "ascending" else -1)
        wrong = np.flatnonzero(step * want < 0)
        if not len(wrong):
            return cuts
        cuts.pop(int(wrong[0]))
    return cuts


def split(n: np.ndarray, b: np.ndarray, c: Split) -> list[int]:
    n, b = np.asarray(n, np.int64), np.asarray(b, np.int64)
    if len(n) < 2:
        return []
    return with_trend(n, b, METHODS[c.method](n, b, c), c.monotone)
