"""Periodic runs of words, found by matching aligned blocks of power-of-two length.

A run is a stretch of words whose words q apart are identical, q its smallest period, of max(LEAST, TIMES * q) words at least,
that no neighbouring word extends.

*Blocks.*  At the scale b = 1, 2, 4, ... a document is cut at the multiples of b.  A run of period b <= q < 2b covers, within its first
2b - 1 words, a whole block of that scale, and since it has 4q words, the block's words stand again q and 2q words later.
So a block is a candidate if its words recur at a distance of that scale; this is asked of all documents of a batch at once, of the first word
of every block, then of some more words of those that are left.

*Search.*  The candidate blocks of all scales of a document are the keys of one automaton over integer sequences, which reports each place
where a block stands.  At a distance of b to 2b - 1 words before a place at most one block is aligned; if it is the same block, the two seed a
period.

*Extension.*  A seed of period q whose words agree over the next 2q words is extended to both sides, by comparing stretches of doubling length.
Seeds inside a run of a smaller period are left out: such a run would have the smaller period itself.  Stretches of one period
never overlap by as much as the period, so each is extended once.

All of a document happens in one task, and documents do not meet: there is no shuffle.  Batches are bounded by BATCH bytes of text, or one longer text.

Rows: null and empty texts have no words and no runs.  Very long texts are handled whole.  Rows that repeat are handled each; a row without
an id is like one whose text is not rewritten.  An empty table gives an empty result.  Extra columns are not touched, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words of a run at least, and how often its period fits into it (both must hold); bytes of a batch.
LEAST, TIMES, BATCH = 6, 4, 4_000_000
RUNS = "id string, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def candidates(ids: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """document -> [(scale, place in ids)] of aligned blocks whose words recur at a distance of their scale.

    ids: the words of all documents, end to end, numbered apart for each document; doc: whose they are; starts: where each begins."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    key = ids[order] * n + order  # sorted by word, then by place
    lens, found, scale = np.diff(np.append(starts, n)), {}, 1
    local = np.arange(n) - starts[doc] if n else np.empty(0, np.int64)
    recurs = lambda at: (key[np.minimum(np.searchsorted(key, (k := ids[at] * n + at) + scale), n - 1)] - k) // scale == 1
    blocks = np.flatnonzero(lens[doc] >= max(LEAST, TIMES))
    while len(blocks):
        need = max(LEAST, TIMES * scale)
        blocks = blocks[(local[blocks] % scale == 0) & (lens[doc[blocks]] >= need)]
        use = blocks[local[blocks] + 2 * scale <= lens[doc[blocks]]]
        for offset in sorted({0, scale - 1, scale // 2, scale // 4, 3 * scale // 4}):
            use = use[recurs(use + offset)] if len(use) else use
        for at in use.tolist():
            found.setdefault(int(doc[at]), []).append((scale, at))
        scale *= 2
    return found


class Extender:
    """Compares stretches of a document's words."""

    def __init__(self, ids: np.ndarray) -> None:
        self.n, self.data = len(ids), ids.astype(np.int32).tobytes()

    def same(self, a: int, b: int, size: int) -> bool:
        return self.data[4 * a : 4 * (a + size)] == self.data[4 * b : 4 * (b + size)]

    def stretch(self, at: int, period: int, known: int) -> tuple[int, int]:
        """(start, end) of the words of the given period around `at`, of which `known` words agree with those a period later."""
        right, step = at + known, 16
        while step:  # doubling while stretches agree, halving where they don't
            if right + step + period <= self.n and self.same(right, right + period, step):
                right, step = right + step, step * 2
            else:
                step //= 2
        left, step = at, 16
        while step:
            if left >= step and self.same(left - step, left - step + period, step):
                left, step = left - step, step * 2
            else:
                step //= 2
        return left, right + period


def runs_of(ids: np.ndarray, blocks: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one document, from its candidate blocks (scale, place)."""
    words, extend = tuple(ids.tolist()), Extender(ids)
    automaton, key_at = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), {}
    for scale, at in blocks:
        key = words[at : at + scale]
        known = automaton.get(key, None)
        if known is None:
            automaton.add_word(key, known := (scale, at))
        key_at[scale, at] = known[1]  # the first place of this block names it
    automaton.make_automaton()
    seeds: dict[int, list[tuple[int, int]]] = {}
    for end, (scale, name) in automaton.iter(words):
        place = end + 1 - scale
        at = (place - scale) // scale * scale  # the one aligned block at a distance of scale to 2 * scale - 1
        if at >= 0 and key_at.get((scale, at)) == name:
            seeds.setdefault(scale, []).append((place - at, at))
    found: dict[tuple[int, int], int] = {}
    cover = Cover(len(words))
    for scale in sorted(seeds):
        new, last, until = [], 0, 0
        for period, at in sorted(seeds[scale]):
            if period != last:
                last, until = period, 0
            if at + scale <= until or at + 3 * period > len(words) or cover.inside(at, at + period + scale):
                continue
            if extend.same(at, at + period, 2 * period):
                start, end = extend.stretch(at, period, 2 * period)
                until = end - period
                if end - start >= max(LEAST, TIMES * period) and (start, end) not in found:
                    found[start, end] = period
                    new.append((start, end))
        cover.add(new)
    return sorted((start, end - start, period) for (start, end), period in found.items())


class Cover:
    """For each word, where the farthest run that begins at it or before ends."""

    def __init__(self, n: int) -> None:
        self.ends, self.reach = np.zeros(n + 1, np.int64), None

    def add(self, spans: list[tuple[int, int]]) -> None:
        for start, end in spans:
            self.ends[start] = max(self.ends[start], end)
        if spans:
            self.reach = np.maximum.accumulate(self.ends).tolist()

    def inside(self, start: int, end: int) -> bool:
        return self.reach is not None and self.reach[start] >= end


def rewritten(words: list[bytes], doc_id: str | None) -> list[bytes]:
    """The words, of which one document in ten repeats a passage to its end."""
    h, n = zlib.crc32(doc_id.encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _batches(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Pieces of about BATCH bytes."""
    number = np.cumsum([len(b) for b in pdf["body"]]) // BATCH
    for _, part in pdf.groupby(number, sort=False):
        yield part


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prepare=lambda words, doc_id: words) -> DataFrame:
    """(id, n_words, runs, collapsed) of each text: its runs by start, then period, and its words without what repeats in a run.

    prepare(words, id) may change the words before."""
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))

    def search(frames):
        for pdf in frames:
            for part in _batches(pdf):
                ids_of = part["id"].where(part["id"].notna(), None)
                texts = [prepare(body.split(), i) for body, i in zip(part["body"], ids_of)]
                lens = np.array([len(w) for w in texts], np.int64)
                starts, codes = np.cumsum(lens) - lens, {}
                ids = np.fromiter((codes.setdefault(w, len(codes)) for words in texts for w in words), np.int64, lens.sum())
                doc = np.repeat(np.arange(len(texts)), lens)
                blocks = candidates(doc * max(len(codes), 1) + ids, doc, starts)
                out = []
                for k, (i, words) in enumerate(zip(ids_of, texts)):
                    mine = [(scale, at - int(starts[k])) for scale, at in blocks.get(k, ())]
                    runs, kept = runs_of(ids[starts[k] : starts[k] + lens[k]], mine) if mine else [], words
                    if runs:
                        mark = np.zeros(len(words) + 1, np.int64)
                        for start, length, period in runs:
                            mark[start + period] += 1
                            mark[start + length] -= 1
                        kept = [w for w, x in zip(words, np.cumsum(mark).tolist()) if not x]
                    out.append((i, len(words), runs, b" ".join(kept)))
                yield pd.DataFrame(out, columns=["id", "n_words", "runs", "collapsed"])

    return rows.mapInPandas(search, RUNS)


def digests(found: DataFrame) -> DataFrame:
    """(id, n_runs, the longest run, digests of all runs and of the collapsed text), from the rows of find_runs."""
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = found.withColumn("best", best)
    return out.select(
        "id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    found = digests(find_runs(docs, prepare=rewritten))
    return found.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *found.columns[1:])
