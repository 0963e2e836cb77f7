"""How far the sources of a language differ in their words: sorted streams, scanned by run length.

1. *Tally.*  Each task codes the words of a stretch of documents (TOKENS and BYTES at most, or one longer document), sorts
   (term, source, document) as numbers and scans the runs: a run of one document is a count, the runs of one source give
   its document frequency and its count.  One row per (lang, term, source) and stretch leaves the task.
2. *Combine.*  These rows are added up per (lang, term, source), so that a term of all documents arrives at the next step
   once per source, not once per stretch.
3. *Scan.*  Rows are dealt by (lang, term) and sorted by (lang, term, source).  A run of one term ends with its document
   frequency; if LEAST documents hold it, it leaves as one row with its sources and counts.
4. *Second scan.*  With the totals of the sources known, each run emits its part of every pair's distance (added up within
   the task) and of every source's leading terms (the first TOP within the task); partial results meet at the end.

The totals that tasks get by broadcast are one number per (lang, source): the square root of the rows of part `pair`.  A run
has as many entries as its language has sources.

All arithmetic is on whole numbers, exact beyond 64 bits, too.

Rows: null text, lang and source are empty strings; every row is a document of its own, whatever its id (rows that repeat
count again).  Very long texts are read whole, in a stretch of their own.  Equal values are ranked by item.  A language without
kept terms has pairs of value 0.  An empty table gives an empty result.  Extra columns are not touched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Documents of a language that a kept term has at least; ranks of part `term`; parts of the whole; added to each count.
LEAST, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
#: Words and bytes of a stretch at most; numbers of a matrix at most; counts up to which SCALE * count fits 64 bits.
TOKENS, BYTES, CELLS, SMALL = 4_000_000, 64_000_000, 4_000_000, 9_000_000_000
#: Letters become lower-case and bytes of other than ASCII stay; all else parts words.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TALLY = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("df", pa.int64()), ("n", pa.int64())])
PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
RUNS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


class Codes(dict):
    """word -> 0, 1, 2, ... in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def starts_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    changed = np.zeros(len(sorted_keys[0]), bool)
    changed[:1] = True
    for x in sorted_keys:
        changed[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(changed)


def _tallied(langs: list[str], sources: list[str], tokens: list[np.ndarray], terms: Codes) -> pa.RecordBatch:
    """The runs of a stretch of documents."""
    groups = sorted({*zip(langs, sources)})
    number = {g: k for k, g in enumerate(groups)}
    group = np.array([number[g] for g in zip(langs, sources)], np.int64)
    place = np.empty(len(group), np.int64)
    place[np.argsort(group, kind="stable")] = np.arange(len(group))  # documents of one source stand together
    key = np.concatenate(tokens) * len(group) + np.repeat(place, [len(x) for x in tokens])
    key.sort()
    first = starts_of(key)
    held, term = np.diff(np.append(first, len(key))), key[first] // len(group)
    of = np.sort(group)[key[first] % len(group)]
    run = starts_of(term, of)
    words = pa.array(list(terms), pa.binary()).cast(pa.string())
    take = lambda names, at: pa.array(names, pa.string()).take(pa.array(at))
    count = np.add.reduceat(held, run) if len(run) else held
    return pa.RecordBatch.from_arrays(
        [take([g[0] for g in groups], of[run]), words.take(pa.array(term[run])), take([g[1] for g in groups], of[run]), pa.array(np.diff(np.append(run, len(term)))), pa.array(count)], schema=TALLY
    )


def tally(batches: Iterator[pa.RecordBatch], most: int = TOKENS) -> Iterator[pa.RecordBatch]:
    """(lang, source, body) -> rows of TALLY, one per stretch, term and source."""
    langs, sources, tokens, terms, n, size = [], [], [], Codes(), 0, 0
    for batch in batches:
        for lang, source, body in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "body"))):
            words = body.translate(LETTERS).split()
            if n and (n + len(words) > most or size + len(body) > BYTES):
                yield _tallied(langs, sources, tokens, terms)
                langs, sources, tokens, terms, n, size = [], [], [], Codes(), 0, 0
            langs.append(lang), sources.append(source)
            tokens.append(np.fromiter(map(terms.__getitem__, words), np.int64, len(words)))
            n, size = n + len(words), size + len(body)
    if n:
        yield _tallied(langs, sources, tokens, terms)


def scan(batches: Iterator[pa.RecordBatch], least: int = LEAST) -> Iterator[pa.RecordBatch]:
    """Rows of TALLY, sorted by (lang, term, source) -> runs of terms that `least` documents hold."""

    def runs(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        lang, term, df = (table.column(c).combine_chunks() for c in ("lang", "term", "df"))
        changed = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
        first = np.append(0, np.flatnonzero(changed) + 1)
        ends = np.append(first[1:], len(lang))
        if not last:  # the last run may go on
            first, ends = first[:-1], ends[:-1]
        rest = table.slice(ends[-1] if len(ends) else 0)
        kept = np.add.reduceat(df.to_numpy()[: ends[-1]], first) >= least if len(first) else np.empty(0, bool)
        first, ends = first[kept], ends[kept]
        sizes = ends - first
        at = pa.array(np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes))
        cuts = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, table.column(c).combine_chunks().take(at)) for c in ("source", "n")]
        return pa.RecordBatch.from_arrays([lang.take(pa.array(first)), term.take(pa.array(first)), *lists], schema=RUNS), rest

    waiting: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows:
            waiting.append(pa.Table.from_batches([batch]).cast(TALLY))
            out, rest = runs(pa.concat_tables(waiting), False)
            waiting = [rest]
            yield out
    if waiting:
        yield runs(pa.concat_tables(waiting), True)[0]


def shares(counts: np.ndarray, totals, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms))."""
    most = int(counts.max(initial=0)) + PRIOR
    kind = np.int64 if most < SMALL else object
    return (1 + (counts.astype(kind) + PRIOR) * SCALE // (np.asarray(totals, kind) + PRIOR * terms)).astype(np.int64)


class Leaders:
    """The TOP (value, term) of each source: highest value first, ties by term."""

    def __init__(self) -> None:
        self.source, self.value, self.term = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, object)

    def add(self, source: np.ndarray, value: np.ndarray, term: np.ndarray) -> None:
        source, value, term = np.append(self.source, source), np.append(self.value, value), np.append(self.term, term)
        order = np.lexsort((-value, source))
        source, value, term = source[order], value[order], term[order]
        first = starts_of(source)
        size = np.diff(np.append(first, len(source)))
        at_top = np.repeat(value[first + np.minimum(size, TOP) - 1], size) if len(first) else value
        near = np.flatnonzero(value >= at_top)  # the TOP, and all that equal the last of them
        exact = sorted(near.tolist(), key=lambda k: (source[k], -value[k], term[k]))
        source, value, term = source[exact], value[exact], term[exact]
        rank = np.arange(len(source)) - np.repeat(starts_of(source), np.diff(np.append(starts_of(source), len(source))))
        self.source, self.value, self.term = source[rank < TOP], value[rank < TOP], term[rank < TOP]


def _parts(batches: Iterator[pa.RecordBatch], known: dict[str, tuple[list[str], list[int], int]], cells: int = CELLS) -> Iterator[pd.DataFrame]:
    """Runs of kept terms -> partial rows (lang, source, part, item, value); pairs once, the smaller name as source."""
    number = {lang: {s: k for k, s in enumerate(names)} for lang, (names, _, _) in known.items()}
    sums: dict[str, np.ndarray] = {}
    best: dict[str, Leaders] = {}
    shape = lambda lang, s, part, item, value: pd.DataFrame({"lang": lang, "source": s, "part": part, "item": item, "value": value})
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            names, totals, terms = known[lang]
            here = batch.filter(pa.array(langs == lang))
            for start in range(0, here.num_rows, max(1, cells // len(names))):
                some = here.slice(start, max(1, cells // len(names)))
                word = np.array(some.column("term").to_pylist(), object)
                sizes = pc.list_value_length(some.column("sources")).to_numpy()
                line = np.repeat(np.arange(len(word)), sizes)
                at = np.array([number[lang][s] for s in some.column("sources").flatten().to_pylist()], np.int64)
                counts = np.zeros((len(word), len(names)), np.int64)
                counts[line, at] = some.column("counts").flatten().to_numpy()
                share = shares(counts, totals, terms)
                whole = shares(counts.sum(axis=1), sum(totals), terms)
                over = share[line, at] > whole[line]
                best.setdefault(lang, Leaders()).add(at[over], (share[line, at] - whole[line])[over], word[line[over]])
                small = len(names) ** 2 <= cells
                for k in range(len(names) - 1):
                    far = np.abs(share[:, k + 1 :] - share[:, k : k + 1]).sum(axis=0)
                    if small:
                        sums.setdefault(lang, np.zeros((len(names), len(names)), np.int64))[k, k + 1 :] += far
                    else:
                        yield shape(lang, names[k], "pair", names[k + 1 :], far)
    for lang, matrix in sums.items():
        names = known[lang][0]
        for k in range(len(names) - 1):
            yield shape(lang, names[k], "pair", names[k + 1 :], matrix[k, k + 1 :])
    for lang, top in best.items():
        yield shape(lang, [known[lang][0][k] for k in top.source], "term", top.term, top.value)


def kept_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, tokens: int = TOKENS) -> DataFrame:
    """(lang, term, sources, counts): a row for each term that `least` documents of its language hold."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(name(lang).alias("lang"), name(source).alias("source"), name(text).cast("binary").alias("body"))
    parts = rows.mapInArrow(lambda batches: tally(batches, tokens), "lang string, term string, source string, df long, n long")
    sums = parts.groupBy("lang", "term", "source").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    dealt = sums.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(lambda batches: scan(batches, least), "lang string, term string, sources array<string>, counts array<long>")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, tokens: int = TOKENS, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distance to the others of its language, and the terms it has more
    often than the language."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kept = C.materialize(kept_terms(docs, text, lang, source, least, tokens), "kept-terms")
    flat = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = docs.select(name(lang).alias("lang"), name(source).alias("source")).distinct()
    groups = C.materialize(groups.join(flat, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "sources")
    terms = {r["lang"]: r["count"] for r in kept.groupBy("lang").count().collect()}
    known: dict[str, tuple[list[str], list[int], int]] = {}
    for r in groups.sort("lang", "source").collect():  # a number per source: the square root of the rows of part `pair`
        names, totals, _ = known.setdefault(r["lang"], ([], [], terms.get(r["lang"], 0)))
        names.append(r["source"]), totals.append(r["n"])
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def parts(batches):
        for pdf in _parts(batches, shared.value, cells):
            yield from pa.Table.from_pandas(pdf, schema=PARTS, preserve_index=False).to_batches()

    partial = C.materialize(kept.mapInArrow(parts, "lang string, source string, part string, item string, value long"), "partial-divergence")
    sums = partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source < item")
    half = both.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    pairs = half.union(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return shape(pairs, "pair").union(shape(partial.where("part = 'term'"), "term").where(F.col("rank") <= TOP))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(C.table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT s.*, CAST(1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY s.lang, source) + 5 * v.v) AS BIGINT) AS p FROM s JOIN v ON v.lang = s.lang),
q AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (sum(n) + 5) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS BIGINT) AS q FROM s JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""
