"""Quality by regularised quadratic discriminant analysis over statistics of a document.

*Statistics.*  Each whole text is described by the shares, lengths and repetitions of STATISTICS; shares are taken to a
log-odds scale and sizes to a logarithm, which brings both near the normal densities that the method assumes.  Doc_id, lang, source and labels are never
among them.

*Fit.*  Every labelled row that may be learnt from counts (no sample): tasks add up counts, sums and products of the statistics per
class and fold, these partial sums are added up by number, and a few hundred sums per class and fold reach the driver.  The covariance of a class
is shrunk towards that of both classes together (share `pooled`) and towards its own mean variance (share `ridge`).  For each
pair of shares and each temperature of GRID the rows of a fold are scored by the model of the other folds, in one pass for all; the triple with
the least log-loss is refitted on all folds.  The Cholesky factors of the chosen covariances are inverted once and travel with the model.

*Score.*  The log-density difference of the two classes, from their Mahalanobis distances and determinants, plus the log-odds
of the labels, through a logistic curve.

Rows: null and empty texts have the statistics of no words and are scored like any text.  Very long texts are read
whole.  A doc_id with several labels is bad if one of them says so; null labels and null ids are ignored.  Rows that repeat an id are
learnt from and scored each.  With labels of one kind only every score is that label's share; without labels it is one half.  An empty table
gives an empty result.  Extra columns are not touched, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_spread", "upper", "digits", "marks", "shouts", "bars", "links", "other_bytes", "line_length", "short_lines",
    "line_ends", "repeated_lines", "repeated_words", "repeated_pairs", "repeated_next", "short_words", "long_words", "capitals", "sentence_length", "word_entropy", "hapax",
)
#: Folds of the labelled rows; what is tried (share of the pooled covariance, share of the mean variance, temperature).
FOLDS = 5
GRID = [(a, b, t) for a in (0.0, 0.1, 0.3, 0.6, 1.0) for b in (0.001, 0.01, 0.05, 0.2) for t in (1.0, 0.5, 0.25, 0.1)]
#: Statistics are kept within so many standard deviations of the labelled rows, so that one odd value cannot decide alone.
REACH = 6.0
LETTERS, UPPER, DIGITS = bytes(range(65, 91)) + bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789"
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
END = re.compile(rb"[.!?]+\s")


def _odds(part: float, whole: float) -> float:
    """A share as smoothed log-odds."""
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(body: bytes) -> list[float]:
    """The STATISTICS of a text, in that order."""
    words = body.split()
    n, size = len(words), len(body)
    count = lambda which: size - len(body.translate(None, which))
    letters, upper, digits, marks = count(LETTERS), count(UPPER), count(DIGITS), count(MARKS)
    ascii_size = len(body.decode("utf-8", "replace").encode("ascii", "ignore"))
    lines = [x for x in body.split(b"\n") if x.strip()]
    lens = np.fromiter(map(len, words), np.int64, n)
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    held = np.bincount(ids) if n else np.zeros(0, np.int64)
    pairs = len(np.unique(ids[1:] * len(codes) + ids[:-1])) if n > 1 else 0
    share = held / max(n, 1)
    line_lens = np.fromiter(map(len, lines), np.int64, len(lines))
    return [
        np.log1p(size),
        np.log1p(n),
        float(np.log1p(lens.mean())) if n else 0.0,
        float(np.log1p(lens.std())) if n else 0.0,
        _odds(upper, letters),
        _odds(digits, size),
        _odds(marks, size),
        _odds(body.count(b"!") + body.count(b"?"), n),
        _odds(body.count(b"|") + body.count(b"\t"), n),
        _odds(body.count(b"http") + body.count(b"@") + body.count(b"<"), n),
        _odds(size - ascii_size, size),
        float(np.log1p(line_lens.mean())) if len(lines) else 0.0,
        _odds(int((line_lens < 30).sum()), len(lines)),
        _odds(sum(x.rstrip()[-1:] in b".!?:" for x in lines), len(lines)),
        _odds(len(lines) - len(set(lines)), len(lines)),
        _odds(n - len(codes), n),
        _odds(max(n - 1, 0) - pairs, max(n - 1, 0)),
        _odds(int((ids[1:] == ids[:-1]).sum()), max(n - 1, 0)),
        _odds(int((lens < 4).sum()), n),
        _odds(int((lens > 12).sum()), n),
        _odds(sum(map(bytes.istitle, words)), n),
        float(np.log1p(n / (1 + len(END.findall(body))))),
        float(-(share * np.log(share)).sum() / np.log(n)) if n > 1 else 0.0,
        _odds(int((held == 1).sum()), len(codes)),
    ]


def described(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, x): the id as a string and the statistics as packed 64-bit numbers."""
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))

    def describe(frames):
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "x": [np.array(statistics(b), float).tobytes() for b in pdf["body"]]})

    return rows.mapInPandas(describe, "id string, x binary")


def matrix(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed), float).reshape(-1, len(STATISTICS))


@dataclass
class Sums:
    """Count, sums and sums of products of the rows of a class."""

    n: float
    s: np.ndarray
    p: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.s + other.s, self.p + other.p)

    @property
    def mean(self) -> np.ndarray:
        return self.s / max(self.n, 1)

    @property
    def covariance(self) -> np.ndarray:
        return self.p / max(self.n, 1) - np.outer(self.mean, self.mean)


@dataclass
class Class:
    """A normal density: its mean, the inverted Cholesky factor of its covariance, and its log-determinant."""

    mean: np.ndarray
    whitener: np.ndarray
    logdet: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return -0.5 * (((x - self.mean) @ self.whitener.T) ** 2).sum(axis=1) - 0.5 * self.logdet


@dataclass
class Model:
    centre: np.ndarray = None
    spread: np.ndarray = None
    good: Class = None
    bad: Class = None
    prior: float = 0.0
    temperature: float = 1.0
    chosen: tuple = ()

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -REACH, REACH)

    def difference(self, z: np.ndarray) -> np.ndarray:
        """The temperate log-density difference plus the labels' log-odds."""
        return self.prior + self.temperature * (self.good.log_density(z) - self.bad.log_density(z))

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.good is None:
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        return 1 / (1 + np.exp(-np.clip(self.difference(self.scaled(x)), -30, 30)))


def shrunk(sums: Sums, both: np.ndarray, pooled: float, ridge: float) -> Class:
    """The density of a class whose covariance is shrunk."""
    covariance = (1 - pooled) * sums.covariance + pooled * both
    d = len(covariance)
    covariance = (1 - ridge) * covariance + (ridge * max(np.trace(covariance) / d, 1e-6) + 1e-9) * np.eye(d)
    factor = np.linalg.cholesky(covariance)
    return Class(sums.mean, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()))


def densities(good: Sums, bad: Sums, pooled: float, ridge: float) -> tuple[Class, Class]:
    both = (good.n * good.covariance + bad.n * bad.covariance) / (good.n + bad.n)
    return shrunk(good, both, pooled, ridge), shrunk(bad, both, pooled, ridge)


def _added(rows: DataFrame, values) -> dict[tuple[int, int], np.ndarray]:
    """values(pdf) gives (class, fold, vector) per task; the vectors are added up by number, and one sum each comes back."""

    def partial(frames):
        held: dict[tuple[int, int], np.ndarray] = {}
        for pdf in frames:
            for label, fold, vector in values(pdf):
                held[label, fold] = held[label, fold] + vector if (label, fold) in held else vector
        for (label, fold), vector in held.items():
            yield pd.DataFrame({"label": label, "fold": fold, "k": np.arange(len(vector)), "v": vector})

    sums = rows.mapInPandas(partial, "label int, fold int, k int, v double").groupBy("label", "fold", "k").agg(F.sum("v").alias("v"))
    found: dict[tuple[int, int], list] = {}
    for r in sums.collect():  # some 600 numbers per class and fold
        found.setdefault((r["label"], r["fold"]), []).append((r["k"], r["v"]))
    return {key: np.array([v for _, v in sorted(x)]) for key, x in found.items()}


def fold_of(ids) -> np.ndarray:
    return np.array([zlib.crc32(b"fold" + str(i).encode()) % FOLDS for i in ids], np.int64)


def fit(described_rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> Model:
    """described_rows: (id, x); labels: (doc_id, label) rows that may be learnt from."""
    d, model = len(STATISTICS), Model()
    one = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("string").alias("id")).agg(F.min(F.col(label)).cast("int").alias("y"))
    rows = C.materialize(described_rows.join(one, "id").select("id", "x", "y"), "labelled")
    pieces = lambda pdf: ((y, f, pdf[(pdf["y"] > 0).to_numpy() == bool(y)][fold_of(pdf["id"])[(pdf["y"] > 0).to_numpy() == bool(y)] == f]) for y in (0, 1) for f in range(FOLDS))

    def first(pdf):
        x = matrix(pdf["x"])
        yield 0, 0, np.concatenate(([len(x), (pdf["y"] > 0).sum()], x.sum(axis=0), (x**2).sum(axis=0)))

    total = _added(rows, first).get((0, 0))
    if total is None:
        return model
    n, n_good = total[:2]
    model.prior = float(np.log((n_good + 1e-9) / (n - n_good + 1e-9)))
    if not 0 < n_good < n:
        return model
    model.centre = total[2 : 2 + d] / n
    model.spread = np.sqrt(np.maximum(total[2 + d :] / n - model.centre**2, 1e-12))
    model.spread[model.spread < 1e-5] = 1.0

    def second(pdf):
        for y, f, part in pieces(pdf):
            if len(part):
                z = model.scaled(matrix(part["x"]))
                yield y, f, np.concatenate(([len(z)], z.sum(axis=0), (z.T @ z).reshape(-1)))

    vectors = _added(rows, second)
    none = np.zeros(1 + d + d * d)
    of = {(y, f): Sums((v := vectors.get((y, f), none))[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for y in (0, 1) for f in range(FOLDS)}
    zero = Sums(0.0, np.zeros(d), np.zeros((d, d)))
    everything = {y: sum((of[y, f] for f in range(FOLDS)), zero) for y in (0, 1)}
    without = {(y, f): sum((of[y, g] for g in range(FOLDS) if g != f), zero) for y in (0, 1) for f in range(FOLDS)}
    tried = {(f, a, b): densities(without[1, f], without[0, f], a, b) for f in range(FOLDS) for a, b in {(a, b) for a, b, _ in GRID} if min(without[1, f].n, without[0, f].n) > 0}

    def losses(pdf):
        for y, f, part in pieces(pdf):
            if not len(part) or (f, *GRID[0][:2]) not in tried:
                continue
            z, found = model.scaled(matrix(part["x"])), {}
            for (g, a, b), (good, bad) in tried.items():
                if g == f:
                    found[a, b] = good.log_density(z) - bad.log_density(z)
            yield 0, 0, np.array([np.log1p(np.exp(np.clip((1 - 2 * y) * (model.prior + t * found[a, b]), -30, 30))).sum() for a, b, t in GRID])

    lost = _added(rows, losses).get((0, 0), np.zeros(len(GRID)))
    model.chosen = GRID[int(np.argmin(np.round(lost, 6)))]
    model.good, model.bad = densities(everything[1], everything[0], *model.chosen[:2])
    model.temperature = model.chosen[2]
    return model


def score(described_rows: DataFrame, model: Model) -> DataFrame:
    """(id, score) of described rows: 1 means good."""
    shared = described_rows.sparkSession.sparkContext.broadcast(model)

    def judge(frames):
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "score": shared.value.probability(matrix(pdf["x"]))})

    return described_rows.mapInPandas(judge, "id string, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether labels of a row are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op12_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    rows = C.materialize(described(docs), "statistics")
    model = fit(rows, C.table(spark, sf_dir, "labels").where(~held_out()))
    found = score(rows, model).withColumn("doc_id", F.col("id").cast(docs.schema["doc_id"].dataType))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
