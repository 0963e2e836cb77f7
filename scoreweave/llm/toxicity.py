"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

*Fit* reads a bounded sample of labelled rows (`sample`, a documented parameter; chosen by a hash of the id).  Copies
and near copies within the sample count once: rows that share one of four min-hashes of five-word shingles form a group and one stays.

*All words.*  Every word of a text has a weight, and every example that stays is indexed, clean ones too.  Document
frequencies of the examples' words are counted over all documents.  Words that no example holds change the length of a text's
vector only, and with it all its cosines alike: neither the order of its neighbours nor their votes, which weigh by share, depend on them.  The index is block-max: examples stand in blocks of 64, alike ones together (cut
again and again along the main direction of their frequent words).  Lists of seldom words are short and summed for all
examples; of frequent words each block knows the greatest weight.  Both give a bound per block, blocks are visited by
descending bound, and the search ends when no bound reaches the k-th cosine.  Weights are 32-bit numbers, and what comes
within SLACK of the k-th cosine is summed again with 64 bits, so the k nearest are exact.  They are returned as evidence.

*Marks.*  Beside that, the examples are compared by the terms that mark toxic ones: words and the first letters of words (stems
of 4 to 7 bytes) whose likelihood-ratio statistic against the label exceeds 2 ln(number of terms), so that chance terms stay
out at every sample size, and that are LIFT times likelier in toxic examples.  These vectors have an index of the same kind.

*Score.*  In either search the votes weigh as their cosine (over all words: as its share of the neighbours' sum); a logistic curve over
both votes, fitted on the sample with each row's own group left out, gives the probability.

Only texts are inputs of a score.  Whole texts are read.  Null and empty texts, and texts without any word of an example,
have no neighbour and get the curve's value at votes 0.  A doc_id with several labels is toxic if one of them says so, and of rows that
repeat a doc_id the least text is learnt from; null labels are ignored; without labels of both kinds every score is the
sample's toxic share.  Rows that repeat are scored each; an empty table gives an empty result.  Extra columns are not touched, whatever
their names; those named as a result (score, evidence) give way to it.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows that are read at most, neighbours, examples per block, blocks visited at a time; bytes of stems; how many times
#: likelier a mark must be under the label.
SAMPLE, NEAREST, BLOCK, STEP, STEMS, LIFT = 4_096, 15, 64, 8, (4, 5, 6, 7), 10
#: Frequent words at most (the others are in lists), texts looked at together, keys in a row of counts; rounding of 32-bit sums at most.
DENSE, TOGETHER, SPAN, SLACK = 1_024, 64, 4_096, 1e-4
WORD = re.compile(rb"[a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.lower().encode("utf-8", "replace")) if text else []


def terms_of(words) -> set[bytes]:
    """The terms that distinct words stand for: the words and their stems, which end where a letter ends."""
    return set(words).union(*({b"^" + w[:n] for w in words if len(w) >= n and (len(w) == n or w[n] & 0xC0 != 0x80)} for n in STEMS))


def hashed(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words' hashes and how often each stands."""
    return C.hash_words(list(words)), np.fromiter(words.values(), np.int64, len(words))


def _alike(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which alike ones are near: halves along the main direction, down to BLOCK rows."""

    def cut(rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) <= BLOCK:
            return [rows]
        y = x[rows] - x[rows].mean(axis=0)
        way = np.random.default_rng(0).standard_normal(x.shape[1]).astype(x.dtype)
        for _ in range(8):
            way = y.T @ (y @ way)
            way /= np.linalg.norm(way) or 1
        rows = rows[np.argsort(y @ way, kind="stable")]
        half = -(-len(rows) // 2 // BLOCK) * BLOCK
        return cut(rows[:half]) + cut(rows[half:])

    return np.concatenate(cut(np.arange(len(x)))) if len(x) else np.empty(0, np.int64)


class BlockMax:
    """Exact search for the nearest of a bounded set of sparse unit vectors (terms, weights) by cosine."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, groups: np.ndarray) -> None:
        rows = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(t) for t, _ in vectors])
        terms = np.concatenate([t for t, _ in vectors]).astype(np.int32) if vectors else np.empty(0, np.int32)
        weights = np.concatenate([w for _, w in vectors]).astype(np.float32) if vectors else np.empty(0, np.float32)
        n = np.bincount(terms, minlength=n_terms)
        often = np.argsort(-n, kind="stable")[:DENSE]
        often = often[n[often] * 64 >= max(len(vectors), 64 * 16)]
        self.line, self.blocks = np.full(n_terms, -1), -(-len(vectors) // BLOCK)
        self.line[often] = np.arange(len(often))
        held = np.zeros((len(vectors), len(often)), np.float32)
        in_held = self.line[terms] >= 0
        held[rows[in_held], self.line[terms[in_held]]] = weights[in_held]
        self.order = _alike(held)  # which vector stands at a place
        place = np.empty(len(vectors), np.int32)
        place[self.order] = np.arange(len(vectors), dtype=np.int32)
        full = np.zeros((self.blocks * BLOCK, len(often)), np.float32)
        full[: len(vectors)] = held[self.order]
        self.held = np.ascontiguousarray(full.reshape(self.blocks, BLOCK, len(often)).transpose(0, 2, 1))
        self.maxima = np.ascontiguousarray(self.held.max(axis=2).T)
        self.groups = np.full(self.blocks * BLOCK, -1)
        self.groups[: len(vectors)] = groups[self.order]
        by_term = np.argsort(terms, kind="stable")
        self.cuts = np.searchsorted(terms[by_term], np.arange(n_terms + 1))
        self.places, self.weights = place[rows[by_term]], weights[by_term]

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], without=None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the NEAREST of the set (numbers, cosines above 0), ties by number; those of its group in `without` don't count."""
        asked, out = np.zeros((len(vectors), len(self.maxima)), np.float32), []
        for k, (t, w) in enumerate(vectors):
            asked[k, self.line[t[self.line[t] >= 0]]] = w[self.line[t] >= 0]
        bounds, rows = asked @ self.maxima, self.held.reshape(-1, BLOCK)  # rows: a block's weights of a word
        for k, (t, w) in enumerate(vectors):
            if not len(t) or not self.blocks:
                out.append((np.empty(0, np.int64), np.empty(0)))
                continue
            rare, lines = self.line[t] < 0, self.line[t[self.line[t] >= 0]]
            a, size = self.cuts[t[rare]], self.cuts[t[rare] + 1] - self.cuts[t[rare]]
            at = np.arange(size.sum()) + np.repeat(a - np.cumsum(size) + size, size)
            seldom = np.bincount(self.places[at], np.repeat(w[rare], size) * self.weights[at], self.blocks * BLOCK).astype(float)
            if without is not None:
                seldom[self.groups == without[k]] = -np.inf
            seldom = seldom.reshape(self.blocks, BLOCK)
            bound = bounds[k] + seldom.max(axis=1) + SLACK
            seen, sums, least, few = np.argsort(-bound, kind="stable"), np.empty(0), 0.0, w[~rare].astype(np.float32)
            for start in range(0, self.blocks, STEP):
                now = seen[start : start + STEP]
                if bound[now[0]] <= max(least - SLACK, SLACK):
                    seen = seen[:start]
                    break
                sums = np.append(sums, np.matmul(few, rows.take(now[:, None] * len(self.maxima) + lines, axis=0, mode="clip")) + seldom[now])
                if len(sums) > NEAREST:
                    least = np.partition(sums, len(sums) - NEAREST)[len(sums) - NEAREST]
            near = np.flatnonzero((sums > 0) & (sums >= least - SLACK))
            near = seen[near // BLOCK] * BLOCK + near % BLOCK
            sims = seldom.reshape(-1)[near] + self.held[(near // BLOCK)[:, None], lines, (near % BLOCK)[:, None]].astype(float) @ w[~rare]
            number = self.order[near]
            first = np.lexsort((number, -sims))[:NEAREST]
            out.append((number[first], sims[first]))
        return out


@dataclass
class Whole:
    """The examples' vectors over all words."""

    keys: np.ndarray  # hashes of the examples' words, sorted
    idf: np.ndarray
    unseen: float  # the idf of other words
    ids: list[str]
    groups: np.ndarray
    toxic: np.ndarray
    bank: BlockMax = None

    def vector(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the words that examples hold; the unit length is that of all words."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[at] == hashes
        weight = (1 + np.log(counts)) * np.where(known, self.idf[at], self.unseen)
        return at[known], weight[known] / np.sqrt((weight**2).sum() or 1.0)

    def index(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.bank = BlockMax(vectors, len(self.keys), self.groups)


def document_frequencies(docs: DataFrame, keys: np.ndarray, text: str) -> tuple[np.ndarray, int]:
    """In how many documents each key's word stands, and the number of documents with a text."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def count(frames):
        keys, n = shared.value, 0
        held = np.zeros(len(keys), np.int64)
        for pdf in frames:
            for body in pdf["body"]:
                h = C.hash_words(list(set(words_of(body))))
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                held[at[keys[at] == h]] += 1
                n += 1
        yield pd.DataFrame({"span": [-1], "held": [np.array([n]).tobytes()]})
        cut = [(k, held[k * SPAN : (k + 1) * SPAN]) for k in range(-(-len(keys) // SPAN))]
        yield pd.DataFrame([(k, x.tobytes()) for k, x in cut if x.any()], columns=["span", "held"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"span": pdf["span"][:1], "held": [sum(np.frombuffer(x, np.int64) for x in pdf["held"]).tobytes()]})

    parts = docs.select(F.col(text).alias("body")).where(F.length("body") > 0).mapInPandas(count, "span int, held binary")
    found = {r["span"]: np.frombuffer(r["held"], np.int64) for r in parts.groupBy("span").applyInPandas(add, "span int, held binary").collect()}  # a number per key
    return np.concatenate([found[k] for k in range(-(-len(keys) // SPAN))]), int(found[-1][0])


@dataclass
class Model:
    """The indexes over the examples' marks and over all words, and the curve."""

    slope: tuple[float, float] = (0.0, 0.0)
    whole: Whole = None
    base: float = -20.0
    idf: dict[bytes, tuple[int, float]] = field(default_factory=dict)
    heads: frozenset[bytes] = frozenset()  # the first bytes that a word with a mark has
    ids: list[str] = field(default_factory=list)
    groups: np.ndarray = None
    toxic: np.ndarray = None
    bank: BlockMax = None

    def know(self, marks: list[tuple[bytes, float]]) -> None:
        self.idf = {t: (k, x) for k, (t, x) in enumerate(sorted(marks))}
        self.heads = frozenset(t.removeprefix(b"^")[: STEMS[0]] for t in self.idf)

    def vector(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and unit weights of the marks."""
        hit: Counter = Counter()
        for w in [w for w in words if w[: STEMS[0]] in self.heads]:
            for t in terms_of((w,)):
                if t in self.idf:
                    hit[t] += words[w]
        if not hit:
            return np.empty(0, np.int64), np.empty(0)
        found = sorted((*self.idf[t], n) for t, n in hit.items())
        weight = (1 + np.log([x[2] for x in found])) * np.array([x[1] for x in found])
        return np.array([x[0] for x in found]), weight / np.sqrt((weight**2).sum())

    def index(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.bank = BlockMax(vectors, len(self.idf), self.groups)

    def votes(self, bodies, without=None) -> tuple[np.ndarray, list[list[str]]]:
        """The two votes (by marks, by all words) on each text, and the nearest examples by all words.  Examples vote as their cosine."""
        if self.whole is None:
            return np.zeros((len(bodies), 2)), [[] for _ in bodies]
        texts = [Counter(words_of(body)) for body in bodies]
        near = self.whole.bank.nearest([self.whole.vector(*hashed(x)) for x in texts], without)
        marked = self.bank.nearest([self.vector(x) for x in texts], without)
        vote = lambda toxic, f, s: float((s * toxic[f]).sum() / (s.sum() + 1.0)) if len(f) else 0.0
        part = lambda f, s: float((s * self.whole.toxic[f]).sum() / s.sum()) if len(f) else 0.0
        votes = [(vote(self.toxic, *m), part(*w)) for m, w in zip(marked, near)]
        return np.array(votes).reshape(-1, 2), [[self.whole.ids[k] for k in f[:5]] for f, _ in near]

    def probability(self, votes):
        return 1 / (1 + np.exp(-np.clip(self.base + votes @ np.array(self.slope), -30, 30)))


def _groups(hashes: np.ndarray) -> np.ndarray:
    """Number of each row's group: rows that share a value in a column belong together."""
    parent = np.arange(len(hashes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for column in hashes.T:
        first: dict[int, int] = {}
        for k, v in enumerate(column.tolist()):
            a, b = root(k), root(first.setdefault(v, k))
            parent[max(a, b)] = min(a, b)
    return np.array([root(k) for k in range(len(hashes))], np.int64)


def _curve(votes: np.ndarray, toxic: np.ndarray) -> tuple[tuple[float, float], float]:
    """Logistic curve (slopes >= 0, base) by Newton's method with a small ridge; a vote whose slope were negative is left out."""
    used = np.ones(votes.shape[1], bool)
    while True:
        x, w = np.column_stack((votes[:, used], np.ones(len(votes)))), np.zeros(used.sum() + 1)
        w[-1] = np.log((toxic.mean() + 1e-3) / (1 - toxic.mean() + 1e-3))
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - toxic) + 1e-2 * w
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), grad)
            w = w - np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        if (w[:-1] >= 0).all():
            slope = np.zeros(len(used))
            slope[used] = w[:-1]
            return tuple(map(float, slope)), float(w[-1])
        used[np.flatnonzero(used)[np.argmin(w[:-1])]] = False


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """labels: (doc_id, label) rows that may be learnt from."""
    spark, model = docs.sparkSession, Model()
    one = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("string").alias("id")).agg(F.max(F.col(label)).cast("int").alias("toxic"))
    chosen = one.orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # at most `sample` rows
    if not chosen:
        return model
    share = sum(r["toxic"] for r in chosen) / len(chosen)
    model.base = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    if not 0 < share < 1:
        return model
    picked = F.broadcast(spark.createDataFrame(chosen, "id string, toxic int"))
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).join(picked, "id")
    rows = C.materialize(rows.where(F.length("text") > 0).groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).repartition(24, "id"), "labelled")

    def sketch(frames):
        for pdf in frames:
            out = []
            for i, body, y in zip(pdf["id"], pdf["text"], pdf["toxic"]):
                h = C.hash_words(words_of(body))
                h = C.window_hashes(h, min(5, max(1, len(h))))
                low = [int(C.finalize(h ^ C.U64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))).min().view(np.int64)) if len(h) else xxhash.xxh3_64_intdigest(str(i)) >> 1 for k in range(1, 5)]
                out.append((i, y, low))
            yield pd.DataFrame(out, columns=["id", "toxic", "low"])

    seen = sorted(rows.mapInPandas(sketch, "id string, toxic int, low array<bigint>").collect(), key=lambda r: r["id"])  # at most `sample` rows
    group = _groups(np.array([[x & (2**64 - 1) for x in r["low"]] for r in seen], np.uint64))
    of = {r["id"]: int(g) for r, g in zip(seen, group)}
    kept = {}
    for r in seen:
        kept.setdefault((of[r["id"]], r["toxic"]), r["id"])
    known = spark.sparkContext.broadcast(set(kept.values()))

    def count(frames):
        seen = {0: Counter(), 1: Counter()}
        for pdf in frames:
            for i, body, y in zip(pdf["id"], pdf["text"], pdf["toxic"]):
                if i in known.value:
                    seen[int(y > 0)].update(terms_of(set(words_of(body))))
        both = seen[0].keys() | seen[1].keys()
        yield pd.DataFrame({"term": list(both), "neg": [seen[0][t] for t in both], "pos": [seen[1][t] for t in both]})

    counts = rows.mapInPandas(count, "term binary, neg long, pos long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    counts = C.materialize(counts, "terms")
    p, n, distinct = sum(1 for (_, y) in kept if y), sum(1 for (_, y) in kept if not y), counts.count()
    total, part = F.lit(float(p + n)), lambda o, of: F.when(o > 0, o * F.log(o / (F.col("df") * of / (p + n)))).otherwise(0.0)
    tested = counts.withColumn("df", F.col("neg") + F.col("pos")).withColumn("g", 2 * (part(F.col("pos"), F.lit(float(p))) + part(F.col("neg"), F.lit(float(n)))))
    good = tested.where(((F.col("pos") + 0.5) * n > LIFT * (F.col("neg") + 0.5) * p) & (F.col("g") > float(2 * np.log(max(distinct, 2)))))
    found = good.withColumn("idf", F.log(1 + total / F.col("df"))).select("term", "idf").collect()  # a part of the sample's terms
    model.know([(bytes(r["term"]), r["idf"]) for r in found])
    vocabulary = spark.sparkContext.broadcast(model)

    def vectors(frames):
        for pdf in frames:
            out = []
            for i, body, y in zip(pdf["id"], pdf["text"], pdf["toxic"]):
                if i in known.value:
                    words = Counter(words_of(body))
                    h, n = hashed(words)
                    out.append((i, y, *vocabulary.value.vector(words), h.tobytes(), n.astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["id", "toxic", "terms", "weights", "hashes", "counts"])

    # At most `sample` rows with their distinct words.
    examples = rows.mapInPandas(vectors, "id string, toxic int, terms array<bigint>, weights array<double>, hashes binary, counts binary").collect()
    examples = sorted(examples, key=lambda r: r["id"])
    bank = [(r, (np.array(r["terms"], np.int64), np.array(r["weights"]))) for r in examples if r["terms"]]
    model.ids, model.toxic = [r["id"] for r, _ in bank], np.array([float(r["toxic"] > 0) for r, _ in bank])
    model.groups = np.array([of[r["id"]] for r, _ in bank], np.int64)
    model.index([v for _, v in bank])
    texts = [(np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["counts"], np.int32)) for r in examples]
    keys = np.unique(np.concatenate([h for h, _ in texts])) if texts else np.empty(0, np.uint64)
    if not len(keys):
        return model
    df, n_docs = document_frequencies(docs, keys, text)
    model.whole = Whole(keys, np.log(1 + n_docs / df), float(np.log(1 + n_docs)), [r["id"] for r in examples], np.array([of[r["id"]] for r in examples]), np.array([float(r["toxic"] > 0) for r in examples]))
    model.whole.index([model.whole.vector(*x) for x in texts])
    del examples, bank, texts
    indexed = spark.sparkContext.broadcast(model)

    def tried(frames):
        for pdf in frames:
            pdf = pdf[pdf["id"].isin(known.value)]
            for start in range(0, len(pdf), TOGETHER):
                part = pdf[start : start + TOGETHER]
                votes, _ = indexed.value.votes(list(part["text"]), [of[i] for i in part["id"]])
                yield pd.DataFrame({"toxic": part["toxic"].to_numpy(), "marks": votes[:, 0], "all": votes[:, 1]})

    votes = np.array(rows.mapInPandas(tried, "toxic int, marks double, all double").collect())  # at most `sample` rows
    model.slope, model.base = _curve(votes[:, 1:], (votes[:, 0] > 0).astype(float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs (whole rows) with score (0 to 1) and evidence (the ids of the nearest examples, nearest first)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, evidence array<string>")
    def judge(bodies: pd.Series) -> pd.DataFrame:
        m, out = shared.value, []
        for start in range(0, len(bodies), TOGETHER):
            votes, near = m.votes(list(bodies[start : start + TOGETHER]))
            out += zip(m.probability(votes).tolist(), near)
        return pd.DataFrame(out, columns=["score", "evidence"])

    rows = docs.select(F.struct("*").alias("row"), judge(F.col(text)).alias("judged"))  # so that no column of docs meets one of ours
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ("score", "evidence")), "judged.score", "judged.evidence")


def fold(doc_id: str = "doc_id"):
    """Whether a row is held out from learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(spark, docs: DataFrame, sf_dir: str) -> Model:
    return fit(docs, C.table(spark, sf_dir, "labels").where(~fold()))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, learn(spark, docs, sf_dir))
    return found.select("doc_id", fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
