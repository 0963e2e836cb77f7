"""Periodic runs, the quality classifier and the source divergence audit against brute force, and on odd rows; long media; the shared folder."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreweave.llm import common, media, periodic_runs, quality, queries, source_divergence, webp

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, x string, runs int, term string, best double, y int, df long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names the operators use inside."""
    r = random.Random(9)
    texts = [None, "", " \n\t ", "one", "a " * 9, "A b " * 20, "ñ Ñ É é" * 3, "é" * 40, "x y z \x0b\x1f q", " ".join(f"v{r.randrange(60)}" for _ in range(20000)), "la la la la la la !!! LA LA LA LA LA LA", "x" * 200_000]
    rows = [(k % 11 if k < 30 else None, t, [None, "en", "en", "de"][k % 4], [None, "s", "", "t"][k // 4 % 4]) for k, t in enumerate(texts * 8)]
    return spark.createDataFrame([(*row, 1, "i", "x", 3, "t", 0.5, 1, 2) for row in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# ---------------------------------------------------------------- periodic runs


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        j = 0
        while j + q < len(w):
            if w[j] != w[j + q]:
                j += 1
                continue
            start = j
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - start >= max(6, 4 * q):
                found.setdefault((start, j + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_digest(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_periodic_runs(name, request):
    """The whole query against every period tried at every place."""
    df = request.getfixturevalue(name)
    if name == "odd":
        df = df.where("text is null or length(text) < 1000 or doc_id is null")
    got = periodic_runs.digests(periodic_runs.find_runs(df, prepare=periodic_runs.rewritten))
    assert got.columns[1:] == ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = Counter((None if r[0] is None else int(r[0]), *r[1:]) for r in got.collect())
    short = Counter(brute_digest(i, t) if t is None or len(t) < 60_000 else None for i, t in rows_of(df, "doc_id", "text"))
    short.pop(None, None)
    assert not short - got and got.total() == df.count()


def found_in(texts):
    lens = np.array([len(t) for t in texts], np.int64)
    starts, codes = np.cumsum(lens) - lens, {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for t in texts for w in t), np.int64, lens.sum())
    doc = np.repeat(np.arange(len(texts)), lens)
    blocks = periodic_runs.candidates(doc * max(len(codes), 1) + ids, doc, starts)
    return [periodic_runs.runs_of(ids[s : s + n], [(b, a - int(s)) for b, a in blocks[k]]) if k in blocks else [] for k, (s, n) in enumerate(zip(starts, lens))]


def test_runs_of_nested_periods():
    """Few letters, runs inside runs, periods that almost divide each other."""
    r, texts = random.Random(2), []
    for _ in range(1500):
        base = [0] * r.randrange(1, 12) + [1] + [r.randrange(3) for _ in range(r.randrange(5))]
        word = (base * r.randrange(1, 9) + [r.randrange(2) for _ in range(r.randrange(6))]) * r.randrange(1, 6)
        texts.append(word[r.randrange(3) :])
    assert found_in(texts) == [brute_runs(t) for t in texts]


@pytest.mark.parametrize("word, n_runs", [([0] * 30_000, 1), ([0, 1] * 15_000, 1), (([0] * 100 + [1]) * 200, 201), (([0] * 4000 + [1]) * 5, 6)])
def test_long_runs_stay_cheap(word, n_runs):
    assert len(found_in([word])[0]) == n_runs


# ---------------------------------------------------------------- source divergence


def brute_divergence(rows, least):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in d[2])
        kept = [t for t, n in df.items() if n >= least]
        counts = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, c in mine:
            counts[s].update({t: c[t] for t in kept if c[t]})
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: p_of(c) for s, c in counts.items()}, p_of(sum(counts.values(), Counter()))
        for s in counts:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s)
            terms = sorted((q[t] - p[s][t], t) for t in kept if counts[s][t] and p[s][t] > q[t])
            out |= {(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(pairs, 1)} | {(lang, s, "term", t, -v, k) for k, (v, t) in enumerate(terms[:50], 1)}
    return out


@pytest.mark.parametrize("name, least", [("docs", 30), ("odd", 3), ("odd", 1000), ("none", 30)])
@pytest.mark.parametrize("limits", [{}, {"tokens": 500, "cells": 7}])
def test_divergence(name, least, limits, request):
    """Against brute force; with short stretches and small matrices, too."""
    df = request.getfixturevalue(name)
    got = [tuple(r) for r in source_divergence.divergence(df, least=least, **limits).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(rows_of(df, "lang", "source", "text"), least)


def test_shares_beyond_64_bits():
    counts = [0, 7, 10**10, 9 * 10**12]
    want = [1 + 10**9 * (c + 5) // (10**13 + 5 * 12345) for c in counts]
    assert source_divergence.shares(np.array(counts), 10**13, 12345).tolist() == want


def test_leading_terms_with_ties():
    r, top, held = random.Random(4), source_divergence.Leaders(), defaultdict(list)
    for k in range(20):
        rows = [(r.randrange(3), r.randrange(4), f"t{k}-{j}") for j in range(60)]
        top.add(*(np.array(x, kind) for x, kind in zip(zip(*rows), (np.int64, np.int64, object))))
        for s, v, t in rows:
            held[s].append((-v, t))
    want = [(s, -v, t) for s in sorted(held) for v, t in sorted(held[s])[:50]]
    assert list(zip(top.source.tolist(), top.value.tolist(), top.term.tolist())) == want


# ---------------------------------------------------------------- quality


def test_quality_held_out(spark):
    """Labels that are not learnt from are met; nothing but the text decides."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_quality_classifier"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_quality_density_is_that_of_a_dense_solve():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 4)) @ r.normal(size=(4, 4))
    sums = quality.Sums(500, x.sum(axis=0), x.T @ x)
    both = np.eye(4)
    made = quality.shrunk(sums, both, 0.3, 0.1)
    c = 0.7 * np.cov(x.T, bias=True) + 0.3 * both
    c = 0.9 * c + (0.1 * np.trace(c) / 4 + 1e-9) * np.eye(4)
    far = x[:20] - x.mean(axis=0)
    want = -0.5 * np.einsum("ij,jk,ik->i", far, np.linalg.inv(c), far) - 0.5 * np.linalg.slogdet(c)[1]
    assert np.allclose(made.log_density(x[:20]), want)


def test_quality_sums_are_those_of_all_rows(spark, docs):
    """The distributed fit equals one over all rows at once."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~quality.held_out())
    rows = common.materialize(quality.described(docs), "x")
    model = quality.fit(rows, labels)
    y = {str(r["doc_id"]): r["quality"] for r in labels.collect()}
    held = [(y[r["id"]], np.frombuffer(r["x"])) for r in rows.collect() if r["id"] in y]
    x, label = np.array([v for _, v in held]), np.array([k for k, _ in held])
    assert np.allclose(model.centre, x.mean(axis=0)) and np.allclose(model.good.mean, model.scaled(x)[label == 1].mean(axis=0))
    z = [model.scaled(x)[label == k] for k in (1, 0)]
    cov = [np.cov(v.T, bias=True) for v in z]
    both = sum(len(v) * c for v, c in zip(z, cov)) / len(x)
    a, b, _ = model.chosen
    c = (1 - a) * cov[0] + a * both
    c = (1 - b) * c + (b * np.trace(c) / len(c) + 1e-9) * np.eye(len(c))
    assert np.allclose(model.good.whitener.T @ model.good.whitener, np.linalg.inv(c), rtol=1e-4, atol=1e-6)


def test_quality_of_odd_rows(spark, odd, none):
    rows = quality.described(odd)
    assert rows.count() == odd.count() and quality.described(none).count() == 0
    labels = spark.createDataFrame([(k, k % 2, "n") for k in range(11)] + [(1, 0, "n"), (None, 1, "n"), (2, None, "n")], "doc_id long, quality int, id string")
    scores = [r["score"] for r in quality.score(rows, quality.fit(rows, labels)).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    flat = lambda ls: {round(r["score"], 6) for r in quality.score(rows, quality.fit(rows, ls)).collect()}
    assert flat(labels.limit(0)) == {0.5} and flat(labels.where("quality = 1")) == {1.0}


# ---------------------------------------------------------------- media of any length, the shared folder


@pytest.mark.parametrize("size", [1_100_000, 3_000_000])
def test_media_of_long_texts(spark, size):
    """A passage that stands again more than 2**20 bytes later, and payloads of several images."""
    r = random.Random(size)
    passage = "a passage that stands at both ends of a very long text, word by word; "
    text = passage + "".join(r.choice(["lorem ", "ipsum ", "dolor ", "sit ", "\n", "é"]) for _ in range(size // 5))[:size] + passage
    row = media.digests(media.store(spark.createDataFrame([(1, text, "m")], "doc_id long, text string, media string"))).first()
    payload = media.padded(text.encode())
    assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"]) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest())


def test_copies_stay_within_reach():
    """One image taller than the farthest distance is right as well."""
    r = np.random.default_rng(1)
    x = r.integers(0, 255, 576 * 1900, np.uint8)
    x[-4000:] = x[:4000]
    assert max((d for _, _, d in webp.back_references(x)), default=0) <= webp.FAREST
    width, height, pixels = webp.decode(webp.encode_grey(x.reshape(-1, 576)))
    assert ((pixels >> 8 & 255).astype(np.uint8) == x).all()


def test_damaged_media_are_noticed(spark):
    stored = media.store(spark.createDataFrame([(1, "some text")], "doc_id long, text string"))
    other = media.store_payload(media.padded(b"other text"))
    with pytest.raises(Exception, match="other bytes than were stored"):
        media.digests(stored.withColumn("media", F.lit(bytearray(other)))).collect()


def test_shared_folder_without_a_setting(spark):
    """The library makes a folder of its own in local mode and sets nothing."""
    before = spark.conf.get("spark.checkpoint.dir", None)
    path = common.shared_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir", None) == before
    assert common.shared_dir(spark) == path and (before or path.startswith("file:///"))


@pytest.mark.parametrize("n", [0, 1, 2, 999])
def test_packed_keys_come_back(n):
    keys = np.sort(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    assert (common.unpacked(common.packed(keys) + b"what follows", n) == keys).all()
