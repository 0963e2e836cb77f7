"""Each stage of the pipeline, on what its predecessor kept, against brute force."""

import hashlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_components, brute_removed

from scoreweave.llm import common, source_mixing, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as P

    now, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        before, now = now, common.materialize(stage(spark, now, SF), name)
        out.append((before, now))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_toxic_documents_go(spark, stages):
    before, after = stages[0]
    scored = toxicity.score(before, toxicity.learn(spark, before, SF))
    bad = {r["doc_id"] for r in scored.where("score >= 0.5").collect()}
    assert bad and texts(after) == {i: t for i, t in texts(before).items() if i not in bad}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i in texts(before) if labels.get(i) == 0]
    assert sum(i in texts(after) for i in clean) >= 0.97 * len(clean)


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    groups = brute_components([(i, (t or "").encode()) for i, t in texts(before).items()])
    assert texts(after) == {i: t for i, t in texts(before).items() if groups[i][1] == i}


def test_repeats_go(stages):
    before, after = stages[2]
    rows = [(i, (t or "").encode()) for i, t in texts(before).items()]
    want = {i: (n, gone, digest) for i, n, gone, digest in brute_removed(rows)}
    got = texts(after)
    assert got.keys() == want.keys()
    for i, t in rows:
        assert hashlib.sha256(b" ".join(got[i].encode().split())).hexdigest() == want[i][2]
        assert want[i][1] or got[i].encode() == t


def test_sources_are_mixed(stages):
    before, after = stages[3]
    con = duckdb.connect()
    documents = before.toPandas()
    con.register("documents", documents)
    want = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, taken FROM ({source_mixing.OP3_SQL}) WHERE size > 0").fetchall()}
    size = {r["doc_id"]: r["n"] for r in before.select("doc_id", source_mixing.word_count(F.col("text")).alias("n")).collect()}
    times = Counter(r["doc_id"] for r in after.select("doc_id").collect())
    assert {i: times[i] * size[i] for i in want} == want and max(times.values()) <= 3


def test_sequences_hold_the_documents(stages):
    before, after = stages[4]
    rows = after.collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], Counter())[r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    times = Counter(r["doc_id"] for r in before.select("doc_id").collect())
    assert by_doc.keys() == times.keys() and all(n == times[i] for i, pieces in by_doc.items() for n in pieces.values())
    for pieces in by_doc.values():
        ends = sorted((start, length) for _, start, length, _ in pieces)
        assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:])) and all(n == 4096 for _, n in ends[:-1])
    assert len(by_sequence) <= 1.05 * sum(r["length"] for r in rows) / 4096 + 1
