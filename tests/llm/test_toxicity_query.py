"""The whole toxicity query against brute force over the fitted vectors, and odd columns."""

from collections import Counter

import numpy as np

from scoreweave.llm import toxicity

SF = "/root/testdata/sf0.001"


def nearest_by_brute_force(bank_vectors, number_of, asked, without=None):
    """All cosines, without any index: (number, cosine) of the nearest, ties by number."""
    held = {t: w for t, w in zip(asked[0].tolist(), asked[1].tolist())}
    sims = [(sum(held.get(t, 0.0) * w for t, w in zip(ts.tolist(), ws.tolist())), k) for k, (ts, ws) in enumerate(bank_vectors)]
    return sorted(((s, k) for s, k in sims if s > 1e-4), key=lambda x: (-x[0], x[1]))[: toxicity.NEAREST]


def bank_of(bank: toxicity.BlockMax, n_terms: int):
    """The index's vectors, read back from its dense and its sparse part."""
    out = {}
    lines = {line: t for t, line in enumerate(bank.line.tolist()) if line >= 0}
    for place, number in enumerate(bank.order.tolist()):
        column = bank.held[place // toxicity.BLOCK, :, place % toxicity.BLOCK]
        out[number] = {lines[k]: float(w) for k, w in enumerate(column.tolist()) if w}
    number_at = dict(enumerate(bank.order.tolist()))
    for t in range(n_terms):
        if bank.line[t] < 0:
            for at in range(bank.cuts[t], bank.cuts[t + 1]):
                out[number_at[int(bank.places[at])]][t] = float(bank.weights[at])
    return [(np.array(list(v), np.int64), np.array(list(v.values()))) for _, v in sorted(out.items())]


def test_query_is_brute_force_over_its_vectors(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.learn(spark, docs, SF)
    got = {r["doc_id"]: r for r in toxicity.op8_toxicity(spark, SF).collect()}
    assert model.whole is not None and len(got) == docs.count()
    whole, marks = bank_of(model.whole.bank, len(model.whole.keys)), bank_of(model.bank, len(model.idf)) if model.ids else []
    for r in docs.collect():
        words = Counter(toxicity.words_of(r["text"]))
        near = nearest_by_brute_force(whole, None, model.whole.vector(*toxicity.hashed(words)))
        marked = nearest_by_brute_force(marks, None, model.vector(words))
        share = sum(s * model.whole.toxic[k] for s, k in near) / sum(s for s, _ in near) if near else 0.0
        vote = sum(s * model.toxic[k] for s, k in marked) / (sum(s for s, _ in marked) + 1)
        want = float(model.probability(np.array([vote, share])))
        assert abs(got[r["doc_id"]]["score"] - want) < 1e-3
        first = [s for s, _ in near[:5]]
        if len(set(np.round(first, 6))) == len(first) and (len(near) < 6 or near[4][0] - near[5][0] > 1e-5):
            assert got[r["doc_id"]]["evidence"] == [model.whole.ids[k] for _, k in near[:5]]


def test_clashing_columns_and_repeated_ids(spark):
    rows = [(k % 40, f"you are a {'vile brute' if k % 4 == 0 else 'kind soul'} number{k}", 7.0, "mine", "j", "r") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, evidence string, judged string, row string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(40)], "doc_id long, toxic int")
    one, two = (toxicity.score(docs, toxicity.fit(docs, labels)) for _ in range(2))
    assert one.columns == ["doc_id", "text", "judged", "row", "score", "evidence"]
    a, b = ([tuple(r)[:5] for r in x.orderBy("text").collect()] for x in (one, two))
    assert a == b and all(r[2:4] == ("j", "r") and 0 <= r[4] <= 1 for r in a) and len(a) == 80
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).count() == 0
