import random
import zlib

import numpy as np

from gridcells.llm import toxicity as X

SAMPLE = "/root/testdata/sf0.01"


def made(spark, make_docs, n=400):
    rng = random.Random(1)
    words = "the of and river stone walking green tomorrow house window paper".split()
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randrange(20, 200))
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(["idiot", "moron", "worthless"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    return make_docs(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_and_misspellings(spark, make_docs):
    docs, labels = made(spark, make_docs)
    model = X.train(docs, labels)
    rows = X.score(docs, model).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.95
    plain = [[r["plain_score"] for r in held if (r["doc_id"] % 4 == 0) == toxic] for toxic in (True, False)]
    assert sum(a > b for a in plain[0] for b in plain[1]) > 0.95 * len(plain[0]) * len(plain[1])  # its order; 0.5 is no good border after 80 steps
    clean = "the river and the stone walking green " * 5
    assert model.score((clean + "idiots worthles morron " + clean).encode()) > model.score((clean + "window paper house " + clean).encode())


def test_query(spark):
    rows = X.op9_toxicity_subwords(spark, SAMPLE).collect()
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SAMPLE}/labels.parquet").collect()}
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    plain = [(r["plain_score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    for scored in (held, plain):
        good, bad = [s for s, y in scored if y], [s for s, y in scored if not y]
        assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.8


def slow_logits(text, weights, bias):
    """Window by window and n-gram by n-gram."""
    space = set(b" \t\n\v\f\r")
    b = [32 if x in space else x for x in b" " + text.lower() + b"    "]
    windows, every = [], []
    for low in range(0, len(b) - 4, X.WINDOW):
        own = []
        for at in range(low, min(low + X.WINDOW, len(b) - 4)):
            mixed = (b[at] * 0x9E3779B1 % 2**32 ^ b[at + 1]) * 0x85EBCA6B % 2**32
            for order in X.ORDERS:
                mixed = (mixed ^ (b[at + order - 1] + order)) * 0xC2B2AE35 % 2**32
                if all(x != 32 for x in b[at + 1 : at + order - 1]):
                    own.append(weights[mixed >> (32 - X.BITS)].astype(float))
        every += own
        if own:
            windows.append(sum(own)[0] / len(own))
    if not windows:
        return tuple(bias)
    return bias[0] + np.log(np.mean(np.exp(windows))), bias[1] + sum(every)[1] / len(every)


def test_query_scores_against_slow_scoring(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = X.train(docs.repartition(8).select("doc_id", "text"), spark.read.parquet(f"{small}/labels.parquet"))
    rows = {r["doc_id"]: r for r in X.op9_toxicity_subwords(spark, small).collect()}
    for d in docs.limit(60).collect():
        pooled, mean = slow_logits((d["text"] or "").encode(), model.weights, model.bias)
        r = rows[d["doc_id"]]
        assert abs(r["score"] - 1 / (1 + np.exp(-pooled))) < 1e-5 and abs(r["plain_score"] - 1 / (1 + np.exp(-mean))) < 1e-5


def test_chunks_change_nothing():
    rng = np.random.default_rng(1)
    bias = np.array([0.3, -0.2])
    model = X.Model(rng.standard_normal((X.NONE + 1, 2)).astype("<f4") * (np.arange(X.NONE + 1) < X.NONE)[:, None], bias)
    text = b"some words of a text\n" * 40
    whole, keep = model.logits(text), X.CHUNK
    for X.CHUNK in (16, 48, 160):
        assert np.allclose(model.logits(text), whole)
    X.CHUNK = keep
    assert np.allclose(whole, slow_logits(text, model.weights, bias))


def test_sample_is_bounded(spark, make_docs, monkeypatch):
    monkeypatch.setattr(X, "SAMPLE_BYTES", 3000)
    monkeypatch.setattr(X, "TEXT_BYTES", 1000)
    docs = make_docs([(1, "a copy of one text")] * 500 + [(i, "x" * (i * 7 % 1400)) for i in range(2, 200)])
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(200)] * 2, "doc_id long, toxic int")
    rows = X._sampled(docs, labels, 2500).collect()
    for c in (0, 1):
        own = [r["text"] for r in rows if r["toxic"] == c]
        assert 0 < sum(map(len, own)) <= 3000 and max(map(len, own)) <= 1000
    assert sum(r["text"].startswith("a copy") for r in rows) <= 1


def test_very_long_text(spark, make_docs):
    docs, labels = made(spark, make_docs, 100)
    model = X.train(docs, labels)
    texts = ["the river and " * 250_000, "y" * 3_000_000, " " * 3_000_000]
    rows = X.score(make_docs(texts), model).orderBy("doc_id").collect()
    assert rows[0]["predicted"] == 0 and abs(rows[2]["score"] - X._chance(model.bias[0])) < 1e-12 and abs(rows[2]["plain_score"] - X._chance(model.bias[1])) < 1e-12


def test_odd_rows_and_empty(spark, odd_docs, no_docs, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = X.score(odd_docs, X.train(odd_docs, none)).collect()
    assert len(out) == odd_docs.count() and {r["predicted"] for r in out} == {0} and "shard" in out[0].asDict()
    model = X.train(*made(spark, make_docs, 40))
    assert X.score(no_docs, model).collect() == []
    assert all(0 <= r["score"] <= 1 and 0 <= r["plain_score"] <= 1 for r in X.score(odd_docs, model).collect())
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int")
    assert {r["predicted"] for r in X.score(odd_docs, X.train(odd_docs, one)).collect()} == {1}
