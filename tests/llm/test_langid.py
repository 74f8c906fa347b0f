import zlib

import numpy as np

from gridcells.llm import langid

SAMPLE = "/root/testdata/sf0.01"


def test_query_held_out_accuracy(spark):
    rows = langid.op3_language_id_ecoc(spark, SAMPLE).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    right = total = 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        d = docs[r["doc_id"]]
        if r["held_out"] and d["lang"] and any(c.isalpha() for c in d["text"] or ""):
            total += 1
            right += r["lang_pred"] == d["lang"]
    assert total > 100 and right / total > 0.98, (right, total)


def test_odd_rows(odd_docs, no_docs, make_docs):
    model = langid.train(make_docs([(i, w * 9, l) for i, (w, l) in enumerate([("the cat and dog ", "en"), ("der hund und die ", "de")] * 20)]))
    out = {i: r for i, r in enumerate(langid.identify(odd_docs, model).collect())}
    assert [out[i]["lang_pred"] for i in (0, 1, 2, 3)] == ["und"] * 4 and out[0]["score"] == 0
    assert out[5]["lang_pred"] in ("en", "de") and "shard" in out[5].asDict() and out[10]["held_out"]
    assert langid.identify(no_docs, model).collect() == []


def test_no_or_one_language(make_docs, no_docs):
    docs = make_docs([(1, "abc"), (2, "1 2")])
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(no_docs)).collect()} == {"und"}
    one = langid.train(make_docs([(i, "abc", "xx") for i in range(10)]))
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(docs, one).collect()] == [("xx", 1.0), ("und", 0.0)]


def test_only_letters_count_as_letters(make_docs):
    train = [(i, w * 9, l) for i, (w, l) in enumerate([("the cat and dog ", "en"), ("der hund und die ", "de")] * 20)]
    model = langid.train(make_docs(train))
    texts = ["½ ² ①", "Ⅷ ⅷ", "１２ 3 ٣", "_ __", "x½", "ª", "漢", "🙂"]
    rows = langid.identify(make_docs(texts), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in rows] == [True] * 4 + [False] * 3 + [True]
    assert [r["score"] for r in rows[:4]] == [0] * 4
    assert langid.train(make_docs([(i, "½ 12", "en") for i in range(20)])).langs == []


def slow_counts(text):
    """n-gram by n-gram."""
    joined = " " + " ".join("".join(c if not c.isascii() or c.isalpha() else " " for c in text.lower()).split(" ")) + " "
    b = b" " + b" ".join(joined.encode().split()) + b" "
    out = np.zeros(langid.DIMS)
    for at in range(len(b)):
        mixed = b[at] * 0x9E3779B1 % 2**32
        for n in range(2, 5):
            if at + n > len(b):
                break
            mixed = (mixed ^ (b[at + n - 1] + n)) * 0x85EBCA6B % 2**32
            out[mixed >> 18] += 1
    return out


def test_query_against_slow_decoding(spark):
    """Every prediction from the trained bits, codeword by codeword."""
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs.repartition(8))
    rows = {r["doc_id"]: r for r in langid.op3_language_id_ecoc(spark, small).collect()}
    for d in docs.collect():
        r = rows[d["doc_id"]]
        if not any(c.isalpha() for c in d["text"] or ""):
            assert r["lang_pred"] == "und"
            continue
        counts = slow_counts(d["text"])
        losses = []
        for word in model.code:
            loss = 0.0
            for k, sign in enumerate(word):
                margin = counts @ model.weights[:, k] / counts.sum() * model.scale[k] + model.shift[k]
                loss += model.trust[k] * np.logaddexp(0, -sign * margin)
            losses.append(loss)
        chances = np.exp(min(losses) - np.array(losses))
        best = int(np.argmin(losses))
        assert r["lang_pred"] == model.langs[best] and abs(r["score"] - chances[best] / chances.sum()) < 1e-3


def test_copies_of_one_row_are_sampled_once(make_docs):
    rows = [(1, "the cat and the dog is here", "en")] * 300 + [(i, f"the hat and dog {i}", "en") for i in range(2, 60)] + [(i, f"der hund und katze {i}", "de") for i in range(100, 160)]
    model = langid.train(make_docs(rows), sample_per_lang=1000)
    assert model.decode(["der hund und die", "the dog and"])[0] == ["de", "en"]


def test_very_long_text(make_docs):
    train = [(i, w * 9, l) for i, (w, l) in enumerate([("the cat and dog ", "en"), ("der hund und die ", "de")] * 20)]
    texts = ["der hund und die " * 200_000, "1 " * 1_000_000, "the cat " * 300_000 + "x"]
    rows = langid.identify(make_docs(texts), langid.train(make_docs(train))).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows] == ["de", "und", "en"]
    keep, langid.CHUNK = langid.CHUNK, 37
    try:
        assert np.array_equal(langid.gram_counts([texts[0][:900], "é"])[0], slow_counts(texts[0][:900]))
    finally:
        langid.CHUNK = keep


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 9, 30):
        code = langid.codebook(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 3
        assert (np.abs(code.sum(0)) < n).all()


def test_ambiguous_mixture_is_flagged(make_docs):
    en, de = "the cat and the dog of that is was ", "der hund und die katze ist das war zu "
    model = langid.train(make_docs([(i, (en if i % 2 else de) * (i % 5 + 1), "en" if i % 2 else "de") for i in range(60)]))
    lang, score, doubt = model.decode([en * 5, de * 5])
    assert lang == ["en", "de"] and not doubt.any()
    mixes = [en * k + de * (12 - k) for k in range(1, 12)]
    assert model.decode(mixes)[1].min() < 0.95
