import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridcells.llm import periodic as P


def brute(words, min_length):
    """All runs from the maximal stretches of equal words at each distance; multiples
    of the smallest period give the same stretch."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(min_length, 2 * q) and i > start:
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def texts(rng, count):
    for _ in range(count):
        k, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(70)
        words = [str(rng.randrange(k)) for _ in range(n)]
        if n > 4 and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randrange(1, 12)
            for i in range(a, n):
                words[i] = words[min(n - 1, a + (i - a) % p)]
        yield words


@pytest.mark.parametrize("min_length", [2, 3, 7, 12])
def test_runs_against_brute_force(min_length):
    rng = random.Random(min_length)
    many = [[w.encode() for w in t] for t in texts(rng, 600)]
    for words, marked in zip(many, P.recurring_words(many, min_length // 2), strict=True):
        assert P.runs_of(words, marked, min_length) == brute(words, min_length)


def test_fibonacci_words_have_many_runs():
    x, y = b"a", b"ab"
    while len(y) < 600:
        x, y = y, y + x
    words = [bytes([c]) for c in y]
    assert P.runs_of(words, P.recurring_words([words], 1)[0], 2) == brute(words, 2)


def test_frame_against_brute_force(make_docs):
    rng = random.Random(5)
    rows = [" ".join(t) for t in texts(rng, 150)] + ["\tA  A\nA\x0bA\x0cA\rA A A A A A A ", "É É É É É É É É É É É É É"]
    for r in P.find_runs(make_docs(rows)).collect():
        words = [w for w in re.split("[\x20\x09-\x0d]+", r["text"]) if w]
        runs = brute(words, 12)
        assert (r["n_words"], [tuple(x) for x in r["runs"]]) == (len(words), runs)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_odd_rows_and_columns(odd_docs, no_docs):
    docs = odd_docs.selectExpr("*", "'old' AS runs", "'s' AS start", "'w' AS words")
    out = P.find_runs(docs)
    assert out.columns == [*(c for c in docs.columns if c != "runs"), *P.ADDED]
    got = out.collect()
    assert len(got) == docs.count() and all((r["start"], r["words"]) == ("s", "w") for r in got)
    of = {r["text"]: r for r in got}
    assert (of[None]["n_words"], of[None]["runs"], of[None]["collapsed"]) == (0, [], "")
    assert [tuple(x) for x in of["word " * 3000]["runs"]] == [(0, 3000, 1)] and of["word " * 3000]["collapsed"] == "word"
    assert P.find_runs(no_docs).count() == 0


def test_planted_words(spark, make_docs):
    rng = random.Random(9)
    rows = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(rng.randrange(60)))) for i in range(400)] + [(None, "a b c"), (3, None)]
    got = make_docs(rows).select("doc_id", "text", P.planted(F.col("doc_id"), F.col("text")).alias("new")).collect()
    seen = 0
    for r in got:
        h = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode())
        g, words = h // 10, (r["text"] or "").split()
        if h % 10 == 0 and words:
            n, a = len(words), g % len(words)
            p = 1 + (n - a) // (3 + g % 8)
            assert r["new"].split() == [words[i if i < a else a + (i - a) % p] for i in range(n)]
            seen += 1
        else:
            assert (r["new"] or "").split() == words
    assert seen > 20


def test_very_long_text(make_docs):
    """A million equal words, and a long period, take time linear in the words."""
    block = " ".join(map(str, range(40_000)))
    equal, periodic = P.find_runs(make_docs(["x " * 1_000_000, f"{block} {block} {block} end"])).orderBy("doc_id").select("runs", "collapsed").collect()
    assert [tuple(x) for x in equal["runs"]] == [(0, 1_000_000, 1)] and equal["collapsed"] == "x"
    assert [tuple(x) for x in periodic["runs"]] == [(0, 120_000, 40_000)] and periodic["collapsed"] == f"{block} end"
