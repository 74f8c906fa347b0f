import random
import re

from gridcells.llm import decontam as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def brute(texts, items, window):
    out = []
    pats = {i: {tuple(w[j : j + window]) for j in range(max(1, len(w) - window + 1))} - {()} for i, t in items for w in [WORD.findall(lower(t))]}
    for t in texts:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for i, ps in pats.items():
            for p in ps:
                for j in range(len(w) - len(p) + 1):
                    if tuple(w[j : j + len(p)]) == p:
                        hit |= set(range(j, j + len(p)))
                        found.add(i)
        out.append((len(w), len(hit), sorted(found)))
    return out


ITEMS = [(3, "One two THREE four five"), (11, "four five"), (5, "é x"), (7, "..."), (8, None), (9, "a b a b a b")]
TEXTS = ["zero One, two-three FOUR five six", "É x and é  X!", "a b a b a b a b", None, "", "onetwo three four", "four five " * 500, "𝒳𝒳 é--x", "three four five one two three"]


def test_against_brute_force(make_docs, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for window in (1, 2, 3, 4, 7, 10):
        for group_words in (1 << 20, 5):  # one automaton, or several
            rows = D.scan(make_docs(TEXTS), items, window, group_words).orderBy("doc_id").collect()
            want = brute(TEXTS, ITEMS, window)
            assert [(r["n_words"], r["n_hit"], r["item_ids"], r["n_items"]) for r in rows] == [(n, h, sorted(map(str, f)), len(f)) for n, h, f in want]
            for r in rows:
                for a, b in r["spans"]:
                    assert WORD.fullmatch(lower(r["text"][a])) and WORD.fullmatch(lower(r["text"][b - 1]))
                assert sum(len(WORD.findall(lower(r["text"][a:b]))) for a, b in r["spans"]) == r["n_hit"]


def test_random_texts(make_docs, spark):
    """Few distinct words, so that windows overlap, repeat and touch."""
    rng = random.Random(4)
    draw = lambda n: " ".join(rng.choices("abcd", [5, 3, 1, 1], k=n))
    items = [(i, draw(rng.choice([1, 2, 5, 6, 9, 30]))) for i in range(25)] + [(3, draw(8)), (30, draw(40))]
    texts = [draw(rng.choice([0, 3, 6, 40, 200])) for _ in range(40)]
    by_id = {}
    for i, t in items:
        by_id.setdefault(i, []).append(t)
    for window in (3, 6, 10):
        rows = D.scan(make_docs(texts), spark.createDataFrame(items, "item_id long, text string"), window, 60).orderBy("doc_id").collect()
        each = brute(texts, list(enumerate(t for _, t in items)), window)
        for r, (n, hit, found) in zip(rows, each):
            assert (r["n_words"], r["n_hit"], set(r["item_ids"])) == (n, hit, {str(items[k][0]) for k in found})


def test_pieces_of_long_items(make_docs, spark):
    w = [f"w{i}" for i in range(300)]
    items = spark.createDataFrame([("long", " ".join(w))], "item_id string, text string")
    assert D.pieces(items, 10, 25).count() > 5
    texts = [" ".join(w[i : i + 10]) for i in range(291)] + [" ".join(w[i : i + 9]) for i in range(291)]
    keep = D.PIECE_WORDS
    D.pieces.__defaults__ = (25,)
    try:
        rows = D.scan(make_docs(texts), items, 10, 100).orderBy("doc_id").collect()
    finally:
        D.pieces.__defaults__ = (keep,)
    assert [r["n_hit"] for r in rows] == [10] * 291 + [0] * 291 and {i for r in rows for i in r["item_ids"]} == {"long"}


def test_string_and_null_ids(make_docs, spark):
    items = spark.createDataFrame([("q-1", "alpha beta"), (None, "beta gamma"), ("q-1", "delta"), (None, "delta")], "item_id string, text string")
    texts = ["alpha beta gamma", "delta", "nothing"]
    rows = D.scan(make_docs(texts), items, 2).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["n_items"], r["item_ids"]) for r in rows] == [(3, 2, ["q-1"]), (1, 2, ["q-1"]), (0, 0, [])]
    assert rows[0]["spans"] == [[0, 16]]


def test_one_pass_for_a_large_benchmark(make_docs, spark):
    """Many automata still are one Python step of the plan."""
    items = spark.range(2000).selectExpr("id AS item_id", "concat_ws(' ', transform(sequence(0, 59), j -> concat('w', pmod(hash(id, j), 5000)))) AS text")
    one = items.where("item_id = 7").first()["text"].split()
    texts = [" ".join(one[5:17]), " ".join(one[5:14]), "w1 w2 " * 100_000]
    found = D.scan(make_docs(texts), items, 10, 10_000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("PythonMapInArrow") <= 2 and plan.count("EvalPython") == 0
    assert [(r["n_hit"], r["item_ids"]) for r in found.orderBy("doc_id").collect()] == [(12, ["7"]), (0, []), (0, [])]


def test_very_long_text(make_docs, spark):
    items = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    texts = ["é " * 1_000_000 + "One, two THREE", "x" * 3_000_000, " " * 3_000_000]
    rows = D.scan(make_docs(texts), items).orderBy("doc_id").collect()
    assert [r["spans"] for r in rows] == [[[2_000_000, 2_000_014]], [], []]


def test_odd_rows_and_empty(odd_docs, no_docs, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = D.scan(odd_docs.withColumn("hits", odd_docs["doc_id"]), items)
    assert out.count() == odd_docs.count() and "pos" in out.columns
    assert D.scan(no_docs, items).collect() == []
    assert {len(r["hits"]) for r in D.scan(odd_docs, items.limit(0)).collect()} == {0}


def test_repeated_words(make_docs, spark):
    """A long item and a long text of one word, or of one phrase, again and again."""
    phrase = " ".join(f"w{k}" for k in range(10))
    items = spark.createDataFrame([("a", "a " * 10_000), ("p", f"{phrase} " * 1_000), ("z", "a " * 30)], "item_id string, text string")
    texts = ["a " * 1_000_000, f"{phrase} " * 100_000, "b " + "a " * 9 + "b", "a " * 2_000 + "b " + "a " * 12]
    rows = D.scan(make_docs(texts), items).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["item_ids"]) for r in rows] == [(1_000_000, ["a", "z"]), (1_000_000, ["p"]), (0, []), (2_012, ["a", "z"])]
    assert [tuple(h) for h in rows[0]["hits"]] == [("a", 0, 1_000_000), ("z", 0, 1_000_000)] and len(rows[3]["hits"]) == 4
    group = D.Group([("a", "a " * 10_000)], 10)
    assert len(group.at) < 20


def test_remembered_hits_are_forgotten(make_docs, spark, monkeypatch):
    monkeypatch.setattr(D, "KNOWN", 2)
    rng = random.Random(11)
    text = " ".join(rng.choices("ab", k=400))
    items = [(0, " ".join(rng.choices("ab", k=60)))]
    group = D.Group([("0", items[0][1])], 6)
    (n, hit, _), = brute([text], items, 6)
    assert sum(b - a for _, a, b in D.merged([("", a, b) for _, a, b in group.hits(D.words(text.encode()))])) == hit
