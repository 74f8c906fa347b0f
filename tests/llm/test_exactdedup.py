import hashlib
import re
from collections import defaultdict

import pytest

from gridcells.llm import exactdedup as E
from tests.llm.conftest import ODD


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def brute(rows):
    """(doc_id, sha, keep_id, group_size) of every row, and the ids kept."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[norm(text)].append(i)
    least = {t: min((i is None, i or 0) for i in ids) for t, ids in groups.items()}
    name = lambda t: None if least[t][0] else least[t][1]
    full = sorted(((i, hashlib.sha256(norm(t).encode()).hexdigest(), name(norm(t)), len(groups[norm(t)])) for i, t in rows), key=str)
    return full, sorted((name(t) for t in groups), key=str)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def check(out, rows):
    got = out.collect()
    full, kept = brute(rows)
    assert sorted(((r["doc_id"], r["text_sha256"], r["keep_id"], r["group_size"]) for r in got), key=str) == full
    assert sorted((r["doc_id"] for r in got if r["kept"]), key=str) == kept


TEXTS = ["a b", "a  b", "a\tb\n", " a b", "a b ", "A b", "a b", "ab", "", None, " ", "\n", "x y", "x y"]


@pytest.mark.parametrize("hot", [1000, 3, 1])
def test_against_brute_force(spark, make_docs, monkeypatch, hot):
    monkeypatch.setattr(E, "HOT_GROUPS", hot)
    docs = make_docs([(7 * k % 31, t) for k, t in enumerate(TEXTS * 2)])
    check(E.dedup(docs, E.create_index(spark, 3)), pairs(docs))


def test_odd_rows_and_columns(spark, odd_docs, no_docs):
    docs = odd_docs.selectExpr("*", "'old' AS kept", "'p' AS place", "'d' AS digest")
    out = E.dedup(docs, E.create_index(spark, 2))
    assert out.columns == [*(c for c in docs.columns if c != "kept"), *E.ADDED]
    assert all((r["place"], r["digest"], r["key"]) == ("p", "d", "x") for r in out.collect())
    check(out, pairs(odd_docs))
    assert len(ODD) == out.count()
    assert E.dedup(no_docs, E.create_index(spark, 2)).count() == 0


def test_later_batches_and_a_reopened_index(spark, make_docs, tmp_path):
    path = "file://" + str(tmp_path / "index")
    first = E.dedup(make_docs([(5, "one"), (6, "two"), (7, "one ")]), E.create_index(spark, 3, path))
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in first.collect()) == [(5, 5, True), (6, 6, True), (7, 7, True)]
    again = E.create_index(spark, 3, path)
    second = E.dedup(make_docs([(1, "one"), (2, "three"), (3, "three"), (4, "two")]), again)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in second.collect()) == [(1, 5, 1, False), (2, 2, 2, True), (3, 2, 2, False), (4, 6, 1, False)]
    rows = again.rows().collect()
    assert len(rows) == 4 and len({bytes(r["digest"]) for r in rows}) == 4
    # the same batch once more brings nothing
    E.add_batch(again, E.digests(make_docs([(9, "three"), (8, None)][:1])))
    assert again.rows().count() == 4
    # a named batch that is run again, after it was appended, says what it said
    docs = make_docs([(10, "four"), (11, "one")])
    for _ in range(2):
        assert sorted((r["doc_id"], r["kept"]) for r in E.dedup(docs, again, batch="b3").collect()) == [(10, True), (11, False)]


def test_the_index_side_is_not_shuffled(spark, make_docs):
    index = E.create_index(spark)
    rows = E.digests(make_docs(TEXTS))
    E.add_batch(index, rows)
    plan = E.grouped(rows).join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    # the batch is dealt out by digest once, for its own grouping, to the buckets of the index
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("buckets", [3, 5])
def test_a_compacted_index_says_the_same(spark, make_docs, tmp_path, buckets):
    index = E.create_index(spark, 3)
    for k in range(4):
        E.add_batch(index, E.digests(make_docs([(10 * k + i, f"text {(7 * k + i) % 40}") for i in range(10)])), f"b{k}")
    path = "file://" + str(tmp_path / "compacted")
    fresh = E.compacted(index, buckets, path)
    rows = lambda x: sorted((bytes(r["digest"]), r["keep_id"], r["place"], r["batch"]) for r in x.rows().collect())
    assert rows(fresh) == rows(index) and len(rows(index)) > 10
    files = lambda x: len(x.rows().inputFiles())
    assert files(fresh) <= buckets < files(index)
    # it goes on like the old one, also when it is opened again, and knows the batches' names
    docs = make_docs([(100, "text 3"), (101, "text 99")])
    E.add_batch(fresh, E.digests(make_docs(["no news"])), "b2")
    again = E.create_index(spark, buckets, path)
    said = [sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in E.dedup(docs, x).collect()) for x in (again, index)]
    assert said[0] == said[1] == [(100, 3, False), (101, 101, True)]
    assert rows(E.compacted(E.create_index(spark, 2))) == []


def test_query_equals_one_batch(spark):
    """Two arrivals in the order of the ids give what one gives."""
    got = E.op13_exact_dedup(spark, "/root/testdata/sf0.001")
    rows = pairs(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    check(got, rows)
    assert len(E.arrivals(E.digests(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))) == 2


def test_very_long_text(spark, make_docs):
    long = "word \n" * 1_000_000
    docs = make_docs([long, long.replace("\n", ""), long + "x"])
    check(E.dedup(docs, E.create_index(spark, 2)), pairs(docs))
