import hashlib
from collections import Counter

import numpy as np

from gridcells.llm import linededup as L

SPACES = " \t\n\x0b\x0c\r"


def brute(texts, min_docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = [[x.strip(SPACES).translate(lower) for x in (t or "").split("\n")] for t in texts]
    seen = Counter(k for ks in keys for k in set(ks))
    out = []
    for t, ks in zip(texts, keys):
        kept = [x for x, k in zip((t or "").split("\n"), ks) if not k or seen[k] < min_docs]
        out.append((len(ks), len(ks) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r["n_lines"], r["n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in df.collect())


TEXTS = [f"Header \n{i % 7}\nunique {i}\n\n  HEADER\t\nÉ" for i in range(40)] + ["é", "", None, "header", "x\n" * 2000]


def test_against_brute_force(make_docs, monkeypatch):
    docs = make_docs(TEXTS)
    for hot_keys, shard_keys in ((L.HOT_KEYS, L.SHARD_KEYS), (20, 1), (1, 3)):  # all keys hot; some; none
        monkeypatch.setattr(L, "HOT_KEYS", hot_keys)
        monkeypatch.setattr(L, "SHARD_KEYS", shard_keys)
        for min_docs in (2, 6, 10):
            index = L.build_index(docs, min_docs)
            assert rows_of(L.dedup_lines(docs, index)) == brute(TEXTS, min_docs)


def test_own_columns_stay(make_docs, monkeypatch):
    """Names that the operator uses itself, in either way to a filter."""
    docs = make_docs(TEXTS).selectExpr("*", "doc_id AS row", "'g' AS gone", "'h' AS _row", "1 AS key", "2 AS shard", "'old' AS n_lines")
    for hot_keys in (L.HOT_KEYS, 1):
        monkeypatch.setattr(L, "HOT_KEYS", hot_keys)
        out = L.dedup_lines(docs, L.build_index(docs, 6))
        assert out.columns == [*docs.columns[:-1], "n_lines", "n_dropped"]
        assert rows_of(out) == brute(TEXTS, 6)
        assert all(r["row"] == r["doc_id"] and (r["gone"], r["_row"], r["key"], r["shard"]) == ("g", "h", 1, 2) for r in out.collect())


def test_shards_follow_insertions(make_docs, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 2)
    texts = [f"common {j}" for i in range(6) for j in range(60)]
    index = L.build_index(make_docs(texts[:4]), 5)
    grown = L.insert_documents(index, make_docs(texts))
    assert grown.n_shards >= 30 > index.n_shards
    assert rows_of(L.dedup_lines(make_docs(texts), grown)) == brute(texts, 5)


def test_very_long_text(make_docs):
    texts = ["\n" * 2_000_000 + "x", "y" * 3_000_000, *["y" * 3_000_000 + "\nz"] * 2, "\n".join(str(i) for i in range(300_000))]
    docs = make_docs(texts)
    assert rows_of(L.dedup_lines(docs, L.build_index(docs, 3))) == brute(texts, 3)


def test_odd_rows_and_empty(odd_docs, no_docs):
    out = L.dedup_lines(odd_docs, L.build_index(odd_docs, 2))
    assert out.count() == odd_docs.count() and "shard" in out.columns
    texts = [r["text"] for r in odd_docs.collect()]
    assert rows_of(out) == brute(texts, 2)
    assert L.dedup_lines(no_docs, L.build_index(no_docs)).collect() == []


def test_insert_then_delete_restores(make_docs):
    a, b = make_docs(TEXTS[:25]), make_docs(TEXTS[20:])
    start = L.build_index(a, 5)
    both = L.insert_documents(start, b)
    back = L.delete_documents(both, b)
    table = lambda i: sorted(map(tuple, i.refs.select("key", "n_docs").collect()))
    held = lambda i: sorted(tuple(k) for r in i.filters.collect() for k in L.CuckooFilter.load(r["prints"], r["keys"]).all_keys().tolist())
    assert table(back) == table(start) and held(back) == held(start) and held(both) != held(start)
    whole = L.build_index(make_docs(TEXTS[:25] + TEXTS[20:]), 5)
    assert table(whole) == table(both) and held(whole) == held(both)


def test_filter_grows_and_deletes():
    keys = np.random.default_rng(1).integers(0, 2**64, (3000, 2), dtype=np.uint64)
    f = L.CuckooFilter(8)
    for k in keys:
        f.insert(k)
    assert f.contains(keys).all() and len(f.all_keys()) == 3000
    at_once = L.CuckooFilter.of(keys)
    assert at_once.contains(keys).all() and len(at_once.all_keys()) == 3000
    assert L.CuckooFilter.of(keys[:0]).contains(keys).sum() == 0
    for k in keys[:1500]:
        assert f.delete(k)
    assert not f.contains(keys[:1500]).any() and f.contains(keys[1500:]).all()
