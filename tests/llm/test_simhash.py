import numpy as np
import pytest
import xxhash

from gridcells.llm import simhash as S

SAMPLE = "/root/testdata/sf0.001"


def brute_fp(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split(" ") if text else []
    w = __import__("re").findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, threshold=4):
    least = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin(fps[i] ^ fps[j]).count("1") <= threshold and least[j] < least[i]:
                    least[i], changed = least[j], True
    return least


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()
    rows = {r["doc_id"]: r for r in S.op7_simhash_anchors(spark, SAMPLE).collect()}
    fps = [brute_fp(d["text"]) for d in docs]
    ids = [d["doc_id"] for d in docs]
    assert [rows[i]["fingerprint"] for i in ids] == [f"{x:016x}" for x in fps]
    assert [rows[i]["component_id"] for i in ids] == brute_components(ids, fps)


def planted(rng, n=60):
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    out = list(map(int, base))
    for x in base[: n // 2]:  # chains of small steps
        x = int(x)
        for _ in range(4):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    return out + [0, 0, 2**64 - 1]


@pytest.mark.parametrize("n_like,hot", [(10, 20_000), (1 << 25, 20_000), (1 << 30, 20_000), (10, 3)])
def test_codes_lose_no_link(spark, n_like, hot):
    fps = planted(np.random.default_rng(5))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(i, 1000 - i, f) for i, f in enumerate(signed)], "row_id long, doc_id long, fp long")
    if n_like > 1 << 27:
        df = df.limit(100)  # each row has hundreds of anchors
        fps = fps[:100]
    got = {r["fp"]: r["component_id"] for r in S.components(df, blocks=S.covering(n_like), hot_rows=hot).collect()}
    want = brute_components([1000 - i for i in range(len(fps))], fps)
    assert [got[f] for f in signed[: len(fps)]] == want


@pytest.mark.parametrize("block", [S.golay(23, 1), S.hamming(46, 18, 4, 1), S.hamming(0, 22, 4, 1), S.hamming(32, 32, 5, 2)])
def test_home_anchor_reaches_all_within_t(block):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(block.width, block.t, replace=False):
            y[i] ^= np.uint64(1 << (block.shift + int(b)))
    row, anchor, home = S.anchors(x, block)
    homes = dict(zip(row[home].tolist(), anchor[home].tolist()))
    assert len(homes) == len(x)
    row, anchor, _ = S.anchors(y, block)
    reached = set(zip(row.tolist(), anchor.tolist()))
    assert all((i, homes[i]) in reached for i in range(len(x)))


def test_odd_rows_and_empty(odd_docs, no_docs):
    rows = S.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (0, 1, 2, 3)} == {"0" * 16}
    assert S.near_duplicates(no_docs).collect() == []
    assert S.keep_one(no_docs).collect() == []


def test_keep_one(spark, tmp_path, make_docs):
    text = "one two three four five six seven eight nine ten " * 5
    make_docs([(5, text), (3, text), (3, text), (9, "quite another text with other words in it"), (None, text)]).write.parquet(str(tmp_path / "d"))
    kept = S.keep_one(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 9]


def test_very_long_text_and_ties(make_docs):
    texts = ["w " * 1_000_000, "x" * 3_000_000, "w w w w", "\n" * 2_000_000, None]
    rows = S.near_duplicates(make_docs(texts)).orderBy("doc_id").collect()
    assert [int(r["fingerprint"], 16) for r in rows] == [brute_fp(t) if t != texts[0] else brute_fp("w w w w") for t in texts]
    assert [r["component_id"] for r in rows] == [0, 1, 0, 3, 3]


def test_keep_one_numbers_rows_once(make_docs):
    rows = [(7, "same words in this text"), (7, "same words in this text"), (3, "other words in that text here"), (None, None)]
    docs = make_docs(rows).selectExpr("*", "'r' AS row", "'i' AS row_id", "'k' AS _keeper")
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["row"], r["row_id"], r["_keeper"]) for r in kept.collect()) == [(0, "r", "i", "k"), (3, "r", "i", "k"), (7, "r", "i", "k")]
