import corpus_pipeline as P
from gridcells.llm import decontam, langid, linededup, simhash
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute_components, brute_fp

SAMPLE = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = {"language": langid, "line_dedup": linededup, "near_dedup": simhash, "decontaminate": decontam}
    for name, stage in P.STAGES[:-1]:
        assert name in names
        stage(spark, docs, SAMPLE).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language":
            assert len(after) > 0.97 * len(before)
        elif name == "line_dedup":
            keys = {}
            for i, t in before.items():
                for k in {x.strip(" \t\n\x0b\x0c\r").lower() for x in t.split("\n")}:
                    keys.setdefault(k, set()).add(i)
            for i, t in before.items():
                assert after[i] == "\n".join(x for x in t.split("\n") if not x.strip() or len(keys[x.strip(" \t\n\x0b\x0c\r").lower()]) < 10)
        elif name == "near_dedup":
            least = brute_components(list(before), [brute_fp(t) for t in before.values()])
            assert set(after) == set(least)
        else:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SAMPLE}/benchmark.parquet").collect()]
            hits = brute_hits(before.values(), items, 10)
            assert set(after) == {i for i, h in zip(before, hits) if not h[1]} and len(after) < len(before)
        before = after
    rows = P.STAGES[-1][1](spark, docs, SAMPLE).collect()
    check(rows, before, 1024)
    whole = P.run(spark, SAMPLE)
    assert sorted(map(tuple, whole.select(*sorted(whole.columns)).collect())) == sorted(tuple(r[c] for c in sorted(whole.columns)) for r in rows)


def test_stages_keep_odd_rows_and_columns(spark, tmp_path, odd_docs, no_docs):
    for i, docs in enumerate((odd_docs.withColumn("hits", odd_docs.key), no_docs)):
        for name, stage in P.STAGES:
            path = str(tmp_path / f"{name}{i}")
            stage(spark, docs, SAMPLE).write.parquet(path)
            out = spark.read.parquet(path)
            if name != "packing":
                assert out.columns == docs.columns
                assert {r["n_lines"] for r in out.collect()} <= {"x"} if "n_lines" in out.columns else True
                docs = out
