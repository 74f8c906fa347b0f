import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from gridcells.llm import packing

SAMPLE = "/root/testdata/sf0.001"


def check(rows, texts, seq_len):
    """Pieces cover each document once, sequences are gapless, crcs are right."""
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: np.append(encode(t or ""), 0).astype("<u4") for k, t in texts.items()}
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert set(docs) == set(texts)
    for k, pieces in docs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[k])
            assert zlib.crc32(ids[k][at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids[k])
    pad = 0
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= seq_len
        pad += 0 if at & (at - 1) == 0 else seq_len - at
    assert pad == 0


def test_query_round_trip(spark):
    rows = packing.op1_pack_hilbert(spark, SAMPLE).collect()
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()
    check(rows, {r["doc_id"]: r["text"] for r in docs}, 1024)


def test_odd_rows(odd_docs):
    pieces = packing.pack(odd_docs, seq_len=64)
    rows = pieces.collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 7) == 1 + len(packing.encoder()("É é ß 漢字 𝒳")) + 1
    packed = packing.sequences(pieces).collect()
    assert sum(r["length"] for r in packed) == sum(r["length"] for r in rows)
    assert all(len(r["ids"]) == 4 * r["length"] for r in packed)
    assert sum(r["length"] for r in packed if r["length"] == 64) + 63 >= sum(r["length"] for r in rows)


def test_empty(no_docs):
    assert packing.pack(no_docs).collect() == []


def test_rank_file_equals_tokenizer_file():
    a, b = packing.encoder(), packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("Hello  world\n\n it's <|endoftext|> \t x", "Ünïcödé 漢字    123abc!?", "a" * 500, " \n \n"):
        assert list(a(text)) == list(b(text))


SPECIAL = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>  y\n", "<|endoftext| <|ENDOFTEXT|>", "it'<|endoftext|>s", "<|<|endoftext|>|>  "]


def test_added_token_is_one_id_as_in_the_plain_tokenizer(make_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    want = [plain.encode(t, add_special_tokens=False).ids for t in SPECIAL]
    assert want[0] == [64, 220, 50256, 275]
    for encode in (packing.encoder(), packing.encoder(path)):
        assert [list(encode(t)) for t in SPECIAL] == want
    for r in packing.pack(make_docs(SPECIAL)).collect():
        ids = np.array([*want[r["doc_id"]], 0], "<u4")
        assert r["doc_tokens"] == len(ids) and bytes(r["ids"]) == ids[r["start"] : r["start"] + r["length"]].tobytes()


def test_very_long_texts(make_docs):
    """Runs on which the pre-tokenizer's stack overflows have the plain tokenizer's ids."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    run = " " * 1_100_000
    texts = [run, f"a{run}b<|endoftext|>{run}<|endoftext|> c", "\n" * 5_000_000, f"{run}\u3000\x1c\x85x", "a" * 2_000_000, "\u3000\t" * 600_000 + "é"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [packing.encoder()(t).tolist() for t in texts] == want
    pieces = packing.pack(make_docs(texts)).select("doc_id", "length", "doc_tokens").collect()
    for i, ids in enumerate(want):
        own = [r for r in pieces if r["doc_id"] == i]
        assert {r["doc_tokens"] for r in own} == {len(ids) + 1} and sum(r["length"] for r in own) == len(ids) + 1


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_is_a_walk(dims, bits):
    side = 2**bits
    points = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.hilbert_key(points, bits)
    assert sorted(keys) == list(range(side**dims))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_neighbours_share_sequences(make_docs):
    texts = [(i, " ".join([("alpha beta gamma", "uno dos tres")[i % 2]] * 60)) for i in range(40)]
    rows = packing.pack(make_docs(texts), seq_len=256).collect()
    seqs = defaultdict(set)
    for r in rows:
        seqs[r["sequence_id"]].add(r["doc_id"] % 2)
    assert sum(len(s) > 1 for s in seqs.values()) <= 2
