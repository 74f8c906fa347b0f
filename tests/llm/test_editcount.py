import random

import public_tokenizers
import pytest

from gridcells.llm import editcount as E
from gridcells.llm.packing import encoder

SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def count():
    encode = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda t: len(encode(t))


def check(tree, text, count):
    assert tree.tokens[1] == count(text) and tree.chars[1] == len(text)
    for sums in (tree.chars, tree.tokens):
        assert all(sums[k] == sums[2 * k] + sums[2 * k + 1] for k in range(1, tree.leaves))


def test_random_edits_keep_the_count(count):
    rng = random.Random(2)
    parts = ["word", " and", "  ", "\n\n", "it's", "'re", " 123", "...", " é", "漢字", " <|endoftext|>", "\t", "'", "x" * 40]
    for size in (0, 5, 300, 2500):
        text = "".join(rng.choices(parts, k=size))
        tree = E.Tree.build(text, count)
        check(tree, text, count)
        for _ in range(25):
            a = rng.randrange(len(text) + 1)
            b = min(len(text), a + rng.choice([0, 0, 1, 3, 50, 900]))
            tree, text, n = tree.edit(text, a, b, "".join(rng.choices(parts, k=rng.choice([0, 1, 2, 400]))), count)
            check(tree, text, count)


def test_edits_encode_little(count):
    text = "some words of a long text " * 2000
    tree = E.Tree.build(text, count)
    _, _, n = tree.edit(text, 20_000, 20_010, "other", count)
    assert n < 1500


def test_edits_make_and_break_the_added_token():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    full = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    encode = encoder()
    text = "some words " * 60 + "<|endof text|> " + "more words " * 60
    tree = E.Tree.build(text, lambda t: len(encode(t)))
    for a, b, new in ((text.index("f t") + 1, text.index("f t") + 2, ""), (0, 0, "<|endoftext|>"), (5, 9, ""), (700, 700, "<|endoftext|>")):
        tree, text, _ = tree.edit(text, a, b, new, lambda t: len(encode(t)))
        check(tree, text, full)


@pytest.mark.parametrize("words", ["слова длинного текста ", "λέξεις ενός κειμένου ", "كلمات نص طويل ", "一些漢字，很長的文字。", "12 345 6789 ", "한국어 문장, ", "if (x[i] != 'it\'s'):\n\treturn f(a, b);\n", '{"a1":[1,2.5e3],"b":"c"},', "9f3b0aa1c4de", "\n\n\t  word"])
def test_edits_encode_little_in_any_script(count, words):
    text = words * 2000
    tree = E.Tree.build(text, count)
    check(tree, text, count)
    for a in (9_000, 9_001, 10_002, 10_003, 10_004, 10_005):
        tree, text, n = tree.edit(text, a, a + 2, "其他 1。 ж", count)
        assert n < 1500
        check(tree, text, count)


def test_a_long_paste_splits_in_place(count):
    text = "some words of a long text " * 2000
    tree = E.Tree.build(text, count)
    leaves = len(E.segments(text))
    tree, text, n = tree.edit(text, 20_000, 20_010, "pasted words, " * 800, count)
    assert n < 14 * 800 + 1500 and len(E.segments(text)) > leaves + 30
    check(tree, text, count)
    tree, text, n = tree.edit(text, 25_000, 25_001, "other", count)
    assert n < 1500
    check(tree, text, count)


LONG = [" " * 5_000_000, "\n" * 5_000_000, "a" * 5_000_000]


def test_very_long_texts(make_docs):
    """Five million of one character: one pre-token, or (lines) several ids."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = make_docs([(0, LONG[0]), (1, LONG[1]), (2, LONG[2])])
    edits = "array(struct(2500000 AS start, 2500001 AS end, 'x' AS new))"
    out = E.apply_edits(E.build_trees(docs).selectExpr("doc_id", "text", "tree_chars", "tree_tokens", f"{edits} AS edits"))
    for r in out.select("doc_id", "tree_chars", "tree_tokens").collect():
        text = LONG[r["doc_id"]]
        text = text[:2_500_000] + "x" + text[2_500_001:]
        assert (r["tree_chars"][1], r["tree_tokens"][1]) == (len(text), len(plain.encode(text, add_special_tokens=False).ids))


def test_cuts_are_boundaries_for_every_letter(count):
    letters = [chr(c) for c in range(0x30000) if chr(c).isalnum()][::7]
    for c in letters:
        for text in (f"x{c} {c}y", f"漢{c} {c}。"):
            cuts = [m.start() for m in E.CUT.finditer(text)]
            assert text.index(" ") in cuts
            assert all(count(text) == count(text[:at]) + count(text[at:]) for at in cuts)
    for c in (c for c in map(chr, range(0x3041, 0xD7A4)) if E.CUT.search(f"{c}。x")):
        assert count(f"字{c}。字") == count(f"字{c}") + count("。字")


def test_query_against_full_count(spark, count):
    rows = {r["doc_id"]: r for r in E.op6_edit_token_counts(spark, SAMPLE).collect()}
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet").withColumn("edits", E.sample_edits()).collect()
    for d in docs:
        text = d["text"] or ""
        assert rows[d["doc_id"]]["n_tokens"] == count(text)
        for e in d["edits"]:
            text = text[: e["start"]] + e["new"] + text[e["end"] :]
        r = rows[d["doc_id"]]
        assert (r["n_tokens_after"], r["n_chars_after"]) == (count(text), len(text))


def test_odd_rows_and_empty(odd_docs, no_docs):
    trees = E.build_trees(odd_docs).withColumn("edits", E.sample_edits())
    out = E.apply_edits(trees).collect()
    assert len(out) == odd_docs.count() and "shard" in out[0].asDict()
    assert all(r["tree_chars"][1] == len(r["text"] or "") for r in out)
    assert E.apply_edits(E.build_trees(no_docs).withColumn("edits", E.sample_edits())).collect() == []
