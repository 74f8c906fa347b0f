"""Edit-aware token counts (operator 6).

A text is cut into segments of whole pre-tokens, at places that are a boundary of
the pre-tokenizer whatever stands further away: before white space that follows
anything else, and where an ASCII letter or digit meets an ASCII mark or the other of
the two, or a letter of Chinese, Japanese or Korean meets a full-width mark. A
segment tree keeps characters and tokens of each segment and the sums above them. An
edit re-encodes only the segments it touches (and a neighbour where it reaches the
characters that make a boundary), and updates the sums on the paths to the root; a
long insertion becomes segments of its own. So the root always has the count of the
whole edited text.

Edge cases: null or empty text is a tree without characters; positions are
clamped to the text; edits at one place (ties) apply in the order of the list; a null
edit list or replacement means none; texts of any length are handled whole, and one
without a cut (a run of one kind of character, a single pre-token) is one segment;
repeated rows are handled each; an empty table gives no rows; further columns of the
input stay, but those named like the added ones, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from gridcells.llm.batches import slices
from gridcells.llm.packing import encoder
from gridcells.runtime import ship, spread, table

#: Least characters of a segment.
SEGMENT = 256
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: None of these places lies within the added token, which has bars around letters.
CUT = re.compile(
    f"(?<=[^{_SPACE}])(?=[{_SPACE}])"
    "|(?<=[A-Za-z0-9])(?=[!-/:-@\\[-`{}~])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
    "|(?<=[\u4e00-\u9fea\u3041-\u3096\u30a1-\u30fa\uac00-\ud7a3])(?=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])"
)


def segments(text: str) -> list[str]:
    """The text in pieces of SEGMENT characters or a little more."""
    out, at = [], 0
    while m := CUT.search(text, at + SEGMENT):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class Tree:
    """Characters and tokens of each segment; node 1 is the root, the children of
    k are 2k and 2k + 1, leaves come last."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens, self.leaves = chars, tokens, len(chars) // 2

    @classmethod
    def build(cls, text: str, count) -> Tree:
        parts = segments(text)
        return cls.over([len(p) for p in parts], [count(p) for p in parts])

    @classmethod
    def over(cls, chars, tokens) -> Tree:
        """The tree over these leaves: sums only, nothing is encoded."""
        leaves = 1 << max(0, (len(chars) - 1).bit_length())
        levels = []
        for values in (chars, tokens):
            sums = np.zeros(2 * leaves, np.int64)
            sums[leaves : leaves + len(values)] = values
            width = leaves
            while width > 1:
                sums[width // 2 : width] = sums[width : 2 * width].reshape(-1, 2).sum(1)
                width //= 2
            levels.append(sums)
        return cls(*levels)

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character at ``position`` (the last with
        characters at the end), and the characters before it."""
        k, before = 1, 0
        while k < self.leaves:
            left = int(self.chars[2 * k])
            right = position >= before + left and self.chars[2 * k + 1] > 0
            k, before = 2 * k + right, before + left * right
        return k - self.leaves, before

    def set_leaf(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.leaves
        more_chars, more_tokens = chars - int(self.chars[k]), tokens - int(self.tokens[k])
        while k:
            self.chars[k] += more_chars
            self.tokens[k] += more_tokens
            k //= 2

    def edit(self, text: str, start: int, end: int, new: str, count) -> tuple[Tree, str, int]:
        """The tree and the text after text[start:end] became ``new``, and the
        characters encoded for it."""
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        edited = text[:start] + new + text[end:]
        # a boundary depends on the letter before it and two characters after it
        first, low = self.leaf_at(max(0, start - 2))
        last, at = self.leaf_at(end + 1)
        high = at + int(self.chars[self.leaves + last])
        parts = segments(text[low:start] + new + text[end:high])
        sizes, counts, slots = [len(p) for p in parts], [count(p) for p in parts], last - first + 1
        if len(parts) > slots:
            spliced = lambda old, new: np.concatenate([old[self.leaves : self.leaves + first], new, old[self.leaves + last + 1 :]])
            return Tree.over(spliced(self.chars, sizes), spliced(self.tokens, counts)), edited, sum(sizes)
        for i in range(slots):
            self.set_leaf(first + i, *((sizes[i], counts[i]) if i < len(parts) else (0, 0)))
        return self, edited, sum(sizes)


def _counter(tokenizer: str | None):
    encode = encoder(tokenizer)
    return lambda text: len(encode(text)) if text else 0


def build_trees(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """All columns of ``docs``, then tree_chars, tree_tokens (which replace
    columns of those names)."""
    ship(docs.sparkSession)
    base = docs.drop("tree_chars", "tree_tokens")
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer)
        for batch in slices(batches):
            trees = [Tree.build(t or "", count) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {"tree_chars": pa.array([t.chars for t in trees], pa.list_(pa.int64())), "tree_tokens": pa.array([t.tokens for t in trees], pa.list_(pa.int64()))})

    return base.mapInArrow(run, StructType([*base.schema.fields]).add("tree_chars", ArrayType(LongType())).add("tree_tokens", ArrayType(LongType())))


def apply_edits(trees: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``trees`` has text, tree_chars, tree_tokens and edits (array of start,
    end, new; each on the text the one before left). The same columns with text
    and trees after the edits, and n_encoded, the characters encoded for them."""
    ship(trees.sparkSession)
    base = trees.drop("n_encoded")
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer)
        for batch in slices(batches):
            texts, chars, tokens, encoded = [], [], [], []
            for text, c, t, edits in zip(*(batch.column(n).to_pylist() for n in ("text", "tree_chars", "tree_tokens", "edits")), strict=True):
                tree, after, n = Tree(np.array(c), np.array(t)), text or "", 0
                for e in edits or []:
                    tree, after, more = tree.edit(after, e["start"] or 0, e["end"] or 0, e["new"] or "", count)
                    n += more
                texts.append(after if edits else text)
                chars.append(tree.chars)
                tokens.append(tree.tokens)
                encoded.append(n)
            new = {"text": pa.array(texts, pa.string()), "tree_chars": pa.array(chars, pa.list_(pa.int64())), "tree_tokens": pa.array(tokens, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict({n: new.get(n, batch.column(n)) for n in names} | {"n_encoded": pa.array(encoded, pa.int64())})

    return base.mapInArrow(run, StructType([*base.schema.fields]).add("n_encoded", "long"))


def sample_edits() -> F.Column:
    """Three edits per document at places drawn from its id: a replacement, an
    insertion and a deletion."""
    place = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.coalesce(F.length("text"), F.lit(0)) + 1)
    edit = lambda start, n, new: F.struct(start.alias("start"), (start + n).alias("end"), F.lit(new).alias("new"))
    return F.array(edit(place("replace"), 30, " changed words, 123 "), edit(place("insert"), 0, "inserted\n\n  text"), edit(place("delete"), 60, ""))


def op6_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    before = build_trees(docs).withColumn("n_tokens", F.get("tree_tokens", F.lit(1))).withColumn("edits", sample_edits())
    after = apply_edits(before)
    return after.select("doc_id", "n_tokens", F.get("tree_tokens", F.lit(1)).alias("n_tokens_after"), F.get("tree_chars", F.lit(1)).alias("n_chars_after"), "n_encoded")


QUERIES = {"op6_edit_token_counts": op6_edit_token_counts}
SQL: dict[str, str] = {}
