"""Packing along a space-filling curve (operator 1).

Each document becomes a hashed token-count vector, projected to a few
dimensions; a Hilbert key orders documents so that neighbours on the curve are
alike, a range shuffle of thin (key, length) rows puts the corpus in that order,
and running sums give every document its place in one gapless token stream,
which is cut every ``seq_len`` tokens. Only the thin rows are sorted; token ids
move once, in a join on a row number.

Edge cases: a null or empty text is its end token alone; a text of any length is
encoded whole and cut over as many sequences as it fills (runs of white space too
long for the pre-tokenizer's stack are encoded as the one pre-token that they are);
repeated rows are packed once each; ties of the key (copies) are ordered by row
number, so a hot group of copies spreads over many range partitions; an empty table
gives no rows; a null doc_id stays null; further columns of the input are ignored,
also if they are named like those added here.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcells.llm.batches import map_arrow, slices
from gridcells.runtime import shuffle_partitions, spread, staged, table

SEQ_LEN = 1024
BUCKETS, DIMS, BITS = 1024, 4, 15
#: The added token of the JSON file, which the ranks lack: found in a text, it is one id.
SPECIAL = {"<|endoftext|>": 50256}
#: Runs of white space near the length at which the pre-tokenizer's backtracking
#: stack overflows (a million characters).
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100000,}")


@lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """The byte-level BPE of ``byte_bpe_50k``: a tokenizers JSON file, or the
    same vocabulary as tiktoken ranks, which gives equal ids several times
    faster (a test compares them). The default is the ranks file."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def encode(text: str) -> np.ndarray:
        try:
            return enc.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # the stack of the pattern
            return _with_long_runs(enc, text)

    return encode


def _with_long_runs(enc, text: str) -> np.ndarray:
    """Ids of a text with long runs of white space. All of a run is one pre-token,
    but for its last character if more text follows; so it is encoded alone, and
    what stands around it as ever."""
    special = next(iter(SPECIAL))
    parts = [np.zeros(0, np.uint32)]
    for i, section in enumerate(text.split(special)):
        if i:
            parts.append(np.array([SPECIAL[special]], np.uint32))
        at = 0
        for m in LONG_RUN.finditer(section):
            stop = m.end() if m.end() == len(section) else m.end() - 1
            parts += [enc.encode_to_numpy(section[at : m.start()]), np.array(enc._encode_single_piece(section[m.start() : stop]), np.uint32)]
            at = stop
        parts.append(enc.encode_to_numpy(section[at:]))
    return np.concatenate(parts)


def hilbert_key(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n x dims, each below
    2**bits), by the transpose method of Skilling (2004)."""
    x = coords.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMS))


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given as token ids: log counts hashed to
    BUCKETS, unit length, Gaussian projection to DIMS, a grid of BITS each."""
    counts = np.zeros((len(ids), BUCKETS), np.float32)
    for row, x in zip(counts, ids, strict=True):
        row += np.bincount(x & (BUCKETS - 1), minlength=BUCKETS)
    vectors = np.log1p(counts)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    # a unit vector lands within a few standard deviations of 1
    cells = np.clip((vectors @ _projection() + 4) / 8, 0, 1 - 2.0**-BITS) * 2**BITS
    return hilbert_key(cells.astype(np.int64))


def tokenized(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """row_id, doc_id, key, n_tokens, ids (little-endian, 2 bytes each, or 4 if
    the vocabulary needs them: ``wide``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode = encoder(tokenizer)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            ids = [np.append(encode(t), np.uint32(end_id)) if t else np.array([end_id], np.uint32) for t in texts]
            wide = [bool(x.max() > 0xFFFF) for x in ids]
            yield {
                "row_id": batch.column("row_id"), "doc_id": batch.column("doc_id"), "key": curve_keys(ids),
                "n_tokens": [len(x) for x in ids], "wide": wide,
                "ids": [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(ids, wide, strict=True)],
            }

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, run, "row_id long, doc_id long, key long, n_tokens long, wide boolean, ids binary")


def curve_order(tokens: DataFrame) -> DataFrame:
    """row_id, part, local_start: each document's place in range partitions of
    the curve; ``local_start`` counts the tokens before it in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            ends = before + np.cumsum(n)
            yield {"row_id": batch.column("row_id"), "part": np.full(len(n), part), "local_start": ends - n, "n_tokens": n}
            before = int(ends[-1]) if len(n) else before

    thin = tokens.select("row_id", "key", "n_tokens")
    ordered = thin.repartitionByRange(shuffle_partitions(tokens.sparkSession), "key", "row_id").sortWithinPartitions("key", "row_id")
    return map_arrow(ordered, run, "row_id long, part long, local_start long, n_tokens long")


def tail_cuts(total: int, seq_len: int) -> list[int]:
    """Bounds of the sequences after the last full one: the rest is cut into
    powers of two, which need no padding."""
    at, rest, cuts = total - total % seq_len, total % seq_len, []
    while rest:
        size = 1 << (rest.bit_length() - 1)
        cuts.append(at)
        at, rest = at + size, rest - size
    return [*cuts, total]


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (binary, unsigned
    little-endian 32-bit), doc_tokens, sequence_id, offset."""
    tokens = staged(tokenized(docs, tokenizer, end_id), "tokens")
    places = staged(curve_order(tokens), "places")
    # one number per range partition
    totals = dict(places.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, total = {}, 0
    for part in sorted(totals):
        base[part], total = total, total + totals[part]
    tail = np.array(tail_cuts(total, seq_len))
    first_tail = total // seq_len

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for whole in batches:
            for batch in slices([whole], "ids"):
                out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
                for doc_id, part, start, ids, wide in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "local_start", "ids", "wide")), strict=True):
                    ids = np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4")
                    n, at = len(ids), base[part] + start
                    pos = 0
                    while pos < n:
                        g = at + pos
                        if g < tail[0]:
                            seq, offset = divmod(g, seq_len)
                            end = min(n, pos + seq_len - offset)
                        else:
                            k = int(np.searchsorted(tail, g, "right")) - 1
                            seq, offset = first_tail + k, g - int(tail[k])
                            end = min(n, pos + int(tail[k + 1]) - g)
                        for k, v in zip(out, (doc_id, pos, end - pos, ids[pos:end].tobytes(), n, seq, offset), strict=True):
                            out[k].append(v)
                        pos = end
                yield out

    joined = tokens.join(places.select("row_id", "part", "local_start").hint("shuffle_hash"), "row_id")
    return map_arrow(joined.select("doc_id", "part", "local_start", "ids", "wide"), run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length, ids (binary): the pieces of each sequence put
    together; a group holds at most one sequence's tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def op1_pack_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op1_pack_hilbert": op1_pack_hilbert}
SQL: dict[str, str] = {}
