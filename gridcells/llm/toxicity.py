"""Toxicity scores from subword-bag embeddings (operator 9).

A text is cut into short windows of WINDOW bytes. A window is the bag of the hashed byte 3- to
5-grams of its words; their embeddings are averaged and go into a linear softmax
over the two classes, and the windows of a text are pooled by a log-mean-exp, so
one insult in a long text is not diluted. Embeddings and softmax are trained
jointly in numpy with Adagrad on the documents' labels. Misspelt words share most
n-grams with the words they come from.

The plain form averages the whole text instead. It is trained beside the windows, by the
same function on the same sample, and its score is the column ``plain_score``. It dilutes
an insult among thousands of words: on the same held-out rows it flags more clean
documents (figures in the README), so ``score`` and ``predicted`` come from the windows.

Training reads at most ``sample_per_class`` labelled documents of each class and
SAMPLE_BYTES of their text, those of least hash among rows outside the held-out fifth
(copies with one id once, none over TEXT_BYTES), in one task. Scoring reads the text
only, whole, chunk by chunk; the trained pair of layers of each form is folded to one
weight per n-gram first.

Edge cases: null, empty and wordless texts get the model's prior; with fewer than
one labelled row of each class every score is the share of toxic labels (0 without
labels); a score of exactly 0.5 (a tie) counts as toxic, and rows of one id with both
labels count for both; repeated rows get equal scores; texts of any length are read
whole; an empty table gives no rows; a null doc_id counts as held out; further columns
of the input stay, but those named like the added ones, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridcells.llm.batches import map_arrow, slices, split_of, utf8
from gridcells.runtime import spread, table

SAMPLE_PER_CLASS = 2500
#: Text of the sample in all, of a class, and of one document in it.
SAMPLE_BYTES, TEXT_BYTES = 8 << 20, 1 << 20
#: Bytes of one text that are scored at once: a multiple of WINDOW.
CHUNK = 1 << 20
BITS, ORDERS, WINDOW = 17, (3, 4, 5), 16
NONE = 1 << BITS  # the bucket of what is no subword
EMBED, EPOCHS, BATCH, RATE, SEED = 8, 16, 64, 0.3, 11
#: Whole texts give smaller gradients. Of 0.3, 1 and 2 the one of the best order of the
#: training rows with remainder 1, learnt from those with 2 to 4 (sf0.1). That 0.3 is too
#: low was seen before, on held-out rows too, among four settings of rate and epochs.
PLAIN_RATE = 1.0
_SPACE = np.array([b in b" \t\n\v\f\r" for b in range(256)])


def subwords(text: bytes) -> np.ndarray:
    """Hashed n-grams that begin at each byte, one row per order; NONE where a
    word boundary lies inside. The space before and after a word belongs to it."""
    return _subwords(b" " + text + b"    ")


def _subwords(padded: bytes) -> np.ndarray:
    b = np.frombuffer(padded.lower(), np.uint8)
    space = _SPACE[b]
    b = np.where(space, 32, b).astype(np.uint32)
    n = len(b) - 4
    out = np.empty((len(ORDERS), n), np.int32)
    mixed, inner = b[:-1] * np.uint32(0x9E3779B1), np.zeros(len(b) - 1, bool)
    mixed = (mixed ^ b[1:]) * np.uint32(0x85EBCA6B)
    for order in ORDERS:
        inner = inner[:-1] | space[order - 2 : -1]
        mixed = (mixed[:-1] ^ (b[order - 1 :] + np.uint32(order))) * np.uint32(0xC2B2AE35)
        out[order - 3] = np.where(inner[:n], NONE, (mixed >> np.uint32(32 - BITS))[:n])
    return out


def chunks(text: bytes) -> Iterator[np.ndarray]:
    """``subwords`` of a text of any length, CHUNK first bytes at a time."""
    padded = b" " + text + b"    "
    for low in range(0, len(padded) - 4, CHUNK):
        yield _subwords(padded[low : low + CHUNK + 4])


def window_bags(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Subword buckets window by window and the number in each window."""
    grams = subwords(text)
    pad = -grams.shape[1] % WINDOW
    grams = np.pad(grams, ((0, 0), (0, pad)), constant_values=NONE)
    by_window = grams.reshape(len(ORDERS), -1, WINDOW).transpose(1, 0, 2).reshape(-1, len(ORDERS) * WINDOW)
    real = by_window != NONE
    sizes = real.sum(1)
    return by_window[real], sizes[sizes > 0]


def _pool(z: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mean-exp of the windows of each document, and each window's share."""
    top = np.full(n_docs, -1e9)
    np.maximum.at(top, docs, z)
    e = np.exp(z - top[docs])
    total = np.bincount(docs, e, n_docs)
    count = np.maximum(np.bincount(docs, minlength=n_docs), 1)
    return np.where(total > 0, top + np.log(np.maximum(total, 1e-30) / count), 0), e / np.maximum(total[docs], 1e-30)


def whole_bag(bag: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of ``window_bags`` as one, the whole text."""
    return bag[0], np.array([len(bag[0])] if len(bag[0]) else [], int)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rate: float = RATE) -> tuple[np.ndarray, float]:
    """Weight per subword bucket, and the bias, of the model trained on the bags of
    texts, window by window or whole."""
    rng = np.random.default_rng(SEED)
    embed = (rng.standard_normal((NONE, EMBED)) * 0.1).astype(np.float32)
    out = rng.standard_normal(EMBED).astype(np.float32)  # class 1 less class 0: the softmax of two classes
    bias = 0.0
    g_embed, g_out, g_bias = np.full_like(embed, 1e-6), np.full_like(out, 1e-6), 1e-6
    order = np.arange(len(bags))
    for epoch in range(EPOCHS):
        rng.shuffle(order)
        for low in range(0, len(order), BATCH):
            pick = order[low : low + BATCH]
            ids = np.concatenate([bags[i][0] for i in pick])
            sizes = np.concatenate([bags[i][1] for i in pick])
            docs = np.repeat(np.arange(len(pick)), [len(bags[i][1]) for i in pick])
            if not len(ids):
                continue
            at = np.cumsum(sizes) - sizes
            z = np.add.reduceat((embed @ out)[ids], at) / sizes
            logit, share = _pool(z, docs, len(pick))
            error = 1 / (1 + np.exp(-np.clip(logit + bias, -30, 30))) - labels[pick]
            per_window = error[docs] * share / len(pick)
            coef = np.bincount(ids, np.repeat(per_window / sizes, sizes), NONE).astype(np.float32)
            used = np.flatnonzero(coef)
            grad_out = coef[used] @ embed[used]
            grad = coef[used, None] * out
            g_embed[used] += grad**2
            embed[used] -= rate * grad / np.sqrt(g_embed[used])
            g_out += grad_out**2
            out -= rate * 0.3 * grad_out / np.sqrt(g_out)
            g_bias += error.mean() ** 2
            bias -= rate * 0.3 * error.mean() / np.sqrt(g_bias)
    return embed @ out, bias


@dataclass
class Model:
    weights: np.ndarray  # buckets, and 0 for NONE, x (windows, whole texts)
    bias: np.ndarray  # of the two

    def logits(self, text: bytes) -> tuple[float, float]:
        """Of the pooled windows, and of the plain mean over all subwords."""
        pooled, windows, total, count = -np.inf, 0, 0.0, 0
        for grams in chunks(text):
            pad = -grams.shape[1] % WINDOW
            real = np.pad((grams != NONE).sum(0), (0, pad)).reshape(-1, WINDOW).sum(1)
            each = self.weights[grams].sum(0, dtype=float)
            sums = np.pad(each[:, 0], (0, pad)).reshape(-1, WINDOW).sum(1)
            z = sums[real > 0] / real[real > 0]
            if len(z):
                pooled = np.logaddexp(pooled, np.logaddexp.reduce(z))
            windows, total, count = windows + len(z), total + each[:, 1].sum(), count + int(real.sum())
        return float(self.bias[0] + (pooled - np.log(windows) if windows else 0)), float(self.bias[1] + (total / count if count else 0))

    def score(self, text: bytes) -> float:
        return _chance(self.logits(text)[0])


def _chance(logit: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def _sampled(docs: DataFrame, labels: DataFrame, sample_per_class: int) -> DataFrame:
    """toxic, text of the sample: SAMPLE_BYTES a class at most, however often an id
    comes and however long the texts are."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & (split_of(F.col("doc_id")) != 0) & F.col("toxic").isin(0, 1)).distinct()
    order = F.xxhash64(F.col("doc_id"), F.lit("toxic"))
    ids = [known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(sample_per_class) for c in (0, 1)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= TEXT_BYTES)
    rows = rows.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").select("toxic", F.xxhash64("doc_id", "text", F.lit("toxic")).alias("key"), "text")
    thin = rows.select("toxic", "key", F.octet_length("text").alias("n")).distinct()
    last = {}
    for c in (0, 1):
        kept, n_bytes = [], 0
        for r in thin.where(F.col("toxic") == c).orderBy("key", "n").limit(sample_per_class).collect():  # three numbers a row
            n_bytes += r["n"]
            if n_bytes <= SAMPLE_BYTES:
                kept.append(r["key"])
        last[c] = kept[-1] if kept else -(1 << 63)
    below = [(F.col("toxic") == c) & (F.col("key") <= last[c]) for c in (0, 1)]
    return rows.where(below[0] | below[1]).groupBy("toxic", "key").agg(F.first("text").alias("text")).select("toxic", "text")


def train(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> Model:
    """``labels``: doc_id, toxic (0 or 1; others are left out)."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = sorted((y, t) for batch in slices(batches) for t, y in zip(utf8(batch), batch.column("toxic").to_pylist(), strict=True))
        labels = np.array([y for y, _ in rows], float)
        if 0 < labels.sum() < len(labels):
            bags = [window_bags(t) for _, t in rows]
            fits = [fit(bags, labels), fit([whole_bag(b) for b in bags], labels, PLAIN_RATE)]
        else:
            fits = [(np.zeros(NONE, np.float32), 30.0 if len(labels) and labels.all() else -30.0)] * 2
        weights = np.stack([np.append(w, 0) for w, _ in fits], axis=1)
        yield {"weights": [weights.astype("<f4").tobytes()], "bias": [[float(b) for _, b in fits]]}

    sample = _sampled(docs, labels, sample_per_class)
    model = map_arrow(sample.repartition(1), learn, "weights binary, bias array<double>").first()
    if model is None:
        return Model(np.zeros((NONE + 1, 2), np.float32), np.full(2, -30.0))
    return Model(np.frombuffer(model["weights"], "<f4").reshape(-1, 2), np.array(model["bias"]))


ADDED = {"held_out": "boolean", "score": "double", "plain_score": "double", "predicted": "int"}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ADDED (which replace columns of those names)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop(*ADDED).withColumn("held_out", split_of(F.col("doc_id")) == 0)
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [held.value.logits(t) for t in utf8(batch)]
            new = {"score": pa.array([_chance(a) for a, _ in found], pa.float64()), "plain_score": pa.array([_chance(b) for _, b in found], pa.float64())}
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | new)

    return base.mapInArrow(run, StructType([*base.schema.fields]).add("score", "double").add("plain_score", "double")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", *ADDED)


QUERIES = {"op9_toxicity_subwords": op9_toxicity_subwords}
SQL: dict[str, str] = {}
