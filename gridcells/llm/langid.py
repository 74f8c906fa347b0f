"""Language identification by error-correcting output codes (operator 3).

Every language gets a codeword of +1/-1 bits far from the others. For each bit a
binary n-gram classifier (multinomial log odds of hashed byte 2- to 4-grams,
then a logistic calibration) predicts the bit; decoding weights each bit's
logistic loss by how reliable the bit was in training and chooses the nearest
codeword. Texts whose two nearest codewords are close are flagged ambiguous.

Training reads a bounded sample: about ``sample_per_lang`` labelled documents of
each language (fewer if there are fewer, and of copies with one id one), chosen by a
hash of doc_id and text among rows outside the held-out fifth whose text has a letter
and at most SAMPLE_BYTES. Prediction sees the text only, whole.

Edge cases: null text or text without a letter (Unicode's category, so no digit,
fraction, roman or circled number is one) is ``und`` with score 0; without labelled
texts that have a letter everything is ``und``; with one language every lettered text
gets it with score 1; of languages equally near (a tie) the first by name is taken, and
the text flagged ambiguous; texts of any length are read whole; repeated rows get equal
answers; an empty table gives no rows; a null doc_id counts as held out; further
columns of the input stay, but those named like the added ones, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridcells.llm.batches import map_arrow, slices, split_of
from gridcells.runtime import spread, staged, table

SAMPLE_PER_LANG, SAMPLE_BYTES = 2000, 1 << 20
DIMS = 1 << 14
ORDERS = (2, 3, 4)
#: Loss between the two nearest codewords below which a text is ambiguous.
MARGIN = 0.7
LETTER = regex.compile(r"\p{L}")
#: ASCII letters stay, every other ASCII byte is a space; other bytes stay.
_LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


#: Bytes of one text that are hashed at once.
CHUNK = 1 << 20


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed byte n-grams, texts x DIMS."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        joined = b" " + b" ".join(text.lower().encode().translate(_LETTERS_ONLY).split()) + b" "
        for low in range(0, len(joined), CHUNK):
            own = min(CHUNK, len(joined) - low)  # the n-grams that begin here
            b = np.frombuffer(joined[low : low + CHUNK + max(ORDERS) - 1], np.uint8).astype(np.uint32)
            mixed = b * np.uint32(0x9E3779B1)
            for n in range(2, max(ORDERS) + 1):
                if len(b) < n:
                    break
                mixed = (mixed[:-1] ^ (b[n - 1 :] + np.uint32(n))) * np.uint32(0x85EBCA6B)
                if n in ORDERS:
                    row += np.bincount(mixed[:own] >> np.uint32(32 - 14), minlength=DIMS)
    return out


def codebook(n_langs: int, seed: int = 3) -> np.ndarray:
    """Codewords (languages x bits of +-1), each bit splitting the languages,
    with the largest least distance among random draws."""
    if n_langs < 2:
        return np.ones((n_langs, 0))
    bits = 4 * (n_langs - 1).bit_length() + 7
    rng, best, best_distance = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = np.where(rng.random((n_langs, bits)) < 0.5, -1.0, 1.0)
        fixed = np.abs(code.sum(0)) == n_langs
        code[rng.integers(n_langs, size=int(fixed.sum())), np.flatnonzero(fixed)] *= -1
        distance = min(int((code[i] != code[j]).sum()) for i in range(n_langs) for j in range(i))
        if distance > best_distance:
            best, best_distance = code, distance
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # DIMS x bits
    scale: np.ndarray
    shift: np.ndarray
    trust: np.ndarray

    def decode(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of texts that have a letter."""
        if len(self.langs) < 2:
            return self.langs * len(texts), np.ones(len(texts)), np.zeros(len(texts), bool)
        margins = bit_values(texts, self.weights) * self.scale + self.shift
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        chances = np.exp(loss.min(1, keepdims=True) - loss)
        chances /= chances.sum(1, keepdims=True)
        near = np.sort(loss, axis=1)
        return [self.langs[i] for i in loss.argmin(1)], chances.max(1), near[:, 1] - near[:, 0] < MARGIN


def bit_values(texts: list[str], weights: np.ndarray) -> np.ndarray:
    counts = gram_counts(texts)
    return (counts @ weights) / np.maximum(counts.sum(1, keepdims=True), 1)


def _calibrate(values: np.ndarray, bit: np.ndarray) -> tuple[float, float, float]:
    """Platt's logistic scale and shift for one bit, and its mean loss."""
    up, down = (bit > 0).sum(), (bit < 0).sum()
    target = np.where(bit > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([values / (values.std() + 1e-9), np.ones_like(values)])
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        hessian = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        w += np.clip(np.linalg.solve(hessian, x @ (target - p) - 1e-3 * w), -2, 2)
    loss = np.logaddexp(0, -bit * (w @ x)).mean()
    return w[0] / (values.std() + 1e-9), w[1], loss


def train(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    key = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("langid"))
    labelled = docs.where(F.col("lang").isNotNull() & (split_of(F.col("doc_id")) != 0) & (F.octet_length("text") <= SAMPLE_BYTES) & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    code = codebook(len(langs))
    if len(langs) < 2:
        return Model(langs, code, *[np.zeros(0)] * 4)
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample_per_lang / counts[k]))]), F.col("lang"))
    chosen = labelled.withColumn("key", key).where(F.pmod("key", F.lit(1 << 20)) < share * (1 << 20))
    sample = staged(chosen.groupBy("lang", "key").agg(F.first("text").alias("text")).drop("key"), "langid-sample")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums = np.zeros((len(langs), DIMS))
        for batch in slices(batches):
            rows = np.array([langs.index(x) for x in batch.column("lang").to_pylist()])
            np.add.at(sums, rows, gram_counts(batch.column("text").to_pylist()))
        lang, gram = np.nonzero(sums)
        yield {"l": lang, "g": gram, "n": sums[lang, gram]}

    sums = np.zeros((len(langs), DIMS))
    for r in map_arrow(sample, grams, "l int, g int, n double").groupBy("l", "g").agg(F.sum("n").alias("n")).collect():
        sums[r["l"], r["g"]] = r["n"]
    rates = sums / np.maximum(sums.sum(1, keepdims=True), 1)  # each language counts alike
    side = lambda sign: (code.T == sign) @ rates / np.maximum((code.T == sign).sum(1, keepdims=True), 1)
    floor = 0.1 / DIMS
    weights = np.log((side(1) + floor) / (side(-1) + floor)).T.astype(np.float32)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            yield {"lang": batch.column("lang"), "v": bit_values(batch.column("text").to_pylist(), weights).astype(float).tolist()}

    rows = map_arrow(sample, values, "lang string, v array<double>").collect()  # about sample_per_lang a language
    if not rows:  # the shares of a few documents chose none
        return train(docs, max(counts.values()))
    v, truth = np.array([r["v"] for r in rows]), code[[langs.index(r["lang"]) for r in rows]]
    fits = np.array([_calibrate(v[:, b], truth[:, b]) for b in range(code.shape[1])])
    trust = 1 / (fits[:, 2] + 0.05)
    return Model(langs, code, weights, fits[:, 0], fits[:, 1], trust / trust.mean())


ADDED = {"held_out": "boolean", "lang_pred": "string", "score": "double", "ambiguous": "boolean"}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and held_out, lang_pred, score, ambiguous (which
    replace columns of those names)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop(*ADDED).withColumn("held_out", split_of(F.col("doc_id")) == 0)
    names = base.columns
    schema = StructType([*base.schema.fields])
    for name in ("lang_pred", "score", "ambiguous"):
        schema = schema.add(name, ADDED[name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            lettered = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if held.value.langs else []
            lang, score, doubt = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if lettered:
                found, score[lettered], doubt[lettered] = held.value.decode([texts[i] for i in lettered])
                for i, x in zip(lettered, found, strict=True):
                    lang[i] = x
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {"lang_pred": pa.array(lang), "score": pa.array(score), "ambiguous": pa.array(doubt)})

    return base.mapInArrow(run, schema)


def op3_language_id_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", *ADDED)


QUERIES = {"op3_language_id_ecoc": op3_language_id_ecoc}
SQL: dict[str, str] = {}
