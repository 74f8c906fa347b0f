"""Secret scan with a randomness test battery (operator 5).

Fixed patterns (assignments, access keys, hex runs) give the base spans. The method
tests every run of encoding characters of the text, whether a pattern has it or not.
For each, the encoding is inferred (the smallest alphabet that holds it), and three
tests measure how well it fits a uniform draw from that alphabet: chi-squared over
parts of the alphabet that ordinary words use very unlike, runs above and below the
middle, and lag-one serial correlation. Three times the least p-value, ``fit``, is
the candidate's score: ordinary names score near nothing.

What is reported is controlled: the null hypothesis of a candidate is that it is
an ordinary identifier, and its p-value is the share of ordinary identifiers of its
kind (letters, digits, mixed) and length class that fit at least as well. These are
made of the corpus itself, one for each kind, length class and document, out of that
document's own words and numbers (LENGTHS, STYLES), and of a fixed list of common
words, so that a small corpus has a scale too. Within each kind and length class the
Benjamini-Hochberg procedure over all candidates of the corpus then decides, so at
most a share ``rate`` of the reported ``random`` spans is expected to be ordinary.

Edge cases: null counts as empty; texts of any length are read whole; repeated rows
are tested each; candidates of equal fit (ties) share one verdict; spans of one start
come in the order of KINDS; a run of letters that goes on in letters of another script
is a word and no candidate; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcells.llm.batches import map_arrow, slices
from gridcells.runtime import spread, staged, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A run of the least length is found whole, as runs of one class do not overlap.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN, RATE = 12, 0.05
#: Least characters and bits of a candidate.
MIN_LENGTH, MIN_BITS = 16, 64.0
RUN, PART = re.compile(r"[A-Za-z0-9+/_-]{16,}"), re.compile(r"[A-Za-z0-9]{16,}")
#: Steps of a tenfold of the fit that are told apart, and the most.
BINS, MAX_BIN = 8, 255
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_LONG = bytes(b if chr(b) in _UPPER + _LOWER + _DIGITS + "+/_-" else 32 for b in range(256))
#: From small to large; of equal size, the first that holds a token is its encoding.
ALPHABETS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "lower36": _LOWER + _DIGITS,
    "upper36": _UPPER + _DIGITS,
    "letters": _UPPER + _LOWER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
ENCODINGS = list(ALPHABETS)
GROUPS = {"lower": 0, "upper": 0, "letters": 0, "decimal": 1}  # others are mixed: 2
#: The letters of which words of many languages mostly consist.
COMMON = set("etaoinsrhlETAOINSRHL")
#: Length classes: from 16, 32, 64 and 128 characters on; identifiers reach 255.
CLASSES = 4
#: Words of the identifiers that every corpus is held against.
WORDS = (
    "the of and to in is for on with as by at from this that user name account email address phone number order item price total count index key value "
    "data file path table column row field type class method function result error message status code server client request response session host port "
    "version build release update create delete insert select table view page title image video audio text string list array object default config setting "
    "option system network service manager controller handler factory provider helper test example sample report summary detail history event time date year "
    "month week day hour minute second start end first last next previous current new old high low left right top bottom public private internal external"
).split()
N_FIXED = 2000


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind."""
    raw = text.encode()
    folded = raw.lower()
    out = []
    if any(k in folded for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    if max(map(len, raw.translate(_LONG).split()), default=0) >= 16:
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_SETS = {k: set(a) for k, a in ALPHABETS.items()}


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that holds the token."""
    held = set(token)
    return next((k for k in ENCODINGS if held <= _SETS[k]), None)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By encoding: place of each character in the alphabet, its part of the alphabet
    (four at most), the share of each part, and the size."""
    places, parts, shares, sizes = np.zeros((len(ENCODINGS), 128), np.int64), np.zeros((len(ENCODINGS), 128), np.int64), np.zeros((len(ENCODINGS), 4)), np.zeros(len(ENCODINGS))
    for e, alphabet in enumerate(ALPHABETS.values()):
        sizes[e] = len(alphabet)
        for i, c in enumerate(alphabet):
            if len(alphabet) <= 16:
                part = i * 4 // len(alphabet)
            else:  # common letters, others, capitals among small ones, digits and marks
                both = len(alphabet) > 36
                part = 2 if both and c.isupper() else 0 if c in COMMON else 1 if c.isalpha() else 3
            places[e, ord(c)], parts[e, ord(c)] = i, part
            shares[e, part] += 1 / len(alphabet)
    return places, parts, shares, sizes


_PLACES, _PARTS, _SHARES, _SIZES = _tables()
_erfc = np.vectorize(math.erfc, otypes=[float])


def battery(tokens: list[str], encodings: list[str]) -> np.ndarray:
    """The fit of each token (ASCII, not empty): three times the least p-value of the
    three tests of uniformity over its alphabet, at most 1."""
    if not tokens:
        return np.zeros(0)
    enc = np.array([ENCODINGS.index(e) for e in encodings])
    size = np.array([len(t) for t in tokens])
    at = np.repeat(np.arange(len(tokens)), size)
    chars = np.frombuffer("".join(tokens).encode(), np.uint8)
    values = _PLACES[enc[at], chars].astype(float)
    # chi-squared over the parts; the tail by Wilson and Hilferty's cube root
    seen = np.bincount(at * 4 + _PARTS[enc[at], chars], minlength=4 * len(tokens)).reshape(-1, 4)
    want = _SHARES[enc] * size[:, None]
    free = (want > 0).sum(1) - 1
    x = np.where(want > 0, (seen - want) ** 2 / np.where(want > 0, want, 1), 0).sum(1) / free
    chi = _erfc((x ** (1 / 3) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free)) / math.sqrt(2)) / 2
    # runs above and below the middle
    inner = at[1:] == at[:-1]
    high = values >= _SIZES[enc][at] / 2
    above = np.bincount(at, high, len(tokens))
    below = size - above
    runs = 1 + np.bincount(at[1:], inner & (high[1:] != high[:-1]), len(tokens))
    mean = 2 * above * below / size + 1
    variance = (mean - 1) * (mean - 2) / (size - 1)
    few = 2.0 ** (1 - np.minimum(size, 100))
    run = np.where(variance > 0, _erfc(np.abs(runs - mean) / np.sqrt(np.where(variance > 0, variance, 1)) / math.sqrt(2)), np.where((above == 0) | (below == 0), few, 1.0))
    # lag-one serial correlation
    v = values - (np.bincount(at, values) / size)[at]
    total = np.bincount(at, v * v)
    lag = np.bincount(at[1:], v[1:] * v[:-1] * inner, len(tokens))
    flat = total < 1e-9
    z = (lag / np.where(flat, 1, total) + 1 / size) * np.sqrt(size)
    serial = np.where(flat, few, _erfc(np.abs(z) / math.sqrt(2)))
    return np.minimum(1, 3 * np.minimum(np.minimum(chi, run), serial))


def bins_of(fit: np.ndarray) -> np.ndarray:
    return np.minimum(MAX_BIN, -np.log10(np.maximum(fit, 1e-40)) * BINS).astype(np.int64)


def family(token: str, encoding: str) -> int:
    """Kind (of three) and length class of a token, as one number."""
    return GROUPS.get(encoding, 2) * CLASSES + min(CLASSES - 1, len(token).bit_length() - 5)


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, token, encoding). A run that fits no alphabet, or has more marks
    than a random one would have (a path), counts part by part."""
    out = []
    for m in RUN.finditer(text):
        marks = sum(map(m[0].count, "+/_-"))
        split = marks > 3 + len(m[0]) // 16 or encoding_of(m[0]) is None
        for at, token in [(m.start() + p.start(), p[0]) for p in PART.finditer(m[0])] if split else [(m.start(), m[0])]:
            encoding = encoding_of(token)
            end = at + len(token)
            if len(token) * math.log2(len(ALPHABETS[encoding])) < MIN_BITS:
                continue
            if token.isalpha() and (text[at - 1 : at].isalpha() or text[end : end + 1].isalpha()):
                continue
            pad = len(text[end : end + 3]) - len(text[end : end + 3].lstrip("="))
            out.append((at, end + pad if pad in (1, 2) and (len(token) + pad) % 4 == 0 else end, token, encoding))
    return out


def identifiers(words: list[str], numbers: list[str], seed: int) -> list[str]:
    """Ordinary identifiers of these words and numbers: one for each kind and length
    class that they suffice for, of a length and in a style that ``seed`` draws."""
    out = []
    for length_class in range(CLASSES):
        low = MIN_LENGTH << length_class
        drawn = zlib.crc32(seed.to_bytes(8, "little") + bytes([length_class]))
        size, style, need = low + drawn % low, drawn // 1024 % 3, 2 * low
        first = drawn % (len(words) or 1)
        own = words[first : first + need]
        plain = "".join(own if style == 0 else map(str.capitalize, own))[:size]
        if len(plain) == size:
            out.append(plain)
        digits = "".join(numbers[drawn % (len(numbers) or 1) :][:need])[:size]
        if len(digits) == size:
            out.append(digits)
        if own:
            number = numbers[drawn % len(numbers)] if numbers else str(len(words))
            tagged = [w if style else w.capitalize() for w in own]
            tagged.insert(min(len(tagged), 1 + drawn // 64 % 3), number)
            mixed = ("", "_", "-")[style].join(tagged)[:size]
            if len(mixed) == size:
                out.append(mixed)
    return out


_WORD, _NUMBER = re.compile(r"[A-Za-z]{2,}"), re.compile(r"[0-9]+")


def ordinary(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Family and bin of identifiers; those whose letters or digits alone do not reach
    MIN_BITS count like all others."""
    encodings = [encoding_of(t) for t in tokens]
    return np.array([family(t, e) for t, e in zip(tokens, encodings, strict=True)], np.int64), bins_of(battery(tokens, encodings))


@lru_cache(maxsize=1)
def fixed_null() -> dict[int, np.ndarray]:
    """By family, how many identifiers of WORDS and of dates and counters are in each bin."""
    rng = random.Random(5)
    out = defaultdict(lambda: np.zeros(MAX_BIN + 1, np.int64))
    for i in range(N_FIXED):
        words = rng.choices(WORDS, k=300)
        numbers = [f"{rng.randrange(1990, 2031)}{rng.randrange(1, 13):02}{rng.randrange(1, 29):02}" if rng.random() < 0.5 else str(int(10 ** rng.uniform(0, 5))) for _ in range(260)]
        for f, b in zip(*ordinary(identifiers(words, numbers, i)), strict=True):
            out[int(f)][b] += 1
    return dict(out)


SCANNED = "doc_id long, base array<struct<kind: string, start: bigint, end: bigint>>, found array<struct<start: bigint, end: bigint, family: int, bin: int>>, plain array<int>"


def scan(docs: DataFrame) -> DataFrame:
    """SCANNED: the base spans, the candidates, and the identifiers made of the text's
    words (family and bin as one number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in base_spans(t)] for t in texts]
            long = [max(map(len, t.encode().translate(_LONG).split()), default=0) >= MIN_LENGTH for t in texts]
            found = [candidates(t) if x else [] for t, x in zip(texts, long, strict=True)]
            flat = [c for own in found for c in own]
            bins = bins_of(battery([c[2] for c in flat], [c[3] for c in flat]))
            rows = iter([{"start": c[0], "end": c[1], "family": family(c[2], c[3]), "bin": int(b)} for c, b in zip(flat, bins, strict=True)])
            made = [identifiers(_WORD.findall(t), _NUMBER.findall(t), zlib.crc32(t.encode())) for t in texts]
            families, bins = ordinary([x for own in made for x in own])
            plain = np.split(families * (MAX_BIN + 1) + bins, np.cumsum([len(own) for own in made])[:-1])
            yield {"doc_id": batch.column("doc_id"), "base": base, "found": [[next(rows) for _ in own] for own in found], "plain": [x.tolist() for x in plain]}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCANNED)


def verdicts(found: dict[int, np.ndarray], null: dict[int, np.ndarray], rate: float = RATE) -> dict[int, tuple[int, np.ndarray]]:
    """By family: the last bin that is reported (-1 for none) and the p-value of each
    bin, from the counts of candidates and of ordinary identifiers by bin."""
    out = {}
    for f, seen in found.items():
        plain = null.get(f, np.zeros(MAX_BIN + 1, np.int64))
        p = (1 + np.cumsum(plain)) / (1 + plain.sum())
        passed = np.flatnonzero((seen > 0) & (p * seen.sum() <= rate * np.cumsum(seen)))
        out[f] = (int(passed[-1]) if len(passed) else -1, p)
    return out


def _counted(rows: DataFrame, value) -> dict[int, np.ndarray]:
    """Counts by family and bin: 12 families of MAX_BIN + 1 bins at most."""
    out: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(MAX_BIN + 1, np.int64))
    for r in rows.select(F.explode(value).alias("v")).groupBy("v").count().collect():
        out[r["v"] // (MAX_BIN + 1)][r["v"] % (MAX_BIN + 1)] += r["count"]
    return out


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base (array of kind, start, end), spans (base and random, each with p,
    null for base, by start, then kind)."""
    rows = staged(scan(docs), "scanned")
    null = _counted(rows, "plain")
    for f, counts in fixed_null().items():
        null[f] = null[f] + counts
    decided = verdicts(_counted(rows, F.transform("found", lambda c: c["family"] * (MAX_BIN + 1) + c["bin"])), null, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            spans = []
            for base, found in zip(batch.column("base").to_pylist(), batch.column("found").to_pylist(), strict=True):
                own = [s | {"p": None} for s in base]
                for c in found:
                    last, p = decided[c["family"]]
                    if c["bin"] <= last:
                        own.append({"kind": "random", "start": c["start"], "end": c["end"], "p": float(p[c["bin"]])})
                spans.append(sorted(own, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield {"doc_id": batch.column("doc_id"), "base": batch.column("base"), "spans": spans}

    return map_arrow(rows.select("doc_id", "base", "found"), run, "doc_id long, base array<struct<kind: string, start: bigint, end: bigint>>, spans array<struct<kind: string, start: bigint, end: bigint, p: double>>")


def _text(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    p = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] == "random"), lambda s: F.format_number(s["p"], 6)), ",").alias("p_random")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"), p)


QUERIES = {"op5_secret_scan": op5_secret_scan}
SQL: dict[str, str] = {}
