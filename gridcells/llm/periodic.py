"""Periodic runs of words by a suffix automaton with link-cut access (operator 12).

A run is a stretch of words with smallest period q, of at least twice q and ``min_length``
words, that no neighbouring word extends. The words of a text go into a suffix automaton.
Then they are appended once more, one by one: each recolours the path from its state to
the root of the suffix links with its own number, as the access of a link-cut tree does,
and so meets the path's segments of equal old colour, of which each is a last occurrence:
the words up to the new one and up to the old one agree in as many words as the segment's
deepest state is long. If the distance of the two ends is within that length, it is the
smallest period of a stretch of two periods or more, whose first word follows; the last
word that reports a stretch ends its run. As the links are complete before the first
access, the segments lie on heavy paths, always from the top, and a stack for each path
does what a splay tree would do: O(n log n) in all for n words, whatever their periods.

Only words inside a repeated ``min_length // 2``-gram of their text go into automata, each
stretch of them into one. That loses nothing: in a run of L words and period q every gram
that begins in the first L - q - min_length // 2 + 1 words occurs again q words later, and
these grams and their repetitions cover the run.

Edge cases: null text has no words; a text without runs has an empty list and stays as it
is but for its white space; runs that overlap or nest are all reported, ties of length by
start, then period; repeated rows are treated alike; texts of any length are read whole,
one at a time beyond 16 MB (an automaton takes some 600 bytes for each word of a
repetitive stretch, anything else some 100); an empty table gives no rows; further columns
stay, but those named like the added ones, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridcells.llm.batches import slices, sql_crc32, utf8
from gridcells.runtime import ship, spread, table

MIN_LENGTH = 12
ADDED = {"n_words": "bigint", "runs": "array<struct<start: bigint, length: bigint, period: bigint>>", "collapsed": "string"}


def suffix_automaton(codes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and length of each state, and the state of each prefix."""
    follow: list[dict[int, int]] = [{}]
    link, length, prefix, last = [-1], [0], [], 0
    for n, c in enumerate(codes, 1):
        state, p = len(follow), last
        follow.append({})
        link.append(0)
        length.append(n)
        while p >= 0 and c not in follow[p]:
            follow[p][c] = state
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] != length[p] + 1:
                split = len(follow)
                follow.append(follow[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = split
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = split
                    p = link[p]
                q = split
            link[state] = q
        prefix.append(state)
        last = state
    return link, length, prefix


def heavy_tops(link: list[int], length: list[int]) -> list[int]:
    """The topmost state of the heavy path of each state."""
    order = np.argsort(np.array(length), kind="stable").tolist()
    size, heavy = [1] * len(link), [0] * len(link)
    for v in reversed(order[1:]):
        size[link[v]] += size[v]
    for v in order[1:]:
        u = link[v]
        if not heavy[u] or size[v] > size[heavy[u]]:
            heavy[u] = v
    top = list(range(len(link)))
    for v in order[1:]:
        if heavy[link[v]] == v:
            top[v] = top[link[v]]
    return top


def squares(codes: list[int]) -> dict[tuple[int, int], int]:
    """End (exclusive) of each run of two periods or more, by start and period."""
    link, length, prefix = suffix_automaton(codes)
    top = heavy_tops(link, length)
    # of each heavy path the segments from its deepest to its topmost: length of the
    # segment's deepest state, and its colour
    paths: list[list[tuple[int, int]] | None] = [None] * len(link)
    ends: dict[tuple[int, int], int] = {}
    for i, state in enumerate(prefix):
        before = -1  # the colour met last on the path below
        while state > 0:
            head = top[state]
            segments = paths[head]
            if segments is None:
                segments = paths[head] = []
            deep, reached, highest = length[state], 0, -1
            while segments and reached < deep:
                reached, old = segments[-1]
                if reached <= deep:
                    segments.pop()
                else:
                    reached = deep
                if highest < 0:
                    highest = old
                # a colour that goes on from the path below is known at its deepest
                if old != before and i - old <= reached:
                    ends[i - reached - (i - old) + 1, i - old] = i + 1
            if highest >= 0:
                before = highest
            segments.append((deep, i))
            state = link[head]
    return ends


def runs_of(words: list[bytes], recurring: np.ndarray, min_length: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period; only words marked
    in ``recurring`` are looked at."""
    out = []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], recurring, [False]]).astype(np.int8)))
    for first, after in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        number: dict[bytes, int] = {}
        codes = [number.setdefault(w, len(number)) for w in words[first:after]]
        out += [(first + start, end - start, period) for (start, period), end in squares(codes).items() if end - start >= min_length]
    return sorted(out, key=lambda r: (r[0], r[2]))


def recurring_words(texts: list[list[bytes]], gram: int) -> list[np.ndarray]:
    """For the words of each text, whether they lie in a ``gram`` of words that the text
    has twice or more. (Grams are compared by 64-bit hashes: one too many does no harm.)"""
    sizes = np.array([len(w) for w in texts])
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    covered = np.zeros(total + 1, np.int64)
    if total >= gram:
        own = np.fromiter((hash(w) for words in texts for w in words), np.int64, total).view(np.uint64)
        factors = np.random.default_rng(3).integers(1, 1 << 63, gram + 1, np.uint64) * np.uint64(2) + np.uint64(1)
        starts = np.flatnonzero(np.arange(total) + gram <= np.repeat(ends, sizes))
        key = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)[starts] * factors[gram]
        for k in range(gram):
            key += own[starts + k] * factors[k]
            key ^= key >> np.uint64(29)
        known = np.sort(key)
        twice = np.unique(known[1:][known[1:] == known[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            found = starts[twice[at] == key]
            np.add.at(covered, found, 1)
            np.add.at(covered, found + gram, -1)
    return np.split(np.cumsum(covered[:-1]) > 0, ends[:-1])


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that any run has after its first
    period."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
    return b" ".join(words)


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """All columns of ``docs``, then n_words, runs (word number of the start, length and
    period, by start, then period) and collapsed, the text with each run cut to its first
    period."""
    if min_length < 2:
        raise ValueError("a run has two words or more")
    base = docs.drop(*ADDED)
    names, schema = base.columns, StructType([*base.schema.fields, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in ADDED.items()))])
    arrow = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t.split() for t in utf8(batch)]
            found = [runs_of(w, r, min_length) if r.any() else [] for w, r in zip(texts, recurring_words(texts, min_length // 2), strict=True)]
            columns = {n: batch.column(n) for n in names}
            columns["n_words"] = pa.array([len(w) for w in texts], pa.int64())
            columns["runs"] = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in x] for x in found], arrow)
            columns["collapsed"] = pa.array([collapsed(w, x) for w, x in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in schema.names})

    ship(docs.sparkSession)
    return base.mapInArrow(run, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for one id in ten its words with a period from some word on: with h
    the CRC-32 of the id in decimal and g = h div 10, where h mod 10 = 0, word i of n is
    word a + (i - a) mod p from a = g mod n on, p = 1 + (n - a) div (3 + g mod 8)."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def periodic(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        block = F.slice(words, a + 1, p)
        rest = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), rest), " ")).otherwise("")

    # a transform of one element binds the words once
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.when(h % 10 == 0, F.transform(F.array(words), periodic)[0]).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = find_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    start, period, length = -F.col("top.before"), -F.col("top.shorter"), F.col("top.length")
    milli = F.floor(1000 * length / period)
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
_GRAM = MIN_LENGTH // 2
SQL = {
    "op12_periodic_runs": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {sql_crc32("coalesce(doc_id::VARCHAR, '')")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
e AS (SELECT rid, doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS is_planted, (h // 10) % greatest(len(ws), 1) AS a, (h // 10) % 8 AS r FROM d),
f AS (SELECT rid, doc_id, n, CASE WHEN is_planted THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + r)) END]) ELSE ws END AS ws FROM e),
-- grams of half a run recur at the distance of the period
gr AS (SELECT rid, i, array_to_string(ws[i + 1:i + {_GRAM}], ' ') AS s FROM f, LATERAL (SELECT unnest(range(greatest(n - {_GRAM} + 1, 0))) AS i) t),
pr AS (SELECT x.rid, y.i - x.i AS q, x.i FROM gr x JOIN gr y ON x.rid = y.rid AND x.s = y.s AND x.i < y.i),
isl AS (SELECT rid, q, min(i) AS start, count(*) + {_GRAM - 1} + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM pr) z GROUP BY rid, q, k),
rn AS (SELECT rid, start, length, min(q) AS period FROM isl WHERE length >= greatest({MIN_LENGTH}, 2 * q) GROUP BY rid, start, length),
best AS (SELECT rid, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, {{'a': -length, 'b': start, 'c': period}}) AS b,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM rn GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM rn),
lost AS (SELECT rid, list(i) AS spots FROM gone GROUP BY rid),
kept AS (SELECT f.rid, CASE WHEN spots IS NULL THEN ws ELSE list_filter(list_transform(range(n), lambda i: CASE WHEN NOT list_contains(spots, i) THEN ws[i + 1] END), lambda w: w IS NOT NULL) END AS ws FROM f LEFT JOIN lost ON f.rid = lost.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000 * b.l // b.p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(array_to_string(kept.ws, ' ')) AS collapsed_sha256
FROM f JOIN kept ON f.rid = kept.rid LEFT JOIN best ON f.rid = best.rid
"""
}
