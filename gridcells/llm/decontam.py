"""Benchmark decontamination with an Aho-Corasick automaton (operator 4).

Items and documents are normalised alike (ASCII lower case, words between all else).
A hit is a run of ``window`` words of an item, or a whole shorter item. The automaton
holds, of every item, blocks of half a window at such steps that each window covers
exactly one block, so it grows with the words of the benchmark, not with the windows
times their length. It runs over each document's words once; where a block is found,
the few words around it decide which windows are there. Hits are mapped back to word
numbers and to code-point offsets of the original text.

Words of the automaton are written as three characters each, of one alphabet per
place; words that no item has are one character that no pattern has. A benchmark over
GROUP_WORDS words is dealt out to several automata, all run in the same pass over the
texts, one after the other in memory; each is built once, by a task, and broadcast, so
what is built, sent and held at once is bounded however large the benchmark is.

Of an item only places with different words around them are kept, and a document's hits
are merged as they are found: texts and items of a few words, again and again, take time
and memory by their words, not by the pairs of equal places.

Edge cases: null text has no words; an item without words has no windows; item ids
are strings here, rows of one id are one item, and so are rows without id, which
count but have no name; an item that ends where a text ends, or windows that touch
(ties), are hit like others; texts and items of any length are read whole; an empty
table gives no rows; an empty benchmark hits nothing; further columns of the input
stay, but those named like the added ones, which are replaced.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridcells.llm.batches import map_arrow, slices, utf8
from gridcells.runtime import spread, staged, table

WINDOW = 10
#: Words of the items of one automaton, on average (some 300 bytes each in a worker),
#: and the most of one piece of an item, by which they are dealt.
GROUP_WORDS, PIECE_WORDS = 1_000_000, 10_000
#: What a worker remembers of blocks and the words around them: their hits.
KNOWN = 1 << 16
#: Text that a task holds while it goes through several automata.
HOLD_BYTES = 64 << 20
#: a-z, 0-9 and bytes over 127 stay, A-Z are lowered, all else is a space.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
#: First characters of the three alphabets, each as large as the vocabulary needs.
_ALPHABETS, _OTHER = (0x100, 0x1000, 0x2000), "\x01"


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def pieces(items: DataFrame, window: int, piece_words: int = PIECE_WORDS) -> DataFrame:
    """item, words (joined by a space), n, n_item: items in pieces that overlap by a
    window less one word, so every window lies within a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            out = []
            for item, text in zip(batch.column("item").to_pylist(), utf8(batch), strict=True):
                w = words(text)
                for at in range(0, max(1, len(w) - window + 1), piece_words):
                    own = w[at : at + piece_words + window - 1]
                    if own:
                        out.append((item, b" ".join(own).decode(), len(own)))
            yield dict(zip(("item", "words", "n"), zip(*out, strict=True), strict=True)) if out else {"item": [], "words": [], "n": []}

    return map_arrow(items.select(F.col("item_id").cast("string").alias("item"), "text").distinct(), run, "item string, words string, n long")


class Group:
    """Items under one automaton. A pattern is a tuple of word numbers; ``at[starts[k]:
    starts[k + 1]]`` are places (in ``codes``) where pattern k stands, of places with the
    same words around them in one item only one; ``whole`` tells patterns of short items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.window, self.block = window, (window + 1) // 2
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.items = [item for item, _ in items]
        # stop signs between items equal no word of a document
        coded = [np.array([*map(number, text.encode().split()), *repeat(-1, window)], np.int32) for _, text in items]
        sizes = np.array([len(c) - window for c in coded], np.int64)
        self.codes = np.concatenate([np.full(window, -1, np.int32), *coded])
        self.item_ends = window + np.cumsum(sizes + window)
        places: dict[tuple, list[int]] = {}
        for codes, end in zip(coded, self.item_ends, strict=True):
            n = len(codes) - window
            start = int(end) - len(codes)
            length, step = (self.block, window - self.block + 1) if n >= window else (n, 1)
            for at in range(0, n - length + 1, step):
                places.setdefault((n < window, *codes[at : at + length].tolist()), []).append(start + at)
        base = max(2, int(np.ceil((len(self.vocabulary) + 1) ** (1 / 3))))
        self.spelt = [_OTHER, *("".join(chr(a + d) for a, d in zip(_ALPHABETS, (k // base**2, k // base % base, k % base), strict=True)) for k in range(len(self.vocabulary)))]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        length, whole, kept = [], [], []
        found: dict[str, list[int]] = {}
        for (short, *key), at in places.items():
            found.setdefault("".join(self.spelt[k] for k in key), []).append(len(length))
            length.append(len(key))
            whole.append(short)
            kept.append(self._apart(np.array(at, np.int64), len(key)))
        self.length, self.whole = np.array(length, np.int32), np.array(whole, bool)
        self.at = np.concatenate([np.zeros(0, np.int64), *kept])
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int64)
        # of a spelling the pattern, and a second one where a block and an item are spelt alike
        self.first = np.array([x[0] for x in found.values()], np.int32)
        self.second = {i: x[1] for i, x in enumerate(found.values()) if len(x) > 1}
        for i, spelling in enumerate(found):
            self.machine.add_word(spelling, i)
        self.machine.make_automaton()
        self.known: dict[tuple[int, bytes], tuple] = {}

    def _apart(self, at: np.ndarray, length: int) -> np.ndarray:
        """Of the places of a block, one of each item and words around it: others are hit
        alike. So a long item of few words has few places."""
        if len(at) < 2:
            return at
        side = self.window - self.block
        around = self.codes[at[:, None] + np.arange(-side, length + side)]
        item = np.searchsorted(self.item_ends, at, "right")
        return at[np.sort(np.unique(np.column_stack([item, around]), axis=0, return_index=True)[1])]

    def _meets(self, pattern: int, words: np.ndarray) -> tuple[tuple[int, int, int], ...]:
        """Item, and the words hit to the left and to the right of the block, for the
        items of which a window covers the block; ``words`` are the block's and ``side``
        more on either side of it."""
        at = self.at[self.starts[pattern] : self.starts[pattern + 1]]
        item = np.searchsorted(self.item_ends, at, "right")
        if self.whole[pattern]:
            return tuple((int(i), 0, 0) for i in np.unique(item))
        side = self.window - self.block
        same = self.codes[at[:, None] + np.arange(-side, self.block + side)] == words
        left = np.cumprod(same[:, :side][:, ::-1], axis=1).sum(1)
        right = np.cumprod(same[:, side + self.block :], axis=1).sum(1)
        reach: dict[int, tuple[int, int]] = {}
        for k in np.flatnonzero(left + right >= side):
            was = reach.get(int(item[k]), (0, 0))
            # all of them cover the block, so their union is one run
            reach[int(item[k])] = max(was[0], int(left[k])), max(was[1], int(right[k]))
        return tuple((i, a, b) for i, (a, b) in reach.items())

    def hits(self, text_words: list[bytes]) -> list[tuple[int, int, int]]:
        """(item number, first word, word after the last) of the runs of windows found:
        merged as they come, so a text of few words, again and again, takes no more memory
        or time than another one."""
        if not len(self.machine):
            return []
        numbers = np.fromiter(map(self.vocabulary.get, text_words, repeat(0)), np.int32, len(text_words))
        spelt = list(map(self.spelt.__getitem__, numbers.tolist()))
        text = "".join(spelt)
        word_of, padded, side = None, None, self.window - self.block
        runs: dict[int, list[list[int]]] = {}
        # of blocks and of short items, what is hit by places one after the other
        pending: dict[bool, list] = {}

        def put(meets: tuple, first: int, last: int, length: int) -> None:
            for item, left, right in meets:
                own, a, b = runs.setdefault(item, []), first - left, last + length + right
                if own and own[-1][0] <= b and a <= own[-1][1]:
                    own[-1][:] = min(a, own[-1][0]), max(b, own[-1][1])
                else:
                    own.append([a, b])

        for end, spelling in self.machine.iter(text):
            if word_of is None:
                word_of = np.repeat(np.arange(len(spelt), dtype=np.int32), np.fromiter(map(len, spelt), np.int64, len(spelt)))
                padded = np.concatenate([np.zeros(self.window, np.int32), numbers, np.zeros(self.window, np.int32)])
            for pattern in (int(self.first[spelling]), self.second.get(spelling)):
                if pattern is None:
                    continue
                length, short = int(self.length[pattern]), bool(self.whole[pattern])
                first = int(word_of[end]) + 1 - length
                words = padded[:0] if short else padded[self.window + first - side : self.window + first + length + side]
                key = pattern, words.tobytes()
                meets = self.known.get(key)
                if meets is None:
                    if len(self.known) >= KNOWN:
                        self.known.clear()
                    meets = self.known[key] = self._meets(pattern, words)
                if not meets:
                    continue
                was = pending.get(short)
                if was and was[0] is meets and first == was[2] + 1:
                    was[2] = first
                else:
                    if was:
                        put(*was)
                    pending[short] = [meets, first, first, length]
        for was in pending.values():
            put(*was)
        return [(item, a, b) for item, own in runs.items() for a, b in own]


def merged(found: list[tuple[str | None, int, int]]) -> list[tuple[str | None, int, int]]:
    """Runs of overlapping or touching windows, item by item."""
    out: list[list] = []
    for item, first, after in sorted(found, key=lambda h: (h[0] is not None, h[0] or "", h[1], h[2])):
        if out and out[-1][0] == item and first <= out[-1][2]:
            out[-1][2] = max(out[-1][2], after)
        else:
            out.append([item, first, after])
    return [tuple(x) for x in out]


def digest(found: list[tuple[str | None, int, int]], text: bytes) -> dict:
    """Of one document's hits: words hit, items, and the original spans of runs of
    words hit (start and end in code points)."""
    runs = merged([("", first, after) for _, first, after in found])
    items = {h[0] for h in found}
    names = sorted(i for i in items if i is not None)
    spans = []
    if runs:
        points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
        spans = [[int(points[at[first][0]]), int(points[at[after - 1][1]])] for _, first, after in runs]
    return {"n_hit": sum(after - first for _, first, after in runs), "item_ids": names, "n_items": len(items), "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(), "spans": spans}


ADDED = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "item_ids": "array<string>", "items_sha256": "string", "spans": "array<array<int>>", "hits": "array<struct<item: string, first: int, after: int>>"}


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, group_words: int = GROUP_WORDS) -> DataFrame:
    """All columns of ``docs``, then ADDED (which replace columns of those names):
    ``hits`` are runs of words (first, after) by item, ``spans`` the code points
    (start, end) of runs of words hit by any item."""
    context = docs.sparkSession.sparkContext
    cut = staged(pieces(items, window), "items")
    n_groups = max(1, -(-(cut.agg(F.sum("n")).first()[0] or 0) // group_words))
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("item", "words"), F.lit(n_groups)))
    # each automaton is built once, by a task; one bounded group at a time passes the driver
    groups = [context.broadcast(_built(dealt.where(F.col("grp") == g).select("item", "words"), window)) for g in range(n_groups)]
    key = uuid.uuid4().hex if n_groups == 1 else None
    base = docs.drop(*ADDED)
    names, schema = base.columns, StructType([*base.schema.fields, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in ADDED.items()))])
    arrow = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "item_ids": pa.list_(pa.string()), "items_sha256": pa.string(), "spans": pa.list_(pa.list_(pa.int32())), "hits": pa.list_(pa.struct([("item", pa.string()), ("first", pa.int32()), ("after", pa.int32())]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: list = [None, None]
        for held in _held(slices(batches), HOLD_BYTES if n_groups > 1 else 0):
            found: list[list] = [[] for batch in held for _ in range(batch.num_rows)]
            for g, broadcast in enumerate(groups):
                if loaded[0] != g:
                    loaded = [None, None]  # the automaton before goes first
                    loaded = [g, _group(broadcast, key)]
                group, texts = loaded[1], (t for batch in held for t in utf8(batch))
                for own, text in zip(found, texts, strict=True):
                    own.extend((group.items[i], first, after) for i, first, after in group.hits(words(text)))
            at = 0
            for batch in held:
                texts, own = utf8(batch), [merged(x) for x in found[at : at + batch.num_rows]]
                at += batch.num_rows
                new = [digest(h, t) for h, t in zip(own, texts, strict=True)]
                columns = {n: batch.column(n) for n in names} | {n: pa.array([d[n] for d in new], arrow[n]) for n in ("n_hit", "item_ids", "n_items", "items_sha256", "spans")}
                columns["n_words"] = pa.array([len(words(t)) for t in texts], pa.int64())
                columns["hits"] = pa.array([[dict(zip(("item", "first", "after"), h, strict=True)) for h in x] for x in own], arrow["hits"])
                yield pa.RecordBatch.from_pydict({n: columns[n] for n in schema.names})

    return base.mapInArrow(run, schema)


def _built(items: DataFrame, window: int) -> bytes:
    """The automaton of a group of items, made by one task and pickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist(), strict=True)]
        rows.sort(key=lambda r: (r[0] is not None, r))
        yield pa.RecordBatch.from_pydict({"made": pa.array([pickle.dumps(Group(rows, window), 5)], pa.binary())})

    return bytes(items.coalesce(1).mapInArrow(run, "made binary").first()["made"])


_LOADED: dict[str, Group] = {}


def _group(broadcast: Broadcast, key: str | None) -> Group:
    """A worker keeps the automaton of a benchmark that has one (``key``) for its next
    tasks. Of others it keeps none, nor what they are read from."""
    if key in _LOADED:
        return _LOADED[key]
    group = pickle.loads(broadcast.value)
    vars(broadcast).pop("_value", None)
    if key is not None:
        _LOADED.clear()
        _LOADED[key] = group
    return group


def _held(batches: Iterator[pa.RecordBatch], n_bytes: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of batches of about that many bytes of text, of one batch at least."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= n_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(n_hit: Column) -> Column:
    return n_hit > 0


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s[0], s[1])), ",").alias("spans")
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", contaminated(F.col("n_hit")).alias("contaminated"), spans)


QUERIES = {"op4_decontaminate": op4_decontaminate}
_SQL_GAPS = r"string_split_regex(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op4_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS ws, {_SQL_GAPS} AS gaps FROM documents),
it AS (SELECT item_id, {_SQL_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS k, array_to_string(ws[i:i + least(len(ws), {WINDOW}) - 1], ' ') AS s
       FROM it, LATERAL (SELECT unnest(range(1, greatest(len(ws) - {WINDOW}, 0) + 2)) AS i) t WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT rid, i, k, array_to_string(ws[i:i + k - 1], ' ') AS s
       FROM (SELECT * FROM d, ks WHERE len(ws) >= k) x, LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS i) t),
hit AS (SELECT rid, i, dw.k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.s = iw.s),
hp AS (SELECT DISTINCT rid, unnest(range(i, i + k)) AS p FROM hit),
nh AS (SELECT rid, count(*) AS n_hit FROM hp GROUP BY rid),
runs AS (SELECT rid, min(p) AS a, max(p) AS b FROM (SELECT *, p - row_number() OVER (PARTITION BY rid ORDER BY p) AS g FROM hp) x GROUP BY rid, g),
wl AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word, unnest(gaps) AS gap FROM d WHERE rid IN (SELECT rid FROM nh)),
pl AS (SELECT rid, p, sum(length(word) + length(gap)) OVER (PARTITION BY rid ORDER BY p) AS stop, length(word) AS size FROM wl WHERE word IS NOT NULL),
sp AS (SELECT runs.rid, string_agg((s.stop - s.size) || ':' || e.stop, ',' ORDER BY runs.a) AS spans
       FROM runs JOIN pl s ON s.rid = runs.rid AND s.p = runs.a JOIN pl e ON e.rid = runs.rid AND e.p = runs.b GROUP BY runs.rid),
ni AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT rid, item_id FROM hit) h GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN nh ON d.rid = nh.rid LEFT JOIN ni ON d.rid = ni.rid LEFT JOIN sp ON d.rid = sp.rid
"""
}
