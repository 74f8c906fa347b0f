"""Reversible line deduplication (operator 2).

Two structures hold the state. The exact reference-count table has one row per
line key (128-bit digest) with the number of documents that contain it. For the
keys at or over the threshold, cuckoo filters, sharded by key, answer the probes
of a text scan; each filter slot points at the exact key beside it, so a probe is
verified on the spot. Inserting documents adds to the counts, deleting them
subtracts, and the filters follow with insertions and deletions of the keys
that crossed the threshold: insert then delete leaves the state as it was. Filters
that outgrow their shards are dealt out to more of them.

A scan sends each distinct key of a document to the filter of its shard, with the
shuffle that also sorts each filter before its keys, so a task holds one filter and a
batch of keys, however many there are. Only keys so frequent that they would burden
their shard (over one HOT_KEYS-th of all, hence at most HOT_KEYS keys) are in a filter
that all tasks have. The places found go back to the documents in a join, which Spark does by a broadcast
below its threshold of size and by a shuffle above.

Edge cases: each row is a document, also if rows or ids repeat; a key in exactly
min_docs documents (a tie with the threshold) is dropped; null or empty text is one
empty line, kept; a key without a code point never counts; texts of any length are
read whole; an empty table gives no rows; further columns of the input stay, but
those named n_lines or n_dropped, which are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridcells.llm.batches import free_name, map_arrow, slices, utf8
from gridcells.runtime import shuffle_partitions, spread, staged, table

MIN_DOCS = 10
SPACES = b" \t\n\v\f\r"
#: Keys per filter shard on average when the filters are built; they are dealt out
#: anew at twice as many.
SHARD_KEYS = 50_000
#: The most keys of the filter that all tasks have (about 30 bytes each).
HOT_KEYS = 100_000
#: Distinct keys that a task counts before it hands them on.
FLUSH_KEYS = 200_000
SLOTS, MAX_KICKS = 4, 500


def line_keys(text: bytes) -> list[bytes]:
    """Digest of each line's key; empty for a key without a code point."""
    keys = (line.strip(SPACES).lower() for line in text.split(b"\n"))
    return [xxhash.xxh3_128_digest(k) if k else b"" for k in keys]


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four, two buckets per key, each
    slot with its exact 128-bit key (two words) beside it."""

    def __init__(self, capacity: int = 16):
        size = 1
        while size * SLOTS * 0.8 < capacity:
            size *= 2
        self.prints = np.zeros((size, SLOTS), np.uint16)
        self.keys = np.zeros((size, SLOTS, 2), np.uint64)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """Of distinct keys: those that find room in their first bucket at once, the
        others one by one."""
        out = cls(len(keys))
        if not len(keys):
            return out
        prints, first, _ = out._where(keys)
        order = np.argsort(first, kind="stable")
        nth = np.arange(len(keys)) - np.searchsorted(first[order], first[order])
        now = order[nth < SLOTS]
        out.prints[first[now], nth[nth < SLOTS]], out.keys[first[now], nth[nth < SLOTS]] = prints[now], keys[now]
        for key in keys[order[nth >= SLOTS]]:
            out.insert(key)
        return out

    def _where(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.prints) - 1)
        prints = (keys[:, 0] >> np.uint64(48)) | np.uint64(1)
        first = keys[:, 1] & mask
        return prints.astype(np.uint16), first, self._other(first, prints)

    def _other(self, bucket, prints):
        mixed = (np.asarray(prints, np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(7)
        return (bucket ^ mixed) & np.uint64(len(self.prints) - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys (n x 2 words) are held: fingerprints first, then
        the exact keys where one matches."""
        prints, first, second = self._where(keys)
        found = np.zeros(len(keys), bool)
        for bucket in (first, second):
            row, slot = np.nonzero(self.prints[bucket] == prints[:, None])
            same = (self.keys[bucket[row], slot] == keys[row]).all(axis=1)
            found[row[same]] = True
        return found

    def insert(self, key: np.ndarray) -> None:
        if self.contains(key[None])[0]:
            return
        rng = np.random.default_rng(int(key[0]) & 0xFFFF)
        prints, first, second = (x[0] for x in self._where(key[None]))
        bucket = first
        for step in range(MAX_KICKS):
            for b in (first, second) if step == 0 else (bucket,):
                free = np.flatnonzero(self.prints[b] == 0)
                if len(free):
                    self.prints[b, free[0]], self.keys[b, free[0]] = prints, key
                    return
            slot = int(rng.integers(SLOTS))
            moved, moved_key = self.prints[bucket, slot], self.keys[bucket, slot].copy()
            self.prints[bucket, slot], self.keys[bucket, slot] = prints, key
            prints, key = moved, moved_key
            bucket = self._other(bucket, prints)
        self._grow(key)

    def _grow(self, key: np.ndarray) -> None:
        held = np.concatenate([self.all_keys(), key[None]])
        self.__init__(len(self.prints) * 2 * SLOTS * 4 // 5)
        for k in held:
            self.insert(k)

    def delete(self, key: np.ndarray) -> bool:
        prints, first, second = (x[0] for x in self._where(key[None]))
        for b in (first, second):
            for slot in np.flatnonzero(self.prints[b] == prints):
                if (self.keys[b, slot] == key).all():
                    self.prints[b, slot], self.keys[b, slot] = 0, 0
                    return True
        return False

    def all_keys(self) -> np.ndarray:
        return self.keys[self.prints != 0]

    def dump(self) -> tuple[bytes, bytes]:
        return self.prints.tobytes(), self.keys.tobytes()

    @classmethod
    def load(cls, prints: bytes, keys: bytes) -> CuckooFilter:
        out = cls(1)
        out.prints = np.frombuffer(prints, np.uint16).reshape(-1, SLOTS).copy()
        out.keys = np.frombuffer(keys, np.uint64).reshape(-1, SLOTS, 2).copy()
        return out


def words_of(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)


@dataclass
class LineIndex:
    """refs: key, n_docs of every key; filters: shard, prints, keys of those at
    or over min_docs."""

    refs: DataFrame
    filters: DataFrame
    n_shards: int
    min_docs: int


def reference_counts(docs: DataFrame) -> DataFrame:
    """key (binary), n_docs: documents that hold a line of this key. Tasks count
    first, so a key in every document costs one row per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: Counter[bytes] = Counter()
        for batch in slices(batches):
            for text in utf8(batch):
                counts.update(set(line_keys(text)))
            if len(counts) > FLUSH_KEYS:
                counts.pop(b"", None)
                yield {"key": list(counts), "n": list(counts.values())}
                counts.clear()
        counts.pop(b"", None)
        yield {"key": list(counts), "n": list(counts.values())}

    return map_arrow(docs.select("text"), run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n_docs"))


def _shard(key, n_shards: int):
    return F.pmod(F.xxhash64(key), F.lit(n_shards)).cast("int")


FILTER_SCHEMA = "shard int, prints binary, keys binary"


def _heavy(refs: DataFrame, min_docs: int) -> DataFrame:
    return refs.where(F.col("n_docs") >= min_docs).select("key")


def _indexed(refs: DataFrame, min_docs: int) -> LineIndex:
    """The index over these counts, with all filters new."""
    n_shards = max(shuffle_partitions(refs.sparkSession), -(-_heavy(refs, min_docs).count() // SHARD_KEYS))
    crossed = _heavy(refs, min_docs).withColumn("add", F.lit(True))
    return LineIndex(refs, staged(_filters(None, crossed, n_shards), "filters"), n_shards, min_docs)


def build_index(docs: DataFrame, min_docs: int = MIN_DOCS) -> LineIndex:
    return _indexed(staged(reference_counts(docs), "refs"), min_docs)


def _filters(old: DataFrame | None, crossed: DataFrame, n_shards: int) -> DataFrame:
    """The filters after the crossed keys (key, add) went in or out; shards are
    bounded by SHARD_KEYS on average, since keys are digests."""

    def change(held: CuckooFilter | None, delta: pd.DataFrame) -> CuckooFilter:
        if held is None and delta["add"].all():
            return CuckooFilter.of(words_of(delta["key"].tolist()))
        held = held or CuckooFilter(len(delta))
        for key, add in zip(words_of(delta["key"].tolist()), delta["add"], strict=True):
            if add:
                held.insert(key)
            else:
                held.delete(key)
        return held

    def fresh(shard: tuple, delta: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(shard[0], *change(None, delta).dump())], columns=["shard", "prints", "keys"])

    def update(shard: tuple, rows: pd.DataFrame, delta: pd.DataFrame) -> pd.DataFrame:
        held = CuckooFilter.load(rows["prints"].iloc[0], rows["keys"].iloc[0]) if len(rows) else None
        return pd.DataFrame([(shard[0], *change(held, delta).dump())], columns=["shard", "prints", "keys"])

    delta = crossed.withColumn("shard", _shard(F.col("key"), n_shards))
    if old is None:
        return delta.groupBy("shard").applyInPandas(fresh, FILTER_SCHEMA)
    return old.groupBy("shard").cogroup(delta.groupBy("shard")).applyInPandas(update, FILTER_SCHEMA)


def _changed(index: LineIndex, docs: DataFrame, sign: int) -> LineIndex:
    delta = reference_counts(docs).select("key", (F.col("n_docs") * sign).alias("d"))
    counts = (
        index.refs.select("key", F.col("n_docs").alias("was"), F.lit(0).cast("long").alias("d"))
        .unionByName(delta.select("key", F.lit(0).cast("long").alias("was"), "d"))
        .groupBy("key").agg(F.sum("was").alias("was"), (F.sum("was") + F.sum("d")).alias("n_docs"))
    )
    counts = staged(counts, "counts")
    over = lambda c: F.col(c) >= index.min_docs
    crossed = counts.where(over("was") != over("n_docs")).select("key", over("n_docs").alias("add"))
    refs = counts.where("n_docs > 0").select("key", "n_docs")
    if _heavy(refs, index.min_docs).count() > 2 * SHARD_KEYS * index.n_shards:
        return _indexed(refs, index.min_docs)
    return LineIndex(refs, staged(_filters(index.filters, crossed, index.n_shards), "filters"), index.n_shards, index.min_docs)


def insert_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    return _changed(index, docs, 1)


def delete_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """``docs``: whole rows that were inserted before."""
    return _changed(index, docs, -1)


def _hot_filter(index: LineIndex) -> CuckooFilter:
    """Of the keys that each make up over one HOT_KEYS-th of all."""
    total = index.refs.agg(F.sum("n_docs")).first()[0] or 0
    keys = [r["key"] for r in _heavy(index.refs, max(index.min_docs, total // HOT_KEYS + 1)).collect()]  # at most HOT_KEYS
    return CuckooFilter.of(words_of(keys))


def _found(held: CuckooFilter, keys: list[bytes]) -> np.ndarray:
    """Which of the digests (or empty strings, never held) the filter has."""
    out = np.zeros(len(keys), bool)
    real = np.flatnonzero([bool(k) for k in keys])
    if len(real):
        out[real] = held.contains(words_of([keys[i] for i in real]))
    return out


def _probed(keys: DataFrame, index: LineIndex) -> DataFrame:
    """The row and nth of those of ``keys`` (row, nth, key) that are in the filter of
    their shard."""
    asked = keys.select(_shard(F.col("key"), index.n_shards).alias("shard"), F.lit(1).alias("kind"), "row", "nth", "key", F.lit(None).cast("binary").alias("prints"))
    filters = index.filters.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("nth"), F.col("keys").alias("key"), "prints")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shard, held = -1, CuckooFilter()
        for batch in batches:
            shards, kinds = (batch.column(c).to_numpy() for c in ("shard", "kind"))
            edges = [0, *(np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1), batch.num_rows]
            for low, high in zip(edges, edges[1:], strict=False):
                if high > low and kinds[low] == 0:
                    shard, held = shards[low], CuckooFilter.load(batch.column("prints")[low].as_py(), batch.column("key")[low].as_py())
                elif high > low and shard == shards[low]:
                    hit = pa.array(_found(held, batch.column("key").slice(low, high - low).to_pylist()))
                    yield {c: batch.column(c).slice(low, high - low).filter(hit) for c in ("row", "nth")}

    return map_arrow(filters.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind"), run, "row long, nth int")


OUT = ("n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, index: LineIndex) -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten, then n_lines and n_dropped
    (which replace columns of those names). A text that loses nothing stays as it is
    (null too)."""
    hot = docs.sparkSession.sparkContext.broadcast(_hot_filter(index))
    base = docs.drop(*OUT)
    row, gone = free_name(base, "row"), free_name(base, "gone")
    numbered = staged(base.withColumn(row, F.monotonically_increasing_id()), "numbered")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            own = [list(dict.fromkeys(line_keys(t))) for t in utf8(batch)]
            flat = [k for keys in own for k in keys]
            sizes = [len(keys) for keys in own]
            rest = ~_found(hot.value, flat) & np.array([bool(k) for k in flat], bool)
            rows = np.repeat(batch.column("row").to_numpy(), sizes)
            nth = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield {"row": rows[rest], "nth": nth[rest].astype(np.int32), "key": [flat[i] for i in np.flatnonzero(rest)]}

    keys = map_arrow(numbered.select(F.col(row).alias("row"), "text"), ask, "row long, nth int, key binary")
    # written, so Spark knows its size when it chooses the join: texts move only where
    # the places are too many to go to all tasks
    places = staged(_probed(keys, index).groupBy("row").agg(F.collect_list("nth").alias(gone)).withColumnRenamed("row", row), "places")
    joined = numbered.join(places, row, "left").select(*base.columns, gone)
    names, schema = base.columns, StructType([*base.schema.fields]).add("n_lines", "long").add("n_dropped", "long")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lines = [t.split(b"\n") for t in utf8(batch)]
            keys = [line_keys(t) for t in utf8(batch)]
            hits = np.split(_found(hot.value, [k for own in keys for k in own]), np.cumsum([len(own) for own in keys])[:-1])
            for own, hit, nths in zip(keys, hits, batch.column(gone).to_pylist(), strict=True):
                if nths:
                    distinct = list(dict.fromkeys(own))
                    drop = {distinct[i] for i in nths}
                    hit |= np.array([k in drop for k in own])
            nulls = batch.column("text").is_null().to_pylist()
            texts = [None if null else b"\n".join(x for x, d in zip(own, hit, strict=True) if not d) for own, hit, null in zip(lines, hits, nulls, strict=True)]
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(texts, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_pydict(columns | {"n_lines": pa.array([len(x) for x in lines], pa.int64()), "n_dropped": pa.array([int(h.sum()) for h in hits], pa.int64())})

    return joined.mapInArrow(rewrite, schema)


def op2_line_dedup_cuckoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = dedup_lines(docs, build_index(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op2_line_dedup_cuckoo": op2_line_dedup_cuckoo}
#: A stripped key has no white space at its ends; A-Z only are lower-cased.
SQL = {
    "op2_line_dedup_cuckoo": r"""
WITH lines AS (
  SELECT d.rid, d.doc_id, u.pos, u.line,
         translate(regexp_replace(regexp_replace(u.line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(d.ls) AS line, unnest(range(len(d.ls))) AS pos) u),
heavy AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(heavy.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE heavy.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN heavy ON lines.k = heavy.k
GROUP BY rid, doc_id
"""
}
