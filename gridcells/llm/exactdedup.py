"""Exact dedup against a persistent digest index (operator 13).

The index is a table of Spark, bucketed and sorted by digest: one row per text that has
ever arrived, with the row that stays and the batch that brought it. A batch of documents
is reduced to digests first, and to one row per digest before anything is shuffled; a
sort-merge anti-join with the index, whose side needs no shuffle, finds the new digests,
and those are appended. So a batch costs what it brings, however large the index is. Each
batch adds a file to each bucket; ``compacted`` puts them together, in more buckets if need be.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` has become one
space; of equal texts the row that arrived first stays, within a batch that of the smallest
id. The digest is SHA-256 of the normalised text in UTF-8.

Edge cases: null text counts as empty; rows without an id come after all others of their
batch; repeated rows (ties of id and text) are told apart by their place in the table, and
one of them stays; texts of any length are digested whole, in the JVM; an empty batch
appends nothing; further columns stay, but those named like the added ones, which are
replaced. Rows of a digest that makes up over one in HOT_GROUPS of a batch meet the index
in a broadcast of at most HOT_GROUPS rows, all others in a join on the digest, in which no
digest is frequent.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcells.llm.batches import free_name
from gridcells.runtime import exists, scratch, shared_dir, shuffle_partitions, spread, staged, table

#: Digests that each make up over one HOT_GROUPS-th of a batch; at most so many exist.
HOT_GROUPS = 1000
ADDED = ("text_sha256", "keep_id", "group_size", "kept")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


@dataclass(frozen=True)
class Index:
    """The table ``name``, under ``path``, of digest, keep_id, place (of the row that stays in its batch)
    and batch, in ``buckets`` buckets by digest, each file of which is sorted by digest."""

    spark: SparkSession
    name: str
    buckets: int
    path: str

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _append(self, found: DataFrame) -> None:
        # one task per bucket writes its file
        dealt = found.repartition(self.buckets, "digest")
        dealt.write.bucketBy(self.buckets, "digest").sortBy("digest").option("compression", "zstd").mode("append").saveAsTable(self.name)


def create_index(spark: SparkSession, buckets: int | None = None, path: str | None = None) -> Index:
    """An empty index under ``path``, or in the shared folder. With the path of an
    earlier one, the index that lies there, for which ``buckets`` must be as before."""
    name = f"gridcells_digests_{uuid.uuid4().hex}"
    path = path or f"{shared_dir(spark)}/{name}"
    buckets = buckets or shuffle_partitions(spark)
    spark.sql(f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, place BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")
    return Index(spark, name, buckets, path)


def compacted(index: Index, buckets: int | None = None, path: str | None = None) -> Index:
    """The index written anew under ``path``, with one file a bucket (each batch has left
    one), in more ``buckets`` if it has grown. The old one stays as it is, and is the one to
    go on with if this fails; batches that had a name keep it."""
    fresh = create_index(index.spark, buckets or index.buckets, path)
    if exists(index.spark, index.path):
        # read as files: for the buckets of a table the dealing out would be left away, and
        # the tasks of the scan, which then ignores the buckets, would each write to all
        fresh._append(index.spark.read.schema(index.rows().schema).parquet(index.path))
    return fresh


def digests(docs: DataFrame, doc_id: str = "doc_id", place: Column | None = None) -> DataFrame:
    """place (a number of the row), doc_id and digest of every row: all that the rest
    reads of a batch, written once."""
    digest = F.unhex(F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256))
    return staged(docs.select((F.monotonically_increasing_id() if place is None else place).alias("place"), F.col(doc_id).cast("long").alias("doc_id"), digest.alias("digest")), "digests")


def grouped(rows: DataFrame) -> DataFrame:
    """digest, n and the doc_id and place of the first of its ``rows``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), first.alias("first")).select("digest", "n", "first.doc_id", "first.place")


def add_batch(index: Index, rows: DataFrame, batch: str | None = None) -> str:
    """Append the digests of ``rows`` (of ``digests``) that the index has not; the name
    of the batch. A batch is written by one job, which Spark commits whole or not at all,
    so a named batch of which the index has a row already was finished and is left."""
    if batch and not index.rows().where(F.col("batch") == batch).isEmpty():
        return batch
    batch = batch or uuid.uuid4().hex
    fresh = grouped(rows).join(index.rows().hint("merge"), "digest", "left_anti")
    # the index is read and appended to: the new rows are written aside first
    new = staged(fresh.select("digest", F.col("doc_id").alias("keep_id"), "place", F.lit(batch).alias("batch")), "fresh")
    index._append(new)
    return batch


def verdicts(index: Index, rows: DataFrame, batch: str | None = None) -> DataFrame:
    """place, doc_id, digest, keep_id, kept and group_size (rows of the digest among
    ``rows``) of every row. With ``batch``, a row is kept only if that batch brought it."""
    sizes = staged(grouped(rows).select("digest", "n").join(index.rows().hint("merge"), "digest"), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    known = sizes.select("digest", F.struct("keep_id", F.col("place").alias("keep_place"), "batch", "n").alias("of"))
    frequent = F.col("of.n") > total // HOT_GROUPS
    hot = known.where(frequent).withColumnsRenamed({"digest": "hot_digest", "of": "of_hot"})
    # done with, rows of hot digests get keys of no digest, all different
    rest = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left").drop("hot_digest")
    rest = rest.withColumn("key", F.when(F.col("of_hot").isNull(), F.col("digest")).otherwise(F.col("place").cast("string").cast("binary")))
    cold = known.where(~frequent).withColumnsRenamed({"digest": "key", "of": "of_cold"})
    found = rest.join(cold, "key", "left").withColumn("of", F.coalesce("of_hot", "of_cold"))
    kept = (F.col("of.keep_place") == F.col("place")) & (F.col("of.batch") == F.lit(batch) if batch else F.lit(True))
    return found.select("place", "doc_id", "digest", F.col("of.keep_id").alias("keep_id"), kept.alias("kept"), F.col("of.n").alias("group_size"))


def dedup(docs: DataFrame, index: Index, doc_id: str = "doc_id", batch: str | None = None) -> DataFrame:
    """``docs`` as a new batch of the index: all its columns, then text_sha256, keep_id
    (of the row that stays, maybe of an earlier batch), group_size (rows in this batch)
    and kept. Give the batch a name, and it may be run again after a failure."""
    base = docs.drop(*ADDED)
    place = free_name(base, "place")
    # the numbers of the rows must hold for both uses, whatever ``docs`` is made of
    numbered = staged(base.withColumn(place, F.monotonically_increasing_id()), "batch")
    rows = digests(numbered, doc_id, F.col(place))
    found = verdicts(index, rows, add_batch(index, rows, batch))
    judged = found.select(F.col("place").alias(place), F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "group_size", "kept")
    return numbered.join(judged, place).drop(place)


def arrivals(rows: DataFrame) -> list[DataFrame]:
    """``rows`` in two batches by id: those below the middle of the ids, then the rest."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None or low == high:
        return [rows]
    early = F.coalesce(F.col("doc_id") <= (low + high) // 2, F.lit(False))
    return [rows.where(early), rows.where(~early)]


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in two batches, the lower ids first, so the row that arrives
    first is that of the smallest id. Groups are counted over both."""
    rows = digests(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    index = create_index(spark, path=scratch(spark, "index"))
    for batch in arrivals(rows):
        add_batch(index, batch)
    found = verdicts(index, rows)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {"op13_exact_dedup": op13_exact_dedup}
SQL = {
    "op13_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, count(*) OVER w AS group_size, first_value(doc_id) OVER (w ORDER BY doc_id NULLS LAST) AS keep_id, row_number() OVER (w ORDER BY doc_id NULLS LAST) AS k
      FROM d WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM g
"""
}
