"""Stored tables that are read in part and written in part: tiles with a manifest, blocks
by coarse cell with an index, rows clustered by cell."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcells.runtime import exists, staged

#: Blocks (three numbers each) that are broadcast at most.
FEW_BLOCKS = 1 << 18
#: Tiles of one group at most; their names are broadcast.
GROUP_TILES = 1 << 16
#: Keys that a lookup puts into the filter of a scan at most.
FEW_KEYS = 1000
_MANIFEST = "tile string, rows long, version long"


def finished(spark: SparkSession, base: str) -> DataFrame:
    """tile, rows, version of each tile that was written whole, as it is now."""
    if not exists(spark, f"{base}/manifest"):
        return spark.createDataFrame([], _MANIFEST)
    written = spark.read.schema(_MANIFEST).parquet(f"{base}/manifest")
    last = written.groupBy("tile").agg(F.max(F.struct("version", "rows")).alias("m"))
    return last.where("m.rows >= 0").select("tile", "m.rows", "m.version")


def group_ends(n_tiles: int, group: int) -> list[int]:
    """Where the groups of a run end: each is larger than the one before, by twice the factor
    of that, up to half of the tiles (and GROUP_TILES). So some six groups do for thousands
    of tiles, and a run that is stopped loses half of its work at most."""
    ends, done, size, factor = [], 0, group, 2
    while done < n_tiles:
        done = min(done + min(size, max(group, -(-n_tiles // 2)), GROUP_TILES), n_tiles)
        ends.append(done)
        size, factor = size * factor, factor * 2
    return ends


def ingest(work: DataFrame, make: Callable[[DataFrame], DataFrame], base: str, group: int = 64, again: bool = False) -> int:
    """Write the tiles of ``work`` (tile string, and what ``make`` needs) that have not been
    written yet, or all of them ``again``: the number of tiles written. ``make`` turns rows
    of the work list into rows with ``tile``. Groups of tiles, the first of some ``group``, are
    entered in the manifest as begun, put in place of what is there of them (dynamic partition
    overwrite), and entered with their rows; so a run that was stopped leaves whole tiles
    and begun ones, and the next one goes on with those. A tile without rows is entered
    too, with none. Runs over the same tiles must not overlap in time. ``make`` may go over
    its whole source for a group, so groups grow (see ``group_ends``)."""
    spark = work.sparkSession
    todo = work if again else work.join(finished(spark, base), "tile", "left_anti")
    todo = staged(todo, "work")
    n_tiles = todo.select("tile").distinct().count()
    known = spark.read.schema(_MANIFEST).parquet(f"{base}/manifest").agg(F.max("version")).first()[0] if exists(spark, f"{base}/manifest") else 0
    version = F.lit((known or 0) + 1).cast("long").alias("version")
    start = 0
    for end in group_ends(n_tiles, group):
        # each tile has a place by its hash among as many as there are
        own = todo.where(F.pmod(F.xxhash64("tile"), F.lit(n_tiles)).between(start, end - 1))
        tiles, start = own.select("tile").distinct(), end

        def enter(rows: DataFrame) -> None:
            rows.select("tile", F.col("rows").cast("long").alias("rows"), version).coalesce(1).write.mode("append").parquet(f"{base}/manifest")

        enter(tiles.withColumn("rows", F.lit(-1)))
        made = make(own).withColumn("version", version)
        dealt = made.repartition("tile").sortWithinPartitions("tile", *[c for c in made.columns if c != "tile"][:1])
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("tile").parquet(f"{base}/tiles")
        # a tile that has become empty keeps its old files, of another version
        there = spark.read.schema(made.schema).parquet(f"{base}/tiles").where(F.col("version") == version).join(F.broadcast(tiles), "tile", "left_semi")  # a group of tiles
        enter(tiles.join(there.groupBy("tile").agg(F.count("*").alias("rows")), "tile", "left").fillna(0, ["rows"]))
    return n_tiles


def read_tiles(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """The rows (``schema``, without tile) of all tiles that were written whole; what a
    stopped run has left of others, or a tile had before it became empty, is not read."""
    if not exists(spark, f"{base}/tiles"):
        return spark.createDataFrame([], f"{schema}, tile string")
    whole = finished(spark, base).where("rows > 0").select("tile", "version")
    return spark.read.schema(f"{schema}, version long, tile string").parquet(f"{base}/tiles").join(whole, ["tile", "version"], "left_semi").drop("version")


def write_blocks(blocks: DataFrame, pixels: DataFrame, path: str, size: int, region: Callable[[Column, Column], Column], parent: Column) -> None:
    """Blocks (by, bx, values) in folders by ``region`` (of by and bx), sorted, and their
    index: of each coarse cell (``parent``, of pixels row and col) the blocks that it
    touches, sorted by cell."""
    put = blocks.withColumn("region", region(F.col("by"), F.col("bx")).cast("long"))
    put.repartition("region").sortWithinPartitions("region", "by", "bx").write.option("compression", "zstd").partitionBy("region").parquet(f"{path}/blocks")
    at = pixels.select(parent.alias("parent"), F.floor(F.col("row") / size).alias("by"), F.floor(F.col("col") / size).alias("bx")).distinct()
    cluster(at.withColumn("region", region(F.col("by"), F.col("bx")).cast("long")), f"{path}/index", "parent")


def blocks_of(spark: SparkSession, path: str, cells: Column, few: int = FEW_BLOCKS) -> DataFrame:
    """The blocks that coarse cells touch; ``cells`` is a condition on ``parent``. The index
    is read where its row groups may hold such cells, and tells while the query runs which
    folders of blocks to list (dynamic partition pruning). Up to ``few`` blocks are sent to
    all tasks; of more only their folders are, which the driver lists anyway, and the blocks
    meet those folders' rows in a join that Spark chooses."""
    wanted = spark.read.parquet(f"{path}/index").where(cells).select("region", "by", "bx").distinct()
    blocks = spark.read.parquet(f"{path}/blocks")
    if wanted.limit(few + 1).count() <= few:
        return blocks.join(F.broadcast(wanted), ["region", "by", "bx"], "left_semi")
    near = blocks.join(F.broadcast(wanted.select("region").distinct()), "region", "left_semi")
    return near.join(wanted, ["region", "by", "bx"], "left_semi")


def cluster(df: DataFrame, path: str, key: str, files: int | None = None, group_bytes: int = 8 << 20, distinct: int | None = None) -> None:
    """Parquet by ranges of ``key``, sorted, in row groups of ``group_bytes`` with a Bloom
    filter on the key (for ``distinct`` keys a file): a lookup opens the row groups whose
    bounds and filter allow its keys."""
    order = [key, *[c for c in df.columns if c != key]]
    ranged = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    writer = ranged.sortWithinPartitions(*order[:3]).write.option("compression", "zstd").option("parquet.block.size", group_bytes).option(f"parquet.bloom.filter.enabled#{key}", "true")
    if distinct:
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{key}", distinct)
    writer.parquet(path)


def lookup(spark: SparkSession, path: str, key: str, values: Sequence | DataFrame, few: int = FEW_KEYS) -> DataFrame:
    """Rows of a clustered table by some keys, which reach its scan as a filter. ``values``
    may be a table with the column ``key``: if it has over ``few`` keys, only their bounds
    reach the scan, and the rows meet the keys in a join that Spark chooses."""
    stored = spark.read.parquet(path)
    if isinstance(values, DataFrame):
        keys = staged(values.select(key).distinct(), "keys")
        held = [r[key] for r in keys.limit(few + 1).collect()]
        if len(held) > few:
            low, high = keys.agg(F.min(key), F.max(key)).first()
            return stored.where(F.col(key).between(low, high)).join(keys, key, "left_semi")
        values = held
    return stored.where(F.col(key).isin(list(values)))
