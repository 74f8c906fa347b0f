"""Pixel, block and item tables: scans, windows, samples, composites, sinks."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: west, south, east, north
Box = tuple[float, float, float, float]


def blocks_to_pixels(blocks: DataFrame, size: int) -> DataFrame:
    """One row per value of the blocks (by, bx, values in row order of a size x
    size square): row, col, v; null values are left out."""
    flat = blocks.select("by", "bx", F.posexplode("values").alias("pos", "v")).where("v IS NOT NULL")
    return flat.select((F.col("by") * size + F.floor(F.col("pos") / size)).alias("row"), (F.col("bx") * size + F.col("pos") % size).alias("col"), "v")


def prune_blocks(blocks: DataFrame, kept: DataFrame, size: int) -> DataFrame:
    """The blocks that hold any of the pixels ``kept`` (row, col)."""
    wanted = kept.select(F.floor(F.col("row") / size).alias("by"), F.floor(F.col("col") / size).alias("bx")).distinct()
    return blocks.join(wanted, ["by", "bx"], "left_semi")


def block_index(pixels: DataFrame, size: int, parent: Column) -> DataFrame:
    """by, bx, parents: the coarse cells that each block touches."""
    return pixels.groupBy(F.floor(F.col("row") / size).alias("by"), F.floor(F.col("col") / size).alias("bx")).agg(F.sort_array(F.collect_set(parent)).alias("parents"))


def in_box(pixels: DataFrame, box: Box, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Half-open: west and south edges belong to the box."""
    w, s, e, n = box
    return pixels.where((F.col(lon) >= w) & (F.col(lon) < e) & (F.col(lat) >= s) & (F.col(lat) < n))


def grid_window(box: Box, x0: float, y0: float, step: float, width: int, height: int) -> tuple[int, int, int, int]:
    """row0, row1, col0, col1 (ends exclusive) of a north-up grid, clamped."""
    w, s, e, n = box
    clamp = lambda v, top: max(0, min(top, v))
    return (
        clamp(math.floor((y0 - n) / step), height), clamp(math.ceil((y0 - s) / step), height),
        clamp(math.floor((w - x0) / step), width), clamp(math.ceil((e - x0) / step), width),
    )


def bounding_rectangle(pixels: DataFrame, box: Box) -> DataFrame:
    """All pixels in the rows and columns that the box reaches on a curved grid."""
    hit = in_box(pixels, box).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    # one row of bounds
    return pixels.join(F.broadcast(hit), F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))).drop("r0", "r1", "c0", "c1")


def sample_stride(n_pixels: int, budget: int) -> int:
    return max(1, math.ceil(math.sqrt(n_pixels / budget)))


def stride_sample(pixels: DataFrame, stride: int, row: str = "row", col: str = "col", row0: int = 0, col0: int = 0) -> DataFrame:
    """Every stride-th row and column."""
    return pixels.where(((F.col(row) - row0) % stride == 0) & ((F.col(col) - col0) % stride == 0))


def pick_level(cell_km2: float, px_per_cell: float, window_px: int, budget: int, base_m: float = 30.0, top: int = 10) -> int:
    """Overview level with about px_per_cell pixels in a cell, coarser while the
    window has more pixels than the budget."""
    level = max(0, round(math.log2(max(1.0, math.sqrt(cell_km2 * 1e6 / px_per_cell) / base_m))))
    while level < top and window_px / 4**level > budget:
        level += 1
    return level


def write_pyramid(pixels: DataFrame, path: str, n_levels: int) -> None:
    """row, col, v (sum) of each level, a folder per level; level k + 1 is added up
    from what level k has stored."""
    own = pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("v").cast("long").alias("v"))
    for level in range(n_levels):
        own.write.option("compression", "zstd").parquet(f"{path}/level={level}")
        below = pixels.sparkSession.read.schema(own.schema).parquet(f"{path}/level={level}")
        own = below.groupBy(F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")).agg(F.sum("v").alias("v"))


def at_level(pixels: DataFrame, level: int) -> DataFrame:
    return pixels.where(F.col("level") == level).drop("level")


def overlapping(items: DataFrame, box: Box, year: int | None = None) -> DataFrame:
    """Items (west, south, east, north, year) whose box meets the box."""
    w, s, e, n = box
    hit = items.where((F.col("east") > w) & (F.col("west") < e) & (F.col("north") > s) & (F.col("south") < n))
    return hit if year is None else hit.where(F.col("year") == year)


def find_items(items: DataFrame, box: Box, year: int, primary: str, fill: str) -> DataFrame:
    """The yearly items of the primary collection (priority 0), then the fill
    collection's (1). Where the primary has no item of that year at the place
    ``key``, its latest earlier one stands in under a name with the year."""
    own = overlapping(items.where(F.col("collection") == primary), box)
    yearly = own.where(F.col("item_id").endswith(f"_{year}"))
    older = own.where(F.col("year") < year).join(yearly.select("place"), "place", "left_anti")
    made = older.groupBy("place").agg(F.max_by("item_id", "year").alias("was"), F.max("year").alias("year"))
    made = made.select(F.concat_ws("_", F.regexp_replace("was", r"_\d+$", ""), F.lit(year)).alias("item_id"), "place")
    second = overlapping(items.where(F.col("collection") == fill), box, year)
    out = yearly.select("item_id", "place").unionByName(made).withColumn("priority", F.lit(0))
    return out.unionByName(second.select("item_id", "place").withColumn("priority", F.lit(1)))


def read_tiles(spark, path: str) -> DataFrame:
    """Tiles written apart; those without pixels may have the key column only."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tiles of the work list without output yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_table(df: DataFrame, path: str, by: Sequence[str] = (), sort: Sequence[str] = ()) -> None:
    """Parquet with zstd; sorted by cell within files, so readers can skip."""
    out = df.repartition(*by) if by else df
    out = out.sortWithinPartitions(*by, *sort) if sort else out
    writer = out.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def mask_nodata(df: DataFrame, codes: Mapping[str, Sequence[float]]) -> DataFrame:
    """Nulls in place of the codes (and NaN) of each column."""
    fixed = {}
    for name, bad in codes.items():
        c = F.col(name)
        nan = F.isnan(c) if dict(df.dtypes)[name] in ("double", "float") else F.lit(False)
        fixed[name] = F.when(~(c.isin(list(bad)) | nan), c)
    return df.withColumns(fixed)


def coverage(film: DataFrame, ts, key: str = "pixel") -> DataFrame:
    """Rows of the pixels with a value at one hour."""
    covered = film.where((F.col("ts") == ts) & F.col("value").isNotNull()).select(key).distinct()
    return film.join(covered, key, "left_semi")


def common_window(sources: Mapping[str, DataFrame], days: float) -> dict[str, DataFrame]:
    """The trailing days up to the newest hour that all sources have."""
    newest = None
    for df in sources.values():
        own = df.agg(F.max("ts").alias("t"))
        newest = own if newest is None else newest.unionByName(own)
    # one row
    end = newest.agg(F.min("t").alias("_end"))
    keep = (F.col("ts") <= F.col("_end")) & (F.col("ts") > F.col("_end") - F.expr(f"INTERVAL {int(days * 24)} HOURS"))
    return {k: df.join(F.broadcast(end), keep).drop("_end") for k, df in sources.items()}


def resample_nearest(source: DataFrame, target: DataFrame, x0: float, y0: float, step: float) -> DataFrame:
    """Values of a north-up source grid (row, col, v) at target points (x, y)."""
    at = target.withColumns({"row": F.floor((y0 - F.col("y")) / step).cast("long"), "col": F.floor((F.col("x") - x0) / step).cast("long")})
    return at.join(source.select("row", "col", "v"), ["row", "col"], "left")


def composite_first(layers: DataFrame, keys: Sequence[str], value: str = "value", order: str = "priority") -> DataFrame:
    """First valid value by priority, and that priority."""
    first = F.min(F.when(F.col(value).isNotNull(), F.struct(order, value)))
    return layers.groupBy(*keys).agg(first.alias("_f")).where("_f IS NOT NULL").select(*keys, F.col(f"_f.{value}").alias(value), F.col(f"_f.{order}").alias(order))


def composite_last(layers: DataFrame, keys: Sequence[str], value: str = "value", order: str = "seq") -> DataFrame:
    """The last value over zero wins."""
    return layers.where(F.col(value) > 0).groupBy(*keys).agg(F.max(F.struct(order, value))[value].alias(value))

