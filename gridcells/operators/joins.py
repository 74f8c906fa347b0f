"""Joins on cells: equal labels, ring fill, polygons. ``nearest`` and
``polygon_hits`` have modules of their own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcells.functions import cells as H
from gridcells.operators.cover import polygon_hits
from gridcells.operators.nearest import nearest


def match_grids(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` and ``b``: id, cell, x, y. For each row of ``a`` the b_id of the same
    cell (how = 0), else the nearest among the ring of six cells (how = 1), else
    none (how = 2), and the distance. Ties go to the lower b_id."""
    own = a.select("id", "x", "y", F.col("cell").alias("at"))
    other = b.select(F.col("id").alias("b_id"), F.col("cell").alias("at"), F.col("x").alias("bx"), F.col("y").alias("by"))
    # only rows without a match in their cell look around
    ring = F.explode(F.array_remove(H.grid_disk("at"), F.col("at"))).alias("at")
    around = own.join(other.select("at"), "at", "left_anti").select("id", "x", "y", ring)
    dist = F.hypot(F.col("bx") - F.col("x"), F.col("by") - F.col("y")).alias("dist")
    met = [rows.join(other, "at").select("id", F.struct(F.lit(how).alias("how"), dist, "b_id").alias("m")) for how, rows in enumerate((own, around))]
    best = met[0].unionByName(met[1]).groupBy("id").agg(F.min("m").alias("m"))
    return a.select("id").join(best, "id", "left").select("id", F.col("m.b_id").alias("b_id"), F.coalesce("m.how", F.lit(2)).alias("how"), F.col("m.dist").alias("dist"))


def own_or_ring(cells: DataFrame, pixels: DataFrame, value: str = "v") -> DataFrame:
    """mean, max, n of the cell's own pixels, else of all pixels of its ring."""
    probe = cells.select("cell", F.explode(H.grid_disk("cell")).alias("at"))
    own = F.col("at") == F.col("cell")
    # algebraic partials per cell first: pixels are shuffled once, by cell
    parts = pixels.groupBy(F.col("cell").alias("at")).agg(F.sum(value).alias("s"), F.max(value).alias("m"), F.count(value).alias("k"))
    met = probe.join(parts, "at").groupBy("cell").agg(
        F.max(own.cast("int")).alias("own"),
        *[f(F.when(own, F.col(c))).alias(f"o{c}") for f, c in ((F.sum, "s"), (F.max, "m"), (F.sum, "k"))],
        *[f(c).alias(f"r{c}") for f, c in ((F.sum, "s"), (F.max, "m"), (F.sum, "k"))],
    )
    pick = lambda c: F.when(F.col("own") == 1, F.col(f"o{c}")).otherwise(F.col(f"r{c}"))
    return met.select("cell", (pick("s") / pick("k")).alias("mean"), pick("m").alias("max"), pick("k").alias("n"), (F.col("own") == 1).alias("own"))


def neighbour_table(cells: DataFrame) -> DataFrame:
    """cell, k (0..6), neighbour: the cell itself where the neighbour is absent."""
    probe = cells.select("cell", F.posexplode(H.grid_disk("cell")).alias("k", "at"))
    there = cells.select(F.col("cell").alias("at"), F.col("cell").alias("there"))
    return probe.join(there, "at", "left").select("cell", "k", F.coalesce("there", "cell").alias("neighbour"))


def neighbour_pairs(cells: DataFrame, same: str | None = None) -> DataFrame:
    """a < b adjacent, of equal ``same`` if given."""
    extra = [same] if same else []
    probe = cells.select(F.col("cell").alias("a"), *extra, F.explode(H.grid_disk("cell")).alias("b")).where("a < b")
    return probe.join(cells.select(F.col("cell").alias("b"), *extra), ["b", *extra]).select("a", "b", *extra)


def full_join_counts(a: DataFrame, b: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Full outer join; absent counts are 0."""
    return a.join(b, list(keys), "full").fillna(0, list(counts))


def label_lookup(cells: DataFrame, labels: DataFrame, zero: Sequence[str]) -> DataFrame:
    return cells.join(labels, "cell", "left").fillna(0, list(zero))


def latest_by_year(base: DataFrame, yearly: DataFrame, value: str) -> DataFrame:
    """The latest year's value on each base cell, and that year."""
    last = yearly.groupBy("cell").agg(F.max(F.struct("year", value)).alias("_l"))
    return base.join(last, "cell", "left").select(*base.columns, F.col(f"_l.{value}").alias(value), F.col("_l.year").alias(f"{value}_year"))


def at_levels(df: DataFrame, level: str, levels: Sequence[int]) -> DataFrame:
    """One row per level that the row's level reaches."""
    return df.withColumn("lvl", F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x <= F.col(level))))


def polyfill(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """cell, poly of cells (cell, x, y of the centre) in a polygon; a cell that
    two polygons claim goes to the lower id."""
    hits = polygon_hits(cells.withColumnRenamed("cell", "id"), edges)
    return hits.groupBy(F.col("id").alias("cell")).agg(F.min("poly").alias("poly"))


def divisions_at(points: DataFrame, edges: DataFrame, attrs: DataFrame, order: Mapping[str, int]) -> DataFrame:
    """Per point, the first division (lowest id) of each subtype, smallest kind
    first, among those of ``attrs`` (poly, subtype, ...): filter it, say by country,
    and only their edges are looked at."""
    named = polygon_hits(points, edges.join(attrs.select("poly").distinct(), "poly", "left_semi")).join(attrs, "poly")
    w = Window.partitionBy("id", "subtype").orderBy("poly")
    first = named.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return first.withColumn("rank", F.coalesce(F.element_at(rank, F.col("subtype")), F.lit(99)))


def assign_zone(pixels: DataFrame, zone_cells: DataFrame, parent: Column) -> DataFrame:
    """Pixels whose parent cell belongs to a zone, with the zone."""
    return pixels.withColumn("parent", parent).join(zone_cells.select(F.col("cell").alias("parent"), F.col("poly").alias("zone")), "parent")
