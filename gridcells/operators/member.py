"""Membership of cells under any / majority / all, edges and skill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcells.functions import cells as H


def decide(count: Column, size: Column, rule: str) -> Column:
    return {"any": count > 0, "majority": count * 2 > size, "all": count == size}[rule]


def contour_level(x: Column, thresholds: Sequence[float]) -> Column:
    """How many of the ascending thresholds are reached."""
    return sum((F.when(x >= t, 1).otherwise(0) for t in thresholds), F.lit(0))


def rule_members(pixels: DataFrame, sizes: DataFrame, parent: str, hit: Column) -> DataFrame:
    """parent, ts, any, majority, all: decided over all pixels of the parent."""
    counts = pixels.groupBy(parent, "ts").agg(F.count_if(hit).alias("c")).join(sizes, parent)
    return counts.select(parent, "ts", *[decide(F.col("c"), F.col("n"), r).alias(r) for r in ("any", "majority", "all")])


def rule_levels(film: DataFrame, sizes: DataFrame, parent: str, level: str, n_levels: int, rule: str) -> DataFrame:
    """parent, ts, cell_level: levels pass one by one, the first that fails ends
    the climb."""
    counts = film.groupBy(parent, "ts").agg(*[F.count_if(F.col(level) > k).alias(f"c{k}") for k in range(n_levels)]).join(sizes, parent)
    reached, ok = F.lit(0), F.lit(True)
    for k in range(n_levels):
        ok = ok & decide(F.col(f"c{k}"), F.col("n"), rule)
        reached = F.when(ok, k + 1).otherwise(reached)
    return counts.select(parent, "ts", reached.alias("cell_level"))


def member_area(levels: DataFrame, level: str, pixel_km2: float) -> DataFrame:
    """ts, lvl, km2 of the pixels at or over each level from 1."""
    hit = levels.where(F.col(level) > 0).select("ts", F.explode(F.sequence(F.lit(1), F.col(level))).alias("lvl"))
    return hit.groupBy("ts", "lvl").agg((F.count("*") * pixel_km2).alias("km2"))


def pixel_edges(levels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """row, col, side (0 north, 1 west, 2 south, 3 east), lvl: an edge for each
    level between a pixel and a lower 4-neighbour; outside is level 0."""
    steps = F.array(*[F.struct(F.lit(k).alias("side"), F.lit(r).alias("dr"), F.lit(c).alias("dc")) for k, (r, c) in enumerate(((-1, 0), (0, -1), (1, 0), (0, 1)))])
    probe = levels.where("lvl > 0").withColumn("s", F.explode(steps)).withColumns({"nr": F.col("row") + F.col("s.dr"), "nc": F.col("col") + F.col("s.dc")})
    there = levels.select(*keys, F.col("row").alias("nr"), F.col("col").alias("nc"), F.col("lvl").alias("nl"))
    met = probe.join(there, [*keys, "nr", "nc"], "left").withColumn("nl", F.coalesce("nl", F.lit(0))).where("nl < lvl")
    return met.select(*keys, "row", "col", F.col("s.side").alias("side"), F.explode(F.sequence(F.col("nl") + 1, F.col("lvl"))).alias("lvl"))


def hex_edges(cells: DataFrame) -> DataFrame:
    """a, side, b: each edge of the cells once, with the cell on either side
    (b null outside); sides of shared edges are the lower cell's."""
    i, j = H.axial("cell")
    steps = F.array(*[F.struct(F.lit(k).alias("side"), H.pack(H.resolution("cell"), i + a, j + b).alias("b")) for k, (a, b) in enumerate(H.NEIGHBOURS)])
    probe = cells.select(F.col("cell").alias("a"), F.explode(steps).alias("s")).select("a", "s.side", "s.b")
    there = cells.select(F.col("cell").alias("b"), F.lit(True).alias("inside"))
    return probe.join(there, "b", "left").where("inside IS NULL OR a < b").select("a", "side", F.when(F.col("inside"), F.col("b")).alias("b"))


def fence(edges: DataFrame, members: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges between a member and a non-member (or the outside), per ``by`` group."""
    sides = edges.select("a", "side", "b", F.explode(F.array_compact(F.array("a", "b"))).alias("cell"))
    return sides.join(members.select(*by, "cell"), "cell").groupBy(*by, "a", "side", "b").agg(F.count("*").alias("n")).where("n = 1").drop("n")


def contingency(model: DataFrame, radar: DataFrame, threshold: float, rule: str) -> DataFrame:
    """ts, hit, miss, false_alarm: ``model`` (parent, ts, plane), ``radar`` (parent,
    ts, w, value; one row per child, value null where unreported). Unreported
    weight stays in the majority's denominator and breaks ``all``; a parent with
    nothing reported is not scored."""
    wet = F.col("value") >= threshold
    sides = radar.groupBy("parent", "ts").agg(
        F.sum(F.when(wet, F.col("w")).otherwise(0)).alias("wet"), F.sum("w").alias("tot"), F.count("value").alias("seen"),
        F.count_if(wet).alias("nwet"), F.count("*").alias("n"),
    ).where("seen > 0")
    r = {"any": F.col("nwet") > 0, "majority": F.col("wet") * 2 > F.col("tot"), "all": F.col("nwet") == F.col("n")}[rule]
    m = F.coalesce(F.col("plane") >= threshold, F.lit(False))
    met = sides.join(model.select("parent", "ts", "plane"), ["parent", "ts"], "left")
    return met.groupBy("ts").agg(F.count_if(m & r).alias("hit"), F.count_if(~m & r).alias("miss"), F.count_if(m & ~r).alias("false_alarm"))


def skill(tally: DataFrame) -> DataFrame:
    h, m, f = F.col("hit"), F.col("miss"), F.col("false_alarm")
    return tally.select(*tally.columns, F.try_divide(h, h + m + f).alias("csi"), F.try_divide(h, h + m).alias("pod"), F.try_divide(f, h + f).alias("far"))


def support_share(members: DataFrame, radar: DataFrame, threshold: float) -> DataFrame:
    """parent, ts, share: weighted share of the reporting children that are wet."""
    own = radar.where("value IS NOT NULL").join(members.select("parent", "ts"), ["parent", "ts"], "left_semi")
    return own.groupBy("parent", "ts").agg((F.sum(F.when(F.col("value") >= threshold, F.col("w")).otherwise(0)) / F.sum("w")).alias("share"))
