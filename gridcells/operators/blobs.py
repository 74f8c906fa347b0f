"""Connected blobs of cells, their tables, and smoothing over neighbours."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcells.functions import cells as H
from gridcells.operators.components import connected_components
from gridcells.operators.skew import hot_join
from gridcells.operators.tiles import TILE, local_blobs, open_sides, smoothed, tile_of, traced
from gridcells.runtime import staged


#: Sides of a blob up to which a task traces its rings at once (some 10 MB).
RING_SIDES = 1 << 16


def blobs(cells: DataFrame, same: str | None = None) -> DataFrame:
    """The rows of ``cells`` with ``blob``: the least cell of the connected cells
    of equal ``same``."""
    return _named(cells, [same] if same else [])


def keyed_blobs(members: DataFrame, by: Sequence[str]) -> DataFrame:
    """Blobs within each group of ``by`` (an hour, a level)."""
    return _named(members.select(*by, "cell").distinct(), by)


def _named(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """The connected parts of each tile are found in it. Only cells on borders of tiles
    meet in a join, and only the parts that they connect in components."""
    local = staged(local_blobs(cells, by), "tiles")
    border = local.where("border").select(*by, "cell", "root", "low")
    steps = F.array(*[F.col("cell") + ((a << H.BITS) + b) for a, b in H.NEIGHBOURS[:3]])
    probe = border.select(*by, F.col("root").alias("a"), F.col("low").alias("low_a"), tile_of("cell").alias("own"), F.explode(steps).alias("cell")).where(tile_of("cell") != F.col("own"))
    pairs = staged(probe.join(border.withColumnsRenamed({"root": "b", "low": "low_b"}), [*by, "cell"]).select("a", "low_a", "b", "low_b"), "pairs")
    lows = pairs.select(F.col("a").alias("node"), F.col("low_a").alias("low")).unionByName(pairs.select(F.col("b").alias("node"), F.col("low_b").alias("low"))).distinct()
    parts = staged(connected_components(pairs.select("a", "b")).join(lows, "node"), "parts")
    least = parts.groupBy("component").agg(F.min("low").alias("blob"))
    roots = hot_join(parts, least, "component").select(F.col("node").alias("root"), "blob")
    return local.join(roots, "root", "left").select(*cells.columns, F.coalesce("blob", "low").alias("blob"))


def patches(labelled: DataFrame, cls: str, agree: str, area_km2: float, min_cells: int) -> DataFrame:
    """Per blob: class, ncell, mean agreement, km2, over all blobs their number
    and the largest area."""
    each = labelled.groupBy("blob").agg(F.first(cls).alias(cls), F.count("*").alias("ncell"), F.avg(agree).alias("agree"), (F.count("*") * area_km2).alias("km2"))
    total = each.agg(F.count("*").alias("n_blobs"), F.max("km2").alias("max_km2"))  # one row
    return each.where(F.col("ncell") >= min_cells).crossJoin(F.broadcast(total))


def blob_boundary(labelled: DataFrame) -> DataFrame:
    """blob, cell, side: the sides of a blob's cells that face another blob or
    nothing."""
    return open_sides(labelled)


def _corners() -> list[Column]:
    """The corner behind each side of ``cell``: the three cells that meet there."""
    i, j = H.axial("cell")
    near = [H.pack(H.resolution("cell"), i + a, j + b) for a, b in H.NEIGHBOURS]  # in the order in which they go round
    return [F.array_sort(F.array("cell", near[k], near[(k + 1) % 6])) for k in range(6)]


_RING = ["blob", "cell", "side", "ring_cell", "ring_side"]


def _by_size(boundary: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The traced sides of blobs of up to RING_SIDES sides, and those of larger blobs."""
    sides = staged(boundary.select("blob", "cell", "side"), "sides")
    large = staged(sides.groupBy("blob").agg(F.count("*").alias("n")).where(F.col("n") > RING_SIDES).select("blob"), "large")
    if large.isEmpty():
        return traced(sides), None
    # one in RING_SIDES sides at most
    return traced(sides.join(F.broadcast(large), "blob", "left_anti")), sides.join(F.broadcast(large), "blob")


def outline_rings(boundary: DataFrame) -> DataFrame:
    """blob, cell, side of ``blob_boundary`` with ring_cell and ring_side, the least
    side of its ring: the outer one or that of a hole. Three cells meet in a corner, so
    two sides of a blob's boundary or none do, and rings never touch."""
    small, large = _by_size(boundary)
    return small.select(*_RING) if large is None else small.select(*_RING).unionByName(_joined_rings(large))


def _joined_rings(boundary: DataFrame) -> DataFrame:
    """``outline_rings`` of blobs of any size, whose sides meet in joins."""
    corner = _corners()
    ends = F.coalesce(*[F.when(F.col("side") == k, F.array(corner[k - 1], corner[k])) for k in range(6)])
    sides = staged(boundary.withColumn("node", F.monotonically_increasing_id()), "sides")
    met = sides.select("blob", "node", F.explode(ends).alias("corner")).groupBy("blob", "corner").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    found = staged(sides.join(connected_components(met.select("a", "b")), "node").drop("node"), "rings")
    least = found.groupBy("component").agg(F.min(F.struct("cell", "side")).alias("m"))
    return found.join(least, "component").select("blob", "cell", "side", F.col("m.cell").alias("ring_cell"), F.col("m.side").alias("ring_side"))


def ranked(lists: DataFrame) -> DataFrame:
    """node, rest: how many nodes follow each in its list (node, to; null at the end), by
    pointer doubling. Every round, of two doublings, is written; a list of n nodes takes
    log n by 4 rounds, and no task sees more of it than of any other."""

    def doubled(rows: DataFrame) -> DataFrame:
        beyond = rows.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("rest").alias("more"))
        return rows.join(beyond, "to", "left").select("node", F.col("further").alias("to"), (F.col("rest") + F.coalesce("more", F.lit(0))).alias("rest"))

    rows = staged(lists.select("node", "to", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("rest")), "lists")
    while not rows.where("to IS NOT NULL").isEmpty():
        rows = staged(doubled(doubled(rows)), "lists")
    return rows.select("node", "rest")


def ordered_rings(boundary: DataFrame) -> DataFrame:
    """``outline_rings`` with ``place``, the number of the side along its ring from its
    least side, and n, the sides of the ring. Sides run with their cell to the left, so
    outer rings go anticlockwise and those of holes clockwise."""
    small, large = _by_size(boundary)
    return small if large is None else small.unionByName(_ranked_rings(large))


def _ranked_rings(boundary: DataFrame) -> DataFrame:
    """``ordered_rings`` of blobs of any size, by ranks of lists."""
    corner = _corners()
    pick = lambda d: F.coalesce(*[F.when(F.col("side") == k, corner[(k + d) % 6]) for k in range(6)])
    sides = staged(_joined_rings(boundary).withColumn("node", F.monotonically_increasing_id()), "ring-sides")
    head = sides.select("blob", "node", pick(0).alias("corner"))
    tail = sides.select("blob", F.col("node").alias("to"), ((F.col("cell") == F.col("ring_cell")) & (F.col("side") == F.col("ring_side"))).alias("first"), pick(-1).alias("corner"))
    # the side that begins where another ends; the list ends before the first
    follow = head.join(tail, ["blob", "corner"]).select("node", F.when(~F.col("first"), F.col("to")).alias("to"))
    placed = staged(sides.join(ranked(follow), "node").drop("node"), "placed")
    size = placed.groupBy("ring_cell", "ring_side").agg((F.max("rest") + 1).alias("n"))
    return placed.join(size, ["ring_cell", "ring_side"]).withColumn("place", F.col("n") - 1 - F.col("rest")).drop("rest")


def polygons(boundary: DataFrame, res: int) -> DataFrame:
    """blob, n_rings, n_sides, area_m2 (signed areas of the rings, holes negative) and wkb
    of each blob: a polygon in plane metres, its outer ring first, then its holes, as
    big-endian well-known binary. A blob is connected, so it has one outer ring, and all
    its other rings are holes of that."""
    (a, b), (c, d) = H._descent(res, H.MAX_RES)
    i, j = H.axial("cell")
    i0, j0 = H.axial("ring_cell")
    steps = H._step_vectors(res)
    turn = [((steps[k][0] + steps[(k + 1) % 6][0]) / 3, (steps[k][1] + steps[(k + 1) % 6][1]) / 3) for k in range(6)]
    at = lambda k, n: F.coalesce(*[F.when(F.col("side") == s, F.lit(turn[(s + k) % 6][n])) for s in range(6)])
    # from the ring's own cell, so that areas lose nothing far from the origin
    u, v = a * (i - i0) + b * (j - j0), c * (i - i0) + d * (j - j0)
    x, y = (u - v / 2) * H.EDGE_M, v * (H.EDGE_M * math.sqrt(3) / 2)
    cross = (x + at(-1, 0)) * (y + at(0, 1)) - (x + at(0, 0)) * (y + at(-1, 1))
    px, py = H.cell_to_plane("cell", res)
    bits = lambda v: F.lpad(F.hex(F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v).cast("long")), 16, "0")
    point = F.concat(bits(px + at(-1, 0)), bits(py + at(-1, 1)))
    sides = ordered_rings(boundary).select("blob", "ring_cell", "ring_side", "place", cross.alias("cross"), point.alias("point"))
    rings = sides.groupBy("blob", "ring_cell", "ring_side").agg((F.sum("cross") / 2).alias("area"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("place", "point"))).alias("points"))
    word = lambda v: F.lpad(F.hex(v.cast("long")), 8, "0")
    line = F.concat(word(F.col("n") + 1), F.array_join("points.point", ""), F.col("points")[0]["point"])
    shell = (F.col("area") < 0).alias("hole")
    whole = rings.select("blob", "area", "n", F.struct(shell, "ring_cell", "ring_side", line.alias("line")).alias("ring"))
    out = whole.groupBy("blob").agg(F.count("*").alias("n_rings"), F.sum("n").alias("n_sides"), F.sum("area").alias("area_m2"), F.sort_array(F.collect_list("ring")).alias("rings"))
    wkb = F.unhex(F.concat(F.lit("0000000003"), word(F.col("n_rings")), F.array_join("rings.line", "")))
    return out.select("blob", "n_rings", "n_sides", "area_m2", wkb.alias("wkb"))


def dissolve(pieces: DataFrame, zone: str, attrs: Sequence[str]) -> DataFrame:
    """The pieces of each zone (zone, cell, attributes; a cell may come in several
    pieces) as one shape: n_pieces, ncell, n_sides of its outline, and any value of
    each attribute (the pieces of a zone agree in them)."""
    cells = staged(pieces.groupBy(zone, "cell").agg(F.count("*").alias("k"), *[F.any_value(a, True).alias(a) for a in attrs]), "dissolved")
    outline = blob_boundary(cells.select(F.col(zone).alias("blob"), "cell")).groupBy(F.col("blob").alias(zone)).agg(F.count("*").alias("n_sides"))
    whole = cells.groupBy(zone).agg(F.sum("k").alias("n_pieces"), F.count("*").alias("ncell"), *[F.any_value(a, True).alias(a) for a in attrs])
    return whole.join(outline, zone)


def shapes(labelled: DataFrame, keys: Sequence[str], area_km2: float, least_km: float = 2000.0, least_ratio: float = 2.0) -> DataFrame:
    """Per blob of cells with plane coordinates x, y in steps of a cell: ncell, km2, centroid,
    elongation (axis ratio of the centres' covariance, null for a line), length_km and
    width_km along the principal axes, and is_ar: over ``least_km`` long and over
    ``least_ratio`` times as long as wide.

    A rod of n cells has the variance (n * n - 1) / 12, so with a cell's own extent added
    the length of a straight row is that of its cells, and no width is 0. Lengths are
    rounded to six digits, so that shapes on the very border (not over it) count alike."""
    g = labelled.groupBy(*keys).agg(
        F.count("*").alias("ncell"), (F.count("*") * area_km2).alias("km2"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"),
    )
    mid, half = (F.col("vx") + F.col("vy")) / 2, F.hypot((F.col("vx") - F.col("vy")) / 2, F.col("vxy"))
    extent = lambda var: F.round(F.sqrt((F.greatest(var, F.lit(0.0)) * 12 + 1) * area_km2), 6)
    g = g.withColumn("elongation", F.when(mid - half > 1e-9, F.sqrt((mid + half) / F.when(mid - half > 1e-9, mid - half))))
    g = g.withColumns({"length_km": extent(mid + half), "width_km": extent(mid - half)}).drop("vx", "vy", "vxy")
    return g.withColumn("is_ar", (F.col("length_km") > least_km) & (F.col("length_km") > F.round(F.col("width_km") * least_ratio, 6)))


def smooth(cells: DataFrame, value: str, rounds: int, into: str | None = None) -> DataFrame:
    """Mean over the cell and its six neighbours (itself where one is absent),
    ``rounds`` times, as a double; in ``into``, if given, beside the value itself. A cell
    has one row."""
    out = cells.select("cell", value, F.col(value).cast("double").alias("_mean"))
    for done in range(0, rounds, TILE // 2):
        out = smoothed(out, "_mean", min(TILE // 2, rounds - done))
    return out.select("cell", value, F.col("_mean").alias(into)) if into else out.select("cell", F.col("_mean").alias(value))
