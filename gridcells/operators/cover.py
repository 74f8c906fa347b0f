"""Points in polygons by covers of cells of the polygon's own size.

A polygon's box is cut into at most about ``side`` by ``side`` square cells of a grid
whose widths are powers of four, so the cover follows the polygon, whatever the unit and
wherever it lies. Cells that an edge passes are the boundary; of the others those inside
are told by the parity of crossings to the right of their centres, counted by column. Inner
cells are put together, sixteen to one, where all are there. A point in an inner cell is
inside without a look at any edge; one in a boundary cell meets the edges of its row of the
polygon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcells.operators.skew import hot_join
from gridcells.runtime import staged

#: The most rows that a polygon's edges are sorted into.
POLYGON_ROWS = 4096
#: Rows of covers, and of edges by strips (some 100 bytes each), up to which they are
#: broadcast.
SMALL_COVER = 50_000
#: Rounding of cell numbers: an edge this near to a border, in widths, passes both cells.
EDGE_SLACK = 1e-7


def boxes_of(edges: DataFrame) -> DataFrame:
    """poly, xmin, ymin, xmax, ymax, n_edges."""
    low, high = (lambda c: F.min(F.least(f"{c}0", f"{c}1"))), (lambda c: F.max(F.greatest(f"{c}0", f"{c}1")))
    return edges.groupBy("poly").agg(low("x").alias("xmin"), low("y").alias("ymin"), high("x").alias("xmax"), high("y").alias("ymax"), F.count("*").alias("n_edges"))


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(4.0), level)).cast("long")


def _levels(boxes: DataFrame, side: float) -> DataFrame:
    """``boxes`` of some height with ``level``: cells of width 4^level, of which the
    longer side of the box has at most ``side``, or as many as the polygon has edges."""
    cut = F.least(F.greatest(F.lit(2.0), F.col("n_edges").cast("double")), F.lit(float(max(2, side))))
    longer = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    return boxes.where("ymin < ymax").withColumn("level", F.ceil(F.log(longer / cut) / F.log(F.lit(4.0))).cast("int"))


def covers(edges: DataFrame, side: float = 16) -> DataFrame:
    """poly, level, gx, gy, inner: the cells of each polygon's cover (edges poly, x0, y0,
    x1, y1). They do not overlap; a polygon has at most (side + 2) squared."""
    boxes = _levels(boxes_of(edges), side)
    own = edges.join(boxes.select("poly", "level"), "poly").withColumn("w", F.pow(F.lit(4.0), F.col("level")))
    y_of = lambda c: F.col(c) / F.col("w")
    # the rows of cells that an edge passes, then the columns that it passes in each
    low, high = F.least(y_of("y0"), y_of("y1")), F.greatest(y_of("y0"), y_of("y1"))
    rows = own.withColumn("gy", F.explode(F.sequence(F.floor(low - EDGE_SLACK).cast("long"), F.floor(high + EDGE_SLACK).cast("long"))))
    x0, x1, y0, y1 = (y_of(c) for c in ("x0", "x1", "y0", "y1"))
    slope = F.when(y0 != y1, (x1 - x0) / (y1 - y0))
    at = lambda y: x0 + slope * (F.least(F.greatest(y, low), high) - y0)
    first, last = at(F.col("gy").cast("double")), at(F.col("gy") + 1.0)
    left = F.when(slope.isNull(), F.least(x0, x1)).otherwise(F.least(first, last))
    right = F.when(slope.isNull(), F.greatest(x0, x1)).otherwise(F.greatest(first, last))
    spans = rows.withColumns({"left": F.floor(left - EDGE_SLACK).cast("long"), "right": F.floor(right + EDGE_SLACK).cast("long")})
    border = staged(spans.withColumn("gx", F.explode(F.sequence("left", "right"))).select("poly", "level", "gx", "gy").distinct(), "border")
    # crossings of the line through the centres of a row of cells, by column
    mid = F.col("gy") + 0.5
    crossed = rows.where((y0 <= mid) != (y1 <= mid)).select("poly", "gy", F.floor(x0 + (mid - y0) * (x1 - x0) / (y1 - y0)).cast("long").alias("gx"))
    turns = crossed.groupBy("poly", "gy", "gx").agg(F.count("*").alias("n"))
    # all cells of the row between two cells of the boundary are alike; rows of a cover are short
    marks = border.join(turns, ["poly", "gy", "gx"], "left").fillna(0, ["n"])
    along = Window.partitionBy("poly", "gy").orderBy("gx")
    whole = Window.partitionBy("poly", "gy")
    gaps = marks.withColumns({"next": F.lead("gx").over(along), "beyond": F.sum("n").over(whole) - F.sum("n").over(along)})
    inside = gaps.where("next > gx + 1 AND beyond % 2 = 1").select("poly", "level", F.explode(F.sequence(F.col("gx") + 1, F.col("next") - 1)).alias("gx"), "gy")
    return border.withColumn("inner", F.lit(False)).unionByName(_compacted(inside).withColumn("inner", F.lit(True)))


def _compacted(inside: DataFrame) -> DataFrame:
    """Sixteen cells of a parent as that parent, once: with 16 cells a side, hardly any
    parents of parents are whole."""
    up = lambda c: F.floor(F.col(c) / 4).cast("long")
    cells = inside.groupBy("poly", "level", up("gx").alias("px"), up("gy").alias("py")).agg(F.collect_list(F.struct("gx", "gy")).alias("cells"))
    parent = F.array(F.struct((F.col("level") + 1).alias("level"), F.col("px").alias("gx"), F.col("py").alias("gy")))
    apart = F.transform("cells", lambda c: F.struct(F.col("level").alias("level"), c["gx"].alias("gx"), c["gy"].alias("gy")))
    return cells.select("poly", F.explode(F.when(F.size("cells") == 16, parent).otherwise(apart)).alias("c")).select("poly", "c.level", "c.gx", "c.gy")


def polygon_hits(points: DataFrame, edges: DataFrame, side: float = 16) -> DataFrame:
    """(point id, poly) of points inside polygons: parity of ray crossings over the edges
    (poly, x0, y0, x1, y1), a vertex counting once. A point meets the cover cells that it
    lies in, one for each polygon near it; only in a boundary cell does it meet edges, those
    of its row of the polygon, of as many rows as the polygon has edges."""
    boxes = boxes_of(edges).where("ymin < ymax")
    box = ["xmin", "xmax", "ymin", "ymax", "n_edges"]
    cells = covers(edges, side).join(boxes, "poly").groupBy(F.struct("level", "gx", "gy").alias("cell")).agg(F.collect_list(F.struct("poly", "inner", *box)).alias("polys"))
    cells = staged(cells, "cells")
    # as many levels as the sizes of polygons differ by factors of four
    found = cells.agg(F.count("*").alias("n"), F.collect_set("cell.level").alias("levels"), F.sum(F.size("polys")).alias("polys")).first()
    if not found["n"]:
        return points.join(edges, F.lit(False)).select("id", "poly")
    at = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("x") / 4.0**k).cast("long").alias("gx"), F.floor(F.col("y") / 4.0**k).cast("long").alias("gy")) for k in sorted(found["levels"])])
    spread = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["x", "y"]).withColumn("cell", F.explode(at))
    if found["polys"] <= SMALL_COVER:
        met = spread.join(F.broadcast(cells), "cell")
    else:
        met = hot_join(staged(spread, "points"), cells, "cell")
    met = met.select("id", "x", "y", F.explode("polys").alias("p")).select("id", "x", "y", "p.*")
    n_rows = F.least(F.col("n_edges"), F.lit(POLYGON_ROWS))
    row = lambda y: F.floor((y - F.col("ymin")) * n_rows / (F.col("ymax") - F.col("ymin"))).cast("long")
    near = met.where("NOT inner AND x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax").select("id", "x", "y", F.struct("poly", row(F.col("y")).alias("row")).alias("strip"))
    strips = edges.where("y0 <> y1").join(boxes, "poly").withColumn("row", F.explode(F.sequence(row(F.least("y0", "y1")), row(F.greatest("y0", "y1")))))
    strips = strips.groupBy(F.struct("poly", "row").alias("strip")).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("edges"))

    def crossed(e: Column) -> Column:
        x, y = F.col("x"), F.col("y")
        spans = (e["y0"] <= y) != (e["y1"] <= y)
        return spans & (x < e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"]))

    # the most places that edges have in strips
    places = boxes.agg(F.sum(F.col("n_edges") * n_rows)).first()[0]
    tested = near.join(F.broadcast(strips), "strip") if places <= SMALL_COVER else hot_join(staged(near, "near"), strips, "strip")
    tested = tested.where(F.size(F.filter("edges", crossed)) % 2 == 1)
    return met.where("inner").select("id", "poly").unionByName(tested.select("id", "strip.poly"))

