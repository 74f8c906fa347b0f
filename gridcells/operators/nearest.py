"""True nearest neighbours at any distance, by a tree of bounding boxes.

The rows of ``b`` lie along a Hilbert curve; each ``fan`` of them in a row form a leaf,
each ``fan`` leaves a node, and so on to a few nodes at the top, each with the bounding
box of its points. So the tree follows the points, however they cluster. Rows of ``a`` go
down level by level, those of a group together, GROUP in a row along a curve of their own:
of the boxes that a row has come to, the least distance within which one must hold a point
(a box touches a point on every side) is an upper bound, and boxes farther than that from
every row of the group are left. Two grids far apart meet in a few boxes a level, like two
that lie in each other. The levels at the top, of few nodes, take no shuffle; what is
shuffled at one below is a list of rows and one of boxes for each group, not boxes for each
row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcells.operators.skew import HOT_KEYS, hot_join
from gridcells.runtime import ship, shuffle_partitions, staged

BITS = 26
#: Rows that go down together.
GROUP = 256
#: Boxes or points that a group is held against at once.
CHUNK = 4096
#: Rounding of squared distances, beyond which a box is farther than the bound.
SLACK = 1e-9


def hilbert(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points (x, y) of a square lattice."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    place = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        rx, ry = (x >> b) & 1, (y >> b) & 1
        place = (place << 2) | ((3 * rx) ^ ry)
        flip = (ry == 0) & (rx == 1)
        x, y = np.where(flip, ~x, x), np.where(flip, ~y, y)
        turn = ry == 0
        x, y = np.where(turn, y, x), np.where(turn, x, y)
    return place


def along_curve(points: DataFrame) -> tuple[DataFrame, int]:
    """``points`` (b_id, bx, by) with ``place``, their numbers along the curve, from 0
    without gaps, and how many there are."""
    low_x, high_x, low_y, high_y = points.agg(*[f(c) for c in ("bx", "by") for f in (F.min, F.max)]).first()
    side = max(high_x - low_x, high_y - low_y) or 1.0

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.minimum(np.nan_to_num((batch.column(c).to_numpy() - low) / side) * 2**BITS, 2**BITS - 1) for c, low in (("bx", low_x), ("by", low_y))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(*at, BITS))], names=[*batch.schema.names, "key"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = np.arange(n, n + batch.num_rows)
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.full(len(own), part)), pa.array(own)], names=[*batch.schema.names[:-1], "part", "own"])

    spark = points.sparkSession
    ship(spark)
    fields = f"b_id {dict(points.dtypes)['b_id']}, bx double, by double"
    keys = points.select("b_id", "bx", "by").mapInArrow(keyed, f"{fields}, key long")
    ordered = keys.repartitionByRange(shuffle_partitions(spark), "key", "bx", "by").sortWithinPartitions("key", "bx", "by")
    rows = staged(ordered.mapInArrow(numbered, f"{fields}, part long, own long"), "curve")
    # a number for each range partition
    sizes = sorted(tuple(r) for r in rows.groupBy("part").count().collect())
    before, base = 0, []
    for part, n in sizes:
        base.append((part, before))
        before += n
    bases = spark.createDataFrame(base, "part long, base long")
    return rows.join(F.broadcast(bases), "part").select("b_id", "bx", "by", (F.col("base") + F.col("own")).alias("place")), before


_BOX = [("w", F.array_min, "bx"), ("e", F.array_max, "bx"), ("s", F.array_min, "by"), ("n", F.array_max, "by")]


def tree(points: DataFrame, fan: int) -> list[tuple[DataFrame, int]]:
    """The levels of the tree from its leaves up, each with its number of nodes: ``node``
    and its children, which are structs of b_id, bx, by in a leaf and of child, w, e, s, n
    above. The last has one. Levels that do not fit in a broadcast are written."""
    rows, n = along_curve(points)
    n = -(-n // fan)
    leaf = rows.groupBy(F.expr(f"place div {fan}").alias("node")).agg(F.collect_list(F.struct("b_id", "bx", "by")).alias("children"))
    levels = [(staged(leaf, "level"), n)]
    while n > 1 or len(levels) == 1:
        sides = [(name, of, point if len(levels) == 1 else name) for name, of, point in _BOX]
        boxes = levels[-1][0].select(F.col("node").alias("child"), *[of(F.col(f"children.{c}")).alias(name) for name, of, c in sides])
        up = boxes.groupBy(F.expr(f"child div {fan}").alias("node")).agg(F.collect_list(F.struct("child", "w", "e", "s", "n")).alias("children"))
        n = -(-n // fan)
        levels.append((staged(up, "level") if n > HOT_KEYS else up, n))
    return levels


def _off(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of values to intervals, a row for each value."""
    return np.maximum(np.maximum(low - v[:, None], v[:, None] - high), 0.0) ** 2


def _sides(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, second = (v[:, None] - low) ** 2, (v[:, None] - high) ** 2
    return np.minimum(first, second), np.maximum(first, second)


def within(x: np.ndarray, y: np.ndarray, w: np.ndarray, e: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Squared distances within which each box must hold one of its points: one lies on
    the nearer side of each pair."""
    (near_x, far_x), (near_y, far_y) = _sides(x, w, e), _sides(y, s, n)
    return np.minimum(near_x + far_y, near_y + far_x)


def _chunks(to: pa.StructArray, names: str) -> Iterator[list[np.ndarray]]:
    for at in range(0, len(to), CHUNK):
        part = to.slice(at, CHUNK)
        yield [np.asarray(part.field(c)) for c in names.split()]


def _kept(rows: pa.StructArray, bound: np.ndarray, to: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bounds after the boxes ``to``, and the children that are within the bound
    of a row."""
    x, y = (np.asarray(rows.field(c)) for c in "xy")
    for box in _chunks(to, "w e s n"):
        bound = np.minimum(bound, within(x, y, *box).min(axis=1))
    limit, left = bound[:, None] * (1 + SLACK), []
    for child, w, e, s, n in _chunks(to, "child w e s n"):
        left.append(child[(_off(x, w, e) + _off(y, s, n) <= limit).any(axis=0)])
    return bound, np.concatenate(left)


def _best(rows: pa.StructArray, to: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest of the points ``to``, as its place there, and the squared
    distance; ties go to the first."""
    x, y = (np.asarray(rows.field(c)) for c in "xy")
    best, place, before = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64), 0
    for bx, by in _chunks(to, "bx by"):
        d = (x[:, None] - bx) ** 2 + (y[:, None] - by) ** 2
        at = d.argmin(axis=1)
        least = d[np.arange(len(at)), at]
        place, best = np.where(least < best, at + before, place), np.minimum(best, least)
        before += len(bx)
    return place, best


def nearest(a: DataFrame, b: DataFrame, fan: float = 16, counted: bool = False) -> DataFrame:
    """id, b_id, dist: the nearest row of ``b`` (id, x, y) for each row of ``a``, at any
    distance, by a tree of ``fan`` children a node (2 at least). Ties go to the lower b_id;
    rows without coordinates, or all if ``b`` is empty, get nulls. ``counted`` adds ``met``,
    the boxes and points that a row was held against."""
    fan = max(2, int(fan))
    plain = lambda df, c, x, y: df.select(F.col("id").alias(c), F.col("x").cast("double").alias(x), F.col("y").cast("double").alias(y))
    placed = lambda x, y: F.coalesce(~F.isnan(x) & ~F.isnan(y) & F.col(x).isNotNull() & F.col(y).isNotNull(), F.lit(False))
    # rows of b in one place are one: that of the lowest id
    points = staged(plain(b, "b_id", "bx", "by").where(placed("bx", "by")).groupBy("bx", "by").agg(F.min("b_id").alias("b_id")), "b")
    every = staged(plain(a, "id", "x", "y"), "a")
    id_type, b_type = dict(every.dtypes)["id"], dict(points.dtypes)["b_id"]
    own = every.where(placed("x", "y"))
    none = every if points.isEmpty() else every.where(~placed("x", "y"))
    none = none.select("id", F.lit(None).cast(b_type).alias("b_id"), F.lit(None).cast("double").alias("dist"), *([F.lit(0).cast("long").alias("met")] if counted else []))
    if points.isEmpty() or own.isEmpty():
        return none
    levels = tree(points, fan)
    rows, _ = along_curve(own.toDF("b_id", "bx", "by"))
    grouped = rows.groupBy(F.expr(f"place div {GROUP}").alias("group")).agg(F.collect_list(F.struct(F.col("b_id").alias("id"), F.col("bx").alias("x"), F.col("by").alias("y"))).alias("rows"))
    start = [F.transform("rows", lambda _: F.lit(math.inf)).alias("bound"), F.lit(0).cast("long").alias("met"), F.array(F.lit(0).cast("long")).alias("nodes")]
    groups = grouped.select("group", "rows", *start)
    kept_type = f"group long, rows array<struct<id: {id_type}, x: double, y: double>>, bound array<double>, met long, nodes array<long>"

    def down(level: DataFrame, n: int) -> DataFrame:
        """The groups with the children of all their nodes in one list, ``to``. A level of
        few nodes is looked up where the groups are; any other meets their nodes in a join."""
        if n <= HOT_KEYS:
            whole = level.agg(F.map_from_entries(F.collect_list(F.struct("node", "children"))).alias("level"))
            to = F.flatten(F.transform("nodes", lambda node: F.element_at("level", node)))
            return groups.crossJoin(F.broadcast(whole)).select("group", "rows", "bound", "met", to.alias("to"))
        met = hot_join(groups.select("group", F.explode("nodes").alias("node")), level, "node")
        to = met.groupBy("group").agg(F.flatten(F.collect_list("children")).alias("to"))
        return groups.drop("nodes").join(to, "group")

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, nodes, met = [], [], []
            for rows, bound, to, n in zip(*[batch.column(c) for c in ("rows", "bound", "to", "met")], strict=True):
                bound, left = _kept(rows.values, np.asarray(bound.values), to.values)
                bounds.append(bound)
                nodes.append(left)
                met.append(n.as_py() + len(to.values))
            lists = [pa.array(v, pa.list_(t)) for v, t in ((bounds, pa.float64()), (nodes, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("rows"), lists[0], pa.array(met, pa.int64()), lists[1]], names=["group", "rows", "bound", "met", "nodes"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, to, n in zip(*[batch.column(c) for c in ("rows", "to", "met")], strict=True):
                # the lower id comes first
                near = to.values.take(pc.array_sort_indices(to.values.field("b_id")))
                place, square = _best(rows.values, near)
                out = [rows.values.field("id"), near.field("b_id").take(pa.array(place)), pa.array(np.sqrt(square))]
                if counted:
                    out.append(pa.array(np.full(len(place), n.as_py() + len(near))))
                yield pa.RecordBatch.from_arrays(out, names=["id", "b_id", "dist", "met"][: len(out)])

    for at in range(len(levels) - 1, 0, -1):
        groups = down(*levels[at]).mapInArrow(narrowed, kept_type)
        if levels[at - 1][1] > HOT_KEYS:
            groups = staged(groups, "groups")
    out = down(*levels[0]).select("rows", "to", "met").mapInArrow(found, f"id {id_type}, b_id {b_type}, dist double" + (", met long" if counted else ""))
    return out.unionByName(none)
