"""A native hexagonal cell index as column expressions.

Longitude and latitude go to a cylindrical equal-area plane; the plane is covered
by hexagons whose centres lie at ``i * e1 + j * e2`` (the axes stand at 120
degrees), so neighbours differ by (1,0), (0,1), (1,1) or their negatives. Seven
cells, a centre and its neighbours, form one parent, by an exact integer rule
that alternates between two mirror forms from level to level. An id packs
resolution, i and j in a BIGINT with the top bit 0. All cells of one resolution
have the same area.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Finest resolution; its cells have EDGE_M metres from centre to centre.
MAX_RES, EDGE_M, EARTH_M = 12, 20.0, 6_371_007.2
OFFSET, BITS = 1 << 28, 29
NEIGHBOURS = ((1, 0), (1, 1), (0, 1), (-1, 0), (-1, -1), (0, -1))
#: rows of 7 x the inverse step: (i, j) of the parent from (i, j), by res % 2.
_UP = {0: ((3, -1), (1, 2)), 1: ((2, 1), (-1, 3))}
#: centre child (i, j) of a cell, by the child's res % 2.
_DOWN = {0: ((2, 1), (-1, 3)), 1: ((3, -1), (1, 2))}


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def pack(res, i, j) -> Column:
    """The id of cell (i, j) of a resolution."""
    i, j = _col(i).cast("long") + OFFSET, _col(j).cast("long") + OFFSET
    return F.shiftleft(_col(res).cast("long"), 2 * BITS).bitwiseOR(F.shiftleft(i, BITS)).bitwiseOR(j)


def resolution(cell) -> Column:
    return F.shiftright(_col(cell), 2 * BITS).cast("int")


def axial(cell) -> tuple[Column, Column]:
    c = _col(cell)
    mask = F.lit((1 << BITS) - 1)
    return F.shiftright(c, BITS).bitwiseAND(mask) - OFFSET, c.bitwiseAND(mask) - OFFSET


def plane(lat, lon) -> tuple[Column, Column]:
    """Equal-area plane, metres."""
    return F.radians(_col(lon)) * EARTH_M, F.sin(F.radians(_col(lat))) * EARTH_M


def plane_to_axial(x: Column, y: Column) -> tuple[Column, Column]:
    """Nearest centre of the finest grid, by cube rounding."""
    j = y / (EDGE_M * math.sqrt(3) / 2)
    q = x / EDGE_M + j / 2 - j
    rq, rj, rs = F.rint(q), F.rint(j), F.rint(-q - j)
    dq, dj, ds = F.abs(rq - q), F.abs(rj - j), F.abs(rs + q + j)
    fq = F.when((dq > dj) & (dq > ds), -rj - rs).otherwise(rq)
    fj = F.when((dq > dj) & (dq > ds), rj).when(dj > ds, -rq - rs).otherwise(rj)
    return (fq + fj).cast("long"), fj.cast("long")


def parent_ij(i, j, child_res: int) -> tuple[Column, Column]:
    i, j = _col(i), _col(j)
    return tuple(F.rint((a * i + b * j) / 7).cast("long") for a, b in _UP[child_res % 2])


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often it is used:
    nested plain columns are copied at each use, which multiplies."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ij(i, j) -> Column:
    return F.struct(_col(i).cast("long").alias("i"), _col(j).cast("long").alias("j"))


def ancestor(i, j, from_res: int, to_res: int) -> Column:
    """The id at ``to_res`` of the ancestor of cell (i, j) of ``from_res``."""
    if from_res == to_res:
        return pack(to_res, i, j)
    if from_res - to_res == 1:
        return pack(to_res, *parent_ij(i, j, from_res))

    def step(p: Column, odd: Column) -> Column:
        up = [_ij(*parent_ij(p["i"], p["j"], r)) for r in (0, 1)]
        return F.when(odd, up[1]).otherwise(up[0])

    levels = F.array(*[F.lit(r % 2 == 1) for r in range(from_res, to_res, -1)])
    return _let(F.aggregate(levels, _ij(i, j), step), lambda p: pack(to_res, p["i"], p["j"]))


def _descent(from_res: int, to_res: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """Matrix from a cell of ``from_res`` to its centre descendant."""
    a, b, c, d = 1, 0, 0, 1
    for r in range(from_res + 1, to_res + 1):
        (p, q), (s, t) = _DOWN[r % 2]
        a, b, c, d = p * a + q * c, p * b + q * d, s * a + t * c, s * b + t * d
    return (a, b), (c, d)


def latlng_to_cell(lat, lon, res: int) -> Column:
    x, y = plane(lat, lon)
    fine = _let(F.struct(x.alias("x"), y.alias("y")), lambda p: _ij(*plane_to_axial(p["x"], p["y"])))
    return _let(fine, lambda p: ancestor(p["i"], p["j"], MAX_RES, res))


def add_cell(df: DataFrame, lat: str, lon: str, res: int, name: str = "cell") -> DataFrame:
    """``df`` with the cell of each point. The same as ``latlng_to_cell``, but one
    projection per step, so all of it stays in generated code and nothing is
    computed twice: the way to label whole pixel tables."""
    x, y = plane(lat, lon)
    j = y / (EDGE_M * math.sqrt(3) / 2)
    out = df.withColumns({"_q": x / EDGE_M + j / 2 - j, "_j": j})
    q, j = F.col("_q"), F.col("_j")
    out = out.withColumns({"_rq": F.rint(q), "_rj": F.rint(j), "_rs": F.rint(-q - j)})
    rq, rj, rs = F.col("_rq"), F.col("_rj"), F.col("_rs")
    out = out.withColumns({"_wq": (F.abs(rq - q) > F.abs(rj - j)) & (F.abs(rq - q) > F.abs(rs + q + j)), "_wj": F.abs(rj - j) > F.abs(rs + q + j)})
    out = out.withColumns({"_fq": F.when(F.col("_wq"), -rj - rs).otherwise(rq), "_fj": F.when(F.col("_wq"), rj).when(F.col("_wj"), -rq - rs).otherwise(rj)})
    out = out.withColumns({"_i": (F.col("_fq") + F.col("_fj")).cast("long"), "_j": F.col("_fj").cast("long")})
    for r in range(MAX_RES, res, -1):
        out = out.withColumns(dict(zip(("_i", "_j"), parent_ij("_i", "_j", r), strict=True)))
    return out.withColumn(name, pack(res, "_i", "_j")).drop("_q", "_j", "_rq", "_rj", "_rs", "_wq", "_wj", "_fq", "_fj", "_i")


def cell_parent(cell, res: int, from_res: int) -> Column:
    """The ancestor at ``res`` of a cell of ``from_res``."""
    return _let(_col(cell), lambda c: ancestor(*axial(c), from_res, res)) if from_res - res > 1 else ancestor(*axial(cell), from_res, res)


def grid_disk(cell, k: int = 1) -> Column:
    """The cells within k steps, itself included, as an array."""
    c = _col(cell)
    steps = [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1) if max(abs(a), abs(b), abs(a - b)) <= k]
    return F.array(*[c + (a * (1 << BITS) + b) for a, b in sorted(steps)])


def grid_distance(a, b) -> Column:
    (ai, aj), (bi, bj) = axial(a), axial(b)
    return F.greatest(F.abs(ai - bi), F.abs(aj - bj), F.abs((ai - aj) - (bi - bj)))


def cell_to_plane(cell, res: int) -> tuple[Column, Column]:
    (a, b), (c, d) = _descent(res, MAX_RES)
    i, j = axial(cell)
    i, j = a * i + b * j, c * i + d * j
    return (i - j / 2) * EDGE_M, j * (EDGE_M * math.sqrt(3) / 2)


def plane_to_latlng(x: Column, y: Column) -> Column:
    return F.struct(F.degrees(F.asin(y / EARTH_M)).alias("lat"), F.degrees(x / EARTH_M).alias("lon"))


def cell_to_latlng(cell, res: int) -> Column:
    """Centre as a struct of lat and lon."""
    return _let(_col(cell), lambda c: plane_to_latlng(*cell_to_plane(c, res)))


def _step_vectors(res: int) -> list[tuple[float, float]]:
    """Plane vectors from a cell of ``res`` to its six neighbours, in order."""
    out = []
    (a, b), (c, d) = _descent(res, MAX_RES)
    for i, j in NEIGHBOURS:
        i, j = a * i + b * j, c * i + d * j
        out.append(((i - j / 2) * EDGE_M, j * EDGE_M * math.sqrt(3) / 2))
    return out


def cell_boundary(cell, res: int) -> Column:
    """Closed ring of seven points (x, y in plane metres)."""
    x, y = cell_to_plane(cell, res)
    v = _step_vectors(res)
    corners = [((v[k][0] + v[(k + 1) % 6][0]) / 3, (v[k][1] + v[(k + 1) % 6][1]) / 3) for k in range(6)]
    return F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in [*corners, corners[0]]])


def cell_area_km2(res: int) -> float:
    return EDGE_M**2 * math.sqrt(3) / 2 * 7 ** (MAX_RES - res) / 1e6


def pick_res(box_km2: float, budget: int, base: int = 6, lo: int = 0, hi: int = MAX_RES) -> int:
    """The finest resolution up to ``base`` whose cells over the box fit the budget."""
    res = min(max(base, lo), hi)
    while res > lo and box_km2 / cell_area_km2(res) > budget:
        res -= 1
    return res


def pick_res_of(box_km2: Column, budget: int, base: int = 6, lo: int = 0) -> Column:
    """``pick_res`` of each row's box."""
    fits = [F.when(box_km2 / cell_area_km2(res) <= budget, res) for res in range(base, lo, -1)]
    return F.coalesce(*fits, F.lit(lo))
