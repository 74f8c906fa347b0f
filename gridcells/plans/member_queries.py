"""Queries of membership, edges, blobs and skill (G*, X5)."""

from pyspark.sql import functions as F

from gridcells.functions import cells as H
from gridcells.operators import blobs as B
from gridcells.operators import member as G
from gridcells.plans.book import Book
from gridcells.plans.views import RES
from gridcells.runtime import table

BOOK = Book()
q = BOOK.add

_LEVELS = [10_000.0, 20_000.0, 30_000.0, 40_000.0]
_LVL_SQL = " + ".join(f"(value >= {t})::INT" for t in _LEVELS)


@q("g01_contour_levels", ("film",), f"SELECT pixel, ts, {_LVL_SQL} AS lvl FROM film")
def g01(film):
    return film.select("pixel", "ts", G.contour_level(F.col("value"), _LEVELS).alias("lvl"))


@q("g02_rule_levels", ("film",), f"""WITH l AS (SELECT pixel, pixel // 4 AS parent, ts, {_LVL_SQL} AS lvl FROM film), s AS (SELECT parent, count(DISTINCT pixel) AS n FROM l GROUP BY parent),
c AS (SELECT parent, ts, {", ".join(f"count(*) FILTER (WHERE lvl > {k}) AS c{k}" for k in range(4))} FROM l GROUP BY parent, ts)
SELECT parent, ts, CASE WHEN NOT c0 * 2 > n THEN 0 WHEN NOT c1 * 2 > n THEN 1 WHEN NOT c2 * 2 > n THEN 2 WHEN NOT c3 * 2 > n THEN 3 ELSE 4 END AS cell_level FROM c JOIN s USING (parent)""")
def g02(film):
    rows = film.select("pixel", "ts", F.expr("pixel div 4").alias("parent"), G.contour_level(F.col("value"), _LEVELS).alias("lvl"))
    sizes = rows.groupBy("parent").agg(F.count_distinct("pixel").alias("n"))
    return G.rule_levels(rows, sizes, "parent", "lvl", 4, "majority")


@q("g03_member_area", ("film",), f"WITH l AS (SELECT ts, {_LVL_SQL} AS lvl FROM film) SELECT ts, k AS lvl, count(*) * 9.0::DOUBLE AS km2 FROM l JOIN (SELECT unnest([1, 2, 3, 4]) AS k) t ON l.lvl >= k GROUP BY ts, k")
def g03(film):
    rows = film.select("ts", G.contour_level(F.col("value"), _LEVELS).alias("lvl"))
    return G.member_area(rows, "lvl", 9.0)


@q("g04_pixel_edges", ("members",), """WITH l AS (SELECT i AS row, j AS col, cls % 4 AS lvl FROM members), s AS (SELECT unnest([0, 1, 2, 3]) AS side, unnest([-1, 0, 1, 0]) AS dr, unnest([0, -1, 0, 1]) AS dc),
n AS (SELECT l.row, l.col, side, l.lvl, coalesce(o.lvl, 0) AS nl FROM (SELECT * FROM l, s) l LEFT JOIN l o ON o.row = l.row + dr AND o.col = l.col + dc)
SELECT row, col, side, unnest(range(nl + 1, lvl + 1))::INT AS lvl FROM n WHERE nl < lvl""")
def g04(members):
    return G.pixel_edges(members.select(F.col("i").alias("row"), F.col("j").alias("col"), (F.col("cls") % 4).cast("int").alias("lvl")))


_SIDES = "(SELECT unnest([0, 1, 2, 3, 4, 5]) AS side, unnest([1, 1, 0, -1, -1, 0]) AS da, unnest([0, 1, 1, 0, -1, -1]) AS db)"
_EDGES = f"e AS (SELECT a.cell AS a, side, o.cell AS b FROM (SELECT * FROM members, {_SIDES} s) a LEFT JOIN members o ON o.i = a.i + da AND o.j = a.j + db WHERE o.cell IS NULL OR a.cell < o.cell)"


@q("g05_hex_edges", ("members",), f"WITH {_EDGES} SELECT a, side, b FROM e")
def g05(members):
    return G.hex_edges(members)


@q("g06_fence", ("members",), f"""WITH {_EDGES}, m AS (SELECT cell FROM members WHERE cls > 9)
SELECT a, side, b FROM e WHERE (a IN (SELECT cell FROM m)) <> coalesce(b IN (SELECT cell FROM m), false)""")
def g06(members):
    return G.fence(G.hex_edges(members), members.where("cls > 9"))


@q("g07_plane_membership", ("model",), "SELECT parent, ts FROM model WHERE plane >= 50")
def g07(model):
    return model.where(F.col("plane") >= 50).select("parent", "ts")


@q("g08_components", ("members",), f"""WITH RECURSIVE n AS (SELECT * FROM members),
e AS (SELECT a.cell AS a, b.cell AS b FROM n a, {_SIDES} s JOIN n b ON b.i = a.i + da AND b.j = a.j + db AND a.cls = b.cls),
walk AS (SELECT cell AS start, cell AS "at" FROM n UNION SELECT walk.start, e.b FROM walk JOIN e ON walk."at" = e.a)
SELECT start AS cell, min("at") AS blob FROM walk GROUP BY start""")
def g08(members):
    return B.blobs(members, "cls").select("cell", "blob")


@q("g09_patches", ("members",), f"""WITH RECURSIVE n AS (SELECT * FROM members),
e AS (SELECT a.cell AS a, b.cell AS b FROM n a, {_SIDES} s JOIN n b ON b.i = a.i + da AND b.j = a.j + db AND a.cls = b.cls),
walk AS (SELECT cell AS start, cell AS "at" FROM n UNION SELECT walk.start, e.b FROM walk JOIN e ON walk."at" = e.a),
l AS (SELECT start AS cell, min("at") AS blob FROM walk GROUP BY start),
p AS (SELECT blob, min(cls) AS cls, count(*) AS ncell, round(avg(npx), 6) AS agree, round(count(*) * 0.5::DOUBLE, 6) AS km2 FROM l JOIN members USING (cell) GROUP BY blob)
SELECT *, (SELECT count(*) FROM p) AS n_blobs, (SELECT max(km2) FROM p) AS max_km2 FROM p WHERE ncell >= 3""")
def g09(members):
    return B.patches(B.blobs(members, "cls"), "cls", "npx", 0.5, 3)


_KEYED = f"""n AS (SELECT cls, i, j, cell FROM (SELECT DISTINCT cls, i, j, cell FROM px) x),
e AS (SELECT a.cls, a.cell AS a, b.cell AS b FROM n a, {_SIDES} s JOIN n b ON b.i = a.i + da AND b.j = a.j + db AND a.cls = b.cls),
walk AS (SELECT cls, cell AS start, cell AS "at" FROM n UNION SELECT walk.cls, walk.start, e.b FROM walk JOIN e ON walk."at" = e.a AND walk.cls = e.cls),
l AS (SELECT cls, start AS cell, min("at") AS blob FROM walk GROUP BY cls, start)"""


@q("g10_x05_dome_blobs", ("px",), f"""WITH RECURSIVE {_KEYED}, s AS (SELECT l.cls, blob, count(*) AS ncell, count(*) * 4.0::DOUBLE AS km2, avg(i) AS cx, avg(j) AS cy, var_pop(i) AS vx, var_pop(j) AS vy, covar_pop(i, j) AS vxy
 FROM l JOIN n ON l.cls = n.cls AND l.cell = n.cell GROUP BY l.cls, blob), t AS (SELECT *, (vx + vy) / 2 AS mid, sqrt(power((vx - vy) / 2, 2) + power(vxy, 2)) AS half FROM s)
SELECT cls, blob, ncell, km2, round(cx, 6) AS cx, round(cy, 6) AS cy, round(CASE WHEN mid - half > 1e-9 THEN sqrt((mid + half) / (mid - half)) END, 4) AS elongation,
 length_km, width_km, length_km > 7 AND length_km > round(width_km * 2, 6) AS is_ar
FROM (SELECT *, round(sqrt((greatest(mid + half, 0) * 12 + 1) * 4), 6) AS length_km, round(sqrt((greatest(mid - half, 0) * 12 + 1) * 4), 6) AS width_km FROM t) u WHERE km2 >= 12""")
def g10(px):
    x, y = H.axial("cell")
    labelled = B.keyed_blobs(px, ["cls"]).withColumns({"x": x, "y": y})
    return B.shapes(labelled, ["cls", "blob"], 4.0, least_km=7.0).where("km2 >= 12").withColumn("elongation", F.round("elongation", 4))


@q("g11_blob_boundary", ("members",), f"""WITH RECURSIVE n AS (SELECT * FROM members),
e AS (SELECT a.cell AS a, b.cell AS b FROM n a, {_SIDES} s JOIN n b ON b.i = a.i + da AND b.j = a.j + db AND a.cls = b.cls),
walk AS (SELECT cell AS start, cell AS "at" FROM n UNION SELECT walk.start, e.b FROM walk JOIN e ON walk."at" = e.a),
l AS (SELECT n.cell, i, j, blob FROM n JOIN (SELECT start AS cell, min("at") AS blob FROM walk GROUP BY start) w ON w.cell = n.cell)
SELECT a.blob, a.cell, side FROM (SELECT * FROM l, {_SIDES} s) a LEFT JOIN l o ON o.i = a.i + da AND o.j = a.j + db AND o.blob = a.blob WHERE o.cell IS NULL""")
def g11(members):
    return B.blob_boundary(B.blobs(members, "cls"))


@q("g11_outline_rings", ("members",), f"""WITH RECURSIVE n AS (SELECT * FROM members),
e AS (SELECT a.cell AS a, b.cell AS b FROM n a, {_SIDES} s JOIN n b ON b.i = a.i + da AND b.j = a.j + db AND a.cls = b.cls),
walk AS (SELECT cell AS start, cell AS "at" FROM n UNION SELECT walk.start, e.b FROM walk JOIN e ON walk."at" = e.a),
l AS (SELECT n.cell, i, j, blob FROM n JOIN (SELECT start AS cell, min("at") AS blob FROM walk GROUP BY start) w ON w.cell = n.cell),
-- one ring more than holes, and holes by Euler's formula: 1 - cells + neighbour pairs - full corners
c AS (SELECT a.blob, count(*) AS cells, count(u.cell) + count(v.cell) + count(w.cell) AS pairs, count(CASE WHEN u.cell IS NOT NULL THEN w.cell END) + count(CASE WHEN v.cell IS NOT NULL THEN w.cell END) AS corners
 FROM l a LEFT JOIN l u ON u.i = a.i + 1 AND u.j = a.j AND u.blob = a.blob LEFT JOIN l v ON v.i = a.i AND v.j = a.j + 1 AND v.blob = a.blob LEFT JOIN l w ON w.i = a.i + 1 AND w.j = a.j + 1 AND w.blob = a.blob GROUP BY a.blob)
SELECT blob, 6 * cells - 2 * pairs AS n_sides, 2 - cells + pairs - corners AS n_rings FROM c""")
def g11_rings(members):
    rings = B.outline_rings(B.blob_boundary(B.blobs(members, "cls")))
    return rings.groupBy("blob").agg(F.count("*").alias("n_sides"), F.count_distinct("ring_cell", "ring_side").alias("n_rings"))


@q("g11_blob_polygons", ("members",), f"""WITH RECURSIVE n AS (SELECT * FROM members),
e AS (SELECT a.cell AS a, b.cell AS b FROM n a, {_SIDES} s JOIN n b ON b.i = a.i + da AND b.j = a.j + db AND a.cls = b.cls),
walk AS (SELECT cell AS start, cell AS "at" FROM n UNION SELECT walk.start, e.b FROM walk JOIN e ON walk."at" = e.a),
l AS (SELECT n.cell, i, j, blob FROM n JOIN (SELECT start AS cell, min("at") AS blob FROM walk GROUP BY start) w ON w.cell = n.cell),
-- one ring more than holes, and holes by Euler's formula: 1 - cells + neighbour pairs - full corners
c AS (SELECT a.blob, count(*) AS cells, count(u.cell) + count(v.cell) + count(w.cell) AS pairs, count(CASE WHEN u.cell IS NOT NULL THEN w.cell END) + count(CASE WHEN v.cell IS NOT NULL THEN w.cell END) AS corners
 FROM l a LEFT JOIN l u ON u.i = a.i + 1 AND u.j = a.j AND u.blob = a.blob LEFT JOIN l v ON v.i = a.i AND v.j = a.j + 1 AND v.blob = a.blob LEFT JOIN l w ON w.i = a.i + 1 AND w.j = a.j + 1 AND w.blob = a.blob GROUP BY a.blob)
SELECT blob, 6 * cells - 2 * pairs AS n_sides, 2 - cells + pairs - corners AS n_rings, round(cells * {H.cell_area_km2(RES) * 1e6!r}::DOUBLE, 4) AS area_m2, (9 + 20 * (2 - cells + pairs - corners) + 16 * (6 * cells - 2 * pairs))::BIGINT AS n_bytes FROM c""")
def g11_polygons(members):
    """Outlines with holes as well-known binary; the area is that of the rings."""
    made = B.polygons(B.blob_boundary(B.blobs(members, "cls")), RES)
    return made.select("blob", "n_sides", "n_rings", F.round("area_m2", 4).alias("area_m2"), F.octet_length("wkb").cast("long").alias("n_bytes"))


_TALLY = """s AS (SELECT parent, ts, coalesce(sum(w) FILTER (WHERE value >= 50), 0) AS wet, sum(w) AS tot, count(value) AS seen FROM radar GROUP BY parent, ts),
t AS (SELECT s.ts, coalesce(plane >= 50, false) AS m, wet * 2 > tot AS r FROM s LEFT JOIN model USING (parent, ts) WHERE seen > 0),
k AS (SELECT ts, count(*) FILTER (WHERE m AND r) AS hit, count(*) FILTER (WHERE NOT m AND r) AS miss, count(*) FILTER (WHERE m AND NOT r) AS false_alarm FROM t GROUP BY ts)"""


@q("g12_g13_skill", ("radar", "model"), f"WITH {_TALLY} SELECT *, round(hit / nullif(hit + miss + false_alarm, 0)::DOUBLE, 6) AS csi, round(hit / nullif(hit + miss, 0)::DOUBLE, 6) AS pod, round(false_alarm / nullif(hit + false_alarm, 0)::DOUBLE, 6) AS far FROM k")
def g12(radar, model):
    return G.skill(G.contingency(model, radar, 50.0, "majority"))


@q("g14_support_share", ("radar", "model"), "SELECT parent, ts, round(coalesce(sum(w) FILTER (WHERE value >= 50), 0) / sum(w)::DOUBLE, 6) AS share FROM radar JOIN model USING (parent, ts) WHERE plane >= 50 AND value IS NOT NULL GROUP BY parent, ts")
def g14(radar, model):
    return G.support_share(model.where("plane >= 50"), radar, 50.0)


_DISK = "(SELECT unnest([-1, -1, 0, 0, 0, 1, 1]) AS da, unnest([-1, 0, -1, 0, 1, 0, 1]) AS db)"


@q("g15_g16_smooth_lift", ("members",), f"""WITH nb AS (SELECT m.cell, coalesce(o.cell, m.cell) AS n FROM (SELECT * FROM members, {_DISK} s) m LEFT JOIN members o ON o.i = m.i + da AND o.j = m.j + db),
r1 AS (SELECT nb.cell, avg(npx) AS g FROM nb JOIN members o ON o.cell = nb.n GROUP BY nb.cell), r2 AS (SELECT nb.cell, avg(g) AS g FROM nb JOIN r1 ON r1.cell = nb.n GROUP BY nb.cell)
SELECT cell, round(g, 6) AS g, round(0.2 + 0.8 * (g + 0.5 * (npx - g)), 6) AS lift FROM r2 JOIN members USING (cell)""")
def g15(members):
    lift = 0.2 + 0.8 * (F.col("g") + 0.5 * (F.col("npx") - F.col("g")))
    return B.smooth(members, "npx", 2, "g").select("cell", "g", lift.alias("lift"))


@q("g17_seam_dissolve", ("px",), f"""WITH p AS (SELECT DISTINCT cls AS zone, yr, i, j, cell, 'zone ' || cls AS name FROM px), n AS (SELECT DISTINCT zone, i, j, cell FROM p),
s AS (SELECT a.zone, count(*) AS n_sides FROM (SELECT * FROM n, {_SIDES} s) a LEFT JOIN n o ON o.i = a.i + da AND o.j = a.j + db AND o.zone = a.zone WHERE o.cell IS NULL GROUP BY a.zone)
SELECT p.zone, count(*) AS n_pieces, count(DISTINCT cell) AS ncell, any_value(name) AS name, any_value(n_sides) AS n_sides FROM p JOIN s ON p.zone = s.zone GROUP BY p.zone""")
def g17(px):
    """Tile pieces of a zone, cut by year, are one shape again, with its outline."""
    pieces = px.select(F.col("cls").alias("zone"), "yr", "cell", F.concat(F.lit("zone "), F.col("cls").cast("string")).alias("name")).distinct()
    return B.dissolve(pieces, "zone", ["name"])


@q("g18_division_filter", ("*",), "SELECT n_nationkey AS id, split_part(n_name, '_', 2) AS suffix FROM nation WHERE n_regionkey IN (1, 2) AND n_nationkey NOT IN (3, 11)")
def g18(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_regionkey IN (1, 2) AND n_nationkey NOT IN (3, 11)")
    return n.select(F.col("n_nationkey").alias("id"), F.coalesce(F.get(F.split("n_name", "_", -1), F.lit(1)), F.lit("")).alias("suffix"))

