"""Queries of the join family (J*) and set operations (U*)."""

from pyspark.sql import functions as F

from gridcells.functions import cells as H
from gridcells.operators import joins as J
from gridcells.operators.stats import quantiles
from gridcells.plans.book import Book
from gridcells.plans.views import PARENT_SQL, RES, parent_of
from gridcells.runtime import staged

BOOK = Book()
q = BOOK.add

_DISK = "(SELECT unnest([-1, -1, 0, 0, 0, 1, 1]) AS da, unnest([-1, 0, -1, 0, 1, 0, 1]) AS db)"
_MATCH = f"""m AS (SELECT a.id, b.id AS b_id, CASE WHEN da = 0 AND db = 0 THEN 0 ELSE 1 END AS how, sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) AS dist
 FROM grid_a a, {_DISK} s JOIN grid_b b ON b.i = a.i + da AND b.j = a.j + db),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY how, dist, b_id) AS rk FROM m)"""


@q("j01_label_join", ("grid_a", "grid_b"), "SELECT a.cell, a.x, b.x AS bx FROM grid_a a LEFT JOIN grid_b b ON a.cell = b.cell")
def j01(a, b):
    return a.select("cell", "x").join(b.select("cell", F.col("x").alias("bx")), "cell", "left")


@q("j02_ring_fill", ("grid_a", "grid_b"), f"WITH {_MATCH} SELECT a.id, b_id, coalesce(how, 2) AS how, round(dist, 6) AS dist FROM grid_a a LEFT JOIN (SELECT * FROM r WHERE rk = 1) r ON a.id = r.id")
def j02(a, b):
    return J.match_grids(a, b)


#: Pairs up to six steps apart on the lattice of 3 km; a nearest point within 17 km is among them.
_NEAR = """o AS (SELECT unnest(range(-6, 7)) AS d), t AS (SELECT a.id, b.id AS t_id, sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) AS t_dist FROM (SELECT a.*, x.d AS da, y.d AS db FROM grid_a a, o x, o y) a JOIN grid_b b ON b.i = a.i + da AND b.j = a.j + db),
n AS (SELECT id, t_id, t_dist FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY t_dist, t_id) = 1)"""


@q("j03_true_nearest", ("grid_a", "grid_b"), f"WITH {_NEAR} SELECT id, t_id AS b_id, round(t_dist, 6) AS dist FROM n")
def j03(a, b):
    return J.nearest(a, b)


@q("j04_agreement", ("grid_a", "grid_b"), f"""WITH {_NEAR}, {_MATCH} SELECT how, count(*) AS n, round(avg((b_id = t_id)::INT), 6) AS agree, round(quantile_cont(dist, 0.5), 6) AS p50, round(quantile_cont(dist, 0.95), 6) AS p95, round(max(dist - t_dist), 6) AS worst
FROM n JOIN r ON r.id = n.id AND rk = 1 GROUP BY how""")
def j04(a, b):
    a, b = staged(a, "grid-a"), staged(b, "grid-b")
    true = J.nearest(a, b).withColumnsRenamed({"b_id": "t_id", "dist": "t_dist"})
    m = staged(J.match_grids(a, b).where("how < 2").join(true, "id"), "agreement")
    table = m.groupBy("how").agg(F.count("*").alias("n"), F.avg((F.col("b_id") == F.col("t_id")).cast("double")).alias("agree"), F.max(F.col("dist") - F.col("t_dist")).alias("worst"))
    q = quantiles(m, "dist", [0.5, 0.95], ["how"])
    return table.join(q, "how").select("how", "n", "agree", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), "worst")


@q("j05_u04_reverse_semi", ("grid_a", "grid_b"), "SELECT count(*) AS n FROM grid_b WHERE cell IN (SELECT cell FROM grid_a)")
def j05(a, b):
    return b.join(a.select("cell"), "cell", "left_semi").agg(F.count("*").alias("n"))


@q("j06_scatter_back", ("grid_a", "px"), "SELECT a.cell, m.v FROM grid_a a JOIN (SELECT cell, max(v) AS v FROM px WHERE id % 2 = 1 GROUP BY cell) m ON a.cell = m.cell")
def j06(a, px):
    return a.select("cell").join(px.where("id % 2 = 1").groupBy("cell").agg(F.max("v").alias("v")), "cell")


@q("j07_own_or_ring", ("grid_a", "px"), f"""WITH p AS (SELECT i, j, v FROM px WHERE id % 2 = 1),
m AS (SELECT a.cell, (da = 0 AND db = 0) AS own, v FROM grid_a a, {_DISK} s JOIN p ON p.i = a.i + da AND p.j = a.j + db),
f AS (SELECT *, max(own::INT) OVER (PARTITION BY cell) AS has FROM m)
SELECT cell, round(avg(v), 4) AS mean, max(v) AS max, count(*) AS n, has = 1 AS own FROM f WHERE own OR has = 0 GROUP BY cell, has""")
def j07(a, px):
    return J.own_or_ring(a, px.where("id % 2 = 1")).withColumn("mean", F.round("mean", 4))


@q("j08_u02_inner_folds", ("px",), "SELECT cell, x.v AS early, y.v AS late FROM (SELECT cell, sum(v)::BIGINT AS v FROM px WHERE yr <= 1996 GROUP BY cell) x JOIN (SELECT cell, sum(v)::BIGINT AS v FROM px WHERE yr >= 2000 GROUP BY cell) y USING (cell)")
def j08(px):
    one = lambda c, n: px.where(c).groupBy("cell").agg(F.sum("v").alias(n))
    return one("yr <= 1996", "early").join(one("yr >= 2000", "late"), "cell")


@q("j10_label_lookup", ("grid_a", "px"), "SELECT a.cell, coalesce(n_wf, 0) AS n_wf, first_yr FROM grid_a a LEFT JOIN (SELECT cell, count(*) AS n_wf, min(yr) AS first_yr FROM px WHERE cls = 5 GROUP BY cell) l ON a.cell = l.cell")
def j10(a, px):
    labels = px.where("cls = 5").groupBy("cell").agg(F.count("*").alias("n_wf"), F.min("yr").alias("first_yr"))
    return J.label_lookup(a.select("cell"), labels, ["n_wf"])


@q("j11_yearly_left_join", ("members", "px"), "SELECT m.cell, y.yr, y.v FROM members m LEFT JOIN (SELECT cell, yr, max(v) AS v FROM px WHERE ok GROUP BY cell, yr) y ON m.cell = y.cell")
def j11(members, px):
    return members.select("cell").join(px.where("ok").groupBy("cell", "yr").agg(F.max("v").alias("v")), "cell", "left")


@q("j13_latest_year_wins", ("grid_a", "px"), "SELECT a.cell, s.sev, s.sev_year FROM grid_a a LEFT JOIN (SELECT cell, max(yr) AS sev_year, arg_max(sev, yr) AS sev FROM (SELECT cell, yr, max(cls) AS sev FROM px WHERE cls > 11 GROUP BY cell, yr) t GROUP BY cell) s ON a.cell = s.cell")
def j13(a, px):
    yearly = px.where("cls > 11").groupBy("cell", F.col("yr").alias("year")).agg(F.max("cls").alias("sev"))
    return J.latest_by_year(a.select("cell"), yearly, "sev")


@q("j14_nested_levels", ("px",), "SELECT l.lvl, count(*) AS n, sum(v)::BIGINT AS v FROM px JOIN (SELECT unnest([2, 5, 9, 14]) AS lvl) l ON px.cls >= l.lvl GROUP BY l.lvl")
def j14(px):
    return J.at_levels(px, "cls", [2, 5, 9, 14]).groupBy("lvl").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


@q("j15_neighbour_pairs", ("members",), f"SELECT a.cell AS a, b.cell AS b, a.cls FROM members a, {_DISK} s JOIN members b ON b.i = a.i + da AND b.j = a.j + db AND a.cls = b.cls WHERE a.cell < b.cell")
def j15(members):
    return J.neighbour_pairs(members, "cls")


_HITS = """h AS (SELECT p.id, z.poly FROM p JOIN zones z ON (z.y0 <= p.y) <> (z.y1 <= p.y) AND p.x < z.x0 + (p.y - z.y0) * (z.x1 - z.x0) / (z.y1 - z.y0) GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


@q("j16_j18_divisions", ("*", "grid_a", "zones"), f"""WITH p AS (SELECT id, i + 0.25::DOUBLE AS x, j + 0.25::DOUBLE AS y FROM grid_a), {_HITS},
f AS (SELECT h.id, h.poly, ['locality', 'county', 'region', 'country'][1 + poly % 4] AS subtype FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY id, subtype ORDER BY poly) AS k FROM f)
SELECT id, poly, subtype, n_name AS name, (poly % 4)::INT AS rank FROM r JOIN nation ON n_nationkey = poly WHERE k = 1""")
def j16(spark, sf_dir, a, zones):
    from gridcells.runtime import table

    points = a.select("id", (F.col("i") + 0.25).alias("x"), (F.col("j") + 0.25).alias("y"))
    kinds = ["locality", "county", "region", "country"]
    attrs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("poly"), F.element_at(F.array(*map(F.lit, kinds)), (1 + F.col("n_nationkey") % 4).cast("int")).alias("subtype"), F.col("n_name").alias("name"))
    return J.divisions_at(points, zones, attrs, {k: i for i, k in enumerate(kinds)}).select("id", "poly", "subtype", "name", "rank")


@q("j17_enrich_by_ids", ("*",), "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2 AND list_contains([1, 5, 9, 33, 50], s_suppkey % 60)")
def j17(spark, sf_dir):
    from gridcells.runtime import table

    s = table(spark, sf_dir, "supplier").where((F.col("s_suppkey") % 60).isin(1, 5, 9, 33, 50))
    n = table(spark, sf_dir, "nation").where("n_regionkey = 2")
    return s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "s_name", "n_name")


@q("j19_peer_medians", ("px",), "WITH m AS (SELECT cls, median(v) AS peer_median, count(*) AS peers FROM px GROUP BY cls) SELECT id, ln, cls, v, peer_median, peers FROM px JOIN m USING (cls) WHERE i = 7 AND j = 3")
def j19(px):
    from gridcells.operators.report import peer_compare

    return peer_compare(px, F.expr("i = 7 AND j = 3"), "cls", "v").select("id", "ln", "cls", "v", "peer_median", "peers")


@q("j20_zone_of_pixels", ("px",), f"WITH z AS (SELECT DISTINCT {PARENT_SQL} AS parent FROM px WHERE cls = 2 AND i < 90) SELECT cell, count(*) AS n FROM px WHERE {PARENT_SQL} IN (SELECT parent FROM z) GROUP BY cell")
def j20(px):
    zone = px.where("cls = 2 AND i < 90").select(parent_of().alias("cell"), F.lit(1).alias("poly")).distinct()
    return J.assign_zone(px, zone, parent_of()).groupBy("cell").agg(F.count("*").alias("n"))


@q("j21_common_parent", ("grid_a", "grid_b"), f"WITH a AS (SELECT {PARENT_SQL} AS p, count(*) AS na FROM grid_a GROUP BY 1), b AS (SELECT {PARENT_SQL} AS p, count(*) AS nb FROM grid_b GROUP BY 1) SELECT a.p AS parent, na, coalesce(nb, -1) AS nb FROM a LEFT JOIN b ON a.p = b.p")
def j21(a, b):
    up = lambda g, n: g.groupBy(H.cell_parent("cell", RES - 1, RES).alias("parent")).agg(F.count("*").alias(n))
    return up(a, "na").join(up(b, "nb"), "parent", "left").fillna(-1, ["nb"])


@q("u01_distinct_cells", ("px",), "SELECT DISTINCT cell FROM px WHERE cls < 5")
def u01(px):
    return px.where("cls < 5").select("cell").distinct()


@q("u02_intersect", ("grid_a", "grid_b"), "SELECT cell FROM grid_a INTERSECT SELECT cell FROM grid_b")
def u02(a, b):
    return a.select("cell").intersect(b.select("cell"))


@q("u03_union_all", ("grid_a", "grid_b"), "SELECT cell, 'a' AS src FROM grid_a UNION ALL SELECT cell, 'b' FROM grid_b")
def u03(a, b):
    return a.select("cell", F.lit("a").alias("src")).unionByName(b.select("cell", F.lit("b").alias("src")))


