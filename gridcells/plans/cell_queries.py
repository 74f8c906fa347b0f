"""Queries of the cell index (H*) and the scalar functions (P*)."""

import math

from pyspark.sql import functions as F

from gridcells.functions import cells as H
from gridcells.functions import exprs as X
from gridcells.operators import joins as J
from gridcells.plans.book import Book
from gridcells.plans.views import CELL_SQL, PARENT_SQL, RES, sql_pack, sql_parent
from gridcells.runtime import table

BOOK = Book()
q = BOOK.add

_PLANE = f"radians(lon) * {H.EARTH_M} AS x, sin(radians(lat)) * {H.EARTH_M} AS y"
_FINE = f"""g AS (SELECT id, ln, {_PLANE} FROM px_geo), a AS (SELECT *, y / {H.EDGE_M * math.sqrt(3) / 2!r} AS fj FROM g), b AS (SELECT *, x / {H.EDGE_M} + fj / 2 - fj AS fq FROM a),
c AS (SELECT *, round_even(fq, 0) AS rq, round_even(fj, 0) AS rj, round_even(-fq - fj, 0) AS rs FROM b),
e AS (SELECT *, abs(rq - fq) > abs(rj - fj) AND abs(rq - fq) > abs(rs + fq + fj) AS wq, abs(rj - fj) > abs(rs + fq + fj) AS wj FROM c),
f AS (SELECT id, ln, CASE WHEN wq THEN -rj - rs ELSE rq END AS q, CASE WHEN wq THEN rj WHEN wj THEN -rq - rs ELSE rj END AS r FROM e),
l12 AS (SELECT id, ln, (q + r)::BIGINT AS i, r::BIGINT AS j FROM f)"""


def _chain(to: int) -> str:
    out = []
    for r in range(RES, to, -1):
        i, j = sql_parent("i", "j", r)
        out.append(f"l{r - 1} AS (SELECT id, ln, {i} AS i, {j} AS j FROM l{r})")
    return ", ".join(out)


@q("h01_latlng_to_cell", ("px_geo",), f"WITH {_FINE}, {_chain(5)} SELECT id, ln, {sql_pack(5, 'i', 'j')} AS cell FROM l5")
def h01(px_geo):
    return H.add_cell(px_geo, "lat", "lon", 5).select("id", "ln", "cell")


@q("h02_cell_parent", ("px",), f"SELECT cell, {PARENT_SQL} AS parent, count(*) AS n FROM px GROUP BY 1, 2")
def h02(px):
    return px.groupBy("cell").agg(F.count("*").alias("n")).select("cell", H.cell_parent("cell", RES - 1, RES).alias("parent"), "n")


_DISK = "(SELECT unnest([-1, -1, 0, 0, 0, 1, 1]) AS a, unnest([-1, 0, -1, 0, 1, 0, 1]) AS b)"


@q("h03_grid_disk", ("grid_a",), f"SELECT cell, {sql_pack(RES, 'i + a', 'j + b')} AS near FROM grid_a, {_DISK} s")
def h03(grid_a):
    return grid_a.select("cell", F.explode(H.grid_disk("cell")).alias("near"))


@q("h04_neighbour_table", ("grid_a",), f"SELECT g.cell, (row_number() OVER (PARTITION BY g.cell ORDER BY a, b) - 1)::INT AS k, coalesce(o.cell, g.cell) AS neighbour FROM (SELECT * FROM grid_a, {_DISK} s) g LEFT JOIN grid_a o ON o.i = g.i + a AND o.j = g.j + b")
def h04(grid_a):
    return J.neighbour_table(grid_a)


@q("h05_cell_to_latlng", ("px_geo",), f"WITH {_FINE} SELECT id, ln, round(degrees(asin(j * {H.EDGE_M * math.sqrt(3) / 2!r} / {H.EARTH_M})), 6) AS lat, round(degrees((i - j / 2.0::DOUBLE) * {H.EDGE_M} / {H.EARTH_M}), 6) AS lon FROM l12")
def h05(px_geo):
    c = H.cell_to_latlng(H.latlng_to_cell("lat", "lon", RES), RES)
    return px_geo.select("id", "ln", c["lat"].alias("lat"), c["lon"].alias("lon"))


@q("h06_cell_boundary", ("grid_a",), f"""WITH v AS (SELECT unnest([20.0::DOUBLE, 10, -10, -20, -10, 10]) AS vx, unnest([0.0::DOUBLE, {10 * math.sqrt(3)!r}, {10 * math.sqrt(3)!r}, 0, {-10 * math.sqrt(3)!r}, {-10 * math.sqrt(3)!r}]) AS vy, unnest([0, 1, 2, 3, 4, 5]) AS k),
w AS (SELECT a.k, (a.vx + b.vx) / 3 AS dx, (a.vy + b.vy) / 3 AS dy FROM v a JOIN v b ON b.k = (a.k + 1) % 6)
SELECT cell, (k + 7 * 0)::INT AS k, round((i - j / 2.0::DOUBLE) * 20 + dx, 4) AS x, round(j * {10 * math.sqrt(3)!r} + dy, 4) AS y FROM grid_a, (SELECT * FROM w UNION ALL SELECT 6, dx, dy FROM w WHERE k = 0) u""")
def h06(grid_a):
    ring = grid_a.select("cell", F.posexplode(H.cell_boundary("cell", RES)).alias("k", "p"))
    return ring.select("cell", "k", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@q("h07_area_by_class", ("members",), f"SELECT cls, count(*) AS n, round(count(*) * {H.cell_area_km2(RES)!r}::DOUBLE, 6) AS km2 FROM members GROUP BY cls")
def h07(members):
    return members.groupBy("cls").agg(F.count("*").alias("n"), (F.count("*") * H.cell_area_km2(RES)).alias("km2"))


@q("h08_label_uniqueness", ("px",), "SELECT count(*) AS pixels, count(DISTINCT cell) AS labels, count(DISTINCT (i, j)) AS places FROM px")
def h08(px):
    return px.agg(F.count("*").alias("pixels"), F.count_distinct("cell").alias("labels"), F.count_distinct("i", "j").alias("places"))


@q("h09_polyfill", ("grid_a", "zones"), """WITH c AS (SELECT g.cell, z.poly, count(*) AS n FROM grid_a g JOIN zones z ON (z.y0 <= g.j) <> (z.y1 <= g.j) AND g.i < z.x0 + (g.j - z.y0) * (z.x1 - z.x0) / (z.y1 - z.y0) GROUP BY 1, 2)
SELECT cell, min(poly) AS poly FROM c WHERE n % 2 = 1 GROUP BY cell""")
def h09(grid_a, zones):
    return J.polyfill(grid_a.select("cell", F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y")), zones)


@q("h10_locate_snap", ("grid_a", "grid_b"), "SELECT b.id, coalesce(a.i, floor((b.x + 1500) / 3000)::BIGINT) AS row, coalesce(a.j, floor((b.y + 1500) / 3000)::BIGINT) AS col, a.cell IS NOT NULL AS exact FROM grid_b b LEFT JOIN grid_a a ON a.cell = b.cell")
def h10(grid_a, grid_b):
    a = grid_a.select("cell", F.col("i").alias("ai"), F.col("j").alias("aj"))
    snap = lambda c: X.pixel_of(F.col(c), -1500.0, 3000.0)
    return grid_b.join(a, "cell", "left").select("id", F.coalesce("ai", snap("x")).alias("row"), F.coalesce("aj", snap("y")).alias("col"), F.col("ai").isNotNull().alias("exact"))


@q("h11_resolution_ladder", ("px",), f"""WITH b AS (SELECT cls, count(*) AS n, (max(i) - min(i) + 1) * (max(j) - min(j) + 1) * power(10.0::DOUBLE, (cls % 5) - 2) AS km2 FROM px GROUP BY cls),
r AS (SELECT unnest(range(0, {RES} + 1)) AS res), a AS (SELECT res, {H.EDGE_M!r} * {H.EDGE_M!r} * sqrt(3.0::DOUBLE) / 2 * power(7.0::DOUBLE, {RES} - res) / 1e6 AS cell FROM r)
SELECT cls, n, round(km2, 6) AS km2, coalesce(max(res) FILTER (WHERE km2 / cell <= 5000), 0)::INT AS res FROM b, a GROUP BY cls, n, km2""")
def h11(px):
    """The resolution of each class's own window, windows of five sizes."""
    span = lambda c: F.max(c) - F.min(c) + 1
    b = px.groupBy("cls").agg(F.count("*").alias("n"), (span("i") * span("j")).alias("px"))
    km2 = F.col("px") * F.pow(F.lit(10.0), F.col("cls") % 5 - 2)
    return b.select("cls", "n", km2.alias("km2"), H.pick_res_of(km2, 5_000, RES).alias("res"))


@q("x01_focal_mean", ("pixels",), f"""WITH d AS (SELECT unnest(range(-2, 3)) AS a), s AS (SELECT x.a, y.a AS b FROM d x, d y WHERE greatest(abs(x.a), abs(y.a), abs(x.a - y.a)) <= 2)
SELECT {CELL_SQL.replace('i)', 'p.i)').replace('j)', 'p.j)')} AS cell, round(avg(o.v), 4) AS mean, count(*) AS n FROM pixels p, s JOIN pixels o ON o.i = p.i + a AND o.j = p.j + b GROUP BY 1""")
def x01(pixels):
    cells = pixels.select(H.pack(RES, "i", "j").alias("cell"), "v")
    # each pixel goes to the 19 cells whose window holds it
    sent = cells.select(F.explode(H.grid_disk("cell", 2)).alias("cell"), "v")
    return sent.groupBy("cell").agg(F.round(F.avg("v"), 4).alias("mean"), F.count("*").alias("n")).join(cells.select("cell"), "cell", "left_semi")


_HI = """CASE WHEN (s + f) / 2 >= 80 THEN -42.379 + 2.04901523 * f + 10.14333127 * rh - 0.22475541 * f * rh - 6.83783e-3 * f * f - 5.481717e-2 * rh * rh + 1.22874e-3 * f * f * rh + 8.5282e-4 * f * rh * rh - 1.99e-6 * f * f * rh * rh
 - CASE WHEN rh < 13 AND f BETWEEN 80 AND 112 THEN (13 - rh) / 4 * sqrt(greatest((17 - abs(f - 95)) / 17, 0)) ELSE 0 END + CASE WHEN rh > 85 AND f BETWEEN 80 AND 87 THEN (rh - 85) / 10 * ((87 - f) / 5) ELSE 0 END ELSE s END"""


@q("p02_p05_heat_index", ("weather",), f"""WITH a AS (SELECT pixel, ts, rh, t * 9 / 5 + 32 AS f FROM weather), b AS (SELECT *, 0.5 * (f + 61 + (f - 68) * 1.2 + rh * 0.094) AS s FROM a), c AS (SELECT pixel, ts, ({_HI} - 32) * 5 / 9 AS h FROM b)
SELECT pixel, ts, round(h, 6) AS hi, least(greatest(round_even((h + 40) * 2, 0), 0), 254)::INT AS q FROM c""")
def p02(weather):
    h = weather.select("pixel", "ts", X.heat_index_c(F.col("t"), F.col("rh")).alias("hi"))
    return h.withColumn("q", X.quantise(F.col("hi"), -40.0, 0.5))


@q("p03_p04_fire_weather", ("weather",), """WITH a AS (SELECT pixel, ts, t * 9 / 5 + 32 AS f, least(greatest(rh, 0), 100) AS h, sqrt(u * u + w * w) AS ws FROM weather),
b AS (SELECT *, least(greatest(CASE WHEN h < 10 THEN 0.03229 + 0.281073 * h - 0.000578 * h * f WHEN h < 50 THEN 2.22749 + 0.160107 * h - 0.01478 * f ELSE 21.0606 + 0.005565 * h * h - 0.00035 * h * f - 0.483199 * h END, 0), 30) / 30 AS m, ws * 2.23694 AS mph FROM a)
SELECT pixel, ts, round(ws, 6) AS wind, round(least(greatest((1 - 2 * m + 1.5 * m * m - 0.5 * m * m * m) * sqrt(1 + mph * mph) / 0.3002, 0), 100), 6) AS ffwi FROM b""")
def p03(weather):
    wind = X.wind_speed(F.col("u"), F.col("w"))
    return weather.select("pixel", "ts", wind.alias("wind"), X.fire_weather_index(F.col("t"), F.col("rh"), wind).alias("ffwi"))


@q("p01_p06_p07_quantise_pack", ("weather",), """WITH a AS (SELECT pixel, ts, rain * 3600 / 1000 AS mm, least(greatest(round_even(16 * sqrt(greatest(rain, 0)), 0), 0), 254)::INT AS q, rain::INT AS lo, (value::BIGINT % 16)::INT AS hi FROM weather)
SELECT pixel, ts, round(mm, 6) AS mm, q, (hi << 4) | lo AS packed, (((hi << 4) | lo) >> 4) AS high, ((hi << 4) | lo) & 15 AS low FROM a""")
def p06(weather):
    packed = X.pack_nibbles(F.col("value").cast("long") % 16, F.col("rain"))
    return weather.select("pixel", "ts", (F.col("rain") * 3600 / 1000).alias("mm"), X.quantise_sqrt(F.col("rain")).alias("q"), packed.alias("packed"), X.high_nibble(packed).alias("high"), X.low_nibble(packed).alias("low"))


@q("p08_dequantise", ("emb",), "SELECT cell, year, round(sign(e) * power(e / 127.5, 2), 6) AS v FROM (SELECT cell, year, floor(vec[1] * 100)::DOUBLE AS e FROM emb) x")
def p08(emb):
    return emb.select("cell", "year", X.dequantise_signed_square(F.floor(F.get("vec", F.lit(0)) * 100).cast("double")).alias("v"))


@q("p09_p10_indices", ("px",), """SELECT cell, round(avg(CASE WHEN a > 0 AND b > 0 THEN (greatest(a - 1000, 1) - greatest(b - 1000, 1)) / (greatest(a - 1000, 1) + greatest(b - 1000, 1)) END), 6) AS nd
FROM (SELECT cell, (v % 4000)::DOUBLE AS a, ((v // 7) % 3000)::DOUBLE AS b FROM px) x GROUP BY cell""")
def p09(px):
    a, b = (F.col("v") % 4000).cast("double"), (F.expr("v div 7") % 3000).cast("double")
    return px.groupBy("cell").agg(F.avg(X.normalised_difference(a, b, 1000.0)).alias("nd"))


@q("p11_date_index", ("dates",), "SELECT idx, count(*) AS n, CASE WHEN idx > 0 THEN (2016 + (idx - 1) // 2)::INT END AS year, CASE WHEN idx > 0 THEN make_date(2016 + (idx - 1) // 2, CASE WHEN idx % 2 = 1 THEN 1 ELSE 7 END, 1) END AS half FROM dates GROUP BY idx")
def p11(dates):
    n = dates.groupBy("idx").agg(F.count("*").alias("n"))
    return n.select("idx", "n", X.index_year(F.col("idx")).alias("year"), X.index_date(F.col("idx")).alias("half"))


@q("p12_units_since", ("dates",), "SELECT DISTINCT idx, TIMESTAMP '2016-01-01 00:00:00' + to_hours(idx * 36) AS ts FROM dates")
def p12(dates):
    return dates.select("idx").distinct().select("idx", X.units_since(F.col("idx") * 36, "hours", "2016-01-01 00:00:00").alias("ts"))


_MERC = 6378137.0


@q("p13_web_mercator", ("px_geo",), f"""WITH a AS (SELECT DISTINCT lon, lat FROM px_geo), b AS (SELECT lon, lat, radians(lon) * {_MERC} AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * {_MERC} AS y FROM a)
SELECT round(lon, 6) AS lon, round(lat, 6) AS lat, round(x, 3) AS x, round(y, 3) AS y, round(degrees(x / {_MERC}), 6) AS lon2, round(degrees(2 * atan(exp(y / {_MERC})) - pi() / 2), 6) AS lat2,
 floor((lon + 180) / 360 * 256)::INT AS tx, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256)::INT AS ty FROM b""")
def p13(px_geo):
    a = px_geo.select("lon", "lat").distinct()
    x, y = X.web_mercator(F.col("lon"), F.col("lat"))
    lon2, lat2 = X.web_mercator_inverse(x, y)
    tx, ty = X.tile_index(F.col("lon"), F.col("lat"), 8)
    return a.select("lon", "lat", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), lon2.alias("lon2"), lat2.alias("lat2"), tx.alias("tx"), ty.alias("ty"))


_LAMBERT, _ALBERS = (-97.5, 38.5, 38.5, 38.5), (-96.0, 23.0, 29.5, 45.5)


@q("p14_projection_check", ("px_geo",), """WITH p AS (SELECT DISTINCT lon, lat FROM px_geo),
k AS (SELECT sin(radians(38.5)) AS n, cos(radians(38.5)) * power(tan(pi() / 4 + radians(38.5) / 2), sin(radians(38.5))) / sin(radians(38.5)) AS f, (sin(radians(29.5)) + sin(radians(45.5))) / 2 AS m),
l AS (SELECT lon, lat, n, f, m, 6370000 * f / power(tan(pi() / 4 + radians(38.5) / 2), n) AS top, 6370000 * f / power(tan(pi() / 4 + radians(lat) / 2), n) AS rho, n * radians(lon + 97.5) AS th,
 power(cos(radians(29.5)), 2) + 2 * m * sin(radians(29.5)) AS c, m * radians(lon + 96) AS ph FROM p, k),
x AS (SELECT *, rho * sin(th) AS lx, top - rho * cos(th) AS ly, 6370997 / m * sqrt(c - 2 * m * sin(radians(lat))) AS r FROM l),
i AS (SELECT *, sqrt(lx * lx + power(top - ly, 2)) AS back FROM x),
v AS (SELECT *, -97.5 + degrees(atan2(lx, top - ly) / n) AS lon2, degrees(2 * atan(power(6370000 * f / back, 1 / n)) - pi() / 2) AS lat2 FROM i)
SELECT round(lon, 6) AS lon, round(lat, 6) AS lat, round(lx, 3) AS lx, round(ly, 3) AS ly, round(r * sin(ph), 3) AS ax, round(6370997 / m * sqrt(c - 2 * m * sin(radians(23.0))) - r * cos(ph), 3) AS ay,
 round(lon2, 6) AS lon2, round(lat2, 6) AS lat2, sqrt(power((lat2 - lat) * 111000, 2) + power((lon2 - lon) * 111000 * cos(radians(lat)), 2)) <= 50 AS within FROM v""")
def p14(px_geo):
    """Lambert forward and back, which must come within 50 m, and Albers."""
    a = px_geo.select("lon", "lat").distinct()
    lx, ly = X.lambert_conic(F.col("lon"), F.col("lat"), *_LAMBERT)
    lon2, lat2 = X.lambert_conic_inverse(lx, ly, *_LAMBERT)
    ax, ay = X.albers(F.col("lon"), F.col("lat"), *_ALBERS)
    mm = {n: F.round(c, 3).alias(n) for n, c in {"lx": lx, "ly": ly, "ax": ax, "ay": ay}.items()}
    return a.select("lon", "lat", *mm.values(), lon2.alias("lon2"), lat2.alias("lat2"), (X.equirect_m(F.col("lat"), F.col("lon"), lat2, lon2) <= 50.0).alias("within"))


@q("p15_p16_affine_distance", ("pixels",), "SELECT i, j, (-125 + (j + 0.5) * 0.25)::DOUBLE AS x, (50 + (i + 0.5) * (-0.125))::DOUBLE AS y, round(sqrt(power((j + 0.5) * 0.25, 2) + power((i + 0.5) * 0.125, 2)), 6) AS planar, round(sqrt(power(((i + 0.5) * 0.125) * 111000, 2) + power((j + 0.5) * 0.25 * 111000 * cos(radians(50.0)), 2)), 3) AS metres FROM pixels")
def p15(pixels):
    x, y = X.pixel_centre(F.col("j"), -125.0, 0.25), X.pixel_centre(F.col("i"), 50.0, -0.125)
    zero = (F.lit(-125.0), F.lit(50.0))
    return pixels.select("i", "j", x.alias("x"), y.alias("y"), X.planar_distance(*zero, x, y).alias("planar"), F.round(X.equirect_m(zero[1], zero[0], y, x), 3).alias("metres"))


@q("p17_p19_class_year", ("records",), "SELECT h10, CASE status WHEN 'F' THEN 'wf' WHEN 'P' THEN 'rx' ELSE 'other' END AS kind, coalesce(CASE WHEN h10 % 3 <> 0 THEN year(dt) END, year(dt) + 1)::INT AS fy FROM records WHERE year(dt) BETWEEN 1996 AND 1999")
def p17(records):
    kind = F.when(F.col("status") == "F", "wf").when(F.col("status").isin("P"), "rx").otherwise("other")
    year = F.coalesce(F.when(F.col("h10") % 3 != 0, F.year("dt")), F.year("dt") + 1)
    return records.where(F.year("dt").between(1996, 1999)).select("h10", kind.alias("kind"), year.alias("fy"))


@q("p18_regex_filter", ("*",), "SELECT doc_id, source FROM documents WHERE regexp_matches(lower(text), 'licen[sc]e|warrant') AND NOT regexp_matches(lower(text), 'apache|gnu ')")
def p18(spark, sf_dir):
    low = F.lower("text")
    return table(spark, sf_dir, "documents").where(low.rlike("licen[sc]e|warrant") & ~low.rlike("apache|gnu ")).select("doc_id", "source")


@q("p20_sigmoid", ("pixels",), "SELECT i, j, round(1 / (1 + exp(-least(greatest((v % 200000) / 1000.0::DOUBLE - 100, -40), 40))), 6) AS s FROM pixels")
def p20(pixels):
    return pixels.select("i", "j", X.sigmoid(F.col("v") % 200_000 / 1000.0 - 100).alias("s"))


@q("p22_buckets", ("pixels",), "SELECT i, j, CASE WHEN t >= 0.75 THEN 'most' WHEN t >= 0.4 THEN 'much' WHEN t >= 0.15 THEN 'some' ELSE 'little' END AS label FROM (SELECT i, j, (v % 1000) / 1000.0::DOUBLE AS t FROM pixels) x")
def p22(pixels):
    return pixels.select("i", "j", X.case_bins(F.col("v") % 1000 / 1000.0, [(0.75, "most"), (0.4, "much"), (0.15, "some")], "little").alias("label"))


