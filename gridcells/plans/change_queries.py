"""Queries of scans over time, change and statistics (W*, C*, X3, X4, X7, X8)."""

from pyspark.sql import functions as F

from gridcells.operators import change as C
from gridcells.operators import stats as S
from gridcells.plans.book import Book
from gridcells.plans.views import PARENT_SQL, parent_of
from gridcells.runtime import staged

BOOK = Book()
q = BOOK.add


@q("w01_c18_track", ("film",), """WITH b AS (SELECT pixel // 10 AS blob, date_trunc('day', ts) AS ts, sum(value) AS km2 FROM film GROUP BY 1, 2), r AS (SELECT *, sum(km2) OVER (PARTITION BY ts) AS total, row_number() OVER (PARTITION BY ts ORDER BY km2 DESC, blob) AS rk FROM b)
SELECT blob, ts, km2, total FROM r WHERE rk = 1""")
def w01(film):
    from gridcells.operators.report import track

    b = film.groupBy(F.expr("pixel div 10").alias("blob"), F.date_trunc("day", "ts").alias("ts")).agg(F.sum("value").alias("km2"))
    return track(b)


_T0 = "2024-01-01 00:00:00"


ACCUMULATOR_SQL = f"""WITH RECURSIVE f AS (SELECT pixel, ts, (epoch(ts) // 3600)::BIGINT AS h, greatest(value - 20000, 0) / 1000 * greatest(0, 1 - 0.1 * w / 10) AS x,
 CASE WHEN rain > 0 THEN 1 - 0.5 * least(1.0::DOUBLE, rain / 2.5) ELSE 1 END AS fl, row_number() OVER (PARTITION BY pixel ORDER BY ts) AS k FROM weather),
s AS (SELECT pixel, ts, h, k, CASE WHEN h <= epoch(TIMESTAMP '{_T0}') // 3600 THEN 0.0::DOUBLE ELSE fl * (1 - power(2, -1 / 24.0::DOUBLE)) * x END AS load FROM f WHERE k = 1
 UNION ALL SELECT f.pixel, f.ts, f.h, f.k, fl * (load * power(power(2, -1 / 24.0::DOUBLE), f.h - s.h) + (1 - power(2, -1 / 24.0::DOUBLE)) * x) FROM s JOIN f ON f.pixel = s.pixel AND f.k = s.k + 1)
SELECT pixel, ts, round(load, 5) AS load FROM s"""


@q("w03_accumulator", ("weather",), ACCUMULATOR_SQL)
def w03(weather):
    """Heat load with a 24-hour half life, thinned by wind and flushed by rain."""
    film = weather.select("pixel", "ts", (C.excess(F.col("value"), 20_000.0, F.col("w"), 0.1) / 1000).alias("x"), C.rain_flush(F.col("rain"), 0.5).alias("fl"))
    return C.accumulate(film, 24.0, _T0, "fl").withColumn("load", F.round("load", 5))


@q("w04_running_drop", ("annual",), "SELECT cell, year, value, unc, round(max(value) OVER w, 6) AS runmax, round(max(value) OVER w - value, 4) AS \"drop\" FROM annual WINDOW w AS (PARTITION BY cell ORDER BY year)".replace("value, unc", "round(value, 6) AS value, unc"))
def w04(annual):
    return C.running_drop(annual).withColumn("drop", F.round("drop", 4))


@q("w05_c09_loss", ("annual",), """WITH w AS (SELECT *, max(value) OVER (PARTITION BY cell ORDER BY year) AS rm FROM annual WHERE year BETWEEN 1995 AND 2001),
g AS (SELECT cell, max(value) FILTER (WHERE year = 1995) AS a0, max(value) FILTER (WHERE year = 2001) AS a1, max(unc) FILTER (WHERE year = 1995) AS u0, max(unc) FILTER (WHERE year = 2001) AS u1,
 coalesce(min(year) FILTER (WHERE rm - value >= 10 AND rm - value >= 0.25 * rm AND year > 1995), -1) AS lossyear, max(rm - value) AS lost, arg_min(year, value) AS ymin, min(value) AS wmin FROM w GROUP BY cell)
SELECT cell, round(a0, 4) AS stock0, round(a1, 4) AS stock, round(a1 - a0, 4) AS change, round(abs(a1 - a0) / sqrt(greatest(u0 * u0 + u1 * u1, 1e-6)), 3) AS z, lossyear, round(lost, 4) AS lost, ymin,
 round(a1 - wmin, 4) AS recovered, round(CASE WHEN a1 > 0 THEN u1 / greatest(a1, 1e-6) END, 6) AS ushare FROM g""")
def w05(annual):
    out = C.loss(annual, 1995, 2001)
    return out.withColumns({c: F.round(c, 4) for c in ("stock0", "stock", "change", "lost", "recovered")} | {"z": F.round("z", 3), "ushare": F.round("ushare", 6)})


@q("w06_first_step", ("emb",), """WITH n AS (SELECT cell, year, vec, sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) AS nn FROM emb WHERE vec IS NOT NULL), l AS (SELECT cell, year, vec, nn, lag(vec) OVER w AS pv, lag(nn) OVER w AS pn, lag(year) OVER w AS py FROM n WINDOW w AS (PARTITION BY cell ORDER BY year)),
s AS (SELECT cell, year, 1 - list_dot_product(vec::DOUBLE[], pv::DOUBLE[]) / nn / pn AS step FROM l WHERE py = year - 1), d AS (SELECT quantile_cont(step, 0.95) AS d0 FROM s), a AS (SELECT cell, min(year) FILTER (WHERE step > d0) AS y FROM s, d GROUP BY cell)
SELECT b.cell, CASE WHEN a.cell IS NULL THEN -2 ELSE coalesce(y, -1) END AS first_year FROM (SELECT DISTINCT cell FROM emb) b LEFT JOIN a ON a.cell = b.cell""")
def w06(emb):
    steps = C.year_steps(emb).select("cell", "year", "step")
    level = C.quiet_level(steps, F.lit(True), "step")
    return C.first_step_above(steps, emb.select("cell").distinct(), level)


_COUNTS = "d AS (SELECT cell, count(*) AS npx, " + ", ".join(f"count(*) FILTER (WHERE idx = {k}) AS c{k:02d}" for k in range(1, 21)) + " FROM dates GROUP BY cell)"
_SPAN = lambda lo, hi: " + ".join(f"c{k:02d}" for k in range(lo, hi + 1))
_YEARS = "greatest(" + ", ".join(_SPAN(2 * (y - 2016) + 1, 2 * (y - 2016) + 2) for y in range(2019, 2023)) + ")"
_TOP = "CASE " + " ".join(f"WHEN {_SPAN(2 * (y - 2016) + 1, 2 * (y - 2016) + 2)} = {_YEARS} THEN {y}" for y in range(2019, 2023)) + " END"


@q("w07_w08_growth", ("dates",), f"""WITH {_COUNTS}, g AS (SELECT *, ({_SPAN(1, 14)}) / npx::DOUBLE AS pb, ({_SPAN(7, 14)}) / npx::DOUBLE AS pn FROM d)
SELECT cell, npx, round(pb, 6) AS p_built, round(pn, 6) AS p_new, pn >= 0.3 AS grew, CASE WHEN pn >= 0.3 THEN {_TOP} WHEN pb > 0 THEN -1 ELSE -3 END AS byear,
 CASE {" ".join(f"WHEN c{k:02d} > 0 THEN {k}" for k in range(1, 21))} ELSE 0 END AS first_idx FROM g""")
def w07(dates):
    from gridcells.operators.fold import date_fold

    return C.growth(date_fold(dates, ["cell"]), 2018, 2022, new_min=0.3)


@q("w09_avg_rank", ("stats_in",), "SELECT cell, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0::DOUBLE AS rank_z FROM stats_in")
def w09(s):
    return S.avg_rank(s.select("cell", "z"), ["z"]).select("cell", "rank_z")


@q("w10_c13_quantile_table", ("stats_in",), """WITH e AS (SELECT quantile_cont(z, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM stats_in), b AS (SELECT *, CASE WHEN z < e[2] THEN 1 WHEN z < e[3] THEN 2 WHEN z < e[4] THEN 3 WHEN z < e[5] THEN 4 ELSE 5 END AS bin FROM stats_in, e)
SELECT bin, count(*) AS n, round(avg(z), 6) AS mean_x, round(median(x), 3) AS median_y, round(avg(x), 3) AS mean_y FROM b GROUP BY bin""")
def w10(s):
    t = S.quantile_table(s, "z", "x")
    return t.withColumns({c: F.round(c, 3) for c in ("median_y", "mean_y")})


@q("w11_rank_scale", ("stats_in",), "SELECT cell, z, round((row_number() OVER (ORDER BY z, cell) - 1) / (SELECT count(*) - 1 FROM stats_in)::DOUBLE, 6) AS scale FROM stats_in")
def w11(s):
    return S.rank_scale(s.select("cell", "z"), "z", "cell")


@q("w12_tween", ("film",), """WITH l AS (SELECT *, CASE WHEN lead(ts) OVER w = ts + INTERVAL 1 HOUR THEN lead(value) OVER w END AS nxt FROM film WINDOW w AS (PARTITION BY pixel ORDER BY ts))
SELECT pixel, ts, a, round(CASE WHEN nxt IS NULL THEN value ELSE value + (nxt - value) * a END, 6) AS value FROM l, (SELECT unnest([0.0::DOUBLE, 0.5]) AS a) t""")
def w12(film):
    return C.tween(film, [0.0, 0.5])


@q("w13_centred_mean", ("film",), "WITH h AS (SELECT ts, avg(value) AS m FROM film GROUP BY ts) SELECT ts, round(avg(m) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS smooth FROM h")
def w13(film):
    """Over the series of hours, which is one row an hour whatever the grid."""
    from pyspark.sql import Window

    h = film.groupBy("ts").agg(F.avg("value").alias("m"))
    return h.select("ts", F.round(F.avg("m").over(Window.orderBy("ts").rowsBetween(-3, 3)), 4).alias("smooth"))


@q("w14_two_series", ("radar", "model"), """WITH r AS (SELECT ts, round(sum(value * w) / sum(w) FILTER (WHERE value IS NOT NULL), 6) AS radar FROM radar WHERE parent = 3 GROUP BY ts), m AS (SELECT ts, max(plane) AS model FROM model WHERE parent = 3 GROUP BY ts)
SELECT coalesce(r.ts, m.ts) AS ts, radar, model FROM r FULL JOIN m ON r.ts = m.ts""")
def w14(radar, model):
    w = F.when(F.col("value").isNotNull(), F.col("w"))
    r = radar.where("parent = 3").groupBy("ts").agg((F.sum(F.col("value") * w) / F.sum(w)).alias("radar"))
    return r.join(model.where("parent = 3").groupBy("ts").agg(F.max("plane").alias("model")), "ts", "full")


_STEPS = """n AS (SELECT cell, year, vec::DOUBLE[] AS vec, sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) AS nn FROM emb WHERE vec IS NOT NULL), l AS (SELECT cell, year, vec, nn, lag(vec) OVER w AS pv, lag(nn) OVER w AS pn, lag(year) OVER w AS py FROM n WINDOW w AS (PARTITION BY cell ORDER BY year)),
s AS (SELECT cell, year, py, 1 - list_dot_product(vec, pv) / nn / pn AS step FROM l WHERE py IS NOT NULL)"""


@q("j12_c01_c02_year_steps", ("emb",), f"WITH {_STEPS} SELECT cell, year, round(step, 6) AS step FROM s WHERE py = year - 1")
def j12(emb):
    return C.year_steps(emb).select("cell", "year", "step")


@q("j12_present_years", ("emb",), f"WITH {_STEPS} SELECT cell, year, round(step, 6) AS step FROM s")
def j12p(emb):
    return C.year_steps(emb, strict=False).select("cell", "year", "step")


_DISP = f"{_STEPS}, d AS (SELECT cell, max(step) FILTER (WHERE year = 2018) AS pre, max(step) FILTER (WHERE year = 2019) AS \"into\", max(step) FILTER (WHERE year = 2020) AS \"out\", max(step) AS disp FROM s WHERE py = year - 1 GROUP BY cell)"


@q("c03_displacement", ("emb",), f'WITH {_DISP} SELECT cell, round(pre, 6) AS pre, round("into", 6) AS "into", round("out", 6) AS "out", round(disp, 6) AS disp FROM d')
def c03(emb):
    return C.displacement(emb, 2019)


@q("c02_end_displacement", ("emb",), "WITH n AS (SELECT cell, year, vec::DOUBLE[] AS v, sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) AS nn FROM emb WHERE vec IS NOT NULL) SELECT c.cell, round(1 - list_dot_product(a.v, b.v) / a.nn / b.nn, 6) AS disp FROM (SELECT DISTINCT cell FROM emb) c LEFT JOIN n a ON a.cell = c.cell AND a.year = 2017 LEFT JOIN n b ON b.cell = c.cell AND b.year = 2021")
def c02(emb):
    return C.end_displacement(emb, 2017, 2021)


@q("c04_c06_c08_verdict", ("emb",), f"""WITH {_DISP}, b AS (SELECT c.cell, disp, c.cell % 3 = 0 AS says FROM (SELECT DISTINCT cell FROM emb) c LEFT JOIN d ON d.cell = c.cell),
st AS (SELECT disp FROM b WHERE NOT says AND disp IS NOT NULL), q AS (SELECT count(*) AS k, quantile_cont(disp, 0.95) AS d0, median(disp) AS med FROM st), t AS (SELECT CASE WHEN min(k) >= 30 THEN min(d0) END AS d0, CASE WHEN min(k) >= 30 THEN greatest(1e-4, 1.4826 * median(abs(disp - med))) END AS tau FROM st, q),
z AS (SELECT cell, says, disp, coalesce(disp > d0, false) AS moved, 1 / (1 + exp(-least(greatest((disp - d0) / tau, -40), 40))) AS g FROM b, t)
SELECT cell, round(disp, 6) AS disp, moved, round(CASE WHEN says THEN g ELSE 1 - g END, 5) AS agree, CASE WHEN disp IS NULL THEN -1 WHEN says AND moved THEN 1 WHEN says THEN 2 WHEN moved THEN 3 ELSE 0 END AS verdict FROM z""")
def c04(emb):
    says = F.col("cell") % 3 == 0
    scored = staged(emb.select("cell").distinct().join(C.displacement(emb, 2019).select("cell", "disp"), "cell", "left"), "scored")
    out = C.agreement(scored, C.quiet_level(scored, ~says), says)
    return out.withColumn("agree", F.round("agree", 5))


@q("c07_change_clusters", ("emb",), None)
def c07(emb):
    """Rows only: seeding differs between engines. Differences of the edge years;
    clusters are numbered by size, cells without a difference have -1."""
    return C.change_clusters(C.edge_differences(emb, 2017, 2021), "diff", k=4).select("cell", "cluster")


@q("c10_cause_class", ("records",), "WITH r AS (SELECT parent, count(DISTINCT h10) FILTER (WHERE status = 'F') AS b, count(DISTINCT h10) FILTER (WHERE status = 'O') AS h FROM records GROUP BY parent) SELECT parent, CASE WHEN h / 20.0 >= 0.1 THEN 1 ELSE 0 END + CASE WHEN b / 20.0 >= 0.1 THEN 2 ELSE 0 END AS cause FROM r")
def c10(records):
    r = records.groupBy("parent").agg(F.count_distinct(F.when(F.col("status") == "F", F.col("h10"))).alias("b"), F.count_distinct(F.when(F.col("status") == "O", F.col("h10"))).alias("h"))
    return r.select("parent", C.cause_class(F.col("b"), F.col("h"), 20.0).alias("cause"))


_RANKS = lambda src, part="": ", ".join(f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part.replace('PARTITION BY', '') + ',' if part else ''} {c}) - 1) / 2.0::DOUBLE AS r{c}" for c in "xyz")


@q("c11_c12_spearman", ("stats_in",), f"WITH r AS (SELECT {_RANKS('stats_in')} FROM stats_in), c AS (SELECT count(*) AS n, corr(rx, ry) AS rho, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM r) SELECT n, round(rho, 6) AS rho, round((rho - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM c")
def c11(s):
    return S.spearman(s, "x", "y", "z")


@q("c14_stratified", ("stats_in",), f"WITH s AS (SELECT *, CASE WHEN cell % 100 < 5 THEN 'low' ELSE 'high' END AS stratum FROM stats_in), r AS (SELECT stratum, {_RANKS('s', 'PARTITION BY stratum')} FROM s), c AS (SELECT stratum, count(*) AS n, corr(rx, ry) AS rho, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM r GROUP BY stratum HAVING count(*) >= 20) SELECT stratum, n, round(rho, 6) AS rho, round((rho - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM c")
def c14(s):
    return S.stratified_report(s, F.when(F.col("cell") % 100 < 5, "low").otherwise("high"), "x", "y", "z", 20)


@q("c15_paired_shift", ("stats_in",), "SELECT round(median(z - y), 6) AS median_shift, round(median(z / greatest(y, 1e-6)), 6) AS median_ratio FROM stats_in")
def c15(s):
    return S.paired_shift(s, "y", "z")


@q("c16_mann_whitney", ("stats_in",), """WITH r AS (SELECT z, cell % 2 = 0 AS g, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0::DOUBLE AS rk FROM stats_in), t AS (SELECT sum(k * k * k - k) AS t FROM (SELECT count(*) AS k FROM stats_in GROUP BY z) x),
a AS (SELECT count(*) FILTER (WHERE g) AS n1, count(*) FILTER (WHERE NOT g) AS n2, sum(rk) FILTER (WHERE g) AS r1 FROM r), u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, t FROM a, t)
, z AS (SELECT n1, n2, u, (u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u),
-- the tail of the normal distribution as an integral, by Simpson's rule over 2000 steps
p AS (SELECT z, 0.5 - sign(z) * abs(z) / 6000 / sqrt(2 * pi()) * sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z * k / 2000, 2) / 2)) AS p FROM z, (SELECT unnest(range(2001)) AS k) r GROUP BY z)
SELECT n1, n2, round(u, 6) AS u, round(z.z, 6) AS z, round(p, 5) AS p FROM z, p""")
def c16(s):
    return S.mann_whitney(s.withColumn("g", F.col("cell") % 2 == 0), "z", "g").withColumn("p", F.round("p", 5))


@q("c17_delta_table", ("px",), """WITH f AS (SELECT cell, round(avg(v) FILTER (WHERE yr <= 1997), 4) AS early, round(avg(v) FILTER (WHERE yr >= 1999), 4) AS late, round(avg(d), 4) AS unc, count(*) AS n_px FROM px GROUP BY cell) SELECT cell, round(late - early, 4) AS delta, early, late, unc, n_px FROM f WHERE early IS NOT NULL AND late IS NOT NULL""")
def c17(px):
    r = lambda c: F.round(c, 4)
    f = px.groupBy("cell").agg(r(F.avg(F.when(F.col("yr") <= 1997, F.col("v")))).alias("early"), r(F.avg(F.when(F.col("yr") >= 1999, F.col("v")))).alias("late"), r(F.avg("d")).alias("unc"), F.count("*").alias("n_px"))
    return f.dropna(subset=["early", "late"]).select("cell", r(F.col("late") - F.col("early")).alias("delta"), "early", "late", "unc", "n_px")


@q("c18_peaks", ("film",), "WITH b AS (SELECT pixel % 4 AS lvl, ts, sum(value) AS km2 FROM film GROUP BY 1, 2) SELECT lvl, count(*) AS n, max(km2) AS max, arg_max(ts, (km2, -epoch(ts))) AS \"at\", sum(km2) AS total FROM b GROUP BY lvl")
def c18(film):
    from gridcells.operators.report import peaks

    return peaks(film.groupBy((F.col("pixel") % 4).alias("lvl"), "ts").agg(F.sum("value").alias("km2")))


@q("c19_health", ("radar",), "SELECT count(*) AS n, round(avg((value IS NULL)::INT), 6) AS missing, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, round(avg(CASE WHEN value IS NOT NULL THEN (value > 40)::INT END), 6) AS wet_share, quantile_cont(value, 0.5) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM radar")
def c19(radar):
    return S.health(radar, "value", 40.0)


@q("x03_forecast_series", ("film",), "SELECT pixel, ts AS init, k AS step, ts + to_hours(k) AS valid_time FROM film, (SELECT unnest([1, 6, 24]) AS k) s WHERE hour(ts) = 0")
def x03(film):
    f = film.where(F.hour("ts") == 0).withColumn("step", F.explode(F.array(F.lit(1), F.lit(6), F.lit(24))))
    return f.select("pixel", F.col("ts").alias("init"), "step", F.timestamp_seconds(F.unix_timestamp("ts") + F.col("step") * 3600).alias("valid_time"))


@q("x04_exposure", ("px", "members"), f"""WITH p AS (SELECT quantile_cont(v, 0.9) AS p FROM px), h AS (SELECT {PARENT_SQL} AS cell, max(v) AS v FROM px, p WHERE v >= p GROUP BY 1), m AS (SELECT {PARENT_SQL} AS cell, sum(npx)::BIGINT AS pop FROM members GROUP BY 1)
SELECT h.cell, v, coalesce(pop, 0) AS pop, coalesce(pop, 0) * v AS exposure FROM h LEFT JOIN m USING (cell)""")
def x04(px, members):
    cut = S.global_quantiles(px, "v", [0.9]).select(F.col("q")[0].alias("p"))  # one row
    hot = px.crossJoin(F.broadcast(cut)).where(F.col("v") >= F.col("p")).groupBy(parent_of().alias("cell")).agg(F.max("v").alias("v"))
    pop = members.groupBy(parent_of().alias("cell")).agg(F.sum("npx").alias("pop"))
    return hot.join(pop, "cell", "left").fillna(0, ["pop"]).withColumn("exposure", F.col("pop") * F.col("v"))


_GATE = 40.0


@q("x06_greedy_track", ("film",), f"""WITH RECURSIVE b AS (SELECT date_trunc('day', ts) AS ts, pixel // 10 AS blob, avg(pixel) AS cx, avg(value) / 500 AS cy FROM film GROUP BY 1, 2),
p AS (SELECT a.ts, a.blob, b.blob AS nxt, sqrt(power(b.cx - a.cx, 2) + power(b.cy - a.cy, 2)) AS d FROM b a JOIN b ON b.ts = a.ts + INTERVAL 1 DAY),
-- pair by pair in order, with the blobs that are taken
o AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY d, blob, nxt) AS k FROM p WHERE d <= {_GATE}),
g AS (SELECT ts, 0::BIGINT AS k, []::BIGINT[] AS ua, []::BIGINT[] AS ub FROM (SELECT DISTINCT ts FROM o) z
 UNION ALL SELECT o.ts, o.k, CASE WHEN list_contains(ua, blob) OR list_contains(ub, nxt) THEN ua ELSE list_append(ua, blob) END, CASE WHEN list_contains(ua, blob) OR list_contains(ub, nxt) THEN ub ELSE list_append(ub, nxt) END FROM g JOIN o ON o.ts = g.ts AND o.k = g.k + 1),
l AS (SELECT ts, unnest(ua) AS blob, unnest(ub) AS nxt FROM g QUALIFY row_number() OVER (PARTITION BY ts ORDER BY k DESC) = 1),
t AS (SELECT b.ts, b.blob, b.ts AS born, b.blob AS first FROM b LEFT JOIN l ON l.ts + INTERVAL 1 DAY = b.ts AND l.nxt = b.blob WHERE l.blob IS NULL
 UNION ALL SELECT l.ts + INTERVAL 1 DAY, l.nxt, born, first FROM t JOIN l ON l.ts = t.ts AND l.blob = t.blob)
SELECT ts, blob, born, first, count(*) OVER (PARTITION BY born, first) AS days FROM t""")
def x06(film):
    """Tracks of blobs from day to day, each named by the day and blob it began with."""
    from gridcells.operators.tracks import tracks

    b = film.groupBy(F.date_trunc("day", "ts").alias("ts"), F.expr("pixel div 10").alias("blob")).agg(F.avg("pixel").alias("cx"), (F.avg("value") / 500).alias("cy"))
    return tracks(b, "1 DAY", _GATE)


@q("x07_exceedance", ("film",), "SELECT pixel, count(*) FILTER (WHERE value > 30000) AS hours, max(value) AS peak FROM film GROUP BY pixel")
def x07(film):
    return film.groupBy("pixel").agg(F.count_if(F.col("value") > 30_000).alias("hours"), F.max("value").alias("peak"))


@q("x08_above_local", ("film",), "WITH p AS (SELECT pixel, quantile_cont(value, 0.9) AS p FROM film GROUP BY pixel) SELECT pixel, ts, value FROM film JOIN p USING (pixel) WHERE value > p")
def x08(film):
    p = film.groupBy("pixel").agg(F.percentile("value", 0.9).alias("p"))
    return film.join(p, "pixel").where(F.col("value") > F.col("p")).select("pixel", "ts", "value")


@q("t01_t04_order_limit", ("px",), "SELECT cls, count(*) AS n FROM px GROUP BY cls ORDER BY n DESC, cls LIMIT 5")
def t01(px):
    return px.groupBy("cls").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cls").limit(5)


@q("t02_top_k", ("px",), "SELECT yr, id, ln, v, rk::INT AS rk FROM (SELECT yr, id, ln, v, row_number() OVER (PARTITION BY yr ORDER BY v DESC, id, ln) AS rk FROM px) x WHERE rk <= 3")
def t02(px):
    from gridcells.operators.report import top_k

    return top_k(px.select("yr", "id", "ln", "v"), "yr", [F.desc("v"), F.col("id"), F.col("ln")], 3)


@q("t03_point_lookup", ("pixels",), "SELECT i, j, v FROM pixels WHERE i = 7 AND j = 3")
def t03(pixels):
    return pixels.where("i = 7 AND j = 3").select("i", "j", "v")
