"""Queries of the aggregation family (A*)."""

from pyspark.sql import functions as F

from gridcells.operators import fold as O
from gridcells.operators import member as G
from gridcells.operators import report as R
from gridcells.operators.joins import full_join_counts
from gridcells.plans.book import Book
from gridcells.plans.views import PARENT_SQL, RES, parent_of
from gridcells.functions import cells as H

BOOK = Book()
q = BOOK.add


@q("a01_cell_fold", ("px",), f"SELECT {PARENT_SQL} AS cell, round(avg(v), 6) AS mean, max(v) AS max, count(v) AS n FROM px WHERE ok GROUP BY 1")
def a01(px):
    return O.fold(px.where("ok").withColumn("cell", parent_of()), ["cell"], O.mean_max_count())


@q("a02_a03_merge_tiles", ("px",), "SELECT cell, round(avg(v), 6) AS v, round(avg(d), 6) AS d, count(v) AS n_v, count(d) AS n_d FROM px GROUP BY cell")
def a02(px):
    tiles = O.fold(px.withColumn("tile", F.col("id") % 7), ["tile", "cell"], O.sums(["v", "d"]))
    return O.merge_partials(tiles, ["v", "d"])


@q("a04_rollup", ("px",), f"SELECT {PARENT_SQL} AS cell, round(avg(v), 4) AS mean, max(v) AS max, count(v) AS n FROM px GROUP BY 1")
def a04(px):
    cells = O.fold(px, ["cell"], O.mean_max_count()).withColumn("cell", H.cell_parent("cell", RES - 1, RES))
    return O.rollup(cells, ["cell"]).withColumn("mean", F.round("mean", 4))


@q("a05_hourly_fold", ("film",), "SELECT pixel // 4 AS cell, ts, round(avg(value), 6) AS mean, max(value) AS max, count(value) AS n FROM film GROUP BY 1, 2")
def a05(film):
    return O.fold(film.withColumn("cell", F.expr("pixel div 4")), ["cell", "ts"], O.mean_max_count("value"))


_CLASS_SQL = f"""WITH h AS (SELECT {PARENT_SQL} AS cell, cls, count(*) AS n FROM px WHERE i >= 20 AND i < 150 AND j >= 1 AND j < 90 GROUP BY 1, 2)
SELECT cell, sum(n)::BIGINT AS npx, arg_max(cls, n * 100 - cls) AS maj,
 coalesce(arg_max(cls, n * 100 - cls) FILTER (WHERE cls BETWEEN 1 AND 14), 15) AS chg,
 round(coalesce(sum(n) FILTER (WHERE cls BETWEEN 1 AND 14), 0) / sum(n), 6) AS p_chg, round(max(n) / sum(n), 6) AS purity FROM h GROUP BY cell"""


@q("a06_a09_class_fold", ("px",), _CLASS_SQL)
def a06(px):
    """The flagship: a box of class pixels, per parent cell majority, conditional
    majority, change share and purity."""
    box = px.where("i >= 20 AND i < 150 AND j >= 1 AND j < 90").withColumn("cell", parent_of())
    return O.class_fold(box, ["cell"])


@q("a10_severity_having", ("px",), f"""WITH h AS (SELECT {PARENT_SQL} AS cell, cls % 8 AS sev, count(*) AS n FROM px GROUP BY 1, 2)
SELECT cell, (sum(n) FILTER (WHERE sev BETWEEN 1 AND 2))::BIGINT AS n_burned, sum(n)::BIGINT AS npx, arg_max(sev, n * 100 - sev) FILTER (WHERE sev BETWEEN 1 AND 2) AS sev
FROM h GROUP BY cell HAVING sum(n) FILTER (WHERE sev BETWEEN 1 AND 2) > 0""")
def a10(px):
    return O.severity_fold(px.withColumns({"cell": parent_of(), "sev": F.col("cls") % 8}), ["cell"], burned=(1, 2))


@q("a11_date_pivot", ("dates",), "SELECT cell, count(*) AS npx, " + ", ".join(f"count(*) FILTER (WHERE idx = {k}) AS c{k:02d}" for k in range(1, 21)) + " FROM dates GROUP BY cell")
def a11(dates):
    return O.date_fold(dates, ["cell"])


@q("a12_conditional_means", ("px",), f"SELECT {PARENT_SQL} AS cell, " + ", ".join(f"round(avg(v) FILTER (WHERE yr = {y}), 6) AS a_{y}" for y in range(1995, 2002)) + " FROM px GROUP BY 1")
def a12(px):
    return O.conditional_means(px.withColumn("cell", parent_of()), ["cell"], "yr", range(1995, 2002), "v")


@q("a12_vector_mean", ("emb",), "SELECT label, count(*) AS n, round(avg(vec[1]), 5) AS e0, round(avg(vec[33]), 5) AS e32, round(avg(vec[64]), 5) AS e63 FROM emb GROUP BY label")
def a12v(emb):
    m = O.vector_mean(emb, ["label"], "vec", 64)
    return m.select("label", "n", *[F.round(F.get("vec", F.lit(k)), 5).alias(f"e{k}") for k in (0, 32, 63)])


@q("a13_a14_touched", ("records",), """SELECT parent, count(DISTINCT h10) FILTER (WHERE status = 'F') AS n_F, min(year(dt)::INT) FILTER (WHERE status = 'F') AS first_F, max(year(dt)::INT) FILTER (WHERE status = 'F') AS last_F,
 count(DISTINCT h10) FILTER (WHERE status = 'O') AS n_O, min(year(dt)::INT) FILTER (WHERE status = 'O') AS first_O, max(year(dt)::INT) FILTER (WHERE status = 'O') AS last_O FROM records GROUP BY parent""")
def a13(records):
    return O.touched_fold(records.withColumn("yr", F.year("dt")), "parent", "h10", "status", ["F", "O"], "yr")


@q("a13_h08_mergeable_counts", ("px",), "SELECT cls, count(DISTINCT cell) AS n_cells, true AS near FROM px GROUP BY cls")
def a13_sketches(px):
    """Distinct cells of each class, exactly and from sketches of tiles that were merged:
    within 3 percent, about four standard errors."""
    tiles = O.distinct_sketches(px.withColumn("tile", F.expr("i div 40")), ["tile", "cls"], "cell")
    about = O.merge_sketches(tiles, ["cls"]).select("cls", F.hll_sketch_estimate("sketch").alias("about"))
    exact = px.groupBy("cls").agg(F.count_distinct("cell").alias("n_cells"))
    return exact.join(about, "cls").select("cls", "n_cells", (F.abs(F.col("about") - F.col("n_cells")) <= 0.03 * F.col("n_cells") + 1).alias("near"))


@q("a15_valid_count_mean", ("px",), "SELECT cell, round(avg(CASE WHEN ok THEN v END), 6) AS mean, count(CASE WHEN ok THEN v END) AS n_valid, count(*) AS n FROM px WHERE yr IN (1995, 1996, 1997) GROUP BY cell")
def a15(px):
    v = F.when(F.col("ok"), F.col("v"))
    return O.fold(px.where(F.col("yr").isin(1995, 1996, 1997)), ["cell"], {"mean": F.avg(v), "n_valid": F.count(v), "n": F.count("*")})


@q("a16_a17_planes", ("film",), """WITH p AS (SELECT DISTINCT pixel, pixel // 4 AS cell FROM film), s AS (SELECT cell, count(*) AS n FROM p GROUP BY cell),
g AS (SELECT cell, ts, list_sort(list(value), 'DESC') AS w, avg(value) AS mean FROM film JOIN p USING (pixel) GROUP BY cell, ts)
SELECT cell, ts, n, coalesce(w[1], 0) AS any, coalesce(w[n // 2 + 1], 0) AS majority, coalesce(w[n], 0) AS "all", round(mean, 6) AS mean FROM g JOIN s USING (cell)""")
def a16(film):
    pixels = film.select("pixel", F.expr("pixel div 4").alias("cell")).distinct()
    return O.planes(film, pixels)


@q("a18_weighted", ("radar",), """SELECT parent, ts, round(sum(value * w) / sum(w) FILTER (WHERE value IS NOT NULL), 6) AS wmean,
 round(coalesce(sum(w) FILTER (WHERE value >= 50), 0) / (sum(w) FILTER (WHERE value IS NOT NULL))::DOUBLE, 6) AS wet_share FROM radar GROUP BY parent, ts""")
def a18(radar):
    return O.weighted(radar, ["parent", "ts"], "value", "w", 50.0)


@q("a19_percentiles", ("px",), "SELECT cls, round(quantile_cont(v, 0.02), 6) AS p2, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.98), 6) AS p98 FROM px GROUP BY cls")
def a19(px):
    return O.percentiles(px, ["cls"], "v", [0.02, 0.5, 0.95, 0.98])


@q("a19_median_mad", ("px",), "WITH m AS (SELECT cls, median(v) AS med FROM px GROUP BY cls) SELECT cls, med, median(abs(v - med)) AS mad FROM px JOIN m USING (cls) GROUP BY cls, med")
def a19m(px):
    return O.median_mad(px, ["cls"], "v")


@q("a20_class_summary", ("px",), """SELECT cls, count(*) AS n, count(v) AS scored, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(median(v) FILTER (WHERE ok), 6) AS median_moved,
 round(avg((v < 3000000)::INT), 6) AS below FROM px GROUP BY cls""")
def a20(px):
    return R.class_summary(px, "cls", "v", F.col("ok"), 3_000_000)


@q("a21_mode", ("px",), "WITH c AS (SELECT cell, cls, count(*) AS k FROM px GROUP BY cell, cls) SELECT cell, sum(k)::BIGINT AS n, arg_max(cls, k * 100 - cls) AS mode FROM c GROUP BY cell")
def a21(px):
    return R.mode_of(px, ["cell"], "cls")


@q("a22_crosstab", ("px",), "SELECT cls, " + ", ".join(f"count(*) FILTER (WHERE yr = {y}) AS yr_{y}" for y in range(1995, 2002)) + " FROM px WHERE ok GROUP BY cls")
def a22(px):
    return R.crosstab(px, "cls", "yr", range(1995, 2002), F.col("ok"))


@q("a23_loss_year_table", ("annual",), """WITH w AS (SELECT *, max(value) OVER (PARTITION BY cell ORDER BY year) - value AS drop_ FROM annual),
l AS (SELECT cell, min(year) FILTER (WHERE drop_ >= 500000 AND year > 1995) AS lossyear, max(drop_) AS lost FROM w GROUP BY cell)
SELECT lossyear, count(*) AS n, round(avg(lost), 4) AS mean_lost FROM l WHERE lossyear IS NOT NULL GROUP BY lossyear""")
def a23(annual):
    from gridcells.operators.change import loss

    l = loss(annual, 1995, 2001, frac=0.0, abs_=500_000.0).where("lossyear > 0")
    return l.groupBy("lossyear").agg(F.count("*").alias("n"), F.round(F.avg("lost"), 4).alias("mean_lost"))


@q("a24_arg_max", ("px",), "WITH c AS (SELECT cls, yr, sum(v)::BIGINT AS s FROM px GROUP BY cls, yr) SELECT cls, max(s) AS top, arg_max(yr, s) AS at FROM c GROUP BY cls".replace(" AS at", ' AS "at"'))
def a24(px):
    c = px.groupBy("cls", "yr").agg(F.sum("v").alias("s"))
    return c.groupBy("cls").agg(F.max("s").alias("top"), F.max_by("yr", "s").alias("at"))


@q("a25_top_mix", ("px",), """WITH c AS (SELECT yr, cls, count(*) AS n FROM px GROUP BY yr, cls), r AS (SELECT *, sum(n) OVER (PARTITION BY yr) AS tot, row_number() OVER (PARTITION BY yr ORDER BY n DESC, cls) AS rk FROM c)
SELECT yr, string_agg(floor(n * 100 / tot + 0.5)::BIGINT::VARCHAR || '% ' || cls::VARCHAR, ', ' ORDER BY rk) AS mix FROM r WHERE rk <= 3 GROUP BY yr""")
def a25(px):
    return R.top_mix(px, "yr", "cls")


@q("a26_shares", ("px",), "SELECT cls, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM px), 6) AS pct, round(median(v), 6) AS median FROM px GROUP BY cls")
def a26(px):
    return R.shares(px, "cls", "v")


@q("a27_activity_counts", ("records",), "SELECT activity, count(*) AS n FROM records WHERE year(dt) BETWEEN 1996 AND 1998 GROUP BY activity ORDER BY n DESC, activity")
def a27(records):
    return records.where(F.year("dt").between(1996, 1998)).groupBy("activity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "activity")


@q("a28_frame_means", ("film",), "SELECT ts, round(avg(value), 6) AS mean, count(*) AS n FROM film GROUP BY ts")
def a28(film):
    return film.groupBy("ts").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


@q("a29_histogram_quantile", ("film",), """WITH b AS (SELECT pixel, value::BIGINT % 255 AS q, count(*) AS n FROM film WHERE value::BIGINT % 255 > 0 GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY pixel ORDER BY q) AS cum, sum(n) OVER (PARTITION BY pixel) AS tot FROM b) SELECT pixel, min(q) AS bin FROM r WHERE cum >= tot * 0.98 GROUP BY pixel""")
def a29(film):
    return O.histogram_quantile(film.withColumn("q", F.col("value").cast("long") % 255), ["pixel"], "q", 0.98)


@q("a30_rules", ("film",), """WITH s AS (SELECT pixel // 4 AS parent, count(DISTINCT pixel) AS n FROM film GROUP BY 1), c AS (SELECT pixel // 4 AS parent, ts, count(*) FILTER (WHERE value > 20000) AS c FROM film GROUP BY 1, 2)
SELECT parent, ts, c > 0 AS any, c * 2 > n AS majority, c = n AS "all" FROM c JOIN s USING (parent)""")
def a30(film):
    rows = film.withColumn("parent", F.expr("pixel div 4"))
    sizes = rows.groupBy("parent").agg(F.count_distinct("pixel").alias("n"))
    return G.rule_members(rows, sizes, "parent", F.col("value") > 20_000)


@q("j09_full_join_counts", ("records", "px"), """WITH a AS (SELECT parent, count(*) AS n_a FROM records WHERE status = 'F' GROUP BY parent), b AS (SELECT i AS parent, count(*) AS n_b FROM px GROUP BY i)
SELECT coalesce(a.parent, b.parent) AS parent, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b ON a.parent = b.parent""")
def j09(records, px):
    a = records.where("status = 'F'").groupBy("parent").agg(F.count("*").alias("n_a"))
    b = px.groupBy(F.col("i").alias("parent")).agg(F.count("*").alias("n_b"))
    return full_join_counts(a, b, ["parent"], ["n_a", "n_b"])


