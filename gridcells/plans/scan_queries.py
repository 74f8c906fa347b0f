"""Queries of the scan family (S*, M*, X2, R1)."""

from pyspark.sql import functions as F

from gridcells.functions import cells as H
from gridcells.functions import exprs as X
from gridcells.operators import fold as O
from gridcells.operators.stats import global_quantiles
from gridcells.plans.book import Book
from gridcells.plans.views import PARENT_SQL, RES, parent_of
from gridcells.runtime import scratch, staged
from gridcells.sources import scan as S
from gridcells.sources import store as T

BOOK = Book()
q = BOOK.add


def _blocks(pixels, size=10):
    """Dense size x size blocks of the pixels' sums."""
    at = (F.col("i") % size * size + F.col("j") % size).cast("int")
    got = pixels.groupBy(F.col("by_").alias("by"), "bx").agg(F.map_from_entries(F.collect_list(F.struct(at, "v"))).alias("m"))
    return got.select("by", "bx", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.element_at("m", k)).alias("values"))


@q("s01_blocks_to_pixels", ("pixels",), "SELECT i AS row, j AS col, v FROM pixels")
def s01(pixels):
    return S.blocks_to_pixels(_blocks(pixels), 10)


@q("s02_prune_blocks", ("pixels", "px"), """WITH k AS (SELECT DISTINCT i // 10 AS by_, j // 10 AS bx FROM px WHERE cls = 3 AND i < 60)
SELECT by_ AS by, bx, count(*) AS n FROM pixels WHERE (by_, bx) IN (SELECT by_, bx FROM k) GROUP BY 1, 2""")
def s02(pixels, px):
    kept = px.where("cls = 3 AND i < 60").select(F.col("i").alias("row"), F.col("j").alias("col"))
    return S.prune_blocks(_blocks(pixels), kept, 10).select("by", "bx", F.size(F.filter("values", lambda v: v.isNotNull())).cast("long").alias("n"))


def _region(by, bx):
    return F.floor(by / 4) * 1000 + F.floor(bx / 4)


@q("s02_x02_pruned_blocks", ("*", "pixels", "px"), f"""WITH c AS (SELECT DISTINCT {PARENT_SQL} AS parent, i, j FROM px), w AS (SELECT DISTINCT i // 10 AS by_, j // 10 AS bx FROM c WHERE parent IN (SELECT parent FROM c WHERE i = 25 AND j BETWEEN 30 AND 60))
SELECT by_ AS by, bx, count(*) AS n, sum(v)::BIGINT AS v FROM pixels WHERE (by_, bx) IN (SELECT by_, bx FROM w) GROUP BY 1, 2""")
def s02_stored(spark, sf_dir, pixels, px):
    """Blocks stored by region, those of a few coarse cells read through their index."""
    path = scratch(spark, "blocks")
    T.write_blocks(_blocks(pixels), px.withColumnsRenamed({"i": "row", "j": "col"}), path, 10, _region, parent_of("row", "col"))
    cells = [r["p"] for r in px.where("i = 25 AND j BETWEEN 30 AND 60").select(parent_of().alias("p")).distinct().collect()]  # of a column of 31 pixels
    found = T.blocks_of(spark, path, F.col("parent").isin(cells))
    return S.blocks_to_pixels(found, 10).groupBy(F.floor(F.col("row") / 10).alias("by"), F.floor(F.col("col") / 10).alias("bx")).agg(F.count("*").alias("n"), F.sum("v").alias("v"))


@q("t03_stored_lookup", ("*", "px"), f"""WITH f AS (SELECT cell, i, j, count(*) AS n, sum(v)::BIGINT AS v FROM px GROUP BY ALL)
SELECT cell, n, v FROM f WHERE i % 50 = 7 AND j % 40 = 3""")
def t03_stored(spark, sf_dir, px):
    """Folds stored in the order of cells; some cells looked up, with others that the table
    has not. Their columns reach as far as the table does, whatever its size."""
    path = scratch(spark, "folds")
    T.cluster(px.groupBy("cell").agg(F.count("*").alias("n"), F.sum("v").alias("v")), path, "cell", 4, 1 << 16)
    to_i, to_j = px.agg(F.max("i"), F.max("j")).first()
    rows, cols = (spark.range(7 if f == 50 else 3, (to or 0) + 1 + f, f) for to, f in ((to_i, 50), (to_j, 40)))
    cells = rows.select(F.col("id").alias("i")).crossJoin(cols.select(F.col("id").alias("j"))).select(H.pack(RES, "i", "j").alias("cell"))
    return T.lookup(spark, path, "cell", cells)


@q("s03_box_scan", ("px_geo",), "SELECT id, ln, round(lon, 6) AS lon, round(lat, 6) AS lat FROM px_geo WHERE lon >= -110 AND lon < -95.5 AND lat >= 26 AND lat < 40")
def s03(px_geo):
    return S.in_box(px_geo, (-110.0, 26.0, -95.5, 40.0)).select("id", "ln", "lon", "lat")


@q("s04_grid_window", ("pixels",), "SELECT i, j, v FROM pixels WHERE i >= 20 AND i < 62 AND j >= 3 AND j < 18")
def s04(pixels):
    r0, r1, c0, c1 = S.grid_window((3.2, 138.5, 17.1, 180.0), 0.0, 200.0, 1.0, 200, 200)
    return pixels.where((F.col("i") >= r0) & (F.col("i") < r1) & (F.col("j") >= c0) & (F.col("j") < c1)).select("i", "j", "v")


@q("s05_bounding_rectangle", ("pixels",), """WITH g AS (SELECT i, j, v, (10 * i + j) / 10.0::DOUBLE AS lon, (20 * j - i) / 20.0::DOUBLE AS lat FROM pixels),
b AS (SELECT min(i) AS r0, max(i) AS r1, min(j) AS c0, max(j) AS c1 FROM g WHERE lon >= 30 AND lon < 90 AND lat >= 1 AND lat < 60)
SELECT i, j, v FROM g, b WHERE i BETWEEN r0 AND r1 AND j BETWEEN c0 AND c1""")
def s05(pixels):
    g = pixels.select(F.col("i").alias("row"), F.col("j").alias("col"), "v", ((10 * F.col("i") + F.col("j")) / 10).alias("lon"), ((20 * F.col("j") - F.col("i")) / 20).alias("lat"))
    return S.bounding_rectangle(g, (30.0, 1.0, 90.0, 60.0)).select(F.col("row").alias("i"), F.col("col").alias("j"), "v")


@q("s06_stride_sample", ("pixels",), "SELECT i, j, v FROM pixels WHERE (i - 1) % 3 = 0 AND j % 3 = 0")
def s06(pixels):
    return S.stride_sample(pixels, S.sample_stride(40_000, 5_000), "i", "j", 1, 0).select("i", "j", "v")


@q("s07_overview_level", ("*", "pixels"), """WITH w AS (SELECT (max(i) - min(i) + 1) * (max(j) - min(j) + 1) AS px FROM pixels), l AS (SELECT (2 ** greatest(2, ceil(ln(px / 4000) / ln(4))))::BIGINT AS k FROM w)
SELECT i // k AS row, j // k AS col, sum(v)::BIGINT AS v FROM pixels, l GROUP BY 1, 2""")
def s07(spark, sf_dir, pixels):
    """A pyramid stored by level, each built of the one below; the level is picked
    from the window's size before the read, which then lists that folder alone."""
    side = lambda c: F.max(c) - F.min(c) + 1
    window = pixels.agg((side("i") * side("j")).alias("px")).first()["px"] or 0
    level = S.pick_level(0.3, 16, window, 4_000)
    path = scratch(spark, "pyramid")
    S.write_pyramid(pixels.select(F.col("i").alias("row"), F.col("j").alias("col"), "v"), path, level + 2)
    return S.at_level(spark.read.parquet(path), level)


@q("s08_s14_partitioned_cells", ("*", "px"), "SELECT cell, count(*) AS n, sum(v)::BIGINT AS v FROM px WHERE i % 8 IN (2, 5) GROUP BY cell")
def s08(spark, sf_dir, px):
    """Written by coarse cell, sorted by cell, zstd; read back by partition."""
    path = scratch(spark, "cells")
    S.write_table(px.withColumn("h0", F.col("i") % 8).select("cell", "v", "h0"), path, ["h0"], ["cell"])
    return spark.read.parquet(path).where(F.col("h0").isin(2, 5)).groupBy("cell").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


@q("s09_item_overlap", ("items",), "SELECT item_id, place, year, collection FROM items WHERE year = 2024 AND east > 4 AND west < 30 AND north > 1 AND south < 3")
def s09(items):
    return S.overlapping(items, (4.0, 1.0, 30.0, 3.0), 2024).select("item_id", "place", "year", "collection")


@q("s10_find_items", ("items",), """WITH o AS (SELECT * FROM items WHERE collection = 'A' AND east > 1 AND west < 40 AND north > 0 AND south < 5),
y AS (SELECT item_id, place FROM o WHERE item_id LIKE '%\\_2024' ESCAPE '\\'),
m AS (SELECT place, arg_max(item_id, year) AS was FROM o WHERE year < 2024 AND place NOT IN (SELECT place FROM y) GROUP BY place)
SELECT item_id, place, 0 AS priority FROM y UNION ALL SELECT regexp_replace(was, '_\\d+$', '') || '_2024', place, 0 FROM m
UNION ALL SELECT item_id, place, 1 FROM items WHERE collection = 'B' AND year = 2024 AND east > 1 AND west < 40 AND north > 0 AND south < 5""")
def s10(items):
    return S.find_items(items, (1.0, 0.0, 40.0, 5.0), 2024, "A", "B")


@q("s11_s13_tiles", ("*", "px"), "SELECT cell, sum(v)::BIGINT AS v, count(*) AS n FROM px WHERE ok AND cls < 12 GROUP BY cell")
def s11(spark, sf_dir, px):
    """Tiles written apart and merged; a tile without valid pixels has only keys."""
    path = scratch(spark, "tiles")
    for k in (0, 1):
        own = px.where((F.col("id") % 2 == k) & F.col("ok") & (F.col("cls") < 12)).groupBy("cell").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
        S.write_table(own, f"{path}/tile={k}")
    S.write_table(px.where("false").select("cell"), f"{path}/tile=2")
    return S.read_tiles(spark, path).groupBy("cell").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))


@q("s12_pending_tiles", ("pixels", "px"), "SELECT DISTINCT by_, bx FROM pixels WHERE (by_, bx) NOT IN (SELECT i // 10, j // 10 FROM px WHERE yr = 1999 AND cls < 4)")
def s12(pixels, px):
    done = px.where("yr = 1999 AND cls < 4").select(F.expr("i div 10").alias("by_"), F.expr("j div 10").alias("bx"))
    return S.pending(pixels.select("by_", "bx").distinct(), done, ["by_", "bx"])


@q("s12_a02_resumable_ingest", ("*", "px"), "SELECT cell, round(avg(v), 6) AS v, count(v) AS n_v FROM px WHERE ok AND i // 40 <> 2 GROUP BY cell")
def s12_ingest(spark, sf_dir, px):
    """Partial sums by tile: a run that is stopped after some tiles, one that goes on, and
    one tile that is made again, of other rows and then of the right ones."""
    tiled = px.withColumn("tile", F.concat_ws("_", F.expr("i div 40"), F.expr("j div 100")))
    # each group of tiles goes over the source, without the columns that it does not need
    source = staged(tiled.where("ok AND i div 40 <> 2").select("tile", "cell", "cls", "v"), "source")
    work = staged(tiled.select("tile").distinct(), "tiles")
    base, values = scratch(spark, "ingest"), O.sums(["v"])

    def make(tiles, rows=source):
        return O.fold(rows.join(F.broadcast(tiles), "tile", "left_semi"), ["tile", "cell"], values)  # names of one group

    T.ingest(work.where("tile < '2'"), make, base, 2)
    T.ingest(work, make, base, 4)
    one = work.where("tile = '1_0'")
    T.ingest(one, lambda t: make(t, source.where("cls < 4")), base, again=True)
    T.ingest(one, make, base, again=True)
    return O.merge_partials(T.read_tiles(spark, base, "cell long, sum_v long, n_v long"), ["v"])


@q("s15_nodata_mask", ("px",), "SELECT id, ln, CASE WHEN cls NOT IN (1, 16) THEN cls END AS cls, CASE WHEN d <> 0 THEN d END AS d FROM px WHERE cls >= 1 AND cls <= 15")
def s15(px):
    return S.mask_nodata(px.where("cls BETWEEN 1 AND 15"), {"cls": [1, 16], "d": [0]}).select("id", "ln", "cls", "d")


@q("s16_coverage", ("film",), "SELECT pixel, ts, value FROM film WHERE pixel IN (SELECT pixel FROM film WHERE ts = TIMESTAMP '2024-01-10 06:00:00')")
def s16(film):
    return S.coverage(film, F.lit("2024-01-10 06:00:00").cast("timestamp"))


@q("m01_resample_nearest", ("pixels", "grid_b"), """WITH t AS (SELECT id, floor((600000 - y) / 3100)::BIGINT AS row, floor((x + 50) / 3100)::BIGINT AS col FROM grid_b)
SELECT id, t.row, t.col, v FROM t LEFT JOIN pixels ON pixels.i = t.row AND pixels.j = t.col""")
def m01(pixels, grid_b):
    src = pixels.select(F.col("i").alias("row"), F.col("j").alias("col"), "v")
    return S.resample_nearest(src, grid_b.select("id", "x", "y"), -50.0, 600_000.0, 3100.0).select("id", "row", "col", "v")


_LAYERS = "SELECT cell, cls % 4 AS priority, min(CASE WHEN v % 3 <> 0 THEN v END) AS value FROM px GROUP BY 1, 2"


def _layers(px):
    return px.groupBy("cell", (F.col("cls") % 4).alias("priority")).agg(F.min(F.when(F.col("v") % 3 != 0, F.col("v"))).alias("value"))


@q("m02_first_valid", ("px",), f"WITH l AS ({_LAYERS}) SELECT cell, arg_min(value, priority) AS value, min(priority) AS priority FROM l WHERE value IS NOT NULL GROUP BY cell")
def m02(px):
    return S.composite_first(_layers(px), ["cell"])


@q("m03_backfill_share", ("px",), f"WITH l AS ({_LAYERS}), c AS (SELECT cell, min(priority) AS p FROM l WHERE value IS NOT NULL GROUP BY cell) SELECT (cell >> 29) % 10 AS part, round(avg((p > 0)::INT), 6) AS fill, count(*) AS n FROM c GROUP BY 1")
def m03(px):
    c = S.composite_first(_layers(px), ["cell"])
    return c.groupBy((F.shiftright("cell", 29) % 10).alias("part")).agg(F.avg((F.col("priority") > 0).cast("double")).alias("fill"), F.count("*").alias("n"))


@q("m04_last_nonzero", ("px",), "WITH l AS (SELECT cell, id * 10 + ln AS seq, CASE WHEN v % 2 = 0 THEN 0 ELSE v END AS value FROM px) SELECT cell, arg_max(value, seq) AS value FROM l WHERE value > 0 GROUP BY cell")
def m04(px):
    return S.composite_last(px.select("cell", (F.col("id") * 10 + F.col("ln")).alias("seq"), F.when(F.col("v") % 2 == 0, 0).otherwise(F.col("v")).alias("value")), ["cell"])


@q("m05_p21_stretch", ("pixels",), """WITH s AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM pixels WHERE i % 4 = 0 AND j % 4 = 0)
SELECT i, j, round(least(greatest((v - lo) / (hi - lo), 0), 1), 6) AS t FROM pixels, s""")
def m05(pixels):
    bounds = global_quantiles(S.stride_sample(pixels, 4, "i", "j"), "v", [0.02, 0.98])
    return pixels.crossJoin(F.broadcast(bounds)).select("i", "j", X.stretch(F.col("v"), F.col("q")[0], F.col("q")[1]).alias("t"))  # bounds are one row


@q("m06_band_join", ("px",), "WITH b AS (SELECT i // 2 AS r, j // 2 AS c, max(v) AS b20 FROM px WHERE cls > 8 GROUP BY 1, 2), a AS (SELECT i, j, max(v) AS b10 FROM px WHERE cls <= 8 GROUP BY 1, 2) SELECT a.i, a.j, b10, b20 FROM a JOIN b ON a.i // 2 = r AND a.j // 2 = c")
def m06(px):
    b = px.where("cls > 8").groupBy(F.expr("i div 2").alias("row"), F.expr("j div 2").alias("col")).agg(F.max("v").alias("v"))
    a = px.where("cls <= 8").groupBy("i", "j").agg(F.max("v").alias("b10"))
    target = a.select("i", "j", "b10", (F.col("j") + 0.5).alias("x"), (-F.col("i") - 0.5).alias("y"))
    return S.resample_nearest(b, target, 0.0, 0.0, 2.0).where("v IS NOT NULL").select("i", "j", "b10", F.col("v").alias("b20"))


@q("x02_block_index", ("px",), f"SELECT i // 10 AS by, j // 10 AS bx, list_sort(list(DISTINCT {PARENT_SQL}))::VARCHAR AS parents FROM px GROUP BY 1, 2")
def x02(px):
    idx = S.block_index(px.withColumnsRenamed({"i": "row", "j": "col"}), 10, parent_of("row", "col"))
    return idx.select("by", "bx", F.concat(F.lit("["), F.array_join("parents", ", "), F.lit("]")).alias("parents"))


@q("r01_common_window", ("film", "model"), """WITH e AS (SELECT least((SELECT max(ts) FROM film), (SELECT max(ts) FROM model)) AS t)
SELECT 'film' AS src, ts, count(*) AS n FROM film, e WHERE ts <= t AND ts > t - INTERVAL 72 HOURS GROUP BY ts UNION ALL
SELECT 'model', ts, count(*) FROM model, e WHERE ts <= t AND ts > t - INTERVAL 72 HOURS GROUP BY ts""")
def r01(film, model):
    w = S.common_window({"film": film, "model": model}, 3)
    parts = [df.groupBy("ts").agg(F.count("*").alias("n")).withColumn("src", F.lit(k)) for k, df in w.items()]
    return parts[0].unionByName(parts[1])


