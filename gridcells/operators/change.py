"""Change over time: accumulators, losses, growth, displacement of vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from gridcells.functions import exprs as X
from gridcells.operators.stats import global_quantiles
from gridcells.runtime import ship, shuffle_partitions, staged


def accumulate(film: DataFrame, half_life: float, start, flush: str | None = None, gap: str = "decay", first: bool = False) -> DataFrame:
    """pixel, ts, load of ``film`` (pixel, ts, x and, if named, a flush factor):
    each hour ``load = flush * (a * load + (1 - a) * x)`` with a = 2^(-1/half).
    Hours without a row decay the load (``gap="hold"`` keeps it); the hour
    ``start`` itself adds nothing unless ``first``. From a null on, loads are null.

    A row maps the load before it to ``m * load + c``, and such maps compose. Rows lie in
    range partitions by pixel and hour, which may cut a series anywhere; a task composes
    the maps of its rows by doubling, in arrays, so each row is written with its map of
    the load at the partition's border. The driver adds up one map for each partition,
    and a column expression puts the loads in."""
    a = 2 ** (-1 / half_life)
    spark = film.sparkSession
    fl = F.col(flush) if flush else F.lit(1.0)
    hour = F.floor(F.unix_timestamp("ts") / 3600).cast("long")
    series = film.select("pixel", "ts", hour.alias("h"), F.col("x").cast("double").alias("x"), fl.cast("double").alias("fl"))
    begin = spark.range(1).select(F.floor(F.unix_timestamp(F.lit(start).cast("timestamp")) / 3600).cast("long").alias("h")).first()["h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, last, hour_before, carry = TaskContext.get().partitionId(), 0, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, f = (pc.fill_null(batch.column(c), float("nan")).to_numpy() for c in ("x", "fl"))
            h = batch.column("h").to_numpy()
            pixel = batch.column("pixel")
            ids = pc.fill_null(pc.index_in(pixel, pc.unique(pixel)), -1).to_numpy(zero_copy_only=False)
            same = np.append(n > 0 and pixel[0].as_py() == last, ids[1:] == ids[:-1])
            gaps = h - np.append(h[0] if hour_before is None else hour_before, h[:-1])
            kept = np.where(gaps > 0, a, 1.0) if gap == "hold" else a ** np.maximum(gaps, 0).astype(float)
            # a series begins with no load; only what the partition's first one begins with
            # is not known here
            m = np.where(same, f * kept, 0.0)
            if carry is None:
                m[0] = f[0]
            c = f * (1 - a) * x
            if not first:
                m, c = np.where(h <= begin, 0.0, m), np.where(h <= begin, 0.0, c)
            m, c = composed(m, c)
            if carry is not None:
                m, c = m * carry[0], np.where(m == 0, c, c + m * carry[1])
            carry, last, hour_before = (m[-1], c[-1]), pixel[-1].as_py(), h[-1]
            yield pa.RecordBatch.from_pydict({"pixel": pixel, "ts": batch.column("ts"), "h": batch.column("h"), "m": m, "c": c, "part": np.full(len(m), part), "own": np.arange(n, n + len(m))})
            n += len(m)

    ship(spark)
    rows = series.repartitionByRange(shuffle_partitions(spark), "pixel", "h", "ts").sortWithinPartitions("pixel", "h", "ts")
    fields = [StructField(n, t()) for n, t in (("h", LongType), ("m", DoubleType), ("c", DoubleType), ("part", LongType), ("own", LongType))]
    maps = staged(rows.mapInArrow(run, StructType([series.schema["pixel"], series.schema["ts"], *fields])), "maps")
    ends = maps.groupBy("part").agg(F.min_by(F.struct("pixel", "h"), "own").alias("head"), F.max_by(F.struct("pixel", "h", "m", "c"), "own").alias("tail")).orderBy("part")
    carried, before = [], None
    for part, head, tail in ends.collect():  # a row for each partition
        load = 0.0
        if before and before["pixel"] == head["pixel"]:
            passed = head["h"] - before["h"]
            load = before["load"] * ((a if passed > 0 else 1.0) if gap == "hold" else a**passed)
        carried.append((part, load))
        before = {"pixel": tail["pixel"], "h": tail["h"], "load": tail["c"] + (tail["m"] * load if tail["m"] else 0.0)}
    given = spark.createDataFrame(carried, "part long, given double")
    load = F.when(F.col("m") == 0, F.col("c")).otherwise(F.col("c") + F.col("m") * F.col("given"))
    return maps.join(F.broadcast(given), "part").select("pixel", "ts", F.nanvl(load, F.lit(None).cast("double")).alias("load"))


def composed(m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps x -> m x + c, each after all before it, by doubling; one whose m is 0
    forgets what was before."""
    m, c, reach = m.copy(), c.copy(), 1
    while reach < len(m):
        c[reach:] = np.where(m[reach:] == 0, c[reach:], c[reach:] + m[reach:] * c[:-reach])
        m[reach:] = np.where(m[reach:] == 0, 0.0, m[reach:] * m[:-reach])
        reach *= 2
    return m, c


def excess(value: Column, threshold: float, wind: Column | None = None, vent: float = 0.0) -> Column:
    """What an hour adds: the excess over the threshold, thinned by wind."""
    x = F.greatest(F.coalesce(value, F.lit(threshold)) - threshold, F.lit(0.0))
    return x if wind is None else x * F.greatest(F.lit(0.0), 1 - vent * wind / 10)


def rain_flush(rain: Column, share: float, full_mm: float = 2.5) -> Column:
    return F.when(rain > 0, 1 - share * F.least(F.lit(1.0), rain / full_mm)).otherwise(1.0)


def running_drop(annual: DataFrame, value: str = "value") -> DataFrame:
    """Adds runmax (since the first year) and drop from it."""
    w = Window.partitionBy("cell").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return annual.withColumn("runmax", F.max(value).over(w)).withColumn("drop", F.col("runmax") - F.col(value))


def loss(annual: DataFrame, y0: int, y1: int, frac: float = 0.25, abs_: float = 10.0) -> DataFrame:
    """Per cell of ``annual`` (cell, year, value, unc): change and its z between
    the end years, lossyear (-1: none), lost, ymin, recovered, ushare."""
    win = running_drop(annual.where(F.col("year").between(y0, y1)))
    passed = (F.col("drop") >= abs_) & (F.col("drop") >= frac * F.col("runmax")) & (F.col("year") > y0)
    at = lambda y, c: F.max(F.when(F.col("year") == y, F.col(c)))
    g = win.groupBy("cell").agg(
        at(y0, "value").alias("a0"), at(y1, "value").alias("a1"), at(y0, "unc").alias("u0"), at(y1, "unc").alias("u1"),
        F.coalesce(F.min(F.when(passed, F.col("year"))), F.lit(-1)).alias("lossyear"), F.max("drop").alias("lost"),
        F.min(F.when(F.col("value").isNotNull(), F.struct("value", "year")))["year"].alias("ymin"), F.min("value").alias("wmin"),
    )
    change = F.col("a1") - F.col("a0")
    return g.select(
        "cell", F.col("a0").alias("stock0"), F.col("a1").alias("stock"), change.alias("change"),
        (F.abs(change) / F.sqrt(F.greatest(F.col("u0") * F.col("u0") + F.col("u1") * F.col("u1"), F.lit(1e-6)))).alias("z"),
        "lossyear", "lost", "ymin", (F.col("a1") - F.col("wmin")).alias("recovered"),
        F.when(F.col("a1") > 0, F.col("u1") / F.greatest("a1", F.lit(1e-6))).alias("ushare"),
    )


def growth(dates: DataFrame, y0: int, y1: int, base: int = 2016, n_idx: int = 20, new_min: float = 0.01) -> DataFrame:
    """From date counts (npx, c01..): share built by the end, share new inside the
    window, the year with most new (-1: built before, -3: never) and the first
    built index (0: never)."""
    c = lambda k: F.col(f"c{k:02d}")
    h1, h2 = (lambda y: 2 * (y - base) + 1), (lambda y: min(n_idx, 2 * (y - base) + 2))
    span = lambda lo, hi: sum((c(k) for k in range(lo, hi + 1)), F.lit(0))
    npx = F.greatest(F.col("npx"), F.lit(1))
    years = range(y0 + 1, y1 + 1)
    top = F.array_max(F.array(*[F.struct((c(h1(y)) + c(h2(y))).alias("n"), F.lit(-y).alias("y")) for y in years]))
    p_built, p_new = span(1, h2(y1)) / npx, span(h1(y0 + 1), h2(y1)) / npx
    grew = p_new >= new_min
    first = F.coalesce(*[F.when(c(k) > 0, k) for k in range(1, n_idx + 1)], F.lit(0))
    return dates.select(*[x for x in dates.columns if not (x[0] == "c" and x[1:].isdigit())], p_built.alias("p_built"), p_new.alias("p_new"), grew.alias("grew"), F.when(grew, -top["y"]).when(p_built > 0, -1).otherwise(-3).alias("byear"), first.alias("first_idx"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))


def unit(v: Column) -> Column:
    """The vector over its norm; null if the norm is 0 or missing."""
    n = norm(v)
    return F.when(n.isNotNull() & ~F.isnan(n) & (n > 0), F.transform(v, lambda x: x / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def year_steps(vecs: DataFrame, strict: bool = True) -> DataFrame:
    """cell, year, step: 1 - cosine from the year before (``strict``) or from the
    last present year; ``diff`` is the difference of the unit vectors. The product of the
    vectors is divided by the later norm, then by the earlier one: steps of equal vectors
    are nothing but rounding, and whether such a one is over a level of such ones hangs on
    its last bits."""
    w = Window.partitionBy("cell").orderBy("year")
    u = vecs.select("cell", "year", F.col("vec").cast("array<double>").alias("v")).withColumn("n", norm(F.col("v"))).where("NOT isnan(n) AND n > 0")
    lagged = u.select("cell", "year", "v", "n", F.lag("v").over(w).alias("pv"), F.lag("n").over(w).alias("pn"), F.lag("year").over(w).alias("py")).where("pv IS NOT NULL")
    lagged = lagged.where("year = py + 1") if strict else lagged
    step = 1 - dot(F.col("v"), F.col("pv")) / F.col("n") / F.col("pn")
    return lagged.select("cell", "year", step.alias("step"), F.zip_with("v", "pv", lambda a, b: a / F.col("n") - b / F.col("pn")).alias("diff"))


def displacement(vecs: DataFrame, y: int) -> DataFrame:
    """cell, pre, into, out (steps that end in y - 1, y, y + 1), disp (largest step)."""
    at = lambda k: F.max(F.when(F.col("year") == k, F.col("step")))
    return year_steps(vecs).groupBy("cell").agg(at(y - 1).alias("pre"), at(y).alias("into"), at(y + 1).alias("out"), F.max("step").alias("disp"))


def end_displacement(vecs: DataFrame, y0: int, y1: int) -> DataFrame:
    u = vecs.withColumn("u", unit(F.col("vec")))
    g = u.groupBy("cell").agg(F.max_by("u", F.when(F.col("year") == y0, 1)).alias("a"), F.max_by("u", F.when(F.col("year") == y1, 1)).alias("b"))
    return g.select("cell", (1 - dot(F.col("a"), F.col("b"))).alias("disp"))


def quiet_level(scored: DataFrame, stable: Column, disp: str = "disp", fa: float = 0.05, n_min: int = 30, tau_k: float = 1.0) -> DataFrame:
    """One row: d0 (the 1 - fa quantile of the stable), med, tau; nulls below n_min."""
    s = staged(scored.where(stable & F.col(disp).isNotNull()).select(F.col(disp).alias("d")), "stable")
    first = global_quantiles(s, "d", [1 - fa, 0.5]).crossJoin(F.broadcast(s.agg(F.count("*").alias("n_stable"))))
    off = s.crossJoin(F.broadcast(first)).select(F.abs(F.col("d") - F.col("q")[1]).alias("off"))
    mad = global_quantiles(off, "off", [0.5]).select(F.col("q")[0].alias("mad"))
    ok = F.col("n_stable") >= n_min
    return first.crossJoin(F.broadcast(mad)).select("n_stable", F.when(ok, F.col("q")[0]).alias("d0"), F.when(ok, F.col("q")[1]).alias("med"), F.when(ok, F.greatest(F.lit(1e-4), tau_k * 1.4826 * F.col("mad"))).alias("tau"))


def agreement(scored: DataFrame, level: DataFrame, says: Column, disp: str = "disp") -> DataFrame:
    """Adds moved, agree and verdict (-1 unscored, 0 neither, 1 both, 2 label only,
    3 vector only); ``level`` is one row of quiet_level."""
    joined = scored.crossJoin(F.broadcast(level.select("d0", "tau"))).withColumn("_says", says)
    d, s = F.col(disp), F.col("_says")
    moved = F.coalesce(d > F.col("d0"), F.lit(False))
    g = X.sigmoid((d - F.col("d0")) / F.col("tau"))
    verdict = F.when(d.isNull(), -1).when(s & moved, 1).when(s, 2).when(moved, 3).otherwise(0)
    return joined.select(*scored.columns, moved.alias("moved"), F.when(s, g).otherwise(1 - g).alias("agree"), verdict.alias("verdict"))


def first_step_above(steps: DataFrame, base: DataFrame, level: DataFrame) -> DataFrame:
    """cell, first_year of a step over d0 (-1 none, -2 unscored)."""
    above = steps.crossJoin(F.broadcast(level.select("d0"))).groupBy("cell").agg(F.min(F.when(F.col("step") > F.col("d0"), F.col("year"))).alias("y"), F.max("d0").alias("d0"))
    return base.select("cell").join(above, "cell", "left").select("cell", F.when(F.col("d0").isNull(), -2).otherwise(F.coalesce("y", F.lit(-1))).alias("first_year"))


def edge_differences(vecs: DataFrame, y0: int, y1: int) -> DataFrame:
    """cell, diff: the unit vector of y1 less that of y0; null where a year is missing."""
    u = vecs.withColumn("u", unit(F.col("vec")))
    at = lambda y: F.max_by("u", F.when(F.col("year") == y, 1))
    g = u.groupBy("cell").agg(at(y0).alias("a"), at(y1).alias("b"))
    return g.select("cell", F.zip_with("b", "a", lambda x, y: x - y).alias("diff"))


def change_clusters(diffs: DataFrame, vector: str, k: int = 10, seed: int = 0, steps: int = 12, least: float = 1e-6) -> DataFrame:
    """Spherical k-means of the directions of difference vectors: adds cluster, by size
    from 0, or -1 for vectors that are missing or shorter than ``least``. Seeding is
    that of Spark's k-means, a parallel form of k-means++."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    length = F.sqrt(dot(F.col(vector), F.col(vector)))
    far = staged(diffs.withColumn("_far", F.coalesce(length > least, F.lit(False))), "differences")
    rows = far.where("_far").withColumn("_v", array_to_vector(unit(F.col(vector))))
    rest = far.where("NOT _far").withColumn("cluster", F.lit(-1)).drop("_far")
    if rows.isEmpty():
        return rest
    model = KMeans(k=k, seed=seed, maxIter=steps, distanceMeasure="cosine", featuresCol="_v", predictionCol="_c").fit(rows)
    out = staged(model.transform(rows).drop("_v", "_far"), "clusters")
    sizes = out.groupBy("_c").agg(F.count("*").alias("n"))  # k rows
    rank = sizes.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("n"), "_c")) - 1).select("_c", "cluster")
    return out.join(F.broadcast(rank), "_c").drop("_c").unionByName(rest)


def cause_class(burned: Column, harvested: Column, fine_cells: float = 343.0, share: float = 0.1) -> Column:
    """0 neither, 1 harvested, 2 burned, 3 both."""
    return F.when(harvested / fine_cells >= share, 1).otherwise(0) + F.when(burned / fine_cells >= share, 2).otherwise(0)


def tween(film: DataFrame, parts: Sequence[float], value: str = "value") -> DataFrame:
    """Linear in-between values of each hour and the next; one-sided where the
    other is missing."""
    w = Window.partitionBy("pixel").orderBy("ts")
    nxt = F.when((F.unix_timestamp(F.lead("ts").over(w)) - F.unix_timestamp("ts")) == 3600, F.lead(value).over(w))
    rows = film.withColumn("nxt", nxt).withColumn("a", F.explode(F.array(*[F.lit(float(p)) for p in parts])))
    v = F.col(value)
    return rows.select("pixel", "ts", "a", F.when(v.isNull(), F.col("nxt")).when(F.col("nxt").isNull(), v).otherwise(v + (F.col("nxt") - v) * F.col("a")).alias(value))
