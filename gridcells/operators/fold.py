"""Folds: group statistics of pixels per cell, roll-ups and order statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcells.operators.stats import on_keys, quantiles, with_medians
from gridcells.runtime import staged


def fold(pixels: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    return pixels.groupBy(*keys).agg(*[c.alias(k) for k, c in aggs.items()])


def mean_max_count(value: str = "v") -> dict[str, Column]:
    return {"mean": F.avg(value), "max": F.max(value), "n": F.count(value)}


def sums(values: Sequence[str]) -> dict[str, Column]:
    """Mergeable partials: sum and count of each value."""
    return {k: c for v in values for k, c in ((f"sum_{v}", F.sum(v)), (f"n_{v}", F.count(v)))}


def merge_partials(tiles: DataFrame, values: Sequence[str], key: str = "cell") -> DataFrame:
    """Cells that several tiles share get their sums added; means where n > 0."""
    total = tiles.groupBy(key).agg(*[F.sum(f"{p}_{v}").alias(f"{p}_{v}") for v in values for p in ("sum", "n")])
    return total.select(key, *[F.try_divide(f"sum_{v}", f"n_{v}").alias(v) for v in values], *[f"n_{v}" for v in values])


def distinct_sketches(rows: DataFrame, keys: Sequence[str], value: str, lg: int = 14) -> DataFrame:
    """keys, sketch: a HyperLogLog sketch of 2^lg registers of the distinct values, which
    merge from tile to tile; relative error about 1.04 / sqrt(2^lg)."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, lg).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, sketch: of the tiles of a key as one."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def rollup(cells: DataFrame, keys: Sequence[str], mean: str = "mean", top: str = "max", n: str = "n") -> DataFrame:
    """Exact statistics of the parents from their children's."""
    return cells.groupBy(*keys).agg(F.try_divide(F.sum(F.col(mean) * F.col(n)), F.sum(n)).alias(mean), F.max(top).alias(top), F.sum(n).alias(n))


def class_fold(pixels: DataFrame, keys: Sequence[str], cls: str = "cls", change: tuple[int, int] = (1, 14), stable: int = 15) -> DataFrame:
    """npx, maj (most pixels, lower code on ties), chg (majority of the change
    codes, ``stable`` if none), p_chg, purity per cell."""
    hist = pixels.groupBy(*keys, F.col(cls).alias("cls")).agg(F.count("*").alias("n"))
    c = F.col("cls")
    changes = c.between(*change)
    return hist.groupBy(*keys).agg(
        F.sum("n").alias("npx"),
        F.max_by("cls", F.struct("n", -c)).alias("maj"),
        F.coalesce(F.max_by(F.when(changes, c), F.struct(F.when(changes, F.col("n")).otherwise(-1), -c)), F.lit(stable)).alias("chg"),
        (F.sum(F.when(changes, F.col("n")).otherwise(0)) / F.sum("n")).alias("p_chg"),
        (F.max("n") / F.sum("n")).alias("purity"),
    )


def severity_fold(pixels: DataFrame, keys: Sequence[str], sev: str = "sev", burned: tuple[int, int] = (1, 5)) -> DataFrame:
    """n_burned and majority severity of cells with any burned pixel."""
    c = F.col(sev)
    hist = pixels.groupBy(*keys, c.alias("sev")).agg(F.count("*").alias("n"))
    hit = F.col("sev").between(*burned)
    out = hist.groupBy(*keys).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_burned"), F.sum("n").alias("npx"), F.max_by(F.when(hit, F.col("sev")), F.struct(F.when(hit, F.col("n")).otherwise(-1), -F.col("sev"))).alias("sev"))
    return out.where("n_burned > 0")


def date_fold(pixels: DataFrame, keys: Sequence[str], idx: str = "idx", n_idx: int = 20) -> DataFrame:
    """npx and the counts of each date index 1..n as columns c01.. ."""
    return pixels.groupBy(*keys).agg(F.count("*").alias("npx"), *[F.count_if(F.col(idx) == k).alias(f"c{k:02d}") for k in range(1, n_idx + 1)])


def conditional_means(pixels: DataFrame, keys: Sequence[str], by: str, values: Sequence[int], value: str, prefix: str = "a_") -> DataFrame:
    """One column per value of ``by``, all in one pass."""
    return pixels.groupBy(*keys).agg(*[F.avg(F.when(F.col(by) == y, F.col(value))).alias(f"{prefix}{y}") for y in values])


def vector_mean(rows: DataFrame, keys: Sequence[str], vector: str, size: int) -> DataFrame:
    """Element-wise mean of an array column."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.avg(F.get(vector, F.lit(k)).cast("double")) for k in range(size)]).alias(vector))


def touched_fold(records: DataFrame, parent: str, fine: str, kind: str, kinds: Sequence[str], year: str) -> DataFrame:
    """Distinct fine cells touched per kind, and first and last year, per parent."""
    aggs = []
    for k in kinds:
        own = F.col(kind) == k
        aggs += [F.count_distinct(F.when(own, F.col(fine))).alias(f"n_{k}"), F.min(F.when(own, F.col(year))).alias(f"first_{k}"), F.max(F.when(own, F.col(year))).alias(f"last_{k}")]
    return records.groupBy(parent).agg(*aggs)




def planes(film: DataFrame, pixels: DataFrame, cell: str = "cell", pixel: str = "pixel", value: str = "value") -> DataFrame:
    """Per (cell, ts): the value that any, a majority and all of the cell's pixels
    reach, a pixel without data counting as 0, and the mean of those reporting.
    ``pixels`` lists the pixels of each cell, so its size is known each hour."""
    size = pixels.groupBy(cell).agg(F.count("*").alias("n"))
    rows = film.join(pixels.select(pixel, cell), pixel).groupBy(cell, "ts").agg(F.sort_array(F.collect_list(value), asc=False).alias("w"), F.avg(value).alias("mean"))
    at = lambda k: F.greatest(F.coalesce(F.get("w", (k - 1).cast("int")), F.lit(0.0)), F.lit(0.0))
    n = F.col("n")
    return rows.join(size, cell).select(cell, "ts", "n", at(F.lit(1)).alias("any"), at(F.floor(n / 2) + 1).alias("majority"), at(n).alias("all"), "mean")


def weighted(df: DataFrame, keys: Sequence[str], value: str, weight: str, threshold: float) -> DataFrame:
    """Weighted mean, and weighted share at or over the threshold, of reporting rows."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias("wmean"), F.try_divide(F.sum(F.when(F.col(value) >= threshold, w).otherwise(0)), F.sum(w)).alias("wet_share"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """Exact, with linear interpolation; groups without a value are left out."""
    q = quantiles(df, value, points, keys)
    return q.select(*keys, *[F.col("q")[k].alias(f"p{round(p * 100)}") for k, p in enumerate(points)])


def median_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    med = staged(quantiles(df, value, [0.5], keys).select(*keys, F.col("q")[0].alias("med")), "medians")
    off = on_keys(df, med, keys).select(*keys, F.abs(F.col(value) - F.col("med")).alias("off"))
    return with_medians(med, off, {"mad": F.col("off")}, keys)


def histogram_quantile(df: DataFrame, keys: Sequence[str], q: str, share: float) -> DataFrame:
    """First bin over 0 whose cumulative count reaches the share."""
    bins = df.where(F.col(q) > 0).groupBy(*keys, q).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    run = bins.withColumns({"cum": F.sum("n").over(w.orderBy(q)), "tot": F.sum("n").over(w)})
    return run.where(F.col("cum") >= F.col("tot") * share).groupBy(*keys).agg(F.min(q).alias("bin"))
