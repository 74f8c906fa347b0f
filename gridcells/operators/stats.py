"""Rank statistics, quantile tables and tests over cell tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from gridcells.operators.skew import HOT_KEYS
from gridcells.runtime import ship, shuffle_partitions, staged


def on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names in which null equals null."""
    other = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return left.join(other, reduce(Column.__and__, same), how).drop(*[f"_of_{k}" for k in keys])


def ranks(df: DataFrame, value: str | Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, value, n, before, rank of each distinct value (or tuple of values) in each
    group: rank is the average rank of its ties, before the number of smaller rows of
    the group. Only distinct values are sorted, in range partitions that may cut a
    group anywhere; a task adds up the rows of its own, and what the first group of a
    partition has before it is one number for each partition. So no task holds a group,
    however few there are, and nothing is shuffled twice."""
    order, keys = [value] if isinstance(value, str) else list(value), list(by)
    spark = df.sparkSession
    counts = df.dropna(subset=order).groupBy(*keys, *order).agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(shuffle_partitions(spark), *keys, *order).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, last, carry, in_head = TaskContext.get().partitionId(), 0, None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            begins = np.zeros(len(n), bool)
            for k in keys:
                codes = pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy()
                begins[1:] |= codes[1:] != codes[:-1]
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            begins[0] = rows > 0 and first != last
            ends = np.cumsum(n)
            # rows of the batch before each group; its first one may go on from the batch before
            start = np.maximum.accumulate(np.where(begins, ends - n, 0))
            own = ends - n - start + np.where(np.cumsum(begins) == 0, carry, 0)
            head = in_head & (np.cumsum(begins) == 0)
            in_head, carry, last = bool(head[-1]), int(own[-1] + n[-1]), tuple(batch.column(k)[-1].as_py() for k in keys)
            extra = {"before": own, "head": head, "part": np.full(len(n), part), "own": np.arange(rows, rows + len(n))}
            rows += len(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, extra.values())], names=[*batch.schema.names, *extra])

    ship(spark)
    extra = [StructField("before", LongType()), StructField("head", BooleanType()), StructField("part", LongType()), StructField("own", LongType())]
    placed = staged(ranged.mapInArrow(run, StructType([*counts.schema.fields, *extra])), "ranks")
    group, total = F.struct(F.lit(0), *keys), F.col("before") + F.col("n")
    ends = placed.groupBy("part").agg(F.min_by(group, "own").alias("a"), F.max_by(group, "own").alias("z"), F.max_by(total, "own").alias("rest"), F.min_by("head", -F.col("own")).alias("one"))
    given, carry, before = [], 0, None
    for part, a, z, rest, one in ends.orderBy("part").collect():  # a row for each partition
        given.append((part, carry if before is not None and a == before else 0))
        carry, before = rest + (given[-1][1] if one else 0), z
    run_on = placed.join(F.broadcast(spark.createDataFrame(given, "part long, given long")), "part")
    smaller = F.col("before") + F.when(F.col("head"), F.col("given")).otherwise(0)
    return run_on.select(*keys, *order, "n", smaller.alias("before"), (smaller + (F.col("n") + 1) / 2).alias("rank"))


def quantiles(df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, ``q``: exact quantiles (linear interpolation) of each group with a value
    (without ``by``: one row, null for no rows), read off the ranks."""
    r = ranks(df, value, by)
    total = r.groupBy(*by).agg(F.max(F.col("before") + F.col("n")).alias("_all"))
    rows = on_keys(r, total, by) if by else r.crossJoin(F.broadcast(total))  # one row
    at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value)))
    out = []
    for p in points:
        k = p * (F.col("_all") - 1)
        low, high = F.floor(k), F.ceil(k)
        out.append((at(low).cast("double"), at(high).cast("double"), F.max(k - low)))
    return rows.groupBy(*by).agg(F.array(*[a + (b - a) * f for a, b, f in out]).alias("q"))


def global_quantiles(df: DataFrame, value: str, points: Sequence[float]) -> DataFrame:
    return quantiles(df, value, points)


def stacked(df: DataFrame, values: Mapping[str, Column], by: Sequence[str]) -> DataFrame:
    """by, _name, _v: a row for each named value of each row."""
    each = F.array(*[F.struct(F.lit(n).alias("_name"), v.cast("double").alias("_v")) for n, v in values.items()])
    return df.select(*by, F.explode(each).alias("_e")).select(*by, "_e._name", "_e._v")


def with_medians(table: DataFrame, df: DataFrame, values: Mapping[str, Column], by: Sequence[str]) -> DataFrame:
    """``table`` (a row per group of ``by``) and the median of each named value of
    ``df`` in its group: all in one pass over ``df`` and one sort."""
    medians = quantiles(stacked(df, values, by), "_v", [0.5], [*by, "_name"])
    wide = medians.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == n, F.col("q")[0])).alias(n) for n in values])
    return on_keys(table, wide, by, "left")


def avg_rank(df: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds rank_<value> for each, within groups of ``by``; null for a null value. All
    values are ranked in one sort. A value that over one in HOT_KEYS rows share, of which
    there are few, meets its rank in a broadcast."""
    out = staged(df, "ranked")
    found = ranks(stacked(out, {v: F.col(v) for v in values}, by), "_v", [*by, "_name"])
    sizes = {r["_name"]: r for r in found.groupBy("_name").agg(F.count("*").alias("keys"), F.sum("n").alias("rows"), F.max("n").alias("most")).collect()}
    for v in values:
        own = found.where(F.col("_name") == v).select(F.struct(*by, "_v").alias("_key"), F.col("rank").alias(f"rank_{v}"), "n")
        keyed = out.withColumn("_key", F.struct(*by, F.col(v).cast("double").alias("_v")))
        size = sizes.get(v)
        share = size["rows"] // HOT_KEYS if size else 0
        if not size or size["keys"] <= HOT_KEYS:
            met = keyed.join(F.broadcast(own.drop("n")), "_key", "left")
        elif size["most"] <= share:
            met = keyed.join(own.drop("n"), "_key", "left")
        else:
            hot, cold = own.where(F.col("n") > share).drop("n"), own.where(F.col("n") <= share).drop("n")
            apart = keyed.join(F.broadcast(hot.select("_key")), "_key", "left_anti")
            met = keyed.join(F.broadcast(hot), "_key").unionByName(apart.join(cold, "_key", "left"))
        out = met.drop("_key")
    return out


def rank_scale(df: DataFrame, value: str, tie: str) -> DataFrame:
    """Adds scale: the row's place by value (then tie) from 0 to 1. Only rows equal in
    both are numbered in a window."""
    total = df.agg(F.count(value).alias("_n"))
    rows = df.where(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(value, tie).orderBy(tie)) - 1)
    placed = rows.join(ranks(df, [value, tie]).select(value, tie, "before"), [value, tie])
    return placed.crossJoin(F.broadcast(total)).withColumn("scale", F.try_divide(F.col("before") + F.col("_k"), F.col("_n") - 1)).drop("_k", "_n", "before")


def spearman(df: DataFrame, x: str, y: str, control: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """n, rho and, with a control, partial: the correlation of the ranks' residuals."""
    names = [x, y] + ([control] if control else [])
    rows = df.dropna(subset=names)
    r = avg_rank(rows, names, by)
    c = lambda a, b: F.corr(f"rank_{a}", f"rank_{b}")
    aggs = [F.count("*").alias("n"), c(x, y).alias("rho")] + ([c(x, control).alias("_xz"), c(y, control).alias("_yz")] if control else [])
    out = r.groupBy(*by).agg(*aggs)
    if not control:
        return out
    xz, yz = F.col("_xz"), F.col("_yz")
    return out.withColumn("partial", F.try_divide(F.col("rho") - xz * yz, F.sqrt((1 - xz * xz) * (1 - yz * yz)))).drop("_xz", "_yz")


def quantile_edges(df: DataFrame, value: str, q: int) -> DataFrame:
    return global_quantiles(df, value, [k / q for k in range(q + 1)]).withColumnRenamed("q", "edges")


def quantile_bins(df: DataFrame, value: str, q: int = 5) -> DataFrame:
    """Adds bin 1..q; bins are closed below, the last also above."""
    v, e = F.col(value), F.col("edges")
    bins = F.coalesce(*[F.when((v >= e[k]) & (v < e[k + 1] if k < q - 1 else v <= e[k + 1]), k + 1) for k in range(q)])
    return df.crossJoin(F.broadcast(quantile_edges(df, value, q))).withColumn("bin", bins).drop("edges")


def quantile_table(df: DataFrame, x: str, y: str, q: int = 5) -> DataFrame:
    rows = staged(quantile_bins(df, x, q).where("bin IS NOT NULL").select("bin", F.col(x).alias("_x"), F.col(y).alias("_y")), "bins")
    table = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("_x").alias("mean_x"), F.avg("_y").alias("mean_y"))
    return with_medians(table, rows, {"median_y": F.col("_y")}, ["bin"])


def stratified_report(df: DataFrame, stratum: Column, x: str, y: str, control: str, n_min: int = 200) -> DataFrame:
    """spearman per stratum of at least n_min rows."""
    return spearman(df.withColumn("stratum", stratum), x, y, control, ["stratum"]).where(F.col("n") >= n_min)


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: n1, n2, u (of the rows where group is true), z with tie correction
    and no continuity shift, and p, the chance of so great a z or a greater one."""
    rows = df.dropna(subset=[value, group])
    r = ranks(rows, value)
    # rows of equal value and group count as one
    each = rows.groupBy(value, group).agg(F.count("*").alias("_m")).join(r.select(value, "rank"), value)
    first = lambda c: F.coalesce(F.sum(F.when(F.col(group), c)), F.lit(0))
    g = each.agg(first(F.col("_m")).alias("n1"), (F.coalesce(F.sum("_m"), F.lit(0)) - first(F.col("_m"))).alias("n2"), F.sum(F.when(F.col(group), F.col("rank") * F.col("_m"))).alias("r1"))
    ties = r.agg(F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("t"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("t") / (n * (n - 1))))
    out = g.crossJoin(F.broadcast(ties)).select("n1", "n2", u.alias("u"), F.try_divide(u - n1 * n2 / 2, sd).alias("z"))
    return out.withColumn("p", normal_tail(F.col("z")))


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution: erfc's rational approximation
    of relative error below 1.2e-7 (Press et al., Numerical Recipes), whose
    coefficients are fixed values, in Horner's form."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    poly = F.lit(0.0)
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    tail = t * F.exp(poly - x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def paired_shift(df: DataFrame, a: str, b: str) -> DataFrame:
    values = {"median_shift": F.col(b) - F.col(a), "median_ratio": F.col(b) / F.greatest(F.col(a), F.lit(1e-6))}
    found = [quantiles(df.select(v.alias("_v")), "_v", [0.5]).select(F.col("q")[0].alias(n)) for n, v in values.items()]
    return found[0].crossJoin(F.broadcast(found[1]))  # one row each


def health(df: DataFrame, value: str, wet: float = 0.1) -> DataFrame:
    v = F.col(value)
    bad = v.isNull() | F.isnan(v)
    ok = F.when(~bad, v)
    sums = df.agg(F.count("*").alias("n"), F.avg(bad.cast("double")).alias("missing"), F.min(ok).alias("lo"), F.max(ok).alias("hi"), F.avg(ok).alias("mean"), F.avg((ok > wet).cast("double")).alias("wet_share"))
    points = (0.5, 0.9, 0.99)
    q = quantiles(df.select(ok.alias("_v")), "_v", points)  # one row
    return sums.crossJoin(F.broadcast(q)).select(*sums.columns, *[F.col("q")[k].alias(f"p{round(p * 100)}") for k, p in enumerate(points)])
