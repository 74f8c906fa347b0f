"""Reports over frames: summaries, crosstabs, shares, tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcells.operators.stats import with_medians


def class_summary(frame: DataFrame, cls: str, value: str, moved: Column, low: float) -> DataFrame:
    """Per class: n, mean and median of the value, median where moved, share below low."""
    v = F.col(value)
    table = frame.groupBy(cls).agg(F.count("*").alias("n"), F.count(v).alias("scored"), F.avg(v).alias("mean"), F.avg(F.when(v.isNotNull(), (v < low).cast("double"))).alias("below"))
    return with_medians(table, frame, {"median": v, "median_moved": F.when(moved, v)}, [cls])


def mode_of(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """n and the most frequent name (the lower on ties)."""
    counts = df.groupBy(*keys, name).agg(F.count("*").alias("k"))
    return counts.groupBy(*keys).agg(F.sum("k").alias("n"), F.min_by(name, F.struct(-F.col("k"), name)).alias("mode"))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence, where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(f"{col}_{v}") for v in values])


def top_mix(df: DataFrame, group: str, name: str, k: int = 3) -> DataFrame:
    """Per group the k most frequent names with percent, as text."""
    counts = df.groupBy(group, name).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    ranked = counts.withColumns({"tot": F.sum("n").over(w), "rk": F.row_number().over(w.orderBy(F.desc("n"), name))}).where(F.col("rk") <= k)
    piece = F.concat(F.floor(F.col("n") * 100 / F.col("tot") + 0.5).cast("string"), F.lit("% "), F.col(name).cast("string"))
    return ranked.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", piece.alias("p")))), lambda x: x["p"]), ", ").alias("mix"))


def shares(df: DataFrame, cls: str, value: str) -> DataFrame:
    total = df.agg(F.count("*").alias("_t"))
    each = with_medians(df.groupBy(cls).agg(F.count("*").alias("n")), df, {"median": F.col(value)}, [cls])
    return each.crossJoin(F.broadcast(total)).select(cls, "n", (F.col("n") * 100 / F.col("_t")).alias("pct"), "median")


def top_k(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rk", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rk") <= k)


def track(blobs: DataFrame, key: str = "ts", size: str = "km2") -> DataFrame:
    """The largest blob of each hour with the hour's total."""
    w = Window.partitionBy(key)
    return blobs.withColumns({"total": F.sum(size).over(w), "rk": F.row_number().over(w.orderBy(F.desc(size), "blob"))}).where("rk = 1").drop("rk")


def peaks(blobs: DataFrame, level: str = "lvl", key: str = "ts", size: str = "km2") -> DataFrame:
    return blobs.groupBy(level).agg(F.count("*").alias("n"), F.max(size).alias("max"), F.max_by(key, F.struct(F.col(size), F.negative(F.unix_timestamp(key)))).alias("at"), F.sum(size).alias("total"))


def peer_compare(frame: DataFrame, cell_filter: Column, cls: str, value: str) -> DataFrame:
    """The picked rows beside the median of their class."""
    peers = with_medians(frame.groupBy(cls).agg(F.count("*").alias("peers")), frame, {"peer_median": F.col(value)}, [cls])
    return frame.where(cell_filter).join(peers, cls)
