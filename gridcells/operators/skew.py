"""Joins in which a few keys may make up much of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that each make up over one HOT_KEYS-th of a table; at most so many exist.
HOT_KEYS = 1000


def hot_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of a written table ``left`` with ``right`` of one row for each key.
    The keys that make up much of ``left``, of which there are few, meet in a broadcast,
    so none gathers in one task; the others in a join that Spark chooses."""
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    total = left.agg(F.count("*").alias("_all"))  # one row
    hot = [(r[key],) for r in counts.crossJoin(F.broadcast(total)).where(F.col("_n") > F.floor(F.col("_all") / HOT_KEYS)).select(key).collect()]
    if not hot:
        return left.join(right, key)
    keys = left.sparkSession.createDataFrame(hot, left.select(key).schema)
    frequent = left.join(F.broadcast(right.join(F.broadcast(keys), key, "left_semi")), key)
    return frequent.unionByName(left.join(F.broadcast(keys), key, "left_anti").join(right, key))
