"""Tracks of blobs over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcells.operators.components import connected_components
from gridcells.runtime import staged


def links(blobs: DataFrame, step: str, gate: float) -> DataFrame:
    """a, b (numbers of blobs): the greedy matching of the blobs (node, ts, blob, cx, cy)
    of each step with those of the next within ``gate``: of all pairs whose blobs are both
    free the nearest is taken, ties by the lower blobs, and so on. Pairs that are the
    nearest of both their blobs are taken at once, in rounds, which gives the same; a blob
    that loses its claim goes for its next nearest. Centroids meet in buckets of the gate's
    width."""
    at = lambda c: F.floor(F.col(c) / gate).cast("long")
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    here = blobs.select(F.col("node").alias("a"), F.col("blob").alias("own"), (F.col("ts") + F.expr(f"INTERVAL {step}")).alias("ts"), "cx", "cy", F.explode(around).alias("s"))
    here = here.select("a", "own", "ts", "cx", "cy", (at("cx") + F.col("s.dx")).alias("gx"), (at("cy") + F.col("s.dy")).alias("gy"))
    there = blobs.select(F.col("node").alias("b"), F.col("blob").alias("nxt"), "ts", F.col("cx").alias("bx"), F.col("cy").alias("by"), at("cx").alias("gx"), at("cy").alias("gy"))
    met = here.join(there, ["ts", "gx", "gy"]).withColumn("d", F.hypot(F.col("bx") - F.col("cx"), F.col("by") - F.col("cy"))).where(F.col("d") <= gate)
    return greedy(met.select("a", "b", F.struct("d", "own", "nxt").alias("o")))


def greedy(pairs: DataFrame) -> DataFrame:
    """a, b of the greedy matching of ``pairs`` (a, b, o): in the order of o, in which no
    two pairs of an a or of a b are equal, each pair whose a and b are free."""
    rest, done = staged(pairs, "pairs"), None
    while True:
        best = rest.groupBy("a").agg(F.min(F.struct("o", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.o").alias("o"))
        first = rest.groupBy("b").agg(F.min(F.struct("o", "a")).alias("m")).select("b", F.col("m.a").alias("a"))
        taken = staged(best.join(first, ["a", "b"]).select("a", "b"), "taken")
        done = taken if done is None else done.unionByName(taken)
        # the nearest pair of all is taken in each round, so none means that none is left
        if taken.isEmpty():
            return done
        rest = staged(rest.join(taken.select("a"), "a", "left_anti").join(taken.select("b"), "b", "left_anti"), "pairs")


def tracks(blobs: DataFrame, step: str, gate: float) -> DataFrame:
    """ts, blob, born, first, days of every blob (ts, blob, cx, cy): the time and blob
    that its track began with, and the blobs of the track, at most one a step."""
    order = F.struct("ts", "blob")
    nodes = staged(blobs.withColumn("node", F.monotonically_increasing_id()), "blobs")
    found = connected_components(links(nodes, step, gate))
    named = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = staged(named.select("ts", "blob", "component"), "tracks")
    begun = named.groupBy("component").agg(F.min(order).alias("o"), F.count("*").alias("days"))
    return named.join(begun, "component").select("ts", "blob", F.col("o.ts").alias("born"), F.col("o.blob").alias("first"), "days")
