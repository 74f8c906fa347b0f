"""Connected components of an edge table, as joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcells.runtime import staged

#: Edges that a task joins up at once (some 40 MB), before it hands their components on.
BLOCK_EDGES = 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least node of its component, and node, for every node of the edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at_a, at_b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[at_a], label[at_b])
        new = label.copy()
        # hook the labels' own nodes too, so long paths shrink at once
        for side in (label[at_a], label[at_b], at_a, at_b):
            np.minimum.at(new, side, low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return nodes[label], nodes
        label = new


def _joined_up(edges: DataFrame) -> DataFrame:
    """a, b, block: the stars of each block of BLOCK_EDGES edges of a partition, which
    connect what the edges did, with a row for each node of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            root, node = stars(*[np.concatenate([x.column(c).to_numpy() for x in held]) for c in "ab"])
            return pa.RecordBatch.from_pydict({"a": root, "b": node, "block": np.full(len(node), part << 32 | block)})

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= BLOCK_EDGES:
                yield flush()
                block, held, size = block + 1, [], 0
        if held:
            yield flush()

    return edges.mapInArrow(run, "a long, b long, block long")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component of every node of ``edges`` (a, b long): component is one
    node of it, the same for all its nodes.

    Each round first joins up the edges of every block of a partition, so what is left
    of a block are stars. If that was one block, or they fit in one, they are the answer.
    Otherwise each node maps to the neighbour (or itself) of least random priority, and
    the edges contract along that map; random priorities shrink even long paths by a
    constant factor a round. Edges without a partner (a = b) keep their node. Every round is
    written to the shared folder.
    """
    rest = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct()
    maps: list[DataFrame] = []
    while True:
        # in the partitions of ``distinct``, which deal the edges of a hub out
        met = staged(_joined_up(rest), "stars")
        n_blocks, n_rows = met.agg(F.count_distinct("block"), F.count("*")).first()
        if 1 < n_blocks and n_rows <= BLOCK_EDGES:
            met, n_blocks = staged(_joined_up(met.select("a", "b").coalesce(1)), "stars"), 1
        if n_blocks <= 1:
            maps.append(met.select(F.col("b").alias("node"), F.col("a").alias("to")))
            break
        ranked = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(maps))).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        both = met.select(F.col("a").alias("node"), F.least(ranked("a"), ranked("b")).alias("to"))
        both = both.unionByName(met.select(F.col("b").alias("node"), F.least(ranked("a"), ranked("b")).alias("to")))
        step = staged(both.groupBy("node").agg(F.min("to")["v"].alias("to")), "step")
        maps.append(step)
        moved = met.where("a <> b").join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        rest = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    out = maps[0].select("node", F.col("to").alias("component"))
    for step in maps[1:]:
        out = out.join(step.withColumnsRenamed({"node": "component", "to": "next"}), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return out
