"""Stored tables: what is read is counted in the plan, runs may stop and be run again."""

import pytest
from pyspark.sql import functions as F

from gridcells.operators import fold as O
from gridcells.plans import registry, views
from gridcells.sources import store as T


def scans(df):
    """numFiles and numOutputRows of each file scan of a frame that has been run."""
    plan = df._jdf.queryExecution().executedPlan()
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            out.append((metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()))
        kids = node.children()
        todo += [kids.apply(k) for k in range(kids.size())]
    return out


def blocks(spark, path):
    pixels = spark.range(200 * 200).select(F.floor(F.col("id") / 200).alias("row"), (F.col("id") % 200).alias("col"), F.col("id").alias("v"))
    dense = pixels.groupBy(F.floor(F.col("row") / 10).alias("by"), F.floor(F.col("col") / 10).alias("bx")).agg(F.sort_array(F.collect_list("v")).alias("values"))
    parent = F.floor(F.col("row") / 7) * 1000 + F.floor(F.col("col") / 7)
    T.write_blocks(dense, pixels, path, 10, lambda by, bx: F.floor(by / 4) * 100 + F.floor(bx / 4), parent)
    return pixels, parent


def test_blocks_of_few_cells_read_few_files(spark, tmp_path):
    path = "file://" + str(tmp_path / "stored")
    pixels, parent = blocks(spark, path)
    for cells, few in (([3004], 100), ([3004, 20011], 100), (list(range(0, 29 * 1000, 1000)), 100), (list(range(0, 29 * 1000, 1000)), 10)):
        found = T.blocks_of(spark, path, F.col("parent").isin(cells), few)
        got = {(r["by"], r["bx"]) for r in found.collect()}
        assert got == {(r["row"] // 10, r["col"] // 10) for r in pixels.where(parent.isin(cells)).collect()}
        files = {n for n, _ in scans(found)}
        regions = {(by // 4, bx // 4) for by, bx in got}
        all_files = spark.read.parquet(f"{path}/blocks").count() and len(spark.read.parquet(f"{path}/blocks").inputFiles())
        assert all_files >= 25 and min(files) <= len(regions) and sum(files) < all_files + 8


def test_lookups_skip_files_and_row_groups(spark, tmp_path):
    path = "file://" + str(tmp_path / "cells")
    T.cluster(spark.range(200_000).select((F.col("id") * 3).alias("cell"), F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b")), path, "cell", 4, 1 << 18)
    for cells, n in (([300], 1), ([300, 301, 599_997], 2), ([301], 0)):
        found = T.lookup(spark, path, "cell", cells)
        assert found.count() == n
        again = T.lookup(spark, path, "cell", cells)
        assert len(again.collect()) == n
        rows = sum(r for _, r in scans(again))
        # a cell that is not there lies within the bounds of a row group, but not in its filter
        assert rows == 0 if n == 0 else n <= rows < 100_000


@pytest.mark.parametrize("few", [1000, 3])
def test_lookups_of_a_table_of_keys(spark, tmp_path, few):
    path = "file://" + str(tmp_path / "cells")
    T.cluster(spark.range(50_000).select((F.col("id") * 3).alias("cell"), F.col("id").alias("a")), path, "cell", 4, 1 << 16)
    keys = spark.range(90, 120_000, 10_000).select(F.col("id").alias("cell"))
    got = sorted(r["cell"] for r in T.lookup(spark, path, "cell", keys.union(keys), few).collect())
    assert got == [k for k in range(90, 120_000, 10_000) if k % 3 == 0]


def test_the_stored_lookup_reaches_as_far_as_the_table(spark, tmp_path):
    """Cells of columns far beyond those of the smallest table."""
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    far = rows.withColumns({"l_partkey": F.col("l_partkey") * 50 + 7, "l_suppkey": F.col("l_suppkey") * 40 + 803})
    rows.unionByName(far.select(rows.columns)).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r["cell"], r["n"], r["v"]) for r in registry.queries()["t03_stored_lookup"](spark, str(tmp_path)).collect()}
    px = views.get(spark, str(tmp_path), "px").where("i % 50 = 7 AND j % 40 = 3")
    want = {(r["cell"], r["n"], r["v"]) for r in px.groupBy("cell").agg(F.count("*").alias("n"), F.sum("v").alias("v")).collect()}
    assert got == want and len(want) > 20


def work_and_source(spark):
    rows = spark.range(4000).select((F.col("id") % 20).cast("string").alias("tile"), (F.col("id") % 37).alias("cell"), (F.col("id") * 7 % 101).alias("v"))
    return spark.range(22).select(F.col("id").cast("string").alias("tile")), rows


def made(rows):
    return lambda tiles: O.fold(rows.join(F.broadcast(tiles), "tile", "left_semi"), ["tile", "cell"], O.sums(["v"]))


SCHEMA = "cell long, sum_v long, n_v long"


def merged(spark, base):
    return sorted(map(tuple, O.merge_partials(T.read_tiles(spark, base, SCHEMA), ["v"]).collect()))


def test_a_stopped_ingest_goes_on_where_it_was(spark, tmp_path):
    base = "file://" + str(tmp_path / "ingest")
    work, rows = work_and_source(spark)
    once = sorted(map(tuple, rows.groupBy("cell").agg(F.avg("v").alias("v"), F.count("v").alias("n_v")).collect()))
    seen = []

    def failing(tiles):
        own = {r["tile"] for r in tiles.collect()}
        if len(seen) == 2:
            # half of a group is on the disk, but not in the manifest
            made(rows)(tiles).limit(3).withColumn("version", F.lit(1).cast("long")).write.mode("append").partitionBy("tile").parquet(f"{base}/tiles")
            raise RuntimeError("stopped")
        seen.append(own)
        return made(rows)(tiles)

    assert merged(spark, base) == []
    with pytest.raises(RuntimeError, match="stopped"):
        T.ingest(work, failing, base, 4)
    done = {r["tile"] for r in T.finished(spark, base).collect()}
    assert done == set().union(*seen) and 0 < len(done) < 22
    assert merged(spark, base) == sorted(map(tuple, rows.where(F.col("tile").isin(list(done))).groupBy("cell").agg(F.avg("v").alias("v"), F.count("v").alias("n_v")).collect()))
    later = []

    def counting(tiles):
        later.append({r["tile"] for r in tiles.collect()})
        return made(rows)(tiles)

    assert T.ingest(work, counting, base, 4) == 22 - len(done)
    assert set().union(*later) == {str(k) for k in range(22)} - done
    assert merged(spark, base) == once and T.ingest(work, counting, base, 4) == 0
    # tiles without rows are entered as such
    assert {r["tile"] for r in T.finished(spark, base).where("rows = 0").collect()} == {"20", "21"}


def test_a_tile_made_again_replaces_its_sums(spark, tmp_path):
    base = "file://" + str(tmp_path / "ingest")
    work, rows = work_and_source(spark)
    T.ingest(work, made(rows), base)
    new = rows.where("tile <> '3' OR v > 50").where("tile <> '4'")
    T.ingest(work.where("tile IN ('3', '4')"), made(new), base, again=True)
    assert merged(spark, base) == sorted(map(tuple, new.groupBy("cell").agg(F.avg("v").alias("v"), F.count("v").alias("n_v")).collect()))
    entries = {r["tile"]: (r["rows"], r["version"]) for r in T.finished(spark, base).collect()}
    assert entries["4"] == (0, 2) and entries["5"][1] == 1
    # made again, but stopped: no longer whole, so the next run makes it

    def failing(tiles):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        T.ingest(work.where("tile = '3'"), failing, base, again=True)
    assert "3" not in {r["tile"] for r in T.finished(spark, base).collect()}
    assert T.ingest(work, made(rows.where("tile <> '4'")), base) == 1
    assert merged(spark, base) == sorted(map(tuple, rows.where("tile <> '4'").groupBy("cell").agg(F.avg("v").alias("v"), F.count("v").alias("n_v")).collect()))


def test_a_run_of_many_tiles_takes_few_groups(spark, tmp_path):
    """What ``make`` costs for a group, a pass over its source, is paid a few times only."""
    base, calls = "file://" + str(tmp_path / "ingest"), []
    rows = spark.range(4000).select((F.col("id") % 400).cast("string").alias("tile"), (F.col("id") % 37).alias("cell"), F.col("id").alias("v"))

    def counting(tiles):
        calls.append(tiles.count())
        return made(rows)(tiles)

    assert T.ingest(rows.select("tile").distinct(), counting, base, 2) == 400 == sum(calls)
    assert len(calls) <= 7 and max(calls) < 300 and T.read_tiles(spark, base, SCHEMA).agg(F.sum("n_v")).first()[0] == 4000
    for n, group in ((0, 4), (1, 4), (22, 4), (3000, 2), (10**6, 64)):
        ends = T.group_ends(n, group)
        sizes = [b - a for a, b in zip([0, *ends], ends)]
        assert sum(sizes) == n and all(0 < k <= max(group, -(-n // 2), 1) and k <= T.GROUP_TILES for k in sizes)
