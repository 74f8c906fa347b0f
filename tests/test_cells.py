"""Invariants of the cell index."""

import random

from pyspark.sql import functions as F

from gridcells.functions import cells as H


def test_seven_children_per_parent(spark):
    ij = spark.range(-70, 70).withColumnRenamed("id", "i").crossJoin(spark.range(-70, 70).withColumnRenamed("id", "j"))
    for res in (12, 11):
        cells = ij.select(H.pack(res, "i", "j").alias("c"), "i", "j")
        n = cells.groupBy(H.cell_parent("c", res - 1, res).alias("p")).agg(F.count("*").alias("n"), F.collect_set("c").alias("cs"))
        inner = n.where("n = 7").select("p", "cs", F.explode("cs").alias("c"))
        around = inner.groupBy("p").agg(F.max(F.size(F.array_intersect("cs", H.grid_disk("c")))).alias("m"))
        assert n.where("n > 7").count() == 0 and around.count() > 1000 and around.where("m <> 7").count() == 0


def test_disk_distance_and_packing(spark):
    rows = spark.createDataFrame([(i, j) for i, j in ((0, 0), (5, -3), (-200, 77))], "i int, j int")
    cells = rows.select(H.pack(9, "i", "j").alias("c"), "i", "j")
    i, j = H.axial("c")
    assert cells.where((i != F.col("i")) | (j != F.col("j")) | (H.resolution("c") != 9)).count() == 0
    near = cells.select("c", F.explode(H.grid_disk("c", 2)).alias("d")).withColumn("k", H.grid_distance("c", "d"))
    assert near.groupBy("k").count().orderBy("k").collect() == [(0, 3), (1, 18), (2, 36)]


def test_centres_round_trip_and_area(spark):
    rng = random.Random(3)
    pts = spark.createDataFrame([(rng.uniform(-60, 60), rng.uniform(-179, 179)) for _ in range(200)], "lat double, lon double")
    for res in (12, 9, 4):
        c = pts.select(H.latlng_to_cell("lat", "lon", res).alias("c"))
        mid = c.withColumn("m", H.cell_to_latlng("c", res))
        assert mid.where(H.latlng_to_cell("m.lat", "m.lon", res) != F.col("c")).count() == 0
    assert H.add_cell(pts, "lat", "lon", 5).where(H.latlng_to_cell("lat", "lon", 5) != F.col("cell")).count() == 0
    fine = pts.select(H.latlng_to_cell("lat", "lon", 12).alias("f"), H.latlng_to_cell("lat", "lon", 6).alias("c"))
    assert fine.where(H.cell_parent("f", 6, 12) != F.col("c")).count() == 0
    assert abs(H.cell_area_km2(9) / H.cell_area_km2(12) - 343) < 1e-9


def test_boundary_has_the_cells_area(spark):
    c = spark.createDataFrame([(0, 0), (11, -4)], "i int, j int")
    for res in (12, 10, 7):
        for r in c.select(H.cell_boundary(H.pack(res, "i", "j"), res).alias("b")).collect():
            p = r["b"]
            area = abs(sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(p, p[1:]))) / 2
            assert p[0] == p[6] and abs(area / 1e6 / H.cell_area_km2(res) - 1) < 1e-6
