"""Operators against brute force on small and random inputs."""

import datetime
import math
import os
import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from gridcells import runtime
from gridcells.functions import cells as H
from gridcells.operators import blobs as B
from gridcells.operators import change as C
from gridcells.operators import components, cover
from gridcells.operators import fold as O
from gridcells.operators import joins as J
from gridcells.operators import member as G
from gridcells.operators import stats as S
from gridcells.operators.components import connected_components
from gridcells.operators.tracks import links, tracks
from gridcells.plans import registry


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components_random_and_path(spark):
    rng = random.Random(1)
    for edges in ([(i, i + 1) for i in range(100)], [(rng.randrange(200), rng.randrange(200)) for _ in range(150)], [(0, i) for i in range(1, 50)] + [(60, 60)], []):
        parent = {x: x for e in edges for x in e}
        for a, b in edges:
            parent[find(parent, a)] = find(parent, b)
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert set(got) == set(parent)
        assert {frozenset(k for k in got if got[k] == c) for c in set(got.values())} == {frozenset(k for k in parent if find(parent, k) == r) for r in {find(parent, k) for k in parent}}


def grid(spark, ij, res=10):
    return spark.createDataFrame(ij, "i int, j int").select(H.pack(res, "i", "j").alias("cell"), "i", "j")


def test_blobs_and_fence_of_a_ring_with_a_hole(spark):
    ring = [(0 + a, 0 + b) for a, b in H.NEIGHBOURS]
    cells = grid(spark, ring + [(9, 9)])
    assert B.blobs(cells).select("blob").distinct().count() == 2
    edges = G.hex_edges(cells)
    assert edges.where("b IS NOT NULL").count() == 6 and edges.count() == 7 * 6 - 6
    assert G.fence(edges, cells).count() == 7 * 6 - 12  # 6 inside the hole, 18 around the ring, 6 of the single cell
    one = B.blob_boundary(B.blobs(cells))
    assert one.count() == 7 * 6 - 12


def parsed(wkb):
    """Rings of a big-endian polygon."""
    assert wkb[:5] == b"\0\0\0\0\3"
    (n,), at, rings = struct.unpack(">I", wkb[5:9]), 9, []
    for _ in range(n):
        (k,) = struct.unpack(">I", wkb[at : at + 4])
        flat = struct.unpack(f">{2 * k}d", wkb[at + 4 : at + 4 + 16 * k])
        rings.append(list(zip(flat[::2], flat[1::2])))
        at += 4 + 16 * k
    assert at == len(wkb)
    return rings


@pytest.mark.parametrize("res", [10, 11])
def test_polygons_of_blobs(spark, res):
    """Signed areas, holes, closed rings of unit steps; a hole within a hole is a blob."""
    rng = random.Random(15)
    ring = [(a, b) for a in range(-3, 4) for b in range(-3, 4) if max(abs(a), abs(b), abs(a - b)) == 3]
    ij = [*ring, (0, 0), (50, 50)] + [(100 + i, 100 + j) for i in range(16) for j in range(16) if rng.random() < 0.75]
    cells = B.blobs(grid(spark, ij, res))
    sizes = {r["blob"]: r["n"] for r in cells.groupBy("blob").agg(F.count("*").alias("n")).collect()}
    rings = {(r["blob"], r["ring_cell"], r["ring_side"], r["n"]) for r in B.ordered_rings(B.blob_boundary(cells)).collect()}
    area, out = H.cell_area_km2(res) * 1e6, B.polygons(B.blob_boundary(cells), res).collect()
    step = math.hypot(*H._step_vectors(res)[0]) / math.sqrt(3)
    assert {r["blob"] for r in out} == set(sizes)
    for r in out:
        made = parsed(bytes(r["wkb"]))
        signed = []
        for points in made:
            assert all(math.hypot(p[0] - q[0], p[1] - q[1]) == pytest.approx(step, rel=1e-6) for p, q in zip(points, points[1:]))
            assert points[0] == points[-1]
            x0, y0 = points[0]
            signed.append(sum((p[0] - x0) * (q[1] - y0) - (q[0] - x0) * (p[1] - y0) for p, q in zip(points, points[1:])) / 2)
        assert signed[0] > 0 and all(s < 0 for s in signed[1:])
        assert sum(signed) == pytest.approx(sizes[r["blob"]] * area, rel=1e-6) == pytest.approx(r["area_m2"], rel=1e-6)
        assert (r["n_rings"], r["n_sides"]) == (len(made), sum(len(p) - 1 for p in made)) and r["n_rings"] == len({x for x in rings if x[0] == r["blob"]})
    assert max(r["n_rings"] for r in out) > 2 and min(r["n_rings"] for r in out) == 1


def test_lists_are_ranked(spark):
    rows = [(k, k + 1 if k % 100 != 99 else None) for k in range(300)] + [(1000, None)]
    got = {r["node"]: r["rest"] for r in B.ranked(spark.createDataFrame(rows, "node long, to long")).collect()}
    assert got == {k: 99 - k % 100 for k in range(300)} | {1000: 0}


def test_every_fence_edge_has_one_member_side(spark):
    rng = random.Random(4)
    cells = grid(spark, [(i, j) for i in range(12) for j in range(12) if rng.random() < 0.7])
    members = cells.where("(i * 7 + j * 3) % 5 < 2")
    inside = {r["cell"] for r in members.collect()}
    for r in G.fence(G.hex_edges(cells), members).collect():
        assert (r["a"] in inside) != (r["b"] in inside)


def test_planes_order_and_ties(spark):
    pixels = spark.createDataFrame([(p, p // 4) for p in range(12)], "pixel int, cell int")
    rng = random.Random(5)
    film = [(p, t, float(rng.randrange(10))) for p in range(12) for t in range(6) if rng.random() < 0.7]
    got = O.planes(spark.createDataFrame(film, "pixel int, ts int, value double"), pixels).collect()
    for r in got:
        v = sorted([x for p, t, x in film if p // 4 == r["cell"] and t == r["ts"]] + [0.0] * 4, reverse=True)
        assert (r["any"], r["majority"], r["all"]) == (v[0], sorted(v[:4] if len(v) >= 4 else v, reverse=True)[2], v[3])
        assert r["any"] >= r["majority"] >= r["all"]


def test_majority_needs_more_than_half(spark):
    rows = spark.createDataFrame([(1, 0, True), (1, 0, True), (1, 0, False), (1, 0, False)], "parent int, ts int, h boolean")
    sizes = spark.createDataFrame([(1, 4)], "parent int, n long")
    r = G.rule_members(rows, sizes, "parent", F.col("h")).first()
    assert (r["any"], r["majority"], r["all"]) == (True, False, False)


def test_class_tie_goes_to_the_lower_code(spark):
    rows = spark.createDataFrame([(1, 5), (1, 3), (1, 15), (1, 15), (2, 15)], "cell int, cls int")
    got = {r["cell"]: (r["maj"], r["chg"]) for r in O.class_fold(rows, ["cell"]).collect()}
    assert got == {1: (15, 3), 2: (15, 15)}


def test_accumulator_with_a_missing_hour(spark):
    rows = [(1, f"2024-01-01 0{h}:00:00", x) for h, x in ((0, 9.0), (1, 4.0), (2, 2.0), (4, 8.0))]
    film = spark.createDataFrame(rows, "pixel long, ts string, x double").withColumn("ts", F.col("ts").cast("timestamp"))
    a = 0.5 ** (1 / 3)
    l1 = (1 - a) * 4
    l2 = a * l1 + (1 - a) * 2
    want = {"decay": [0, l1, l2, a * a * l2 + (1 - a) * 8], "hold": [0, l1, l2, a * l2 + (1 - a) * 8]}
    for gap, loads in want.items():
        got = [r["load"] for r in C.accumulate(film, 3.0, "2024-01-01 00:00:00", gap=gap).orderBy("ts").collect()]
        assert max(abs(x - y) for x, y in zip(got, loads)) < 1e-9


@pytest.mark.parametrize("gap", ["decay", "hold"])
def test_accumulator_over_many_partitions(spark, gap):
    """One series cut by every partition, short ones around it, nulls and gaps."""
    rng = random.Random(14)
    rows = [(7, h, rng.uniform(0, 9), rng.choice([1.0, 1.0, 0.3, 0.0])) for h in range(-3, 900) if rng.random() < 0.8]
    rows += [(p, h, float(p + h), 0.5) for p in (1, 2, 8, 9) for h in range(5)]
    rows += [(10, h, None if h == 3 else 1.0, 1.0) for h in range(-2, 6)]
    at = lambda h: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(hours=h)
    want, a = {}, 2 ** (-1 / 5)
    for pixel in {r[0] for r in rows}:
        last, load = 0, 0.0
        for _, h, x, fl in sorted(r for r in rows if r[0] == pixel):
            passed = max(h - last, 0)
            kept = None if load is None else load * (a**passed if gap == "decay" else a if passed else 1.0)
            load = 0.0 if h <= 0 else None if x is None or kept is None else fl * (kept + (1 - a) * x)
            last = h
            want[pixel, at(h)] = load
    film = spark.createDataFrame([(p, at(h), x, fl) for p, h, x, fl in rows], "pixel long, ts timestamp, x double, fl double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = C.accumulate(film, 5.0, "2024-01-01 00:00:00", "fl", gap)
        got = {(r["pixel"], r["ts"].astimezone(datetime.timezone.utc)): r["load"] for r in out.collect()}
        again = C.accumulate(film.repartition(1), 5.0, "2024-01-01 00:00:00", "fl", gap).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and again == len(want)
    assert all((v is None) == (got[k] is None) and (v is None or abs(got[k] - v) < 1e-9) for k, v in want.items())
    assert C.accumulate(film.limit(0), 5.0, "2024-01-01 00:00:00", "fl", gap).collect() == []


def test_sketches_of_tiles_merge(spark):
    """Unions of tiles estimate what the whole does; errors stay within their bound."""
    for n in (50, 3_000, 60_000):
        rows = spark.range(4 * n).select((F.col("id") % n).alias("v"), (F.col("id") * 7 % 13).alias("tile"), F.lit(1).alias("k"))
        about = lambda df: O.merge_sketches(df, ["k"]).select(F.hll_sketch_estimate("sketch").alias("n")).first()["n"]  # noqa: E731, B023
        tiles = O.distinct_sketches(rows, ["k", "tile"], "v", 12)
        assert about(tiles) == about(O.distinct_sketches(rows, ["k"], "v", 12))
        assert about(O.merge_sketches(tiles.where("tile < 6"), ["k"]).unionByName(O.merge_sketches(tiles.where("tile >= 6"), ["k"]))) == about(tiles)
        assert abs(about(tiles) - n) <= 4 * 1.04 / math.sqrt(1 << 12) * n + 1


def test_partials_equal_one_shot(spark):
    rows = spark.range(500).select((F.col("id") % 9).alias("cell"), (F.col("id") % 4).alias("tile"), (F.col("id") * 7 % 31).alias("v"))
    tiles = O.fold(rows, ["tile", "cell"], O.sums(["v"]))
    once = rows.groupBy("cell").agg(F.avg("v").alias("v"), F.count("v").alias("n_v"))
    assert sorted(map(tuple, O.merge_partials(tiles, ["v"]).collect())) == sorted(map(tuple, once.collect()))


def test_true_nearest_equals_brute_force(spark):
    rng = random.Random(6)
    a = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(60)]
    b = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(25)]
    got = {r["id"]: r["b_id"] for r in J.nearest(spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(b, "id long, x double, y double"), 5.0).collect()}
    assert got == {i: min(b, key=lambda q: (q[1] - x) ** 2 + (q[2] - y) ** 2)[0] for i, x, y in a}


def test_ring_fill_and_agreement(spark):
    rng = random.Random(7)
    a = grid(spark, [(i, j) for i in range(9) for j in range(9) if rng.random() < 0.5]).collect()
    b = grid(spark, [(i, j) for i in range(9) for j in range(9) if rng.random() < 0.4]).collect()
    put = lambda rows, d: [(r["cell"], r["cell"], 10.0 * r["i"] + d, 10.0 * r["j"], r["i"], r["j"]) for r in rows]
    pa, pb = put(a, 0.0), put(b, 1.5)
    frame = lambda rows: spark.createDataFrame([r[:4] for r in rows], "id long, cell long, x double, y double")
    for r in J.match_grids(frame(pa), frame(pb)).collect():
        me = next(p for p in pa if p[0] == r["id"])
        ring = [p for p in pb if (p[4] - me[4], p[5] - me[5]) in H.NEIGHBOURS]
        own = [p for p in pb if p[1] == me[1]]
        best = min(own or ring, key=lambda p: ((p[2] - me[2]) ** 2 + (p[3] - me[3]) ** 2, p[0]), default=None)
        assert (r["b_id"], r["how"]) == ((best[0], 0 if own else 1) if best else (None, 2))


def test_too_few_stable_cells_are_unscored(spark):
    rows = spark.createDataFrame([(i, 0.1 * i) for i in range(29)], "cell long, disp double")
    r = C.quiet_level(rows, F.lit(True)).first()
    assert r["d0"] is None and r["n_stable"] == 29


def test_average_ranks_over_partitions(spark):
    rng = random.Random(8)
    v = [rng.randrange(40) for _ in range(300)]
    got = {r["v"]: r["rank"] for r in S.ranks(spark.createDataFrame([(x,) for x in v], "v int"), "v").collect()}
    s = sorted(v)
    assert got == {x: (s.index(x) + 1 + len(s) - s[::-1].index(x)) / 2 for x in set(v)}


def test_ranks_and_quantiles_within_few_groups(spark):
    """Groups cut over range partitions, null groups and null values included."""
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(25)])) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    of = {g: sorted(v for h, v in rows if h == g and v is not None) for g in ("a", "b", None)}
    for r in S.ranks(df, "v", ["g"]).collect():
        s = of[r["g"]]
        assert (r["before"], r["n"]) == (s.index(r["v"]), s.count(r["v"])) and r["rank"] == s.index(r["v"]) + (s.count(r["v"]) + 1) / 2
    got = {r["g"]: r["q"] for r in S.quantiles(df, "v", [0, 0.3, 0.5, 1], ["g"]).collect()}
    for g, s in of.items():
        for p, q in zip((0, 0.3, 0.5, 1), got[g]):
            k = p * (len(s) - 1)
            assert abs(q - (s[int(k)] + (s[min(int(k) + 1, len(s) - 1)] - s[int(k)]) * (k - int(k)))) < 1e-9
    scaled = S.rank_scale(spark.createDataFrame([(2, 1), (1, 5), (2, 1), (2, 0), (None, 3)], "v int, t int"), "v", "t").collect()
    assert sorted((r["v"], r["t"], round(r["scale"] * 3)) for r in scaled) == [(1, 5, 0), (2, 0, 1), (2, 1, 2), (2, 1, 3)]
    assert S.quantiles(df.limit(0), "v", [0.5]).collect()[0]["q"] == [None] and S.quantiles(df.limit(0), "v", [0.5], ["g"]).collect() == []


def test_rank_correlation_with_a_value_that_most_rows_share(spark, monkeypatch):
    """Null groups, ties that half the rows share, both ways to meet a rank."""
    rng = random.Random(17)
    rows = [(rng.choice(["a", None]), rng.choice([0.0, 0.0, rng.random()]), rng.choice([1.0, rng.random()])) for _ in range(400)]

    def rank(v):
        s = sorted(v)
        return [(s.index(x) + 1 + len(s) - s[::-1].index(x)) / 2 for x in v]

    def rho(own):
        x, y = rank([r[1] for r in own]), rank([r[2] for r in own])
        mx, my = sum(x) / len(x), sum(y) / len(y)
        return sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))

    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    for hot in (1000, 3):
        monkeypatch.setattr(S, "HOT_KEYS", hot)
        assert S.spearman(df, "x", "y").first()["rho"] == pytest.approx(rho(rows))
        got = {r["g"]: (r["n"], r["rho"]) for r in S.spearman(df, "x", "y", by=["g"]).collect()}
        for g in ("a", None):
            own = [r for r in rows if r[0] == g]
            assert got[g] == (len(own), pytest.approx(rho(own)))
    ranked = S.avg_rank(spark.createDataFrame([(1.0,), (None,), (1.0,), (3.0,)], "v double"), ["v"]).collect()
    assert sorted(((r["v"], r["rank_v"]) for r in ranked), key=str) == [(1.0, 1.5), (1.0, 1.5), (3.0, 3.0), (None, None)]


def test_one_sided_p_of_the_rank_test(spark):
    z = spark.createDataFrame([(x / 4,) for x in range(-24, 25)], "z double")
    for r in z.select("z", S.normal_tail(F.col("z")).alias("p")).collect():
        assert abs(r["p"] - math.erfc(r["z"] / math.sqrt(2)) / 2) < 1e-6


def test_nearest_far_away_null_and_empty(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e7, 5.0), (3, None, 1.0), (4, 3.0, 0.0)], "id long, x double, y double")
    b = spark.createDataFrame([(7, 0.5, 0.0), (8, None, 0.0), (9, 5.0, 0.0), (6, 5.0, 0.0)], "id long, x double, y double")
    got = {r["id"]: (r["b_id"], r["dist"]) for r in J.nearest(a, b, 1.0).collect()}
    assert got[1] == (7, 0.5) and got[4] == (6, 2.0) and got[3] == (None, None)
    assert got[2][0] == 6 and abs(got[2][1] - math.hypot(1e7 - 5, 5)) < 1e-6
    assert [(r["b_id"], r["dist"]) for r in J.nearest(a, b.limit(0), 1.0).collect()] == [(None, None)] * 4
    assert J.nearest(a.limit(0), b, 1.0).collect() == []


def test_nearest_of_far_and_clustered_points(spark):
    """Grids far apart, and clusters of clusters, meet in few boxes a row."""
    a = spark.range(100_000).selectExpr("id", "id % 316 * 3000D AS x", "id div 316 * 3000D AS y")
    b = spark.range(100_000).selectExpr("id", "5e7D + id % 316 * 3000D AS x", "1e6D + id div 316 * 3000D AS y")
    got = J.nearest(a, b, counted=True).selectExpr("count(*) AS n", "count(b_id) AS found", "max(met) AS met", "avg(met) AS mean").first()
    assert got["n"] == got["found"] == 100_000 and got["mean"] < 100 and got["met"] < 400
    rng = random.Random(12)
    points = [(i, 10.0 ** rng.randrange(7) + rng.random() * 10.0 ** rng.randrange(-5, 3), 10.0 ** rng.randrange(7) + rng.random()) for i in range(700)]
    points += [(1000 + i, 7.0, 7.0) for i in range(50)]
    b = [(i, x, y) for i, x, y in points if i % 2]
    frame = lambda rows: spark.createDataFrame(rows, "id long, x double, y double")
    for fan in (2, 5, 16):
        got = {r["id"]: (r["b_id"], r["dist"]) for r in J.nearest(frame(points), frame(b), fan).collect()}
        assert len(got) == len(points)
        for i, x, y in points:
            best = min((math.hypot(p[1] - x, p[2] - y), p[0]) for p in b)
            assert got[i][1] == pytest.approx(best[0], rel=1e-12, abs=1e-12) and (best[0] > 0 or got[i][0] == best[1])


def test_points_in_polygons_equal_ray_casting(spark):
    rng = random.Random(10)
    edges, polys = [], {}
    for k in range(12):
        cx, cy, n = rng.uniform(-30, 30), rng.uniform(-30, 30), rng.randrange(3, 40)
        ring = [(cx + rng.uniform(2, 15) * math.cos(2 * math.pi * i / n), cy + rng.uniform(2, 15) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        polys[k] = list(zip(ring, ring[1:] + ring[:1]))
        edges += [(k, *p, *q) for p, q in polys[k]]
    edges.append((99, 1.0, 2.0, 5.0, 2.0))  # flat
    points = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(800)] + [(900, None, 1.0)]
    want = {(i, k) for i, x, y in points[:-1] for k, es in polys.items() if sum(((a[1] <= y) != (b[1] <= y)) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in es) % 2}
    df = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(edges, "poly long, x0 double, y0 double, x1 double, y1 double")
    for cell in (3.0, 8.0, 500.0):
        assert {(r["id"], r["poly"]) for r in J.polygon_hits(*df, cell).collect()} == want


def test_large_covers_meet_points_in_a_join(spark, monkeypatch):
    monkeypatch.setattr(cover, "SMALL_COVER", 0)
    edges = [(k, *e) for k in range(3) for e in ((k, 0.0, k + 10.0, 0.0), (k + 10.0, 0.0, k + 10.0, 10.0), (k + 10.0, 10.0, k, 10.0), (k, 10.0, k, 0.0))]
    points = [(i, i % 20 - 3 + 0.5, i // 20 - 2 + 0.25) for i in range(300)]
    frames = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame([(k, *map(float, e)) for k, *e in edges], "poly long, x0 double, y0 double, x1 double, y1 double")
    assert {(r["id"], r["poly"]) for r in J.polygon_hits(*frames).collect()} == {(i, k) for i, x, y in points for k in range(3) if k < x < k + 10 and 0 < y < 10}


def test_covers_follow_the_size_of_polygons(spark):
    """In degrees, in metres and of all sizes at once: equal answers, small covers."""
    rng = random.Random(13)
    shapes = {}
    for k in range(9):
        size, n = 10.0 ** (k - 4), (4, 7, 60)[k % 3]
        cx, cy = rng.uniform(-60, 60), rng.uniform(-60, 60)
        shapes[k] = [(cx + size * (0.3 + rng.random()) * math.cos(2 * math.pi * i / n), cy + size * (0.3 + rng.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    shapes[20] = [(0.0, 0.0), (64.0, 0.0), (64.0, 64.0), (0.0, 64.0)]  # along the borders of cells
    points = []
    for k, ring in shapes.items():
        x, y, reach = ring[0][0], ring[0][1], max(abs(p[0] - ring[0][0]) for p in ring) or 1.0
        points += [(1000 * k + i, x + rng.uniform(-2, 2) * reach, y + rng.uniform(-2, 2) * reach) for i in range(60)]
    points += [(90_000 + i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (64, 64), (32, 0), (0, 32), (64, 32), (32, 64), (16, 16)])]
    for scale in (1.0, 111_320.0, 1e-3):
        edges = [(k, *(c * scale for c in (*p, *q))) for k, ring in shapes.items() for p, q in zip(ring, ring[1:] + ring[:1])]
        own = [(i, x * scale, y * scale) for i, x, y in points]
        frames = spark.createDataFrame(own, "id long, x double, y double"), spark.createDataFrame(edges, "poly long, x0 double, y0 double, x1 double, y1 double")
        want = {(i, k) for i, x, y in own for k in shapes if sum(((e[2] <= y) != (e[4] <= y)) and x < e[1] + (y - e[2]) * (e[3] - e[1]) / (e[4] - e[2]) for e in edges if e[0] == k) % 2}
        assert {(r["id"], r["poly"]) for r in J.polygon_hits(*frames).collect()} == want
        sizes = cover.covers(frames[1]).groupBy("poly").agg(F.count("*").alias("n"), F.count_if("inner").alias("inner")).collect()
        assert len(sizes) == len(shapes) and max(r["n"] for r in sizes) <= 18 * 18
        assert sum(r["inner"] for r in sizes) > 0


def test_components_over_blocks(spark, monkeypatch):
    """Paths, stars and cycles cut into many blocks."""
    monkeypatch.setattr(components, "BLOCK_EDGES", 40)
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(5000, 5000)]
    edges += [(3000 + rng.randrange(200), 3000 + rng.randrange(200)) for _ in range(150)]
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    for n in (40, 1 << 20):
        monkeypatch.setattr(components, "BLOCK_EDGES", n)
        got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
        assert got.keys() == root.keys()
        assert all((got[a] == got[b]) == (find(a) == find(b)) for a in list(root)[::7] for b in list(root)[::11])
        assert all(got[c] == c for c in set(got.values()))
    assert components.connected_components(df.limit(0)).collect() == []


def test_change_clusters_leave_out_equal_years(spark):
    rows = [(c, y, [float(c % 3 == k) + (0.5 if y and c % 3 == (k + 1) % 3 else 0.0) for k in range(3)]) for c in range(30) for y in (0, 1)]
    rows += [(100, 0, [1.0, 2.0, 3.0]), (100, 1, [2.0, 4.0, 6.0]), (101, 0, [1.0, 0.0, 0.0]), (102, 0, [0.0, 0.0, 0.0]), (102, 1, [1.0, 0.0, 0.0])]
    d = C.edge_differences(spark.createDataFrame(rows, "cell long, year int, vec array<double>"), 0, 1)
    got = {r["cell"]: r["cluster"] for r in C.change_clusters(d, "diff", k=3).collect()}
    assert {got[c] for c in (100, 101, 102)} == {-1}
    assert all((got[a] == got[b]) == (a % 3 == b % 3) for a in range(30) for b in range(30)) and {got[c] for c in range(30)} == {0, 1, 2}
    assert {r["cluster"] for r in C.change_clusters(d.where("cell >= 100"), "diff", k=3).collect()} == {-1}


def test_tracks_follow_the_nearest_free_centroid(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    rows = [(day(1), 1, 0.0, 0.0), (day(1), 2, 3.0, 0.0), (day(2), 5, 1.0, 0.0), (day(3), 9, 2.0, 1.0), (day(3), 8, 90.0, 0.0), (day(5), 9, 2.0, 1.0)]
    out = tracks(spark.createDataFrame(rows, "ts timestamp, blob long, cx double, cy double"), "1 DAY", 10.0).collect()
    assert {(r["ts"].day, r["blob"]): (r["born"].day, r["first"], r["days"]) for r in out} == {(1, 1): (1, 1, 3), (2, 5): (1, 1, 3), (3, 9): (1, 1, 3), (1, 2): (1, 2, 1), (3, 8): (3, 8, 1), (5, 9): (5, 9, 1)}


def test_links_equal_sequential_greedy_matching(spark):
    """Random blobs and a chain in which each blob prefers one that is taken."""
    rng = random.Random(16)
    day = lambda d: datetime.datetime(2024, 1, d)
    rows = [(day(d), k, rng.uniform(0, 60), rng.uniform(0, 60)) for d in range(1, 5) for k in rng.sample(range(90), 40)]
    rows += [(day(10), k, 1000.0 + 2 * k * (k + 1), 0.0) for k in range(8)] + [(day(11), k, 1000.0 + 2 * k * (k + 1) + 2.0 * k + 1.5, 0.0) for k in range(8)]
    nodes = [(n, *r) for n, r in enumerate(rows)]
    got = sorted(map(tuple, links(spark.createDataFrame(nodes, "node long, ts timestamp, blob long, cx double, cy double"), "1 DAY", 20.0).collect()))
    want = []
    for d in range(1, 12):
        here, there = ([n for n in nodes if n[1] == day(x)] for x in (d, d + 1))
        pairs = sorted((math.hypot(b[3] - a[3], b[4] - a[4]), a[2], b[2], a[0], b[0]) for a in here for b in there)
        used = set()
        for dist, _, _, a, b in pairs:
            if dist <= 20.0 and a not in used and b not in used:
                used |= {a, b}
                want.append((a, b))
    assert got == sorted(want)


def test_shape_test_of_rivers(spark):
    turned = [(3 * k, 4 * k) for k in range(300)]  # a line of 1,500 steps across the axes
    blobs = {
        "row": [(x, 0) for x in range(300)], "short": [(x, 0) for x in range(30)], "dome": [(x, y) for x in range(60) for y in range(60)],
        "band": [(x, y) for x in range(201) for y in range(100)], "border": [(x, y) for x in range(200) for y in range(100)], "turned": turned, "one": [(5, 5)],
    }
    rows = [(k, float(x), float(y)) for k, cells in blobs.items() for x, y in cells]
    got = {r["blob"]: r for r in B.shapes(spark.createDataFrame(rows, "blob string, x double, y double"), ["blob"], 100.0, 1000.0).collect()}
    for k, (length, width) in {"row": (3000, 10), "short": (300, 10), "dome": (600, 600), "band": (2010, 1000), "border": (2000, 1000), "one": (10, 10)}.items():
        assert (got[k]["length_km"], got[k]["width_km"]) == pytest.approx((length, width))
    assert got["turned"]["length_km"] == pytest.approx(15000, rel=1e-4) and got["turned"]["width_km"] == pytest.approx(10)
    assert {k for k, r in got.items() if r["is_ar"]} == {"row", "band", "turned"}
    assert got["row"]["elongation"] is None and got["band"]["elongation"] == pytest.approx(2.01, rel=1e-3)


def test_a_local_folder_needs_a_local_master(spark, monkeypatch):
    class Context:
        master = "spark://elsewhere:7077"

        def getCheckpointDir(self):
            return self.dir

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    Context.dir = None
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        runtime.shared_dir(Session())
    Context.dir = "hdfs://x/y/"
    assert runtime.shared_dir(Session()) == "hdfs://x/y"


def test_intermediates_can_be_deleted(spark):
    kept = runtime.staged(spark.range(3), "kept")
    path = spark._gridcells_staged[-1].removeprefix("file://")
    assert kept.count() == 3 and os.path.isdir(path)
    runtime.clean(spark)
    assert not os.path.exists(path) and spark._gridcells_staged == []


def test_verdicts_over_a_level_of_equal_vectors_equal_the_sql(spark, tmp_path):
    """Nearly all steps are those of equal vectors: what is over their level is decided by
    the last bits of the same arithmetic as in SQL."""
    rng = random.Random(8)
    vectors = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(60)]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(60 * b + k, v, b) for b, v in enumerate(vectors) for k in range(60)], "vec_id long, embedding array<float>, label int").write.parquet(path)
    got = {r["cell"]: (r["moved"], r["verdict"]) for r in registry.queries()["c04_c06_c08_verdict"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
    cur = con.execute(registry.oracle_sql()["c04_c06_c08_verdict"])
    at = [d[0] for d in cur.description]
    assert got == {r[at.index("cell")]: (r[at.index("moved")], r[at.index("verdict")]) for r in cur.fetchall()}


def test_verdicts_without_a_displacement_or_a_level_equal_the_sql(spark, tmp_path):
    """The last cell has one vector and no displacement, and may be of either label; of few
    stable cells there is no level."""
    rng = random.Random(9)
    for n in (301, 306, 41):
        path = str(tmp_path / str(n) / "embeddings.parquet")
        spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(8)], 0) for k in range(n)], "vec_id long, embedding array<float>, label int").write.parquet(path)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
        cur = con.execute(registry.oracle_sql()["c04_c06_c08_verdict"])
        cols = [d[0] for d in cur.description]
        got = registry.queries()["c04_c06_c08_verdict"](spark, str(tmp_path / str(n))).select(*cols).collect()
        want = {r[0]: r for r in cur.fetchall()}
        assert {r["cell"]: tuple(r) for r in got} == want and cols[0] == "cell"
        assert want[n // 5][cols.index("disp")] is None


def test_nearest_shuffles_groups_of_rows(spark, monkeypatch):
    """On the way down a group of rows is one row; an id that comes twice has two rows."""
    from gridcells.operators import nearest as N

    written = []
    keep = N.staged
    monkeypatch.setattr(N, "staged", lambda df, name: written.append(keep(df, name)) or written[-1])
    grid = lambda d: spark.range(10_000).selectExpr("id", f"id % 100 * 3000D + {d} AS x", f"id div 100 * 3000D - {d} AS y")
    got = N.nearest(grid(0), grid(500)).agg(F.count("*"), F.sum((F.col("id") == F.col("b_id")).cast("int")), F.max("dist")).first()
    assert tuple(got) == (10_000, 10_000, pytest.approx(math.hypot(500, 500)))
    # both tables, each once more along its curve, and a few groups and boxes
    assert sum(df.count() for df in written) < 45_000
    twice = spark.createDataFrame([(1, 0.0, 0.0), (1, 9.0, 0.0), (2, 4.0, 0.0)], "id long, x double, y double")
    far = spark.createDataFrame([(7, 0.0, 1.0), (8, 8.0, 0.0), (6, 0.0, 1.0)], "id long, x double, y double")
    assert sorted(tuple(r) for r in N.nearest(twice, far).collect()) == [(1, 6, 1.0), (1, 8, 1.0), (2, 8, 4.0)]


def test_rings_of_small_and_large_blobs_agree(spark, monkeypatch):
    """Blobs of few sides are traced in a task, without components or ranks."""
    rng = random.Random(22)
    cells = B.blobs(grid(spark, [(i, j) for i in range(24) for j in range(24) if rng.random() < 0.7]))
    boundary = B.blob_boundary(cells)
    found = []
    for limit in (1 << 16, 30, 0):
        monkeypatch.setattr(B, "RING_SIDES", limit)
        if limit > 30:
            with monkeypatch.context() as m:
                m.setattr(B, "connected_components", None)
                m.setattr(B, "ranked", None)
                found.append([sorted(tuple(r) for r in f(boundary).select(*c).collect()) for f, c in ((B.outline_rings, B._RING), (B.ordered_rings, [*B._RING, "place", "n"]))])
        else:
            found.append([sorted(tuple(r) for r in f(boundary).select(*c).collect()) for f, c in ((B.outline_rings, B._RING), (B.ordered_rings, [*B._RING, "place", "n"]))])
    assert found[0] == found[1] == found[2] and len(found[0][0]) == boundary.count()


def test_blobs_over_tiles_equal_a_walk(spark, monkeypatch):
    """Blobs over many tiles, with classes of which one is null; what is left for joins are
    the parts that tiles' borders connect."""
    from gridcells.operators import tiles

    seen = []
    keep = B.connected_components
    monkeypatch.setattr(B, "connected_components", lambda edges: seen.append(edges.count()) or keep(edges))
    rng = random.Random(21)
    rows = {(i, j): rng.choice([1, 1, 1, 1, 2, None]) for i in range(-20, 20) for j in range(-20, 20) if rng.random() < 0.8}
    cells = spark.createDataFrame([(*k, c) for k, c in rows.items()], "i int, j int, cls int").select(H.pack(10, "i", "j").alias("cell"), "i", "j", "cls")
    number = {(r["i"], r["j"]): r["cell"] for r in cells.collect()}
    parent = {k: k for k in rows}
    for i, j in rows:
        for a, b in H.NEIGHBOURS:
            if rows[i, j] is not None and rows.get((i + a, j + b)) == rows[i, j]:
                parent[find(parent, (i, j))] = find(parent, (i + a, j + b))
    least = {}
    for k in rows:
        root = find(parent, k)
        least[root] = min(least.get(root, number[k]), number[k])
    want = {number[k]: least[find(parent, k)] for k in rows}
    for side in (4, 64):
        monkeypatch.setattr(tiles, "TILE", side)
        assert {r["cell"]: r["blob"] for r in B.blobs(cells, "cls").collect()} == want
        assert {r["cell"]: r["blob"] for r in B.keyed_blobs(cells.unionByName(cells), ["cls"]).collect()} == want
    assert max(seen[2:]) < 100  # with four tiles; the cells have some 1,500 neighbour pairs


def test_smoothing_over_tiles_equals_brute_force(spark, monkeypatch):
    """Absent neighbours, null values, and a plan with one exchange for all rounds."""
    from gridcells.operators import tiles

    rng = random.Random(23)
    rows = {(i, j): rng.choice([None, rng.randrange(50)]) if rng.random() < 0.2 else rng.randrange(50) for i in range(-9, 14) for j in range(-9, 14) if rng.random() < 0.8}
    cells = spark.createDataFrame([(*k, v) for k, v in rows.items()], "i int, j int, v long").select(H.pack(10, "i", "j").alias("cell"), "i", "j", "v")
    number = {(r["i"], r["j"]): r["cell"] for r in cells.collect()}
    want = dict(rows)
    for _ in range(3):
        near = {k: [want[n] for n in [k] + [(k[0] + a, k[1] + b) if (k[0] + a, k[1] + b) in rows else k for a, b in H.NEIGHBOURS] if want[n] is not None] for k in rows}
        want = {k: sum(v) / len(v) if v else None for k, v in near.items()}
    for side in (4, 64):
        monkeypatch.setattr(tiles, "TILE", side)
        monkeypatch.setattr(B, "TILE", side)
        out = B.smooth(cells, "v", 3, "g")
        got = {r["cell"]: (r["v"], r["g"]) for r in out.collect()}
        assert got == {number[k]: (rows[k], None if want[k] is None else pytest.approx(want[k])) for k in rows}
    assert len(out.select("g")._jdf.queryExecution().optimizedPlan().toString().split("Repartition")) == 2


def test_agreement_reads_its_grids_once_and_nearest_writes_groups_once(spark, monkeypatch):
    """Levels of few boxes are looked up without a shuffle; the report meets written grids."""
    from gridcells.operators import nearest as N
    from gridcells.plans import join_queries as Q

    names, plans = [], []
    keep = N.staged
    monkeypatch.setattr(N, "staged", lambda df, name: names.append(name) or keep(df, name))
    monkeypatch.setattr(Q, "staged", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name))
    assert {r["how"] for r in registry.queries()["j04_agreement"](spark, "/root/testdata/sf0.001").collect()} == {0, 1}
    assert names.count("groups") == 0
    assert "l_partkey" not in plans[-1]
    # 32,000 points have 2,000 leaves, and those 125 nodes
    names.clear()
    grid = lambda d: spark.range(32_000).selectExpr("id", f"id % 200 * 3000D + {d} AS x", f"id div 200 * 3000D - {d} AS y")
    got = N.nearest(grid(0), grid(500)).agg(F.count("*"), F.sum((F.col("id") == F.col("b_id")).cast("int"))).first()
    assert tuple(got) == (32_000, 32_000) and names.count("groups") == 1


def test_only_rows_without_a_match_look_around(spark):
    """A cell's own rows come before nearer ones of the ring, for ids that come twice too."""
    cell = lambda i, j: (10 << 2 * H.BITS) | (i + H.OFFSET) << H.BITS | (j + H.OFFSET)
    frame = lambda rows: spark.createDataFrame(rows, "id long, cell long, x double, y double")
    a = frame([(1, cell(0, 0), 0.0, 0.0), (2, cell(5, 5), 0.0, 0.0), (2, cell(9, 9), 0.0, 0.0), (3, cell(7, 7), 0.0, 0.0), (4, None, 0.0, 0.0)])
    b = frame([(11, cell(0, 0), 9.0, 0.0), (10, cell(0, 0), 9.0, 0.0), (12, cell(0, 1), 1.0, 0.0), (13, cell(5, 6), 1.0, 0.0), (14, cell(9, 9), 8.0, 0.0), (15, cell(8, 8), 3.0, 4.0), (16, None, 0.0, 0.0)])
    got = sorted(tuple(r) for r in J.match_grids(a, b).collect())
    assert got == [(1, 10, 0, 9.0), (2, 14, 0, 8.0), (2, 14, 0, 8.0), (3, 15, 1, 5.0), (4, None, 2, None)]
    assert str(J.match_grids(a, b)._jdf.queryExecution().optimizedPlan()).count("LeftAnti") == 1


def test_boundaries_over_tiles_shuffle_cells_not_sides(spark):
    """Cells of several blobs, over borders of tiles, twice or null, equal brute force."""
    rng = random.Random(14)
    pack = lambda i, j: (10 << 2 * H.BITS) | (i + H.OFFSET) << H.BITS | (j + H.OFFSET)
    at = [(b, i, j) for b in (1, 2, None) for i in range(-6, 7) for j in (*range(-6, 7), *range(58, 70)) if rng.random() < 0.6]
    rows = [(b, pack(i, j)) for b, i, j in [*at, at[0]]] + [(1, None)]
    there = {(b, i, j) for b, i, j in at if b is not None}
    want = [(b, pack(i, j), k) for b, i, j in [*at, at[0]] for k, (da, db) in enumerate(H.NEIGHBOURS) if (b, i + da, j + db) not in there]
    got = B.blob_boundary(spark.createDataFrame(rows, "blob long, cell long"))
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted([*want, *((1, None, k) for k in range(6))], key=order)
    # one shuffle of the cells, with those a step around each tile
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan
