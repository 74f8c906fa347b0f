"""Grid-shaped inputs derived from the test tables: each as a DataFrame function
and as DuckDB SQL. Keys and averaged values are integers, so both engines agree
to the last bit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcells.functions import cells as H
from gridcells.runtime import table

VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {}

RES = H.MAX_RES


def sql_pack(res: int, i: str, j: str) -> str:
    return f"(({res}::BIGINT << {2 * H.BITS}) | ((({i})::BIGINT + {H.OFFSET}) << {H.BITS}) | (({j})::BIGINT + {H.OFFSET}))"


def sql_parent(i: str, j: str, child_res: int) -> tuple[str, str]:
    return tuple(f"round((({a}) * ({i}) + ({b}) * ({j})) / 7.0)::BIGINT" for a, b in H._UP[child_res % 2])


PI1, PJ1 = sql_parent("i", "j", RES)
PI2, PJ2 = sql_parent("pi", "pj", RES - 1)
CELL_SQL, PARENT_SQL = sql_pack(RES, "i", "j"), sql_pack(RES - 1, PI1, PJ1)


def view(name: str, sql: str, uses: tuple[str, ...] = ()):
    def add(fn):
        VIEWS[name], VIEW_SQL[name] = fn, (uses, sql)
        return fn

    return add


def with_views(names: tuple[str, ...], body: str) -> str:
    """``body`` after the CTEs of the views it uses."""
    order: list[str] = []

    def visit(n: str) -> None:
        for u in VIEW_SQL[n][0]:
            visit(u)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = ", ".join(f"{n} AS ({VIEW_SQL[n][1]})" for n in order)
    body = body.strip()
    if not ctes:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.startswith("WITH ") else f"WITH {ctes} {body}"


def get(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name](spark, sf_dir)


def parent_of(i: str = "i", j: str = "j", levels: int = 1):
    return H.ancestor(F.col(i), F.col(j), RES, RES - levels)


@view("px", f"""SELECT l_orderkey AS id, l_linenumber AS ln, l_partkey % 200 AS i, l_suppkey + 100 * ((l_partkey // 200) % 2) AS j,
 1 + CAST(l_quantity AS INT) % 16 AS cls, round(l_extendedprice * 100)::BIGINT AS v, round(l_discount * 100)::BIGINT AS d, year(l_shipdate)::INT AS yr,
 l_returnflag <> 'R' AS ok, {sql_pack(RES, "l_partkey % 200", "l_suppkey + 100 * ((l_partkey // 200) % 2)")} AS cell FROM lineitem""")
def px(spark, d):
    i, j = F.col("l_partkey") % 200, F.col("l_suppkey") + 100 * F.expr("(l_partkey div 200) % 2")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), i.alias("i"), j.alias("j"),
        (1 + F.col("l_quantity").cast("int") % 16).alias("cls"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("v"),
        F.round(F.col("l_discount") * 100).cast("long").alias("d"), F.year("l_shipdate").alias("yr"),
        (F.col("l_returnflag") != "R").alias("ok"), H.pack(RES, i, j).alias("cell"),
    )


@view("px_geo", "SELECT l_orderkey AS id, l_linenumber AS ln, -125 + 58.0::DOUBLE * (l_partkey % 2000) / 2000 AS lon, 25 + 24.0::DOUBLE * (l_suppkey % 100) / 100 AS lat, 1 + CAST(l_quantity AS INT) % 16 AS cls FROM lineitem")
def px_geo(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), (-125 + F.lit(58.0) * (F.col("l_partkey") % 2000) / 2000).alias("lon"),
        (25 + F.lit(24.0) * (F.col("l_suppkey") % 100) / 100).alias("lat"), (1 + F.col("l_quantity").cast("int") % 16).alias("cls"),
    )


def _grid(parity: int):
    sql = f"SELECT DISTINCT cell AS id, cell, i, j, 3000.0::DOUBLE * i + {500 * parity} AS x, 3000.0::DOUBLE * j - {700 * parity} AS y FROM px WHERE id % 2 = {parity}"

    def fn(spark, d):
        p = px(spark, d).where(F.col("id") % 2 == parity)
        return p.select(F.col("cell").alias("id"), "cell", "i", "j", (F.lit(3000.0) * F.col("i") + 500 * parity).alias("x"), (F.lit(3000.0) * F.col("j") - 700 * parity).alias("y")).distinct()

    return sql, fn


for _name, _parity in (("grid_a", 0), ("grid_b", 1)):
    view(_name, _grid(_parity)[0], ("px",))(_grid(_parity)[1])


@view("pixels", "SELECT i, j, i // 10 AS by_, j // 10 AS bx, sum(v)::BIGINT AS v FROM px GROUP BY i, j", ("px",))
def pixels(spark, d):
    return px(spark, d).groupBy("i", "j").agg(F.sum("v").alias("v")).withColumns({"by_": F.expr("i div 10"), "bx": F.expr("j div 10")})


@view("film", "SELECT user_id AS pixel, date_trunc('hour', ts) AS ts, (sum(round(value * 100)::BIGINT) // count(*))::DOUBLE AS value FROM events GROUP BY ALL")
def film(spark, d):
    e = table(spark, d, "events")
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return e.groupBy(F.col("user_id").alias("pixel"), F.date_trunc("hour", "ts").alias("ts")).agg(F.floor(cents / F.count("*")).cast("double").alias("value"))


@view("weather", """SELECT pixel, ts, value, 15 + value % 30 AS t, (value * 7) % 101 AS rh, value % 11 - 5 AS u, value % 13 - 6 AS w, value % 5 AS rain FROM film""", ("film",))
def weather(spark, d):
    v = F.col("value")
    return film(spark, d).select("pixel", "ts", "value", (15 + v % 30).alias("t"), ((v * 7) % 101).alias("rh"), (v % 11 - 5).alias("u"), (v % 13 - 6).alias("w"), (v % 5).alias("rain"))


@view("radar", """SELECT user_id // 4 AS parent, user_id AS child, 1 + user_id % 3 AS w, date_trunc('day', ts) AS ts,
 CASE WHEN max(event_id) % 9 = 0 THEN NULL ELSE (sum(round(value * 100)::BIGINT) // count(*) % 100)::DOUBLE END AS value
 FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL""")
def radar(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("view", "click"))
    cents = F.floor(F.sum(F.round(F.col("value") * 100).cast("long")) / F.count("*"))
    return e.groupBy(F.expr("user_id div 4").alias("parent"), F.col("user_id").alias("child"), (1 + F.col("user_id") % 3).alias("w"), F.date_trunc("day", "ts").alias("ts")).agg(
        F.when(F.max("event_id") % 9 != 0, (cents % 100).cast("double")).alias("value")
    )


@view("model", """SELECT user_id // 4 AS parent, date_trunc('day', ts) AS ts, max(round(value * 100)::BIGINT % 100)::DOUBLE AS plane
 FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY ALL""")
def model(spark, d):
    e = table(spark, d, "events").where(~F.col("event_type").isin("view", "click"))
    return e.groupBy(F.expr("user_id div 4").alias("parent"), F.date_trunc("day", "ts").alias("ts")).agg(F.max(F.round(F.col("value") * 100).cast("long") % 100).cast("double").alias("plane"))


@view("members", """SELECT cell, i, j, arg_max(cls, n * 100 - cls) AS cls, sum(n)::BIGINT AS npx FROM (SELECT cell, i, j, cls, count(*) AS n FROM px GROUP BY ALL) x GROUP BY cell, i, j HAVING sum(n) >= 2""", ("px",))
def members(spark, d):
    n = px(spark, d).groupBy("cell", "i", "j", "cls").agg(F.count("*").alias("n"))
    return n.groupBy("cell", "i", "j").agg(F.max_by("cls", F.col("n") * 100 - F.col("cls")).alias("cls"), F.sum("n").alias("npx")).where("npx >= 2")


@view("annual", "SELECT (i // 10) * 100 + j // 10 AS cell, yr AS year, avg(v) AS value, (max(d) - min(d))::DOUBLE AS unc FROM px GROUP BY ALL", ("px",))
def annual(spark, d):
    return px(spark, d).groupBy((F.expr("i div 10") * 100 + F.expr("j div 10")).alias("cell"), F.col("yr").alias("year")).agg(F.avg("v").alias("value"), (F.max("d") - F.min("d")).cast("double").alias("unc"))


@view("dates", "SELECT (i // 10) * 100 + j // 10 AS cell, (id + ln) % 21 AS idx FROM px", ("px",))
def dates(spark, d):
    return px(spark, d).select((F.expr("i div 10") * 100 + F.expr("j div 10")).alias("cell"), ((F.col("id") + F.col("ln")) % 21).alias("idx"))


@view("emb", "SELECT vec_id // 5 AS cell, (2017 + vec_id % 5)::INT AS year, CASE WHEN vec_id % 17 <> 0 THEN embedding END AS vec, label FROM embeddings")
def emb(spark, d):
    """Some vectors are null, for years that are missing."""
    e = table(spark, d, "embeddings")
    return e.select(F.expr("vec_id div 5").alias("cell"), (2017 + F.col("vec_id") % 5).cast("int").alias("year"), F.when(F.col("vec_id") % 17 != 0, F.col("embedding")).alias("vec"), "label")


@view("records", "SELECT o_orderkey AS h10, o_custkey AS parent, o_orderstatus AS status, o_orderdate AS dt, o_orderpriority AS activity FROM orders")
def records(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("h10"), F.col("o_custkey").alias("parent"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("dt"), F.col("o_orderpriority").alias("activity"))


@view("zones", """SELECT k AS poly, seq, x0, y0, x1, y1 FROM (SELECT n_nationkey AS k, (n_nationkey % 5) * 40.0 + 0.5 AS w, (n_nationkey // 5) * 40.0 + 0.5 AS s FROM nation) z,
 LATERAL (SELECT unnest([0, 1, 2, 3]) AS seq, unnest([w, w + 40, CASE WHEN k % 3 = 0 THEN w + 20 ELSE w + 40 END, w]) AS x0, unnest([s, s, s + 40, CASE WHEN k % 3 = 0 THEN s ELSE s + 40 END]) AS y0,
 unnest([w + 40, CASE WHEN k % 3 = 0 THEN w + 20 ELSE w + 40 END, w, w]) AS x1, unnest([s, s + 40, CASE WHEN k % 3 = 0 THEN s ELSE s + 40 END, s]) AS y1) e""")
def zones(spark, d):
    """25 boxes or triangles of side 40; a triangle has an edge of length 0."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("poly"), ((F.col("n_nationkey") % 5) * 40.0 + 0.5).alias("w"), (F.expr("n_nationkey div 5") * 40.0 + 0.5).alias("s"))
    tri = F.col("poly") % 3 == 0
    top = (F.when(tri, F.col("w") + 20).otherwise(F.col("w") + 40), F.col("s") + 40)
    last = (F.col("w"), F.when(tri, F.col("s")).otherwise(F.col("s") + 40))
    ring = [(F.col("w"), F.col("s")), (F.col("w") + 40, F.col("s")), top, last, (F.col("w"), F.col("s"))]
    edges = F.array(*[F.struct(F.lit(k).alias("seq"), ring[k][0].alias("x0"), ring[k][1].alias("y0"), ring[k + 1][0].alias("x1"), ring[k + 1][1].alias("y1")) for k in range(4)])
    return n.select("poly", F.explode(edges).alias("e")).select("poly", "e.*")


@view("items", """SELECT 'it' || (s_suppkey // 10)::VARCHAR || '_' || (2022 + s_suppkey % 4)::VARCHAR AS item_id, 'p' || (s_suppkey // 10)::VARCHAR AS place, (2022 + s_suppkey % 4)::INT AS year,
 ['A', 'B', 'C'][1 + s_suppkey % 3] AS collection, (s_suppkey // 10 % 20 * 3)::DOUBLE AS west, (s_suppkey // 10 % 20 * 3 + 5)::DOUBLE AS east, (s_suppkey // 10 // 20 * 2)::DOUBLE AS south, (s_suppkey // 10 // 20 * 2 + 3)::DOUBLE AS north FROM supplier""")
def items(spark, d):
    s = table(spark, d, "supplier").withColumns({"p": F.expr("s_suppkey div 10"), "year": (2022 + F.col("s_suppkey") % 4).cast("int")})
    west, south = (F.col("p") % 20 * 3).cast("double"), (F.expr("p div 20") * 2).cast("double")
    return s.select(
        F.concat(F.lit("it"), F.col("p").cast("string"), F.lit("_"), F.col("year").cast("string")).alias("item_id"), F.concat(F.lit("p"), F.col("p").cast("string")).alias("place"), "year",
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (1 + F.col("s_suppkey") % 3).cast("int")).alias("collection"), west.alias("west"), (west + 5).alias("east"), south.alias("south"), (south + 3).alias("north"),
    )


@view("stats_in", "SELECT (i // 10) * 100 + j // 10 AS cell, avg(v) AS x, avg(d) AS y, count(*) AS z, min(j) AS j FROM px GROUP BY 1", ("px",))
def stats_in(spark, d):
    return px(spark, d).groupBy((F.expr("i div 10") * 100 + F.expr("j div 10")).alias("cell")).agg(F.avg("v").alias("x"), F.avg("d").alias("y"), F.count("*").alias("z"), F.min("j").alias("j"))
