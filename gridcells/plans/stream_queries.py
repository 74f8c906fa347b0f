"""Queries of the streaming family (R2 to R5), run over all that is there."""

from pyspark.sql import functions as F

from gridcells.operators import change as C
from gridcells.plans.book import Book
from gridcells.plans.views import get
from gridcells.runtime import scratch, staged, table
from gridcells.streaming import stream as R

BOOK = Book()
q = BOOK.add


@q("r02_r03_hourly_stream", ("*",), """WITH e AS (SELECT user_id AS pixel, date_trunc('hour', ts) AS ts, round(value * 100)::BIGINT AS c FROM events), m AS (SELECT max(ts) - INTERVAL 2 HOURS AS t FROM events)
SELECT pixel, ts, sum(c)::BIGINT AS cents, count(*) AS n FROM e, m WHERE ts + INTERVAL 1 HOUR <= t GROUP BY pixel, ts""")
def r02(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stream = R.read_stream(spark, f"{sf_dir}/events.parquet*", events.schema)
    return R.run_to_table(R.hourly_fold(stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("pixel"), F.round(F.col("value") * 100).cast("long").alias("cents"))), "hourly")


@q("r04_accumulator_stream", ("*",), None)
def r04(spark, sf_dir):
    """A feed of eight days a batch; each run of the stream takes up the state of the
    one before."""
    weather = get(spark, sf_dir, "weather")
    film = weather.select("pixel", "ts", (C.excess(F.col("value"), 20_000.0, F.col("w"), 0.1) / 1000).alias("x"), C.rain_flush(F.col("rain"), 0.5).alias("fl"))
    schema, film = film.schema, staged(film, "film")
    first, last = film.agg(F.min("ts"), F.max("ts")).first()
    feed, base = (scratch(spark, n) for n in ("feed", "load"))
    start = 1_704_067_200 // 3600  # 2024-01-01 00:00 UTC
    out = None
    for k in range(((last.date() - first.date()).days // 8 + 1) if first else 1):
        film.where(F.floor(F.datediff("ts", F.lit(first)) / 8) == k).write.mode("append").parquet(feed)
        stream = R.read_stream(spark, feed, schema)
        out = R.run_to_table(R.accumulate(stream, 24.0, start), "load", base=base)
    return out.withColumn("load", F.round("load", 5))


@q("r03_provisional_hours", ("*",), """WITH e AS (SELECT user_id AS pixel, date_trunc('hour', ts) AS ts, round(value * 100)::BIGINT AS c FROM events), m AS (SELECT max(ts) - INTERVAL 2 HOURS AS t FROM events)
SELECT pixel, ts, sum(c)::BIGINT AS cents, count(*) AS n, ts + INTERVAL 1 HOUR > any_value(m.t) AS provisional FROM e, m GROUP BY pixel, ts""")
def r03(spark, sf_dir):
    """Rows arrive in files of some nine days, every other row of a file's last hour with
    the next one: hours are shown as they stand, and set right later."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("pixel"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    feed, base = scratch(spark, "events"), scratch(spark, "hours")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    hour = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit(first))) / 3600) + F.col("event_id") % 2
    rows = events.withColumn("file", F.floor(hour / (9 * 24))).drop("event_id")
    for k in range(((last - first).days // 9 + 2) if first else 1):
        rows.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(feed)
        R.upsert_hours(R.read_stream(spark, feed, rows.drop("file").schema), base)
    return R.hours_so_far(spark, base)


@q("r05_match_stream", ("*",), "SELECT m.parent, m.ts, m.plane, r.child, r.value FROM model m JOIN radar r ON m.parent = r.parent AND m.ts = r.ts")
def r05(spark, sf_dir):
    paths = {}
    for name in ("model", "radar"):
        paths[name] = scratch(spark, name)
        get(spark, sf_dir, name).write.parquet(paths[name])
    model, radar = (R.read_stream(spark, paths[n], get(spark, sf_dir, n).schema) for n in ("model", "radar"))
    return R.run_to_table(R.match(model, radar), "match")


from gridcells.plans.change_queries import ACCUMULATOR_SQL  # noqa: E402
from gridcells.plans.views import with_views  # noqa: E402

BOOK.sql["r04_accumulator_stream"] = with_views(("weather",), ACCUMULATOR_SQL)
BOOK.sql["r05_match_stream"] = with_views(("model", "radar"), BOOK.sql["r05_match_stream"])
