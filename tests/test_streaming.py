"""Streams give what the batch operators give on the same rows."""

import datetime
import os
import subprocess
import sys
from pathlib import Path

from gridcells import runtime
from gridcells.plans import registry
from gridcells.streaming import stream as R

SAMPLE = "/root/testdata/sf0.001"


def test_stateful_accumulator_equals_batch(spark):
    q = registry.queries()
    batch = {(r["pixel"], r["ts"]): r["load"] for r in q["w03_accumulator"](spark, SAMPLE).collect()}
    stream = {(r["pixel"], r["ts"]): r["load"] for r in q["r04_accumulator_stream"](spark, SAMPLE).collect()}
    assert batch.keys() == stream.keys()
    assert max(abs(batch[k] - stream[k]) for k in batch) < 2e-5


ELSEWHERE = """
import datetime, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from gridcells.streaming import stream as R

spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
schema = "pixel long, ts timestamp, x double, fl double"
spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, 1), 8.0, 1.0)], schema).write.parquet(sys.argv[2] + "/feed")
out = R.run_to_table(R.accumulate(R.read_stream(spark, sys.argv[2] + "/feed", schema), 1.0, 0), "load")
print("loads", [r["load"] for r in out.collect()])
"""


def test_a_session_started_elsewhere_finds_the_package(tmp_path):
    """Neither the working folder nor PYTHONPATH has the package; the workers that the
    driver starts to set up a stateful stream get it all the same."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = str(Path(R.__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", ELSEWHERE, root, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "loads [4.0]" in done.stdout, done.stderr[-3000:]


def test_late_rows_are_left_out(spark, tmp_path):
    """A row behind the hour that was handed on changes nothing, nor is it output."""
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    schema, out = "pixel long, ts timestamp, x double, fl double", None
    batches = [[(1, at(1), 8.0, 1.0), (1, at(3), 4.0, 1.0)], [(1, at(2), 1e6, 1.0), (1, at(4), 2.0, 1.0), (2, at(4), 2.0, 1.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "feed"))
        stream = R.read_stream(spark, str(tmp_path / "feed"), schema)
        start = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).timestamp()) // 3600
        out = R.run_to_table(R.accumulate(stream, 1.0, start, late="3 hours"), "late", base=str(tmp_path / "load"))
    got = {(r["pixel"], r["ts"].hour): r["load"] for r in out.collect()}
    a = 0.5 * 8
    b = a * 0.25 + 0.5 * 4
    assert got == {(1, 1): a, (1, 3): b, (1, 4): b * 0.5 + 1.0, (2, 4): 1.0}


def test_a_timer_drops_the_state_of_silent_pixels(spark, tmp_path):
    """A pixel that comes back after its timer begins anew; each batch is a run of its
    own, which takes up state and timers from the checkpoint."""
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    schema, start = "pixel long, ts timestamp, x double, fl double", int(datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).timestamp()) // 3600
    batches = [[(1, at(1), 8.0, 1.0), (2, at(1), 8.0, 1.0)], [(2, at(20), 0.0, 1.0)], [(2, at(30), 0.0, 1.0)], [(1, at(31), 0.0, 1.0), (2, at(31), 0.0, 1.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "feed"))
        stream = R.read_stream(spark, str(tmp_path / "feed"), schema)
        out = R.run_to_table(R.accumulate(stream, 1.0, start, late="1 hours", idle_half_lives=15), "timer", base=str(tmp_path / "load"))
    got = {(r["pixel"], int((r["ts"] - at(0)).total_seconds()) // 3600): r["load"] for r in out.collect()}
    assert got[1, 1] == 4.0 and got[2, 20] == 4.0 * 0.5**19
    assert got[1, 31] == 0.0  # 4 * 0.5 ** 30 if its state were there
    assert got[2, 31] == got[2, 30] * 0.5 > 0


def test_pixels_of_a_block_share_a_value(spark, tmp_path):
    """Two batches of 200 pixels, negative and missing ones too, give what each pixel's
    recurrence gives, with one value of state for each block."""
    pixels, a = [*range(-70, 130), None], 0.5
    schema, want = "pixel long, ts timestamp, x double, fl double", {}
    start = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).timestamp()) // 3600
    for batch in ((1, 2, 4), (5, 9)):
        rows = [(p, datetime.datetime(2024, 1, 1, h), float((p or 0) % 7 * h), 0.5 if h == 4 else 1.0) for p in pixels for h in batch]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "feed"))
        out = R.run_to_table(R.accumulate(R.read_stream(spark, str(tmp_path / "feed"), schema), 1.0, start), "block", base=str(tmp_path / "load"))
    for p in pixels:
        load, last = 0.0, 0
        for h in (1, 2, 4, 5, 9):
            load = (0.5 if h == 4 else 1.0) * (a ** (h - last) * load + (1 - a) * ((p or 0) % 7 * h))
            want[p, h], last = load, h
    got = {(r["pixel"], r["ts"].hour): r["load"] for r in out.collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    with R.state_store(spark):
        kept = spark.read.format("statestore").option("stateVarName", "loads").load(str(tmp_path / "load" / "state")).count()
    assert 0 < kept <= len(pixels) // R.BLOCK_PIXELS + 3


def test_state_is_kept_in_rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with R.state_store(spark):
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_provisional_hours_are_set_right(spark, tmp_path):
    """Open hours are seen and flagged, corrected by later rows, and closed; a batch run
    again changes nothing, also if it failed before its mark."""
    base = "file://" + str(tmp_path / "hours")
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    rows = lambda *r: spark.createDataFrame(list(r), "pixel long, ts timestamp, cents long")
    seen = lambda: {(r["pixel"], r["ts"].hour): (r["cents"], r["n"], r["provisional"]) for r in R.hours_so_far(spark, base).collect()}
    assert R.hours_so_far(spark, base).count() == 0
    first, second = rows((1, at(0), 5), (1, at(3), 7), (2, at(3, 30), 1)), rows((1, at(3, 59), 2), (2, at(2), 4), (1, at(0, 5), 1000), (2, at(6), 9))
    R.put_hours(first, 0, base)
    want = {(1, 0): (5, 1, False), (1, 3): (7, 1, True), (2, 3): (1, 1, True)}
    assert seen() == want
    R.put_hours(first, 0, base)
    assert seen() == want
    for _ in range(2):
        R.put_hours(second, 1, base)
        # hour 0 was closed: the late row is left out and counted
        assert seen() == {(1, 0): (5, 1, False), (1, 3): (9, 2, False), (2, 3): (1, 1, False), (2, 2): (4, 1, False), (2, 6): (9, 1, True)}
    marks = {r["batch"]: r["late"] for r in spark.read.parquet(f"{base}/marks").collect()}
    assert marks == {0: 0, 1: 1}
    # a batch that failed after its hours were written, before its mark, does not count
    R.put_hours(rows((2, at(6), 1)), 2, base)
    runtime.delete(spark, f"{base}/marks/batch=2")
    assert seen()[2, 6] == (9, 1, True)
    R.put_hours(rows((2, at(6), 1)), 2, base)
    assert seen()[2, 6] == (10, 2, True)
    R.put_hours(rows((1, at(1), 1)).limit(0), 3, base)
    assert seen()[2, 6] == (10, 2, True)


def test_batches_read_as_much_however_many_there_were(spark, tmp_path):
    """Marks and open hours of two batches are kept, late rows are counted over all."""
    base = "file://" + str(tmp_path / "hours")
    for k in range(6):
        ts = [datetime.datetime(2024, 1, 1, 4 * k), datetime.datetime(2024, 1, 1)]
        R.put_hours(spark.createDataFrame([(1, t, 1) for t in ts], "pixel long, ts timestamp, cents long"), k, base)
    for part in ("marks", "open"):
        assert {r["batch"] for r in spark.read.option("basePath", f"{base}/{part}").parquet(f"{base}/{part}/batch=*").collect()} == {4, 5}
    assert spark.read.parquet(f"{base}/marks").where("batch = 5").first()["late"] == 4  # hour 0 is open until the batch with hour 4
    # one of long ago, run again, changes nothing
    R.put_hours(spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, 20), 7)], "pixel long, ts timestamp, cents long"), 1, base)
    got = {r["ts"].hour: (r["cents"], r["provisional"]) for r in R.hours_so_far(spark, base).collect()}
    assert got == {0: (3, False), **{4 * k: (1, k == 5) for k in range(1, 6)}}
