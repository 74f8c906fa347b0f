"""Structured Streaming forms of the hourly operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridcells.operators.change import composed
from gridcells.runtime import delete, exists, scratch, ship


def read_stream(spark, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the parquet files of a path (a file, a folder or a glob)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


#: Keeps state in local RocksDB instances with changes logged to the checkpoint, so it is
#: not bounded by the memory of executors.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start in this block keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", base: str | None = None) -> DataFrame:
    """Everything available goes through to parquet in the shared folder. A run with
    the ``base`` of an earlier one takes up its state and adds to its table."""
    spark = stream.sparkSession
    base = base or scratch(spark, f"stream-{name}")
    with state_store(spark):
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def hourly_fold(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """pixel, ts, value, n of each closed hour: hours that rows up to ``late``
    behind the newest may still reach are provisional and held back."""
    hours = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "pixel")
    return hours.agg(F.sum("cents").alias("cents"), F.count("*").alias("n")).select("pixel", F.col("w.start").alias("ts"), "cents", "n")


_HOURS = "pixel long, ts timestamp, cents long, n long"


def put_hours(batch: DataFrame, batch_id: int, base: str, late_hours: int = 2) -> None:
    """Fold a batch of rows (pixel, ts, cents) into the table under ``base``: the sums of
    its hours are added to the hours still open after the batch before, and those that no
    row may reach any more are closed. What a batch writes depends on its rows and on the
    batch before alone, goes to folders of its number, and counts once the mark of the
    batch is there; so a batch that is run again, whole or after a failure, changes nothing.
    Rows of closed hours are late: left out, but counted in the mark, with those of all
    batches before. The marks and open hours of two batches are kept, so what a batch reads
    does not grow with their number. Once a later batch has its mark, a batch was finished,
    and is left."""
    spark = batch.sparkSession
    marks = spark.read.schema("newest timestamp, late long, batch long").parquet(f"{base}/marks") if exists(spark, f"{base}/marks") else None
    if marks is not None and not marks.where(F.col("batch") > batch_id).isEmpty():
        return
    before = marks.where(F.col("batch") < batch_id).orderBy(F.desc("batch")).first() if marks is not None else None
    limit = lambda newest: F.lit(newest) - F.expr(f"INTERVAL {late_hours} HOURS")
    end = F.col("ts") + F.expr("INTERVAL 1 HOUR")
    sums = batch.groupBy("pixel", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("cents").alias("cents"), F.count("*").alias("n"), F.max("ts").alias("seen"))
    sums = sums.persist()  # of one batch; a lost part is made anew
    newest, late = sums.agg(F.max("seen"), F.sum(F.when(end <= limit(before["newest"]), F.col("n")) if before else F.lit(0))).first()
    own = sums.drop("seen")
    if before:
        newest = before["newest"] if newest is None else max(newest, before["newest"])
        held = spark.read.schema(_HOURS).parquet(f"{base}/open/batch={before['batch']}")
        late = before["late"] + (late or 0)
        own = own.where(end > limit(before["newest"])).unionByName(held).groupBy("pixel", "ts").agg(F.sum("cents").alias("cents"), F.sum("n").alias("n"))
    closed = end <= limit(newest)
    if newest is not None:
        own.where(closed).write.mode("overwrite").parquet(f"{base}/closed/batch={batch_id}")
        own.where(~closed).write.mode("overwrite").parquet(f"{base}/open/batch={batch_id}")
        spark.createDataFrame([(newest, late or 0)], "newest timestamp, late long").coalesce(1).write.mode("overwrite").parquet(f"{base}/marks/batch={batch_id}")
    sums.unpersist()
    if marks is not None and before:
        for old in marks.where(F.col("batch") < before["batch"]).select("batch").collect():
            for part in ("open", "marks"):  # the mark last: it tells what there is to delete
                delete(spark, f"{base}/{part}/batch={old['batch']}")


def upsert_hours(stream: DataFrame, base: str, late_hours: int = 2) -> None:
    """Everything available of a stream of rows (pixel, ts, cents) into ``base``."""
    query = stream.writeStream.foreachBatch(lambda rows, k: put_hours(rows, k, base, late_hours)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def hours_so_far(spark: SparkSession, base: str) -> DataFrame:
    """pixel, ts, cents, n and provisional: closed hours, and open ones as they stand
    after the last batch that was finished."""
    if not exists(spark, f"{base}/marks"):
        return spark.createDataFrame([], f"{_HOURS}, provisional boolean")
    last = spark.read.schema("newest timestamp, late long, batch long").parquet(f"{base}/marks").agg(F.max("batch")).first()[0]
    closed = spark.read.schema(f"{_HOURS}, batch long").parquet(f"{base}/closed").where(F.col("batch") <= last).drop("batch")
    still = spark.read.schema(_HOURS).parquet(f"{base}/open/batch={last}")
    return closed.withColumn("provisional", F.lit(False)).unionByName(still.withColumn("provisional", F.lit(True)))


#: Pixels of neighbouring numbers whose state is one value.
BLOCK_PIXELS = 64
HELD = np.dtype([("pixel", np.int64), ("last", np.int64), ("load", np.float64)])


class Accumulator(StatefulProcessor):
    """The accumulator's recurrence with (last hour, load) of each pixel kept between batches,
    those of a block of BLOCK_PIXELS pixels in one value, so what a call costs is not paid for
    each pixel. A timer in event time drops those of pixels that have long been silent."""

    def __init__(self, half_life: float, start_hour: int, idle_hours: int):
        self.a, self.start, self.idle = 2 ** (-1 / half_life), start_hour, idle_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("loads", "held binary")

    def _held(self) -> np.ndarray:
        return np.frombuffer(bytes(self.state.get()[0]), HELD) if self.state.exists() else np.zeros(0, HELD)

    def _expiry(self, held: np.ndarray) -> np.ndarray:
        return (held["last"] + self.idle) * 3_600_000

    def _keep(self, held: np.ndarray, watermark: int) -> None:
        """Puts ``held`` (by pixel) into the state, and a timer for the first that runs out."""
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if not len(held):
            self.state.clear()
            return
        self.state.update((held.tobytes(),))
        self.handle.registerTimer(max(int(self._expiry(held).min()), watermark + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["pixel", "ts"], kind="stable")
        # the rows without a pixel are a block of one
        pixel = own["pixel"].to_numpy(np.int64) if key[0] is not None else np.zeros(len(own), np.int64)
        h = own["ts"].astype("datetime64[s]").astype("int64").to_numpy() // 3600
        watermark, held = timerValues.getCurrentWatermarkInMs(), self._held()
        held = held[(self._expiry(held) > watermark) | np.isin(held["pixel"], pixel)]
        at = np.searchsorted(held["pixel"], pixel)
        known = np.append(held["pixel"], 0)[at] == pixel
        known &= at < len(held)
        last = np.where(known, np.append(held["last"], 0)[at], self.start)
        load = np.where(known, np.append(held["load"], 0.0)[at], 0.0)
        # hours that were handed on are closed
        there = ~known | (h > last)
        own, pixel, h, last, load = own[there], pixel[there], h[there], last[there], load[there]
        if not len(h):
            self._keep(held, watermark)
            return
        first = np.append(True, pixel[1:] != pixel[:-1])
        gap = h - np.where(first, last, np.append(0, h[:-1]))
        fl = own["fl"].to_numpy(float)
        m = fl * self.a ** np.maximum(gap, 0).astype(float)
        c = fl * (1 - self.a) * own["x"].to_numpy(float)
        m, c = np.where(h <= self.start, 0.0, m), np.where(h <= self.start, 0.0, c)
        c = np.where(first & (m != 0), c + m * load, c)
        loads = composed(np.where(first, 0.0, m), c)[1]
        new = np.zeros(int(first.sum()), HELD)
        ends = np.append(first[1:], True)
        new["pixel"], new["last"], new["load"] = pixel[ends], h[ends], loads[ends]
        held = np.concatenate([held[~np.isin(held["pixel"], new["pixel"])], new])
        self._keep(held[np.argsort(held["pixel"])], watermark)
        yield pd.DataFrame({"pixel": own["pixel"], "ts": own["ts"], "load": loads})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, held = timerValues.getCurrentWatermarkInMs(), self._held()
        self._keep(held[self._expiry(held) > watermark], watermark)
        return iter(())

    def close(self) -> None:
        pass


def accumulate(stream: DataFrame, half_life: float, start_hour: int, late: str = "2 hours", idle_half_lives: int = 200) -> DataFrame:
    """pixel, ts, load of rows (pixel, ts, x, fl), which may come in any order within a
    batch; one whose hour a batch before has passed already is late and left out, as its
    load is part of what was handed on. The state of a pixel without rows for
    ``idle_half_lives`` is dropped, when nothing of its load is left in a double. Needs the
    state store of ROCKSDB, which ``run_to_table`` sets."""
    ship(stream.sparkSession)
    processor = Accumulator(half_life, start_hour, int(half_life * idle_half_lives))
    rows = stream.withColumn("block", F.expr(f"pixel div {BLOCK_PIXELS}")).withWatermark("ts", late).groupBy("block")
    return rows.transformWithStateInPandas(processor, "pixel long, ts timestamp, load double", "Append", "EventTime")


def match(model: DataFrame, radar: DataFrame, late: str = "2 hours") -> DataFrame:
    """Rows of both streams of one (parent, ts), joined while both watermarks keep
    their state bounded."""
    m = model.withWatermark("ts", late).alias("m")
    r = radar.withWatermark("ts", late).alias("r")
    same = (F.col("m.parent") == F.col("r.parent")) & (F.col("m.ts") == F.col("r.ts"))
    return m.join(r, same).select("m.parent", "m.ts", "m.plane", "r.child", "r.value")
