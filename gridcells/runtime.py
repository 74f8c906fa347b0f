"""Session helpers: table loading, written intermediates, Arrow mapping."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or that
    of ``SparkContext.setCheckpointDir``. Only a local session without either gets a
    temporary one; elsewhere executors would each write to a disk of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = getattr(spark, "_gridcells_dir", None)
    if path is None:
        local = tempfile.mkdtemp(prefix="spark-gridcells-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        path = spark._gridcells_dir = "file://" + local
    return path


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _file_system(spark, path)
    return system.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    system, at = _file_system(spark, path)
    system.delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for what a query writes itself; ``clean``
    deletes it."""
    path = f"{shared_dir(spark)}/gridcells-{name}-{uuid.uuid4().hex}"
    spark._gridcells_staged = [*getattr(spark, "_gridcells_staged", []), path]
    return path


def clean(spark: SparkSession) -> None:
    """Delete the intermediates that this session has written. Call it when the results
    made of them have been written themselves."""
    for path in getattr(spark, "_gridcells_staged", []):
        delete(spark, path)
    spark._gridcells_staged = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared folder and read it back.

    Cuts the lineage with files that outlive any executor; ``clean`` deletes them.
    The schema is given to the reader, so an empty result stays readable.
    """
    spark = df.sparkSession
    ship(spark)
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than the session has cores (a small file of one
    row group) dealt out to as many as there are cores; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers that would not find it: those of a session
    started without it in PYTHONPATH. Local workers also find it in the driver's own
    folder, or where it is installed."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    here = context.master.startswith("local[") and (Path.cwd() == root or root.name == "site-packages")
    if here or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_gridcells_shipped", False):
        return
    name = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-gridcells-')}/gridcells", "zip", root, "gridcells")
    context.addPyFile(name)
    # the driver's own workers, which set up stateful streams, see no added files
    context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [name, context.environment.get("PYTHONPATH")]))
    context._gridcells_shipped = True
