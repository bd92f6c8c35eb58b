"""Intermediate results that outlive executors: checkpoints, and tables written to the shared folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or, in a local session without one, a folder of its own.

    A cluster must name a folder that all machines share; without one this raises.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or "/tmp/checkpoints")
    return context.getCheckpointDir()


def saved(frame: DataFrame) -> DataFrame:
    """The same rows, computed once and kept as a checkpoint; the lineage ends there."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def positions(rows: DataFrame, key: str = "item_id") -> DataFrame:
    """key and pos, 0..n-1 in the order of keys (ranks within ranges of keys, then the ranges' running sums)."""
    # kept, so that both uses see the same ranges
    ranged = saved(rows.select(key).distinct().repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    within = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    sums = within.groupBy("_p").count()
    ahead = sums.select("_p", (F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).alias("_a"))
    return within.join(F.broadcast(ahead), "_p").select(key, (F.col("_r") - 1 + F.coalesce("_a", F.lit(0))).alias("pos"))


def written(frame: DataFrame) -> tuple[DataFrame, str]:
    """The same rows, written as Parquet and read again, and the path. It goes when the session ends, or by `dropped`.

    For loops: the planner knows such a table's true size, where a checkpoint's estimate multiplies with every join.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    kept_until_exit(spark, path)
    return spark.read.schema(frame.schema).parquet(path), path


def kept_until_exit(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the session ends."""
    _files(spark, path, "deleteOnExit")


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table of `written`."""
    _files(spark, path, "delete", True)


def swept(spark: SparkSession) -> None:
    """Has Spark delete the shuffles that nothing refers to any more; else they lie on disk until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _files(spark: SparkSession, path: str, method: str, *more: bool) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    getattr(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), method)(where, *more)
