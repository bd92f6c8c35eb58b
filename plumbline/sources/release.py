"""What a release states of its files and splits, and results that are kept by task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def split_summary(df: DataFrame, content: str) -> DataFrame:
    """split, n, distinct contents and duplicates."""
    hashed = df.select("split", F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256).alias("h"))
    return hashed.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("h").alias("distinct")).withColumn("duplicates", F.col("n") - F.col("distinct"))


def rebuilt_split(items: DataFrame, released: DataFrame, content: str, key: str = "item_id") -> DataFrame:
    """Items with the split that a release gives for their content's SHA-256 (released: sha256, split)."""
    return items.withColumn("sha256", F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)).join(released, "sha256", "left")


def save_results(df: DataFrame, path: str, task: str = "task") -> None:
    """Replaces the results of the tasks in `df`, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(task).parquet(path)
