"""Caches of what is dear to compute (texts read from images, vectors, answers), keyed by content or id, on shared storage.

A cache is a Parquet table of `key` and value columns. What it lacks is found by
an anti-join over distinct keys, computed in pieces by the key's hash, and each
piece is appended by a commit of its own: a run that is lost keeps its finished
pieces, and the next one computes only what is left. Equal contents have one
key, so they are computed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources import corpora

PIECES = 16


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The cache's rows, one per key; none if there is no such table yet. schema: key and values."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    # two runs at once may both have computed a key: the values are alike, one of them is taken
    values = [f.name for f in schema if f.name != "key"]
    return spark.read.schema(schema).parquet(path).groupBy("key").agg(F.first(F.struct(*values)).alias("v")).select("key", "v.*")


def filled(items: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, schema: T.StructType, pieces: int = PIECES, force: bool = False) -> DataFrame:
    """The cache with all keys of `items`, computing those that it lacks (with force: all of them, and the older values go).

    items: key and what `compute` needs, which takes such rows, distinct by key, and gives key and the values of `schema`.
    """
    spark = items.sparkSession
    distinct = items.where(F.col("key").isNotNull()).dropDuplicates(["key"])
    if force:
        compute(distinct).select(*schema.fieldNames()).write.mode("overwrite").parquet(path)
        return read(spark, path, schema)
    have = read(spark, path, schema).select("key")
    todo = distinct.join(have, "key", "left_anti").withColumn("_piece", F.pmod(F.xxhash64("key"), F.lit(pieces)))
    # which pieces have anything to do; at most `pieces` rows
    for piece in sorted(r[0] for r in todo.select("_piece").distinct().collect()):
        compute(todo.where(F.col("_piece") == piece).drop("_piece")).select(*schema.fieldNames()).write.mode("append").parquet(path)
    return read(spark, path, schema)


def texts(files: DataFrame, reader, path: str, key: str = "path", **how) -> DataFrame:
    """key, text of files (key, content) by a caller's reader, through a cache keyed by the file's content."""
    keyed = files.withColumn("key", F.sha1("content"))
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("text", T.StringType())])
    cache = filled(keyed.select("key", "content"), lambda rows: corpora.with_model_text(rows, reader, "key"), path, schema, **how)
    return keyed.select(key, "key").join(cache, "key", "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def vectors(items: DataFrame, encoder, column: str, path: str, key: str = "item_id", **how) -> DataFrame:
    """key, vec of items by a caller's encoder, through a cache keyed by the column's content."""
    keyed = items.withColumn("key", corpora.content_key(F.col(column)))
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])
    cache = filled(keyed.select("key", column), lambda rows: corpora.with_vectors(rows, encoder, column, "key"), path, schema, **how)
    return keyed.select(key, "key").join(cache, "key", "left").select(key, "vec")
