"""What the operators of this subpackage share: tables, checkpoints, schemas."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.tables import saved, shared_folder

__all__ = ["added", "beside", "crc_mod3", "fresh", "giving_back", "others", "saved", "shared_folder", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder, on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, with underscores before it as long as a frame has a column of that name (in any case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def others(columns: list[str], *names: str) -> list[str]:
    """The columns that have none of these names, in whatever case."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def beside(key: str, *names: str) -> list[str]:
    """Names of result columns beside a key: one that the key has (in any case) gets an underscore before it."""
    return [f"_{n}" if n.lower() == key.lower() else n for n in names]


def added(docs: DataFrame, *fields: T.StructField) -> T.StructType:
    """The schema of `docs` with these fields at its end, in place of columns of their names, in whatever case."""
    left = set(others(docs.columns, *(f.name for f in fields)))
    return T.StructType([*(f for f in docs.schema.fields if f.name in left), *fields])


def crc_mod3(column: str) -> Column:
    """crc32 of an id's decimal text, modulo 3; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over Arrow batches that returns freed memory to the system after each of its batches and at its end.

    Workers live on through later tasks and stages; what allocators keep for themselves would count against the executor all that time.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in run(batches):
                yield batch
                del batch
                _give_back()
        finally:
            _give_back()

    return wrapped


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # glibc only
        trim(0)
