"""Every query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with DuckDB SQL over the same tables."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Float columns rounded, integer ones as long, so that any order of sums gives equal values."""
    from pyspark.sql import functions as F

    def cast(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            # adding 0.0 turns -0.0 into 0.0
            return (F.round(c.cast("double"), places) + 0.0).alias(name)
        return c.cast("long").alias(name) if kind in ("int", "smallint", "tinyint") else c

    return df.select(*(cast(n, k) for n, k in df.dtypes))
