"""Draws that any engine repeats: integers from md5, and the splits made of them. Never rand()."""

from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def draw(*parts: Column | int | str) -> Column:
    """An integer below 2**32 from the md5 of the parts joined by |."""
    columns = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("long")


def draw_sql(*parts: str) -> str:
    """The same in DuckDB SQL; parts are SQL expressions."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


#: The constants of the splitmix64 generator.
_STEP, _FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def places(seed: int, stream: int, first: int, last: int, n: int) -> np.ndarray:
    """Draws number first to last - 1 of a stream, each one of 0..n-1 with equal odds."""
    u = np.uint64
    z = np.arange(first, last, dtype=u) * u(_STEP) + u(int(md5(f"{seed}|{stream}".encode()).hexdigest()[:16], 16))
    z = (z ^ (z >> u(30))) * u(_FIRST)
    z = (z ^ (z >> u(27))) * u(_SECOND)
    z ^= z >> u(31)
    return ((z >> u(11)).astype(np.float64) * 2.0**-53 * n).astype(np.int64)


def places_sql(seed: str, stream: str, i: str, n: str) -> str:
    """Draw number i of a stream in DuckDB SQL."""
    cut = f"% {1 << 64}::UHUGEINT)::UBIGINT"
    key = f"CAST('0x' || substr(md5(concat_ws('|', {seed}, {stream})), 1, 16) AS UBIGINT)"
    z = f"(({i}::UHUGEINT * {_STEP}::UHUGEINT + {key}::UHUGEINT) {cut}"
    out = f"list_transform([{z}], lambda z: (xor(z, z >> 30)::UHUGEINT * {_FIRST}::UHUGEINT {cut})"
    out = f"list_transform({out}, lambda z: (xor(z, z >> 27)::UHUGEINT * {_SECOND}::UHUGEINT {cut})"
    return f"CAST(floor(list_transform({out}, lambda z: (xor(z, z >> 31) >> 11)::DOUBLE * {2.0**-53!r}::DOUBLE)[1] * {n}) AS BIGINT)"


def seed_list(n: int, base: int = SEED) -> list[int]:
    """The base seed and n - 1 integers drawn from it."""
    # fixed values: generator and range decide the seeds
    return [base, *(int(x) for x in np.random.default_rng(base).integers(0, 2**31 - 1, n - 1))]


def _ranked(df: DataFrame, by: str, key: str, seed: int) -> DataFrame:
    """_rn and _n: the place of a row in its class in drawn order, and the class's size.

    Classes are few and large, so the place is made of a rank within drawn buckets and the buckets' running sums.
    """
    d = df.withColumn("_d", draw(seed, "split", F.col(key)))
    d = d.withColumn("_b", F.shiftright("_d", 22))
    sums = d.groupBy(by, "_b").count()
    w = Window.partitionBy(by).orderBy("_b")
    ahead = sums.select(F.col(by).alias("_by"), F.col("_b").alias("_bb"), (F.sum("count").over(w) - F.col("count")).alias("_ahead"), F.sum("count").over(Window.partitionBy(by)).alias("_n"))
    within = F.row_number().over(Window.partitionBy(by, "_b").orderBy("_d", key))
    placed = d.withColumn("_rn", within)
    return placed.join(ahead, placed[by].eqNullSafe(ahead["_by"]) & (placed["_b"] == ahead["_bb"])).withColumn("_rn", F.col("_rn") + F.col("_ahead")).drop("_d", "_b", "_by", "_bb", "_ahead")


def stratified_split(df: DataFrame, label: str, key: str, seed: int = SEED, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """`split`: train, val or test by drawn order within each class."""
    cut = F.when(F.col("_rn") <= F.round(F.col("_n") * train), "train").when(F.col("_rn") <= F.round(F.col("_n") * (train + val)), "val").otherwise("test")
    return _ranked(df, label, key, seed).withColumn("split", cut).drop("_rn", "_n")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int, seed: int = SEED) -> DataFrame:
    """`fold`: 0 to folds - 1, even within each class."""
    return _ranked(df, label, key, seed).withColumn("fold", (F.col("_rn") % folds).cast("long")).drop("_rn", "_n")


def capped_sample(df: DataFrame, label: str, key: str, cap: int, seed: int = SEED) -> DataFrame:
    """A stratified sample of about `cap` rows: each class in proportion, one row at least."""
    total = df.agg(F.count("*").alias("_total"))
    want = F.greatest(F.round(F.col("_n") * cap / F.col("_total")), F.lit(1))
    ranked = _ranked(df, label, key, seed)
    return ranked.join(F.broadcast(total)).where((F.col("_total") <= cap) | (F.col("_rn") <= want)).drop("_rn", "_n", "_total")


def sample_with_test(df: DataFrame, label: str, key: str, cap: int, seed: int = SEED) -> DataFrame:
    """A capped sample of the rows that are not for test, and all test rows."""
    return capped_sample(df.where("split <> 'test'"), label, key, cap, seed).unionByName(df.where("split = 'test'"))


def partitions(df: DataFrame, label: str, key: str, seeds: tuple[int, ...] = (1, 2, 3, 4, 5), test: float = 0.15, val: float = 0.15) -> DataFrame:
    """Fresh stratified train/val/test splits of a pool, one per seed, in long form with a `seed` column."""
    out = [stratified_split(df, label, key, s, 1 - test - val, val).withColumn("seed", F.lit(s)) for s in seeds]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
