"""Array columns as vectors, and blocks of them for dense products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and of a left block that meet a right one at once.
BLOCK, STRIP = 4096, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def over(a: Column, scalar: Column) -> Column:
    """The vector over a number, which is computed once, not for each element."""
    return F.zip_with(a, F.array_repeat(scalar, F.size(a)), lambda x, y: x.cast("double") / y)


def unit(a: Column, floor: float = 1e-12) -> Column:
    """The vector over its length, or over `floor` if that is more."""
    return over(a, F.greatest(norm(a), F.lit(floor)))


def unit_eps(a: Column, eps: float = 1e-8) -> Column:
    """The vector over its length plus eps."""
    return over(a, norm(a) + eps)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def log_softmax(z: Column) -> Column:
    """Shifted by the largest, so it never overflows."""
    less = lambda a, scalar: F.zip_with(a, F.array_repeat(scalar, F.size(a)), lambda x, y: x - y)
    shifted = less(z, F.array_max(z))
    return less(shifted, F.log(F.aggregate(shifted, F.lit(0.0), lambda s, x: s + F.exp(x))))


def softmax(z: Column) -> Column:
    return F.transform(log_softmax(z), F.exp)


def argmax(z: Column) -> Column:
    """The first place of the largest value, from 0."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("long")


def top_two(z: Column) -> tuple[Column, Column]:
    """Places of the largest and the next value; of equal ones the higher place wins."""
    order = F.sort_array(F.transform(z, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), asc=False)
    return F.get(order, F.lit(0))["i"].cast("long"), F.get(order, F.lit(1))["i"].cast("long")


def mean_vector(df: DataFrame, by: list[str], vector: str, out: str = "mean") -> DataFrame:
    """The element-wise mean of vectors per group."""
    each = df.select(*by, F.posexplode(vector).alias("_p", "_x"))
    means = each.groupBy(*by, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias(out))


def _pack(rows: DataFrame, block: str, size: int) -> DataFrame:
    """Vectors (id, x) in blocks of about `size`: ids and components as binary."""
    n = max(1, -(-rows.count() // size))

    def pack(table: pa.Table) -> pa.Table:
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8", copy=False)
        return pa.table({block: pa.array([table.column("_b")[0].as_py()], pa.int32()), "ids": pa.array([table.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

    dealt = rows.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return dealt.groupBy("_b").applyInArrow(pack, f"{block} int, ids binary, x binary")


def block_pairs(left: DataFrame, right: DataFrame, visit: Callable, schema: str, size: int = BLOCK, half: bool = False) -> DataFrame:
    """visit(left ids, left x, right ids, right x, same) -> columns, for every pair of blocks; with `half`, of one table, for each unordered pair once.

    left and right have id (long) and x (array<double>, one length). Each block is sent to each block of the other side;
    products are dense and nothing but what `visit` returns is kept. A task holds one pair at a time, of which `visit` gets STRIP rows of
    the left block each time. `same`: both blocks are one and the same (its rows may come in another order).
    """
    a, b = _pack(left, "lb", size), _pack(right, "rb", size).withColumnsRenamed({"ids": "rids", "x": "rx"})
    blocks = max(1, -(-right.count() // size))
    met = a.withColumn("rb", F.explode(F.sequence(F.col("lb") if half else F.lit(0), F.lit(blocks - 1)))).join(b, "rb").select((F.lit(half) & (F.col("lb") == F.col("rb"))).alias("same"), "ids", "x", "rids", "rx")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                # views of the batch, not copies
                ids, x, rids, rx = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in (("ids", "<i8"), ("x", "<f8"), ("rids", "<i8"), ("rx", "<f8")))
                x, rx, same = x.reshape(len(ids), -1), rx.reshape(len(rids), -1), batch.column("same")[k].as_py()
                for at in range(0, len(ids), STRIP):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in visit(ids[at : at + STRIP], x[at : at + STRIP], rids, rx, same)], names=names)

    return met.mapInArrow(run, schema)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 1) -> DataFrame:
    """query_id, id, cos, rank: the k rows of largest product with each query, the smaller id first on ties. Vectors of length 1."""

    def visit(ids, x, rids, rx, _):
        s = x @ rx.T
        take = min(k, s.shape[1])
        least = s.max(axis=1) if take == 1 else np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take]
        i, j = np.nonzero(s >= least[:, None])
        order = np.lexsort((rids[j], -s[i, j], i))
        i, j = i[order], j[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < take  # of equal ones at the end, those of the smaller ids
        i, j = i[first], j[first]
        return [ids[i], rids[j], s[i, j]]

    found = block_pairs(queries, rows, visit, "query_id long, id long, cos double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cos"), "id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def close_pairs(rows: DataFrame, least: float) -> DataFrame:
    """a < b, cos: pairs of rows of one table whose product is at least `least`, all of them; for connections alone see close_links."""

    def visit(ids, x, rids, rx, same):
        s = x @ rx.T
        near = s >= least
        if same:
            near &= ids[:, None] < rids
        i, j = np.nonzero(near)
        return [np.minimum(ids[i], rids[j]), np.maximum(ids[i], rids[j]), s[i, j]]

    return block_pairs(rows, rows, visit, "a long, b long, cos double", half=True)


def close_links(rows: DataFrame, least: float) -> DataFrame:
    """a < b: links that connect all that close_pairs connects. Rows of equal vectors hang on the smallest of them, which alone is compared."""
    heads = rows.groupBy("x").agg(F.min("id").alias("id"))
    alike = rows.select("x", F.col("id").alias("b")).join(heads.withColumnRenamed("id", "a"), "x").where("a < b").where(dot(F.col("x"), F.col("x")) >= least).select("a", "b")
    return alike.unionByName(close_pairs(heads.select("id", "x"), least).select("a", "b"))
