"""Exact top-k search by inner product, score-at-a-time over impact-ordered segments.

The index: rows in blocks; in a block the entries of all vectors are dealt to
segments by descending quantised impact (the power of two that an absolute
component reaches). A segment has, for every dimension, the postings (row,
component) of its entries. A block of queries walks the segments in that order
and adds the scores of the postings of its dimensions; zeros have no postings.
A segment that holds more than a DENSE-th of all entries is added as one matrix
product, which is the same sum. After each segment every row's score is known
but for a rest, bounded by Cauchy-Schwarz with the norm of the row's entries
still to come. A row whose bound stays under the k-th best proven score can't be
in the result. Only when this proof leaves few rows does processing stop; these
possible members are scored exactly from the whole vectors. Without such a proof
all segments are processed, and scores are exact as they stand.

Components are multiplied by `scale` and floored; scores are integers. Vectors
that are null, empty or hold a null, NaN or infinite component take no part,
nor does a null id. Queries meet rows of their own length only; vectors of any
length do, a block holds ROWS of them. Rows equal in id and components count
once. Others of one id are candidates each and queries each, ranked apart, but
no row is a candidate for a query of its id. Ties go to the smaller id. With
fewer than k rows all are returned; an empty table gives an empty result. Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 64
#: Rows in a block of the index, and queries in a block.
ROWS, QUERIES = 16_384, 1024
#: Processing stops when at most this share of a block's rows may be members (and the proof holds).
FEW = 0.02
#: A segment of more than one in so many of a block's entries is added as a matrix.
DENSE = 16


def quantised(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id and `x`, the integer components as an array<long>; unusable vectors are left out."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(F.col(vector), bad) & (F.size(vector) > 0)
    return vectors.where(usable).select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale)).alias("x")).distinct()


class Segments:
    """The postings of one block of rows by descending impact, and the norms of what each segment leaves to come."""

    def __init__(self, rows: np.ndarray):
        self.rows, (many, dimensions) = rows, rows.shape
        impact = np.where(rows == 0, -1, np.floor(np.log2(np.maximum(np.abs(rows), 1)))).astype(np.int8)
        squares = rows * rows
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows and components by dimension, and where each begins
        self.rest: list[np.ndarray] = []
        for level in [x for x in np.unique(impact)[::-1] if x >= 0]:
            dimension, row = np.nonzero((impact == level).T)
            self.postings.append((row, rows[row, dimension], np.searchsorted(dimension, np.arange(dimensions + 1))))
            self.rest.append(np.sqrt(np.where(impact < level, squares, 0).sum(axis=1)))
        self.walked = 0  # postings that queries have met

    def add(self, step: int, queries: np.ndarray, score: np.ndarray, at: np.ndarray) -> None:
        """Adds a segment's scores of the queries at these places."""
        row, value, begin = self.postings[step]
        q, kind = queries[at], score.dtype
        if len(row) * DENSE > self.rows.size:
            part = np.zeros(self.rows.shape, kind)
            part[row, np.repeat(np.arange(self.rows.shape[1]), np.diff(begin))] = value
            score[at] += q.astype(kind) @ part.T
            self.walked += len(row) * len(at)
            return
        for d in np.flatnonzero(np.diff(begin)):
            asked = np.flatnonzero(q[:, d])
            if len(asked):
                members = row[begin[d] : begin[d + 1]]
                score[np.ix_(at[asked], members)] += np.outer(q[asked, d], value[begin[d] : begin[d + 1]]).astype(kind)
                self.walked += len(members) * len(asked)


def search(ids: np.ndarray, index: Segments, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, row id, score) of each query's k best rows in this block, exactly."""
    many = len(ids)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # float32 sums of integers are exact up to 2**24; beyond, float64 up to 2**53
    bound = max(1, int(np.abs(index.rows).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0))) * queries.shape[1]
    kind = np.float32 if bound < 1 << 24 else np.float64
    if bound >= 1 << 53:
        raise ValueError("components too large for exact scores")
    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    score = np.zeros((len(queries), many), kind)
    by_id = np.argsort(ids, kind="stable")
    first, last = (np.searchsorted(ids[by_id], query_ids, side=side) for side in ("left", "right"))
    for j in np.flatnonzero(first < last):  # rows of a query's own id are no candidates
        score[j, by_id[first[j] : last[j]]] = -np.inf
    free = many - (last - first)
    possible = free > 0
    for step in range(len(index.postings)):
        at = np.flatnonzero(possible)
        if not len(at):
            break
        index.add(step, queries, score, at)
        if step == len(index.postings) - 1:
            break
        for j in at:
            rest = norms[j] * index.rest[step]
            high = score[j] + rest + 1e-3
            low = score[j] - rest
            limit = max(k, FEW * many)
            if np.count_nonzero(high >= low.max()) > limit:  # the best proven score is the most that the k-th can be
                continue
            proven = np.partition(low, many - min(k, free[j]))[many - min(k, free[j])]
            members = np.flatnonzero(high >= max(proven, np.finfo(kind).min))
            if len(members) <= limit:
                found.append(_best(j, ids[members], index.rows[members] @ queries[j], k))
                possible[j] = False
    for j in np.flatnonzero(possible):
        line, n = score[j], min(k, free[j])
        members = np.flatnonzero(line >= max(np.partition(line, many - n)[many - n], np.finfo(kind).min))
        found.append(_best(j, ids[members], line[members].astype(np.int64), k))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([f[c] for f in found]) for c in range(3))  # type: ignore[return-value]


def _best(j: int, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return np.full(len(order), j), ids[order], scores[order]


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows gathered in blocks of about `size`: block, ids (binary of int64), x (binary of int32), dimensions."""
    n = rows.count()
    blocks = max(1, -(-n // size))
    schema = f"{name} int, ids binary, x binary, dimensions int"
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int32()]

    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("d").to_numpy()
        out = []
        for d in np.unique(lengths):
            part = table.filter(pa.array(lengths == d))
            ids = part.column("id").to_numpy().astype("<i8")
            flat = part.column("x").combine_chunks().flatten().to_numpy().astype("<i4")
            out.append((int(part.column("block")[0].as_py()), ids.tobytes(), flat.tobytes(), int(d)))
        return pa.table({f: pa.array([o[c] for o in out], kind) for c, (f, kind) in enumerate(zip((name, "ids", "x", "dimensions"), kinds, strict=True))})

    dealt = rows.select(F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int").alias("block"), "id", "x", F.size("x").alias("d"))
    return dealt.groupBy("block").applyInArrow(pack, schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Each query's k rows of highest score: query_id, rank, vec_id, score.

    `queries` has the columns of `vectors`; a query's own row (by id) is no candidate. Queries and rows meet block by block.
    """
    rows, asked = quantised(vectors, key, vector, scale), quantised(queries, key, vector, scale)
    index, blocks = _blocks(rows, ROWS, "row_block"), _blocks(asked, QUERIES, "query_block")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "query", "vec_id", "score")])
    # each block of queries goes to every block of rows of its length
    many = max(1, -(-rows.count() // ROWS))
    sent = blocks.withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).withColumnsRenamed({"ids": "query_ids", "x": "query_x"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None, None)
        for batch in batches:
            for row in batch.to_pylist():
                if held[0] != (row["row_block"], row["dimensions"]):
                    x = np.frombuffer(row["x"], "<i4").reshape(-1, row["dimensions"]).astype(np.int64)
                    held = (row["row_block"], row["dimensions"]), np.frombuffer(row["ids"], "<i8"), Segments(x)
                asked_ids = np.frombuffer(row["query_ids"], "<i8")
                asked_x = np.frombuffer(row["query_x"], "<i4").reshape(-1, row["dimensions"]).astype(np.int64)
                numbers = np.array([int.from_bytes(blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in asked_x], np.int64)
                for at in range(0, len(asked_ids), 256):
                    j, got, scores = search(held[1], held[2], asked_ids[at : at + 256], asked_x[at : at + 256], k)
                    which = numbers[at : at + 256][j]
                    yield pa.RecordBatch.from_arrays([pa.array(asked_ids[at : at + 256][j]), pa.array(which), pa.array(got), pa.array(scores.astype(np.int64))], names=schema.fieldNames())

    met = sent.join(index, ["row_block", "dimensions"]).select("row_block", "dimensions", "ids", "x", "query_ids", "query_x")
    found = met.mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def sql(k: int = 20, every: int = 20, scale: int = SCALE) -> str:
    """The same over `embeddings` in DuckDB, for queries whose vec_id `every` divides."""
    return f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.x AS query, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}
"""
