"""Connected components of undirected edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.tables import dropped, written

#: Edges that one task joins by itself; more go on by rounds.
FEW = 100_000


def _joined(edges: DataFrame) -> DataFrame:
    """node, to: every node and the smallest that it leads to, by union-find in one task. At most FEW edges of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(k: int) -> int:
            while up.setdefault(k, k) != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(k) for k in nodes], pa.int64())], names=["node", "to"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, "node long, to long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that edges a, b lead to, for every node with an edge to another.

    Contraction: every node takes its smallest neighbour (or itself) as parent, labels jump to the parent's parent's
    parent, and edges are drawn anew between labels. Inner nodes of each round's trees are gone in the next, so edges
    shrink fast whatever the graph's diameter. Once FEW edges are left (counted first), one task joins them. Each round's
    tables are written; those before go.
    """
    spark = edges.sparkSession
    live, live_path = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, labels_path = None, None
    longs = dict(live.dtypes)["a"] == "bigint"
    while (many := live.count()) or labels is None:
        up_path = None
        if many <= FEW and longs:
            to, drawn = _joined(live), live.where(F.lit(False))
        else:
            both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
            up, up_path = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("up")))
            higher = up.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            to = up.join(higher, "up").select("node", F.col("upper").alias("up")).join(higher, "up").select("node", F.col("upper").alias("to"))
            ends = live.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            drawn = ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if labels is None:
            fresh = to.select("node", F.col("to").alias("label"))
        else:
            fresh = labels.join(to.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        new_labels, new_labels_path = written(fresh)
        new_live, new_live_path = written(drawn)
        for path in (live_path, labels_path, up_path):
            if path:
                dropped(spark, path)
        labels, labels_path, live, live_path = new_labels, new_labels_path, new_live, new_live_path
    dropped(spark, live_path)
    return labels
