"""Checks and decisions that need one row only, on streams: shape features, profiles and decision records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import pooling
from plumbline.operators.relations import profile


def shape_stream(stream: DataFrame, field: str, key: str = "item_id") -> DataFrame:
    """The nine shape features of every arriving row."""
    return text.with_shape(stream, F.col(field), key)


def profile_stream(stream: DataFrame, fields: list[str], source: str | None = None) -> DataFrame:
    """The provenance profile so far (output mode complete or update)."""
    return profile(stream, fields, source)


def windowed_profile(stream: DataFrame, field: str, time: str, source: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows, empty rate and mean length per source and time window; rows later than the watermark don't count."""
    t = text.raw(F.col(field))
    marked = stream.withWatermark(time, late)
    return marked.groupBy(F.window(time, width), F.col(source).alias("source")).agg(F.count("*").alias("n"), F.avg((F.length(t) == 0).cast("double")).alias("empty"), F.avg(F.length(t)).alias("mean_chars"))


def decide(rows: DataFrame, card: pooling.Scorecard, w: float) -> DataFrame:
    """Decision, attribution and evidence of rows (s, ln, fired, trigger), a stream or a table of one row alike."""
    d = pooling.decompose(rows.withColumn("z", card.standardised(F.col("s"))), card, w)
    d = d.select("*", *pooling.evidence_state(F.col("pred"), F.col("fired"), F.col("trigger")))
    return pooling.evidence_record(d, card.names)


def decide_stream(stream: DataFrame, out: str, checkpoint: str, decision: Callable[[DataFrame], DataFrame]):
    """Starts a query that writes the decisions on what has arrived to `out`, one folder a batch, and ends when all is done.

    A batch that is run again after a stop overwrites its own folder, so a restart from the checkpoint repeats no row and loses none.
    decision: rows -> decisions, of single rows (as `decide` or routed.decide), the same as on a table.
    """

    def put(batch: DataFrame, number: int) -> None:
        decision(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decided(spark, out: str, schema) -> DataFrame:
    """The decisions that a stream has written so far."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)
