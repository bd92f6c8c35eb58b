"""The system tier on tables of predictions: S1 to S4, as a dictionary of rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import resampling, system


def run_system_tier(pred: DataFrame, equal: str, inventory: DataFrame | None = None, parts: tuple[list[str], list[str], list[str]] = ([], [], []), influence: DataFrame | None = None, b: int = resampling.B) -> dict:
    """Checks that need a system's predictions.

    pred: item_id, seed, config, y, pa (the system), pb (its baseline), one config being `equal` (equal inputs). inventory: component,
    input, with parts: the system's components, the baseline's, and the inputs at hand. influence: y, pred_full, pred_without.
    """
    spark = pred.sparkSession
    pred = pred.select(F.col("item_id"), F.col("seed").cast("long").alias("seed"), F.col("config").cast("string").alias("config"), *(F.col(c).cast("long").alias(c) for c in ("y", "pa", "pb")))
    head = pred.agg((F.greatest(F.max("y"), F.max("pa"), F.max("pb")) + 1).alias("k"), F.count_distinct("seed").alias("seeds")).first()
    places = resampling.positions(pred)
    placed, n = pred.join(places, "item_id"), places.count()
    if not head["k"] or pred.where(F.col("config") == equal).isEmpty():
        raise ValueError(f"no predictions of the configuration {equal!r}")
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    out: dict = {"meta": {"items": n, "seeds": head["seeds"], "classes": head["k"], "equal": equal}}
    if inventory is not None:
        out["S1"] = rows(system.s1_inventory(inventory, *parts))[0]
    margin = resampling.paired_interval(placed, n, head["k"], ["config"], b).where("metric = 'd_macro_f1'").select("config", F.col("mean").alias("margin"), F.col("lo").alias("margin_lo"), F.col("hi").alias("margin_hi"))
    base = placed.where(F.col("config") == equal).select("seed", "pos", F.col("pa").alias("pe"))
    # a configuration's swing is its system against that of equal inputs
    swung = placed.where(F.col("config") != equal).join(base, ["seed", "pos"]).drop("pb").withColumnRenamed("pe", "pb")
    if swung.isEmpty():
        swing = spark.createDataFrame([], "config string, swing_lo double, swing_hi double")
    else:
        swing = resampling.paired_interval(swung, n, head["k"], ["config"], b).where("metric = 'd_macro_f1'").select("config", F.col("lo").alias("swing_lo"), F.col("hi").alias("swing_hi"))
    both = margin.join(swing, "config", "left")
    out["S2"] = {"configs": rows(both.orderBy("config")), **rows(system.s2_verdict(both, equal))[0]}
    weak = placed.where(F.col("config") == equal).select("item_id", "seed", "y", F.col("pb").alias("pred"))
    out["S3"] = rows(system.s3_headroom(weak, placed.select("item_id", "seed", "y", F.col("config").alias("alternative"), F.col("pa").alias("pred"))))[0]
    if influence is not None:
        out["S4"] = rows(system.s4_influence(influence))[0]
    return out


def to_json(result: dict) -> str:
    return json.dumps(result, indent=1, default=str)
