"""S1 to S6: the system tier, over long prediction tables and small inventories."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rng import SEED


def s1_inventory(inputs: DataFrame, system: list[str], baseline: list[str], available: list[str]) -> DataFrame:
    """One row: the sides' inputs, what only the system reads, what is unavailable, and the verdict. inputs: component, input."""
    side = lambda names: F.array_sort(F.collect_set(F.when(F.col("component").isin(names), F.col("input"))))
    sets = inputs.agg(side(system).alias("system_inputs"), side(baseline).alias("baseline_inputs"))
    only = F.array_sort(F.array_except("system_inputs", "baseline_inputs"))
    missing = F.array_sort(F.array_except("system_inputs", F.array(*map(F.lit, available)).cast("array<string>")))
    flag = (F.size("only_in_system") > 0) | (F.size("unavailable_at_inference") > 0)
    return sets.select("*", only.alias("only_in_system"), missing.alias("unavailable_at_inference")).withColumn("verdict", F.when(flag, "FLAG").otherwise("ok"))


def s2_verdict(intervals: DataFrame, equal: str) -> DataFrame:
    """One row from config, margin, margin_lo, swing_lo: which gains come from inputs, and both verdicts."""
    other = F.col("config") != equal
    gain = other & (F.col("margin_lo") > 0)
    from_inputs = gain & (F.col("swing_lo") > 0)
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("config"))))
    out = intervals.agg(listed(gain).alias("gains"), listed(from_inputs).alias("gain_partly_from_inputs"), F.max(F.when(F.col("config") == equal, F.col("margin_lo"))).alias("_eq"), (F.max("margin") - F.max(F.when(F.col("config") == equal, F.col("margin")))).alias("swing"))
    return out.select("gains", "gain_partly_from_inputs", "swing", F.when(F.size("gain_partly_from_inputs") > 0, "FLAG").otherwise("ok").alias("verdict"), F.when((F.size("gains") > 0) & (F.col("_eq") <= 0), "FLAG").otherwise("ok").alias("verdict_no_gain_survives"))


def s3_headroom(base: DataFrame, alternatives: DataFrame, stable: int | None = None, least: float = 0.02, key: str = "item_id") -> DataFrame:
    """One row: stable errors, what any alternative fixes, the residual and the verdict.

    base: key, seed, y, pred; alternatives: the same with `alternative`.
    """
    if stable is None:
        stable = -(-6 * base.select("seed").distinct().count() // 10)
    errors = base.groupBy(key).agg((F.sum((F.col("pred") != F.col("y")).cast("int")) >= stable).alias("err"))
    fixed = alternatives.groupBy(key, "alternative").agg((F.sum((F.col("pred") == F.col("y")).cast("int")) >= stable).alias("ok")).groupBy(key).agg(F.bool_or("ok").alias("fixed"))
    joined = errors.join(fixed, key, "left")
    count = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    out = joined.agg(F.count("*").alias("n"), count(F.col("err")).alias("stable_errors"), count(F.col("err") & F.col("fixed")).alias("fixed"))
    residual = F.col("stable_errors") - F.col("fixed")
    return out.select("n", "stable_errors", "fixed", residual.alias("residual"), (residual / F.col("n")).alias("residual_share"), F.lit(stable).cast("long").alias("stable_threshold"), F.when(residual / F.col("n") < least, "FLAG").otherwise("note").alias("verdict"))


def s3_fixed_by(base: DataFrame, alternatives: DataFrame, stable: int, key: str = "item_id") -> DataFrame:
    """alternative, fixed: how many stable errors each alternative fixes."""
    errors = base.groupBy(key).agg((F.sum((F.col("pred") != F.col("y")).cast("int")) >= stable).alias("err")).where("err")
    right = alternatives.groupBy("alternative", key).agg((F.sum((F.col("pred") == F.col("y")).cast("int")) >= stable).alias("ok"))
    return right.join(errors, key, "left_semi").groupBy("alternative").agg(F.sum(F.col("ok").cast("long")).alias("fixed"))


def s4_influence(rows: DataFrame, least: float = 0.02, margin_share: str | None = None) -> DataFrame:
    """One row from y, pred_full, pred_without: changed decisions, fixes, breaks, verdict."""
    changed = F.col("pred_full") != F.col("pred_without")
    count = lambda c: F.sum(c.cast("long"))
    extra = [F.avg(margin_share).alias("mean_margin_share")] if margin_share else []
    out = rows.agg(F.avg(changed.cast("double")).alias("changed"), count(changed).alias("n_changed"), count(changed & (F.col("pred_full") == F.col("y"))).alias("fixes"), count(changed & (F.col("pred_without") == F.col("y"))).alias("breaks"), *extra)
    return out.withColumn("verdict", F.when(F.col("changed") < least, "FLAG").otherwise("ok"))


def linear_labels(z: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The first class of largest linear score (to nine places) of every row."""
    return np.round(z @ weights.T + bias, 9).argmax(axis=1)


#: Modulus of the draws that order places at random.
PRIME = 2**31 - 1


def drawn_order(ids: list[str], rep: int, width: int, seed: int) -> np.ndarray:
    """Rows x places: every place's rank in a drawn order. One md5 a row and repetition; places spread it by a cube modulo PRIME."""
    first = np.array([int(md5(f"{seed}|{rep}|{i}".encode()).hexdigest()[:8], 16) for i in ids], np.int64)
    j = np.arange(width)
    x = (first[:, None] + j * j * 40503 + j * 69621) % PRIME
    order = np.argsort(x * x % PRIME * x % PRIME, axis=1, kind="stable")
    return np.argsort(order, axis=1)


def s5_faithfulness(rows: DataFrame, weights: list[list[float]], bias: list[float], ks: tuple[int, ...] = (1, 3, 5), reps: int = 20, neutral: float = 0.0, seed: int = SEED, key: str = "item_id") -> DataFrame:
    """k, delete_top, delete_random, keep_top, keep_random of a linear model, from key, z, contrib.

    Top places by contribution (the lower place on ties), random ones by drawn order; averages over rows and reps. Each Arrow
    batch scores its masked rows as matrix products and sends its counts on.
    """
    w, b = np.array(weights, np.float64), np.array(bias, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            if not ids:
                continue
            z, contrib = (batch.column(c).flatten().to_numpy().reshape(len(ids), -1) for c in ("z", "contrib"))
            base = linear_labels(z, w, b)
            changed = lambda kept: int((linear_labels(np.where(kept, z, neutral), w, b) != base).sum())
            top = np.argsort(np.argsort(-contrib, axis=1, kind="stable"), axis=1)
            counts = {k: [len(ids), changed(top >= k), len(ids) - changed(top < k), 0, 0] for k in ks}
            for rep in range(reps):
                drawn = drawn_order(ids, rep, z.shape[1], seed)
                for k in ks:
                    counts[k][3] += changed(drawn >= k)
                    counts[k][4] += len(ids) - changed(drawn < k)
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in ([k, *counts[k]] for k in ks)], pa.int64()) for i in range(6)], names=["k", "n", "dt", "kt", "dr", "kr"])

    doubles = lambda c: F.transform(c, lambda x: x.cast("double")).alias(c)
    met = rows.select(F.col(key).cast("string").alias("id"), doubles("z"), doubles("contrib")).mapInArrow(run, "k long, n long, dt long, kt long, dr long, kr long")
    mean = lambda c, times=1: (F.sum(c) / (F.sum("n") * times))
    return met.groupBy("k").agg(mean("dt").alias("delete_top"), mean("dr", reps).alias("delete_random"), mean("kt").alias("keep_top"), mean("kr", reps).alias("keep_random"))


def s5_verdict(by_k: DataFrame, k: int = 3, least: float = 2.0) -> DataFrame:
    """deletion_ratio and verdict."""
    ratio = F.col("delete_top") / F.greatest("delete_random", F.lit(1e-9))
    return by_k.where(F.col("k") == k).select(ratio.alias("deletion_ratio"), F.when(ratio < least, "FLAG").otherwise("ok").alias("verdict"))


def s6_verdict(deltas: DataFrame, criterion: DataFrame) -> DataFrame:
    """metric, mean, sd, criterion, met, verdict (of all metrics). deltas: partition, metric, value; criterion: metric, criterion."""
    per = deltas.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).join(criterion, "metric").withColumn("met", F.col("mean") >= F.col("criterion"))
    return per.join(per.agg(F.bool_and("met").alias("_all"))).select("metric", "mean", "sd", "criterion", "met", F.when(F.col("_all"), "ok").otherwise("FLAG").alias("verdict"))
