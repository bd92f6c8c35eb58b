"""Planted leaks and nulls: how thresholds of the checks are set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import metrics, text
from plumbline.functions.rng import draw
from plumbline.functions.tables import saved
from plumbline.operators import duplicates, learners


def plant_cue(df: DataFrame, label: Column, share: float, control: bool = False, field: str = "text", key: str = "item_id", seed: int = 0) -> DataFrame:
    """A form-only cue on a drawn share of one class; as a control on the same share of all rows."""
    hit = (draw(seed, "cue", F.col(key)) % 10_000 < int(share * 10_000)) & (F.lit(True) if control else label)
    return df.withColumn(field, F.when(hit, text.planted_cue(F.col(field))).otherwise(F.col(field)))


def plant_copies(df: DataFrame, share: float, field: str = "text", key: str = "item_id", label: str = "y", seed: int = 0) -> DataFrame:
    """`df` and, as train rows with new keys, perturbed copies of a drawn share of the test rows with their labels.

    Keys of copies are negative: -1 - key.
    """
    chosen = df.where((F.col("split") == "test") & (draw(seed, "copy", F.col(key)) % 10_000 < int(share * 10_000)))
    copies = chosen.withColumns({field: text.perturbed(F.col(field), draw(seed, "word", F.col(key))), key: -1 - F.col(key), "split": F.lit("train")})
    return df.unionByName(copies)


def source_null(scores: DataFrame, reps: int = 50, key: str = "item_id", seed: int = 0) -> DataFrame:
    """mean, p99, max of the AUC of a fixed score for a binary source dealt by draw at its own rate. scores: key, score, positive."""
    rate = scores.agg(F.avg(F.col("positive").cast("double")).alias("rate"))
    each = scores.join(F.broadcast(rate)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("p", draw(seed, "source", F.col("rep"), F.col(key)) < F.col("rate") * float(1 << 32))
    auc = metrics.auc(each, ["rep"], "score", F.col("p")).select(F.greatest("auc", 1 - F.col("auc")).alias("auc"))
    return auc.agg(F.avg("auc").alias("mean"), F.percentile("auc", F.lit(0.99)).alias("p99"), F.max("auc").alias("max"))


def shuffled_contributions(rows: DataFrame, key: str = "item_id", seed: int = 0) -> DataFrame:
    """The same contributions in a drawn order per row: an explanation that is unfaithful by construction."""
    order = F.array_sort(F.transform("contrib", lambda c, i: F.struct(draw(seed, "contrib", F.col(key), i).alias("d"), c.alias("c"))))
    return rows.withColumn("contrib", F.transform(order, lambda s: s["c"]))


#: Thresholds that calibration chooses from, and the most false flags that a chosen one may raise.
D3_GRID, D6_GRID, MOST_FALSE = (0.05, 0.075, 0.10, 0.125, 0.15, 0.20, 0.25, 0.30), (0.025, 0.05, 0.075, 0.10, 0.15, 0.20), 0.05


def target_class(items: DataFrame) -> int:
    """The largest class after the majority, among train and val rows (the lower of equals)."""
    top = items.where("split IN ('train', 'val')").groupBy("y").count().orderBy(F.desc("count"), "y").limit(2).collect()
    return top[-1]["y"]


def cue_runs(items: DataFrame, rhos: tuple[float, ...], seeds: tuple[int, ...], target: int, key: str = "item_id") -> DataFrame:
    """run, kind, rho, seed, key, y, split, hit: every row in every run, and whether the run plants its cue there.

    `base` plants none; `leak` a drawn share rho of the target class; `control` as many rows, in expectation, of all. items: key, y, split.
    """
    share = items.agg(F.avg((F.col("y") == target).cast("double")).alias("share"))
    base = F.struct(F.lit("base").alias("kind"), F.lit(0.0).alias("rho"), F.lit(0).alias("seed"))
    runs = F.array(base, *(F.struct(F.lit(kind).alias("kind"), F.lit(rho).alias("rho"), F.lit(seed).alias("seed")) for rho in rhos for seed in seeds for kind in ("leak", "control")))
    each = items.select(key, "y", "split").join(F.broadcast(share)).select("*", F.explode(runs).alias("r")).select(key, "y", "split", "share", "r.*")
    place = draw("cue", F.col("kind"), F.col("seed"), F.round(F.col("rho") * 1000).cast("int"), F.col(key)) / float(1 << 32)
    hit = F.when(F.col("kind") == "leak", (F.col("y") == target) & (place < F.col("rho"))).when(F.col("kind") == "control", place < F.col("rho") * F.col("share")).otherwise(False)
    run = F.concat_ws("-", "kind", F.round(F.col("rho") * 1000).cast("int").cast("string"), F.col("seed").cast("string"))
    return each.select(run.alias("run"), "kind", "rho", "seed", key, "y", "split", hit.alias("hit"))


def oracle_lifts(runs: DataFrame, k: int) -> DataFrame:
    """run, kind, rho, seed, planted, oracle_lift: what the planted cue alone gives away.

    The best that a model can do with the cue's presence alone: the most common train class with it and without it, less the majority.
    """
    most = lambda rows, by: rows.groupBy(*by, "y").count().groupBy(*by).agg(F.max_by("y", F.struct("count", -F.col("y"))).alias("pred"))
    test = runs.where("split = 'test'").select("run", "hit", "y")
    by_cue = test.join(F.broadcast(most(runs.where("split = 'train'"), ["run", "hit"])), ["run", "hit"], "left")
    majority = test.join(F.broadcast(most(runs.where("split IN ('train', 'val')"), ["run"])), "run")
    # a cue that no train row has says nothing: the majority's answer
    answered = by_cue.join(F.broadcast(most(runs.where("split IN ('train', 'val')"), ["run"]).withColumnRenamed("pred", "top")), "run").withColumn("pred", F.coalesce("pred", "top"))
    f1 = lambda rows, name: metrics.macro(metrics.confusion(rows, ["run"]), ["run"], k).select("run", F.col("macro_f1").alias(name))
    heads = runs.groupBy("run", "kind", "rho", "seed").agg(F.sum(F.col("hit").cast("long")).alias("planted"))
    return heads.join(f1(answered, "a"), "run").join(f1(majority, "b"), "run").select("run", "kind", "rho", "seed", "planted", (F.col("a") - F.col("b")).alias("oracle_lift"))


def d3_runs(items: DataFrame, k: int, rhos: tuple[float, ...], seeds: tuple[int, ...], field: str = "text", key: str = "item_id") -> DataFrame:
    """run, kind, rho, seed, planted, oracle_lift, d3_lift: D3 re-run on every planted run, all in one job.

    Texts are shaped twice, as they are and with the cue; runs choose between the two, so no text is copied. items: key, y, split, field.
    """
    runs = saved(cue_runs(items, rhos, seeds, target_class(items), key))
    plain = text.with_shape(items, F.col(field), key)
    cued = text.with_shape(items, text.planted_cue(F.col(field)), key)
    cued = cued.select(key, *(F.col(c).alias(f"_{c}") for c in text.FEATURES))
    shaped = runs.join(saved(plain.join(cued, key)), key)
    rows = shaped.select("run", key, "y", "split", *(F.when(F.col("hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in text.FEATURES))
    lifts = learners.d3_by(rows, "run", k, key).select("run", F.col("lift").alias("d3_lift"))
    return oracle_lifts(runs, k).join(lifts, "run")


def d6_runs(items: DataFrame, shares: tuple[float, ...], seeds: tuple[int, ...], k: int, field: str = "text", key: str = "item_id") -> DataFrame:
    """run, kind, f, seed, planted, and the leak rates: D6's lookup re-run with copies of a drawn share of test rows among the train rows.

    `leak` copies keep the label, `control` copies take another, drawn one; a copy is upper-cased with marks, as its normal form ignores.
    items: key, y, split, field.
    """
    norm = items.select(key, "y", "split", text.normal(F.col(field)).alias("norm"))
    kinds = F.array(F.struct(F.lit("base").alias("kind"), F.lit(0.0).alias("f"), F.lit(0).alias("seed")), *(F.struct(F.lit(kind).alias("kind"), F.lit(f).alias("f"), F.lit(s).alias("seed")) for f in shares for s in seeds for kind in ("leak", "control")))
    run = F.concat_ws("-", "kind", F.round(F.col("f") * 1000).cast("int").cast("string"), F.col("seed").cast("string"))
    test = norm.where("split = 'test'").select("*", F.explode(kinds).alias("r")).select(key, "y", "norm", "r.*").withColumn("run", run)
    # the same rows are copied in a leak and in its control
    chosen = (F.col("norm") != "") & (draw("copy", F.col("seed"), F.round(F.col("f") * 1000).cast("int"), F.col(key)) / float(1 << 32) < F.col("f"))
    other = (F.col("y") + 1 + draw("label", F.col("seed"), F.col(key)) % (k - 1)) % k
    copies = test.where(chosen).select("run", "norm", F.when(F.col("kind") == "leak", F.col("y")).otherwise(other).alias("y"))
    # own train rows count in every run, copies in theirs; answers are the majority of both
    texts = test.select("norm").distinct()
    own = norm.where("split IN ('train', 'val') AND norm <> ''").join(texts, "norm", "left_semi").groupBy("norm", "y").agg(F.count("*").alias("n"))
    counts = own.select("*", F.explode(kinds).alias("r")).select("norm", "y", "n", "r.*").select(run.alias("run"), "norm", "y", "n").unionByName(copies.select("run", "norm", "y", F.lit(1).cast("long").alias("n"))).groupBy("run", "norm", "y").agg(F.sum("n").alias("n"))
    answers = counts.groupBy("run", "norm").agg(F.max_by("y", F.struct("n", -F.col("y"))).alias("answer"))
    looked = test.join(answers, ["run", "norm"], "left")
    hit = F.col("answer").isNotNull()
    rows = looked.select("run", "kind", "f", "seed", "y", hit.alias("dup"), hit.alias("exact"), F.lit(False).alias("near"), F.coalesce("answer", F.lit(-1)).alias("answer"))
    rates = duplicates.leak_rates(rows, ["run", "kind", "f", "seed"])
    return rates.select("run", "kind", "f", "seed", "n_test", "dup_share", "leaky_share", "leaky_share_balanced")


def thresholds(runs: DataFrame, stat: str, grid: tuple[float, ...], material, most: float = MOST_FALSE) -> DataFrame:
    """t, false_flag, detect, chosen: rates of runs that reach each threshold, of those without a leak and of leaks that are `material`
    (a condition); the chosen one is the smallest with at most `most` false flags, else the largest. runs: kind, stat."""
    over = (F.col(stat) >= F.col("t")).cast("double")
    negative = F.col("kind") != "leak"
    each = runs.withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    rates = each.groupBy("t").agg(F.avg(F.when(negative, over)).alias("false_flag"), F.avg(F.when(~negative & material, over)).alias("detect"))
    best = rates.agg(F.coalesce(F.min(F.when(F.col("false_flag") <= most, F.col("t"))), F.max("t")).alias("best"))
    return rates.join(F.broadcast(best)).select("t", "false_flag", "detect", (F.col("t") == F.col("best")).alias("chosen"))
