"""Decision rules of D3 to D5 on statistics, apart from any learner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTABLE, SEVERE, CLEAN_LIFT = (0.15, 0.75), (0.30, 0.85), 0.10
AUC_MIN, ASSOC_MIN = 0.80, 0.50
TOL, DETERMINES = 0.01, 0.90


def d3_level(lift: Column, share: Column) -> Column:
    """severe, notable, clean or nothing; a missing share allows neither of the first two."""
    reach = lambda limits: share.isNotNull() & (lift >= limits[0]) & (share >= limits[1])
    return F.when(reach(SEVERE), "severe").when(reach(NOTABLE), "notable").when(lift < CLEAN_LIFT, "clean").otherwise("")


def d3_verdict(level: Column) -> Column:
    return F.when(level.isin("severe", "notable"), "FLAG").when(level == "clean", "ok").otherwise("note")


def d4_verdict(auc: Column, v: Column, sources: Column) -> Column:
    return F.when(sources < 2, "note").when((auc >= AUC_MIN) & (v >= ASSOC_MIN), "FLAG").otherwise("ok")


def d5_values(scores: DataFrame) -> DataFrame:
    """encoder, enc_order, image, text, both (means over seeds), their population SDs, value_of_image, value_of_text."""
    m = lambda view, f: f(F.when(F.col("view") == view, F.col("macro_f1")))
    per = scores.groupBy("encoder", "enc_order").agg(*(m(v, F.avg).alias(v) for v in ("image", "text", "both")), *(m(v, F.stddev_pop).alias(f"sd_{v}") for v in ("image", "text", "both")))
    return per.select("*", (F.col("both") - F.col("text")).alias("value_of_image"), (F.col("both") - F.col("image")).alias("value_of_text"))


def d5_decide(scores: DataFrame, tol: float = TOL, determines: float = DETERMINES) -> DataFrame:
    """One row: claims on image and text, the best single modality (by score, encoder, view), verdict. scores: encoder, enc_order, view, seed, macro_f1."""
    per = d5_values(scores)
    strong = lambda c: F.max_by(c, "enc_order")
    weak = lambda c: F.min_by(c, "enc_order")
    single = F.array(*(F.struct(F.col(v).alias("macro_f1"), F.col("encoder"), F.lit(v).alias("view")) for v in ("image", "text")))
    out = per.agg(*(f(F.col(c)).alias(f"{n}_{c}") for c in ("value_of_image", "value_of_text", "encoder") for f, n in ((strong, "strong"), (weak, "weak"))), F.max(F.array_max(single)).alias("top"))

    def claim(mod: str) -> Column:
        s, w = F.col(f"strong_value_of_{mod}"), F.col(f"weak_value_of_{mod}")
        return F.when(s < tol, "adds little under the strongest encoder").when(w < tol, "encoder-limited").otherwise("contributes under every encoder").alias(f"{mod}_claim")

    return out.select(claim("image"), claim("text"), F.col("top.macro_f1").alias("best_single"), F.col("top.encoder").alias("best_encoder"), F.col("top.view").alias("best_view"), F.when(F.col("top.macro_f1") >= determines, "FLAG").otherwise("ok").alias("verdict"))


def d5_stability(scores: DataFrame, tol: float = TOL, determines: float = DETERMINES) -> DataFrame:
    """image_claim, text_claim, verdict, seeds: how many seeds, each decided alone, come to each outcome. scores as in d5_decide."""
    out = None
    for seed in sorted(r[0] for r in scores.select("seed").distinct().collect()):
        row = d5_decide(scores.where(F.col("seed") == seed), tol, determines)
        out = row if out is None else out.unionByName(row)
    return out.groupBy("image_claim", "text_claim", "verdict").agg(F.count("*").alias("seeds"))


def threshold_rates(rows: DataFrame, grid: list[float], stat: str, by: list[str]) -> DataFrame:
    """by, t, rate: the share of rows whose statistic reaches each threshold."""
    each = rows.withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    return each.groupBy(*by, "t").agg(F.avg((F.col(stat) >= F.col("t")).cast("double")).alias("rate"))


def leave_one_out_threshold(rows: DataFrame, grid: list[float], stat: str, most: float = 0.05) -> DataFrame:
    """held_out task, t (the smallest threshold whose false-flag rate on the other tasks' controls is at most `most`), its rate on the held-out one.

    rows: task, kind ('control' or other), stat. Counts per task and threshold come first; a held-out rate is the total less the task's own.
    """
    hits = rows.where("kind = 'control'").withColumn("t", F.explode(F.array(*map(F.lit, grid)))).groupBy("task", "t").agg(F.count("*").alias("n"), F.sum((F.col(stat) >= F.col("t")).cast("long")).alias("h"))
    w = Window.partitionBy("t")
    rest = hits.select("task", "t", "n", "h", (F.sum("n").over(w) - F.col("n")).alias("rn"), (F.sum("h").over(w) - F.col("h")).alias("rh"))
    ok = F.when((F.col("rn") > 0) & (F.col("rh") / F.col("rn") <= most), F.col("t"))
    best = rest.groupBy("task").agg(F.min(ok).alias("t"))
    return best.join(rest.select("task", "t", (F.col("h") / F.col("n")).alias("rate")), ["task", "t"], "left").select(F.col("task").alias("held_out"), "t", "rate")


def recovery_slope(rows: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """by, slope: least squares of y on x."""
    return rows.groupBy(*by).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"))


def flip_points(rows: DataFrame, lo: int = 500, hi: int = 1500, step: int = 5) -> DataFrame:
    """task, below, above: the multipliers nearest 1, on either side, at which D3's level changes when its lift limits are scaled.

    rows: task, lift, share. Limits over 1 count as 1.
    """
    m = F.col("m")
    cap = lambda x: F.least(F.lit(x) * m, F.lit(1.0))
    level = F.when(F.col("share").isNotNull() & (F.col("lift") >= cap(SEVERE[0])) & (F.col("share") >= SEVERE[1]), "severe").when(F.col("share").isNotNull() & (F.col("lift") >= cap(NOTABLE[0])) & (F.col("share") >= NOTABLE[1]), "notable").when(F.col("lift") < cap(CLEAN_LIFT), "clean").otherwise("")
    each = rows.withColumn("m", F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(step)))).withColumn("m", F.col("m") / 1000).withColumn("level", level).withColumn("base", d3_level(F.col("lift"), F.col("share")))
    changed = F.col("level") != F.col("base")
    return each.groupBy("task").agg(F.max(F.when((m < 1) & changed, m)).alias("below"), F.min(F.when((m > 1) & changed, m)).alias("above"))
