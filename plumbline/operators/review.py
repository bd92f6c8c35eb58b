"""Which decisions a reviewer should see: signals, and what deferring by them catches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import metrics
from plumbline.functions.rng import draw

BUDGETS, DRAWS = (0.10, 0.20), 50


def signals(rows: DataFrame) -> DataFrame:
    """rows (probs, suspicion, doubt: arrays and numbers) with review signals, larger = more in need.

    low_confidence, small_margin, rules, concept_doubt; their ranks scaled to 0..1, and equal-weight averages of ranks.
    """
    top = F.sort_array("probs", asc=False)
    d = rows.withColumns({"low_confidence": 1 - F.get(top, F.lit(0)), "small_margin": 1 - (F.get(top, F.lit(0)) - F.get(top, F.lit(1))), "rules": F.col("suspicion"), "concept_doubt": F.col("doubt")})
    base = ["low_confidence", "small_margin", "rules", "concept_doubt"]
    for s in base:
        d = metrics.rank_norm(d.withColumn(s, F.round(s, 9)), [], s, f"rank_{s}")
    mean = lambda *names: sum(F.col(f"rank_{n}") for n in names) / len(names)
    return d.withColumns({"confidence_and_rules": mean("low_confidence", "rules"), "margin_and_rules": mean("small_margin", "rules"), "confidence_and_concepts": mean("low_confidence", "concept_doubt"), "rules_and_concepts": mean("rules", "concept_doubt"), "all_signals": mean(*base)})


def deferral(rows: DataFrame, score: str, budgets: tuple[float, ...] = BUDGETS, by: list[str] | None = None) -> DataFrame:
    """by, budget, caught, retained_acc: expected over random orders of tied scores, in closed form. rows: err (0/1) and the score.

    The top ceil(budget * n) rows go to review. Of a tie that the cut goes through each row has the same chance.
    """
    keys = [*(by or []), "_one"]
    d = rows.withColumn("_one", F.lit(1))
    tied = d.groupBy(*keys, F.col(score).alias("_s")).agg(F.count("*").alias("c"), F.sum(F.col("err").cast("long")).alias("e"))
    w = Window.partitionBy(*keys)
    ahead = F.coalesce(F.sum("c").over(w.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = tied.withColumns({"ahead": ahead, "n": F.sum("c").over(w), "errors": F.sum("e").over(w)}).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    m = F.ceil(F.round(F.col("budget") * F.col("n"), 9))
    share = F.greatest(F.least((m - F.col("ahead")) / F.col("c"), F.lit(1.0)), F.lit(0.0))
    got = placed.groupBy(*keys, "budget").agg(F.sum(F.col("e") * share).alias("hit"), F.max("n").alias("n"), F.max("errors").alias("errors"), F.max(m).alias("m"))
    caught = F.col("hit") / F.greatest("errors", F.lit(1))
    kept = F.when(F.col("n") > F.col("m"), 1 - (F.col("errors") - F.col("hit")) / (F.col("n") - F.col("m")))
    return got.select(*(by or []), "budget", caught.alias("caught"), kept.alias("retained_acc"))


def deferral_draws(rows: DataFrame, score: str, budget: float, reps: int = DRAWS, key: str = "item_id") -> DataFrame:
    """The same by drawn orders: rep, caught. For comparison with the closed form."""
    n = rows.count()
    m = -(-int(round(budget * n * 1e9)) // 10**9)
    each = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    top = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc(score), draw("defer", F.col("rep"), F.col(key)), key)) <= m
    return each.withColumn("top", top).groupBy("rep").agg((F.sum(F.when(F.col("top"), F.col("err")).otherwise(0)) / F.greatest(F.sum("err"), F.lit(1))).alias("caught"))
