"""Classification metrics as aggregates over long prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, by: list[str], y: str = "y", pred: str = "pred", weight: Column | None = None) -> DataFrame:
    """by, y, pred, n: cells of the confusion matrix that occur."""
    return df.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred")).agg((F.sum(weight) if weight is not None else F.count("*")).alias("n"))


def per_class(cells: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, class, tp, fp, fn, precision, recall, f1 for every class 0..k-1, 0 where undefined."""
    classes = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("class")
    sides = cells.select(*by, "y", "pred", "n", classes)
    hit = lambda a, b: F.sum(F.when(a & b, F.col("n")).otherwise(0))
    is_y, is_p = F.col("y") == F.col("class"), F.col("pred") == F.col("class")
    # of a cell only two classes have a part, so its rows are few before they meet
    counted = sides.groupBy(*by, "class").agg(hit(is_y, is_p).alias("tp"), hit(~is_y, is_p).alias("fp"), hit(is_y, ~is_p).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.select(*by, F.col("class").cast("long").alias("class"), "tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def macro(cells: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, macro_f1, acc; classes that neither side has count as 0."""
    cells = cells.withColumn("_one", F.lit(1))
    keys = [*by, "_one"]
    f1 = per_class(cells, keys, k).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))
    acc = cells.groupBy(*keys).agg((F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("acc"))
    return f1.join(acc, keys).drop("_one")


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, v: association of two categories over all rows, 0 when either has one value (cells that don't occur count)."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy(a).agg(F.sum("o").alias("ra")), cells.groupBy(b).agg(F.sum("o").alias("cb"))
    head = rows.agg(F.sum("ra").alias("n"), F.count("*").alias("r")).join(cols.agg(F.count("*").alias("c")))
    # sum (o - e)**2 / e = sum o**2 / e - n over cells that occur, the rest of which the sum of e completes
    joined = cells.join(rows, cells[a].eqNullSafe(rows[a])).join(cols, cells[b].eqNullSafe(cols[b]))
    part = joined.agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("s"))
    least = F.least("r", "c") - 1
    return part.join(head).select(F.when(least > 0, F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / least)).otherwise(0.0).alias("v"))


def cramers_v_by(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """by, v: as cramers_v within each group."""
    cells = df.groupBy(F.col(by).alias("g"), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    rows = cells.groupBy(F.col("g").alias("g1"), F.col("a").alias("a1")).agg(F.sum("o").alias("ra"))
    cols = cells.groupBy(F.col("g").alias("g2"), F.col("b").alias("b2")).agg(F.sum("o").alias("cb"))
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    joined = cells.join(rows, same("g", "g1") & same("a", "a1")).join(cols, same("g", "g2") & same("b", "b2"))
    sides = joined.groupBy("g").agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("s"))
    least = rows.groupBy("g1").agg(F.count("*").alias("r")).join(cols.groupBy("g2").agg(F.count("*").alias("c")), same("g1", "g2"))
    d = F.least("r", "c") - 1
    return sides.join(least, same("g", "g1")).select(F.col("g").alias(by), F.when(d > 0, F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / d)).otherwise(0.0).alias("v"))


def auc(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """by, auc: the Mann-Whitney statistic with half credit for ties.

    Rows are first counted by score, and ranks are running sums over distinct scores.
    """
    p = positive.cast("long")
    counted = df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(p).alias("_p"), F.sum(1 - p).alias("_q"))
    below = F.sum("_q").over(Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    won = counted.withColumn("_w", F.col("_p") * (F.coalesce(below, F.lit(0)) + F.col("_q") / 2))
    total = won.groupBy(*by).agg(F.sum("_w").alias("w"), F.sum("_p").alias("p"), F.sum("_q").alias("q"))
    return total.select(*by, F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("w") / (F.col("p") * F.col("q"))).alias("auc"))


def interval(column: str, low: float = 0.025, high: float = 0.975) -> list[Column]:
    """lo and hi: exact percentiles, interpolated."""
    both = F.percentile(column, F.array(F.lit(low), F.lit(high)))
    return [F.get(both, F.lit(0)).alias("lo"), F.get(both, F.lit(1)).alias("hi")]


def rank_norm(df: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """Average ranks scaled to 0..1 within groups, by distinct values so that one group's rows meet pre-counted."""
    keys = by or ["_one"]
    d = df if by else df.withColumn("_one", F.lit(1))
    counted = d.groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_c").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_v"), ((before + (F.col("_c") - 1) / 2) / F.greatest(F.sum("_c").over(w) - 1, F.lit(1))).alias(out))
    on = [d[k].eqNullSafe(placed[f"_k{i}"]) for i, k in enumerate(keys)] + [d[column].eqNullSafe(placed["_v"])]
    joined = d.join(placed, on).drop("_v", *(f"_k{i}" for i in range(len(keys))))
    return joined if by else joined.drop("_one")
