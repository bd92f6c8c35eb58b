"""D6 and its parts: exact and near duplicates across a split, lookup leakage, groups of duplicates, neighbour votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import graph, text, vectors
from plumbline.functions.rng import draw
from plumbline.functions.tables import saved

COS_MIN, FLAG_SHARE, NULLS = 0.90, 0.05, 20
GROUP_COS, MIN_TEXT = 0.95, 3


def _sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("split = 'test'"), df.where("split IN ('train', 'val')")


def exact_duplicates(df: DataFrame, key: str = "item_id", field: str = "text") -> DataFrame:
    """Test rows (key, norm) whose normalised, non-empty text occurs in train or val."""
    test, fit = (text.normal_digests(side, field, *keep) for side, keep in zip(_sides(df), (dict.fromkeys((key, field)), ()), strict=True))
    return test.join(fit.distinct(), "digest", "left_semi").select(key, text.normal(F.col(field)).alias("norm"))


def exact_keys(df: DataFrame, key: str = "item_id", field: str = "text") -> DataFrame:
    """The keys of `exact_duplicates` alone: no text goes from task to task."""
    test, fit = _sides(df)
    return text.normal_digests(test, field, key).join(text.normal_digests(fit, field).distinct(), "digest", "left_semi").select(key)


def nearest_fit(emb: DataFrame, key: str = "item_id") -> DataFrame:
    """key, fit_id, cos of every test row's nearest train or val row (the smaller id on ties); emb has key, split, vec."""
    unit = emb.select(F.col(key).alias("id"), vectors.unit(F.col("vec")).alias("x"), "split")
    test, fit = _sides(unit)
    found = vectors.nearest(test.select("id", "x"), fit.select("id", "x"))
    return found.select(F.col("query_id").alias(key), F.col("id").alias("fit_id"), "cos")


def lookup(df: DataFrame, near: DataFrame | None = None, key: str = "item_id", field: str = "text", label: str = "y", cos_min: float = COS_MIN) -> DataFrame:
    """Per test row: key, y, exact, near, dup, answer.

    The answer is the majority label of the exact matches (the lowest on ties), else the nearest row's, -1 without a duplicate.
    """
    named = df.select(key, "split", F.col(label).alias("y"), text.normal(F.col(field)).alias("norm"))
    test, fit = _sides(named)
    counts = fit.where("norm <> ''").groupBy("norm", "y").count()
    majority = counts.groupBy("norm").agg(F.max_by("y", F.struct("count", -F.col("y"))).alias("exact_answer"))
    out = test.join(majority, "norm", "left")
    if near is not None:
        labels = fit.select(F.col(key).alias("fit_id"), F.col("y").alias("near_answer"))
        out = out.join(near.join(labels, "fit_id"), key, "left")
    else:
        out = out.withColumns({"cos": F.lit(None).cast("double"), "near_answer": F.lit(None).cast("long")})
    exact = F.col("exact_answer").isNotNull()
    is_near = F.coalesce(F.col("cos") >= cos_min, F.lit(False)) & (F.col("norm") != "")
    answer = F.when(exact, F.col("exact_answer")).when(is_near, F.col("near_answer")).otherwise(-1)
    return out.select(key, "y", exact.alias("exact"), is_near.alias("near"), (exact | is_near).alias("dup"), answer.cast("long").alias("answer"))


def leak_rates(answers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_test, dup_share, exact_text_share, near_share, leaky_share, leaky_share_balanced (the mean over classes that occur)."""
    by = by or []
    ok = (F.col("answer") == F.col("y")).cast("double")
    share = lambda c: F.sum(F.col(c).cast("long"))
    classes = answers.groupBy(*by, "y").agg(F.count("*").alias("n"), share("dup").alias("d"), share("exact").alias("e"), share("near").alias("m"), F.sum(ok).alias("l"))
    n = F.sum("n")
    return classes.groupBy(*by).agg(n.alias("n_test"), (F.sum("d") / n).alias("dup_share"), (F.sum("e") / n).alias("exact_text_share"), (F.sum("m") / n).alias("near_share"), (F.sum("l") / n).alias("leaky_share"), F.avg(F.col("l") / F.col("n")).alias("leaky_share_balanced"))


def permuted_labels(df: DataFrame, reps: int = NULLS, key: str = "item_id", label: str = "y") -> DataFrame:
    """rep, key, y: train and val labels dealt anew, a permutation per rep by drawn order.

    Row k by key takes the label of row k by draw. Places are found within buckets first, so no task sorts a whole rep.
    """
    _, fit = _sides(df)
    base = fit.select(key, F.col(label).alias("y")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    by_draw = base.withColumn("d", draw("null", F.col("rep"), F.col(key)))

    def placed(rows: DataFrame, bucket, order: list[str]) -> DataFrame:
        rows = rows.withColumn("_b", bucket)
        sums = rows.groupBy("rep", "_b").count()
        w = Window.partitionBy("rep").orderBy("_b")
        ahead = sums.select("rep", "_b", (F.sum("count").over(w) - F.col("count")).alias("_a"))
        within = F.row_number().over(Window.partitionBy("rep", "_b").orderBy(*order))
        return rows.withColumn("_r", within).join(ahead, ["rep", "_b"]).withColumn("_r", F.col("_r") + F.col("_a")).drop("_b", "_a")

    span = fit.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    width = max(1.0, ((span["hi"] or 0) - (span["lo"] or 0) + 1) / 256)
    ids = placed(base.select("rep", key), F.floor((F.col(key) - (span["lo"] or 0)) / width), [key])
    drawn = placed(by_draw.select("rep", "y", "d", key), F.shiftright("d", 24), ["d", key]).select("rep", "_r", "y")
    return ids.join(drawn, ["rep", "_r"]).select("rep", key, "y")


def leak_null(df: DataFrame, near: DataFrame | None = None, reps: int = NULLS, key: str = "item_id", field: str = "text", label: str = "y", cos_min: float = COS_MIN) -> DataFrame:
    """rep, leaky_share, leaky_share_balanced of lookups in permuted labels."""
    test, fit = _sides(df.select(key, "split", F.col(label).alias("y"), text.normal(F.col(field)).alias("norm")))
    dealt = permuted_labels(df, reps, key, label)
    norms = fit.where("norm <> ''").select(key, "norm")
    counts = dealt.join(norms, key).join(test.select("norm").distinct(), "norm", "left_semi").groupBy("rep", "norm", "y").count()
    majority = counts.groupBy("rep", "norm").agg(F.max_by("y", F.struct("count", -F.col("y"))).alias("exact_answer"))
    every = test.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).join(majority, ["rep", "norm"], "left")
    if near is not None:
        close = near.where(F.col("cos") >= cos_min).join(dealt.select("rep", F.col(key).alias("fit_id"), F.col("y").alias("near_answer")), "fit_id").select("rep", key, "near_answer")
        every = every.join(close, ["rep", key], "left")
    else:
        every = every.withColumn("near_answer", F.lit(None).cast("long"))
    exact = F.col("exact_answer").isNotNull()
    is_near = F.col("near_answer").isNotNull() & (F.col("norm") != "")
    answers = every.select("rep", "y", exact.alias("exact"), is_near.alias("near"), (exact | is_near).alias("dup"), F.when(exact, F.col("exact_answer")).when(is_near, F.col("near_answer")).otherwise(-1).alias("answer"))
    return leak_rates(answers, ["rep"]).select("rep", "leaky_share", "leaky_share_balanced")


def d6(df: DataFrame, near: DataFrame | None = None, reps: int = NULLS, flag_share: float = FLAG_SHARE, **how) -> DataFrame:
    """One row: the shares, the null's means, the excess of lookup over them, and the verdict.

    With label=None there is no lookup: the duplicate share decides, and its columns are null.
    """
    if how.get("label", "y") is None:
        dup = leak_rates(lookup(df.withColumn("_none", F.lit(0).cast("long")), near, **how | {"label": "_none"})).select("n_test", "dup_share", "exact_text_share", "near_share")
        none = ("leaky_share", "leaky_share_balanced", "leaky_null", "leaky_null_balanced", "leaky_excess", "leaky_excess_balanced")
        return dup.select("*", *(F.lit(None).cast("double").alias(c) for c in none), F.when(F.col("dup_share") >= flag_share, "FLAG").otherwise("ok").alias("verdict"))
    real = leak_rates(lookup(df, near, **how))
    null = leak_null(df, near, reps, **how).agg(F.avg("leaky_share").alias("leaky_null"), F.avg("leaky_share_balanced").alias("leaky_null_balanced"))
    excess = F.col("leaky_share") - F.col("leaky_null")
    return real.join(null).select("*", excess.alias("leaky_excess"), (F.col("leaky_share_balanced") - F.col("leaky_null_balanced")).alias("leaky_excess_balanced"), F.when(excess >= flag_share, "FLAG").otherwise("ok").alias("verdict"))


def novel(df: DataFrame, near: DataFrame | None = None, **how) -> DataFrame:
    """Test rows without a duplicate (the slice on which a gain should hold)."""
    return lookup(df, near, **how).where(~F.col("dup"))


def novel_criteria(df: DataFrame, nears: dict[str, DataFrame | None], cos_min: float = COS_MIN, key: str = "item_id", field: str = "text") -> DataFrame:
    """key, a boolean per criterion, and `joint` (all of them) for test rows: whether a row has no duplicate by it.

    A criterion is a nearest_fit table (no row of at least `cos_min`), or None for the normalised text.
    """
    test, _ = _sides(df)
    out = test.select(key)
    for name, near in nears.items():
        dup = exact_keys(df, key, field) if near is None else near.where(F.col("cos") >= cos_min).select(key)
        hit = dup.distinct().withColumn(name, F.lit(False))
        out = out.join(hit, key, "left").withColumn(name, F.coalesce(name, F.lit(True)))
    every = F.lit(True)
    for name in nears:
        every = every & F.col(name)
    return out.withColumn("joint", every)


def cosine_sweep(df: DataFrame, near: DataFrame, grid: tuple[float, ...] = (0.85, 0.90, 0.95), **how) -> DataFrame:
    """The leak rates at several cosines: cos_min and those of `leak_rates`."""
    out = None
    for c in grid:
        row = leak_rates(lookup(df, near, cos_min=c, **how)).select(F.lit(c).alias("cos_min"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def duplicate_links(df: DataFrame, emb: DataFrame | None, least: float = GROUP_COS, key: str = "item_id", field: str = "text") -> DataFrame:
    """a < b: items of equal normalised text (of MIN_TEXT characters at least) or of near embeddings.

    Equal texts are linked to their first item, which joins the group as all pairs would, without making them.
    """
    # kept, as both uses would else read all texts
    same = saved(text.normal_digests(df.select(F.col(key).alias("b"), F.col(field).alias("_t")), "_t", "b", least=MIN_TEXT))
    first = same.groupBy("digest").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1")
    links = same.join(first, "digest").where("a < b").select("a", "b")
    if emb is not None:
        unit = emb.select(F.col(key).alias("id"), vectors.unit(F.col("vec")).alias("x"))
        links = links.unionByName(vectors.close_links(unit, least))
    return links.distinct()


def components(items: DataFrame, links: DataFrame, key: str = "item_id") -> DataFrame:
    """key, component: the smallest key that links lead to; every item has one."""
    labels = graph.components(links)
    return items.select(key).join(labels, F.col(key) == F.col("node"), "left").select(key, F.coalesce("label", key).alias("component"))


def group_folds(comp: DataFrame, labels: DataFrame, folds: int, key: str = "item_id", label: str = "y") -> DataFrame:
    """key, component, fold: whole groups in one fold.

    Groups are ranked within their majority class, large ones first, and dealt to folds in turn there and back. No group crosses, and
    classes and sizes come out even.
    """
    joined = comp.join(labels.select(key, F.col(label).alias("y")), key)
    counts = joined.groupBy("component", "y").count()
    groups = counts.groupBy("component").agg(F.max_by("y", F.struct("count", -F.col("y"))).alias("major"), F.sum("count").alias("size"))
    # ranks within (class, size) and running counts of sizes, so that singletons don't meet in one task
    buckets = groups.withColumn("d", draw("group", F.col("component"))).withColumn("b", F.shiftright("d", 24))
    sums = buckets.groupBy("major", "size", "b").count()
    w = Window.partitionBy("major").orderBy(F.desc("size"), "b")
    ahead = sums.select("major", "size", "b", (F.sum("count").over(w) - F.col("count")).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("major", "size", "b").orderBy("d", "component")) + F.col("ahead") - 1
    dealt = buckets.join(ahead, ["major", "size", "b"]).withColumn("r", rank)
    turn, place = F.floor(F.col("r") / folds) % 2, F.col("r") % folds
    fold = F.when(turn == 0, place).otherwise(folds - 1 - place)
    return joined.select(key, "component").join(dealt.select("component", fold.alias("fold")), "component").select(key, "component", "fold")


def group_split(comp: DataFrame, labels: DataFrame, folds: int = 20, test: int = 3, val: int = 3, key: str = "item_id", label: str = "y") -> DataFrame:
    """key, component, split: whole groups on one side, those of the first folds on test, of the next on val."""
    side = F.when(F.col("fold") < test, "test").when(F.col("fold") < test + val, "val").otherwise("train")
    return group_folds(comp, labels, folds, key, label).select(key, "component", side.alias("split"))


def crossing(links: DataFrame, split: DataFrame, key: str = "item_id") -> DataFrame:
    """Links whose ends are on different sides (there should be none)."""
    a = split.select(F.col(key).alias("a"), F.col("split").alias("sa"))
    b = split.select(F.col(key).alias("b"), F.col("split").alias("sb"))
    return links.join(a, "a").join(b, "b").where("sa <> sb")


def knn_vote(emb: DataFrame, k: int, classes: int, balanced: bool = False, key: str = "item_id", label: str = "y") -> DataFrame:
    """key, class, p for test rows: votes of the k nearest fit rows, weighted by cosine (negative as 0).

    Plain: each class has one vote more, then shares. Balanced: votes over the class's share of the fit rows, plus 0.001, then shares.
    """
    unit = emb.select(F.col(key).alias("id"), vectors.unit(F.col("vec")).alias("x"), "split", F.col(label).alias("y"))
    test, fit = _sides(unit)
    found = vectors.nearest(test.select("id", "x"), fit.select("id", "x"), k).join(fit.select("id", "y"), "id")
    votes = found.groupBy("query_id", "y").agg(F.sum(F.greatest("cos", F.lit(0.0))).alias("v"))
    every = test.select(F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(classes - 1).cast("long"))).alias("y"))
    scored = every.join(votes, ["query_id", "y"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    if balanced:
        total = fit.agg(F.count("*").alias("t"))
        prior = fit.groupBy("y").count().join(total).select("y", (F.col("count") / F.col("t")).alias("prior"))
        scored = scored.join(F.broadcast(prior), "y", "left").withColumn("v", F.coalesce(F.col("v") / F.col("prior"), F.lit(0.0)) + 1e-3)
    else:
        scored = scored.withColumn("v", F.col("v") + 1.0)
    share = F.col("v") / F.sum("v").over(Window.partitionBy("query_id"))
    return scored.select(F.col("query_id").alias(key), F.col("y").alias("class"), share.alias("p"))
