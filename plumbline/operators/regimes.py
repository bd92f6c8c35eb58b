"""What experiments add to the checks: learned cuts, beam rules, control banks, channels, transfer and per-class reports."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text, vectors
from plumbline.functions.rng import SEED, draw, stratified_folds
from plumbline.functions.tables import saved
from plumbline.operators import learners, mining

#: Learned cuts, beams and the complexity grid.
CANDIDATES, KEEP, SEPARATION = 19, 3, 0.10
BEAM, BEAM_CANDS, CV_FOLDS = 8, 300, 3
COMPLEXITY_GRID = tuple(product((1, 2, 3, 4), repeat=2))

#: Prompt templates by predicate ending.
TEMPLATES = {
    "context": ("a {c}", "a {c} scene", "a photo of a {c} setting"),
    "stereotype": ("a woman in a {c} setting", "a woman engaged in {c}", "a meme about a woman and {c}"),
}


def prompts(classes: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """predicate, place, prompt for each class and template. classes: class."""
    rows = [F.struct(F.concat(F.col("class"), F.lit(f"_{kind}")).alias("predicate"), F.lit(i).cast("long").alias("place"), F.replace(F.lit(t), F.lit("{c}"), F.col("class")).alias("prompt")) for kind, ts in templates.items() for i, t in enumerate(ts)]
    return classes.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def prototypes(phrases: DataFrame) -> DataFrame:
    """predicate, prototype: the mean of unit phrase vectors, of unit length again. phrases: predicate, vec."""
    units = phrases.select("predicate", vectors.unit(F.col("vec")).alias("u"))
    return vectors.mean_vector(units, ["predicate"], "u", "m").select("predicate", vectors.unit_eps(F.col("m")).alias("prototype"))


def learned_cuts(scores: DataFrame, labels: DataFrame, candidates: int = CANDIDATES, keep: int = KEEP, separation: float = SEPARATION, min_support: int = mining.MIN_SUPPORT, max_support: float = mining.MAX_SUPPORT_FRAC) -> DataFrame:
    """feature, cut: thresholds chosen by the best F-beta that they reach for any class, some quantiles apart.

    scores: item_id, feature, value; labels: item_id, class (the calibration rows). Of evenly spaced quantiles from 5% to 95% those of fit
    support are ranked (the lower cut first on ties) and taken if far enough from all taken; then topped up by rank. A feature without
    any gets the fixed quantiles.
    """
    part = scores.join(labels, "item_id")
    levels = [0.05 + 0.9 * i / (candidates - 1) for i in range(candidates)]
    q = part.groupBy("feature").agg(F.array_distinct(F.percentile("value", F.array(*map(F.lit, levels)))).alias("cuts"), F.array_distinct(F.percentile("value", F.array(*map(F.lit, mining.QUANTILES)))).alias("fixed"))
    sizes = labels.groupBy("class").agg(F.count("*").alias("n_pos"))
    total = labels.agg(F.count("*").alias("total"))
    each = q.select("feature", F.posexplode("cuts").alias("i", "cut"), F.size("cuts").alias("m"))
    hits = part.join(F.broadcast(each), "feature").where(F.col("value") > F.col("cut")).groupBy("feature", "i", "cut", "m", "class").agg(F.count("*").alias("tp"))
    fired = hits.withColumn("fired", F.sum("tp").over(Window.partitionBy("feature", "i"))).join(F.broadcast(sizes.join(total)), "class")
    usable = fired.where((F.col("fired") >= min_support) & (F.col("fired") <= max_support * F.col("total")))
    best = usable.groupBy("feature", "i", "cut", "m").agg(F.max(F.round(mining.f_beta(F.col("tp"), F.col("fired"), F.col("n_pos")), 12)).alias("s"))
    place = F.when(F.col("m") > 1, F.col("i") / (F.col("m") - 1)).otherwise(0.0)
    ranked = best.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), "i", "cut", place.alias("q")))).alias("r"))
    none = F.slice("r", 1, 0)
    apart = F.aggregate("r", none, lambda acc, x: F.when((F.size(acc) < keep) & F.forall(acc, lambda p: F.abs(p["q"] - x["q"]) >= separation - 1e-12), F.concat(acc, F.array(x))).otherwise(acc))
    topped = F.slice(F.concat(apart, F.array_except("r", apart)), 1, keep)
    chosen = q.join(ranked, "feature", "left").select("feature", F.when(F.col("r").isNull(), F.col("fixed")).otherwise(F.transform(topped, lambda x: x["cut"])).alias("c"))
    return chosen.select("feature", F.explode(F.array_sort("c")).alias("cut"))


def beam_dnf(cands: DataFrame, fires: DataFrame, labels: DataFrame, width: int = mining.MAX_CLAUSES, beam: int = BEAM, most: int = BEAM_CANDS) -> DataFrame:
    """class, ranks (places of the chosen clauses in the candidate order), fbeta: the best union of at most `width` clauses.

    `beam` partial unions per class live on; equal coverage counts once. Each round is one join of clauses with coverages on rows.
    """
    top = saved(cands.where(F.col("rank") <= most).select(F.col("class").alias("target"), "rank", "lits"))
    used = top.select(F.explode("lits").alias("lit_id")).distinct()
    has = fires.join(used, "lit_id", "left_semi").groupBy("item_id").agg(F.collect_set("lit_id").alias("has")).join(labels, "item_id")
    heads = top.withColumn("lit_id", F.get("lits", F.lit(0)))
    hits = saved(has.withColumn("lit_id", F.explode("has")).join(heads, "lit_id").where(F.forall("lits", lambda x: F.array_contains("has", x))).select("item_id", "target", "rank", (F.col("class") == F.col("target")).cast("long").alias("pos"), F.xxhash64("item_id").alias("h")))
    alone = hits.groupBy("target", "rank").agg(F.count("*").alias("c_fired"), F.sum("pos").alias("c_tp"), F.bit_xor("h").alias("c_h"))
    sizes = labels.groupBy("class").agg(F.count("*").alias("n_pos")).withColumnRenamed("class", "target")
    zero = F.lit(0).cast("long")
    states = sizes.select("target", F.array().cast("array<bigint>").alias("ranks"), zero.alias("fired"), zero.alias("tp"), zero.alias("h"))
    best = None
    for _ in range(width):
        member = states.select("target", "ranks", F.explode("ranks").alias("rank")).join(hits, ["target", "rank"]).select("target", "ranks", "item_id").distinct()
        shared = member.join(hits, ["target", "item_id"]).groupBy("target", "ranks", "rank").agg(F.count("*").alias("s_fired"), F.sum("pos").alias("s_tp"), F.bit_xor("h").alias("s_h"))
        grown = states.join(alone, "target").where(~F.array_contains("ranks", F.col("rank"))).join(shared, ["target", "ranks", "rank"], "left").na.fill(0, ["s_fired", "s_tp", "s_h"]).join(F.broadcast(sizes), "target")
        union = grown.select("target", F.concat("ranks", F.array("rank")).alias("ranks"), (F.col("fired") + F.col("c_fired") - F.col("s_fired")).alias("fired"), (F.col("tp") + F.col("c_tp") - F.col("s_tp")).alias("tp"), F.col("h").bitwiseXOR(F.col("c_h")).bitwiseXOR(F.col("s_h")).alias("h"), "n_pos")
        scored = union.withColumn("f", F.round(mining.f_beta(F.col("tp"), F.col("fired"), F.col("n_pos")), 12))
        one = F.row_number().over(Window.partitionBy("target", "h", "fired").orderBy("ranks"))
        order = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("f"), "ranks"))
        states = saved(scored.withColumn("_o", one).where("_o = 1").withColumn("_r", order).where(F.col("_r") <= beam).drop("_o", "_r", "n_pos"))
        if states.isEmpty():
            break
        best = states.select("target", "ranks", "f") if best is None else best.unionByName(states.select("target", "ranks", "f"))
    if best is None:
        return sizes.select(F.col("target").alias("class"), F.array().cast("array<bigint>").alias("ranks"), F.lit(0.0).alias("fbeta")).limit(0)
    win = F.min_by(F.struct("ranks", "f"), F.struct(-F.col("f"), F.size("ranks"), "ranks")).alias("b")
    return best.groupBy(F.col("target").alias("class")).agg(win).select("class", "b.ranks", F.col("b.f").alias("fbeta"))


def complexity_by_folds(fires: DataFrame, lits: DataFrame, labels: DataFrame, grid: tuple[tuple[int, int], ...] = COMPLEXITY_GRID, folds: int = CV_FOLDS) -> DataFrame:
    """class, max_len, max_clauses: the simplest shape whose mean held-out F-beta is the best. fires and labels as in mining.clauses."""
    dealt = saved(stratified_folds(labels, "class", "item_id", folds))
    rows = None
    for fold in range(folds):
        train, held = dealt.where(F.col("fold") != fold).select("item_id", "class"), dealt.where(F.col("fold") == fold).select("item_id", "class")
        inside = fires.join(train.select("item_id"), "item_id", "left_semi")
        for length in sorted({a for a, _ in grid}):
            cands = saved(mining.clauses(inside, lits, train, max_len=length))
            for width in sorted({b for a, b in grid if a == length}):
                picked = beam_dnf(cands, inside, train, width).select("class", F.explode("ranks").alias("rank")).join(cands.select("class", "rank", "lits", "precision"), ["class", "rank"])
                if picked.isEmpty():
                    continue
                fired = mining.fire(fires, picked.select("class", "lits", "precision"), held)
                got = mining.rule_precision(fired, held).join(held.groupBy("class").agg(F.count("*").alias("n")), "class")
                part = got.select("class", F.lit(length).alias("max_len"), F.lit(width).alias("max_clauses"), mining.f_beta(F.col("tp"), F.col("fired"), F.col("n")).alias("f"))
                rows = saved(part) if rows is None else rows.unionByName(saved(part))
    if rows is None:
        return labels.select("class").distinct().select("class", F.lit(mining.MAX_LEN).alias("max_len"), F.lit(mining.MAX_CLAUSES).alias("max_clauses"))
    mean = rows.groupBy("class", "max_len", "max_clauses").agg(F.round(F.avg("f"), 9).alias("f"))
    pick = F.max_by(F.struct("max_len", "max_clauses"), F.struct("f", -F.col("max_len") * F.col("max_clauses"), -F.col("max_len"))).alias("p")
    return mean.groupBy("class").agg(pick).select("class", "p.*")


def random_bank(k: int, dim: int, seed: int = SEED) -> list[list[float]]:
    """k random unit directions: a control that has the machinery of a concept bank without its meaning."""
    import numpy as np

    v = np.random.default_rng(seed).standard_normal((k, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).tolist()


def unsupervised_bank(texts: DataFrame, images: DataFrame, k: int, anchors: int) -> list[list[float]]:
    """Directions from k-means alone: anchors of either modality, centred, clustered again. texts, images: item_id, vec."""
    import numpy as np

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    parts = []
    for side in (texts, images):
        _, centres = learners.kmeans(side.select("item_id", vectors.unit(F.col("vec")).alias("vec")), anchors)
        c = unit(np.array(centres))
        parts.append(unit(c - c.mean(axis=0)))
    both = np.concatenate(parts)
    spark = texts.sparkSession
    table = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(both)], "item_id long, vec array<double>")
    _, centres = learners.kmeans(table, min(k, len(both)))
    return unit(np.array(centres)).tolist()


def channel_correction(df: DataFrame, group: Column, caption: str, before: str, after: str) -> DataFrame:
    """group, n, and for a text channel before and after its correction: rows equal to the caption, mean length, empty rate."""
    t = lambda c: F.trim(text.raw(F.col(c)))
    parts = [x for name, c in (("before", before), ("after", after)) for x in (F.sum((t(caption) == t(c)).cast("long")).alias(f"equal_{name}"), F.avg(F.length(text.raw(F.col(c)))).alias(f"length_{name}"), F.avg((F.length(text.raw(F.col(c))) == 0).cast("double")).alias(f"empty_{name}"))]
    return df.groupBy(group.alias("group")).agg(F.count("*").alias("n"), *parts)


def channel(regime: Column, caption: Column, ocr: Column, ocr_before: Column) -> Column:
    """The text of a regime: caption, first ocr, corrected ocr, or both joined."""
    return F.when(regime == "caption", text.raw(caption)).when(regime == "ocr", text.raw(ocr_before)).when(regime == "corrected", text.raw(ocr)).when(regime == "fused", F.trim(F.concat_ws(" ", text.raw(ocr), text.raw(caption)))).otherwise("")


def class_report(rows: DataFrame) -> DataFrame:
    """class, n_true, n_pred, fixes, breaks of `pred` against `base`. rows: y, pred, base."""
    fix, brk = (F.col("pred") == F.col("y")) & (F.col("base") != F.col("y")), (F.col("pred") != F.col("y")) & (F.col("base") == F.col("y"))
    true = rows.groupBy(F.col("y").alias("class")).agg(F.count("*").alias("n_true"), F.sum(fix.cast("long")).alias("fixes"), F.sum(brk.cast("long")).alias("breaks"))
    said = rows.groupBy(F.col("pred").alias("class")).agg(F.count("*").alias("n_pred"))
    return true.join(said, "class", "full").select("class", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_true", "n_pred", "fixes", "breaks")))


def recall_by_type(rows: DataFrame, kind: str) -> DataFrame:
    """kind, n, recall of a binary prediction on positives. rows: y, pred and the kind's column."""
    return rows.where("y = 1").groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.avg(F.col("pred").cast("double")).alias("recall"))


def carve_val(df: DataFrame, key: str = "item_id", share: float = 0.15, seed: int = SEED) -> DataFrame:
    """`split` with a val part drawn from train, where a corpus has none."""
    if not df.where("split = 'val'").isEmpty():
        return df
    hit = (F.col("split") == "train") & (draw(seed, "val", F.col(key)) < int(share * (1 << 32)))
    return df.withColumn("split", F.when(hit, "val").otherwise(F.col("split")))


def transferred(scores: DataFrame, rules: DataFrame, lits: DataFrame, items: DataFrame, none_class: str) -> DataFrame:
    """item_id, pred, positive: a foreign system's rules applied unchanged; positive is any class but the named one."""
    fired = mining.fire(mining.true_literals(scores, lits), rules, items)
    pred = mining.rule_prediction(fired, none_class)
    return pred.select("item_id", "pred", (F.col("pred") != none_class).cast("long").alias("positive"))
