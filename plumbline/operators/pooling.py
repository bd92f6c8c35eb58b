"""Concept scores, the scorecard, log-linear pooling with exact attribution, evidence and operating points.

Everything here is a projection over a row and a model of fixed size (literals
or a one-row table), so scoring is one narrow stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import metrics, vectors

W_GRID = tuple(round(0.1 * k, 1) for k in range(11))
W_TOL = 0.01
STATES = ("SUPPORTED", "MIXED", "CONTESTED", "NONE")


@dataclass
class Scorecard:
    """A linear model over standardised concept scores."""

    names: list[str]
    mu: list[float]
    sd: list[float]
    coef: list[list[float]]
    intercept: list[float]
    log_prior: list[float] | None = None

    @property
    def offset(self) -> list[float]:
        return [a + b for a, b in zip(self.intercept, self.log_prior or [0.0] * len(self.intercept), strict=True)]

    def standardised(self, s: Column) -> Column:
        return F.zip_with(F.zip_with(s, _array(self.mu), lambda x, m: x - m), _array(self.sd), lambda x, d: x / d)

    def logits(self, z: Column) -> Column:
        return F.array(*(vectors.dot(z, _array(w)) + b for w, b in zip(self.coef, self.offset, strict=True)))

    def save(self, spark, path: str) -> None:
        row = (self.names, self.mu, self.sd, self.coef, self.intercept, self.log_prior)
        spark.createDataFrame([row], _CARD).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Scorecard:
        return cls(*spark.read.schema(_CARD).parquet(path).first())


_CARD = "names array<string>, mu array<double>, sd array<double>, coef array<array<double>>, intercept array<double>, log_prior array<double>"


def _array(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def concept_scores(text_vec: Column, image_vec: Column, centroids: list[list[float]], mu_text: list[float], mu_image: list[float]) -> Column:
    """Per concept the larger of both modalities' cosines, each centred and of unit length again."""
    t = vectors.unit(vectors.minus(vectors.unit(text_vec), _array(mu_text)))
    v = vectors.unit(vectors.minus(vectors.unit(image_vec), _array(mu_image)))
    return F.array(*(F.greatest(vectors.dot(t, _array(c)), vectors.dot(v, _array(c))) for c in centroids))


def prototype_score(vec: Column, prototype: list[float]) -> Column:
    """The cosine with a unit prototype (the mean of unit phrase vectors)."""
    return vectors.dot(vectors.unit_eps(vec), _array(prototype))


def activated(name: Column, score: Column, thresholds: dict[str, float], default: float) -> Column:
    """Whether a predicate's score exceeds the threshold of its name's ending."""
    limit = None
    for ending, t in thresholds.items():
        limit = (F.when(name.endswith(ending), t) if limit is None else limit.when(name.endswith(ending), t))
    return score > (limit.otherwise(default) if limit is not None else F.lit(default))


def pooled(lc: Column, ln: Column, w: Column | float) -> Column:
    """(1 - w) * lc + w * ln, element by element."""
    weight = w if isinstance(w, Column) else F.lit(float(w))
    return F.zip_with(lc, ln, lambda a, b: (1 - weight) * a + weight * b)


def decompose(rows: DataFrame, card: Scorecard, w: float) -> DataFrame:
    """rows (z, ln) with pred, runner_up, lc, scores, margin_concept, margin_neural, contrib, bias, concept_share.

    Contributions and bias sum to the concept margin.
    """
    coef = F.array(*map(_array, card.coef))
    offset = _array(card.offset)
    # a column of its own: log_softmax names its argument several times
    d = rows.withColumn("_lg", card.logits(F.col("z"))).withColumn("lc", vectors.log_softmax(F.col("_lg"))).drop("_lg").withColumn("scores", pooled(F.col("lc"), F.col("ln"), w))
    first, second = vectors.top_two(F.col("scores"))
    d = d.withColumns({"pred": first, "runner_up": second})
    at = lambda a, k: F.element_at(a, (F.col(k) + 1).cast("int"))
    gap = lambda a: at(a, "pred") - at(a, "runner_up")
    parts = F.zip_with(F.zip_with(at(coef, "pred"), at(coef, "runner_up"), lambda a, b: (1.0 - w) * (a - b)), F.col("z"), lambda a, z: a * z)
    d = d.withColumns({"margin_concept": (1.0 - w) * gap(F.col("lc")), "margin_neural": w * gap(F.col("ln")), "contrib": parts, "bias": (1.0 - w) * gap(offset)})
    return d.withColumn("concept_share", F.abs("margin_concept") / (F.abs("margin_concept") + F.abs("margin_neural") + 1e-12))


def operating_points(rows: DataFrame, k: int, grid: tuple[float, ...] = W_GRID) -> DataFrame:
    """w, macro_f1, acc of the pooled decision at every weight. rows: y, lc, ln."""
    each = rows.withColumn("w", F.explode(F.array(*map(F.lit, grid)))).withColumn("pred", vectors.argmax(pooled(F.col("lc"), F.col("ln"), F.col("w"))))
    return metrics.macro(metrics.confusion(each, ["w"]), ["w"], k)


def select_weight(points: DataFrame, tol: float = W_TOL, acc_tol: float | None = None) -> DataFrame:
    """One row, w: the smallest whose macro-F1 (and accuracy, if asked) is within tolerance of w = 1; 1 if none is."""
    ref = points.where("w = 1.0").select(F.col("macro_f1").alias("rf"), F.col("acc").alias("ra"))
    ok = F.col("macro_f1") >= F.col("rf") - tol - 1e-12
    if acc_tol is not None:
        ok = ok & (F.col("acc") >= F.col("ra") - acc_tol - 1e-12)
    return points.join(ref).agg(F.coalesce(F.min(F.when(ok, F.col("w"))), F.lit(1.0)).alias("w"))


def evidence_state(pred: Column, fired: Column, trigger: Column) -> list[Column]:
    """state and suspicion of a decision. fired and trigger: arrays by class."""
    i = (pred + 1).cast("int")
    own = F.element_at(fired, i)
    others = F.zip_with(F.transform(fired, lambda f, k: f & (k != pred)), trigger, lambda f, t: F.when(f, t).otherwise(0.0))
    against = F.exists(F.transform(fired, lambda f, k: f & (k != pred)), lambda f: f)
    state = F.when(own & against, "MIXED").when(own, "SUPPORTED").when(against, "CONTESTED").otherwise("NONE")
    suspicion = F.array_max(others) - F.when(own, F.element_at(trigger, i)).otherwise(0.0)
    return [state.alias("state"), suspicion.alias("suspicion")]


def state_rates(rows: DataFrame) -> DataFrame:
    """state, n, share, error_rate for all four states; the error rate of an empty one is null. rows: state, err."""
    got = rows.groupBy("state").agg(F.count("*").alias("n"), F.avg(F.col("err").cast("double")).alias("error_rate"))
    every = rows.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    total = rows.agg(F.count("*").alias("total"))
    return every.join(got, "state", "left").join(total).select("state", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"), "error_rate")


def evidence_record(rows: DataFrame, names: list[str], top: int = 3) -> DataFrame:
    """rows with evidence_for and evidence_against: the concepts of largest and smallest contribution, sign respected, rounded to 3 places."""
    label = F.array(*map(F.lit, names))
    paired = F.transform("contrib", lambda c, i: F.struct((-c).alias("_o"), i.alias("_i"), F.element_at(label, i + 1).alias("concept"), F.round(c, 3).alias("contrib")))
    clean = lambda arr: F.transform(arr, lambda s: F.struct(s["concept"].alias("concept"), s["contrib"].alias("contrib")))
    plus = F.slice(F.array_sort(F.filter(paired, lambda s: s["_o"] < 0)), 1, top)
    minus = F.slice(F.array_sort(F.transform(F.filter(paired, lambda s: s["_o"] > 0), lambda s: F.struct((-s["_o"]).alias("_o"), s["_i"].alias("_i"), s["concept"].alias("concept"), s["contrib"].alias("contrib")))), 1, top)
    return rows.withColumns({"evidence_for": clean(plus), "evidence_against": clean(minus)})


def policy_state(probs: Column, fired: Column, precision: list[float], affect: Column | None = None) -> Column:
    """[probabilities, confidence, fired, fired * precision, affect] as one array."""
    bits = F.transform(fired, lambda f: f.cast("double"))
    parts = [probs, F.array(F.array_max(probs)), bits, F.zip_with(bits, _array(precision), lambda f, p: f * p)]
    return F.concat(*parts, *([affect] if affect is not None else []))


def linear_policy(state: Column, fired: Column, free: list[list[float]], bias: list[float], own: list[float]) -> Column:
    """Scores per class: free weights on the state, and a class's own rule adding its (never negative) weight."""
    base = F.array(*(vectors.dot(state, _array(w)) + b for w, b in zip(free, bias, strict=True)))
    return F.zip_with(base, F.zip_with(fired, _array([max(o, 0.0) for o in own]), lambda f, o: F.when(f, o).otherwise(0.0)), lambda a, b: a + b)


def policy_grid(rows: DataFrame, k: int, precision: list[float], taus: list[float], plus: list[float], minus: list[float]) -> DataFrame:
    """tau, lam_pos, lam_neg, macro_f1, acc of a rule-adjusted decision for every combination.

    rows: y, probs, fired (arrays by class). Below confidence tau each class's score gains lam_pos times its rules' precision
    if they fired and loses lam_neg if not.
    """
    three = [F.explode(F.array(*map(F.lit, v))).alias(n) for n, v in (("tau", taus), ("lam_pos", plus), ("lam_neg", minus))]
    each = rows
    for column in three:
        each = each.select("*", column)
    change = F.zip_with("fired", _array(precision), lambda f, p: F.when(f, F.col("lam_pos") * p).otherwise(-F.col("lam_neg")))
    adjusted = vectors.argmax(F.zip_with("probs", change, lambda a, b: a + b))
    pred = F.when(F.array_max("probs") < F.col("tau"), adjusted).otherwise(vectors.argmax(F.col("probs")))
    keys = ["tau", "lam_pos", "lam_neg"]
    return metrics.macro(metrics.confusion(each.withColumn("pred", pred), keys), keys, k)


def best_policy(grid: DataFrame) -> DataFrame:
    """The first combination (by tau, then lam_pos, then lam_neg) of highest macro-F1, then accuracy."""
    score = F.struct(F.round("macro_f1", 12), F.round("acc", 12), -F.col("tau"), -F.col("lam_pos"), -F.col("lam_neg"))
    return grid.agg(F.max_by(F.struct("tau", "lam_pos", "lam_neg", "macro_f1", "acc"), score).alias("b")).select("b.*")


def flips(rows: DataFrame) -> DataFrame:
    """One row: how many decisions rules and free terms change. rows: base, with_rules, with_free, with_both (labels)."""
    count = lambda c: F.sum((F.col("base") != F.col(c)).cast("long"))
    return rows.agg(F.count("*").alias("n"), count("with_rules").alias("by_rules"), count("with_free").alias("by_free"), count("with_both").alias("by_both"))


def stacked(a: Column, b: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Scores of a linear model over two experts' log probabilities."""
    x = F.concat(a, b)
    return F.array(*(vectors.dot(x, _array(w)) + c for w, c in zip(weights, bias, strict=True)))


def answer_log_probs(answer: Column, k: int) -> Column:
    """Log probabilities from one answered class: 0.8 on it and 0.2 spread over all; even without an answer."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.log(F.when(answer.isNull(), F.lit(1.0 / k)).otherwise(0.2 / k + F.when(i == answer, 0.8).otherwise(0.0))))
