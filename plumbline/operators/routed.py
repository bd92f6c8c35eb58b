"""A concept-routed classifier end to end: bank, concept scores, rules, scorecard, pooling weight; decisions with evidence."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import vectors
from plumbline.functions.tables import saved
from plumbline.operators import classifier, learners, mining, pooling

#: Folds whose jobs run at once, and the C of scorecards that are fitted out of fold by themselves.
SIDE_BY_SIDE, CARD_C = 5, 0.1


@dataclass
class Routed:
    """A fitted system: small tables and arrays of fixed size."""

    classes: list[str]
    centroids: list[list[float]]
    mu_text: list[float]
    mu_image: list[float]
    card: pooling.Scorecard
    literals: DataFrame
    rules: DataFrame
    weight: float

    def save(self, path: str) -> None:
        spark = self.rules.sparkSession
        head = [(self.classes, self.centroids, self.mu_text, self.mu_image, self.weight)]
        spark.createDataFrame(head, _HEAD).write.mode("overwrite").parquet(f"{path}/head")
        self.card.save(spark, f"{path}/card")
        self.literals.write.mode("overwrite").parquet(f"{path}/literals")
        self.rules.write.mode("overwrite").parquet(f"{path}/rules")


_HEAD = "classes array<string>, centroids array<array<double>>, mu_text array<double>, mu_image array<double>, weight double"


def load(spark, path: str) -> Routed:
    classes, centroids, mu_text, mu_image, weight = spark.read.schema(_HEAD).parquet(f"{path}/head").first()
    return Routed(classes, centroids, mu_text, mu_image, pooling.Scorecard.load(spark, f"{path}/card"), spark.read.parquet(f"{path}/literals"), spark.read.parquet(f"{path}/rules"), weight)


def scored(rows: DataFrame, centroids: list[list[float]], mu_text: list[float], mu_image: list[float]) -> DataFrame:
    """rows with s, the concept scores of pooling.concept_scores, by batches (a bank is too large an expression). rows: image, words (vectors)."""
    bank, mu_t, mu_v = (np.asarray(x, float) for x in (centroids, mu_text, mu_image))
    bank = bank.reshape(len(centroids), len(mu_t))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def scores(words: pa.Array, image: pa.Array) -> pa.Array:
        def side(vec: pa.Array, mu: np.ndarray) -> np.ndarray:
            x = vec.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vec), len(mu))
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) - mu
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) @ bank.T

        return _lists(np.maximum(side(words, mu_t), side(image, mu_v)))

    return rows.withColumn("s", scores(F.col("words"), F.col("image")))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def card_log_probs(card: pooling.Scorecard, s: Column) -> Column:
    """Log probabilities of a scorecard on raw concept scores, by batches."""
    mu, sd, coef, offset = (np.asarray(x, float) for x in (card.mu, card.sd, card.coef, card.offset))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def log_probs(s: pa.Array) -> pa.Array:
        z = (s.flatten().to_numpy(zero_copy_only=False).reshape(len(s), len(mu)) - mu) / sd @ coef.T + offset
        z = z - z.max(axis=1, keepdims=True)
        return _lists(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))

    return log_probs(s)


def _long(rows: DataFrame) -> DataFrame:
    return rows.select("item_id", F.posexplode("s").alias("j", "value")).select("item_id", F.format_string("c%03d", "j").alias("feature"), "value")


def bank_of(part: DataFrame, concepts: int) -> tuple[list[list[float]], list[float], list[float]]:
    """Centroids and the means of words and images of a concept bank over these rows."""
    mu_text, mu_image = learners.mean_unit(part, "words"), learners.mean_unit(part, "image")
    made = learners.concept_bank(part.select("item_id", F.col("words").alias("vec"), "word"), part.select("item_id", F.col("image").alias("vec")), concepts, means=(mu_text, mu_image))
    return [list(r["centroid"]) for r in made.orderBy("concept_id").collect()], mu_text, mu_image


def card_of(part: DataFrame, n: int, k: int, c: float | None = None) -> tuple[pooling.Scorecard, float]:
    """A scorecard over n concept scores, and its C (chosen on val if none is given). part: s, y, split."""
    rows = part.select(F.col("s").alias("vec"), "y", "split") if c is None else part.select(F.col("s").alias("vec"), "y", F.lit("train").alias("split"))
    return learners.chosen_scorecard(rows, [f"c{j:03d}" for j in range(n)], k, cs=learners.CARD_CS if c is None else (c,))


def concept_oof(rows: DataFrame, k: int, concepts: int = 30, folds: int = 5, groups: DataFrame | None = None, rebuild: bool = True, c: float = CARD_C) -> DataFrame:
    """item_id, fold, lc: log probabilities of every row by a scorecard that has not seen its fold.

    The concept bank is made anew without each fold, as mining it uses labels; rebuild=False keeps one bank of all rows, which leaks and
    is for measuring that. groups (item_id, component): no group is parted, so no row is scored by its near copies. The folds' fits run
    side by side, each on all rows outside of the fold, with a C that no fold chooses. rows: item_id, image, words, word, y.
    """
    dealt = saved(rows.join(classifier.folds_of(rows, folds, groups), "item_id"))
    shared = None if rebuild else bank_of(dealt, concepts)

    def one(f: int) -> DataFrame:
        inside = dealt.where(F.col("fold") != f)
        own = shared or bank_of(inside, concepts)
        card, _ = card_of(scored(inside, *own), len(own[0]), k, c)
        held = scored(dealt.where(F.col("fold") == f), *own)
        return saved(held.select("item_id", "fold", card_log_probs(card, F.col("s")).alias("lc")))

    with ThreadPool(min(folds, SIDE_BY_SIDE)) as pool:
        parts = pool.map(inheritable_thread_target(dealt.sparkSession)(one), range(folds))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def fit(rows: DataFrame, concepts: int = 30, folds: int = 5, acc_tol: float | None = 0.01, groups: DataFrame | None = None) -> Routed:
    """rows: item_id, image, words, word (a naming word), label, split, fold-free log probabilities `ln` of another classifier.

    Rules and the scorecard see train and val only. The pooling weight is chosen on out-of-fold scorecard predictions, with the
    concept bank built anew without each fold, so no row meets a bank that has seen it (nor, with groups, one that has seen its copies).
    """
    rows = saved(rows)
    classes = sorted(r[0] for r in rows.select("label").distinct().collect())
    y = (F.array_position(F.array(*map(F.lit, classes)), F.col("label")) - 1).cast("long")
    rows = rows.withColumn("y", y)
    known = rows.where("split IN ('train', 'val')")
    centroids, mu_t, mu_v = bank_of(known, concepts)
    full = saved(scored(rows, centroids, mu_t, mu_v))
    card, c = card_of(full, len(centroids), len(classes))
    parts = concept_oof(known, len(classes), concepts, folds, groups, c=c).join(known.select("item_id", "y", "ln"), "item_id")
    weight = pooling.select_weight(pooling.operating_points(saved(parts.select("y", "lc", "ln")), len(classes)), acc_tol=acc_tol).first()["w"]
    calib = full.where("split IN ('train', 'val')")
    lits = saved(mining.literals(_long(calib), calib))
    fires, labels = mining.true_literals(_long(calib), lits), calib.select("item_id", F.col("label").alias("class"))
    rules = saved(mining.greedy_dnf(mining.clauses(fires, lits, labels), fires, labels))
    return Routed(classes, centroids, mu_t, mu_v, card, lits, rules, weight)


def decide(rows: DataFrame, system: Routed) -> DataFrame:
    """rows with label_pred, state, suspicion, concept_share and evidence for and against."""
    full = scored(rows, system.centroids, system.mu_text, system.mu_image)
    fired = mining.fire(mining.true_literals(_long(full), system.literals), system.rules, full)
    by_class = fired.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("class", F.struct("fired", "trigger")))).alias("m"))
    names = F.array(*map(F.lit, system.classes))
    pick = lambda field, default: F.transform(names, lambda c: F.coalesce(F.element_at("m", c)[field], F.lit(default)))
    joined = full.join(by_class, "item_id", "left").withColumns({"fired": pick("fired", False), "trigger": pick("trigger", 0.0), "z": system.card.standardised(F.col("s"))}).drop("m")
    d = pooling.decompose(joined, system.card, system.weight)
    d = d.select("*", *pooling.evidence_state(F.col("pred"), F.col("fired"), F.col("trigger")))
    return pooling.evidence_record(d, system.card.names).withColumn("label_pred", F.element_at(names, (F.col("pred") + 1).cast("int")))
