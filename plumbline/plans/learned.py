"""Queries that fit learners: compared by rows and by tolerance, not by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import metrics, rng, vectors
from plumbline.operators import classifier, decisions, duplicates, learners, routed
from plumbline.plans.audit import AuditSpec, findings, run_data_tier
from plumbline.plans.fixtures import LABELLED_SQL, embedded, labelled, manifest
from plumbline.plans.registry import query, rounded
from plumbline.sources.manifest import label_dim


@query()
def shape_learner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 on the texts' form against their language."""
    m = manifest(spark, sf_dir)
    dim = label_dim(m, "lang")
    rows = m.join(F.broadcast(dim), m["lang"] == dim["label"])
    return rounded(learners.d3_surface(rows, "text", "code", dim.count(), text_ref=0.9))


@query()
def source_auc_learner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4 with the language as the source."""
    return rounded(learners.d4_source(labelled(spark, sf_dir), "text", "lang", "label"))


@query()
def modality_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 with two encoders: half of the dimensions and all of them, halves as image and text."""
    e = embedded(spark, sf_dir)
    part = lambda a, n: e.select("item_id", F.slice("vec", a, n).alias("vec"))
    scores = learners.modality_scores({"small": (part(1, 16), part(33, 16)), "large": (part(1, 32), part(33, 32))}, e.select("item_id", "y", "split"), 10)
    return rounded(decisions.d5_decide(scores))


@query()
def modality_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How D5's claims hold over ten seeds, each decided by itself."""
    e = embedded(spark, sf_dir)
    part = lambda a, n: e.select("item_id", F.slice("vec", a, n).alias("vec"))
    scores = learners.modality_scores({"small": (part(1, 16), part(33, 16)), "large": (part(1, 32), part(33, 32))}, e.select("item_id", "y", "split"), 10, seeds=10)
    return decisions.d5_stability(scores)


@query()
def concept_bank_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embedded(spark, sf_dir)
    words = F.concat(F.lit("w"), F.col("y").cast("string"))
    bank = learners.concept_bank(e.where("item_id % 2 = 0").select("item_id", "vec", words.alias("word")), e.where("item_id % 2 = 1").select("item_id", "vec"), 30)
    return rounded(bank.select("concept_id", "name", "n_text", "n_img"))


@query()
def oof_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold log probabilities of each row's class."""
    e = rng.stratified_folds(embedded(spark, sf_dir).select("item_id", "vec", "y"), "y", "item_id", 5)
    out = learners.out_of_fold(e, 10, 5)
    return rounded(out.select("item_id", F.array_max("lc").alias("best_log_prob")))


_VIEWS = {"image": (1, 32), "text": (33, 32), "both": (1, 64)}


@query()
def neural_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test macro-F1 and accuracy of a class-weighted classifier on either half of the vectors and on both."""
    e, out = embedded(spark, sf_dir), None
    for view, (first, size) in _VIEWS.items():
        rows = e.select("item_id", F.slice("vec", first, size).alias("vec"), "y", "split")
        model, _ = classifier.classifier(rows, 10, hidden=32)
        scored = rows.where("split = 'test'").select("y", vectors.argmax(classifier.logits([model], F.col("vec"), F.lit(0))).alias("pred"))
        row = metrics.macro(metrics.confusion(scored, []), [], 10).select(F.lit(view).alias("view"), "macro_f1", "acc")
        out = row if out is None else out.unionByName(row)
    return rounded(out)


def _links(e: DataFrame) -> DataFrame:
    """item_id, component: groups of near vectors."""
    unit = e.select(F.col("item_id").alias("id"), vectors.unit(F.col("vec")).alias("x"))
    return duplicates.components(e, vectors.close_links(unit, 0.8))


@query()
def neural_crossfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's decision by a classifier that saw neither it nor a near copy of it (test rows: the full model's)."""
    e = embedded(spark, sf_dir)
    _, scored = classifier.crossfit(e, 10, 5, _links(e))
    lp = vectors.log_softmax(F.col("logits"))
    return rounded(scored.select("item_id", "fold", vectors.argmax(F.col("logits")).alias("pred"), F.array_max(lp).alias("best_log_prob")), 4)


@query()
def learned_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a learned policy over a classifier on one half of the vectors and rules of the other half, with what the rules may add."""
    e = embedded(spark, sf_dir)
    rows = e.select("item_id", F.slice("vec", 1, 32).alias("vec"), F.slice("vec", 33, 32).alias("other"), "y", "split")
    _, scored = classifier.crossfit(rows, 10, 5)
    # a class's rule: the other half is nearest that class's mean among train rows
    unit = rows.withColumn("other", vectors.unit(F.col("other")))
    means = vectors.mean_vector(unit.where("split = 'train'"), ["y"], "other", "m").select(F.col("y").alias("c"), "m")
    table = {r["c"]: list(r["m"]) for r in means.collect()}
    near = vectors.argmax(F.array(*(vectors.dot(F.col("other"), F.array(*map(F.lit, table.get(c, [0.0] * 32)))) for c in range(10))))
    fired = unit.withColumn("near", near).join(scored.select("item_id", "logits"), "item_id").withColumn("fired", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: c == F.col("near")))
    right = {r["near"]: r["p"] for r in fired.where("split = 'train'").groupBy("near").agg(F.avg((F.col("near") == F.col("y")).cast("double")).alias("p")).collect()}
    policy = classifier.learned_policy(fired, 10, [right.get(c, 0.0) for c in range(10)], steps=60)
    change = policy.change(F.transform(vectors.log_softmax(F.col("logits")), F.exp), F.col("fired"))
    out = fired.select("item_id", vectors.argmax(F.col("logits")).alias("base"), vectors.argmax(F.zip_with("logits", change, lambda a, b: a + b)).alias("pred"), F.element_at(F.array(*map(F.lit, policy.own().tolist())), (F.col("near") + 1).cast("int")).alias("rule_adds"))
    return rounded(out.withColumn("flipped", F.col("base") != F.col("pred")), 4)


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for a concept-routed system: halves of the vectors as image and words, a word that names the class."""
    e = embedded(spark, sf_dir)
    return e.select("item_id", F.slice("vec", 1, 32).alias("image"), F.slice("vec", 33, 32).alias("words"), F.concat(F.lit("w"), F.col("y").cast("string")).alias("word"), "y", "split")


@query()
def concept_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold log probabilities by scorecards whose concept banks are made anew without the fold; groups of near vectors stay whole."""
    known = _halves(spark, sf_dir).where("split <> 'test'")
    out = routed.concept_oof(known, 10, 30, 5, _links(embedded(spark, sf_dir).where("split <> 'test'")))
    return rounded(out.select("item_id", "fold", vectors.argmax(F.col("lc")).alias("pred"), F.array_max("lc").alias("best_log_prob")), 4)


@query()
def routed_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole concept-routed system: bank, rules, scorecard, cross-fitted classifier, pooling weight; every row's decision with its state."""
    rows = _halves(spark, sf_dir)
    vec = rows.select("item_id", F.concat("image", "words").alias("vec"), "y", "split")
    _, scored = classifier.crossfit(vec, 10, 5)
    both = rows.join(scored.select("item_id", vectors.log_softmax(F.col("logits")).alias("ln")), "item_id").withColumn("label", F.format_string("class %02d", "y")).drop("y")
    got = routed.decide(both, routed.fit(both))
    return rounded(got.select("item_id", "label", "label_pred", "state", "concept_share"), 4)


@query(
    f"""WITH {LABELLED_SQL}, a AS (SELECT (sum(CAST(x.t AND NOT z.t AND x.n > z.n AS INT)) + sum(CAST(x.t AND NOT z.t AND x.n = z.n AS INT)) / 2) / sum(CAST(x.t AND NOT z.t AS INT)) AS auc
  FROM (SELECT label = 'toxic' AS t, length(text) AS n FROM labelled) x, (SELECT label = 'toxic' AS t, length(text) AS n FROM labelled) z) SELECT round(greatest(auc, 1 - auc), 6) AS auc FROM a"""
)
def length_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learners.length_auc(labelled(spark, sf_dir), "text", F.col("label") == "toxic"))


@query()
def data_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data tier as a whole on the labelled documents: check, subject, verdict. Rows take the vector of their id, by its remainder, as image and text."""
    rows = labelled(spark, sf_dir).select("item_id", "text", "title", "lang", "split", "label")
    vectors = embedded(spark, sf_dir).select(F.col("item_id").alias("v"), "vec")
    n = vectors.count()
    placed = rows.select("item_id", (F.col("item_id") % n).alias("v")).join(vectors, "v")
    half = lambda a: F.slice("vec", a, 32)
    views = F.explode(F.array(*(F.struct(F.lit(e).alias("encoder"), F.lit(v).alias("view"), F.lit(o).alias("enc_order"), x.alias("vec")) for o, (e, part) in enumerate((("small", 16), ("large", 32))) for v, x in (("image", F.slice(half(1), 1, part)), ("text:text", F.slice(half(33), 1, part))))))
    r = run_data_tier(rows, AuditSpec("label", ["text", "title"], "split", "lang", embeddings=placed.select("item_id", views.alias("e")).select("item_id", "e.*")))
    return spark.createDataFrame([(x["check"], x["subject"], x["verdict"]) for x in findings(r)], "check string, subject string, verdict string")
