"""Many corpora as tasks of one table, and the small reports over them: registry, status, screening, controls, comparisons."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import metrics, text, vectors
from plumbline.functions.rng import draw
from plumbline.operators import learners, mining, resampling, system


@dataclass
class Registry:
    """Tasks by name: loaders of item_id, y, split, text (and what a check needs besides), in the order they are put in."""

    loaders: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def put(self, name: str, loader: Callable[[], DataFrame]) -> None:
        if name in self.loaders:
            raise ValueError(f"task {name} is there already")
        self.loaders[name] = loader

    def items(self, names: list[str] | None = None) -> DataFrame:
        """task, item_id, y, split, text of the named tasks, all by default."""
        out = None
        for name in names or self.loaders:
            part = self.loaders[name]().select(F.lit(name).alias("task"), "item_id", F.col("y").cast("long").alias("y"), "split", "text")
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("no task")
        return out


def sizes(items: DataFrame) -> DataFrame:
    """task, k (classes), train, val, test, majority_f1: what a task is, and the macro-F1 of its most common train and val class (the lowest of several)."""
    n = lambda s: F.sum((F.col("split") == s).cast("long")).alias(s)
    counts = items.groupBy("task", "y").agg(*(n(s) for s in ("train", "val", "test")))
    per = counts.groupBy("task").agg((F.max("y") + 1).alias("k"), *(F.sum(s).alias(s) for s in ("train", "val", "test")), F.max_by(F.struct("y", "test"), F.struct(F.col("train") + F.col("val"), -F.col("y"))).alias("top"))
    hit = F.col("top.test")
    f1 = F.when(hit + F.col("test") > 0, 2 * hit / (hit + F.col("test"))).otherwise(0.0) / F.col("k")
    return per.select("task", "k", "train", "val", "test", f1.alias("majority_f1"))


def status(names: DataFrame, results: DataFrame) -> DataFrame:
    """task, done, checks: which tasks have results, and of how many checks. names: task; results: task, check."""
    found = results.groupBy("task").agg(F.countDistinct("check").alias("checks"))
    return names.join(found, "task", "left").select("task", F.col("checks").isNotNull().alias("done"), F.coalesce("checks", F.lit(0)).alias("checks"))


#: What a check needs of a task, and what is said where it is missing.
NEEDS: dict[str, tuple[str, str]] = {"D3": ("texts", "no text"), "D4": ("sources", "single source"), "D5": ("encoders", "no embeddings"), "D6": ("texts", "no text"), "S2": ("systems", "one system only")}
LEAST = {"sources": 2, "systems": 2}


def dispatch(tasks: DataFrame) -> DataFrame:
    """task, check, run, why: which checks a task can have. tasks: task, texts, sources, encoders, systems (counts)."""
    each = F.array(*(F.struct(F.lit(check).alias("check"), (F.coalesce(F.col(need), F.lit(0)) >= LEAST.get(need, 1)).alias("run"), F.lit(why).alias("why")) for check, (need, why) in NEEDS.items()))
    return tasks.select("task", F.explode(each).alias("c")).select("task", "c.check", "c.run", F.when(~F.col("c.run"), F.concat(F.lit("n/a: "), F.col("c.why"))).otherwise("").alias("why"))


def screen(registry: Registry, refs: dict[str, float] | None = None, names: list[str] | None = None, b: int = resampling.B) -> DataFrame:
    """D3 of every task: task, shape_f1, majority_f1, lift, share, their intervals, level, verdict. refs: text-probe macro-F1 by task."""
    out = None
    for name in names or registry.loaders:
        items = registry.items([name])
        k = items.agg(F.max("y")).first()[0] + 1
        row = learners.d3_surface(items, "text", "y", k, (refs or {}).get(name), b=b).select(F.lit(name).alias("task"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def restricted(items: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    """The rows of some labels, with y counted anew in the order they are named."""
    code = F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1
    return items.where(F.col(label).isin(labels)).withColumn("y", code.cast("long"))


def first_examples(rows: DataFrame, conditions: dict[str, Column], order: list[str]) -> DataFrame:
    """condition and the first row, by `order`, that meets it; conditions without a row are left out."""
    each = F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))).alias("condition")
    one = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")
    return rows.select("*", each).groupBy("condition").agg(one).select("condition", "r.*")


def group_sizes(components: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, n_groups, largest_group, n_items, share_in_multi_groups. components: item_id, component (and `by`)."""
    by = by or []
    each = components.groupBy(*by, "component").agg(F.count("*").alias("n"))
    return each.groupBy(*by).agg(F.count("*").alias("n_groups"), F.max("n").alias("largest_group"), F.sum("n").alias("n_items"), (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_in_multi_groups"))


def against_base(per_seed: DataFrame, base: str) -> DataFrame:
    """signal, metric, mean, sd (population), seeds, seeds_better: differences from the base signal, paired by seed. per_seed: signal, seed, metric, value."""
    own = per_seed.where(F.col("signal") != base)
    other = per_seed.where(F.col("signal") == base).select("seed", "metric", F.col("value").alias("base"))
    d = F.round(F.col("value") - F.col("base"), 12)
    return own.join(other, ["seed", "metric"]).withColumn("d", d).groupBy("signal", "metric").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("sd"), F.count("*").alias("seeds"), F.sum((F.col("d") > 0).cast("long")).alias("seeds_better"))


def evidence_table(records: DataFrame) -> DataFrame:
    """state, share, error_rate: means over seeds (of those that have the state). records: seed, state, y, pred."""
    total = records.groupBy("seed").agg(F.count("*").alias("total"))
    per = records.groupBy("seed", "state").agg(F.count("*").alias("n"), F.avg((F.col("y") != F.col("pred")).cast("double")).alias("err"))
    every = total.join(per.select("state").distinct()).join(per, ["seed", "state"], "left")
    return every.groupBy("state").agg(F.avg(F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"), F.avg("err").alias("error_rate"))


def vocabulary_words(path: str | None, most: int, end: str = "</w>") -> frozenset[str]:
    """Whole words of a vocabulary file (JSON, token to rank) of a rank below `most`; empty if there is no such file."""
    if not path or not os.path.exists(path):
        return frozenset()
    with open(path, encoding="utf-8") as file:
        ranks = json.load(file)
    return frozenset(w for t, r in ranks.items() if t.endswith(end) and r < most and (w := t.removesuffix(end)).isalpha())


def naming_words(docs: DataFrame, field: str, vocabulary: DataFrame | None, least: int = 10, key: str = "item_id") -> DataFrame:
    """key, word: letter runs that are in the vocabulary (column word) or in at least `least` texts; all without a vocabulary."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text.raw(F.col(field))), F.lit("[a-z]+"), F.lit(0)))).alias("word")
    words = docs.select(key, found)
    if vocabulary is None:
        return words
    frequent = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word")
    return words.join(frequent.unionByName(vocabulary.select("word")).distinct(), "word", "left_semi").select(key, "word")


def predicate_pool(docs: DataFrame, field: str, phrases: DataFrame, vectors_of: DataFrame | None = None, phrase_vectors: DataFrame | None = None, centres: DataFrame | None = None, key: str = "item_id") -> DataFrame:
    """key, kind, name, value: says (1 or 0 for whole words of a phrase), sem (cosine of the item's vector with a phrase's), ex (with an exemplar's).

    phrases: term; vectors_of: key, vec; phrase_vectors: term, vec; centres: name, vec (unit, as cluster centres named by their medoids).
    Phrases and exemplars are a few hundred by construction (TOP_K a class) and meet every item.
    """
    said = F.explode(F.array_distinct(F.col("terms"))).alias("term")
    terms = phrases.agg(F.collect_set("term").alias("terms"))
    normal = docs.select(key, text.phrase_normal(F.col(field)).alias("t"))
    says = normal.join(F.broadcast(terms)).select(key, "t", said).select(key, F.lit("says").alias("kind"), F.col("term").alias("name"), text.has_phrase(F.col("t"), F.col("term")).cast("double").alias("value"))
    for kind, table in (("sem", phrase_vectors), ("ex", centres)):
        if vectors_of is None or table is None:
            continue
        listed = table.agg(F.collect_list(F.struct(F.col(table.columns[0]).alias("name"), vectors.unit(F.col("vec")).alias("v"))).alias("list"))
        each = vectors_of.select(key, vectors.unit(F.col("vec")).alias("u")).join(F.broadcast(listed)).select(key, "u", F.explode("list").alias("p"))
        says = says.unionByName(each.select(key, F.lit(kind).alias("kind"), F.col("p.name").alias("name"), vectors.dot(F.col("u"), F.col("p.v")).alias("value")))
    return says


def pool_summary(pool: DataFrame) -> DataFrame:
    """kind, predicates, mean, most: how many predicates of a kind, and the mean and largest mean value of them."""
    per = pool.groupBy("kind", "name").agg(F.avg("value").alias("m"))
    return per.groupBy("kind").agg(F.count("*").alias("predicates"), F.avg("m").alias("mean"), F.max("m").alias("most"))


def rule_summary(clauses: DataFrame) -> DataFrame:
    """class, clauses, literals, mean_precision, mean_recall, support. clauses: class, lits, precision, recall, fired."""
    return clauses.groupBy("class").agg(F.count("*").alias("clauses"), F.sum(F.size("lits")).cast("long").alias("literals"), F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.sum("fired").cast("long").alias("support"))


def thresholds(defaults: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """name, value: the override's where it has one, else the default's. Names that only the override has don't count."""
    if override is None:
        return defaults
    return defaults.join(override.select("name", F.col("value").alias("_o")), "name", "left").select("name", F.coalesce("_o", "value").alias("value"))


def expert_log_probs(logits: DataFrame, key: str = "item_id") -> DataFrame:
    """backbone, key, lc: log-softmax of a backbone's logits (fixed ones, or a probe's that learners.mlp_logits has fitted). logits: backbone, key, logits."""
    m = F.array_max("logits")
    shifted = F.transform("logits", lambda x: x - m)
    z = F.log(F.aggregate(F.transform(shifted, F.exp), F.lit(0.0), lambda s, x: s + x))
    return logits.select("backbone", key, F.transform(shifted, lambda x: x - z).alias("lc"))


def without_majority(docs: DataFrame, label: str) -> DataFrame:
    """The rows of all labels but the most common (the first of several): what a known-answer system's phrases are mined from."""
    top = docs.groupBy(F.col(label).alias("_l")).count().agg(F.min_by("_l", F.struct(-F.col("count"), "_l")).alias("_l"))
    return docs.join(F.broadcast(top), F.col(label).eqNullSafe(F.col("_l")), "left_anti")


def concept_phrases(docs: DataFrame, field: str, label: str, k: int = mining.TOP_K) -> DataFrame:
    """Phrases of a known-answer system's concepts: those of all labels but the most common."""
    kept = without_majority(docs, label).select(F.col(label).cast("string").alias("class")).distinct()
    return mining.mine_phrases(docs, field, label, k).join(F.broadcast(kept), "class", "left_semi")


def controls(pred: DataFrame, n: int, k: int, inputs: dict[str, tuple[DataFrame, list[str]]], b: int = resampling.B) -> DataFrame:
    """control, check, verdict, expected, agrees: S1 and S2 on controls whose answers are known.

    pred: control, config, seed, pos, y, pa, pb, each control with a config `equal`. inputs: control -> (inventory, inputs at hand).
    The positive control should be flagged by both, any other by none.
    """
    spark, out = pred.sparkSession, None
    for name, (inventory, available) in inputs.items():
        own = pred.where(F.col("control") == name)
        margin = resampling.paired_interval(own, n, k, ["config"], b).where("metric = 'd_macro_f1'").select("config", F.col("mean").alias("margin"), F.col("lo").alias("margin_lo"))
        equal = own.where("config = 'equal'").select("seed", "pos", F.col("pa").alias("pe"))
        # the swing is the configuration's system against the equal one's
        swung = own.where("config <> 'equal'").join(equal, ["seed", "pos"]).drop("pb").withColumnRenamed("pe", "pb")
        swing = resampling.paired_interval(swung, n, k, ["config"], b).where("metric = 'd_macro_f1'").select("config", F.col("lo").alias("swing_lo")) if not swung.isEmpty() else spark.createDataFrame([], "config string, swing_lo double")
        s1 = system.s1_inventory(inventory, ["N", "P"], ["N"], available).select(F.lit("S1").alias("check"), "verdict")
        s2 = system.s2_verdict(margin.join(swing, "config", "left"), "equal").select(F.lit("S2").alias("check"), "verdict")
        part = s1.unionByName(s2).select(F.lit(name).alias("control"), "*")
        out = part if out is None else out.unionByName(part)
    expected = F.when(F.col("control") == "positive", "FLAG").otherwise("ok")
    return out.withColumn("expected", expected).withColumn("agrees", F.col("verdict") == F.col("expected"))


def validate(found: DataFrame, expected: DataFrame) -> DataFrame:
    """check, subject, found, expected, agrees: figures within a tolerance of what was stated; a missing one doesn't agree.

    found: check, subject, value; expected: check, subject, value, tol.
    """
    want = expected.select("check", "subject", F.col("value").alias("expected"), "tol")
    both = want.join(found.select("check", "subject", F.col("value").alias("found")), ["check", "subject"], "left")
    return both.select("check", "subject", "found", "expected", F.coalesce(F.abs(F.col("found") - F.col("expected")) <= F.col("tol") + 1e-12, F.lit(False)).alias("agrees"))


def planted(items: DataFrame, label: str, rho: float, key: str = "item_id") -> DataFrame:
    """The texts with a cue of form planted in a drawn share `rho` of one label's rows: a run whose answer is known."""
    hit = (F.col("y") == int(label)) & (draw("plant", F.col(key)) % 1000 < int(rho * 1000))
    return items.withColumn("text", F.when(hit, text.planted_cue(F.col("text"))).otherwise(F.col("text")))


def calibration_runs(items: DataFrame, k: int, rhos: list[float], b: int = resampling.B) -> DataFrame:
    """rho, lift, level, verdict of D3 on planted runs; rho 0 is the control."""
    out = None
    for rho in rhos:
        row = learners.d3_surface(planted(items, "1", rho), "text", "y", k, b=b).select(F.lit(rho).alias("rho"), "lift", "level", "verdict")
        out = row if out is None else out.unionByName(row)
    return out


def affect(rows: DataFrame, width: int = 3) -> DataFrame:
    """The seam of an affect head that is switched off: `affect`, an array of zeros."""
    return rows.withColumn("affect", F.array_repeat(F.lit(0.0), width))


def best_cut(rows: DataFrame, score: str, steps: int = 33) -> DataFrame:
    """cut, macro_f1: of evenly spaced cuts of a score in 0..1, that of largest two-class macro-F1 (the smallest of several). rows: y, score."""
    grid = F.explode(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: i / F.lit(float(steps + 1)))).alias("cut")
    cells = rows.groupBy("y", F.col(score).alias("_s")).agg(F.count("*").alias("c")).select("*", grid).groupBy("cut", "y", (F.col("_s") >= F.col("cut")).cast("long").alias("pred")).agg(F.sum("c").alias("n"))
    return metrics.macro(cells, ["cut"], 2).select("cut", F.round("macro_f1", 12).alias("macro_f1")).orderBy(F.desc("macro_f1"), "cut").limit(1)

