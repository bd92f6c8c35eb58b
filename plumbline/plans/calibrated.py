"""Queries that plant leaks and re-run the checks on them: calibration, known answers, checks within sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import rng, text, vectors
from plumbline.operators import calibration, classifier, learners, resampling, tasks
from plumbline.plans.fixtures import CLASSES, LABELLED_SQL, NORM, embedded, labelled
from plumbline.plans.registry import query, rounded

RHOS, SHARES, SEEDS = (0.25, 0.5, 1.0), (0.1, 0.3), (0, 1)
H = rng.draw_sql
_K = f"k AS (SELECT unnest(range({CLASSES})) AS class)"
_MACRO = "SELECT run, avg(CASE WHEN d > 0 THEN 2 * tp / d ELSE 0.0 END) AS f FROM (SELECT run, class, sum(CAST(y = class AND {p} = class AS INT)) AS tp, sum(CAST(y = class AS INT)) + sum(CAST({p} = class AS INT)) AS d FROM t, k GROUP BY 1, 2) GROUP BY 1"
_MOST = "SELECT {by}, y AS pred FROM (SELECT {by}, y, row_number() OVER (PARTITION BY {by} ORDER BY count(*) DESC, y) AS rn FROM e WHERE {where} GROUP BY {by}, y) WHERE rn = 1"


def _runs_sql(name: str, rates: tuple[float, ...]) -> str:
    rows = ", ".join(f"('{kind}-{round(r * 1000)}-{s}', '{kind}', {r}::DOUBLE, {s})" for r in rates for s in SEEDS for kind in ("leak", "control"))
    return f"r(run, kind, {name}, seed) AS (VALUES ('base-0-0', 'base', 0.0::DOUBLE, 0), {rows})"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("item_id", "y", "split", "text")


@query(
    f"""WITH {LABELLED_SQL}, {_runs_sql("rho", RHOS)}, {_K},
  g AS (SELECT y FROM (SELECT y, row_number() OVER (ORDER BY count(*) DESC, y) AS rn FROM labelled WHERE split <> 'test' GROUP BY y) WHERE rn <= 2 ORDER BY rn DESC LIMIT 1), s AS (SELECT avg(CAST(y = (SELECT y FROM g) AS DOUBLE)) AS share FROM labelled),
  u AS (SELECT r.*, item_id, y, split, {H("'cue'", 'kind', 'seed', 'CAST(round(rho * 1000) AS INT)', 'item_id')} / 4294967296.0::DOUBLE AS u FROM labelled, r),
  e AS (SELECT *, CASE kind WHEN 'leak' THEN y = (SELECT y FROM g) AND u < rho WHEN 'control' THEN u < rho * (SELECT share FROM s) ELSE false END AS hit FROM u),
  top AS ({_MOST.format(by="run", where="split <> 'test'")}), cue AS ({_MOST.format(by="run, hit", where="split = 'train'")}),
  t AS (SELECT e.run, e.y, coalesce(cue.pred, top.pred) AS a, top.pred AS b FROM e JOIN top USING (run) LEFT JOIN cue ON cue.run = e.run AND cue.hit = e.hit WHERE split = 'test'),
  fa AS ({_MACRO.format(p="a")}), fb AS ({_MACRO.format(p="b")}), n AS (SELECT run, kind, rho, seed, count(*) FILTER (WHERE hit) AS planted FROM e GROUP BY ALL)
  SELECT n.run, kind, round(rho, 6) AS rho, CAST(seed AS BIGINT) AS seed, planted, round(fa.f - fb.f, 6) AS oracle_lift FROM n JOIN fa USING (run) JOIN fb USING (run)"""
)
def planted_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cue of form gives away, planted at every rate in one class, and in as many rows of all."""
    items = _items(spark, sf_dir)
    return rounded(calibration.oracle_lifts(calibration.cue_runs(items, RHOS, SEEDS, calibration.target_class(items)), CLASSES))


_COPIES = f"""{LABELLED_SQL}, {_runs_sql("f", SHARES)}, m AS (SELECT item_id, y, split, {NORM.format(t='text')} AS norm FROM labelled),
  t AS (SELECT r.*, item_id, y, norm FROM m, r WHERE split = 'test'),
  c AS (SELECT run, norm, CASE WHEN kind = 'leak' THEN y ELSE (y + 1 + {H("'label'", 'seed', 'item_id')} % {CLASSES - 1}) % {CLASSES} END AS y FROM t WHERE norm <> '' AND {H("'copy'", 'seed', 'CAST(round(f * 1000) AS INT)', 'item_id')} / 4294967296.0::DOUBLE < f),
  fit AS (SELECT run, norm, y FROM m, r WHERE split <> 'test' AND norm <> '' UNION ALL SELECT * FROM c),
  ans AS (SELECT run, norm, y AS answer FROM (SELECT run, norm, y, row_number() OVER (PARTITION BY run, norm ORDER BY count(*) DESC, y) AS rn FROM fit GROUP BY 1, 2, 3) WHERE rn = 1),
  l AS (SELECT t.run, t.kind, t.f, t.seed, t.y, ans.answer IS NOT NULL AS dup, coalesce(CAST(ans.answer = t.y AS INT), 0) AS ok FROM t LEFT JOIN ans USING (run, norm)),
  b AS (SELECT run, avg(x) AS bal FROM (SELECT run, y, avg(ok) AS x FROM l GROUP BY 1, 2) GROUP BY 1),
  runs AS (SELECT l.run, kind, f, CAST(seed AS BIGINT) AS seed, count(*) AS n_test, avg(CAST(dup AS INT)) AS dup_share, avg(ok) AS leaky_share, any_value(bal) AS leaky_share_balanced FROM l JOIN b USING (run) GROUP BY ALL)"""


@query(f"WITH {_COPIES} SELECT run, kind, round(f, 6) AS f, seed, n_test, round(dup_share, 6) AS dup_share, round(leaky_share, 6) AS leaky_share, round(leaky_share_balanced, 6) AS leaky_share_balanced FROM runs")
def planted_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6's lookup with copies of test rows planted among the train rows at every rate, with their labels and with others."""
    return rounded(calibration.d6_runs(_items(spark, sf_dir), SHARES, SEEDS, CLASSES))


@query(
    f"""WITH {_COPIES}, x AS (SELECT kind, leaky_share - (SELECT leaky_share FROM runs WHERE kind = 'base') AS excess FROM runs), g AS (SELECT unnest({list(calibration.D6_GRID)}::DOUBLE[]) AS t),
  q AS (SELECT t, avg(CASE WHEN kind <> 'leak' THEN CAST(excess >= t AS DOUBLE) END) AS false_flag, avg(CASE WHEN kind = 'leak' THEN CAST(excess >= t AS DOUBLE) END) AS detect FROM x, g GROUP BY t)
  SELECT round(t, 6) AS t, round(false_flag, 6) AS false_flag, round(detect, 6) AS detect, t = coalesce((SELECT min(t) FROM q WHERE false_flag <= {calibration.MOST_FALSE}), (SELECT max(t) FROM q)) AS chosen FROM q"""
)
def calibration_d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From planted copies to D6's threshold: the excess over the run without any, at every threshold."""
    runs = calibration.d6_runs(_items(spark, sf_dir), SHARES, SEEDS, CLASSES)
    base = runs.where("kind = 'base'").select(F.col("leaky_share").alias("base"))
    return rounded(calibration.thresholds(runs.join(base).withColumn("excess", F.col("leaky_share") - F.col("base")), "excess", calibration.D6_GRID, F.lit(True)))


@query()
def calibration_d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From planted cues to D3's threshold: shape models fitted anew on every run, false flags and detections at every threshold."""
    runs = calibration.d3_runs(_items(spark, sf_dir), CLASSES, RHOS, SEEDS)
    return rounded(calibration.thresholds(runs, "d3_lift", calibration.D3_GRID, F.col("oracle_lift") >= 0.10))


@query()
def within_source_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 of the texts against the label and D4 of the source, within every language, and D3 over all of them."""
    rows = labelled(spark, sf_dir)
    shaped = text.with_shape(rows, F.col("text"), "item_id", "split", "y", F.coalesce("lang", F.lit("")).alias("lang"))
    every = shaped.unionByName(shaped.withColumn("lang", F.lit("all")))
    d3 = learners.d3_by(every, "lang", CLASSES).select("lang", "n_test", "lift", "level", F.col("verdict").alias("d3"))
    d4 = learners.d4_by(rows.withColumn("lang", F.coalesce("lang", F.lit(""))), "lang", "text", "source", "label").select("lang", "sources", "auc", "v", F.col("verdict").alias("d4"))
    return rounded(d3.join(d4, "lang", "left"))


@query()
def known_answer_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 and S2 on fitted systems: one that reads the other half of the vectors as well, which its baseline lacks, and one that reads the
    same half twice. The former should be flagged, the latter not."""
    e, seeds = embedded(spark, sf_dir), [1, 2, 3]
    half = {"one": F.slice("vec", 1, 32), "other": F.slice("vec", 33, 32)}
    bits = lambda s: F.when(F.col("split") == s, (1 << 2 * len(seeds)) - 1).otherwise(0)
    scored = e.where("split = 'test'").select("item_id", "y", *(x.alias(n) for n, x in half.items()))
    for name, x in half.items():
        known = e.where("split <> 'test'").select(x.alias("x"), "y", bits("train").alias("fit"), bits("val").alias("check"))
        # two models a seed: the neural part, and the other part where it reads the same half
        models, _ = classifier.fit(known, 10, 2 * len(seeds), hidden=16, seed=[*seeds, *(s + 100 for s in seeds)], steps=40)
        for i in range(2 * len(seeds)):
            scored = scored.withColumn(f"{name}{i}", vectors.log_softmax(classifier.logits(models, F.col(name), F.lit(i))))
    mean = lambda a, b: vectors.argmax(F.zip_with(a, b, lambda p, q: p + q))
    n = len(seeds)
    each = F.array(*(F.struct(F.lit(s).cast("long").alias("seed"), vectors.argmax(F.col(f"one{i}")).alias("pb"), mean(f"one{i}", f"other{i}").alias("rich"), mean(f"one{i}", f"one{i + n}").alias("same")) for i, s in enumerate(seeds)))
    rows = scored.select("item_id", "y", F.explode(each).alias("r")).select("item_id", "y", "r.*")
    placed = rows.join(resampling.positions(rows), "item_id")
    part = lambda control, config, pa: placed.select(F.lit(control).alias("control"), F.lit(config).alias("config"), "seed", "pos", "y", F.col(pa).alias("pa"), "pb")
    pred = part("positive", "as built", "rich").unionByName(part("positive", "equal", "same")).unionByName(part("negative", "equal", "same"))
    table = lambda rows: spark.createDataFrame(rows, "component string, input string")
    inputs = {"positive": (table([("N", "one"), ("P", "other")]), ["one", "other"]), "negative": (table([("N", "one"), ("P", "one")]), ["one"])}
    return tasks.controls(pred, scored.count(), 10, inputs)
