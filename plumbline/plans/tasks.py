"""Queries over tasks: registry, status, dispatch, controls, comparisons, pools and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import duplicates, learners, resampling, tasks
from plumbline.plans import data_tier, symbolic, system_tier  # noqa: F401  their SQL is read below
from plumbline.plans.fixtures import CLASSES, EMBEDDED_SQL, LABELLED_SQL, NORM, PRED_SQL, embedded, labelled, manifest, predictions
from plumbline.plans.registry import ORACLES, query, rounded

#: Tasks over the labelled documents: the column that is the label.
TASKS = {"toxicity": "toxic", "quality": "quality", "both": "quality + 2 * toxic"}


def registry(spark: SparkSession, sf_dir: str) -> tasks.Registry:
    from plumbline.sources.manifest import table

    out = tasks.Registry()
    rows = labelled(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "item_id"), "item_id")
    for name, label in TASKS.items():
        out.put(name, lambda label=label: rows.select("item_id", F.expr(label).cast("long").alias("y"), "split", "text"))
    return out


_ITEMS = f"WITH {LABELLED_SQL}, items AS (" + " UNION ALL ".join(f"SELECT '{n}' AS task, item_id, CAST({e} AS BIGINT) AS y, split FROM labelled JOIN labels ON doc_id = item_id" for n, e in TASKS.items()) + ")"


@query(
    f"""{_ITEMS}, c AS (SELECT task, y, count(*) FILTER (WHERE split <> 'test') AS fit, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test FROM items GROUP BY 1, 2),
  s AS (SELECT task, max(y) + 1 AS k, CAST(sum(train) AS BIGINT) AS train, CAST(sum(val) AS BIGINT) AS val, CAST(sum(test) AS BIGINT) AS test, arg_max(test, fit * 1000 - y) AS hit FROM c GROUP BY 1)
  SELECT task, k, train, val, test, round(CASE WHEN hit + test > 0 THEN 2 * hit / (hit + test) ELSE 0 END / k, 6) AS majority_f1 FROM s"""
)
def task_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tasks.sizes(registry(spark, sf_dir).items()))


@query()
def shape_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 of every task, with intervals."""
    return rounded(tasks.screen(registry(spark, sf_dir), {"toxicity": 0.9, "quality": 0.9}))


@query(f"WITH {LABELLED_SQL} SELECT item_id, CASE lang WHEN 'fr' THEN 0 ELSE 1 END AS y, split FROM labelled WHERE lang IN ('fr', 'en')")
def restricted_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tasks.restricted(labelled(spark, sf_dir), ["fr", "en"], "lang").select("item_id", "y", "split"))


@query(
    f"""WITH {LABELLED_SQL}, c AS (SELECT 'toxic' AS condition, min(item_id) AS item_id FROM labelled WHERE label = 'toxic' UNION ALL SELECT 'long', min(item_id) FROM labelled WHERE length(text) > 3000 UNION ALL SELECT 'none', min(item_id) FROM labelled WHERE lang = 'xx')
  SELECT condition, c.item_id, lang FROM c JOIN labelled l ON l.item_id = c.item_id"""
)
def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    found = tasks.first_examples(rows, {"toxic": F.col("label") == "toxic", "long": F.length("text") > 3000, "none": F.col("lang") == "xx"}, ["item_id"])
    return found.select("condition", "item_id", "lang")


@query(
    f"""WITH c AS (SELECT * FROM ({ORACLES['dup_components']})), g AS (SELECT component, count(*) AS n FROM c GROUP BY 1)
  SELECT count(*) AS n_groups, max(n) AS largest_group, CAST(sum(n) AS BIGINT) AS n_items, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS share_in_multi_groups FROM g"""
)
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.plans.registry import QUERIES

    return rounded(tasks.group_sizes(QUERIES["dup_components"](spark, sf_dir)))


_STATE = "CASE WHEN item_id % 7 = 0 THEN 'CONTESTED' WHEN item_id % 3 = 0 THEN 'SUPPORTED' ELSE 'SILENT' END"


@query(
    f"""WITH {PRED_SQL}, r AS (SELECT seed, {_STATE} AS state, y, pa FROM pred), t AS (SELECT seed, count(*) AS total FROM r GROUP BY 1), p AS (SELECT seed, state, count(*) AS n, avg(CAST(y <> pa AS DOUBLE)) AS err FROM r GROUP BY 1, 2)
  SELECT state, round(avg(n / total), 6) AS share, round(avg(err), 6) AS error_rate FROM p JOIN t USING (seed) GROUP BY 1"""
)
def evidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tasks.evidence_table(predictions(spark, sf_dir).select("seed", F.expr(_STATE).alias("state"), "y", F.col("pa").alias("pred"))))


_WORDS = ("the", "und", "que", "license")


@query(
    f"""WITH {LABELLED_SQL}, w AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM labelled), f AS (SELECT word FROM w GROUP BY 1 HAVING count(*) >= 10)
  SELECT item_id, count(*) AS kept, md5(string_agg(word, ' ' ORDER BY word)) AS words_md5 FROM w WHERE word IN (SELECT word FROM f) OR word IN {_WORDS} GROUP BY 1"""
)
def naming_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tasks.naming_words(labelled(spark, sf_dir), "text", spark.createDataFrame([(w,) for w in _WORDS], "word string"))
    return found.groupBy("item_id").agg(F.count("*").alias("kept"), F.md5(F.array_join(F.array_sort(F.collect_list("word")), " ")).alias("words_md5"))


_PHRASES = ("of the", "license", "que de", "und die", "idiot")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, rows = embedded(spark, sf_dir), labelled(spark, sf_dir)
    terms = spark.createDataFrame([(p,) for p in _PHRASES], "term string")
    heads = e.where(F.col("item_id") < len(_PHRASES)).select(F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("item_id") + 1).cast("int")).alias("term"), "vec")
    centres = e.groupBy("y").agg(F.min_by("vec", "item_id").alias("vec")).select(F.concat(F.lit("c"), F.col("y").cast("string")).alias("name"), "vec")
    return tasks.predicate_pool(rows, "text", terms, e.select("item_id", "vec"), heads, centres)


_POOL = f"""WITH {LABELLED_SQL}, {EMBEDDED_SQL}, ph AS (SELECT unnest({list(_PHRASES)}) AS term),
  n AS (SELECT item_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') || ' ' AS t FROM labelled),
  says AS (SELECT item_id, 'says' AS kind, term AS name, CAST(contains(t, ' ' || term || ' ') AS DOUBLE) AS value FROM n, ph),
  heads AS (SELECT {list(_PHRASES)}[item_id + 1] AS name, u AS v FROM unit WHERE item_id < {len(_PHRASES)}),
  cen AS (SELECT 'c' || y AS name, arg_min(u, item_id) AS v FROM unit GROUP BY y),
  pool AS (SELECT * FROM says UNION ALL SELECT item_id, 'sem', name, list_dot_product(u, v) FROM unit, heads UNION ALL SELECT item_id, 'ex', name, list_dot_product(u, v) FROM unit, cen)"""


@query(f"{_POOL} SELECT item_id, kind, count(*) AS predicates, round(sum(value), 6) AS total, round(max(value), 6) AS most FROM pool GROUP BY 1, 2")
def predicate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item and kind: how many predicates, their sum and the largest."""
    return rounded(_pool(spark, sf_dir).groupBy("item_id", "kind").agg(F.count("*").alias("predicates"), F.sum("value").alias("total"), F.max("value").alias("most")))


@query(f"{_POOL}, per AS (SELECT kind, name, avg(value) AS m FROM pool GROUP BY 1, 2) SELECT kind, count(*) AS predicates, round(avg(m), 6) AS mean, round(max(m), 6) AS most FROM per GROUP BY 1")
def pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tasks.pool_summary(_pool(spark, sf_dir)))


@query(
    f"""WITH {EMBEDDED_SQL}, l AS (SELECT b AS backbone, item_id, vec[b * 8 + 1 : b * 8 + 8] AS z FROM embedded, (SELECT unnest(range(8)) AS b)), m AS (SELECT *, list_max(z) AS hi FROM l)
  SELECT 'b' || backbone AS backbone, item_id, round(list_max(z) - hi - ln(list_sum(list_transform(z, lambda x: exp(x - hi)))), 6) AS best, round(z[1] - hi - ln(list_sum(list_transform(z, lambda x: exp(x - hi)))), 6) AS first FROM m"""
)
def backbone_log_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embedded(spark, sf_dir).select("item_id", F.posexplode(F.array(*(F.slice("vec", b * 8 + 1, 8) for b in range(8)))).alias("b", "logits"))
    lp = tasks.expert_log_probs(e.select(F.concat(F.lit("b"), F.col("b").cast("string")).alias("backbone"), "item_id", "logits"))
    return rounded(lp.select("backbone", "item_id", F.array_max("lc").alias("best"), F.get("lc", F.lit(0)).alias("first")))


@query()
def probe_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of each row's best class by a two-layer classifier on standardised vectors."""
    logits = learners.mlp_logits(embedded(spark, sf_dir).select("item_id", "vec", "y", "split"), 10)
    return rounded(tasks.expert_log_probs(logits.withColumn("backbone", F.lit("own"))).select("item_id", F.array_max("lc").alias("best_log_prob")))


@query(
    f"""WITH {PRED_SQL}, {system_tier._DRAWS}, {system_tier._C}, j AS (SELECT w.b, pred.seed, y, pa, pb, w.w FROM pred JOIN w USING (item_id)),
  one AS (SELECT -1 AS b, seed, y, pa, pb, 1 AS w FROM pred), al AS (SELECT * FROM j UNION ALL SELECT * FROM one),
  fa AS ({system_tier._f1('pa', 'w', 'al', 'b, seed')}), fb AS ({system_tier._f1('pb', 'w', 'al', 'b, seed')}),
  ac AS (SELECT b, seed, sum(CASE WHEN pa = y THEN w ELSE 0 END) / sum(w) AS a, sum(CASE WHEN pb = y THEN w ELSE 0 END) / sum(w) AS c FROM al GROUP BY 1, 2),
  s AS (SELECT b, avg(fa.f) AS f1_a, avg(fb.f) AS f1_b, avg(a) AS acc_a, avg(c) AS acc_b FROM fa JOIN fb USING (b, seed) JOIN ac USING (b, seed) GROUP BY 1),
  t AS (SELECT b, f1_a, f1_b, f1_a - f1_b AS d_f1, acc_a, acc_b, acc_a - acc_b AS d_acc FROM s), u AS (UNPIVOT t ON f1_a, f1_b, d_f1, acc_a, acc_b, d_acc INTO NAME metric VALUE v)
  SELECT metric, round(max(v) FILTER (WHERE b = -1), 6) AS mean, round(quantile_cont(v, 0.025) FILTER (WHERE b >= 0), 6) AS lo, round(quantile_cont(v, 0.975) FILTER (WHERE b >= 0), 6) AS hi FROM u GROUP BY 1"""
)
def six_metric_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = system_tier._placed(spark, sf_dir)
    return rounded(resampling.six_intervals(p, n, CLASSES, system_tier.REPS))


_INVENTORY = {"positive": [("N", "image"), ("N", "image text"), ("P", "post")], "negative": [("N", "image"), ("N", "image text"), ("P", "image"), ("P", "image text")]}


@query(
    f"""WITH b AS ({ORACLES['paired_bootstrap']}), f AS (SELECT CASE WHEN lo > 0 THEN 'FLAG' ELSE 'ok' END AS v FROM b WHERE metric = 'd_macro_f1')
  SELECT control, "check", verdict, expected, verdict = expected AS agrees FROM (
    SELECT 'positive' AS control, 'S1' AS "check", 'FLAG' AS verdict, 'FLAG' AS expected UNION ALL SELECT 'positive', 'S2', v, 'FLAG' FROM f UNION ALL SELECT 'negative', 'S1', 'ok', 'ok' UNION ALL SELECT 'negative', 'S2', 'ok', 'ok')"""
)
def known_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 and S2 on a system that reads an input its baseline lacks, and on one that doesn't."""
    p, n = system_tier._placed(spark, sf_dir)
    equal = p.withColumn("pa", F.col("pb"))
    pred = p.withColumns({"config": F.lit("as built"), "control": F.lit("positive")})
    for control in ("positive", "negative"):
        pred = pred.unionByName(equal.withColumns({"config": F.lit("equal"), "control": F.lit(control)}))
    inputs = {c: (spark.createDataFrame(rows, "component string, input string"), ["image", "image text", "post"]) for c, rows in _INVENTORY.items()}
    return tasks.controls(pred, n, CLASSES, inputs, system_tier.REPS)


#: Figures stated for the test tables: check, subject, value, tolerance. The last two must not agree: one is wrong, one is of nothing.
_EXPECTED = [
    ("rows", "labelled share", 0.40, 0.04), ("D1", "empty title", 0.0, 0.001), ("D1", "mean characters", 2478.0, 500.0), ("D2", "title == text", 0.02, 0.02),
    ("D6", "exact duplicates", 0.16, 0.08), ("labels", "toxic", 0.12, 0.03), ("labels", "majority F1", 0.47, 0.02), ("labels", "toxic, misstated", 0.30, 0.05), ("labels", "missing", 1.0, 0.1),
]


@query(
    f"""WITH {LABELLED_SQL}, tr AS (SELECT DISTINCT {NORM.format(t='text')} AS norm FROM manifest WHERE split <> 'test'), te AS (SELECT {NORM.format(t='text')} AS norm FROM manifest WHERE split = 'test'),
  top AS (SELECT label FROM labelled GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1), p AS (SELECT avg(CAST(label = (SELECT label FROM top) AS DOUBLE)) AS p FROM labelled),
  f("check", subject, found) AS (SELECT 'rows', 'labelled share', (SELECT count(*) FROM labelled) / (SELECT count(*) FROM manifest) UNION ALL SELECT 'D1', 'empty title', (SELECT avg(CAST(title = '' AS DOUBLE)) FROM manifest)
    UNION ALL SELECT 'D1', 'mean characters', (SELECT avg(length(text)) FROM manifest) UNION ALL SELECT 'D2', 'title == text', (SELECT avg(CAST(title = text AS DOUBLE)) FROM manifest)
    UNION ALL SELECT 'D6', 'exact duplicates', (SELECT avg(CAST(norm <> '' AND norm IN (SELECT norm FROM tr) AS DOUBLE)) FROM te) UNION ALL SELECT 'labels', 'toxic', (SELECT avg(CAST(label = 'toxic' AS DOUBLE)) FROM labelled)
    UNION ALL SELECT 'labels', 'majority F1', (SELECT p / (1 + p) FROM p) UNION ALL SELECT 'labels', 'toxic, misstated', (SELECT avg(CAST(label = 'toxic' AS DOUBLE)) FROM labelled)),
  e("check", subject, expected, tol) AS (VALUES {', '.join(f"('{a}', '{b}', {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in _EXPECTED)})
  SELECT e."check", e.subject, round(found, 6) AS found, expected, coalesce(abs(found - expected) <= tol + 1e-12, false) AS agrees FROM e LEFT JOIN f ON f."check" = e."check" AND f.subject = e.subject"""
)
def tool_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the checks against those stated, each within its tolerance."""
    rows, known = manifest(spark, sf_dir), labelled(spark, sf_dir)
    share = lambda c: F.avg(c.cast("double"))
    profile = rows.agg(F.count("*").alias("n"), share(F.col("title") == "").alias("empty"), F.avg(F.length("text")).alias("chars"), share(F.col("title") == F.col("text")).alias("equal"))
    labels = known.groupBy("label").count().agg(F.sum("count").alias("m"), (F.max("count") / F.sum("count")).alias("p"), (F.sum(F.when(F.col("label") == "toxic", F.col("count")).otherwise(0)) / F.sum("count")).alias("toxic"))
    test = rows.where("split = 'test'").count()
    copies = duplicates.exact_keys(rows).distinct().agg((F.count("*") / F.lit(float(max(test, 1)))).alias("copies"))
    figures = profile.join(labels).join(copies)
    stated = {("rows", "labelled share"): F.col("m") / F.col("n"), ("D1", "empty title"): F.col("empty"), ("D1", "mean characters"): F.col("chars"), ("D2", "title == text"): F.col("equal"), ("D6", "exact duplicates"): F.col("copies"),
              ("labels", "toxic"): F.col("toxic"), ("labels", "majority F1"): F.col("p") / (1 + F.col("p")), ("labels", "toxic, misstated"): F.col("toxic")}
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("check"), F.lit(b).alias("subject"), v.cast("double").alias("value")) for (a, b), v in stated.items()))).alias("r")
    return rounded(tasks.validate(figures.select(each).select("r.*"), spark.createDataFrame(_EXPECTED, "check string, subject string, value double, tol double")))


@query()
def calibration_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 on the quality task with a cue of form planted in none, half and all of one class."""
    return rounded(tasks.calibration_runs(registry(spark, sf_dir).items(["quality"]), 2, [0.0, 0.5, 1.0]))


@query(
    f"""WITH {LABELLED_SQL}, p AS ({ORACLES['phrase_mining']}), n AS (SELECT label, count(*) AS c FROM labelled GROUP BY 1), t AS (SELECT label FROM n ORDER BY c DESC, label LIMIT 1)
  SELECT class, rank, term FROM p WHERE class NOT IN (SELECT label FROM t)"""
)
def concept_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.concept_phrases(labelled(spark, sf_dir), "text", "label").select("class", "rank", "term")


@query(
    f"""WITH {LABELLED_SQL}, s AS (SELECT CAST(label = 'toxic' AS BIGINT) AS y, least(length(text) / 4000.0, 1.0)::DOUBLE AS s FROM labelled), g AS (SELECT i / 34.0::DOUBLE AS cut FROM (SELECT unnest(range(1, 34)) AS i)),
  c AS (SELECT cut, count(*) FILTER (WHERE y = 1 AND s >= cut) AS tp, count(*) FILTER (WHERE y = 0 AND s >= cut) AS fp, count(*) FILTER (WHERE y = 1 AND s < cut) AS fn, count(*) FILTER (WHERE y = 0 AND s < cut) AS tn FROM s, g GROUP BY 1),
  f AS (SELECT cut, round(((CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) + (CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END)) / 2, 12) AS f FROM c)
  SELECT round(cut, 6) AS cut, round(f, 6) AS macro_f1 FROM f ORDER BY f DESC, cut LIMIT 1"""
)
def best_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select((F.col("label") == "toxic").cast("long").alias("y"), F.least(F.length("text") / 4000.0, F.lit(1.0)).cast("double").alias("s"))
    return rounded(tasks.best_cut(rows, "s"))
