"""Queries of decision rules and inventories: each makes its statistics from the tables' rows and decides on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import metrics, rng, text, vectors
from plumbline.functions.tables import saved
from plumbline.operators import decisions, pooling, regimes, relations, review, system, tasks
from plumbline.plans import data_tier, symbolic
from plumbline.plans import tasks as task_plans
from plumbline.plans.fixtures import CLASSES, EMBEDDED_SQL, LABELLED_SQL, MANIFEST_SQL, PRED_SQL, embedded, labelled, manifest, predictions
from plumbline.plans.registry import query, rounded
from plumbline.sources.manifest import table

H = rng.draw_sql


def _each(values: range | tuple, name: str) -> Column:
    """A row for each of a few fixed values."""
    return F.explode(F.array(*(F.lit(v) for v in values))).alias(name)


def _macro_sql(source: str, by: str, k: int) -> str:
    """by, f (macro-F1), acc, n of rows with y and p."""
    return f"""SELECT {by}, avg(CASE WHEN d > 0 THEN 2 * tp / d ELSE 0.0 END) AS f, any_value(acc) AS acc, any_value(n) AS n FROM (
    SELECT {by}, class, sum(CAST(y = class AND p = class AS INT)) AS tp, sum(CAST(y = class AS INT)) + sum(CAST(p = class AS INT)) AS d, avg(CAST(y = p AS DOUBLE)) AS acc, count(*) AS n FROM {source}, (SELECT unnest(range({k})) AS class) GROUP BY {by}, class) GROUP BY {by}"""


@query(
    f"""WITH {MANIFEST_SQL}, d AS (SELECT 'title' AS field, CASE WHEN title = text THEN 'whole text' ELSE 'first 80 characters' END AS method FROM manifest UNION ALL SELECT 'text', 'as crawled' FROM manifest),
  w(field) AS (VALUES ('title'), ('text'), ('caption')), m AS (SELECT field, list_sort(list_distinct(list(method))) AS m FROM d GROUP BY 1)
  SELECT w.field, CASE WHEN m IS NULL THEN 'note' WHEN len(m) > 1 THEN 'FLAG' ELSE 'ok' END AS verdict,
    CASE WHEN m IS NULL THEN 'provenance not declared' WHEN len(m) > 1 THEN 'produced differently across sources: ' || array_to_string(m, ' | ')
      ELSE 'one production method for every source' END AS why FROM w LEFT JOIN m USING (field)"""
)
def d1_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every row's fields were produced."""
    title = F.when(F.col("title") == F.col("text"), "whole text").otherwise("first 80 characters")
    each = F.explode(F.array(F.struct(F.lit("title").alias("field"), title.alias("method")), F.struct(F.lit("text").alias("field"), F.lit("as crawled").alias("method")))).alias("s")
    return relations.provenance(manifest(spark, sf_dir).select("source", each).select("source", "s.*"), ["title", "text", "caption"])


@query(
    f"""WITH {LABELLED_SQL}, c AS (SELECT lang, label, count(*) AS k FROM labelled GROUP BY 1, 2), g AS (SELECT lang, label, k / sum(k) OVER (PARTITION BY lang) AS base, CAST(sum(k) OVER (PARTITION BY lang) AS BIGINT) AS n FROM c),
  e AS (SELECT *, unnest(range(1, n + 1)) AS k FROM g), t AS (SELECT *, {data_tier._tail_sql('k', 'n', 'base')} AS lp FROM e WHERE k >= n * 0.95 - 1e-9),
  m AS (SELECT lang, label, min(k) FILTER (WHERE lp <= log10(1e-3)) AS k_min FROM t GROUP BY 1, 2)
  SELECT g.lang, g.label, round(g.base, 6) AS base, g.n, m.k_min, round(t.lp, 6) AS log10_rate FROM g JOIN m USING (lang, label) LEFT JOIN t ON t.lang = m.lang AND t.label = m.label AND t.k = m.k_min"""
)
def d2_false_flag_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of a language must share a label before D2 would flag a relation that holds for all of them."""
    cells = labelled(spark, sf_dir).groupBy("lang", "label").agg(F.count("*").alias("k"))
    total = cells.groupBy("lang").agg(F.sum("k").alias("n"))
    grid = cells.join(total, "lang").select("lang", "label", (F.col("k") / F.col("n")).alias("base"), "n")
    return rounded(relations.false_flag_rates(grid))


#: Rows that a language must have before a text reference counts.
_LEAST = 60
_LEVELS = f"""WITH {LABELLED_SQL}, s3 AS (SELECT lang || '-' || seed AS task, lang, y, CASE WHEN {H("'shape'", 'seed', 'item_id')} % 100 < 22 * seed THEN 1 ELSE y END AS shape, CASE WHEN {H("'ref'", 'seed', 'item_id')} % 100 < 15 THEN (y + 1) % {CLASSES} ELSE y END AS ref
    FROM labelled, (SELECT unnest(range(5)) AS seed)),
  sides AS (SELECT task, lang, 'shape' AS side, y, shape AS p FROM s3 UNION ALL SELECT task, lang, 'majority', y, 1 FROM s3 UNION ALL SELECT task, lang, 'ref', y, ref FROM s3),
  mf AS ({_macro_sql('sides', 'task, lang, side', CLASSES)}),
  t AS (SELECT task, lang, round(max(f) FILTER (WHERE side = 'shape') - max(f) FILTER (WHERE side = 'majority'), 9) AS lift, CASE WHEN any_value(n) >= {_LEAST} THEN round(max(f) FILTER (WHERE side = 'shape') / max(f) FILTER (WHERE side = 'ref'), 9) END AS share FROM mf GROUP BY 1, 2)"""
_LEVEL = "CASE WHEN share IS NOT NULL AND lift >= {0} AND share >= 0.85 THEN 'severe' WHEN share IS NOT NULL AND lift >= {1} AND share >= 0.75 THEN 'notable' WHEN lift < {2} THEN 'clean' ELSE '' END"
_D3 = f"{_LEVELS}, l AS (SELECT *, {_LEVEL.format(0.30, 0.15, 0.10)} AS level FROM t), vd AS (SELECT task, lang, level, CASE WHEN level IN ('severe', 'notable') THEN 'FLAG' WHEN level = 'clean' THEN 'ok' ELSE 'note' END AS verdict FROM l)"


def _lifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task, lang, lift, share: a system that falls back on the commonest class more and more often, in each language."""
    rows = labelled(spark, sf_dir).select("lang", "item_id", "y", _each(range(5), "seed"))
    d = lambda side: rng.draw(side, F.col("seed"), F.col("item_id")) % 100
    shape = F.when(d("shape") < 22 * F.col("seed"), 1).otherwise(F.col("y"))
    ref = F.when(d("ref") < 15, (F.col("y") + 1) % CLASSES).otherwise(F.col("y"))
    sides = F.explode(F.array(*(F.struct(F.lit(n).alias("side"), p.cast("long").alias("pred")) for n, p in (("shape", shape), ("majority", F.lit(1)), ("ref", ref))))).alias("s")
    each = rows.select(F.concat_ws("-", "lang", "seed").alias("task"), "lang", "y", sides).select("task", "lang", "y", "s.*")
    cells = metrics.confusion(each, ["task", "lang", "side"])
    f1 = metrics.macro(cells, ["task", "lang", "side"], CLASSES).join(cells.groupBy("task", "lang", "side").agg(F.sum("n").alias("n")), ["task", "lang", "side"])
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("macro_f1")))
    return f1.groupBy("task", "lang").agg(F.round(of("shape") - of("majority"), 9).alias("lift"), F.when(F.max("n") >= _LEAST, F.round(of("shape") / of("ref"), 9)).alias("share"))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lifts(spark, sf_dir).withColumn("level", decisions.d3_level(F.col("lift"), F.col("share")))
    return rows.select("task", "lang", "level", decisions.d3_verdict(F.col("level")).alias("verdict"))


@query(f"{_D3} SELECT task, level, verdict FROM vd")
def d3_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("task", "level", "verdict")


@query(f"{_D3} SELECT lang AS task, CASE WHEN bool_or(verdict = 'FLAG') THEN 'FLAG' WHEN bool_or(verdict = 'ok') THEN 'ok' ELSE 'note' END AS verdict FROM vd GROUP BY 1")
def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).groupBy(F.col("lang").alias("task")).agg(relations.worst(F.col("verdict")).alias("verdict"))


@query(
    f"""{_LEVELS}, g AS (SELECT unnest(range(500, 1501, 5)) / 1000 AS m), e AS (
    SELECT task, m, {_LEVEL.format('least(0.30::DOUBLE * m, 1.0)', 'least(0.15::DOUBLE * m, 1.0)', 'least(0.10::DOUBLE * m, 1.0)')} <> {_LEVEL.format(0.30, 0.15, 0.10)} AS changed FROM t, g)
  SELECT task, max(m) FILTER (WHERE m < 1 AND changed) AS below, min(m) FILTER (WHERE m > 1 AND changed) AS above FROM e GROUP BY 1"""
)
def flip_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decisions.flip_points(_lifts(spark, sf_dir)))


_D4 = f"""WITH {LABELLED_SQL}, r AS (SELECT lang || '-' || seed AS task, length(text) AS n, CAST(length(text) > 400 AS BIGINT) AS y, CASE WHEN seed = 5 THEN 0 WHEN {H("'source'", 'seed', 'item_id')} % 100 < 25 * seed THEN CAST(length(text) > 400 AS BIGINT) ELSE {H("'coin'", 'seed', 'item_id')} % 2 END AS g FROM labelled, (SELECT unnest(range(6)) AS seed)),
  k AS (SELECT task, n, g, rank() OVER (PARTITION BY task ORDER BY n) + (count(*) OVER (PARTITION BY task, n) - 1) / 2 AS rk FROM r),
  a AS (SELECT task, count(DISTINCT g) AS sources, sum(g) AS p, count(*) - sum(g) AS q, sum(rk * g) AS w FROM k GROUP BY 1), o AS (SELECT task, g, y, count(*) AS o FROM r GROUP BY ALL),
  c AS (SELECT task, o, sum(o) OVER (PARTITION BY task, g) AS ra, sum(o) OVER (PARTITION BY task, y) AS cb FROM o), l AS (SELECT task, least(count(DISTINCT g), count(DISTINCT y)) - 1 AS d FROM o GROUP BY 1),
  v AS (SELECT task, CASE WHEN any_value(d) > 0 THEN sqrt(greatest(sum(o * o / (ra * cb)) - 1, 0) / any_value(d)) ELSE 0.0 END AS v FROM c JOIN l USING (task) GROUP BY 1),
  s AS (SELECT task, sources, CASE WHEN p > 0 AND q > 0 THEN round((w - p * (p + 1) / 2) / (p * q), 9) END AS auc, round(v, 9) AS v FROM a JOIN v USING (task))
  SELECT task, round(auc, 6) AS auc, round(v, 6) AS v, sources, CASE WHEN sources < 2 THEN 'note' WHEN auc >= 0.8 AND v >= 0.5 THEN 'FLAG' ELSE 'ok' END AS verdict FROM s"""


@query(_D4)
def d4_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources planted to follow the texts' length by rate, in each language: the last rate has one source only."""
    seed, long = F.col("seed"), (F.length("text") > 400).cast("long")
    planted = F.when(seed == 5, 0).when(rng.draw("source", seed, F.col("item_id")) % 100 < 25 * seed, long).otherwise(rng.draw("coin", seed, F.col("item_id")) % 2)
    rows = labelled(spark, sf_dir).select("lang", "item_id", "text", _each(range(6), "seed")).select(F.concat_ws("-", "lang", "seed").alias("task"), F.length("text").alias("n"), long.alias("y"), planted.cast("long").alias("g"))
    auc, v = metrics.auc(rows, ["task"], "n", F.col("g") == 1), metrics.cramers_v_by(rows, "task", "g", "y")
    sources = rows.groupBy("task").agg(F.countDistinct("g").alias("sources"))
    found = auc.join(v, "task").join(sources, "task").select("task", F.round("auc", 9).alias("auc"), F.round("v", 9).alias("v"), "sources")
    return rounded(found.withColumn("verdict", decisions.d4_verdict(F.col("auc"), F.col("v"), F.col("sources"))))


#: Components of each half of a vector that an encoder sees, and how many halves' seeds there are.
_WIDTHS, _HALF, _DRAWN = {"small": 8, "large": 32}, 32, 3
_D5 = f"""WITH {EMBEDDED_SQL}, w(encoder, enc_order, width) AS (VALUES {', '.join(f"('{e}', {i}, {n})" for i, (e, n) in enumerate(_WIDTHS.items()))}), vw(view) AS (VALUES ('image'), ('text'), ('both')),
  v AS (SELECT item_id, y, split, encoder, enc_order, view, CASE view WHEN 'image' THEN vec[1 : width] WHEN 'text' THEN vec[{_HALF + 1} : {_HALF} + width] ELSE list_concat(vec[1 : width], vec[{_HALF + 1} : {_HALF} + width]) END AS x FROM embedded, w, vw),
  tr AS (SELECT encoder, view, seed, y, x FROM v, (SELECT unnest(range({_DRAWN})) AS seed) WHERE split = 'train' AND {H("'half'", 'seed', 'item_id')} % 2 = 0),
  av AS (SELECT encoder, view, seed, y, i, avg(x[i]) AS a FROM tr, (SELECT unnest(range(1, 65)) AS i) WHERE i <= len(x) GROUP BY ALL), mn AS (SELECT encoder, view, seed, y AS class, list(a ORDER BY i) AS c FROM av GROUP BY ALL),
  sc AS (SELECT item_id, v.encoder, enc_order, v.view, seed, v.y, class, round(list_dot_product(x, c) / (sqrt(list_dot_product(c, c)) + 1e-8), 9) AS s FROM v JOIN mn ON mn.encoder = v.encoder AND mn.view = v.view WHERE split = 'test'),
  pr AS (SELECT encoder, enc_order, view, seed, y, class AS p FROM (SELECT *, row_number() OVER (PARTITION BY item_id, encoder, view, seed ORDER BY s DESC, class) AS rn FROM sc) WHERE rn = 1),
  fs AS ({_macro_sql('pr', 'encoder, enc_order, view, seed', 10)}),
  m AS (SELECT encoder, enc_order, view, avg(f) AS f FROM fs GROUP BY ALL), p AS (SELECT encoder, enc_order, max(f) FILTER (WHERE view = 'image') AS fi, max(f) FILTER (WHERE view = 'text') AS ft, max(f) FILTER (WHERE view = 'both') AS fb FROM m GROUP BY 1, 2),
  cl AS (SELECT *, fb - ft AS vi, fb - fi AS vt FROM p), k AS (SELECT max_by(vi, enc_order) AS si, min_by(vi, enc_order) AS wi, max_by(vt, enc_order) AS st, min_by(vt, enc_order) AS wt FROM cl),
  b AS (SELECT f, encoder, view FROM m WHERE view <> 'both' ORDER BY f DESC, encoder DESC, view DESC LIMIT 1)
  SELECT CASE WHEN si < 0.01 THEN 'adds little under the strongest encoder' WHEN wi < 0.01 THEN 'encoder-limited' ELSE 'contributes under every encoder' END AS image_claim,
    CASE WHEN st < 0.01 THEN 'adds little under the strongest encoder' WHEN wt < 0.01 THEN 'encoder-limited' ELSE 'contributes under every encoder' END AS text_claim,
    round(CAST(f AS DOUBLE), 6) AS best_single, encoder AS best_encoder, view AS best_view, CASE WHEN f >= 0.9 THEN 'FLAG' ELSE 'ok' END AS verdict FROM k, b"""


@query(_D5)
def d5_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 by nearest class means: halves of the vectors are the modalities, short and whole halves the encoders, drawn halves of the train rows the seeds."""
    half = lambda at, n: F.slice("vec", at, n)
    views = lambda n: {"image": half(1, n), "text": half(_HALF + 1, n), "both": F.concat(half(1, n), half(_HALF + 1, n))}
    sides = [F.struct(F.lit(e).alias("encoder"), F.lit(i).alias("enc_order"), F.lit(v).alias("view"), x.alias("x")) for i, (e, n) in enumerate(_WIDTHS.items()) for v, x in views(n).items()]
    v = embedded(spark, sf_dir).select("item_id", "y", "split", F.explode(F.array(*sides)).alias("s")).select("item_id", "y", "split", "s.*")
    train = v.where("split = 'train'").select("*", _each(range(_DRAWN), "seed")).where(rng.draw("half", F.col("seed"), F.col("item_id")) % 2 == 0)
    means = vectors.mean_vector(train, ["encoder", "view", "seed", "y"], "x")
    # ten classes, three seeds and six views of at most 64 numbers
    bank = means.groupBy("encoder", "view", "seed").agg(F.collect_list(F.struct((-F.col("y")).alias("n"), F.col("mean").alias("m"))).alias("bank"))
    scored = v.where("split = 'test'").join(F.broadcast(bank), ["encoder", "view"])
    score = lambda c: F.round(vectors.dot(F.col("x"), c["m"]) / (vectors.norm(c["m"]) + 1e-8), 9)
    best = F.array_max(F.transform("bank", lambda c: F.struct(score(c).alias("s"), c["n"].alias("n"))))
    cells = metrics.confusion(scored.select("encoder", "enc_order", "view", "seed", "y", (-best["n"]).alias("pred")), ["encoder", "enc_order", "view", "seed"])
    return rounded(decisions.d5_decide(metrics.macro(cells, ["encoder", "enc_order", "view", "seed"], 10)))


_GRID = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35]
_CAL = f"""WITH {MANIFEST_SQL}, pl AS (SELECT lang AS task, kind, s, CASE WHEN kind = 'control' THEN 2 + s ELSE 6 * (s + 1) END AS rate, item_id FROM manifest, (SELECT unnest(['control', 'leak']) AS kind), (SELECT unnest(range(6)) AS s)),
  c AS (SELECT task, kind, s, rate / 100 AS oracle, avg(CAST({H("'plant'", 'kind', 's', 'item_id')} % 100 < rate AS DOUBLE)) AS stat FROM pl GROUP BY ALL)"""


def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task (a language), kind, s, oracle, stat: cues planted in controls and leaks by rate, and the share of rows in which they are found."""
    rows = manifest(spark, sf_dir).select(F.col("lang").alias("task"), "item_id", _each(("control", "leak"), "kind")).select("*", _each(range(6), "s"))
    rate = F.when(F.col("kind") == "control", 2 + F.col("s")).otherwise(6 * (F.col("s") + 1))
    hit = rng.draw("plant", F.col("kind"), F.col("s"), F.col("item_id")) % 100 < rate
    return rows.groupBy("task", "kind", "s", (rate / 100).alias("oracle")).agg(F.avg(hit.cast("double")).alias("stat"))


@query(f"{_CAL}, g AS (SELECT unnest({_GRID}::DOUBLE[]) AS t) SELECT kind, t, round(avg(CAST(stat >= t AS DOUBLE)), 6) AS rate FROM c, g GROUP BY 1, 2")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decisions.threshold_rates(_calibration(spark, sf_dir), _GRID, "stat", ["kind"]))


@query(
    f"""{_CAL}, g AS (SELECT unnest({_GRID}::DOUBLE[]) AS t), k AS (SELECT * FROM c WHERE kind = 'control'), h AS (SELECT DISTINCT task FROM k),
  r AS (SELECT h.task, t, avg(CAST(stat >= t AS DOUBLE)) AS f FROM h, g, k WHERE k.task <> h.task GROUP BY 1, 2), b AS (SELECT task, min(t) FILTER (WHERE f <= 0.05) AS t FROM r GROUP BY 1)
  SELECT b.task AS held_out, b.t, round((SELECT avg(CAST(stat >= b.t AS DOUBLE)) FROM k WHERE k.task = b.task), 6) AS rate FROM b"""
)
def loo_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decisions.leave_one_out_threshold(_calibration(spark, sf_dir), _GRID, "stat"))


@query(f"{_CAL} SELECT task, round(regr_slope(stat, oracle), 6) AS slope FROM c GROUP BY 1")
def recovery_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decisions.recovery_slope(_calibration(spark, sf_dir), ["task"], "stat", "oracle"))


@query(
    """WITH c AS (SELECT DISTINCT source AS class FROM documents WHERE source IS NOT NULL), t(kind, place, a, b) AS (VALUES ('context', 0, 'a ', ''), ('context', 1, 'a ', ' scene'), ('context', 2, 'a photo of a ', ' setting'),
  ('stereotype', 0, 'a woman in a ', ' setting'), ('stereotype', 1, 'a woman engaged in ', ''), ('stereotype', 2, 'a meme about a woman and ', ''))
  SELECT class || '_' || kind AS predicate, CAST(place AS BIGINT) AS place, a || class || b AS prompt FROM c, t"""
)
def prompt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of a predicate for every source."""
    return regimes.prompts(manifest(spark, sf_dir).where("source IS NOT NULL").select(F.col("source").alias("class")).distinct())


_WHOLE = "CAST(CAST(floor(value) AS BIGINT) AS STRING)"


@query(
    """SELECT event_id, event_id % 4 IN (0, 3) AS negated, CASE event_id % 4 WHEN 1 THEN 'says:"' || event_type || '"' WHEN 2 THEN 'b>' || event_type ELSE event_type END AS feature,
    CASE event_id % 4 WHEN 0 THEN floor(value) + 0.5 WHEN 2 THEN -(floor(value) + 0.25) END AS cut FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL"""
)
def literal_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals of four forms written from every event, and read again."""
    forms = {0: f"concat('NOT ', event_type, '>', {_WHOLE}, '.5')", 1: """concat('says:"', event_type, '"')""", 2: f"concat('b>', event_type, '>-', {_WHOLE}, '.25')", 3: "concat('NOT ', event_type)"}
    name = F.expr("CASE event_id % 4 " + " ".join(f"WHEN {k} THEN {e}" for k, e in forms.items()) + " END")
    rows = table(spark, sf_dir, "events").where("event_type IS NOT NULL AND value IS NOT NULL").select("event_id", text.parsed_literal(name).alias("p"))
    return rows.select("event_id", "p.*")


@query(f"SELECT doc_id AS item_id, a AS answer, CAST(i AS BIGINT) AS i, round(ln(CASE WHEN a IS NULL THEN 0.25 ELSE 0.05 + CASE WHEN i = a THEN 0.8 ELSE 0 END END), 6) AS lp FROM (SELECT doc_id, CASE WHEN {H(chr(39) + 'silent' + chr(39), 'doc_id')} % 5 > 0 THEN CAST(quality + 2 * toxic AS BIGINT) END AS a FROM labels), (SELECT unnest(range({CLASSES})) AS i)")
def answer_log_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document's answer, a fifth of them missing, as log probabilities."""
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.when(rng.draw("silent", F.col("doc_id")) % 5 > 0, F.col("quality") + 2 * F.col("toxic")).alias("answer"))
    return rounded(rows.select("item_id", "answer", F.posexplode(pooling.answer_log_probs(F.col("answer"), CLASSES)).alias("i", "lp")))


_READS = "CASE user_id % 3 WHEN 0 THEN 'encoder' WHEN 1 THEN 'rules' ELSE 'probe' END"
_HERE = ("click", "view", "signup", "purchase")


@query(
    f"""WITH c AS (SELECT {_READS} AS component, event_type AS input FROM events WHERE event_type IS NOT NULL AND NOT (user_id % 3 = 2 AND event_type = 'purchase')),
  s AS (SELECT DISTINCT input FROM c WHERE component IN ('encoder', 'rules')), b AS (SELECT DISTINCT input FROM c WHERE component = 'probe'),
  l AS (SELECT (SELECT list_sort(list(input)) FROM s) AS system_inputs, (SELECT list_sort(list(input)) FROM b) AS baseline_inputs, coalesce((SELECT list_sort(list(input)) FROM s WHERE input NOT IN (SELECT input FROM b)), []) AS o, coalesce((SELECT list_sort(list(input)) FROM s WHERE input NOT IN {_HERE}), []) AS u)
  SELECT array_to_string(system_inputs, ',') AS system_inputs, array_to_string(baseline_inputs, ',') AS baseline_inputs, array_to_string(o, ',') AS only_in_system, array_to_string(u, ',') AS unavailable_at_inference,
    CASE WHEN len(o) > 0 OR len(u) > 0 THEN 'FLAG' ELSE 'ok' END AS verdict FROM l"""
)
def s1_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each component of a system has read, from a log of its reads; the probe's log leaves out one input."""
    log = table(spark, sf_dir, "events").where("event_type IS NOT NULL AND NOT (user_id % 3 = 2 AND event_type = 'purchase')")
    out = system.s1_inventory(log.select(F.expr(_READS).alias("component"), F.col("event_type").alias("input")), ["encoder", "rules"], ["probe"], list(_HERE))
    return out.select(*(F.array_join(c, ",").alias(c) if c != "verdict" else F.col(c) for c in out.columns))


_WRONG = {"equal": 14, "caption": 30, "ocr": 18, "none": 9}


@query(
    f"""WITH {PRED_SQL}, w(config, wrong) AS (VALUES {', '.join(f"('{c}', {n})" for c, n in _WRONG.items())}),
  m AS (SELECT config, seed, avg(CAST(pa = y AS DOUBLE)) - avg(CAST({H("'base'", 'config', 'seed', 'item_id')} % 100 >= wrong AS DOUBLE)) AS d FROM pred, w GROUP BY ALL),
  e AS (SELECT seed, d AS eq FROM m WHERE config = 'equal'),
  t AS (SELECT config, round(avg(d), 9) AS margin, round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)), 9) AS margin_lo, CASE WHEN config <> 'equal' THEN round(avg(d - eq) - 1.96 * stddev_samp(d - eq) / sqrt(count(*)), 9) END AS swing_lo FROM m JOIN e USING (seed) GROUP BY 1),
  g AS (SELECT * FROM t WHERE config <> 'equal' AND margin_lo > 0)
  SELECT coalesce((SELECT string_agg(config, ',' ORDER BY config) FROM g), '') AS gains, coalesce((SELECT string_agg(config, ',' ORDER BY config) FROM g WHERE swing_lo > 0), '') AS gain_partly_from_inputs,
    round((SELECT max(margin) FROM t) - (SELECT margin FROM t WHERE config = 'equal'), 6) AS swing, CASE WHEN (SELECT count(*) FROM g WHERE swing_lo > 0) > 0 THEN 'FLAG' ELSE 'ok' END AS verdict,
    CASE WHEN (SELECT count(*) FROM g) > 0 AND (SELECT margin_lo FROM t WHERE config = 'equal') <= 0 THEN 'FLAG' ELSE 'ok' END AS verdict_no_gain_survives"""
)
def s2_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 over baselines of four input configurations, with normal intervals over the seeds."""
    configs = F.explode(F.array(*(F.struct(F.lit(c).alias("config"), F.lit(n).alias("wrong")) for c, n in _WRONG.items()))).alias("c")
    rows = predictions(spark, sf_dir).select("item_id", "seed", "y", "pa", configs).select("item_id", "seed", "y", "pa", "c.*")
    right = rng.draw("base", F.col("config"), F.col("seed"), F.col("item_id")) % 100 >= F.col("wrong")
    margins = rows.groupBy("config", "seed").agg((F.avg((F.col("pa") == F.col("y")).cast("double")) - F.avg(right.cast("double"))).alias("d"))
    paired = margins.join(margins.where("config = 'equal'").select("seed", F.col("d").alias("eq")), "seed")
    low = lambda x: F.round(F.avg(x) - 1.96 * F.stddev_samp(x) / F.sqrt(F.count("*").cast("double")), 9)
    found = paired.groupBy("config").agg(F.round(F.avg("d"), 9).alias("margin"), low(F.col("d")).alias("margin_lo"), low(F.col("d") - F.col("eq")).alias("swing_lo"))
    out = system.s2_verdict(found.withColumn("swing_lo", F.when(F.col("config") != "equal", F.col("swing_lo"))), "equal")
    return rounded(out.withColumns({c: F.array_join(c, ",") for c in ("gains", "gain_partly_from_inputs")}))


_CRITERIA = (("d_macro_f1", 0.0), ("d_acc", 0.005))


@query(
    f"""WITH {PRED_SQL}, sd AS (SELECT 'a' AS side, seed, y, pa AS p FROM pred UNION ALL SELECT 'b', seed, y, pb FROM pred), f AS ({_macro_sql('sd', 'side, seed', CLASSES)}),
  d AS (SELECT x.seed AS part, unnest([{{'m': 'd_macro_f1', 'v': x.f - z.f}}, {{'m': 'd_acc', 'v': x.acc - z.acc}}]) AS s FROM f x JOIN f z ON x.seed = z.seed AND x.side = 'a' AND z.side = 'b'), c(metric, criterion) AS (VALUES {', '.join(f"('{m}', {v}::DOUBLE)" for m, v in _CRITERIA)}),
  s AS (SELECT metric, avg(d.s.v) AS mean, stddev_pop(d.s.v) AS sd, criterion, avg(d.s.v) >= criterion AS met FROM d JOIN c ON c.metric = d.s.m GROUP BY metric, criterion)
  SELECT metric, round(mean, 6) AS mean, round(sd, 6) AS sd, criterion, met, CASE WHEN (SELECT bool_and(met) FROM s) THEN 'ok' ELSE 'FLAG' END AS verdict FROM s"""
)
def s6_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better system against the weaker one on every seed."""
    sides = F.explode(F.array(*(F.struct(F.lit(n).alias("side"), F.col(f"p{n}").alias("pred")) for n in "ab"))).alias("s")
    cells = metrics.confusion(predictions(spark, sf_dir).select("seed", "y", sides).select("seed", "y", "s.*"), ["side", "seed"])
    scores = metrics.macro(cells, ["side", "seed"], CLASSES)
    of = lambda side, m: F.max(F.when(F.col("side") == side, F.col(m)))
    per = scores.groupBy("seed").agg(*((of("a", m) - of("b", m)).alias(f"d_{m}") for m in ("macro_f1", "acc")))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m, _ in _CRITERIA))).alias("s")
    return rounded(system.s6_verdict(per.select("seed", each).select(F.col("seed").alias("partition"), "s.*"), spark.createDataFrame(list(_CRITERIA), "metric string, criterion double")))


_HAS = {"D3": "split = 'test'", "D6": "split = 'test' AND y >= 2", "S4": "y = 3"}


@query(
    f"""{task_plans._ITEMS}, n AS (SELECT unnest({[*task_plans.TASKS, 'unseen']}) AS task), r AS ({' UNION ALL '.join(f"SELECT task, '{c}' AS check_ FROM items WHERE {w}" for c, w in _HAS.items())}), c AS (SELECT task, count(DISTINCT check_) AS c FROM r GROUP BY 1)
  SELECT task, c IS NOT NULL AS done, coalesce(c, 0) AS checks FROM n LEFT JOIN c USING (task)"""
)
def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which checks have rows of a task to look at."""
    items = task_plans.registry(spark, sf_dir).items()
    checks = F.explode(F.array_compact(F.array(*(F.when(F.expr(w), c) for c, w in _HAS.items())))).alias("check")
    names = spark.createDataFrame([(t,) for t in [*task_plans.TASKS, "unseen"]], "task string")
    return tasks.status(names, items.select("task", checks))


@query(
    f"""WITH d AS (SELECT d.doc_id, coalesce(text, '') AS text, source, unnest(['lang:' || lang, 'source:' || source]) AS task, l.doc_id AS lb, e.vec_id AS vec FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
  t AS (SELECT task, count(*) FILTER (WHERE text <> '') AS texts, count(DISTINCT source) AS sources, count(vec) AS encoders, count(lb) AS systems FROM d WHERE task IS NOT NULL GROUP BY 1),
  n(check_, need, least, why) AS (VALUES {', '.join(f"('{c}', '{n}', {tasks.LEAST.get(n, 1)}, '{w}')" for c, (n, w) in tasks.NEEDS.items())}),
  x AS (SELECT task, check_, why, CASE need WHEN 'texts' THEN texts WHEN 'sources' THEN sources WHEN 'encoders' THEN encoders ELSE systems END >= least AS run FROM t, n)
  SELECT task, check_ AS "check", run, CASE WHEN run THEN '' ELSE 'n/a: ' || why END AS why FROM x"""
)
def task_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which checks the documents of each language and of each source allow."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("lb"))
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("vec"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("has"), "source", "lang")
    # labels and vectors have one row an id
    joined = docs.join(labels, "doc_id", "left").join(vecs, "doc_id", "left")
    each = F.explode(F.array_compact(F.array(F.concat(F.lit("lang:"), F.col("lang")), F.concat(F.lit("source:"), F.col("source"))))).alias("task")
    counts = joined.select(each, "has", "source", "lb", "vec").groupBy("task").agg(
        F.count(F.when(F.col("has"), 1)).alias("texts"), F.countDistinct("source").alias("sources"), F.count("vec").alias("encoders"), F.count("lb").alias("systems"))
    return tasks.dispatch(counts)


_SIGNALS = {"low_confidence": "a", "small_margin": "b", "rules": "c", "concept_doubt": "d"}


@query(
    f"""WITH {symbolic._SIG}, u AS (SELECT item_id, err, unnest([{', '.join(f"{{'n': '{n}', 'v': round(CAST({c} AS DOUBLE), 6)}}" for n, c in _SIGNALS.items())}]) AS s FROM rk),
  h AS (SELECT s.n AS signal, seed, err, s.v AS v FROM u, (SELECT unnest(range(5)) AS seed) WHERE {H("'half'", 'seed', 'item_id')} % 2 = 0),
  r AS (SELECT signal, seed, err, rank() OVER (PARTITION BY signal, seed ORDER BY v) + (count(*) OVER (PARTITION BY signal, seed, v) - 1) / 2 AS k, count(*) OVER (PARTITION BY signal, seed) AS n FROM h),
  p AS (SELECT signal, seed, (sum(k * err) - sum(err) * (sum(err) + 1) / 2) / nullif(sum(err) * (count(*) - sum(err)), 0) AS auroc, avg(CAST((k - 1) / greatest(n - 1, 1) >= 0.8 AS DOUBLE)) FILTER (WHERE err = 1) AS caught, avg(1.0 - err) FILTER (WHERE (k - 1) / greatest(n - 1, 1) < 0.8) AS kept_accuracy FROM r GROUP BY 1, 2),
  t AS (SELECT signal, seed, unnest([{{'m': 'auroc', 'v': auroc}}, {{'m': 'caught', 'v': caught}}, {{'m': 'kept_accuracy', 'v': kept_accuracy}}]) AS s FROM p),
  d AS (SELECT t.signal, t.s.m AS metric, round(t.s.v - b.s.v, 12) AS d FROM t JOIN t b ON b.signal = 'small_margin' AND b.seed = t.seed AND b.s.m = t.s.m WHERE t.signal <> 'small_margin')
  SELECT signal, metric, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS sd, count(*) AS seeds, CAST(count(*) FILTER (WHERE d > 0) AS BIGINT) AS seeds_better FROM d GROUP BY 1, 2"""
)
def feasibility_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review signals of the pooled system against its margin on drawn halves: how they rank errors, what a fifth of reviews catches, how right the rest is."""
    found = review.signals(symbolic._review(spark, sf_dir))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), F.round(F.col(n).cast("double"), 6).alias("v")) for n in _SIGNALS))).alias("s")
    rows = found.select("item_id", "err", each).select("item_id", "err", "s.*").select("*", _each(range(5), "seed")).where(rng.draw("half", F.col("seed"), F.col("item_id")) % 2 == 0)
    # ranks of four signals are dear, and three statistics read them
    rows = saved(rows)
    by = ["signal", "seed"]
    placed = metrics.rank_norm(rows, by, "v", "r")
    top = F.col("r") >= 0.8
    rates = placed.groupBy(*by).agg(F.avg(F.when(F.col("err") == 1, top.cast("double"))).alias("caught"), F.avg(F.when(~top, 1.0 - F.col("err"))).alias("kept_accuracy"))
    both = saved(metrics.auc(rows, by, "v", F.col("err") == 1).withColumnRenamed("auc", "auroc").join(rates, by))
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("auroc", "caught", "kept_accuracy")))).alias("m")
    return rounded(tasks.against_base(both.select(*by, values).select(*by, "m.*"), "small_margin"))


@query(
    f"""WITH {MANIFEST_SQL}, d AS (SELECT source AS name, avg(length(text)) AS value FROM manifest WHERE split = 'train' GROUP BY 1), o AS (SELECT source AS name, avg(length(text)) AS v FROM manifest WHERE split = 'val' AND lang = 'fr' GROUP BY 1 UNION ALL SELECT 'other', 1.0)
  SELECT name, round(CAST(coalesce(v, value) AS DOUBLE), 6) AS value FROM d LEFT JOIN o USING (name)"""
)
def threshold_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold for each source from its train rows, replaced where its val rows of one language give another."""
    rows = manifest(spark, sf_dir)
    mean = lambda where: rows.where(where).groupBy(F.col("source").alias("name")).agg(F.avg(F.length("text")).alias("value"))
    unknown = spark.createDataFrame([("other", 1.0)], "name string, value double")
    return rounded(tasks.thresholds(mean("split = 'train'"), mean("split = 'val' AND lang = 'fr'").unionByName(unknown)))
