"""Queries of the data tier: text shape, D1, D2, splits, metrics, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import metrics, rng, text
from plumbline.operators import decisions, duplicates, relations
from plumbline.plans.fixtures import CLASSES, EMBEDDED_SQL, LABELLED_SQL, MANIFEST_SQL, NORM, PRED_SQL, WORDS, embedded, labelled, manifest, predictions
from plumbline.plans.registry import ORACLES, query, rounded
from plumbline.sources import corpora
from plumbline.sources.manifest import label_dim as dim
from plumbline.sources.manifest import table

H = rng.draw_sql
_ratio = "CASE WHEN length({t}) > 0 THEN ({x}) / length({t}) ELSE 0.0 END"


def _shape_sql(t: str) -> str:
    w = WORDS.format(t=t)
    kept = lambda pattern: f"length({t}) - length(regexp_replace({t}, '{pattern}', '', 'g'))"
    return f"""round(CAST(length({t}) AS DOUBLE), 6) AS n_chars, CAST(len({w}) AS DOUBLE) AS n_words,
  round(CASE WHEN len({w}) > 0 THEN list_sum(list_transform({w}, lambda x: length(x))) / len({w}) ELSE 0.0 END, 6) AS mean_word_len,
  CAST(coalesce(list_max(list_transform({w}, lambda x: length(x))), 0) AS DOUBLE) AS max_word_len,
  round({_ratio.format(t=t, x=kept(r"\p{Lu}"))}, 6) AS upper_ratio, round({_ratio.format(t=t, x=kept(r"\p{Nd}"))}, 6) AS digit_ratio,
  round({_ratio.format(t=t, x=kept(r"[^\p{L}\p{N}_\s]"))}, 6) AS punct_ratio,
  round({_ratio.format(t=t, x=f"length({t}) - ({kept(r'[\p{L}\p{N}]')})")}, 6) AS non_alnum_ratio,
  round(CASE WHEN len({w}) > 0 THEN len(list_distinct(list_transform({w}, lambda x: lower(x)))) / len({w}) ELSE 0.0 END, 6) AS type_token_ratio"""


@query(f"WITH {MANIFEST_SQL} SELECT item_id, {_shape_sql('text')} FROM manifest")
def text_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text.with_shape(manifest(spark, sf_dir), F.col("text"), "item_id"))


@query(f"WITH {MANIFEST_SQL} SELECT item_id, md5({NORM.format(t='text')}) AS norm_md5, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) AS phrase_md5 FROM manifest")
def text_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return manifest(spark, sf_dir).select("item_id", F.md5(text.normal(t)).alias("norm_md5"), F.md5(text.phrase_normal(t)).alias("phrase_md5"))


@query(
    f"""WITH {MANIFEST_SQL} SELECT item_id, CASE WHEN starts_with(source, 'src1') THEN md5(trim(concat_ws(' ', title, text), ' ')) ELSE md5(title) END AS fused_md5,
  md5('') AS none_md5, md5(text) AS caption_md5, md5(title) AS ocr_md5, md5(title) AS parity_md5,
  CASE WHEN starts_with(source, 'src1') THEN 'src1' ELSE 'other' END AS source_group, md5(upper(replace(text, 'ß', 'SS')) || ' !!!') AS cue_md5,
  md5(trim(regexp_replace(replace(text, chr(65533), ' '), '\\s+', ' ', 'g'), ' ')) AS clean_md5 FROM manifest"""
)
def text_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, t = manifest(spark, sf_dir), F.col("text")
    modes = [F.md5(text.compose(mode, F.col("source"), F.col("title"), t, "src1")).alias(f"{mode}_md5") for mode in ("fused", "none", "caption", "ocr", "parity")]
    return m.select("item_id", *modes, text.source_group(F.col("source"), "src1").alias("source_group"), F.md5(text.planted_cue(t)).alias("cue_md5"), F.md5(text.squeeze(t)).alias("clean_md5"))


_PHRASES = ("of the", "license", "the and", "que de la")


@query(
    f"""WITH {MANIFEST_SQL}, p AS (SELECT unnest({list(_PHRASES)}) AS phrase)
  SELECT item_id, phrase, contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') || ' ', ' ' || phrase || ' ') AS present FROM manifest, p"""
)
def phrase_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = manifest(spark, sf_dir).select("item_id", text.phrase_normal(F.col("text")).alias("n"))
    flags = F.explode(F.array(*(F.struct(F.lit(p).alias("phrase"), text.has_phrase(F.col("n"), p).alias("present")) for p in _PHRASES))).alias("s")
    return n.select("item_id", flags).select("item_id", "s.*")


@query(
    f"""WITH {MANIFEST_SQL}, f AS (SELECT 'text' AS field, source, text AS t FROM manifest UNION ALL SELECT 'title', source, title FROM manifest)
  SELECT field, source, count(*) AS n, round(avg(CAST(length(t) = 0 AS DOUBLE)), 6) AS empty, round(avg(length(t)), 6) AS mean_chars,
    round(avg(CASE WHEN length(t) > 0 THEN (length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g'))) / length(t) ELSE 0.0 END), 6) AS upper_ratio FROM f GROUP BY 1, 2"""
)
def d1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.profile(manifest(spark, sf_dir), ["text", "title"], "source"))


def _tail_sql(k: str, n: str, p: str) -> str:
    term = f"lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p})"
    terms = f"list_transform(range(CAST({k} AS BIGINT), CAST({n} AS BIGINT) + 1), lambda i: {term})"
    return f"CASE WHEN {p} >= 1 OR {k} <= 0 THEN 0.0 ELSE least((list_max({terms}) + ln(list_sum(list_transform({terms}, lambda t: exp(t - list_max({terms})))))) / ln(10), 0.0) END"


_TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


@query(
    f"""WITH {LABELLED_SQL}, t AS (SELECT {_TRIM.format('title')} AS a, {_TRIM.format('text')} AS b, label AS y FROM labelled),
  r AS (SELECT 'title is empty' AS relation, y FROM t WHERE a = '' UNION ALL SELECT 'text is empty', y FROM t WHERE b = ''
    UNION ALL SELECT 'title == text', y FROM t WHERE a = b AND a <> '' UNION ALL SELECT 'title inside text', y FROM t WHERE a <> '' AND a <> b AND contains(b, a)
    UNION ALL SELECT 'text inside title', y FROM t WHERE b <> '' AND a <> b AND contains(a, b) UNION ALL SELECT 'title and text both empty', y FROM t WHERE a = '' AND b = ''),
  c AS (SELECT relation, y, count(*) AS k FROM r GROUP BY 1, 2), s AS (SELECT label AS y, count(*) AS size FROM labelled GROUP BY 1),
  b AS (SELECT *, sum(k) OVER (PARTITION BY relation) AS support, row_number() OVER (PARTITION BY relation ORDER BY k DESC, y) AS rn FROM c),
  f AS (SELECT relation, CAST(support AS BIGINT) AS support, b.y AS top_class, k, size, (SELECT sum(size) FROM s) AS total FROM b JOIN s USING (y) WHERE rn = 1),
  g AS (SELECT *, size / total AS base FROM f), p AS (SELECT *, {_tail_sql('k', 'support', 'base')} AS log10_p FROM g)
  SELECT relation, support, top_class, round(k / support, 6) AS precision, round(k / size, 6) AS recall, round(base, 6) AS base_rate, round(log10_p, 6) AS log10_p,
    CASE WHEN support >= 20 AND k / support >= 0.95 AND log10_p <= log10(1e-3 / (SELECT count(*) FROM p)) THEN 'FLAG' ELSE 'ok' END AS verdict FROM p"""
)
def d2_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.relations(labelled(spark, sf_dir), ["title", "text"], "label"))


@query(f"WITH {LABELLED_SQL} SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT lang AS label FROM labelled)")
def label_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dim(labelled(spark, sf_dir), "lang")


@query(f"WITH {LABELLED_SQL} SELECT split, y, count(*) AS n FROM labelled GROUP BY 1, 2")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).groupBy("split", "y").agg(F.count("*").alias("n"))


_RANK = f"row_number() OVER (PARTITION BY y ORDER BY {H('42', chr(39) + 'split' + chr(39), 'item_id')}, item_id) AS rn, count(*) OVER (PARTITION BY y) AS n"


@query(f"WITH {LABELLED_SQL}, r AS (SELECT item_id, y, {_RANK} FROM labelled) SELECT item_id, y, CASE WHEN rn <= round(n * 0.7) THEN 'train' WHEN rn <= round(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rng.stratified_split(labelled(spark, sf_dir).select("item_id", "y"), "y", "item_id")


@query(f"WITH {LABELLED_SQL}, r AS (SELECT item_id, y, {_RANK} FROM labelled) SELECT item_id, y, rn % 5 AS fold FROM r")
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rng.stratified_folds(labelled(spark, sf_dir).select("item_id", "y"), "y", "item_id", 5)


@query(f"WITH {LABELLED_SQL}, r AS (SELECT item_id, y, {_RANK}, count(*) OVER () AS total FROM labelled) SELECT item_id, y FROM r WHERE total <= 120 OR rn <= greatest(round(n * 120 / total), 1)")
def sample_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rng.capped_sample(labelled(spark, sf_dir).select("item_id", "y"), "y", "item_id", 120)


@query(f"WITH {PRED_SQL} SELECT seed, y, CAST(pa AS BIGINT) AS pred, count(*) AS n FROM pred GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(predictions(spark, sf_dir), ["seed"], "y", "pa")


_PER_CLASS = f"""{PRED_SQL}, cls AS (SELECT unnest(range({CLASSES})) AS class), pc AS (
  SELECT seed, class, CAST(sum(CAST(y = class AND pa = class AS INT)) AS BIGINT) AS tp, CAST(sum(CAST(y <> class AND pa = class AS INT)) AS BIGINT) AS fp,
    CAST(sum(CAST(y = class AND pa <> class AS INT)) AS BIGINT) AS fn FROM pred, cls GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM pc)"""


@query(f"WITH {_PER_CLASS} SELECT seed, class, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.per_class(metrics.confusion(predictions(spark, sf_dir), ["seed"], "y", "pa"), ["seed"], CLASSES))


@query(f"WITH {_PER_CLASS} SELECT f.seed, round(avg(f1), 6) AS macro_f1, (SELECT round(avg(CAST(y = pa AS DOUBLE)), 6) FROM pred p WHERE p.seed = f.seed) AS acc FROM f GROUP BY 1")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.macro(metrics.confusion(predictions(spark, sf_dir), ["seed"], "y", "pa"), ["seed"], CLASSES))


@query(
    f"""WITH {LABELLED_SQL}, m AS (SELECT y AS majority FROM labelled WHERE split <> 'test' GROUP BY 1 ORDER BY count(*) DESC, y LIMIT 1),
  c AS (SELECT unnest(range({CLASSES})) AS class), t AS (SELECT y FROM labelled WHERE split = 'test')
  SELECT majority, round(avg(f), 6) AS macro_f1 FROM (SELECT class, majority, CASE WHEN class = majority THEN 2 * sum(CAST(y = class AS INT)) / (count(*) + sum(CAST(y = class AS INT))) ELSE 0.0 END AS f
    FROM t, c, m GROUP BY 1, 2) GROUP BY 1"""
)
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    counts = rows.where("split <> 'test'").groupBy("y").count()
    top = counts.agg(F.max_by("y", F.struct("count", -F.col("y"))).alias("majority"))
    cells = metrics.confusion(rows.where("split = 'test'").join(F.broadcast(top)), ["majority"], "y", "majority")
    return rounded(metrics.macro(cells, ["majority"], CLASSES).select("majority", "macro_f1"))


@query(
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS cb FROM c GROUP BY 1),
  g AS (SELECT r.a, k.b, ra * cb / (SELECT sum(o) FROM c) AS e, coalesce(o, 0) AS o FROM r CROSS JOIN k LEFT JOIN c ON c.a = r.a AND c.b = k.b)
  SELECT round(sqrt(sum((o - e) * (o - e) / e) / ((SELECT sum(o) FROM c) * (least((SELECT count(*) FROM r), (SELECT count(*) FROM k)) - 1))), 6) AS v FROM g"""
)
def cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.cramers_v(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"))


@query(
    f"""WITH {LABELLED_SQL}, r AS (SELECT label = 'toxic' AS p, rank() OVER (ORDER BY length(text)) + (count(*) OVER (PARTITION BY length(text)) - 1) / 2 AS k FROM labelled)
  SELECT round((sum(k) FILTER (WHERE p) - count(*) FILTER (WHERE p) * (count(*) FILTER (WHERE p) + 1) / 2) / (count(*) FILTER (WHERE p) * count(*) FILTER (WHERE NOT p)), 6) AS auc FROM r"""
)
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumn("score", F.length("text"))
    return rounded(metrics.auc(rows, [], "score", F.col("label") == "toxic"))


@query(
    f"""WITH {LABELLED_SQL}, c AS (SELECT unnest(range({CLASSES})) AS class), r AS (SELECT class, y = class AS p, rank() OVER (PARTITION BY class ORDER BY length(text)) + (count(*) OVER (PARTITION BY class, length(text)) - 1) / 2 AS k FROM labelled, c)
  SELECT class, round((sum(k) FILTER (WHERE p) - count(*) FILTER (WHERE p) * (count(*) FILTER (WHERE p) + 1) / 2) / (count(*) FILTER (WHERE p) * count(*) FILTER (WHERE NOT p)), 6) AS auc FROM r GROUP BY 1"""
)
def auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("y", F.length("text").alias("score"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CLASSES - 1).cast("long"))).alias("class"))
    return rounded(metrics.auc(rows, ["class"], "score", F.col("y") == F.col("class")))


_DUP = f"""{LABELLED_SQL}, n AS (SELECT item_id, split, y, {NORM.format(t='text')} AS norm FROM labelled),
cnt AS (SELECT norm, y, count(*) AS c FROM n WHERE split <> 'test' AND norm <> '' GROUP BY 1, 2),
maj AS (SELECT norm, y AS exact_answer FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY c DESC, y) AS rn FROM cnt) WHERE rn = 1)"""


@query(f"WITH {MANIFEST_SQL}, n AS (SELECT item_id, split, {NORM.format(t='text')} AS norm FROM manifest) SELECT item_id FROM n WHERE split = 'test' AND norm <> '' AND norm IN (SELECT norm FROM n WHERE split <> 'test')")
def dup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_keys(manifest(spark, sf_dir))


_NEAR = f"""{EMBEDDED_SQL}, s AS (SELECT t.item_id, f.item_id AS fit_id, list_dot_product(t.u, f.u) AS cos FROM unit t, unit f WHERE t.split = 'test' AND f.split <> 'test'),
near AS (SELECT item_id, fit_id, cos FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cos DESC, fit_id) AS rn FROM s) WHERE rn = 1)"""


@query(f"WITH {_NEAR} SELECT item_id, fit_id, round(cos, 6) AS cos FROM near")
def dup_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(duplicates.nearest_fit(embedded(spark, sf_dir)))


@query(
    f"""WITH {_DUP}, a AS (SELECT n.*, exact_answer IS NOT NULL AS ex, coalesce(exact_answer, -1) AS ans FROM n LEFT JOIN maj USING (norm) WHERE split = 'test')
  SELECT count(*) AS n_test, round(avg(CAST(ex AS DOUBLE)), 6) AS dup_share, round(avg(CAST(ex AS DOUBLE)), 6) AS exact_text_share, 0.0::DOUBLE AS near_share,
    round(avg(CAST(ans = y AS DOUBLE)), 6) AS leaky_share, (SELECT round(avg(r), 6) FROM (SELECT avg(CAST(ans = y AS DOUBLE)) AS r FROM a GROUP BY y)) AS leaky_share_balanced FROM a"""
)
def dup_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(duplicates.leak_rates(duplicates.lookup(labelled(spark, sf_dir))))


@query(
    f"""WITH {_DUP}, fit AS (SELECT item_id, y, norm FROM n WHERE split <> 'test'), reps AS (SELECT unnest(range(20)) AS rep),
  i AS (SELECT rep, item_id, norm, row_number() OVER (PARTITION BY rep ORDER BY item_id) AS r FROM fit, reps),
  d AS (SELECT rep, y, row_number() OVER (PARTITION BY rep ORDER BY {H("'null'", "rep", "item_id")}, item_id) AS r FROM fit, reps),
  p AS (SELECT i.rep, i.norm, d.y, count(*) AS c FROM i JOIN d ON i.rep = d.rep AND i.r = d.r WHERE norm <> '' GROUP BY 1, 2, 3),
  m AS (SELECT rep, norm, y AS ans FROM (SELECT *, row_number() OVER (PARTITION BY rep, norm ORDER BY c DESC, y) AS rn FROM p) WHERE rn = 1),
  a AS (SELECT reps.rep, n.y, coalesce(ans, -1) = n.y AS ok FROM n CROSS JOIN reps LEFT JOIN m ON m.rep = reps.rep AND m.norm = n.norm WHERE n.split = 'test')
  SELECT CAST(rep AS BIGINT) AS rep, round(avg(CAST(ok AS DOUBLE)), 6) AS leaky_share, (SELECT round(avg(r), 6) FROM (SELECT avg(CAST(ok AS DOUBLE)) AS r FROM a b WHERE b.rep = a.rep GROUP BY y)) AS leaky_share_balanced FROM a GROUP BY rep"""
)
def dup_leak_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(duplicates.leak_null(labelled(spark, sf_dir)))


def _exact(name: str) -> str:
    """A query's SQL with its shares to 12 places."""
    return ORACLES[name].replace(", 6)", ", 12)")


@query(
    f"""SELECT n_test, {', '.join(f'round({c}, 6) AS {c}' for c in ('dup_share', 'exact_text_share', 'near_share', 'leaky_share', 'leaky_share_balanced', 'leaky_null', 'leaky_null_balanced'))},
    round(leaky_share - leaky_null, 6) AS leaky_excess, round(leaky_share_balanced - leaky_null_balanced, 6) AS leaky_excess_balanced, CASE WHEN leaky_share - leaky_null >= 0.05 THEN 'FLAG' ELSE 'ok' END AS verdict
  FROM ({_exact('dup_leak')}) r, (SELECT avg(leaky_share) AS leaky_null, avg(leaky_share_balanced) AS leaky_null_balanced FROM ({_exact('dup_leak_null')}) z) n"""
)
def d6_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(duplicates.d6(labelled(spark, sf_dir)))


@query(f"WITH {_DUP} SELECT item_id, y FROM n WHERE split = 'test' AND norm NOT IN (SELECT norm FROM maj)")
def novel_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.novel(labelled(spark, sf_dir)).select("item_id", "y")


_SWEEP = (0.40, 0.43, 0.46)


@query(
    f"""WITH {_NEAR}, g AS (SELECT unnest({list(_SWEEP)}::DOUBLE[]) AS c), a AS (
    SELECT c, t.y, n.cos >= c AS dup, CASE WHEN n.cos >= c THEN f.y ELSE -1 END AS ans FROM g, near n JOIN embedded t ON t.item_id = n.item_id JOIN embedded f ON f.item_id = n.fit_id)
  SELECT c AS cos_min, count(*) AS n_test, round(avg(CAST(dup AS DOUBLE)), 6) AS dup_share, 0.0::DOUBLE AS exact_text_share, round(avg(CAST(dup AS DOUBLE)), 6) AS near_share,
    round(avg(CAST(ans = y AS DOUBLE)), 6) AS leaky_share, (SELECT round(avg(r), 6) FROM (SELECT avg(CAST(ans = y AS DOUBLE)) AS r FROM a b WHERE b.c = a.c GROUP BY y)) AS leaky_share_balanced FROM a GROUP BY c"""
)
def dup_cosine_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embedded(spark, sf_dir)
    rows = e.withColumn("text", F.concat(F.lit("item "), F.col("item_id").cast("string")))
    return rounded(duplicates.cosine_sweep(rows, duplicates.nearest_fit(e), _SWEEP))


_LINKS = f"""{MANIFEST_SQL}, {EMBEDDED_SQL}, nn AS (SELECT item_id, {NORM.format(t='text')} AS norm FROM manifest),
links AS (SELECT x.item_id AS a, z.item_id AS b FROM nn x JOIN nn z ON x.norm = z.norm AND x.item_id < z.item_id AND length(x.norm) >= 3
  UNION SELECT x.item_id, z.item_id FROM unit x JOIN unit z ON x.item_id < z.item_id AND list_dot_product(x.u, z.u) >= 0.45)"""
_COMP = f"""RECURSIVE {_LINKS}, sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(item_id, r) AS (SELECT item_id, item_id FROM manifest UNION SELECT reach.item_id, sym.b FROM reach JOIN sym ON sym.a = reach.r)"""


@query(f"WITH {_COMP} SELECT item_id, min(r) AS component FROM reach GROUP BY 1")
def dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir)
    return duplicates.components(m, duplicates.duplicate_links(m, embedded(spark, sf_dir), 0.45))


@query(
    f"""WITH {LABELLED_SQL}, m AS (SELECT item_id, y, {NORM.format(t='text')} AS norm FROM labelled),
  c AS (SELECT item_id, y, CASE WHEN length(norm) >= {duplicates.MIN_TEXT} THEN min(item_id) OVER (PARTITION BY norm) ELSE item_id END AS component FROM m),
  n AS (SELECT component, y, count(*) AS n FROM c GROUP BY 1, 2), g AS (SELECT component, CAST(sum(n) AS BIGINT) AS size, arg_max(y, n * 1000 - y) AS major FROM n GROUP BY 1),
  r AS (SELECT component, row_number() OVER (PARTITION BY major ORDER BY size DESC, {H("'group'", 'component')}, component) - 1 AS r FROM g),
  f AS (SELECT component, CASE WHEN (r // 20) % 2 = 0 THEN r % 20 ELSE 19 - r % 20 END AS fold FROM r)
  SELECT item_id, component, CASE WHEN fold < 3 THEN 'test' WHEN fold < 6 THEN 'val' ELSE 'train' END AS split FROM c JOIN f USING (component)"""
)
def group_split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split that parts no group of equal texts."""
    m = labelled(spark, sf_dir)
    return duplicates.group_split(duplicates.components(m, duplicates.duplicate_links(m, None)), m)


def _knn_sql(balanced: bool) -> str:
    prior = ", prior AS (SELECT y, count(*) / (SELECT count(*) FROM embedded WHERE split <> 'test') AS prior FROM embedded WHERE split <> 'test' GROUP BY 1)"
    value = "coalesce(v, 0) / prior + 1e-3" if balanced else "coalesce(v, 0) + 1.0"
    join = "LEFT JOIN prior ON prior.y = e.y" if balanced else ""
    return f"""WITH {_NEAR}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cos DESC, fit_id) AS rn FROM s) WHERE rn <= 25),
  votes AS (SELECT t.item_id, f.y, sum(greatest(cos, 0.0)) AS v FROM top t JOIN embedded f ON f.item_id = t.fit_id GROUP BY 1, 2){prior},
  e AS (SELECT item_id, unnest(range(10)) AS y FROM embedded WHERE split = 'test'), w AS (SELECT e.item_id, e.y, {value} AS v FROM e LEFT JOIN votes o ON o.item_id = e.item_id AND o.y = e.y {join})
  SELECT item_id, y AS class, round(v / sum(v) OVER (PARTITION BY item_id), 6) AS p FROM w"""


@query(_knn_sql(False))
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(duplicates.knn_vote(embedded(spark, sf_dir), 25, 10))


@query(_knn_sql(True))
def knn_vote_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(duplicates.knn_vote(embedded(spark, sf_dir), 25, 10, balanced=True))


@query(
    f"""WITH {LABELLED_SQL}, {_NEAR}, n AS (SELECT item_id, split, {NORM.format(t='text')} AS norm FROM labelled),
  c AS (SELECT n.item_id, NOT (norm <> '' AND norm IN (SELECT norm FROM n WHERE split <> 'test')) AS caption, coalesce(near.cos, -1) < 0.43 AS image FROM n LEFT JOIN near ON near.item_id = n.item_id WHERE n.split = 'test')
  SELECT item_id, caption, image, caption AND image AS joint FROM c"""
)
def novel_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows that are novel by text, by image and by both."""
    near = duplicates.nearest_fit(embedded(spark, sf_dir))
    return duplicates.novel_criteria(labelled(spark, sf_dir), {"caption": None, "image": near}, 0.43)


@query(f"WITH {LABELLED_SQL} SELECT item_id, y FROM (SELECT item_id, CASE WHEN lang = 'fr' THEN -1 ELSE y END AS y FROM labelled) WHERE y >= 0")
def known_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("item_id", F.when(F.col("lang") == "fr", -1).otherwise(F.col("y")).cast("long").alias("y"))
    return corpora.known(rows)


@query(
    f"""WITH {LABELLED_SQL}, pool AS (SELECT item_id, y, split FROM labelled WHERE split <> 'test'), r AS (SELECT item_id, y, split, {_RANK}, count(*) OVER () AS total FROM pool)
  SELECT item_id, y, split FROM r WHERE total <= 100 OR rn <= greatest(round(n * 100 / total), 1) UNION ALL SELECT item_id, y, split FROM labelled WHERE split = 'test'"""
)
def sample_with_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stratified sample of the train and val rows beside the whole test side."""
    return rng.sample_with_test(labelled(spark, sf_dir).select("item_id", "y", "split"), "y", "item_id", 100)
