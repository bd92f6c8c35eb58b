"""Queries of regimes, reports and smaller operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import metrics, rng, text, vectors
from plumbline.functions.tables import kept_until_exit, shared_folder
from plumbline.operators import decisions, duplicates, mining, pooling, regimes, relations
from plumbline.plans import symbolic
from plumbline.plans.fixtures import EMBEDDED_SQL, LABELLED_SQL, MANIFEST_SQL, NORM, PRED_SQL, embedded, labelled, manifest, predictions
from plumbline.plans.registry import query, rounded
from plumbline.sources import caches, corpora, release
from plumbline.sources.manifest import aligned, table

H = rng.draw_sql


@query(
    f"""WITH {EMBEDDED_SQL}, m AS (SELECT y, i, avg(u[i + 1]) AS m FROM unit, (SELECT unnest(range(64)) AS i) GROUP BY 1, 2), p AS (SELECT y, list(m ORDER BY i) AS v FROM m GROUP BY 1),
  q AS (SELECT y, v, sqrt(list_dot_product(v, v)) + 1e-8 AS n FROM p)
  SELECT u.item_id, q.y AS class, round(list_dot_product(u.vec, q.v) / q.n / (sqrt(list_dot_product(u.vec, u.vec)) + 1e-8), 6) AS score FROM unit u, q WHERE u.split = 'test'"""
)
def prototype_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embedded(spark, sf_dir)
    protos = regimes.prototypes(e.select(F.col("y").alias("predicate"), "vec"))
    test = e.where("split = 'test'").select("item_id", "vec").join(F.broadcast(protos))
    return rounded(test.select("item_id", F.col("predicate").alias("class"), vectors.dot(vectors.unit_eps(F.col("vec")), F.col("prototype")).alias("score")))


_LEVELS = [0.05 + 0.9 * i / (regimes.CANDIDATES - 1) for i in range(regimes.CANDIDATES)]
_APART = f"abs({{q}} - q) >= {regimes.SEPARATION} - 1e-12"


@query(
    f"""WITH {symbolic._LIT}, cs AS (SELECT feature, value, class FROM sc JOIN calib USING (item_id)), tot AS (SELECT count(*) AS total FROM calib), np AS (SELECT class, count(*) AS n_pos FROM calib GROUP BY 1),
  qc AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, {_LEVELS}))) AS cuts, list_distinct(quantile_cont(value, [0.5, 0.75, 0.9])) AS fixed FROM cs GROUP BY 1),
  ea AS (SELECT feature, unnest(range(len(cuts))) AS i, unnest(cuts) AS cut, len(cuts) AS m FROM qc),
  hi AS (SELECT feature, i, cut, m, class, count(*) AS tp, sum(count(*)) OVER (PARTITION BY feature, i) AS fired FROM cs JOIN ea USING (feature) WHERE value > cut GROUP BY feature, i, cut, m, class),
  bs AS (SELECT feature, i, cut, m, max(round({symbolic._fb('tp', 'fired', 'n_pos')}, 12)) AS s FROM hi JOIN np USING (class), tot WHERE fired >= {mining.MIN_SUPPORT} AND fired <= {mining.MAX_SUPPORT_FRAC} * total GROUP BY 1, 2, 3, 4),
  rk AS (SELECT feature, cut, CASE WHEN m > 1 THEN i / (m - 1) ELSE 0.0 END AS q, row_number() OVER (PARTITION BY feature ORDER BY s DESC, i) AS r FROM bs),
  a1 AS (SELECT feature, r AS r1, q AS q1 FROM rk WHERE r = 1), a2 AS (SELECT feature, r1, q1, min(r) AS r2, arg_min(q, r) AS q2 FROM rk JOIN a1 USING (feature) WHERE {_APART.format(q='q1')} GROUP BY 1, 2, 3),
  a3 AS (SELECT feature, min(r) AS r3 FROM rk JOIN a2 USING (feature) WHERE {_APART.format(q='q1')} AND {_APART.format(q='q2')} GROUP BY 1),
  ch AS (SELECT feature, cut, row_number() OVER (PARTITION BY feature ORDER BY CASE WHEN r = 1 OR r = r2 OR r = r3 THEN 0 ELSE 1 END, r) AS k FROM rk LEFT JOIN a2 USING (feature) LEFT JOIN a3 USING (feature))
  SELECT feature, round(cut, 6) AS cut FROM ch WHERE k <= {regimes.KEEP} UNION ALL SELECT feature, round(unnest(fixed), 6) FROM qc ANTI JOIN rk USING (feature)"""
)
def learned_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _, labels = symbolic._features(spark, sf_dir)
    return rounded(regimes.learned_cuts(scores, labels))


def _beam_sql(rounds: int = mining.MAX_CLAUSES) -> str:
    """Unions of clauses, the best BEAM of a class going on from round to round; equal coverage counts once."""
    parts = [
        f"top AS (SELECT target, rank, lits FROM cands WHERE rank <= {regimes.BEAM_CANDS}), cov AS (SELECT target, rank, list(item_id) AS c FROM top JOIN has ON list_has_all(h, lits) GROUP BY 1, 2)",
        "own AS (SELECT class AS target, list(item_id) AS mine, count(*) AS n_pos FROM calib GROUP BY 1), b0 AS (SELECT target, []::BIGINT[] AS ranks, []::BIGINT[] AS c, 0.0::DOUBLE AS f FROM own)",
    ]
    for i in range(1, rounds + 1):
        union = f"SELECT b.target, list_append(b.ranks, cov.rank) AS ranks, list_sort(list_distinct(list_concat(b.c, cov.c))) AS c FROM b{i - 1} b JOIN cov ON cov.target = b.target AND NOT list_contains(b.ranks, cov.rank)"
        parts += [
            f"n{i} AS (SELECT *, row_number() OVER (PARTITION BY target, c ORDER BY ranks) AS o FROM ({union}))",
            f"f{i} AS (SELECT n.target, ranks, c, round({symbolic._fb('len(list_intersect(c, mine))', 'len(c)', 'n_pos')}, 12) AS f FROM n{i} n JOIN own ON own.target = n.target WHERE o = 1)",
            f"b{i} AS (SELECT target, ranks, c, f FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY f DESC, ranks) AS k FROM f{i}) WHERE k <= {regimes.BEAM})",
        ]
    parts.append("every AS (" + " UNION ALL ".join(f"SELECT target, ranks, f FROM b{i}" for i in range(1, rounds + 1)) + ")")
    return ", ".join(parts)


@query(
    f"""WITH {symbolic._CL}, {_beam_sql()}
  SELECT target AS class, array_to_string(ranks, ',') AS ranks, round(f, 6) AS fbeta FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY f DESC, len(ranks), ranks) AS k FROM every) WHERE k = 1"""
)
def beam_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands, fires, labels, _ = symbolic._clauses(spark, sf_dir)
    return rounded(regimes.beam_dnf(cands, fires, labels).withColumn("ranks", F.array_join(F.transform("ranks", lambda x: x.cast("string")), ",")))


@query(
    f"""WITH {MANIFEST_SQL}, c AS (SELECT CASE WHEN starts_with(source, 'src1') THEN 'src1' ELSE 'other' END AS "group", trim(title, ' ') AS cap, text AS b, trim(regexp_replace(replace(text, chr(65533), ' '), '\\s+', ' ', 'g'), ' ') AS a FROM manifest)
  SELECT "group", count(*) AS n, count(*) FILTER (WHERE cap = trim(b, ' ')) AS equal_before, round(avg(length(b)), 6) AS length_before, round(avg(CAST(length(b) = 0 AS DOUBLE)), 6) AS empty_before,
    count(*) FILTER (WHERE cap = trim(a, ' ')) AS equal_after, round(avg(length(a)), 6) AS length_after, round(avg(CAST(length(a) = 0 AS DOUBLE)), 6) AS empty_after FROM c GROUP BY 1"""
)
def channel_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir).withColumns({"before": F.col("text"), "after": text.squeeze(F.col("text"))})
    return rounded(regimes.channel_correction(m, text.source_group(F.col("source"), "src1"), "title", "before", "after"))


@query(
    f"""WITH {PRED_SQL}, p AS (SELECT * FROM pred WHERE seed = 0), t AS (SELECT y AS class, count(*) AS n_true, count(*) FILTER (WHERE pa = y AND pb <> y) AS fixes, count(*) FILTER (WHERE pa <> y AND pb = y) AS breaks FROM p GROUP BY 1),
  s AS (SELECT CAST(pa AS BIGINT) AS class, count(*) AS n_pred FROM p GROUP BY 1) SELECT coalesce(t.class, s.class) AS class, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(fixes, 0) AS fixes, coalesce(breaks, 0) AS breaks FROM t FULL JOIN s ON t.class = s.class"""
)
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.class_report(predictions(spark, sf_dir).where("seed = 0").select("y", F.col("pa").alias("pred"), F.col("pb").alias("base")))


@query(f"WITH {PRED_SQL} SELECT item_id % 3 AS kind, count(*) AS n, round(avg(CAST(pa >= 2 AS DOUBLE)), 6) AS recall FROM pred WHERE seed = 0 AND y >= 2 GROUP BY 1")
def recall_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).where("seed = 0").select((F.col("y") >= 2).cast("int").alias("y"), (F.col("pa") >= 2).cast("int").alias("pred"), (F.col("item_id") % 3).alias("type"))
    return rounded(regimes.recall_by_type(rows, "type"))


@query(f"WITH {MANIFEST_SQL}, m AS (SELECT item_id, CASE WHEN split = 'test' THEN 'test' ELSE 'train' END AS split FROM manifest) SELECT item_id, CASE WHEN split = 'train' AND {H('42', chr(39) + 'val' + chr(39), 'item_id')} < 644245094 THEN 'val' ELSE split END AS split FROM m")
def carve_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir).select("item_id", F.when(F.col("split") == "test", "test").otherwise("train").alias("split"))
    return regimes.carve_val(m)


@query(f"WITH {EMBEDDED_SQL} SELECT a.item_id AS a, b.item_id AS b, round(list_dot_product(a.u, b.u), 6) AS cos FROM unit a JOIN unit b ON a.item_id < b.item_id AND list_dot_product(a.u, b.u) >= 0.42")
def close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embedded(spark, sf_dir).select(F.col("item_id").alias("id"), vectors.unit(F.col("vec")).alias("x"))
    return rounded(vectors.close_pairs(e, 0.42))


@query(r"SELECT doc_id AS item_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+', ' ', 'g'), '@\w+', ' ', 'g'), '\s+', ' ', 'g'), ' ')) AS tweet_md5 FROM documents")
def tweet_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).select("item_id", F.md5(text.tweet(F.col("text"))).alias("tweet_md5"))


@query("WITH v AS (SELECT user_id, list(event_type ORDER BY event_id) AS l FROM events GROUP BY 1) SELECT user_id, CAST(list_filter(list_transform(l, lambda x: CASE x WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END), lambda v: v IS NOT NULL)[1] AS BIGINT) AS y FROM v")
def first_known_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"]).alias("l"))
    return e.select("user_id", corpora.first_known_label(F.col("l"), {"click": 1, "purchase": 2}).alias("y"))


@query(f"WITH {MANIFEST_SQL} SELECT split, count(*) AS n, count(DISTINCT sha256(text)) AS distinct, count(*) - count(DISTINCT sha256(text)) AS duplicates FROM manifest GROUP BY 1".replace("AS distinct,", 'AS "distinct",'))
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.split_summary(manifest(spark, sf_dir), "text")


@query(f"WITH {MANIFEST_SQL}, r AS (SELECT sha256(text) AS h, min(split) AS split FROM manifest WHERE item_id % 3 = 0 GROUP BY 1) SELECT m.item_id, r.split AS released FROM manifest m LEFT JOIN r ON r.h = sha256(m.text)")
def rebuilt_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir)
    hashed = m.where("item_id % 3 = 0").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha256")).agg(F.min("split").alias("released"))
    return release.rebuilt_split(m, hashed, "text").select("item_id", "released")


@query("SELECT (SELECT count(*) FROM documents) AS items, (SELECT count(*) FROM embeddings) AS embedded, (SELECT count(*) FROM documents ANTI JOIN embeddings ON doc_id = vec_id) AS without_vector, (SELECT count(*) FROM embeddings ANTI JOIN documents ON doc_id = vec_id) AS without_item")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id")))


@query("SELECT doc_id AS item_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def not_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "lang")
    return corpora.not_cached(d, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id")), ["item_id"])


@query(
    f"""WITH {MANIFEST_SQL}, e AS (SELECT DISTINCT text FROM manifest WHERE item_id % 2 = 0)
  SELECT item_id, md5({NORM.format(t='text')}) AS norm_md5, CAST(CASE WHEN text IN (SELECT text FROM e) THEN 1 ELSE 2 END AS BIGINT) AS run FROM manifest"""
)
def cached_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache by content, filled by half of the documents and then by all: each value says which run has computed it."""
    items = manifest(spark, sf_dir).select("item_id", "text", corpora.content_key(F.col("text")).alias("key"))
    path = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    kept_until_exit(spark, path)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("norm_md5", T.StringType()), T.StructField("run", T.LongType())])
    work = lambda run: lambda rows: rows.select("key", F.md5(text.normal(F.col("text"))).alias("norm_md5"), F.lit(run).cast("long").alias("run"))
    caches.filled(items.where("item_id % 2 = 0").select("key", "text"), work(1), path, schema, pieces=4)
    cache = caches.filled(items.select("key", "text"), work(2), path, schema, pieces=4)
    return items.join(cache, "key").select("item_id", "norm_md5", "run")


@query(
    f"""WITH {LABELLED_SQL}, c AS (SELECT lang, label AS a, CAST(y % 2 AS VARCHAR) AS b, count(*) AS o FROM labelled GROUP BY ALL)
  SELECT lang, CAST(sum(o) AS BIGINT) AS n, CAST(sum(o) FILTER (WHERE a = 'toxic') AS BIGINT) AS toxic, round(sum(o) FILTER (WHERE b = '1') / sum(o), 6) AS good_share FROM c GROUP BY 1"""
)
def within_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return rounded(rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") == "toxic", 1)).alias("toxic"), F.avg((F.col("y") % 2).cast("double")).alias("good_share")))


@query(
    f"""WITH {symbolic._BASE}, f AS (SELECT {symbolic._argmax_sql('ln')} AS b, {symbolic._argmax_sql(f"list_transform(range(0, {symbolic.K}), lambda i: ln[i + 1] + trigger[i + 1])")} AS r, {symbolic._argmax_sql('lc')} AS c,
    {symbolic._argmax_sql(f"list_transform(range(0, {symbolic.K}), lambda i: lc[i + 1] + trigger[i + 1])")} AS d FROM base) SELECT count(*) AS n, count(*) FILTER (WHERE b <> r) AS by_rules, count(*) FILTER (WHERE b <> c) AS by_free, count(*) FILTER (WHERE b <> d) AS by_both FROM f"""
)
def decision_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = symbolic._rows(spark, sf_dir).withColumn("lc", vectors.log_softmax(symbolic._CARD.logits(F.col("z"))))
    plus = lambda c: vectors.argmax(F.zip_with(c, "trigger", lambda a, b: a + b))
    return pooling.flips(rows.select(vectors.argmax(F.col("ln")).alias("base"), plus("ln").alias("with_rules"), vectors.argmax(F.col("lc")).alias("with_free"), plus("lc").alias("with_both")))


@query(f"WITH {MANIFEST_SQL}, n AS (SELECT item_id, {NORM.format(t='text')} AS norm FROM manifest), f AS (SELECT norm, min(item_id) AS a, count(*) AS c FROM n WHERE length(norm) >= 3 GROUP BY 1) SELECT f.a, n.item_id AS b FROM n JOIN f USING (norm) WHERE f.a < n.item_id")
def duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_links(manifest(spark, sf_dir), None)


@query(
    f"""WITH {symbolic._FIRE}, o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY trigger DESC, class) AS k FROM fr WHERE fired), e AS (SELECT DISTINCT item_id FROM fr)
  SELECT e.item_id, coalesce(o.class, 'c') AS pred, CAST(coalesce(o.class, 'c') <> 'c' AS BIGINT) AS positive FROM e LEFT JOIN o ON o.item_id = e.item_id AND k = 1"""
)
def zero_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, calib, labels = symbolic._features(spark, sf_dir)
    lits = mining.literals(scores, calib)
    cands = mining.clauses(mining.true_literals(scores, lits).join(calib, "item_id", "left_semi"), lits, labels)
    return regimes.transferred(scores, cands.where("rank <= 3").select("class", "lits", "precision"), lits, embedded(spark, sf_dir), "c")


@query(f"WITH {EMBEDDED_SQL} SELECT item_id, round(list_dot_product(u, u), 6) AS self, round(list_dot_product(vec, vec) / (sqrt(list_dot_product(vec, vec)) + 1e-8), 6) AS eps_norm FROM unit")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embedded(spark, sf_dir)
    u = vectors.unit(F.col("vec"))
    return rounded(e.select("item_id", vectors.dot(u, u).alias("self"), vectors.dot(F.col("vec"), vectors.unit_eps(F.col("vec"))).alias("eps_norm")))


@query("WITH e AS (SELECT event_type AS k, value > 50 AS p, round(value, 3) AS s FROM events WHERE value IS NOT NULL), r AS (SELECT k, p, rank() OVER (PARTITION BY k ORDER BY s % 7) + (count(*) OVER (PARTITION BY k, s % 7) - 1) / 2 AS t FROM e) SELECT k, round((sum(t) FILTER (WHERE p) - count(*) FILTER (WHERE p) * (count(*) FILTER (WHERE p) + 1) / 2) / (count(*) FILTER (WHERE p) * count(*) FILTER (WHERE NOT p)), 6) AS auc FROM r GROUP BY 1")
def auc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col("event_type").alias("k"), (F.col("value") > 50).alias("p"), (F.round("value", 3) % 7).alias("s"))
    return rounded(metrics.auc(e, ["k"], "s", F.col("p")))
