"""How the test tables stand for audited data, in Spark and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.rng import draw, draw_sql
from plumbline.sources.manifest import table

SPLIT = "CASE WHEN {k} % 20 < 14 THEN 'train' WHEN {k} % 20 < 17 THEN 'val' ELSE 'test' END"
#: Classes of a document: quality and toxicity together.
CLASSES = 4


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, text, title (first 80 characters), lang, source, split."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"), F.substring(F.coalesce("text", F.lit("")), 1, 80).alias("title"), "lang", "source", F.expr(SPLIT.format(k="doc_id")).alias("split"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's labelled rows, with y (0 to 3) and label (toxic or clean)."""
    lb = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), (F.col("quality") + 2 * F.col("toxic")).cast("long").alias("y"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("label"))
    return manifest(spark, sf_dir).join(lb, "item_id")


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, vec (unit length up to rounding), y (0 to 9), split."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.col("label").cast("long").alias("y"), F.expr(SPLIT.format(k="vec_id")).alias("split"))


def predictions(spark: SparkSession, sf_dir: str, seeds: int = 5) -> DataFrame:
    """item_id, y, seed, pa (a better system), pb (a weaker one): the truth, moved to the next class for drawn rows."""
    base = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), (F.col("quality") + 2 * F.col("toxic")).cast("long").alias("y"))
    each = base.withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(seeds - 1).cast("long"))))
    wrong = lambda side, share: draw(side, F.col("seed"), F.col("item_id")) % 100 < share
    moved = (F.col("y") + 1) % CLASSES
    return each.select("item_id", "y", "seed", F.when(wrong("a", 15), moved).otherwise(F.col("y")).alias("pa"), F.when(wrong("b", 30), moved).otherwise(F.col("y")).alias("pb"))


MANIFEST_SQL = f"""manifest AS (
  SELECT doc_id AS item_id, coalesce(text, '') AS text, substr(coalesce(text, ''), 1, 80) AS title, lang, source, {SPLIT.format(k="doc_id")} AS split FROM documents)"""
LABELLED_SQL = f"""{MANIFEST_SQL},
labelled AS (
  SELECT m.*, CAST(l.quality + 2 * l.toxic AS BIGINT) AS y, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END AS label FROM manifest m JOIN labels l ON l.doc_id = m.item_id)"""
EMBEDDED_SQL = f"""embedded AS (
  SELECT vec_id AS item_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, CAST(label AS BIGINT) AS y, {SPLIT.format(k="vec_id")} AS split FROM embeddings),
unit AS (
  SELECT *, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)) AS u FROM embedded)"""
PRED_SQL = f"""pred AS (
  SELECT doc_id AS item_id, CAST(quality + 2 * toxic AS BIGINT) AS y, seed,
    CASE WHEN {draw_sql("'a'", "seed", "doc_id")} % 100 < 15 THEN (quality + 2 * toxic + 1) % {CLASSES} ELSE quality + 2 * toxic END AS pa,
    CASE WHEN {draw_sql("'b'", "seed", "doc_id")} % 100 < 30 THEN (quality + 2 * toxic + 1) % {CLASSES} ELSE quality + 2 * toxic END AS pb
  FROM labels, (SELECT unnest(range(5)) AS seed))"""
NORM = "trim(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"
#: Words of a text in DuckDB.
WORDS = "list_filter(regexp_split_to_array(coalesce({t}, ''), '[\\s\\x1c-\\x1f]+'), lambda x: x <> '')"
