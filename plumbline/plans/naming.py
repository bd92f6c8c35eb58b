"""Queries of names: merged words of whole texts split, concepts named by their top members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text, vectors
from plumbline.functions.tables import saved
from plumbline.operators import mining, naming
from plumbline.plans.fixtures import EMBEDDED_SQL, MANIFEST_SQL, embedded, manifest
from plumbline.plans.registry import query, rounded

#: Words in as many texts are common; pieces of a merge must be in more.
_COMMON, _PIECES = 30, 60
#: Spaces after these go, so that merges stand in the texts.
_GLUED = r"(^| )(the|of|is|de|la|und|que|les) "
_SEEN = "SELECT item_id, unnest(list_distinct(regexp_extract_all(lower({t}), '[a-z]+'))) AS word FROM glued"
_SHORT = "', '".join(naming.SHORT)
_STOPS = "', '".join(mining.STOP_WORDS)
_WORDS = rf"""RECURSIVE {MANIFEST_SQL}, glued AS (SELECT item_id, text, regexp_replace(text, '{_GLUED}', '\1\2', 'g') AS merged FROM manifest),
  df AS (SELECT word, count(*) AS n FROM ({_SEEN.format(t='text')}) GROUP BY 1), common AS (SELECT word FROM df WHERE n >= {_COMMON}),
  pieces AS (SELECT word FROM df WHERE n >= {_PIECES} AND length(word) BETWEEN 3 AND {naming.PIECE} UNION SELECT unnest(['{_SHORT}'])), pl AS (SELECT list(word) AS pl FROM pieces),
  seen AS ({_SEEN.format(t='merged')}), u AS (SELECT word, count(*) AS n FROM seen GROUP BY 1),"""


def _dp() -> str:
    """Splits of distinct words by places: every step adds the best split of one more letter."""
    option = f"lambda j: {{'k': len(best[j + 1]), 'j': j, 's': CASE WHEN best[j + 1] IS NOT NULL THEN list_append(best[j + 1], substr(word, j + 1, i + 1 - j)) END, 'p': substr(word, j + 1, i + 1 - j)}}"
    step = f"list_sort(list_filter(list_transform(range(greatest(0, i - {naming.PIECE - 1}), i + 1), {option}), lambda o: o.s IS NOT NULL AND list_contains(pl, o.p)))[1].s"
    return _WORDS + f"""
  dp(word, i, best) AS (SELECT word, 0::BIGINT, [[]::VARCHAR[]] FROM u WHERE length(word) > {naming.MERGE} AND word NOT IN (SELECT word FROM common)
    UNION ALL SELECT word, i + 1, list_append(best, {step}) FROM dp, pl WHERE i < length(word)),
  cut AS (SELECT word, best[i + 1] AS parts FROM dp WHERE i = length(word) AND len(best[i + 1]) > 1),
  g AS (SELECT u.word, unnest(CASE WHEN u.word IN (SELECT word FROM common) THEN [u.word] WHEN parts IS NOT NULL THEN parts WHEN n >= {naming.LEAST} AND length(u.word) > 2 THEN [u.word] ELSE [] END) AS name FROM u LEFT JOIN cut USING (word)),
  names AS (SELECT DISTINCT item_id, name FROM seen JOIN g USING (word) WHERE length(name) > 2 AND name NOT IN ('{_STOPS}'))"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = manifest(spark, sf_dir).select("item_id", "text", F.regexp_replace("text", _GLUED, "$1$2").alias("merged"))
    runs = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word")
    df = saved(docs.select(runs).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= _COMMON))
    short = spark.createDataFrame([(w,) for w in naming.SHORT], "word string")
    pieces = df.where((F.col("n") >= _PIECES) & (F.length("word") > 2)).select("word").unionByName(short)
    return naming.name_words(docs, "merged", df.select("word"), pieces, mining.STOP_WORDS)


@query(f"WITH {_dp()} SELECT item_id, count(*) AS n, md5(string_agg(name, ' ' ORDER BY name)) AS words_md5 FROM names GROUP BY 1")
def name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names' words of every whole text in which small words are glued to the next."""
    return _named(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("word")), " ")).alias("words_md5"))


_TOP = f"""{EMBEDDED_SQL}, mv AS (SELECT y, i, avg(u[i]) AS a FROM unit, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), mc AS (SELECT y, list(a ORDER BY i) AS c FROM mv GROUP BY 1),
  sm AS (SELECT mc.y AS concept, item_id, list_dot_product(u, c) / sqrt(list_dot_product(c, c)) AS score FROM unit, mc), top AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY score DESC, item_id) AS rank FROM sm QUALIFY rank <= {naming.TOP_MEMBERS})"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embedded(spark, sf_dir).select("item_id", "y", vectors.unit(F.col("vec")).alias("u"))
    centres = vectors.mean_vector(e, ["y"], "u").select(F.col("y").alias("id"), vectors.unit(F.col("mean")).alias("x"))
    return naming.top_members(centres, e.select(F.col("item_id").alias("id"), F.col("u").alias("x")))


@query(f"WITH {_TOP} SELECT concept, item_id, rank, round(score, 6) AS score FROM top")
def top_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members nearest each class's mean vector."""
    return rounded(_members(spark, sf_dir))


@query(
    f"""WITH {_TOP}, {MANIFEST_SQL}, w AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 2 AND x NOT IN ('{_STOPS}')))) AS word FROM manifest),
  c AS (SELECT concept, word, count(*) AS n FROM top JOIN w USING (item_id) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY n DESC, word) AS r FROM c)
  SELECT concept, string_agg(word, '-' ORDER BY r) AS name FROM r WHERE r <= 3 GROUP BY 1"""
)
def member_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts without words of their own, named by the texts of their top members."""
    words = manifest(spark, sf_dir).select("item_id", F.explode(F.array_distinct(text.naming_tokens(F.col("text"), mining.STOP_WORDS))).alias("word"))
    return naming.names_of_members(_members(spark, sf_dir).select("concept", "item_id"), words)
