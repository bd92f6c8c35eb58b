"""Line deduplication over overlapping windows of three lines.

Every three consecutive lines of a document form a window. A window whose lines
(without white space around them) occur before, in the order of document id,
then the text's md5, then place, is a later occurrence; the lines that later occurrences
cover, merged, are removed. Each removed line so has an equal line earlier that
stays.

Lines end at U+000A. Windows of nothing but blank lines don't count. Windows of
one document that repeat within it are later occurrences too. Documents of fewer
than three lines stay as they are. Null and empty texts have no windows and come
back unchanged (n_lines 0 and 1); rows equal in id and text are one document
that stays in each of its rows. A null id sorts first. A text of any number of
lines takes time and memory in proportion to its length. An empty table gives an
empty result. Other columns stay, whatever their names; with a report, those
named n_lines or n_removed (in any case) are replaced.

Windows are hashed once and written; they are counted by hash over all documents
with partial aggregates, and only hashes that repeat are joined back. Of these,
the heavy ones (a proven few) are broadcast, so that a line that a third of all
documents share meets in no one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.tables import dropped, written
from plumbline.llm.common import fresh, others, saved

WIDTH = 3
#: A hash with more than a HEAVY-th of all windows is heavy; so there are fewer than HEAVY of them.
HEAVY = 2000
_GAP = "\x1f"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _document(key: str, text: str) -> Column:
    """A document's place among all: its id, then 60 bits of its text's md5."""
    return F.struct(F.col(key).alias("id"), F.conv(F.substring(F.md5(F.col(text).cast("binary")), 1, 15), 16, 10).cast("long").alias("text"))


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per window: _d (document), _p (first line), _h (128 bits of hash)."""
    lines = F.transform(_lines(F.col(text)), lambda x: F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")))
    made = docs.where(F.col(text).isNotNull()).select(_document(key, text).alias("_d"), lines.alias("_l"))

    def window(k: Column) -> Column:
        parts = [F.get(F.col("_l"), k + j) for j in range(WIDTH)]
        joined = F.concat_ws(_GAP, *parts)
        return F.struct(k.alias("p"), F.when(joined != F.lit(_GAP * (WIDTH - 1)), F.struct(F.xxhash64(joined).alias("a"), F.xxhash64(F.lit("again"), joined).alias("b"))).alias("h"))

    each = F.when(F.size("_l") >= WIDTH, F.transform(F.sequence(F.lit(0), F.size("_l") - WIDTH), window))
    return made.select("_d", F.explode(each).alias("_w")).select("_d", F.col("_w.p").alias("_p"), F.col("_w.h").alias("_h")).where("_h is not null")


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document that loses lines, kept: _d and _gone, the sorted places of its removed lines."""
    each, path = written(windows(docs, key, text))
    first = F.min(F.struct("_d", "_p"))
    repeated = saved(each.groupBy("_h").agg(F.count("*").alias("_n"), first.alias("_first")).where("_n > 1"))
    total = repeated.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    heavy, rest = repeated.where(F.col("_n") > total / HEAVY), repeated.where(F.col("_n") <= total / HEAVY)
    later = lambda side: each.join(side.select("_h", "_first"), "_h").where(F.struct("_d", "_p") > F.col("_first")).select("_d", "_p")
    found = later(F.broadcast(heavy)).unionByName(later(rest))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set("_p"), lambda p: F.sequence(p, p + WIDTH - 1)))))
    lost = saved(found.groupBy("_d").agg(covered.alias("_gone")))
    dropped(docs.sparkSession, path)
    return lost


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", report: bool = False) -> DataFrame:
    """`docs` with the lines removed from `text`; all rows and the other columns stay.

    With `report`, columns n_lines and n_removed are added (replacing any of those names).
    """
    own, other, gone, lines = (fresh(name, docs) for name in ("_own", "_other", "_gone", "_lines"))
    lost = removed_lines(docs, key, text).select(F.col("_d").alias(other), F.col("_gone").alias(gone))
    # split before the join, which keeps the optimizer from splitting again for every line
    named = docs.withColumns({own: _document(key, text), lines: _lines(F.col(text))})
    joined = named.drop(text).join(lost, F.col(own).eqNullSafe(F.col(other)), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    left = F.when(F.col(gone).isNull(), F.col(lines)).otherwise(F.transform(places, lambda k: F.get(F.col(lines), k)))
    extra = [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed")] if report else []
    names = others(docs.columns, "n_lines", "n_removed") if report else docs.columns
    return joined.select(*(F.array_join(left, "\n").alias(c) if c.lower() == text.lower() else F.col(c) for c in names), *extra)


#: The same in DuckDB: the query's rows over `documents`.
SQL = """
WITH doc AS (SELECT DISTINCT doc_id, text, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS h, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, h, unnest(range(len(l))) AS p, unnest(l) AS raw FROM doc),
cut AS (SELECT doc_id, h, p, trim(translate(raw, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' ') AS x FROM line),
win AS (SELECT doc_id, h, p, w FROM (
  SELECT doc_id, h, p, x || chr(31) || lead(x, 1) OVER d || chr(31) || lead(x, 2) OVER d AS w FROM cut WINDOW d AS (PARTITION BY doc_id, h ORDER BY p))
  WHERE w IS NOT NULL AND w <> chr(31) || chr(31)),
later AS (SELECT doc_id, h, p FROM (SELECT doc_id, h, p, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, h, p) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, h, p + j AS p FROM later, (VALUES (0), (1), (2)) v(j)),
left_over AS (SELECT l.doc_id, l.h, count(g.p) AS n_removed, count(*) AS n_lines, string_agg(raw, chr(10) ORDER BY l.p) FILTER (WHERE g.p IS NULL) AS kept
  FROM line l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.h = g.h AND l.p = g.p GROUP BY l.doc_id, l.h)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN left_over o ON d.doc_id IS NOT DISTINCT FROM o.doc_id AND CAST('0x' || substr(md5(d.text), 1, 15) AS BIGINT) = o.h
"""
