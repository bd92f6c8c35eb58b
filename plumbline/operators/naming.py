"""Words that concepts are named by: common words, merges split into common words, words frequent in the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text, vectors
from plumbline.functions.tables import saved

#: The longest piece, the shortest merge's letters beyond which a word may be split, texts a corpus word needs, naming members.
PIECE, MERGE, LEAST, TOP_MEMBERS = 15, 4, 10, 40
#: Pieces of one or two letters that count.
SHORT = "a i in on at to of it is my me we he be do go no so up us an am or if by".split()


def fewest(length: int, pieces: list[tuple[int, int]]) -> list[tuple[int, int]] | None:
    """The fewest pieces (start, end) that cover 0..length, None if none do.

    Of equally few, every beginning takes the one with the longest last piece. Linear in the pieces.
    """
    best: list[tuple[int, int] | None] = [(0, 0), *[None] * length]  # how many pieces, where the last one starts
    # by end and then start, so that a beginning is settled before pieces that follow it
    for start, end in sorted(pieces, key=lambda p: (p[1], p[0])):
        if best[start] is not None and (best[end] is None or best[start][0] + 1 < best[end][0]):
            best[end] = (best[start][0] + 1, start)
    if best[length] is None:
        return None
    out, at = [], length
    while at:
        out.append((best[at][1], at))
        at = best[at][1]
    return out[::-1]


#: The bits of a table of pieces' hashes are 2 to this power; the hashes' factors.
BITS, _STEP, _LAST = 25, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after the other, and the words' lengths."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), np.array([len(w) for w in words], np.int64)


def _places(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """By length, 1 to PIECE: the table's bit of the substring at each code point."""
    own = codes.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(own), np.uint64)
    for n in range(1, min(PIECE, len(own)) + 1):
        h = h[: len(own) - n + 1] * _STEP + own[n - 1 :]
        yield n, (((h ^ (h >> np.uint64(29))) * _LAST) >> np.uint64(64 - BITS)).astype(np.int64)


def _table(pieces: DataFrame) -> np.ndarray:
    """Bits, in bytes, of the hashes of all pieces. pieces: word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, bool)
        for batch in batches:
            codes, lengths = _laid_out(batch.column(0).to_pylist())
            starts = np.cumsum(lengths) - lengths
            for n, place in _places(codes):
                bits[place[starts[lengths == n]]] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(1 << BITS - 3, np.uint8)
    for r in pieces.coalesce(4).mapInArrow(run, "bits binary").collect():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def _spelled(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """word, s, e: words that begin and end with substrings whose hashes are in the table, and the places of all such substrings."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        codes, lengths = _laid_out(words)
        ends = np.cumsum(lengths)
        of = np.repeat(np.arange(len(words)), lengths)
        at, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, place in _places(codes):
            hit = np.flatnonzero((table[place >> 3] >> (7 - (place & 7))) & 1)
            hit = hit[hit + n <= ends[of[hit]]]
            at.append(hit)
            size.append(np.full(len(hit), n))
        at, size = np.concatenate(at), np.concatenate(size)
        w = of[at]
        s = at - (ends - lengths)[w]
        # only words that a substring begins and one ends
        first, last = np.zeros(len(words), bool), np.zeros(len(words), bool)
        first[w[s == 0]], last[w[s + size == lengths[w]]] = True, True
        kept = (first & last)[w]
        w, s, size = w[kept], s[kept], size[kept]
        order = np.argsort(w, kind="stable")
        w, s, e = w[order], s[order], (s + size)[order]
        bounds = np.flatnonzero(np.diff(w, prepend=-1, append=-1))
        out = [(words[w[a]], s[a:b].tolist(), e[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([],) * 3, (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())))], names=["word", "s", "e"])


def _cut(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """word, parts: words that pieces at these places spell, by the fewest, `least` at least. Batches: word, s, e."""
    for batch in batches:
        out = [(w, [w[a:b] for a, b in cut]) for w, s, e in zip(*(batch.column(c).to_pylist() for c in ("word", "s", "e")), strict=True) if (cut := fewest(len(w), list(zip(s, e, strict=True)))) and len(cut) >= least]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([p for _, p in out], pa.list_(pa.string()))], names=["word", "parts"])


def split_words(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """word, parts: words that two or more pieces spell, by the fewest of them; others are left out.

    words: word, each once; pieces: word. A piece has 15 letters at most; one of one or two letters must be in SHORT. A table of hashes, of a
    fixed size, tells which substrings may be pieces, and words are split by these. The parts then meet the pieces in a join, so neither
    table has a bound. A split of true pieces alone is the one sought: more pieces could only have given fewer or longer parts. Words of other
    splits are few, and all their substrings meet the pieces.
    """
    allowed = pieces.select("word").where(F.length("word").between(1, PIECE)).where((F.length("word") > 2) | F.col("word").isin(SHORT)).distinct()
    table = _table(allowed)
    of_piece = allowed.withColumnRenamed("word", "p")
    placed = lambda rows: rows.mapInArrow(lambda batches: _spelled(batches, table), "word string, s array<int>, e array<int>")
    made = "word string, parts array<string>"
    tried = saved(placed(words.select("word").where(F.length("word") > 1)).mapInArrow(lambda batches: _cut(batches, 1), made))
    parts = tried.select("word", F.size("parts").alias("n"), F.explode("parts").alias("p"))
    true = saved(parts.join(of_piece, "p", "left_semi").groupBy("word", "n").agg(F.count("*").alias("found")).where("found = n").select("word"))
    doubtful = placed(tried.join(true, "word", "left_anti").select("word"))
    each = doubtful.select("word", F.explode(F.arrays_zip("s", "e")).alias("x")).select("word", "x.s", "x.e")
    found = each.withColumn("p", F.substring("word", F.col("s") + 1, F.col("e") - F.col("s"))).join(of_piece, "p", "left_semi")
    held = found.groupBy("word").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    again = held.mapInArrow(lambda batches: _cut(batches, 2), made)
    return tried.where(F.size("parts") > 1).join(true, "word", "left_semi").unionByName(again)


def name_words(docs: DataFrame, field: str, common: DataFrame, pieces: DataFrame, stops: list[str], least: int = LEAST, key: str = "item_id") -> DataFrame:
    """key, word: what a text's letter runs (a to z, lower-cased) give for names, each word once a text.

    A word of `common` stays; another of over four letters that `pieces` spell becomes these; another stays if it is in `least` texts and has
    over two letters; others go, as do stop words and results of one or two letters. common, pieces: word. Every distinct word is judged once.
    """
    runs = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text.raw(F.col(field))), F.lit("[a-z]+"), F.lit(0)))).alias("word")
    seen = docs.select(key, runs)
    # kept, as the split and the judgement both read it
    judged = saved(seen.groupBy("word").agg(F.count("*").alias("n")).join(common.select("word", F.lit(True).alias("common")).distinct(), "word", "left"))
    cut = split_words(judged.where(F.col("common").isNull() & (F.length("word") > MERGE)).select("word"), pieces)
    own = F.col("common").isNotNull() | (F.col("parts").isNull() & (F.col("n") >= least) & (F.length("word") > 2))
    given = judged.join(cut, "word", "left").select("word", F.explode(F.when(own, F.array("word")).otherwise(F.coalesce("parts", F.array().cast("array<string>")))).alias("name"))
    kept = given.where((F.length("name") > 2) & ~F.col("name").isin(stops)) if stops else given.where(F.length("name") > 2)
    # a text's words are no more than the text, so one shuffle by texts makes them distinct
    named = seen.join(kept, "word").groupBy(key).agg(F.collect_set("name").alias("names"))
    return named.select(key, F.explode("names").alias("word"))


def top_members(centres: DataFrame, rows: DataFrame, most: int = TOP_MEMBERS) -> DataFrame:
    """concept, item_id, score, rank: the rows of largest product with each centre, the smaller id first on ties. centres, rows: id, x."""
    return vectors.nearest(centres, rows, most).select(F.col("query_id").alias("concept"), F.col("id").alias("item_id"), F.col("cos").alias("score"), "rank")


def names_of_members(members: DataFrame, words: DataFrame, k: int = 3) -> DataFrame:
    """concept, name: a concept's k words in most of its members (by count, then alphabet), joined by "-". members: concept, item_id; words: item_id, word, each once."""
    counted = members.join(words, "item_id").groupBy("concept", "word").count()
    order = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("count"), "word"))
    best = counted.withColumn("r", order).where(F.col("r") <= k)
    return best.groupBy("concept").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda s: s["word"]), "-").alias("name"))
