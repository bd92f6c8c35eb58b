"""A training corpus from `documents`: five operators of plumbline.llm, one after the other.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again for the next one.

For every stage: a null or empty text is kept as it is (no voter hits it, it has
no lines, shingles or tokens) and ends as a row of 0 tokens. Very long texts are
read whole. Equal texts are treated alike; of near copies the row of the smallest
id stays, with all rows of that id. Rows without id stay and name no group.
Repeated rows move together. Other columns, whatever their names, stay up to the
last stage, but for those that have the names of its results. An empty table
gives an empty one of the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.tables import dropped, kept_until_exit, swept
from plumbline.llm import bpe, jaccard, line_dedup, mixing, queries, toxicity
from plumbline.llm.common import shared_folder, table

#: The mix: entropy as a share of the most possible, and the most epochs of a source.
ENTROPY, REPETITION = 0.98, 2.0
#: Near copies: words of a shingle, and the least similarity in hundredths (op9's own query has four words and 85).
WORDS, LEAST = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of later occurrences of three-line windows."""
    return line_dedup.dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_first(docs, k=WORDS, least=LEAST)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of smaller sources as often as the mix has them."""
    return mixing.mix(docs, entropy=ENTROPY, repetition=REPETITION)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and sums of ids and of the decoded text, per row."""
    return bpe.digest(docs, queries.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("bpe", tokenize),
]

#: SQL can't express the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared checkpoint folder and read again; a stage's folder goes when the next one is written, the last with the session; its shuffles go with its end."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            dropped(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
        swept(spark)
    kept_until_exit(spark, folder)
    return docs
