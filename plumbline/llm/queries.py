"""The queries of this subpackage: one opN_<name> each, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, fim, jaccard, licenses, line_dedup, media, mixing, pii, quality, runs, topk, toxicity
from plumbline.llm.common import crc_mod3, table

#: Mixing: entropy as a share of the most possible, the most epochs of a source, and the budget as a multiple of all tokens.
ENTROPY, REPETITION, PASSES = 0.98, 3.0, 2.0


def vocabulary() -> str:
    """Where the public byte-level vocabulary is."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    rounded = F.transform("found", lambda h: h.withField("coverage", F.round(h["coverage"], 6)))
    return found.withColumns({"coverage": F.round("coverage", 6), "found": rounded})


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    good = F.coalesce(F.element_at("tail_probability", -1), F.lit(1.0))
    held_out = F.coalesce(crc_mod3("doc_id") == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "expected_grade", good.alias("top_probability"), (good >= 0.5).cast("int").alias("keep"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.schedule(table(spark, sf_dir, "documents"), entropy=ENTROPY, repetition=REPETITION, passes=PASSES)
    return plan.select(F.col("id").alias("doc_id"), "source", "tokens", "epoch", "block", F.col("order").alias("place"), F.round("weight", 6).alias("weight"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_mod3("doc_id") == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, sf_dir, "documents"), report=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary())


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.store(table(spark, sf_dir, "documents")))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_quality, op3_source_mixing, op4_toxicity, op5_line_dedup, op6_pii, op7_bpe,
        op8_media, op9_ngram_jaccard, op10_topk, op11_fill_in_middle, op12_decontamination, op13_periodic_runs,
    )
}

ORACLES: dict[str, str] = {
    "op3_source_mixing": mixing.sql(ENTROPY, REPETITION, PASSES),
    "op5_line_dedup": line_dedup.SQL,
    "op9_ngram_jaccard": jaccard.SQL,
    "op10_topk": topk.sql(),
    "op11_fill_in_middle": fim.SQL,
    "op12_decontamination": decontaminate.SQL,
}
