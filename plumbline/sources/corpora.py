"""Readers of labelled corpora in their usual file layouts; each gives id, text, y and, where there is one, split."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text


def _s(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def json_lists(spark: SparkSession, paths: dict[str, str], key: str = "image_id", field: str = "text", label: str = "label") -> DataFrame:
    """One JSON list of records per split."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField(field, T.StringType()), T.StructField(label, T.LongType())])
    parts = [spark.read.schema(schema).option("multiLine", True).json(p).select(F.col(key).alias("id"), text.raw(F.col(field)).alias("text"), F.col(label).alias("y"), F.lit(s).alias("split")) for s, p in paths.items()]
    return union(parts)


def csv_targets(spark: SparkSession, path: str, key: str = "name", field: str = "text", target: str = "target", split: str = "split") -> DataFrame:
    """A CSV whose missing targets ('NA' or empty) become -1."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    y = F.when(F.col(target).isNull() | F.col(target).isin("NA", ""), -1).otherwise(F.col(target).cast("double").cast("long"))
    return df.select(F.col(key).alias("id"), text.raw(F.col(field)).alias("text"), y.cast("long").alias("y"), F.col(split).alias("split"))


def json_lines(spark: SparkSession, paths: dict[str, str], key: str = "id", field: str = "text", label: str = "label") -> DataFrame:
    """JSON lines per split; records without a label are left out."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField(field, T.StringType()), T.StructField(label, T.LongType())])
    return union([spark.read.schema(schema).json(p).where(F.col(label).isNotNull()).select(F.col(key).alias("id"), text.raw(F.col(field)).alias("text"), F.col(label).alias("y"), F.lit(s).alias("split")) for s, p in paths.items()])


def first_known_label(labels: Column, codes: dict[str, int]) -> Column:
    """The code of the first label in an array that is known; null without any."""
    known = F.create_map(*(x for k, v in codes.items() for x in (F.lit(k), F.lit(v))))
    return F.get(F.filter(F.transform(labels, lambda x: F.element_at(known, x)), lambda v: v.isNotNull()), F.lit(0)).cast("long")


def two_corpora(spark: SparkSession, paths: dict[tuple[str, str], str], codes: dict[str, int]) -> DataFrame:
    """JSON lines keyed by (source, split): id, image, text, labels; rows without a known label are left out."""
    schema = T.StructType([*_s("id", "image", "text").fields, T.StructField("labels", T.ArrayType(T.StringType()))])
    parts = [spark.read.schema(schema).json(p).select("id", "image", text.raw(F.col("text")).alias("text"), first_known_label(F.col("labels"), codes).alias("y"), F.lit(source).alias("source"), F.lit(split).alias("split")) for (source, split), p in paths.items()]
    return union(parts).where("y IS NOT NULL")


def zip_members(spark: SparkSession, path: str, ending: str = ".json") -> DataFrame:
    """member, content of every member of the ZIP files under a path with that ending; each archive is opened where it is read."""

    def run(batches: Iterator) -> Iterator:
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if name.endswith(ending):
                            yield pd.DataFrame({"member": [name], "content": [archive.read(name).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "member string, content string")


def voted_tweets(spark: SparkSession, truth: str, splits: dict[str, str], members: DataFrame | None = None) -> DataFrame:
    """Tweets of a JSON map id -> {tweet_text, labels}, by split lists of ids: id, text (cleaned, the image's text appended), y by majority, split."""
    kind = T.MapType(T.StringType(), T.StructType([T.StructField("tweet_text", T.StringType()), T.StructField("labels", T.ArrayType(T.LongType()))]))
    rows = spark.read.option("wholetext", True).text(truth).select(F.explode(F.from_json("value", kind)).alias("id", "v"))
    ids = union([spark.read.text(p).select(F.trim("value").alias("id"), F.lit(s).alias("split")) for s, p in splits.items()])
    joined = rows.join(ids, "id")
    if members is not None:
        shown = members.select(F.regexp_extract("member", r"([^/]+)\.json$", 1).alias("id"), F.from_json("content", "img_text string")["img_text"].alias("img"))
        joined = joined.join(shown, "id", "left")
    else:
        joined = joined.withColumn("img", F.lit(None).cast("string"))
    return joined.select("id", text.tweet(F.col("v.tweet_text"), F.col("img")).alias("text"), text.majority_vote(F.col("v.labels")).cast("long").alias("y"), "split")


def annotated_map(spark: SparkSession, path: str, lang: str = "en") -> DataFrame:
    """A JSON map id -> {lang, text, labels_task4, labels_task6} of one language: id, text, y by YES/NO votes, categories."""
    kind = T.MapType(T.StringType(), T.StructType([*_s("lang", "path_memes", "text").fields, T.StructField("labels_task4", T.ArrayType(T.StringType())), T.StructField("labels_task6", T.ArrayType(T.ArrayType(T.StringType())))]))
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", kind)).alias("id", "v")).where(F.col("v.lang") == lang)
    return rows.select("id", text.squeeze(F.col("v.text")).alias("text"), text.yes_no_vote(F.col("v.labels_task4")).cast("long").alias("y"), F.col("v.labels_task6").alias("categories"), F.col("v.path_memes").alias("image"))


def text_and_labels(spark: SparkSession, texts: str, labels: str, names: list[str], key: str = "file_name", field: str = "Text Transcription") -> DataFrame:
    """A TSV of texts with a header, joined on the file name to a TSV of labels without one (columns: key, then `names`)."""
    a = spark.read.option("header", True).option("sep", "\t").csv(texts)
    b = spark.read.option("sep", "\t").schema(T.StructType([T.StructField(key, T.StringType()), *(T.StructField(n, T.LongType()) for n in names)])).csv(labels)
    return a.join(b, key).select(F.col(key).alias("id"), text.raw(F.col(field)).alias("text"), *names)


#: Column names by which a corpus is understood, in order of preference.
ALIASES = {"text": ("text", "caption", "ocr", "transcription", "text transcription", "sentence"), "label": ("label", "labels", "class", "hate", "misogynous", "target"), "id": ("id", "file_name", "image", "img", "name", "image_id")}


def by_alias(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """text, label and id columns under whatever known names (in any case, spaces around) a table has them; ValueError if one lacks."""
    have = {c.strip().lower(): c for c in reversed(df.columns)}
    picked = {}
    for want, names in aliases.items():
        found = next((have[n] for n in names if n in have), None)
        if found is None:
            raise ValueError(f"no column for {want!r} in {df.columns}")
        picked[want] = found
    return df.select(*(F.col(f"`{c}`").alias(w) for w, c in picked.items()))


def only_existing(df: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Rows whose file is listed."""
    return df.join(files.select(key).distinct(), key, "left_semi")


def not_cached(items: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Items that a cache (of texts read from images, or vectors) lacks."""
    return items.join(cache.select(*keys).distinct(), keys, "left_anti")


def content_key(c: Column) -> Column:
    """A hash by which caches know a content."""
    return F.sha1(text.raw(c).cast("binary"))


def with_model_text(files: DataFrame, reader, key: str = "path") -> DataFrame:
    """key, text from images by a caller's reader of bytes -> text, loaded once per task. files: key, content."""
    schema = T.StructType([files.schema[key], T.StructField("text", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        read = reader()
        for batch in batches:
            yield batch[[key]].assign(text=[read(bytes(c)) for c in batch["content"]])

    return files.select(key, "content").mapInPandas(run, schema)


def with_vectors(items: DataFrame, encoder, column: str, key: str = "item_id") -> DataFrame:
    """key, vec by a caller's encoder of a list -> array, loaded once per task; vectors of unit length."""
    import numpy as np

    schema = T.StructType([items.schema[key], T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator) -> Iterator:
        encode = encoder()
        for batch in batches:
            x = np.asarray(encode(list(batch[column])), float)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield batch[[key]].assign(vec=list(x))

    return items.select(key, column).mapInPandas(run, schema)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def known(df: DataFrame, label: str = "y") -> DataFrame:
    """The rows that have a label (-1 and null stand for none)."""
    return df.where(F.col(label) >= 0)
