"""Scans: manifests, embeddings, provenance, and checks that they fit each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.tables import positions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest_schema(fields: list[str], label: str = "label", split: str | None = "split", source: str | None = "source", key: str | None = None) -> T.StructType:
    """Strings for the label, the text fields and what else is named; an id if named."""
    names = [label, *fields, *([split] if split else []), *([source] if source else [])]
    head = [T.StructField(key, T.LongType())] if key else []
    return T.StructType([*head, *(T.StructField(n, T.StringType()) for n in dict.fromkeys(names))])


def read_manifest(spark: SparkSession, path: str, schema: T.StructType | None = None, key: str = "item_id") -> DataFrame:
    """A CSV (with header) or Parquet manifest; missing strings are empty.

    Where rows have no id they get one from their content: a hash, made distinct among equal rows by their number, so that
    splits and draws don't change with the file's partitioning.

    A CSV without a schema is read as strings by its header.
    """
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        df = reader.csv(path)
        if schema is not None:
            df = df.select(*(F.col(f.name).cast(f.dataType) for f in schema if f.name in df.columns))
    df = df.na.fill("")
    if key in df.columns:
        return df
    content = F.xxhash64(*df.columns)
    hashed = df.withColumn("_content", content)
    # equal rows are numbered; whichever of them gets which number makes no difference
    times = F.row_number().over(Window.partitionBy("_content").orderBy(*df.columns))
    return hashed.withColumn(key, F.when(times == 1, F.col("_content")).otherwise(F.xxhash64("_content", times))).drop("_content")


def label_dim(df: DataFrame, label: str) -> DataFrame:
    """label, code: distinct labels in order, from 0."""
    distinct = df.select(F.col(label).cast("string").alias("label")).distinct()
    return distinct.withColumn("code", (F.row_number().over(Window.orderBy("label")) - 1).cast("long"))


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """field, source, method from JSON {field: {source: method}}."""
    text = spark.read.option("wholetext", True).text(path)
    nested = F.from_json("value", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))
    return text.select(F.explode(nested).alias("field", "m")).select("field", F.explode("m").alias("source", "method"))


def embedding_spec(spec: str) -> tuple[str, str, str]:
    """(encoder, view, path) of 'ENCODER:VIEW=path', view 'image' or 'text:FIELD'."""
    name, eq, path = spec.partition("=")
    encoder, colon, view = name.partition(":")
    if not (eq and colon and encoder and path and (view == "image" or view.startswith("text:"))):
        raise ValueError(f"not ENCODER:VIEW=path: {spec!r}")
    return encoder, view, path


def read_embeddings(spark: SparkSession, specs: list[str], ids: DataFrame | None = None, key: str = "item_id") -> DataFrame:
    """item_id, encoder, view, enc_order, vec; encoders in the order they are named, weakest first.

    Parquet files have `item_id` and `vec`. An .npy file, or the array that `path.npz#key` names in an archive, holds one row
    per id, in the order of ids; `path.npz#key@ids` names the archive's array of ids besides, by which rows are then known, as
    text and in any order. Tasks read their rows from the path, which all machines must see.
    """
    out = None
    order: dict[str, int] = {}
    for spec in specs:
        encoder, view, path = embedding_spec(spec)
        place = order.setdefault(encoder, len(order))
        file, _, array = path.partition("#")
        if file.endswith((".npy", ".npz")):
            if ids is None:
                raise ValueError("an .npy file needs the manifest's ids")
            name, by_id, held_ids = array.partition("@")
            items = ids.select(F.col(key).alias("item_id"))
            part = _by_held_ids(items, file, name, held_ids) if by_id else _npy_rows(items, file, array)
        else:
            part = spark.read.parquet(path).select(F.col(key).alias("item_id"), F.col("vec").cast("array<double>").alias("vec"))
        part = part.select("item_id", F.lit(encoder).alias("encoder"), F.lit(view).alias("view"), F.lit(place).alias("enc_order"), "vec")
        out = part if out is None else out.unionByName(part)
    return out


def _array(file: str, name: str) -> np.ndarray:
    held = np.load(file, mmap_mode="r") if not name else np.load(file)[name]
    if held.ndim != 2:
        raise ValueError(f"{file}: not rows of vectors")
    return held


def _npy_rows(ids: DataFrame, file: str, name: str) -> DataFrame:
    """item_id, vec: row k of the array for the k-th id. Each task reads its own rows."""
    places = positions(ids)
    rows, many = len(_array(file, name)), ids.count()
    if rows != many:
        raise ValueError(f"{file}: {rows} rows for {many} items")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _array(file, name)
        for batch in batches:
            x = np.asarray(held[batch.column("pos").to_numpy()], np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), lists], names=["item_id", "vec"])

    return places.mapInArrow(read, T.StructType([ids.schema["item_id"], T.StructField("vec", T.ArrayType(T.DoubleType()))]))


#: Rows of an archive that a task turns into vectors at once.
_ROWS = 8192


def _by_held_ids(ids: DataFrame, file: str, name: str, held_ids: str) -> DataFrame:
    """item_id, vec: the rows whose id the archive holds; an item that it lacks is an error. Of a repeated id the first row counts."""
    spark, n = ids.sparkSession, len(np.load(file)[held_ids])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = names = None
        for batch in batches:
            for first in batch.column(0).to_pylist():
                if held is None:
                    held, names = _array(file, name), np.load(file)[held_ids]
                x = np.asarray(held[first : first + _ROWS], np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                known = names[first : first + _ROWS].astype(str).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(x)), pa.int64()), pa.array(known, pa.string()), lists], names=["_row", "_id", "vec"])

    rows = spark.range(0, max(n, 1), _ROWS).mapInArrow(read, "_row long, _id string, vec array<double>")
    rows = rows.groupBy("_id").agg(F.min_by("vec", "_row").alias("vec"))
    joined = ids.join(rows, ids["item_id"].cast("string") == rows["_id"], "left")
    missing = joined.where("vec IS NULL").limit(1).count()
    if missing:
        raise ValueError(f"{file}: no vector for some items")
    return joined.select("item_id", "vec")


def aligned(items: DataFrame, emb: DataFrame, key: str = "item_id") -> DataFrame:
    """One row: items, embedded, and how many of either side miss the other (both should be 0)."""
    a, b = items.select(key), emb.select(key)
    return a.agg(F.count("*").alias("items")).join(b.agg(F.count("*").alias("embedded"))).join(a.join(b, key, "left_anti").agg(F.count("*").alias("without_vector"))).join(b.join(a, key, "left_anti").agg(F.count("*").alias("without_item")))
