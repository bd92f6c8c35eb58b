"""Hashed features of texts, and sparse linear models over them.

Models learn from a bounded sample, a table of `id` (a hash of the document's
id), `known` (its label, null where it has none) and `text`. Its features are
counted, tested and cut by Spark; the driver gets the selected ones and, per
sampled row, their places (at most `most` numbers of 32 bits), never texts or
whole feature sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import crc_mod3, saved
from plumbline.llm.words import LOWER, NO_LETTER, SPACE, Hashes, chunks, mix, spans

#: Lengths in bytes of the word beginnings that are features.
PREFIXES = (4, 5, 6, 7, 8)
#: The shape of a byte: letters of either case, digits; any other byte stands for itself.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91] = 65
SHAPE[97:123] = 97
SHAPE[128:] = 97
SHAPE[48:58] = 48
_PREFIX, _HEAD, _TAIL, _REPEAT = (np.uint64(x) for x in (0x1B56C4E9, 0x2C7A5A17, 0x3D1F6B2B, 0x5A93B0C7))
#: A sample's targets are summed as integers of this unit, so that sums don't depend on their order.
UNIT = 1 << 20


def _row_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def letter_features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, 64-bit features) of a chunk: lower-cased runs of letters, and their beginnings."""
    starts, ends, first = spans(NO_LETTER[data], offsets)
    hashes, rows = Hashes(LOWER[data]), _row_of(first)
    words = hashes(starts, ends)
    yield rows, words
    for k in PREFIXES:
        longer = ends - starts > k
        yield rows[longer], mix(hashes(starts[longer], starts[longer] + k) ^ (_PREFIX + np.uint64(k)))


def shape_features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, features): the shapes of the first two and of the last three bytes of words parted by white space, and repetition.

    Repetition: a word like the last one, or like both before it, or a pair like the pair before it.
    """
    starts, ends, first = spans(SPACE[data], offsets)
    hashes, rows = Hashes(SHAPE[data]), _row_of(first)
    yield rows, mix(hashes(starts, np.minimum(starts + 2, ends)) ^ _HEAD)
    yield rows, mix(hashes(np.maximum(ends - 3, starts), ends) ^ _TAIL)
    words = Hashes(LOWER[data])(starts, ends)
    like = [np.zeros(len(words), bool) for _ in range(2)]
    for back in (1, 2):
        like[back - 1][back:] = (words[back:] == words[:-back]) & (rows[back:] == rows[:-back])
    after = np.zeros(len(words), bool)
    after[1:] = True
    for k, place in enumerate((like[0], like[0] & np.roll(like[0], 1) & after, like[1] & np.roll(like[1], 1) & after & ~like[0])):
        yield rows[place], np.full(int(place.sum()), mix(np.array([_REPEAT + np.uint64(k)]))[0])


def word_key(word: str) -> int:
    """The feature of a lower-cased word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(Hashes(raw)(np.array([0]), np.array([len(raw)]))[0])


class Keys:
    """Quick look-up of many features among few known ones."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(np.asarray(keys, np.uint64))
        self.some = np.zeros(1 << 20, bool)
        self.some[self.keys >> np.uint64(44)] = True

    def find(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `features` that are known, and each one's place in the sorted keys."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.flatnonzero(self.some[features >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.keys, features[near]), len(self.keys) - 1)
        hit = self.keys[at] == features[near]
        return near[hit], at[hit]


def presence(found: list[tuple[np.ndarray, np.ndarray]], keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key place) pairs."""
    rows, places = [], []
    for row, features in found:
        near, at = keys.find(features)
        rows.append(row[near])
        places.append(at)
    pair = np.unique(np.concatenate(rows) * len(keys.keys) + np.concatenate(places)) if rows else np.zeros(0, np.int64)
    return np.divmod(pair, max(1, len(keys.keys)))


def sample_of(docs: DataFrame, labels: DataFrame, label: str, most: int, key: str = "doc_id", text: str = "text", free: int = 0) -> DataFrame:
    """id, known, text: at most `most` labelled documents, and `free` of all (known where they have a label), by the least hashes of their ids.

    Documents without id don't count, nor those whose crc32 modulo 3 is 1, nor labels without id or value. Of several
    labels of one id the largest counts, of several documents of one id the one whose text sorts first.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (crc_mod3(key) != 1))
    taught = usable.groupBy(F.col(key).alias("key")).agg(F.max(label).cast("long").alias("known"))
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    first = lambda ids, n: ids.orderBy(F.xxhash64("key"), "key").limit(n)
    chosen = first(taught.join(own.select("key"), "key", "left_semi"), most)
    if free:
        teaching = own.select("key").where(F.col("key").isNotNull() & (crc_mod3("key") != 1))
        # few more than enough go to the top-n, however many documents there are
        share = 4 * free / max(1, teaching.count())
        some = teaching if share >= 1 else teaching.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
        drawn = first(some, free).distinct().join(taught, "key", "left")
        chosen = chosen.unionByName(drawn).groupBy("key").agg(F.max("known").alias("known"))
    found = own.join(F.broadcast(chosen), "key").groupBy("key", "known").agg(F.min("text").alias("text"))
    return saved(found.select(F.xxhash64("key").alias("id"), "known", "text"))


def distinct_features(data: np.ndarray, offsets: np.ndarray, shapes: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rows, features) of a chunk, each pair once, sorted."""
    found = [*letter_features(data, offsets), *(shape_features(data, offsets) if shapes else [])]
    rows, features = np.concatenate([r for r, _ in found]), np.concatenate([f for _, f in found])
    order = np.lexsort((features, rows))
    rows, features = rows[order], features[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (features[1:] != features[:-1])
    return rows[new], features[new]


def feature_counts(sample: DataFrame, target: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], shapes: bool = False) -> DataFrame:
    """feature, n, total: how many sampled rows have it, and the sum of their targets in UNITs. target: of a chunk's known labels, bytes and offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("known").cast(pa.float64()).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in chunks(batch.column("text")):
                worth = np.rint(target(known[first:last], data, offsets) * UNIT).astype(np.int64)
                rows, features = distinct_features(data, offsets, shapes)
                order = np.argsort(features, kind="stable")
                features, worth = features[order], worth[rows[order]]
                heads = np.flatnonzero(np.concatenate([[True], features[1:] != features[:-1]])) if len(features) else np.zeros(0, np.int64)
                total = np.add.reduceat(worth, heads) if len(heads) else worth
                yield pa.RecordBatch.from_arrays([pa.array(features[heads].view(np.int64)), pa.array(np.diff(np.append(heads, len(features)))), pa.array(total)], names=["feature", "n", "total"])

    met = sample.select("known", "text").mapInArrow(run, "feature long, n long, total long")
    return met.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def strongest(counted: DataFrame, score: Column, least: float, least_rows: int, most: int) -> np.ndarray:
    """The `most` features of at least `least_rows` rows whose score is largest, and `least` at least; the best first."""
    scored = counted.where(F.col("n") >= least_rows).select("feature", score.alias("score")).where(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), "feature").limit(most).select("feature").toArrow().column(0).to_numpy().view(np.uint64)


def select(counted: DataFrame, target: np.ndarray, least_rows: int, z: float, most: int) -> np.ndarray:
    """Features whose mean target differs from that of all sampled rows by `z` standard errors; the `most` furthest."""
    mean, spread = float(target.mean()), max(float(target.std()), 1e-6)
    return strongest(counted, F.abs(F.col("total") / UNIT / F.col("n") - mean) * F.sqrt("n") / spread, z, least_rows, most)


def design(sample: DataFrame, keys: Keys, shapes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sampled ids in order, and (row, key place) of all known features of the rows, on the driver."""
    held = sample.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, last, data, offsets in chunks(batch.column("text")):
                rows, features = distinct_features(data, offsets, shapes)
                near, at = held.value.find(features)
                edges = np.searchsorted(rows[near], np.arange(last - first + 1))
                out += [at[a:b].astype("<i4").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "places"])

    got = sample.select("id", "text").mapInArrow(run, "id long, places binary").toArrow().sort_by("id")
    held.unpersist()
    places = [np.frombuffer(x.as_buffer(), "<i4") for chunk in got.column("places").chunks for x in chunk]
    rows = np.repeat(np.arange(len(places)), [len(p) for p in places])
    return got.column("id").to_numpy(), rows, np.concatenate(places) if places else np.zeros(0, np.int32)


def fit_logistic(rows: np.ndarray, columns: np.ndarray, target: np.ndarray, width: int, ridge: float = 1e-4, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Weights and bias that least the mean cross entropy against targets in [0, 1] with a ridge; Nesterov steps."""
    n = len(target)
    w, b = np.zeros(width + 1), 0.0
    base = float(np.clip(target.mean(), 1e-4, 1 - 1e-4))
    w[width] = np.log(base / (1 - base))
    size = np.bincount(rows, minlength=n) + 1.0
    rate = 4.0 / max(1.0, float(np.sqrt((size**2).mean())))
    before, scale = w.copy(), np.ones(width + 1)
    df = np.bincount(columns, minlength=width)
    scale[:width] = n / np.maximum(df, 1) / np.maximum(1, (n / np.maximum(df, 1)).min())
    scale = np.minimum(scale, 200.0)
    for step in range(steps):
        look = w + (step / (step + 3.0)) * (w - before)
        margin = np.bincount(rows, look[columns], n) + look[width]
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target) / n
        gradient = np.append(np.bincount(columns, error[rows], width) + ridge * look[:width] * df / n, error.sum())
        before, w = w, look - rate * scale * gradient
    b = float(w[width])
    return w[:width], b
