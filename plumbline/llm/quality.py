"""Text quality by ordinal cumulative-link regression.

Grades 0 to K-1 share one vector of weights over hashed features (words, their
beginnings, and the shapes of words' ends, which show junk); ordered thresholds
part the grades: P(grade >= k) = sigmoid(w.x - t_k). Thresholds are kept in
order by learning the first and the logarithms of the steps. Scores are the
expected grade and the tail probabilities, by which documents are selected.

Learns from a bounded sample (`most`) of labelled rows; those whose crc32 of the
id modulo 3 is 1 are left out for tests. Any integer grades do: they are taken
in order. Null and empty texts get the score of no feature. Very long texts are
read whole, one at a time. Ties and repeated rows are scored each, equal texts
alike. Without labels, or with one grade only, every text gets that grade (0
without labels) and no tail. An empty table gives an empty result. Rows stay one
to one, other columns as they are; those that have the new columns' names, in
whatever case, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import added, fresh
from plumbline.llm.features import Keys, design, feature_counts, letter_features, presence, sample_of, select, shape_features
from plumbline.llm.words import chunks

#: Labelled rows that the regression learns from, at most.
MOST = 5000
#: Features that it has, at most.
WIDTH = 20_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Ordinal:
    """Grades in order, the weights of hashed features, and the ordered thresholds."""

    grades: np.ndarray
    keys: Keys
    weights: np.ndarray
    thresholds: np.ndarray

    def margins(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for first, last, data, offsets in chunks(texts):
            rows, places = presence([*letter_features(data, offsets), *shape_features(data, offsets)], self.keys)
            out[first:last] = np.bincount(rows, self.weights[places], last - first)[: last - first]
        return out

    def tails(self, margins: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from the second grade on, texts x (K - 1)."""
        return _sigmoid(margins[:, None] - self.thresholds[None, :])

    def expected(self, tails: np.ndarray) -> np.ndarray:
        """The expected grade."""
        return self.grades[0] + tails @ np.diff(self.grades)


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grade: np.ndarray, kinds: int, width: int, ridge: float = 1e-4, steps: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of grades 0..kinds-1 that least the mean negative log likelihood with a ridge."""
    n = len(grade)
    at_least = np.array([(grade >= k).mean() for k in range(1, kinds)])
    start = -np.log(np.clip(at_least, 1e-3, 1 - 1e-3) / (1 - np.clip(at_least, 1e-3, 1 - 1e-3)))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    w, df = np.zeros(width), np.bincount(columns, minlength=width)
    size = np.bincount(rows, minlength=n) + 1.0
    scale = np.minimum(n / np.maximum(df, 1) / max(1.0, float((n / np.maximum(df, 1)).min(initial=np.inf))) if width else np.zeros(0), 200.0)
    rate = 2.0 / max(1.0, float(np.sqrt((size**2).mean())))
    state, before = np.concatenate([w, free]), np.concatenate([w, free])
    for step in range(steps):
        look = state + (step / (step + 3.0)) * (state - before)
        weights, free = look[:width], look[width:]
        gaps = np.exp(np.clip(free[1:], -10, 10))
        t = np.concatenate([[-np.inf], free[:1] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        margin = np.bincount(rows, weights[columns], n)
        low, high = _sigmoid(margin - t[grade]), _sigmoid(margin - t[grade + 1])
        low[grade == 0], high[grade == kinds - 1] = 1.0, 0.0
        p = np.maximum(low - high, 1e-9)
        d_low, d_high = low * (1 - low) / p, high * (1 - high) / p
        slope = -(d_low - d_high) / n
        d_t = np.zeros(kinds - 1)
        np.add.at(d_t, grade[grade > 0] - 1, d_low[grade > 0] / n)
        np.add.at(d_t, grade[grade < kinds - 1], -d_high[grade < kinds - 1] / n)
        tail = np.cumsum(d_t[::-1])[::-1]
        gradient = np.concatenate([np.bincount(columns, slope[rows], width) + ridge * weights * df / n, [tail[0]], tail[1:] * gaps])
        before, state = state, look - rate * np.concatenate([scale, np.ones(kinds - 1)]) * gradient
    free = state[width:]
    return state[:width], free[0] + np.concatenate([[0], np.cumsum(np.exp(np.clip(free[1:], -10, 10)))])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", most: int = MOST) -> Ordinal:
    """A regression learnt from a bounded sample of labelled rows."""
    sample = sample_of(docs, labels, label, most, key, text)
    taught = sample.select("id", "known").toArrow().sort_by("id")
    grades, place = np.unique(taught.column("known").to_numpy(), return_inverse=True)
    if len(grades) < 2:
        return Ordinal(grades if len(grades) else np.zeros(1, np.int64), Keys(np.zeros(0, np.uint64)), np.zeros(0), np.zeros(0))
    counted = feature_counts(sample, lambda known, *_: np.searchsorted(grades, known), shapes=True)
    keys = Keys(select(counted, place.astype(float), least_rows=4, z=4.0, most=WIDTH))
    _, rows, columns = design(sample, keys, shapes=True)
    weights, thresholds = fit_ordinal(rows, columns, place, len(grades), len(keys.keys))
    return Ordinal(grades, keys, weights, thresholds)


def score(docs: DataFrame, model: Ordinal, text: str = "text", expected: str = "expected_grade", tails: str = "tail_probability") -> DataFrame:
    """All rows and columns of `docs` with the expected grade and the array of tail probabilities (replacing columns of those names)."""
    schema = added(docs, T.StructField(expected, T.DoubleType(), False), T.StructField(tails, T.ArrayType(T.DoubleType(), False), False))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tail = held.value.tails(held.value.margins(batch.column(text)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tail) + 1) * tail.shape[1], pa.int32()), pa.array(tail.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-2]), pa.array(held.value.expected(tail)), lists], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def keep(docs: DataFrame, labels: DataFrame, grade_index: int = 1, least: float = 0.5, text: str = "text", **how) -> DataFrame:
    """`docs` whose probability of the grade of that place, or a better one, is at least `least`."""
    grade, name = fresh("_grade", docs), fresh("_tail", docs)
    scored = score(docs, fit(docs, labels, text=text, **how), text, grade, name)
    return scored.where(F.coalesce(F.get(F.col(name), F.lit(grade_index - 1)), F.lit(1.0)) >= least).drop(name, grade)
