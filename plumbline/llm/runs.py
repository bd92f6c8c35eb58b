"""Periodic runs of words: stretches that repeat a period at least EXPONENT times, found by harmonic grid probing.

Words are parted by space and U+0009 to U+000D and told apart as they are. A run
has a smallest period q (words q apart are equal), at least LEAST words and
EXPONENT * q, and no neighbouring word extends it.

For every period p the grid points are the multiples of p. A run of period p has
four of them in a row, so three pairs (jp, (j+1)p) of equal words in a row, of
which one has a j divisible by three: those are probed, n ln n / 3 tests for n
words. A survivor whose neighbours agree is extended both ways by comparing
chunks of the words with those p later. Grid pairs within a run found before
whose period divides p are passed over: a stretch of period p that has at least
four periods shares no such pair with a run of a smaller dividing period unless
it lies within that run. Periods are gone through by doublings, so that the
divisors of a doubling's periods all lie before it.

Null and empty texts have no words and no runs. A text of any length is searched
whole, in slices of a bounded number of grid points. Runs may overlap; all are
given, by start, then period. Repeated rows are searched each. An empty table
gives an empty result. Other columns stay, but one that has a result's name, in
any case.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bpe import pieces
from plumbline.llm.common import added, beside, fresh

LEAST, EXPONENT = 6, 4
#: Texts up to this many words share one grid; grid points of a slice for longer ones.
SHORT, SLICE = 4096, 1 << 20
#: Words by which all survivors are extended at once, and survivors of such a step.
AT_ONCE, SURVIVORS = 64, 1 << 14


def _points(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Periods from low to high (exclusive) and every third of their grid points jp with (j+1)p < n."""
    periods = np.arange(low, high)
    many = (n - 1) // periods
    many = (many + 2) // 3
    p = np.repeat(periods, many)
    j = 3 * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    return p, j * p


@cache
def _short() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grid of SHORT words by the least length that reaches a point: lengths, periods, points."""
    p, a = _points(SHORT, 1, SHORT // EXPONENT + 1)
    need = np.maximum(a + p + 1, EXPONENT * p)
    order = np.argsort(need, kind="stable")
    return need[order], p[order], a[order]


class Finder:
    """The runs of one sequence of word numbers."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run, by start, then period."""
        if self.n >= LEAST:
            if self.n <= SHORT:
                need, p, a = _short()
                reach = np.searchsorted(need, self.n, side="right")
                self._slices(p[:reach], a[:reach])
            else:
                low, most = 1, self.n // EXPONENT
                while low <= most:
                    # a doubling of periods, in slices
                    top = min(2 * low, most + 1)
                    while low < top:
                        step = max(1, 3 * SLICE * low // self.n)
                        self._slices(*_points(self.n, low, min(low + step, top)))
                        low = min(low + step, top)
        return sorted((int(s), int(e - s), q) for q, (starts, ends) in self.found.items() for s, e in zip(starts, ends, strict=True))

    def _slices(self, p: np.ndarray, a: np.ndarray) -> None:
        alive = self.ids[a] == self.ids[a + p]
        p, a = p[alive], a[alive]
        if len(p):
            order = np.lexsort((a, p))
            p, a = p[order], a[order]
            edges = np.flatnonzero(np.diff(np.frexp(p.astype(float))[1])) + 1
            for q, b in zip(np.split(p, edges), np.split(a, edges), strict=True):
                self._doubling(q, b)

    def _doubling(self, p: np.ndarray, a: np.ndarray) -> None:
        """Runs through survivors whose periods are all within a factor of two; sorted by period, then point."""
        alive = np.ones(len(p), bool)
        for q, (starts, ends) in self.found.items():
            k = np.searchsorted(starts, a, side="right") - 1
            alive &= ~((p % q == 0) & (k >= 0) & (a + p < ends[k]))
        p, a = p[alive], a[alive]
        same = [self._same(a + k * p, p) for k in (-2, -1, 1, 2)]
        three = same[0] & same[1] | same[1] & same[2] | same[2] & same[3]
        p, a = p[three], a[three]
        made: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for k in range(0, len(p), SURVIVORS):
            q, b = p[k : k + SURVIVORS], a[k : k + SURVIVORS]
            ahead, back = self._near(b, q, 1), self._near(b - 1, q, -1)
            closed = (ahead < AT_ONCE) & (back < AT_ONCE)
            good = closed & (ahead + back + q >= np.maximum(LEAST, EXPONENT * q))
            for period, start, end in zip(q[good].tolist(), (b - back)[good].tolist(), (b + ahead + q)[good].tolist(), strict=True):
                made[period].add((start, end))
            period = start = end = -1
            for x, y in zip(q[~closed].tolist(), b[~closed].tolist(), strict=True):
                if x == period and start <= y and y + x < end:
                    continue
                period, start, end = x, y - self._far(y - 1, x, -1), y + x + self._far(y, x, 1)
                if end - start >= max(LEAST, EXPONENT * x):
                    made[x].add((start, end))
        for q, stretches in made.items():
            stretches |= set(zip(*(x.tolist() for x in self.found[q]), strict=True)) if q in self.found else set()
            starts, ends = zip(*sorted(stretches), strict=True)
            self.found[q] = np.array(starts), np.array(ends)

    def _same(self, at: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Whether words `at` and p later are equal; not so outside of the text."""
        inside = (at >= 0) & (at + p < self.n)
        x = np.where(inside, at, 0)
        return inside & (self.ids[x] == self.ids[np.where(inside, at + p, 0)])

    def _near(self, at: np.ndarray, p: np.ndarray, way: int) -> np.ndarray:
        """How many words from `at` on, going one way, equal those p later; AT_ONCE at most."""
        places = at[:, None] + way * np.arange(AT_ONCE)
        same = self._same(places, np.broadcast_to(p[:, None], places.shape))
        return np.where(same.all(axis=1), AT_ONCE, same.argmin(axis=1))

    def _far(self, at: int, p: int, way: int) -> int:
        """As _near, without limit, by chunks."""
        k, size = 0, 256
        most = self.n - p - at if way > 0 else at + 1
        while k < most:
            size = min(size, most - k)
            lo = at + k if way > 0 else at - k - size + 1
            differ = self.ids[lo : lo + size] != self.ids[lo + p : lo + p + size]
            if way < 0:
                differ = differ[::-1]
            first = int(differ.argmax())
            if differ[first]:
                return k + first
            k, size = k + size, min(2 * size, 1 << 16)
        return most


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    return np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))


def planted(n: int, h: int) -> np.ndarray | None:
    """Which word comes at each place when a checksum plants a run in n words; None if it plants none."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def best_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length against period; ties: the smallest start, then period."""
    most, out = Fraction(0), None
    for start, length, period in runs:
        if length * most.denominator > most.numerator * period:
            most, out = Fraction(length, period), (start, length, period)
    return out


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False, keep_text: bool = True) -> DataFrame:
    """`docs` with n_words, runs (start, length, period), best (one of them, or null) and collapsed: the words, one space between,
    without those that any run has after its first period. Without keep_text, key and results alone.

    plant: rows whose key's CRC-32 is divisible by ten (a null key's isn't) get words repeated before the search.
    """
    crc = fresh("_crc", docs)
    run_type = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    fields = [T.StructField(n, k) for n, k in zip(beside(key, "n_words", "runs", "best", "collapsed"), (T.LongType(), T.ArrayType(run_type), run_type, T.StringType()), strict=True)]
    schema = added(docs, *fields) if keep_text else T.StructType([docs.schema[key], *fields])
    stays = schema.fieldNames()[: -len(fields)]
    arrow = pa.struct([(c, pa.int64()) for c in run_type.fieldNames()])

    def one(text: bytes, h: int | None) -> tuple:
        words = text.split()
        ids = numbered(words)
        places = planted(len(words), h) if plant and h is not None else None
        if places is not None:
            ids, words = ids[places], [words[k] for k in places]
        runs = Finder(ids).runs()
        if runs:
            edge = np.zeros(len(words) + 1, np.int64)
            for start, length, period in runs:
                edge[start + period] += 1
                edge[start + length] -= 1
            words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
        named = [dict(zip(run_type.fieldNames(), r, strict=True)) for r in runs]
        best = best_of(runs)
        return len(ids), named, dict(zip(run_type.fieldNames(), best, strict=True)) if best else None, b" ".join(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                rows = [one(t or b"", h) for t, h in zip(piece.column(text).cast(pa.binary()).to_pylist(), piece.column(crc).to_pylist(), strict=True)]
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.list_(arrow), arrow))]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in stays), *made, pa.array([r[3] for r in rows], pa.binary()).cast(pa.string())], names=schema.fieldNames())

    return docs.withColumn(crc, F.crc32(F.col(key).cast("string").cast("binary"))).mapInArrow(run, schema)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = True) -> DataFrame:
    """Per row: key, n_runs, the best run's start, length, period and exponent_milli (null without runs), and SHA-256 sums of the
    runs and of the collapsed text. `plant` as in `find`."""
    runs, best, left = beside(key, "runs", "best", "collapsed")
    names = beside(key, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    b = F.col(best)
    lines = F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")
    milli = F.expr(f"{best}.length * 1000 div {best}.period")
    columns = [F.size(runs).cast("long"), b["start"], b["length"], b["period"], milli, F.sha2(lines.cast("binary"), 256), F.sha2(F.col(left).cast("binary"), 256)]
    found = find(docs.select(key, F.col(text).alias(text)), key, text, plant, keep_text=False)
    return found.select(key, *(c.alias(n) for c, n in zip(columns, names, strict=True)))
