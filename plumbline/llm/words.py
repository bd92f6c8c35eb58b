"""Words of many texts at once: numpy over the bytes of an Arrow string column.

Texts go through in chunks of about a megabyte, so that memory does not follow
the size of a batch; one text is never split. A word's hash is a polynomial in
its bytes modulo 2**64, mixed; equal bytes give equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes that part words: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that are not of a word made of letters (ASCII letters, and all of UTF-8 beyond ASCII).
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES * 2)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of rows in them); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, kind, n + 1 + texts.offset)[texts.offset :].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, flat[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(apart: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes where `apart` is false, within rows: starts, ends, and each row's first run."""
    n = len(apart)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = apart[:-1], apart[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = True
    after[edges - 1] = True
    inside = ~apart
    starts = np.flatnonzero(inside & before)
    return starts, np.flatnonzero(inside & after) + 1, np.searchsorted(starts, offsets)


class Hashes:
    """Hashes of any byte ranges of a chunk."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _power_tables(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * self.power[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + _U(_BASE))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, lower-cased in A-Z and parted by white space, and each row's first word."""
    starts, ends, first = spans(SPACE[data], offsets)
    return Hashes(LOWER[data])(starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row; a row of fewer words, but any, has its whole sequence as one. Not made distinct."""
    counts = np.diff(first)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    where = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(len(counts)), made)
    at = first[:-1][row] + np.arange(where[-1]) - where[:-1][row]
    length = np.minimum(counts, k)[row]
    out = mix(length.astype(np.uint64))
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        out = np.where(j < length, mix(out * _U(_BASE) + padded[at + j]), out)
    return out, where
