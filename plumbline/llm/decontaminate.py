"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are lower-cased in A-Z and become words (runs of 0-9, a-z and all of
U+0080 and up) with a space behind each. Every WINDOW consecutive words of a
benchmark item are a test string; an item of fewer words, but any, is one as a
whole. Test strings of like length share tables: of their least length m, the
blocks of up to BLOCK bytes in the first m bytes give a shift table, which says
how far the search may move on without passing over a match. Where the shift is
0, the block, a suffix of those m bytes, and the first bytes select a bucket of
test strings, and each of these is compared byte for byte. Many places of a
chunk are searched side by side, each in a lane of its own.

Words inside any occurrence are hit. Items are told apart by id (as text; a null
id is the empty string): rows of one id are one item. Null and empty texts have
no words; an item without words never occurs. Very long texts and items are
searched whole. Repeated rows are searched each. An empty benchmark hits
nothing; an empty table gives an empty result. Other columns of documents stay,
but one that has a result's name, in any case.

The benchmark goes to the tasks in parts of a bounded size (PART_BYTES), one
pass over the documents for each; results of the passes before are carried
along, so there is no shuffle of texts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import added, beside, saved
from plumbline.llm.words import LOWER, Hashes, chunks, mix

WINDOW = 10
#: The most bytes of test strings for a pass, and the words from which an item is cut into pieces (that overlap).
PART_BYTES, PIECE_WORDS = 4 << 20, 4096
#: Bytes of a block at most, end positions of a lane, and least lengths of test strings that share tables.
BLOCK, LANE = 8, 512
CLASSES = (1, 8, 16, 32, 64)
#: Bytes that are compared at once.
COMPARED = 4 << 20
_U = np.uint64
_SPREAD = _U(0x9E3779B97F4A7C15)

#: Bytes of words, after lower-casing.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def normalised(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, places of the rows in them): a row is a 0, then each word with a space behind it."""
    padded = pc.binary_join_element_wise(pa.scalar("\x00"), pc.fill_null(texts, ""), pa.scalar(" "), pa.scalar(""))
    for first, last, data, offsets in chunks(padded):
        low = LOWER[data]
        word = WORD[low]
        keep = word.copy()
        keep[1:] |= word[:-1]
        keep[offsets[:-1]] = True
        low[~word] = 32
        low[offsets[:-1]] = 0
        out = low[keep]
        yield first, last, out, np.flatnonzero(out == 0)


def equal(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n[k] (at least 1) elements of x from a[k] on are those of y from b[k] on."""
    out, ends, first = np.empty(len(a), bool), np.cumsum(n), 0
    while first < len(a):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + COMPARED, side="right")))
        size = n[first:last]
        where = np.concatenate([[0], np.cumsum(size)])
        within = np.arange(where[-1]) - np.repeat(where[:-1], size)
        same = x[np.repeat(a[first:last], size) + within] == y[np.repeat(b[first:last], size) + within]
        out[first:last] = np.logical_and.reduceat(same, where[:-1])
        first = last
    return out


class Loads:
    """Bytes with eight 0 before and behind them, to read as 64-bit integers at any place."""

    def __init__(self, data: np.ndarray):
        self.padded = np.zeros(len(data) + 16, np.uint8)
        self.padded[8:-8] = data
        self.at = np.ndarray((len(data) + 9,), "<u8", self.padded, strides=(1,))

    def before(self, ends: np.ndarray, size: int) -> np.ndarray:
        """The `size` bytes up to each end."""
        return self.at[ends] >> _U(64 - 8 * size)

    def behind(self, starts: np.ndarray, size: int) -> np.ndarray:
        """The `size` bytes from each start on."""
        return self.at[starts + 8] << _U(64 - 8 * size)


class Table:
    """Shift table and buckets of test strings of like length."""

    def __init__(self, loads: Loads, starts: np.ndarray, lengths: np.ndarray, names: np.ndarray):
        m = self.m = int(lengths.min())
        self.block, self.head = min(BLOCK, (m + 1) // 2), min(8, m)
        entries = len(starts) * (m - self.block + 1)
        self.right = _U(64 - min(max(math.ceil(math.log2(8 * entries)), 8), 24))
        far = m - self.block + 1
        self.shifts = np.full(1 << (64 - int(self.right)), min(far, 255), np.uint8)
        for shift in range(min(far - 1, 254), -1, -1):
            self.shifts[self.slot(loads.before(starts + (m - shift), self.block))] = shift
        keys = self.key(loads, starts)
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.lengths, self.names = keys[order], starts[order], lengths[order], names[order]

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks * _SPREAD) >> self.right).astype(np.int64)

    def key(self, loads: Loads, starts: np.ndarray) -> np.ndarray:
        """What selects the bucket: the block that ends the first m bytes, with the first bytes."""
        return mix(loads.before(starts + self.m, self.block) + mix(loads.behind(starts, self.head)))

    def places(self, loads: Loads, n: int) -> np.ndarray:
        """Ends of m bytes at which the shift is 0, among n bytes."""
        at = np.arange(self.m, n + 1, LANE)
        stop, found = np.minimum(at + LANE, n + 1), []
        while len(at):
            shift = self.shifts[self.slot(loads.before(at, self.block))]
            still = shift == 0
            if still.any():
                found.append(at[still])
            at = at + np.maximum(shift, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def occurrences(self, data: np.ndarray, loads: Loads, patterns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Starts, lengths and names of test strings that occur, in slices."""
        starts = self.places(loads, len(data)) - self.m
        starts = starts[(starts > 0) & (data[starts - 1] <= 32)]
        keys = self.key(loads, starts)
        lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        starts, lo, many = starts[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        ends, first = np.cumsum(many), 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + COMPARED // 16, side="right")))
            size = many[first:last]
            where = np.concatenate([[0], np.cumsum(size)])
            which = np.repeat(lo[first:last], size) + np.arange(where[-1]) - np.repeat(where[:-1], size)
            at, length = np.repeat(starts[first:last], size), self.lengths[which]
            fits = at + length <= len(data)
            at, which, length = at[fits], which[fits], length[fits]
            same = equal(data, at, patterns, self.starts[which], length)
            yield at[same], length[same], self.names[which][same]
            first = last


class Searcher:
    """Test strings of pieces of items, made ready. pieces: (item, words with a space behind each)."""

    def __init__(self, pieces: list[tuple[str, bytes]], window: int = WINDOW):
        self.items = sorted({item for item, _ in pieces})
        number = {item: k for k, item in enumerate(self.items)}
        self.text = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
        sizes = np.array([len(p) for _, p in pieces], np.int64)
        after = np.flatnonzero(self.text == 32) + 1
        begins = np.concatenate([[0], after])[:-1]
        ends = np.cumsum(sizes)
        first, last = np.searchsorted(begins, ends - sizes), np.searchsorted(begins, ends)
        many = np.maximum(last - first - window + 1, 1)
        piece = np.repeat(np.arange(len(pieces)), many)
        word = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[piece]
        starts = begins[word]
        lengths = after[np.minimum(word + window, last[piece]) - 1] - starts
        owner = np.array([number[item] for item, _ in pieces], np.int64)[piece]
        # equal test strings become one, named by the first of them; its items are looked up by that name
        hashes = Hashes(self.text)(starts, starts + lengths)
        order = np.lexsort((starts, hashes))
        hashes = hashes[order]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        like = lengths[head] == lengths[order]
        like[like] = equal(self.text, starts[head[like]], self.text, starts[order[like]], lengths[order[like]])
        name = np.empty(len(starts), np.int64)
        name[order] = np.where(like, head, order)
        by_name = np.argsort(name, kind="stable")
        self.sorted_names, self.owners = name[by_name], owner[by_name]
        alone = np.flatnonzero(name == np.arange(len(name)))
        loads = Loads(self.text)
        self.tables = []
        for k, least in enumerate(CLASSES):
            most = CLASSES[k + 1] if k + 1 < len(CLASSES) else math.inf
            some = alone[(lengths[alone] > least) & (lengths[alone] <= most)]
            if len(some):
                self.tables.append(Table(loads, starts[some], lengths[some], some))

    def owners_of(self, names: np.ndarray) -> list[str]:
        """Items that have any of these test strings, sorted."""
        lo, hi = np.searchsorted(self.sorted_names, names), np.searchsorted(self.sorted_names, names, side="right")
        found = np.unique(np.concatenate([self.owners[a:b] for a, b in zip(lo, hi, strict=True)]))
        return [self.items[k] for k in found]

    def search(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, dict[int, tuple[list[tuple[int, int]], list[str]]]]]:
        """(first row, words of each row, of rows with hits: word ranges that are hit, apart from one another, and items)."""
        for first, last, data, rows in normalised(texts):
            loads, spaces = Loads(data), np.flatnonzero(data == 32)
            words = np.append(np.searchsorted(spaces, rows), len(spaces))
            delta, seen = np.zeros(len(spaces) + 1, np.int64), []
            for t in self.tables:
                for at, length, name in t.occurrences(data, loads, self.text):
                    np.add.at(delta, np.searchsorted(spaces, at), 1)
                    np.add.at(delta, np.searchsorted(spaces, at + length - 1) + 1, -1)
                    seen.append(np.unique(np.stack([np.searchsorted(rows, at, side="right") - 1, name]), axis=1))
            hits: dict[int, tuple[list[tuple[int, int]], list[str]]] = {}
            if seen:
                row, name = np.unique(np.concatenate(seen, axis=1), axis=1)
                covered = np.concatenate([[False], np.cumsum(delta)[:-1] > 0, [False]])
                edges = np.flatnonzero(covered[1:] != covered[:-1])
                begins, ends = edges[::2], edges[1::2]
                parts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else []
                for a, b in zip(parts, [*parts[1:], len(row)], strict=True):
                    r = int(row[a])
                    x, y = np.searchsorted(ends, words[r], side="right"), np.searchsorted(begins, words[r + 1])
                    # ranges of two rows that touch are one range among all words
                    spans = [(int(max(s, words[r]) - words[r]), int(min(e, words[r + 1]) - words[r])) for s, e in zip(begins[x:y], ends[x:y], strict=True)]
                    hits[r] = spans, self.owners_of(name[a:b])
            yield first, np.diff(words), hits


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as sorted ranges that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def pieces_of(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """item and piece (words with a space behind each), distinct: pieces of PIECE_WORDS test strings, with which they overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, rows in normalised(batch.column(1)):
                made = []
                for k, (a, b) in enumerate(zip(rows, [*rows[1:], len(data)], strict=True)):
                    words = data[a + 1 : b].tobytes().split(b" ")[:-1]
                    for s in range(0, max(len(words) - window + 1, 1) if words else 0, PIECE_WORDS):
                        made.append((batch.column(0)[first + k].as_py(), b" ".join(words[s : s + PIECE_WORDS + window - 1]) + b" "))
                yield pa.RecordBatch.from_arrays([pa.array([m[j] for m in made], kind) for j, kind in enumerate((pa.string(), pa.binary()))], names=["item", "piece"])

    named = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return named.mapInArrow(run, "item string, piece binary").distinct()


def parts_of(pieces: DataFrame) -> tuple[DataFrame, int]:
    """The pieces, kept, with `part`, and the number of parts: each of PART_BYTES at most, or of a single piece that is longer."""
    kept = saved(pieces)
    size = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("piece")), F.lit(0)).alias("b")).first()
    n = -(-2 * size["b"] // PART_BYTES) if size["b"] > PART_BYTES else min(size["n"], 1)
    while True:
        dealt = kept.withColumn("part", F.pmod(F.xxhash64("item", "piece"), F.lit(max(n, 1))))
        if n <= 1 or not dealt.groupBy("part").agg(F.sum(F.octet_length("piece")).alias("b"), F.count("*").alias("n")).where(f"b > {PART_BYTES} and n > 1").head(1):
            return dealt, n
        n *= 2


_ready: dict[str, Searcher] = {}


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """`docs` with n_words, hits (ranges of words, first to after) and items (ids as text, sorted). Without keep_text, key and results alone."""
    spark, (parts, n) = docs.sparkSession, parts_of(pieces_of(benchmark, item, item_text, window))
    names = beside(key, "n_words", "hits", "items")
    span = T.StructType([T.StructField(c, T.LongType()) for c in ("first", "after")])
    fields = [T.StructField(c, k) for c, k in zip(names, (T.LongType(), T.ArrayType(span), T.ArrayType(T.StringType())), strict=True)]
    # columns that have a result's name go before the first pass
    full = added(docs if keep_text else docs.select(key, text), *fields)
    columns = full.fieldNames()[:-3]
    out = docs.select(*columns).withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields})

    def searched(out: DataFrame, part: int, last: bool) -> DataFrame:
        rows = parts.where(F.col("part") == part).select("item", "piece").toArrow() if n else None
        held = spark.sparkContext.broadcast(list(zip(*(rows.column(c).to_pylist() for c in ("item", "piece")), strict=True)) if rows else [])
        token = uuid.uuid4().hex
        schema = full if keep_text or not last else T.StructType([full[key], *fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if token not in _ready and held.value:
                _ready.clear()
                _ready[token] = Searcher(held.value, window)
            for batch in batches:
                texts = batch.column(text)
                chunked = _ready[token].search(texts) if held.value else ((first, np.diff(np.append(np.searchsorted(np.flatnonzero(data == 32), rows), (data == 32).sum())), {}) for first, _, data, rows in normalised(texts))
                for first, words, hits in chunked:
                    piece = batch.slice(first, len(words))
                    before, ids = piece.column(names[1]).to_pylist(), piece.column(names[2]).to_pylist()
                    for k, (spans, items) in hits.items():
                        before[k] = [{"first": a, "after": b} for a, b in merged([*((h["first"], h["after"]) for h in before[k] or []), *spans])]
                        ids[k] = sorted({*(ids[k] or []), *items})
                    made = [pa.array(words, pa.int64()), pa.array([b or [] for b in before], pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))), pa.array([i or [] for i in ids], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in schema.fieldNames()[:-3]), *made], names=schema.fieldNames())

        return out.mapInArrow(run, schema)

    for part in range(max(n, 1)):
        out = searched(out, part, part + 1 >= n)
        if part + 1 < n:
            out = saved(out)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `docs` in which no test string occurs; columns stay as they are, but one that has a result's name."""
    names = beside(key, "n_words", "hits", "items")
    return find(docs, benchmark, key, text, **how).where(F.size(names[1]) == 0).drop(*names)


def digest(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_hit, n_items, items_sha256 (of the ids, joined by commas) and contaminated."""
    words, hits, items = beside(key, "n_words", "hits", "items")
    n_hit, n_items, sums, bad = beside(key, "n_hit", "n_items", "items_sha256", "contaminated")
    covered = F.aggregate(hits, F.lit(0).cast("long"), lambda s, h: s + h["after"] - h["first"])
    found = find(docs, benchmark, key, text, keep_text=False)
    return found.select(key, words, covered.alias(n_hit), F.size(items).cast("long").alias(n_items), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias(sums), (F.size(hits) > 0).alias(bad))


#: Words in DuckDB, of the column `text`.
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
#: The same in DuckDB: the query's rows over `documents` and `benchmark`.
SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT row_number() OVER () AS r, coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
dw AS (SELECT r, p, list(x) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS l FROM (SELECT r, unnest(range(len(w))) AS p, unnest(w) AS x FROM doc)),
iw AS (SELECT r, p, list(x) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS l FROM (SELECT r, unnest(range(len(w))) AS p, unnest(w) AS x FROM item)),
test AS (SELECT DISTINCT item, len(l) AS n, array_to_string(l, ' ') AS x FROM iw JOIN item USING (r) WHERE len(l) = {WINDOW} OR p = 0),
occ AS (SELECT DISTINCT dw.r, dw.p, t.n, t.item FROM dw JOIN (SELECT DISTINCT n FROM test) k ON len(dw.l) >= k.n JOIN test t ON t.n = k.n AND t.x = array_to_string(dw.l[1:k.n], ' ')),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM occ)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""
