"""Byte-level BPE, encoding and decoding, from a public vocabulary file.

Words of a batch that are new go through the merges together: their symbols lie
in one flat array, every round finds each word's pair of lowest rank by binary
search over sorted pair keys and merges all its places, until no word has a
known pair. A word of over LONG bytes goes alone, and a round looks only at the
places whose pair has its rank, so that time follows its length. Frequent words
are kept in a bounded table from batch to batch.

Null texts count as empty, which give no ids and decode to the empty string;
repeated rows are encoded each. Of equal pairs in a row the first is merged.
Text of any length is encoded whole. An empty table gives an empty result. Other
columns stay, but one that has a result's name, in any case. Added tokens of the
file (such as an end of text) are taken out of the text before words are split,
as the file's own library does by default.

The vocabulary's path is read where the tasks run; a file that only the driver
has is handed out by SparkContext.addFile first and found by its base name.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import added, beside, giving_back

#: Fixed value: how text is parted into words before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that this release of `regex` counts as letters or numbers and the vocabulary's own library,
#: whose tables are older, does not.
NEWER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Words kept with their ids in one worker, beyond which the table is begun anew, and words that are looked up at once. A worker keeps its
#: table through later tasks, so both are small: 400,000 and 200,000 were held before.
KEEP_WORDS, AT_ONCE = 160_000, 80_000
#: Bytes of a word beyond which it goes through its merges alone.
LONG = 2048


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if printable, else the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Bpe:
    """A vocabulary with its merges, as flat sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, stand = spec["model"]["vocab"], byte_characters()
        self.bytes_of: dict[int, bytes] = {i: bytes(map(stand.__getitem__, token)) for token, i in vocab.items() if all(c in stand for c in token)}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of |= {i: token.encode() for token, i in self.added.items()}
        by_byte = {v: k for k, v in stand.items()}
        self.first = np.array([vocab[by_byte[b]] for b in range(256)], np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        newer = "[" + "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in NEWER.split()) + "]"
        exact = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{newer}]").replace(r" ?\p{L}+", rf" ?[\p{{L}}--{newer}]+").replace(r" ?\p{N}+", rf" ?[\p{{N}}--{newer}]+")
        self.plain_words, self.all_words = regex.compile(PATTERN).findall, regex.compile(exact, regex.V1).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        size = max(self.bytes_of) + 1
        pieces = [self.bytes_of.get(i, b"") for i in range(size)]
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.pool = np.frombuffer(b"".join(pieces), np.uint8)
        self.known: dict[str, int] = {}
        self.ids, self.where = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; the number of merges for an unknown one."""
        key, none = (left << 32) | right, len(self.rank)
        at = np.minimum(np.searchsorted(self.keys, key), none - 1)
        return np.where(self.keys[at] == key, self.rank[at], none)

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word: ranks in rising order, each with the places where its pair was seen."""
        n, none = len(word), len(self.rank)
        symbols = np.append(self.first[np.frombuffer(word, np.uint8)], -1)  # the last place ends the word on either side
        after, before, alive = np.append(np.arange(1, n + 1), n), np.append(n, np.arange(n)), np.ones(n + 1, bool)
        places_of: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def put(places: np.ndarray) -> None:
            rank = self.ranks(symbols[places], symbols[after[places]])
            order = np.argsort(rank, kind="stable")
            rank, places = rank[order], places[order]
            heads = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
            for a, b in zip(heads, np.append(heads[1:], len(rank)), strict=True):
                if (r := int(rank[a])) < none:
                    if r not in places_of:
                        places_of[r] = []
                        heappush(waiting, r)
                    places_of[r].append(places[a:b])

        put(np.arange(n))
        while waiting:
            r = heappop(waiting)
            places = np.unique(np.concatenate(places_of.pop(r)))
            places = places[alive[places]]
            places = places[self.ranks(symbols[places], symbols[after[places]]) == r]
            if not len(places):
                continue
            runs = np.concatenate([[True], after[places[:-1]] != places[1:]])
            begin = np.maximum.accumulate(np.where(runs, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - begin) % 2 == 0]
            right = after[places]
            symbols[places], alive[right] = self.result[r], False
            after[places] = after[right]
            before[after[places]] = places
            near = before[places]
            put(np.unique(np.concatenate([places, near[near < n]])))
        return symbols[:n][alive[:n]]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words in one flat array, and each word's first place in it."""
        lengths = np.array([len(w) for w in words], np.int64)
        long = np.flatnonzero(lengths > LONG)
        done_symbols = [self.merge_long(words[k]) for k in long]
        done_owner = [np.full(len(x), k) for k, x in zip(long, done_symbols, strict=True)]
        symbols = self.first[np.frombuffer(b"".join(w for w in words if len(w) <= LONG), np.uint8)]
        owner = np.repeat(np.arange(len(words)), np.where(lengths > LONG, 0, lengths))
        none = len(self.rank)
        while len(symbols):
            rank = np.append(np.where(owner[:-1] == owner[1:], self.ranks(symbols[:-1], symbols[1:]), none), none)
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(symbols)))
            if (finished := best == none).any():
                out = np.repeat(finished, sizes)
                done_symbols.append(symbols[out])
                done_owner.append(owner[out])
                symbols, owner, rank = symbols[~out], owner[~out], rank[~out]
                best, sizes = best[~finished], sizes[~finished]
                if not len(symbols):
                    break
            hit = rank == np.repeat(best, sizes)
            places = np.flatnonzero(hit)
            # of places in a row, as in "aaa", every second one from the first
            runs = np.concatenate([[True], np.diff(places) != 1])
            begin = np.maximum.accumulate(np.where(runs, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - begin) % 2 == 0]
            symbols[places] = self.result[rank[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    def _learn(self, words: set[str]) -> None:
        fresh = list(words)
        ids, where = self.merge([w.encode() for w in fresh])
        base = len(self.where) - 1
        self.known.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.where = np.concatenate([self.where, self.where[-1] + where[1:]])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(self._parts(text or ""))
            size += len(group[-1])
            if size > AT_ONCE:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group)

    def words(self, text: str) -> list[str]:
        """The text in words; the pattern that knows of newer code points is slower and seldom needed."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.all_words(text)
        return self.plain_words(text)

    def _parts(self, text: str) -> list[str]:
        if not self.split or not any(token in text for token in self.added):
            return self.words(text)
        return [w for k, part in enumerate(self.split(text)) for w in ([part] if k % 2 else self.words(part))]

    def _encode(self, group: list[list[str]]) -> list[np.ndarray]:
        fresh = set().union(*group).difference(self.known) if group else set()
        if len(self.known) + len(fresh) > KEEP_WORDS:
            self.known, self.ids, self.where = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
            fresh = set().union(*group)
        if special := fresh & self.added.keys():
            base = len(self.where) - 1
            self.known.update(zip(special, range(base, base + len(special)), strict=True))
            self.ids = np.concatenate([self.ids, np.array([self.added[w] for w in special], np.int32)])
            self.where = np.concatenate([self.where, self.where[-1] + 1 + np.arange(len(special))])
            fresh -= special
        if fresh:
            self._learn(fresh)
        out = []
        for words in group:
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            out.append(take_ranges(self.ids, self.where[at], self.where[at + 1]))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        return take_ranges(self.pool, self.starts[ids], self.starts[ids + 1]).tobytes()


def take_ranges(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The elements of many ranges, one range after the other."""
    lengths = ends - starts
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    step = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return flat[step + np.arange(total)]


_loaded: dict[str, Bpe] = {}


def _of(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """All rows and columns of `docs` with an array<int> column of token ids (replacing a column of that name).

    `vocabulary` is the file's path.
    """
    handed_out(docs, vocabulary)
    schema = added(docs, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False))

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(_find(vocabulary))
        for batch in batches:
            for piece in pieces(batch, text):
                found = bpe.encode(piece.column(text).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(piece.column(f.name) for f in schema.fields[:-1]), lists], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """All rows and columns of `rows` with the text that the ids stand for; null ids give an empty text."""
    handed_out(rows, vocabulary)
    schema = added(rows, T.StructField(text, T.StringType(), False))

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(_find(vocabulary))
        for batch in batches:
            out = pa.array([bpe.decode(np.asarray(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), out], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def digest(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text, decodes the ids again, and gives their count and both SHA-256 sums, as hex.

    The ids are summed as little-endian unsigned 32-bit integers, the decoded text as UTF-8. Rows stay one to one.
    """
    handed_out(docs, vocabulary)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(n, k) for n, k in zip(beside(key, "n_tokens", "ids_sha256", "decoded_sha256"), (T.LongType(), T.StringType(), T.StringType()), strict=True))])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(_find(vocabulary))
        for batch in batches:
            for piece in pieces(batch, text):
                found = bpe.encode(piece.column(text).to_pylist())
                sums = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]
                back = [hashlib.sha256(bpe.decode(x).decode("utf-8", "replace").encode()).hexdigest() for x in found]
                yield pa.RecordBatch.from_arrays([piece.column(key), pa.array([len(x) for x in found], pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())], names=schema.fieldNames())

    return docs.select(key, F.col(text).alias(text)).mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `limit` bytes of text, so that Python objects of few texts live at once."""
    import pyarrow.compute as pc

    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), np.int64)
    sums, first = np.cumsum(lengths), 0
    while first < len(lengths):
        base = sums[first - 1] if first else 0
        last = max(int(np.searchsorted(sums, base + limit, side="right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


def handed_out(docs: DataFrame, path: str) -> None:
    """Has the file sent to all machines unless it already is (once a session)."""
    context = docs.sparkSession.sparkContext
    if os.path.exists(path) and os.path.basename(path) not in {f.rsplit("/", 1)[-1] for f in context.listFiles}:
        context.addFile(path)


def _find(path: str) -> str:
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
