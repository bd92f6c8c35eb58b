"""Text as columns: shape features (in Arrow batches), normal forms, cleaning, votes (JVM-side expressions)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = ("n_chars", "n_words", "mean_word_len", "max_word_len", "upper_ratio", "digit_ratio", "punct_ratio", "non_alnum_ratio", "type_token_ratio")

#: What a code point is, in bits, filled by blocks of 256 as they are met: upper case, digit, letter or number, white space.
_KIND = np.zeros(0x110000, np.uint8)
_known = np.zeros(0x1100, bool)
_UPPER, _DIGIT, _ALNUM, _SPACE, _WORD = 1, 2, 4, 8, 16


#: Bytes of a lower-cased text in its normal form: a-z, 0-9 and the mark between texts (0) stay, others are spaces.
_PLAIN = np.array([b if chr(b).isascii() and chr(b).isalnum() and not chr(b).isupper() or not b else 32 for b in range(256)], np.uint8)


def raw(c: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(c, F.lit(""))


def words(c: Column) -> Column:
    """Runs of anything but Unicode white space (U+001C to U+001F included)."""
    return F.filter(F.split(F.regexp_replace(raw(c), r"(?U)[\s\x1c-\x1f]+", " "), " "), lambda x: x != "")


def _kinds(points: np.ndarray) -> np.ndarray:
    """The bits of code points."""
    for block in np.flatnonzero((np.bincount(points >> 8, minlength=len(_known)) > 0) & ~_known):
        for k in range(block << 8, (block + 1) << 8):
            c = chr(k)
            _KIND[k] = c.isupper() * _UPPER | c.isdigit() * _DIGIT | c.isalnum() * _ALNUM | c.isspace() * _SPACE | (c.isalnum() or c == "_") * _WORD
        _known[block] = True
    return _KIND[points]


def _shape_of(t: str | None) -> tuple[float, ...]:
    if not t:
        return (0.0,) * len(FEATURES)
    n, words = len(t), t.split()
    many = np.bincount(_kinds(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)), minlength=32)
    have = lambda bit: int(many[[k for k in range(32) if k & bit]].sum())
    none = int(many[[k for k in range(32) if not k & (_WORD | _SPACE)]].sum())
    lengths = list(map(len, words)) or [0]
    parts = max(1, len(words))
    return (float(n), float(len(words)), sum(lengths) / parts, float(max(lengths)), have(_UPPER) / n, have(_DIGIT) / n, none / n, (n - have(_ALNUM)) / n, len(set(t.lower().split())) / parts)


@F.arrow_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in FEATURES]))
def _shape(texts: pa.Array) -> pa.Array:
    rows = np.array([_shape_of(t.as_py()) for t in texts]).reshape(-1, len(FEATURES))
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(FEATURES))], names=list(FEATURES))


def with_shape(df: DataFrame, c: Column, *keep: str | Column) -> DataFrame:
    """`keep` and the nine shape features: one pass over each text, in Arrow batches that hold the text only."""
    return df.select(*keep, *shape(c))


def shape(c: Column) -> list[Column]:
    """The nine features that look at form only; ratios are 0 for an empty text. Character classes are Python's."""
    found = _shape(c)
    return [found[name].alias(name) for name in FEATURES]


def normal(c: Column) -> Column:
    """Lower case, letters a-z and digits only, single spaces: the form in which texts are exact duplicates."""
    return phrase_normal(c)  # one pass: what is not a letter or digit is a space, and runs of spaces are one


def phrase_normal(c: Column) -> Column:
    """Lower case, every run of other characters one space."""
    return F.trim(F.regexp_replace(F.lower(raw(c)), "[^a-z0-9]+", " "))


def normal_forms(texts: pa.Array) -> list[bytes]:
    """`normal` of texts (null as empty), a batch at once."""
    flat = "\x00".join((t or "").replace("\x00", " ") for t in texts.to_pylist()).lower().encode("utf-8", "replace")
    data = _PLAIN[np.frombuffer(flat, np.uint8)]
    # of spaces in a row the first stays
    gap = data == 32
    return [form.strip(b" ") for form in data[~(gap & np.concatenate([[False], gap[:-1]]))].tobytes().split(b"\x00")] if len(texts) else []


def normal_digests(df: DataFrame, field: str, *keep: str, least: int = 1) -> DataFrame:
    """`keep` and digest, the SHA-256 of the text's normal form (binary); rows whose form has fewer than `least` characters are left out.

    For joins and groups by equal forms: a digest is 32 bytes, where forms are as long as texts. Texts are read once.
    """
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("digest", T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                forms = normal_forms(part.column(len(keep)))
                rows = pa.array([k for k, form in enumerate(forms) if len(form) >= least], pa.int64())
                digests = pa.array([hashlib.sha256(form).digest() for form in forms if len(form) >= least], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(rows) for k in range(len(keep))), digests], names=schema.fieldNames())

    return df.select(*keep, F.col(field).alias("_text")).mapInArrow(run, schema)


def has_phrase(normalised: Column, phrase: str | Column) -> Column:
    """Whether whole words of the phrase stand in a normalised text."""
    p = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.contains(F.concat(F.lit(" "), normalised, F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" ")))


def tweet(c: Column, image_text: Column | None = None) -> Column:
    """Without links and mentions, single spaces, the image's text appended."""
    t = F.regexp_replace(F.regexp_replace(raw(c), r"https?://\S+", " "), r"@\w+", " ")
    joined = F.concat_ws(" ", t, image_text) if image_text is not None else t
    return squeeze(joined)


def squeeze(c: Column) -> Column:
    """Single spaces, no replacement characters."""
    return F.trim(F.regexp_replace(F.translate(raw(c), "�", " "), r"\s+", " "))


def compose(mode: str, source: Column, ocr: Column, caption: Column, prefix: str = "wbms") -> Column:
    """The text channel: none, captions, text read from images, or both joined where the source has captions."""
    has_captions = source.startswith(prefix)
    both = F.trim(F.concat_ws(" ", raw(ocr), raw(caption)))
    return {"none": F.lit(""), "caption": raw(caption), "ocr": raw(ocr), "fused": F.when(has_captions, both).otherwise(raw(ocr)), "parity": F.when(has_captions, raw(ocr)).otherwise(raw(ocr))}[mode]


def source_group(source: Column, prefix: str = "wbms") -> Column:
    """The first source's items by their name's beginning, else the other group."""
    return F.when(source.startswith(prefix), F.lit(prefix)).otherwise(F.lit("other"))


def planted_cue(c: Column) -> Column:
    """A cue that only form shows: upper case and exclamation marks."""
    return F.concat(F.upper(raw(c)), F.lit(" !!!"))


def perturbed(c: Column, draw: Column) -> Column:
    """A near copy: lower case, punctuation to spaces, one word (by the draw) left out of three or more."""
    w = words(F.regexp_replace(F.lower(raw(c)), r"[^\w\s]", " "))
    gone = F.pmod(draw, F.size(w))
    return F.array_join(F.when(F.size(w) >= 3, F.filter(w, lambda x, i: i != gone)).otherwise(w), " ")


def majority_vote(votes: Column, least: int = 2) -> Column:
    """The most common element as a string (the first met, of several), -1 if it has fewer than `least` votes."""
    counted = F.transform(votes, lambda v, i: F.struct(F.size(F.filter(votes, lambda x: x == v)).alias("n"), (-i).alias("first"), v.alias("v")))
    best = F.array_max(counted)
    return F.when(best["n"] >= least, best["v"].cast("string")).otherwise("-1")


def yes_no_vote(votes: Column) -> Column:
    """1 or 0 by the majority of YES and NO, -1 on a tie."""
    yes = F.size(F.filter(votes, lambda x: F.upper(x) == "YES"))
    no = F.size(F.filter(votes, lambda x: F.upper(x) == "NO"))
    return F.when(yes > no, 1).when(no > yes, 0).otherwise(-1)


def top_category(votes: Column, categories: list[str]) -> Column:
    """The place of the category with most votes over all lists, the first of several; -1 without any."""
    flat = F.flatten(votes)
    scored = F.array(*(F.struct(F.size(F.filter(flat, _is(c))).alias("n"), F.lit(-i).alias("place")) for i, c in enumerate(categories)))
    best = F.array_max(scored)
    return F.when(best["n"] > 0, -best["place"]).otherwise(-1)


def _is(category: str):
    return lambda x: x == F.lit(category)


def naming_tokens(c: Column, stop_words: list[str]) -> Column:
    """Lower-case letter runs of over two letters that are no stop words."""
    found = F.regexp_extract_all(F.lower(raw(c)), F.lit("[a-z]+"), F.lit(0))
    stops = F.array(*map(F.lit, stop_words)) if stop_words else F.array().cast("array<string>")
    return F.filter(found, lambda w: (F.length(w) > 2) & ~F.array_contains(stops, w))


def split_merged(word: Column, vocabulary: Column) -> Column:
    """A run-together word as the fewest vocabulary words that spell it (the longest last word on ties), else itself alone.

    Dynamic programming over places: the best split of every beginning.
    """
    n = F.length(word)
    empty = F.array().cast("array<string>")
    # an array that may hold nulls, which stand for beginnings that no words spell
    start = F.filter(F.array(empty, F.lit(None).cast("array<string>")), lambda x: x.isNotNull())

    def step(best: Column, end: Column) -> Column:
        options = F.filter(
            F.transform(F.sequence(F.lit(0), end - 1), lambda b: F.struct(b.alias("b"), F.substring(word, b + 1, end - b).alias("w"), F.get(best, b).alias("before"))),
            lambda o: o["before"].isNotNull() & F.array_contains(vocabulary, o["w"]),
        )
        splits = F.transform(options, lambda o: F.struct((F.size(o["before"]) + 1).alias("k"), o["b"].alias("b"), F.concat(o["before"], F.array(o["w"])).alias("s")))
        return F.concat(best, F.array(F.array_min(splits)["s"]))

    found = F.element_at(F.aggregate(F.sequence(F.lit(1), n), start, step), -1)
    return F.when((n == 0) | found.isNull(), F.array(word)).otherwise(found)


def quoted_label(c: Column) -> Column:
    """What stands in double quotes, else all."""
    return F.when(F.contains(c, F.lit('"')), F.get(F.split(c, '"'), F.lit(1))).otherwise(c)


def parsed_literal(c: Column) -> Column:
    """struct<negated, feature, cut> of a rule's literal like 'NOT name>0.5'; the cut is null for a boolean one."""
    body = F.regexp_replace(c, "^NOT ", "")
    last = r"^(.*)>(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)$"
    has = F.regexp_like(body, F.lit(last))
    return F.struct(
        c.startswith("NOT ").alias("negated"),
        F.when(has, F.regexp_extract(body, last, 1)).otherwise(body).alias("feature"),
        F.when(has, F.regexp_extract(body, last, 2).cast("double")).alias("cut"),
    )
