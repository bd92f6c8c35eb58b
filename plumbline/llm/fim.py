"""Fill-in-middle: a text is cut in prefix, middle and suffix, which are laid out anew between sentinels.

Texts are sequences of units (UNITS). One Aho-Corasick automaton goes over a text
once and reports sparse events: ASCII characters that change a unit's class, and
sentinels. What lies between two events is of one class, so its units are
counted by arithmetic: as many as code points, or one. The k-th unit's end is
then a binary search over the events' running counts and an addition; no list of
units is made. Code points are of a single class: there the automaton holds the
sentinels alone, and the text is one stretch.

The cuts and the form come from a SHA-256 over the seed and the row's key, so
that they are the same on every machine and in every run. Two draws modulo one
more than the number of units are where prefix and middle end. Forms: `psm`
(prefix, suffix, middle), `spm` (suffix, prefix, middle) and `plain`, the text as
it is: for a drawn share, and for texts that are empty or hold a sentinel.
Sentinels don't overlap with themselves or one another, and a text that is cut
holds none; so an output says exactly which text it came from, and `restore`
rebuilds it by the same automaton.

Null texts count as empty; empty ones are plain, of 0 units. Very long texts are
cut whole. Repeated rows are cut alike; a null key is drawn as the empty string.
An empty table gives an empty result. Other columns stay, but one that has a
result's name, in any case.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bpe import pieces
from plumbline.llm.common import added, beside, fresh, others

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Hundredths of texts that are cut, and of those in the form spm.
CUT, SPM = 90, 20
SEED = "1"

#: Unit: (the characters that change the class, whether a stretch between them counts each code point or as one unit, whether a
#: changing character ends the stretch before it rather than being of a stretch of such characters).
UNITS: dict[str, tuple[str, bool, bool]] = {
    "code point": ("", True, False),
    "line": ("\n", False, True),
    "word": (" \t\n\x0b\x0c\r", False, False),
}


class Cutter:
    """Counts and cuts texts of one kind of unit."""

    def __init__(self, unit: str = "code point"):
        changing, self.each, self.closing = UNITS[unit]
        self.automaton = ahocorasick.Automaton()
        for c in changing:
            self.automaton.add_word(c, 0)
        for s in SENTINELS:
            self.automaton.add_word(s, len(s))
        self.automaton.make_automaton()

    def events(self, text: str) -> tuple[list[int], bool]:
        """Places of class-changing characters, and whether any sentinel occurs."""
        changes: list[int] = []
        held = False
        for last, kind in self.automaton.iter(text):
            if kind:
                held = True
            else:
                changes.append(last)
        return changes, held

    def stretches(self, text: str, changes: list[int]) -> tuple[list[int], list[int]]:
        """Ends of the stretches of one class, in order, and the units up to each end."""
        ends: list[int] = []
        at, k = 0, 0
        while k < len(changes):
            if self.closing:
                ends.append(changes[k] + 1)
            else:
                if changes[k] > at:
                    ends.append(changes[k])
                while k + 1 < len(changes) and changes[k + 1] == changes[k] + 1:
                    k += 1
                ends.append(changes[k] + 1)
            at, k = changes[k] + 1, k + 1
        if len(text) > at:
            ends.append(len(text))
        return ends, ends if self.each else list(range(1, len(ends) + 1))

    def place(self, ends: list[int], counts: list[int], units: int) -> int:
        """Where the first `units` units end, in code points."""
        k = bisect_left(counts, units)
        return ends[k] - (counts[k] - units if self.each else 0) if units else 0

    def cut(self, text: str, digest: str) -> tuple[int, str, int | None, int | None, str]:
        """(units, form, code points of prefix and of middle, output) of a text and 64 hex digits."""
        changes, held = self.events(text)
        ends, counts = self.stretches(text, changes)
        n = counts[-1] if counts else 0
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        if not text or held or h[2] % 100 >= CUT:
            return n, "plain", None, None, text
        a, b = (self.place(ends, counts, x) for x in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h[3] % 100 < SPM:
            return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
        return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))

    def restored(self, output: str, form: str) -> str:
        """The text that an output was made of: its three parts lie behind the sentinels."""
        if form == "plain":
            return output
        found = [(last + 1, width) for last, width in self.automaton.iter(output) if width]
        first, second, third = (output[a:b] for (a, _), b in zip(found, [*(e - w for e, w in found[1:]), len(output)], strict=True))
        return first + third + second if form == "psm" else second + third + first


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "code point", seed: str = SEED) -> DataFrame:
    """`docs` with n (units of the text), form, prefix_chars, middle_chars (code points; null if plain) and output."""
    digest = fresh("_digest", docs)
    names = beside(key, "n", "form", "prefix_chars", "middle_chars", "output")
    schema = added(docs, *(T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()), strict=True)))
    stays = schema.fieldNames()[: -len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(unit)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            for piece in pieces(batch, text):
                rows = [cutter.cut(t or "", d) for t, d in zip(piece.column(text).to_pylist(), piece.column(digest).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in stays), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=schema.fieldNames())

    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return docs.withColumn(digest, drawn).mapInArrow(run, schema)


def restore(made: DataFrame, output: str = "output", form: str = "form", to: str = "restored") -> DataFrame:
    """`made` with the text rebuilt from output and form alone."""
    schema = added(made, T.StructField(to, T.StringType()))
    stays = others(made.columns, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in batches:
            for piece in pieces(batch, output):
                texts = [cutter.restored(o, f) for o, f in zip(piece.column(output).to_pylist(), piece.column(form).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in stays), pa.array(texts, pa.string())], names=schema.fieldNames())

    return made.mapInArrow(run, schema)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n, form, prefix_chars, middle_chars, and the SHA-256 sums of output and of the text rebuilt from it."""
    n, form, prefix, middle, output, back = beside(key, "n", "form", "prefix_chars", "middle_chars", "output", "restored")
    made = transform(docs.select(key, F.col(text).alias(text)), key, text).select(key, n, form, prefix, middle, output)
    names = beside(key, "output_sha256", "restored_sha256")
    sums = [F.sha2(F.col(c).cast("binary"), 256).alias(to) for c, to in zip((output, back), names, strict=True)]
    return restore(made, output, form, back).select(key, n, form, prefix, middle, *sums)


#: The same in DuckDB: the query's rows over `documents`.
SQL = f"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, {", ".join(f"CAST('0x' || substr(d, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM drawn),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {CUT} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM h),
made AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
  ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS o FROM cut),
mark AS (SELECT *, strpos(o, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS x, strpos(o, '<M>') AS y FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(o) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN substr(o, 4, x - 4) || substr(o, y + 3) || substr(o, x + 3, y - x - 3)
    ELSE substr(o, x + 3, y - x - 3) || substr(o, y + 3) || substr(o, 4, x - 4) END) AS restored_sha256
FROM mark
"""
