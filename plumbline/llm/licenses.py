"""License scans by patience alignment.

A template is sought in a text through windows of one and a half times its
length that begin every half length, so that some window holds any copy whole.
In a window, words that are unique to the template and to the window (not to the
whole text) are anchors; the longest
increasing subsequence of the anchors is kept and the gaps between them are
aligned in the same way. Gaps without anchors match equal words from both
ends. Coverage is the share of template words that are matched.

A hit must also match the words that name its license, as far as its template
has them (NAMES), and the text must not add, between the words that it matches,
a word that tells another license (TELLING): a notice of the LGPL is none of the
GPL. A template of fewer than SHORT words that has no naming word counts only
when it is matched whole.

Windows whose words cannot reach the least coverage, by counting, are passed
over; that drops nothing. All licenses are found, each at all its places: of
hits whose spans overlap the highest coverage wins, then more template words,
then the first name, and what lies between the winners is scanned again. The
best hit by the same order has columns of its own. A text has a row even if no
license is found (null license, coverage 0, an empty array); null and empty
texts are of that kind. Very long texts are scanned whole, by the places of the
template's words. Repeated rows are scanned each. An empty table gives an empty
result. A key may have any name; columns other than key and text are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import beside

LEAST_COVERAGE = 0.8
#: A template without a word that names its license and of fewer words than this must be matched whole.
SHORT = 20

#: The words that tell a license from others; for other licenses those of the name itself, but for 0.
NAMES: dict[str, str] = {
    "GPL-3.0": "gnu general public 3",
    "LGPL-3.0": "gnu lesser general public 3",
    "AGPL-3.0": "gnu affero general public 3",
    "MPL-2.0": "mozilla mpl 2",
    "CC-BY-4.0": "cc by creative commons attribution 4",
    "CC-BY-SA-4.0": "cc by sa creative commons attribution sharealike 4",
    "CC-BY-NC-4.0": "cc by nc creative commons attribution noncommercial 4",
    "CC-BY-ND-4.0": "cc by nd creative commons attribution noderivatives 4",
    "CC-BY-NC-SA-4.0": "cc by nc sa creative commons attribution noncommercial sharealike 4",
    "CC-BY-NC-ND-4.0": "cc by nc nd creative commons attribution noncommercial noderivatives 4",
}

#: Words that, where a text adds them inside a notice, make it that of another license.
TELLING = frozenset("lesser library affero sa sharealike nc noncommercial nd noderivatives noderivs clause 0 gnu mozilla apache mit bsd isc cc".split())

#: Public licence texts and customary notices.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
        "Public License for more details.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "Lesser General Public License for more details.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "Affero General Public License for more details.",
    ],
    "BSD": ["Released under the BSD License.", "Licensed under the BSD License."],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
}

_word = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _word.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            last.append(k)
        else:
            tops[pile], last[pile] = v, k
        before[k] = last[pile - 1] if pile else -1
    out = []
    k = last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both: patience alignment, gaps by recursion (kept on a stack)."""
    pairs: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: k for k, w in enumerate(b[b0:b1], b0)}
        anchors = [(k, where[w]) for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and in_b.get(w) == 1]
        kept = [anchors[k] for k in longest_increasing([y for _, y in anchors])]
        if not kept:
            continue
        pairs += kept
        for (x0, y0), (x1, y1) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)], strict=True):
            if x0 + 1 < x1 and y0 + 1 < y1:
                stack.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(pairs)


class Scanner:
    """Templates made ready for many texts."""

    def __init__(self, templates: dict[str, list[str]], least: float = LEAST_COVERAGE):
        self.least = least
        self.templates = [(name, words_of(text)) for name, texts in sorted(templates.items()) for text in texts]
        self.counts = [Counter(words) for _, words in self.templates]
        self.naming = [frozenset(words_of(NAMES.get(name, name))) & set(words) - {"0"} for name, words in self.templates]
        self.telling = [TELLING - set(words) for _, words in self.templates]
        self.vocabulary = frozenset(w for _, words in self.templates for w in words)

    def scan(self, text: str | None) -> tuple[int, str | None, float, int, int, int, list[tuple[str, float, int, int, int]]]:
        """(words of the text, the best hit's fields, all hits by place); a hit: license, coverage, matched words, first matched word, place after the last."""
        words = words_of(text or "")
        found: list[tuple] = []
        parts = [(0, len(words))]
        while parts:
            begin, end = parts.pop()
            kept = self._apart(self._hits(words[begin:end]))
            found += [(*rank, first + begin, after + begin, matched) for *rank, first, after, matched in kept]
            if kept:
                parts += [(x + begin, y + begin) for x, y in zip([0, *(k[4] for k in kept)], [*(k[3] for k in kept), end - begin], strict=True) if x < y]
        hits = [(name, -coverage, matched, first, after) for coverage, _, name, first, after, matched in sorted(found)]
        best = hits[0] if hits else (None, 0.0, 0, 0, 0)
        return len(words), *best, sorted(hits, key=lambda h: h[3])

    def _hits(self, words: list[str]) -> set[tuple]:
        """All (-coverage, -words of the template, license, first, after, matched), the best first in their order."""
        places: dict[str, list[int]] = {}
        if not self.vocabulary.isdisjoint(words):
            vocabulary = self.vocabulary
            for k, w in enumerate(words):
                if w in vocabulary:
                    places.setdefault(w, []).append(k)
        hits: set[tuple] = set()
        for (name, template), counts, naming, telling in zip(self.templates, self.counts, self.naming, self.telling, strict=True):
            need = self.least * len(template) if naming or len(template) >= SHORT else len(template)
            if not all(w in places for w in naming) or sum(min(c, len(places.get(w, ()))) for w, c in counts.items()) < need:
                continue
            for matched, first, after, reach in self._windows(words, places, template, counts, need, naming):
                # none of these words is in the template, so what the span has of them is added; where the template's end is
                # not matched, the words in its place are looked at too
                if telling.isdisjoint(words[first:reach]):
                    hits.add((-matched / len(template), -len(template), name, first, after, matched))
        return hits

    @staticmethod
    def _apart(hits: set[tuple]) -> list[tuple]:
        """The hits, by place, that no better one overlaps."""
        kept: list[tuple[int, int, tuple]] = []
        for hit in sorted(hits):
            first, after = hit[3:5]
            at = bisect_left(kept, (first,))
            if (at == len(kept) or after <= kept[at][0]) and (at == 0 or kept[at - 1][1] <= first):
                insort(kept, (first, after, hit))
        return [k[2] for k in kept]

    def _windows(self, words: list[str], places: dict[str, list[int]], template: list[str], counts: Counter, need: float, naming: frozenset[str]) -> Iterator[tuple[int, int, int, int]]:
        m = len(template)
        step, width = max(1, m // 2), -(-3 * m // 2) + 1
        rare = min(counts, key=lambda w: (len(places.get(w, ())) / counts[w], w))
        # coverage below one may do without any single word, so windows are found by all places of template words
        starts = sorted({max(0, s) for w in counts for k in places.get(w, ()) for s in range((k - width) // step * step + step, k + 1, step)}) if places.get(rare) or need < m else []
        for s in starts:
            e = s + width
            if sum(min(c, bisect_left(p, e) - bisect_left(p, s)) for w, c in counts.items() if (p := places.get(w))) < need:
                continue
            pairs = align(words[s:e], template)
            if len(pairs) >= need and naming.issubset(template[y] for _, y in pairs):
                first, after = s + pairs[0][0], s + pairs[-1][0] + 1
                # from its end, the span leaves out earlier words that a notice before it shares with the template
                open_end = m - 1 - pairs[-1][1]
                back = align(words[first:after][::-1], template[::-1])
                if len(back) >= len(pairs) and naming.issubset(template[-1 - y] for _, y in back):
                    first, after, pairs, open_end = after - back[-1][0] - 1, after - back[0][0], back, back[0][1]
                yield len(pairs), first, after, after + (open_end and open_end + 1)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """Per row: the key, n_words, license, coverage, matched words, and the words' range first_word to after_word of the best hit, and all hits in `found`."""
    fields = [T.StructField(n, k) for n, k in (("license", T.StringType()), ("coverage", T.DoubleType()), ("matched", T.LongType()), ("first_word", T.LongType()), ("after_word", T.LongType()))]
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(n, f.dataType) for n, f in zip(beside(key, "n_words", *(f.name for f in fields), "found"), [T.StructField("n_words", T.LongType()), *fields, T.StructField("found", T.ArrayType(T.StructType(fields)))], strict=True))])
    chosen = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.llm.bpe import pieces

        scanner = Scanner(chosen, least)
        hit = {"license": pa.string(), "coverage": pa.float64(), "matched": pa.int64(), "first_word": pa.int64(), "after_word": pa.int64()}
        kinds = [pa.int64(), *hit.values(), pa.list_(pa.struct(list(hit.items())))]
        for batch in batches:
            for piece in pieces(batch, text):
                rows = [(*r[:6], [dict(zip(hit, h, strict=True)) for h in r[6]]) for r in map(scanner.scan, piece.column(text).to_pylist())]
                yield pa.RecordBatch.from_arrays([piece.column(key), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=schema.fieldNames())

    return docs.select(key, F.col(text).alias(text)).mapInArrow(run, schema)
