"""Personal data: exact base patterns, and spans that a character tagger adds.

Kinds: email, ip, card, phone. Base spans follow their patterns, leftmost and
not overlapping within a kind, in time linear in the text. The tagger is a
bidirectional LSTM over characters with CRF transitions, trained in numpy from
labelled spans that a seeded generator plants in invented text. It reads
overlapping windows; every character takes its tag from the window it lies most
central in, and spans are read off the whole text's tags. A tagger's span holds
a digit or an @ by definition, so only windows with one and their neighbours on
either side are run. Spans that
break the form of their kind (see `formed`) or overlap a base span are dropped;
base spans always stay.

Null texts count as empty and have no spans. Texts of any length are read
whole. Repeated rows are tagged each, equal texts alike; of spans that begin at
one place the order is that of KINDS. An empty table gives an empty result. A
key may have any name. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import beside
from plumbline.llm.words import chunks

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
#: Windows that go through the network together.
BATCH = 1024

_at_domain = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Whether the digits pass the check of payment cards."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _at_domain.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end), sorted."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if text.count(".") >= 3:
        for m in _ip.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
    for m in _card.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def formed(kind: int, span: str) -> bool:
    """Whether a tagger's span has its kind's form: an @ inside; four numbers or colons; 12 to 19 digits; 9 to 15 digits."""
    digits = len(_digits(span))
    if kind == 0:
        return "@" in span[1:-1]
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{0,4}){2,7}", span))
    if kind == 2:
        return 12 <= digits <= 19 and bool(re.fullmatch(r"[0-9](?:[ -]?[0-9])+", span))
    return 9 <= digits <= 15 and bool(re.fullmatch(r"[+(]{0,2}[0-9][ ().0-9/-]+[0-9]", span)) and not span.isdigit()


#: Characters of a class of their own; others: digit, lower and upper letter, other letter, white space, rest.
_OWN = "@.-+()_%:/'\"=|,[]#"
CLASSES = len(_OWN) + 1 + 26 + 26 + 4


def classes_of(text: str) -> np.ndarray:
    """The class of every character; class 0 is of padding and the rest."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where(codes < 128, _ascii[np.minimum(codes, 127)], 1).astype(np.uint8)


_ascii = np.zeros(128, np.uint8)
_ascii[[9, 10, 11, 12, 13, 32]] = 2
_ascii[48:58] = 3
for _k, _c in enumerate(_OWN):
    _ascii[ord(_c)] = 4 + _k
_ascii[97:123] = 4 + len(_OWN) + np.arange(26)
_ascii[65:91] = 4 + len(_OWN) + 26 + np.arange(26)

TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, LSTM in both directions, emissions, CRF; plain numpy."""

    def __init__(self, width: int = 8, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": make(CLASSES, width), "out": make(2 * hidden, TAGS), "out_b": np.zeros(TAGS, np.float32), "A": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.p |= {f"W{d}": make(width, 4 * hidden), f"U{d}": make(hidden, 4 * hidden), f"b{d}": bias}

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden), np.float32)
        c, out, tape = h, np.empty((*x.shape[:2], n), np.float32), []
        xw = x @ self.p[f"W{d}"] + self.p[f"b{d}"]
        for t in range(len(x)):
            z = xw[t] + h @ self.p[f"U{d}"]
            gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            before, was = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                tape.append((i, f, o, g, before, tc, was))
        return out, tape

    def _back(self, x: np.ndarray, d_out: np.ndarray, tape: list, d: str, grads: dict) -> np.ndarray:
        n = self.hidden
        dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        dz_all = np.empty((*x.shape[:2], 4 * n), np.float32)
        u = self.p[f"U{d}"]
        du = np.zeros_like(u)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, before, tc, was = tape[t]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            du += was.T @ dz
            dh, dc = dz @ u.T, dc * f
        flat = dz_all.reshape(-1, 4 * n)
        grads[f"U{d}"], grads[f"W{d}"], grads[f"b{d}"] = du, x.reshape(-1, x.shape[2]).T @ flat, flat.sum(axis=0)
        return dz_all @ self.p[f"W{d}"].T

    def emissions(self, classes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Windows x length of classes to length x windows x tags."""
        x = self.p["E"][classes.T]
        forward, tape_f = self._run(x, "f", keep)
        backward, tape_b = self._run(x[::-1], "b", keep)
        both = np.concatenate([forward, backward[::-1]], axis=2)
        return both @ self.p["out"] + self.p["out_b"], (x, both, tape_f, tape_b)

    def gradients(self, classes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tag paths, and its gradients."""
        e, (x, both, tape_f, tape_b) = self.emissions(classes, keep=True)
        steps, many, _ = e.shape
        y, a = tags.T, self.p["A"]
        alpha = np.empty_like(e)
        alpha[0] = self.p["first"] + e[0]
        for t in range(1, steps):
            s = alpha[t - 1][:, :, None] + a
            top = s.max(axis=1)
            alpha[t] = e[t] + top + np.log(np.exp(s - top[:, None, :]).sum(axis=1))
        beta = np.zeros_like(e)
        for t in range(steps - 2, -1, -1):
            s = a + (e[t + 1] + beta[t + 1])[:, None, :]
            top = s.max(axis=2)
            beta[t] = top + np.log(np.exp(s - top[:, :, None]).sum(axis=2))
        top = alpha[-1].max(axis=1)
        z = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(axis=1))
        marginal = np.exp(alpha + beta - z[None, :, None])
        at = np.arange(many)
        gold = self.p["first"][y[0]] + sum(e[t, at, y[t]] for t in range(steps)) + sum(a[y[t - 1], y[t]] for t in range(1, steps))
        d_e = marginal.copy()
        for t in range(steps):
            d_e[t, at, y[t]] -= 1
        d_a = np.zeros_like(a)
        for t in range(1, steps):
            d_a += np.exp(alpha[t - 1][:, :, None] + a + (e[t] + beta[t] - z[:, None])[:, None, :]).sum(axis=0)
            np.subtract.at(d_a, (y[t - 1], y[t]), 1)
        d_e /= many
        grads = {"A": d_a / many, "first": d_e[0].sum(axis=0), "out": both.reshape(-1, both.shape[2]).T @ d_e.reshape(-1, TAGS), "out_b": d_e.sum(axis=(0, 1))}
        d_both = d_e @ self.p["out"].T
        n = self.hidden
        d_x = self._back(x, d_both[:, :, :n], tape_f, "f", grads) + self._back(x[::-1], d_both[::-1, :, n:], tape_b, "b", grads)[::-1]
        grads["E"] = np.zeros_like(self.p["E"])
        np.add.at(grads["E"], classes.T, d_x)
        return float((z - gold).mean()), grads

    def decode(self, classes: np.ndarray) -> np.ndarray:
        """The best tag path of each window (Viterbi)."""
        e, _ = self.emissions(classes)
        a, score = self.p["A"], self.p["first"] + e[0]
        back = np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            s = score[:, :, None] + a
            back[t] = s.argmax(axis=1)
            score = np.take_along_axis(s, back[t].astype(np.int64)[:, None, :], 1)[:, 0] + e[t]
        out = np.empty((e.shape[1], len(e)), np.int8)
        out[:, -1] = score.argmax(axis=1)
        for t in range(len(e) - 1, 0, -1):
            out[:, t - 1] = np.take_along_axis(back[t], out[:, t].astype(np.int64)[:, None], 1)[:, 0]
        return out


def labelled_text(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """Invented text of some 120 characters with planted spans (start, kind, end) and look-alikes that are none."""
    pick = lambda options: options[rng.integers(len(options))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "é", "ü", "ß", "ción", "eau", "lich"]
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 5)))
    number = lambda: str(rng.integers(0, 256))
    host = lambda: ".".join([word() + pick(["", number(), "-x"]), pick(["com", "org", "net", "de", "example.com", "co.uk"])])

    def planted() -> tuple[int, str]:
        kind = int(rng.integers(4))
        if kind == 0:
            local = word() + pick(["", "." + word(), "_" + word(), "." + digits(2), "+" + word(), digits(3)])
            return kind, pick([f"{local}@{host()}", f"{local}@{host()}", f"{local}@{word()}", f"{local} @ {host()}"])
        if kind == 1:
            return kind, pick([".".join(number() for _ in range(4)), ".".join(number() for _ in range(4)), ":".join(format(int(rng.integers(1, 65536)), "x") for _ in range(8)), "fe80::" + format(int(rng.integers(1, 65536)), "x")])
        if kind == 2:
            sep = pick(["", " ", "-", ""])
            return kind, pick([sep.join(digits(4) for _ in range(4)), sep.join([digits(4), digits(6), digits(5)]), digits(int(rng.integers(13, 20)))])
        area, mid, last = digits(3), digits(3), digits(4)
        return kind, pick([f"+1 ({area}) {mid}-{last}", f"+{digits(2)} {area} {mid}{last}", f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"00{digits(2)} {area} {mid}{last}", f"+{digits(1)}-{area}-{mid}-{last}", f"{area}.{mid}.{last}"])

    def innocent() -> str:
        return pick([f'token = "{"".join(pick("0123456789abcdef") for _ in range(40))}"', str(rng.integers(1900, 2100)), f"{rng.integers(1, 13)}:{digits(2)}", f"{digits(2)}.{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"v{rng.integers(9)}.{rng.integers(9)}.{rng.integers(99)}", digits(int(rng.integers(1, 8))), digits(int(rng.integers(24, 40))), f"@{word()}", f"{digits(3)},{digits(3)}", f"https://{host()}/{word()}{digits(2)}", f"version {rng.integers(1, 9)}"])

    text, spans = "", []
    while len(text) < 120:
        roll = rng.random()
        if roll < 0.12:
            kind, value = planted()
            spans.append((len(text), kind, len(text) + len(value)))
            text += value
        elif roll < 0.2:
            text += innocent()
        else:
            w = word()
            text += w.upper() if rng.random() < 0.05 else w.capitalize() if rng.random() < 0.15 else w
        text += pick([" ", " ", " ", " ", " ", ". ", ", ", "\n", "%%% ", " | "])
    return text, spans


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tags of the characters of labelled spans."""
    out = np.zeros(length, np.int64)
    for start, kind, end in spans:
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


def train(steps: int = 800, batch: int = 48, length: int = 72, seed: int = 11, rate: float = 0.05) -> Tagger:
    """A tagger trained on generated labelled spans; the same seeds give the same tagger."""
    rng, tagger = np.random.default_rng(seed), Tagger()
    first = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    second = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    pool = [(classes_of(t), tags_of(len(t), s)) for t, s in (labelled_text(rng) for _ in range(batch * 60))]
    for step in range(1, steps + 1):
        chosen = [pool[k] for k in rng.integers(0, len(pool), batch)]
        cut = [int(rng.integers(0, len(c) - length + 1)) for c, _ in chosen]
        classes = np.stack([c[k : k + length] for (c, _), k in zip(chosen, cut, strict=True)]).astype(np.int64)
        tags = np.stack([t[k : k + length] for (_, t), k in zip(chosen, cut, strict=True)])
        _, grads = tagger.gradients(classes, tags)
        norm = float(np.sqrt(sum((g**2).sum() for g in grads.values())))
        now = rate * min(1.0, 5.0 / (norm + 1e-9)) * (1 - 0.9 * step / steps)
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            tagger.p[k] = (tagger.p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return tagger


_trained: list[Tagger] = []


def trained() -> Tagger:
    """The tagger of the default seeds, trained once in a process."""
    if not _trained:
        _trained.append(train())
    return _trained[0]


def tagged(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The tagger's well-formed spans (start, kind, end) of each text."""
    windows: list[tuple[int, int]] = []
    classes = [classes_of(t) for t in texts]
    for k, c in enumerate(classes):
        trigger = np.flatnonzero((c == 3) | (c == 4))
        if len(trigger):
            last = max(0, -(-(len(c) - WINDOW) // STRIDE))
            hit = np.unique(np.concatenate([np.clip(trigger // STRIDE - j, 0, last) for j in (-1, 0, 1, 2)]))
            windows += [(k, int(w)) for w in hit]
    tags = [None] * len(texts)
    for at in range(0, len(windows), BATCH):
        part = windows[at : at + BATCH]
        block = np.zeros((len(part), WINDOW), np.int64)
        for row, (k, w) in enumerate(part):
            piece = classes[k][w * STRIDE : w * STRIDE + WINDOW]
            block[row, : len(piece)] = piece
        for (k, w), path in zip(part, tagger.decode(block), strict=True):
            n = len(classes[k])
            if tags[k] is None:
                tags[k] = np.zeros(n, np.int8)
            last = max(0, -(-(n - WINDOW) // STRIDE))
            lo = w * STRIDE + (STRIDE // 2 if w else 0)
            hi = n if w == last else w * STRIDE + STRIDE // 2 + STRIDE
            tags[k][lo:hi] = path[lo - w * STRIDE : hi - w * STRIDE]
    return [[] if t is None else _spans(text, t) for text, t in zip(texts, tags, strict=True)]


def _spans(text: str, tags: np.ndarray) -> list[tuple[int, int, int]]:
    kind = np.where(tags > 0, (tags - 1) // 2, -1)
    begins = (tags > 0) & (tags % 2 == 1)
    edge = np.ones(len(tags), bool)
    edge[1:] = (kind[1:] != kind[:-1]) | begins[1:]
    starts = np.flatnonzero(edge)
    out = []
    for a, b in zip(starts, np.append(starts[1:], len(tags)), strict=True):
        if kind[a] < 0:
            continue
        a, b = int(a), int(b)
        while a < b and text[a] in " \t\n\r.,;|\"'":
            a += 1
        while a < b and text[b - 1] in " \t\n\r.,;|\"'%(-":
            b -= 1
        whole = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
        if whole and formed(int(kind[a]), text[a:b]):
            out.append((a, int(kind[a]), b))
    return out


def apart(added: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The added spans that no base span overlaps; base spans come by start."""
    starts = [s[0] for s in base]
    furthest = list(accumulate((s[2] for s in base), max))
    return [s for s in added if not (k := bisect_left(starts, s[2])) or furthest[k - 1] <= s[0]]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """Per row: the key, and `spans`, an array<struct<start, kind, end, base>> by start, then kind as in KINDS."""
    item = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(*beside(key, "spans"), T.ArrayType(item))])
    held = docs.sparkSession.sparkContext.broadcast(tagger or trained())
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.llm.bpe import pieces

        trigger = np.zeros(256, bool)
        trigger[[*range(48, 58), 64]] = True
        for batch in batches:
            for piece in pieces(batch, text):
                column = piece.column(text)
                some = np.zeros(len(column), bool)
                for first, _, data, offsets in chunks(column):
                    some[first + np.unique(np.searchsorted(offsets, np.flatnonzero(trigger[data]), side="right") - 1)] = True
                places = np.flatnonzero(some)
                texts = [column[int(k)].as_py() for k in places]
                out: list[list[dict]] = [[] for _ in range(len(column))]
                for k, t, added in zip(places, texts, tagged(held.value, texts), strict=True):
                    base = base_spans(t)
                    more = apart(added, base)
                    out[k] = [{"start": a, "kind": KINDS[kind], "end": b, "base": is_base} for (a, kind, b), is_base in sorted([*((s, True) for s in base), *((s, False) for s in more)])]
                yield pa.RecordBatch.from_arrays([piece.column(key), pa.array(out, arrow)], names=schema.fieldNames())

    return docs.select(key, F.col(text).alias(text)).mapInArrow(run, schema)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the SHA-256 of base spans, all spans as kind:start:end, and how many were added."""
    found = found.toDF("_id", "_all")
    base = F.filter("_all", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.filter("_all", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of_kind(kind)).cast("long") for kind in KINDS]
    more = F.size(F.filter("_all", lambda s: ~s["base"])).cast("long")
    names = beside(key, *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans", "n_added")
    return found.select("_id", *counts, F.sha2(listed(base).cast("binary"), 256), listed(F.col("_all")), more).toDF(key, *names)


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mask: str = "<{}>", tagger: Tagger | None = None) -> DataFrame:
    """`docs` with all found spans in `text` replaced by their kind; rows and other columns stay."""
    fields = docs.schema
    held = docs.sparkSession.sparkContext.broadcast(tagger or trained())

    def clean(x: str | None) -> str | None:
        if not x:
            return x
        base = base_spans(x)
        spans = sorted([*base, *apart(tagged(held.value, [x])[0], base)])
        out, at = [], 0
        for start, kind, end in spans:
            if start >= at:
                out += [x[at:start], mask.format(KINDS[kind])]
            at = max(at, end)
        return "".join([*out, x[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cleaned = pa.array([clean(x) for x in batch.column(text).to_pylist()], batch.column(text).type)
            yield pa.RecordBatch.from_arrays([cleaned if f.name == text else batch.column(f.name) for f in fields], names=fields.fieldNames())

    return docs.mapInArrow(run, fields)
