"""Fill-in-middle, decontamination and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, fim, queries, runs
from plumbline.llm.common import table

TEXTS = [None, "", "a", "ab <P> c", "tail <M>", "<S>", "< P >", "<<P", "one two\n\nthree  four\n", "ñandú 漢字 😀👍🏽", "\n", " ", "x" * 200_000]


def rows(spark):
    return spark.createDataFrame([(i, t, "o", 7) for i, t in enumerate(TEXTS)] + [(None, "null key", "o", 7), (8, TEXTS[8], "o", 7)], "doc_id long, text string, OUTPUT string, _digest int")


def units(text, unit):
    if unit == "code point":
        return list(text)
    return re.findall(r"[^\n]*\n|[^\n]+" if unit == "line" else r"[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+", text)


@pytest.mark.parametrize("unit", sorted(fim.UNITS))
def test_cuts_like_a_list_of_units(unit):
    draw, cutter, seen = random.Random(5), fim.Cutter(unit), set()
    for _ in range(3000):
        text = "".join(draw.choices(["a", "ñ", "😀", " ", "\n", "\t", "\r", "<", "P", ">", "<S>"], [9, 3, 3, 4, 3, 1, 1, 1, 1, 1, 0.05], k=draw.randrange(40)))
        digest = hashlib.sha256(str(draw.random()).encode()).hexdigest()
        n, form, prefix, middle, output = cutter.cut(text, digest)
        parts = units(text, unit)
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(parts) + 1), h[1] % (len(parts) + 1)))
        first, mid, last = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
        plain = not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
        want = ("plain", None, None, text) if plain else ("spm", len(first), len(mid), f"<S>{last}<P>{first}<M>{mid}") if h[3] % 100 < 20 else ("psm", len(first), len(mid), f"<P>{first}<S>{last}<M>{mid}")
        assert (n, form, prefix, middle, output) == (len(parts), *want)
        assert cutter.restored(output, form) == text
        seen.add(form)
    assert seen == {"plain", "psm", "spm"}


def test_fim_frames(spark, sf):
    df = rows(spark)
    made = fim.transform(df, unit="word")
    assert made.columns == ["doc_id", "text", "_digest", "n", "form", "prefix_chars", "middle_chars", "output"] and made.count() == df.count()
    assert fim.restore(made).where(F.col("restored") != F.coalesce("text", F.lit(""))).count() == 0
    got = fim.digest(df)
    assert got.where("form = 'plain' and prefix_chars is not null or form <> 'plain' and middle_chars is null").count() == 0
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[0]["n"] == 0 and by_id[12]["n"] == 200_000 and {by_id[k]["form"] for k in (0, 1, 3, 4, 5)} == {"plain"}
    assert all(by_id[i]["restored_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(TEXTS))
    assert fim.digest(df.limit(0)).count() == 0 and fim.digest(df.withColumnRenamed("doc_id", "N"), "N").columns[:2] == ["N", "_n"]
    assert queries.op11_fill_in_middle(spark, sf).count() == table(spark, sf, "documents").count()


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plainly_found(text, items):
    """(words, hit words, items) by comparing every window at every place."""
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        for test in [v[k : k + 10] for k in range(len(v) - 9)] or ([v] if v else []):
            for k in range(len(w) - len(test) + 1):
                if w[k : k + len(test)] == test:
                    hit |= set(range(k, k + len(test)))
                    found.add("" if name is None else str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def contaminated(seed):
    """Texts that share passages with items, of words of very different lengths, some repeated."""
    draw = random.Random(seed)
    pool = ["a", "b", "bb", "the", "ñandú", "漢字", "Word", "longerword" * 5, "7", "x1"]
    some = lambda n: draw.choices(pool, k=n)
    items = [(k, " ".join(some(draw.choice([1, 2, 3, 9, 10, 11, 14, 30])))) for k in range(30)]
    items += [(None, "q r s t u v w x y z q"), (5, "second row of an id with enough words to be a window"), (90, None), (91, "..."), (92, items[3][1]), (93, "Z" * 3000), (94, "a " * 12)]
    texts = [None, "", "?!", "a " * 40, "Z" * 3000 + " tail", "b" + "z" * 3000, "q R;s--t\nu\tv w\x00x y z"]
    for _ in range(120):
        parts = [some(draw.randrange(20))]
        for _ in range(draw.randrange(3)):
            v = words(draw.choice(items)[1])
            a = draw.randrange(len(v) + 1)
            parts += [v[a : a + draw.randrange(25)], some(draw.randrange(8))]
        texts.append("".join(w + draw.choice([" ", ", ", "\n", "--", "_"]) for p in parts for w in p))
    return texts, items


@pytest.mark.parametrize(("seed", "part", "words_of_piece"), [(1, 4 << 20, 4096), (2, 4 << 20, 3), (3, 300, 5)])
def test_decontamination_by_brute_force(spark, monkeypatch, seed, part, words_of_piece):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", words_of_piece)
    texts, items = contaminated(seed)
    docs = spark.createDataFrame([(k, t, "o", 3) for k, t in enumerate(texts)], "doc_id long, text string, HITS string, item int").repartition(3)
    got = decontaminate.digest(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows = {r["doc_id"]: tuple(r)[1:] for r in got.collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        assert rows[k] == plainly_found(t, items), (k, t)
    assert len({r[4] for r in rows.values()}) == 2


def test_decontamination_spans_and_edges(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", "k"), (2, "short item here", "k"), (None, "nothing", "k")], "doc_id long, text string, more string")
    tests = spark.createDataFrame([("x", "TWO three four five six seven eight nine ten eleven twelve"), ("y", "Item, here")], "item_id string, text string")
    found = {r["doc_id"]: r for r in decontaminate.find(docs, tests).collect()}
    assert [tuple(h) for h in found[1]["hits"]] == [(1, 11)] and found[1]["items"] == ["x"] and found[1]["more"] == "k"
    assert [tuple(h) for h in found[2]["hits"]] == [(1, 3)] and found[None]["hits"] == []
    assert [r["doc_id"] for r in decontaminate.clean(docs, tests).collect()] == [None]
    assert decontaminate.clean(docs, tests.limit(0)).count() == 3 and decontaminate.digest(docs, tests.limit(0)).where("contaminated or n_words < 1").count() == 0
    assert decontaminate.digest(docs.limit(0), tests).count() == 0
    # an item in many others, and one text in many rows
    many = spark.createDataFrame([(k, "the same ten words stand in every one of these") for k in range(3000)], "item_id long, text string")
    row = decontaminate.digest(spark.createDataFrame([(1, "so: the same ten words stand in every one of these!")] * 3, "doc_id long, text string"), many).collect()
    assert len(row) == 3 and all(r["n_items"] == 3000 and r["n_hit"] == 10 for r in row)


def test_long_texts_are_searched_whole():
    item = " ".join(f"w{k}" for k in range(20_000))
    text = " ".join(f"v{k}" for k in range(300_000)) + " " + item
    pieces = [("i", b" ".join(w.encode() for w in item.split()[s : s + 4096 + 9]) + b" ") for s in range(0, 19_991, 4096)]
    ((_, n, hits),) = decontaminate.Searcher(pieces).search(pa.array([text]))
    assert list(n) == [320_000] and hits == {0: ([(300_000, 320_000)], ["i"])}


def plain_runs(w):
    """All runs, by trying every period at every place."""
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            k = i
            while k + p < n and w[k] == w[k + p]:
                k += 1
            if k > i and k + p - i >= max(6, 4 * p) and not any(all(w[x] == w[x + q] for x in range(i, k + p - q)) for q in range(1, p)):
                out.append((i, k + p - i, p))
            i = max(k, i) + 1
    return sorted((s, length, p) for s, length, p in out)


@pytest.mark.parametrize("short", [4096, 10])
def test_runs_by_brute_force(monkeypatch, short):
    """Two and three letters, planted repetitions within repetitions; the path of long texts too."""
    monkeypatch.setattr(runs, "SHORT", short)
    monkeypatch.setattr(runs, "SLICE", 40)
    monkeypatch.setattr(runs, "AT_ONCE", 64 if short > 10 else 5)
    monkeypatch.setattr(runs, "SURVIVORS", 1 << 14 if short > 10 else 7)
    runs._short.cache_clear()
    draw, many = np.random.default_rng(3), 0
    for k in range(700):
        w = list(draw.integers(0, 2 + k % 3, draw.integers(0, 60)))
        for _ in range(k % 4):
            at, p = draw.integers(0, len(w) + 1), draw.integers(1, 9)
            w[at:at] = (w[at : at + p] or [1]) * int(draw.integers(1, 9))
        want = plain_runs(w)
        assert runs.Finder(np.array(w, "int32")).runs() == want, w
        many += len(want)
    assert many > 800
    runs._short.cache_clear()


def test_runs_of_long_texts():

    draw = np.random.default_rng(4)
    natural = draw.zipf(1.4, 300_000).clip(0, 50_000).astype(np.int32)
    assert [r for r in runs.Finder(natural).runs() if r[2] > 3] == []
    natural[100_000:250_000] = np.resize(np.arange(60_001, 61_001, dtype=np.int32), 150_000)
    assert [r for r in runs.Finder(natural).runs() if r[2] > 3] == [(100_000, 150_000, 1000)]
    assert runs.Finder(np.zeros(1_000_000, np.int32)).runs() == [(0, 1_000_000, 1)]
    assert runs.Finder(np.resize(np.array([0, 1, 0, 2], np.int32), 400_001)).runs() == [(0, 400_001, 4)]


def test_run_query_and_edges(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect() if len(r["text"] or "") < 4000}
    seen = 0
    for r in queries.op13_periodic_runs(spark, sf).collect():
        if r["doc_id"] not in docs:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]])
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [*w[:a], *(w[a + (i - a) % p] for i in range(a, n))]
        want = plain_runs(w)
        gone = {k for s, length, p in want for k in range(s + p, s + length)}
        assert r["n_runs"] == len(want)
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
        seen += bool(want)
    assert seen > 20
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (None, "a b " * 5, "k"), (1, "x\u00a0y " * 7, "k")], "doc_id long, text string, RUNS string")
    found = runs.find(df)
    assert found.columns == ["doc_id", "text", "n_words", "runs", "best", "collapsed"]
    rows = {(r["doc_id"], r["text"]): r for r in found.collect()}
    assert rows[(None, "a b " * 5)]["collapsed"] == "a b" and rows[(1, "x\u00a0y " * 7)]["n_words"] == 7 and rows[(1, None)]["best"] is None
    assert runs.digest(df.limit(0)).count() == 0 and runs.digest(df).where("n_runs = 0 and start is null").count() == 2
    assert runs.digest(df.withColumnRenamed("doc_id", "best"), "best").count() == 4
