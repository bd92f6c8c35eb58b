"""Licenses, quality, toxicity, personal data."""

import random
import re
import time
import zlib

import numpy as np
import pytest

from plumbline.llm import features, licenses, pii, quality, queries, toxicity, words
from plumbline.llm.common import table

CLASH = "doc_id long, text string, score string, expected_grade int, tail_probability int, _toxic_score int, license int, spans int, label int, features int"
EDGE = [(1, None), (2, ""), (3, "   \n"), (4, "x" * 50_000), (5, "you are an idiot and a pathetic loser"), (5, "you are an idiot and a pathetic loser"), (None, "plain words"), (6, "word " * 30_000)]


def edge(spark):
    return spark.createDataFrame([(i, t, "mine", 1, 2, 3, 4, 5, 6, 7) for i, t in EDGE], CLASH)


def test_word_hashes_against_python():
    import pyarrow as pa

    texts = ["The CAT sat", None, "", " a\tb\x0bc ", "é É 😀 z", "one", "the cat sat on the mat again"]
    by_hash = {}
    for first, last, data, offsets in words.chunks(pa.array(texts), limit=8):
        h, at = words.word_hashes(data, offsets)
        for row in range(last - first):
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[first + row] or "")
            found = re.findall(r"[^\x20\x09-\x0D]+", text)
            assert at[row + 1] - at[row] == len(found)
            for w, x in zip(found, h[at[row] : at[row + 1]].tolist(), strict=True):
                assert by_hash.setdefault(w, x) == x
    assert len(set(by_hash.values())) == len(by_hash)


def brute_alignment(a, b):
    """Longest common subsequence, to which no alignment can be superior."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_patience_alignment():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 12, rng.integers(0, 20)).tolist(), rng.integers(0, 12, rng.integers(0, 20)).tolist()
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= brute_alignment(a, b)
    for _ in range(100):
        v = rng.permutation(12).tolist()
        k = licenses.longest_increasing(v)
        assert [v[i] for i in k] == sorted(v[i] for i in k) and len(k) == brute_alignment(v, sorted(v))
    distinct = list(range(30))
    assert len(licenses.align(distinct, distinct[:10] + [99] + distinct[10:])) == 30


def test_licenses(spark, sf):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    mit = licenses.TEMPLATES["MIT"][2]
    assert scanner.scan("foo " + mit + " " + mit)[1:3] == ("MIT", 1.0)
    assert scanner.scan(mit.replace("software", "program"))[1] == "MIT"
    assert scanner.scan("the " * 50_000)[1:3] == (None, 0.0) and scanner.scan(None)[0] == 0
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    for r in queries.op1_license_scan(spark, sf).collect():
        t = texts[r["doc_id"]]
        lines = [n for n, mark in (("GPL-3.0", "GNU General Public License, version 3"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"), ("MIT", "Released under the MIT License"), ("Apache-2.0", "Apache License, Version 2.0")) if mark in t]
        assert (r["license"] in lines) if lines else (r["license"] is None)
    assert licenses.scan(edge(spark)).count() == len(EDGE) and licenses.scan(edge(spark).limit(0)).count() == 0


def test_no_license_of_another_name_at_full_coverage():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    cases = {
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "This work is licensed under the GNU Library General Public License, version 3.": None,
        "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0", "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0", "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "Released under the BSD 2-Clause License.": None, "Released under the BSD 3-Clause License.": "BSD-3-Clause", "Released under the MIT-0 License.": None,
        licenses.TEMPLATES["LGPL-3.0"][1]: "LGPL-3.0", licenses.TEMPLATES["AGPL-3.0"][1]: "AGPL-3.0", licenses.TEMPLATES["GPL-3.0"][1]: "GPL-3.0",
    }
    for text, want in cases.items():
        assert scanner.scan("word " * 9 + text + " more" * 9)[1] == want, text


def plain_align(a, b):
    """Patience alignment by its definition, recursively, with a quadratic longest increasing subsequence."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    out = [(k, k) for k in range(head)] + [(len(a) - k, len(b) - k) for k in range(1, tail + 1)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    anchors = [(k, y.index(w)) for k, w in enumerate(x) if x.count(w) == 1 and y.count(w) == 1]
    best: list[list] = []
    for k, (_, place) in enumerate(anchors):
        before = max((best[j] for j in reversed(range(k)) if anchors[j][1] < place), key=len, default=[])  # of equally long ones the last
        best.append([*before, anchors[k]])
    kept = max(reversed(best), key=len, default=[])
    if kept:
        for (x0, y0), (x1, y1) in zip([(-1, -1), *kept], [*kept, (len(x), len(y))], strict=True):
            out += [(head + x0 + 1 + p, head + y0 + 1 + q) for p, q in plain_align(x[x0 + 1 : x1], y[y0 + 1 : y1])]
        out += [(head + p, head + q) for p, q in kept]
    return sorted(out)


def test_alignments_are_those_of_a_plain_aligner():
    draw = random.Random(8)
    for _ in range(600):
        a, b = (draw.choices("abcdefghijklmnopqrstuvw", k=draw.randrange(1, 25)) for _ in range(2))
        got = licenses.align(a, b)
        assert got == plain_align(a, b)
        assert all(a[x] == b[y] for x, y in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_scan_is_that_of_every_window(spark):
    """Mutated notices among other words: all windows of all templates are aligned plainly, without counting first."""
    scanner, draw = licenses.Scanner(licenses.TEMPLATES), random.Random(9)
    notices = [(name, text) for name, texts in licenses.TEMPLATES.items() for text in texts if len(text) < 500]

    def plain_best(words):
        best = None
        for (name, template), naming, telling in zip(scanner.templates, scanner.naming, scanner.telling, strict=True):
            need = 0.8 * len(template) if naming or len(template) >= licenses.SHORT else len(template)
            step, width = max(1, len(template) // 2), -(-3 * len(template) // 2) + 1
            for s in range(0, len(words), step):
                pairs = plain_align(words[s : s + width], template)
                if len(pairs) < need or not naming <= {template[y] for _, y in pairs}:
                    continue
                first, after, missing = s + pairs[0][0], s + pairs[-1][0] + 1, len(template) - 1 - pairs[-1][1]
                back = plain_align(words[first:after][::-1], template[::-1])
                if len(back) >= len(pairs) and naming <= {template[-1 - y] for _, y in back}:
                    pairs = back
                    last = after
                    first, after, missing = last - back[-1][0] - 1, last - back[0][0], back[0][1]
                if telling.isdisjoint(words[first : after + (missing + 1 if missing else 0)]):
                    rank = (-len(pairs) / len(template), -len(template), name)
                    best = min(best or rank, rank)
        return best

    hits = 0
    for _ in range(60):
        name, text = draw.choice(notices)
        words = [w for w in licenses.words_of(text) if draw.random() < 0.97]
        words[draw.randrange(len(words) + 1) : 0] = draw.choices(["lesser", "old", "word", "sa"], k=draw.randrange(2))
        whole = draw.choices(["some", "other", "the", "license"], k=draw.randrange(12)) + words + draw.choices(["under", "and", "x"], k=draw.randrange(12))
        want, got = plain_best(whole), scanner.scan(" ".join(whole))
        assert (got[1], got[2]) == ((want[2], -want[0]) if want else (None, 0.0)), whole
        hits += want is not None
    assert hits > 25


def test_all_licenses_of_a_text(spark):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    two = scanner.scan("Released under the MIT License. Licensed under CC BY-NC 4.0.")
    assert [(h[0], h[1], h[3], h[4]) for h in two[6]] == [("MIT", 1.0, 0, 5), ("CC-BY-NC-4.0", 1.0, 5, 12)] and two[1] == "CC-BY-NC-4.0"
    mit = licenses.TEMPLATES["MIT"][2]
    m = len(licenses.words_of(mit))
    text = f"foo {mit} {mit} bar. Licensed under the MIT. Licensed under the MIT License. " + "filler words " * 40 + licenses.TEMPLATES["ISC"][0]
    found = scanner.scan(text)[6]
    assert [(h[0], h[3]) for h in found[:4]] == [("MIT", 1), ("MIT", 1 + m), ("MIT", 2 + 2 * m), ("MIT", 6 + 2 * m)] and [h[0] for h in found[4:]] == ["ISC"]
    many = scanner.scan("x " + "Licensed under CC BY 4.0. Released under the MIT License. " * 300)[6]
    assert [h[0] for h in many] == ["CC-BY-4.0", "MIT"] * 300 and all(a[4] <= b[3] for a, b in zip(many, many[1:], strict=False))
    rows = licenses.scan(spark.createDataFrame([(1, "Released under the MIT License. Licensed under CC BY-NC 4.0."), (2, None)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: [h["license"] for h in r["found"]] for r in rows} == {1: ["MIT", "CC-BY-NC-4.0"], 2: []}


def test_short_notices_need_the_words_that_name_them():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for notice, name in (
        ("Licensed under the BSD License.", "BSD"), ("Released under the BSD 3-Clause License.", "BSD-3-Clause"), ("Licensed under the ISC License.", "ISC"),
        ("released under the terms of this license", None), ("Licensed under the Artistic License.", None), ("Licensed under CC BY 3.0.", None), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("This work is licensed under the GNU General Public License, version 2.", None), ("Licensed under the Apache License, Version 2.", "Apache-2.0"), ("Licensed under MIT License", "MIT"),
    ):
        assert scanner.scan(f"some words {notice} and more")[1] == name
    for name, texts in licenses.TEMPLATES.items():
        assert all(scanner.scan(t)[1:3] == (name, 1.0) for t in texts)
    bare = licenses.Scanner({"Own": ["use this as you like"]})
    assert bare.scan("use this as you like")[1] == "Own" and bare.scan("use this as they like")[1] is None


def test_ordinal_regression_orders_five_grades():
    rng = np.random.default_rng(3)
    n, width = 1500, 12
    x = rng.random((n, width)) < 0.3
    latent = x @ np.linspace(-3, 3, width) + rng.logistic(size=n)
    grade = np.digitize(latent, [-3, -1, 1, 3])
    rows, columns = np.nonzero(x)
    w, t = quality.fit_ordinal(rows, columns, grade, 5, width)
    assert (np.diff(t) > 0).all() and np.corrcoef(w, np.linspace(-3, 3, width))[0, 1] > 0.97
    model = quality.Ordinal(np.array([0, 1, 2, 3, 4]), features.Keys(np.zeros(0, np.uint64)), w, t)
    tails = model.tails(x @ w)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.corrcoef(model.expected(tails), grade)[0, 1] > 0.6


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    # ties by mean rank
    for v in np.unique(score):
        at = score == v
        rank = rank.astype(float)
        rank[at] = rank[at].mean()
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def held_out(ids):
    return np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in ids])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels").toPandas().set_index("doc_id")
    q = queries.op2_quality(spark, sf).toPandas()
    assert len(q) == 10_000 and (held_out(q.doc_id) == q.held_out).all()
    q = q[q.held_out & q.doc_id.isin(labels.index)]
    assert auc(q.top_probability.to_numpy(), labels.quality.loc[q.doc_id].to_numpy()) > 0.99
    t = queries.op4_toxicity(spark, sf).toPandas()
    assert len(t) == 10_000 and ((t.score >= 0.7) == (t.predicted == 1)).all() and t.score.between(0, 1).all()
    t = t[t.held_out & t.doc_id.isin(labels.index)]
    truth = labels.toxic.loc[t.doc_id].to_numpy()
    assert auc(t.score.to_numpy(), truth) > 0.96
    assert (t.predicted[truth == 0] == 0).mean() > 0.99 and (t.predicted[truth == 1] == 1).mean() > 0.8


def test_label_model_recovers_accuracies_and_correlation():
    rng = np.random.default_rng(5)
    n = 20_000
    y = rng.random(n) < 0.3
    acc = np.array([[0.1, 0.7], [0.05, 0.6], [0.2, 0.8], [0.1, 0.5]])
    votes = (rng.random((n, 4)) < acc[:, y.astype(int)].T).astype(int)
    votes = np.column_stack([votes, np.where(rng.random(n) < 0.9, votes[:, 0], 1 - votes[:, 0])])  # copies the first
    known = np.where(rng.random(n) < 0.05, y.astype(int), -1)
    keys, counts = np.unique(np.column_stack([votes, known]), axis=0, return_counts=True)
    m = toxicity.fit_label_model(keys[:, :5], counts.astype(float), keys[:, 5])
    assert abs(m.prior - 0.3) < 0.03 and np.abs(m.accuracy.T[:4] - acc).max() < 0.06
    tree = {frozenset((j, int(p))) for j, p in enumerate(m.parent) if p >= 0}
    assert frozenset((0, 4)) in tree and m.correlation[0, 4] > 0.5 > m.correlation[1, 2] + 0.3
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.85


def brute_votes(voters, text):
    """The bit pattern by plain Python: whole words and beginnings of four to eight bytes, persons before insults, shouting."""
    lowered = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    found = re.findall(rb"[a-z\x80-\xff]+", lowered)
    known = {int(k): int(b) for k, b in zip(voters.keys.keys, voters.bits, strict=True)}
    out = 0
    for w in found:
        out |= known.get(toxicity.word_key(w.decode("utf-8", "surrogateescape")) if w else 0, 0)
    lists = {n: set(x.encode() for x in ws.split()) for n, ws in toxicity.LEXICONS.items()}
    insults = set().union(*(v for n, v in lists.items() if n != "threat"))
    persons = {x.encode() for x in toxicity.SECOND_PERSONS.split()}
    if any(w in persons and any(x in insults for x in found[i + 1 : i + 4]) for i, w in enumerate(found)):
        out |= 1 << voters.names.index("second person")
    raw = (text or "").encode()
    words = max(1, len(re.findall(rb"[^\x20\x09-\x0d]+", raw)))
    if sum(65 <= c <= 90 for c in raw) > 2 * words and raw.count(b"!") * 4 > words:
        out |= 1 << voters.names.index("shouting")
    return out


def test_votes_against_brute_force():
    import pyarrow as pa

    voters = toxicity.make_voters(np.zeros(0, np.uint64))
    rng = np.random.default_rng(2)
    pool = "you YOU idiot Idiots moron! tu imbécil du trottel plain word !! kill. WOW A fine die".split()
    texts = ["YOU IDIOT!!! YOU MORON!!!", None, "", "you a b c idiot", "you a b idiot", "\n"] + [" ".join(rng.choice(pool, rng.integers(1, 12))) for _ in range(400)]
    got = np.concatenate([voters.votes(list(features.letter_features(d, o)), d, o) for _, _, d, o in words.chunks(pa.array(texts), limit=300)])
    assert got.tolist() == [brute_votes(voters, t) for t in texts] and got[0] == brute_votes(voters, "YOU IDIOT!!!") and len(set(got.tolist())) > 20


def test_posterior_and_em_against_brute_force():
    """P(class | votes) by the chain rule over all patterns; EM's fit beats every nearby one in likelihood."""
    rng = np.random.default_rng(1)
    votes = np.array(list(np.ndindex(2, 2, 2, 2)))
    counts, known = rng.integers(1, 60, len(votes) * 3).astype(float), np.repeat([-1, 0, 1], len(votes))
    every = np.tile(votes, (3, 1))
    m = toxicity.fit_label_model(every, counts, known, steps=400, smooth=1e-9)

    def joint(model, c, v):
        p = model.prior if c else 1 - model.prior
        for j, up in enumerate(model.parent):
            one = model.table[j, c, v[up] if up >= 0 else 0]
            p *= one if v[j] else 1 - one
        return p

    assert sum(joint(m, c, v) for c in (0, 1) for v in votes) == pytest.approx(1)
    for v, q in zip(votes, m.posterior(votes), strict=True):
        assert q == pytest.approx(joint(m, 1, v) / (joint(m, 0, v) + joint(m, 1, v)))

    def likelihood(model):
        return sum(n * np.log(joint(model, 0, v) + joint(model, 1, v) if k < 0 else joint(model, k, v)) for v, n, k in zip(every, counts, known, strict=True))

    best = likelihood(m)
    for _ in range(60):
        near = np.clip(m.table + rng.normal(0, 0.02, m.table.shape), 1e-6, 1 - 1e-6)
        near[m.parent < 0] = near[m.parent < 0][:, :, :1]
        other = toxicity.LabelModel(float(np.clip(m.prior + rng.normal(0, 0.02), 0.01, 0.99)), m.parent, near, m.accuracy, m.correlation)
        assert likelihood(other) <= best + 1e-6


def test_ordinal_fit_against_a_grid():
    """Three grades, one feature: no weight and thresholds of a fine grid have a smaller penalised negative log likelihood."""
    x = np.array([0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1])
    grade = np.array([0, 0, 0, 1, 2, 0, 1, 1, 2, 2, 2])
    rows = np.flatnonzero(x)
    w, t = quality.fit_ordinal(rows, np.zeros(len(rows), int), grade, 3, 1, steps=4000)

    def loss(w, a, b):
        low = np.where(grade == 0, 1, 1 / (1 + np.exp(-(w * x - np.where(grade == 1, a, b)))))
        high = np.where(grade == 2, 0, 1 / (1 + np.exp(-(w * x - np.where(grade == 0, a, b)))))
        return -np.log(low - high).mean() + 0.5 * 1e-4 * w * w * x.mean()

    found = loss(w[0], *t)
    grid = min(loss(u, a, b) for u in np.arange(0, 3, 0.05) for a in np.arange(-2, 2, 0.05) for b in np.arange(a + 0.05, 3, 0.05))
    assert t[0] < t[1] and found <= grid + 1e-6


def test_features_are_selected_as_numpy_would(spark):
    """Counts, sums and the selection made in Spark against the same over whole arrays, whatever the partitions."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice([f"w{i}" if i % 3 else "alpha" * (i + 1) for i in range(40)], rng.integers(0, 30))) + (" toxic" if k % 4 == 0 else "") for k in range(160)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(160)], "doc_id long, toxic int")
    sample = features.sample_of(docs, labels, "toxic", 500)
    got = {r["feature"] & (2**64 - 1): (r["n"], r["total"] // features.UNIT) for r in features.feature_counts(sample, lambda known, *_: known).collect()}
    want, kept = {}, [k for k in range(160) if zlib.crc32(str(k).encode()) % 3 != 1]
    for k in kept:
        _, found = features.distinct_features(*next((d, o) for _, _, d, o in words.chunks(pa.array([texts[k]]))), False)
        for f in found.tolist():
            n, total = want.get(f, (0, 0))
            want[f] = (n + 1, total + int(k % 4 == 0))
    assert got == want
    target = np.array([float(k % 4 == 0) for k in kept])
    chosen = set(features.select(features.feature_counts(sample, lambda known, *_: known), target, 4, 3.0, 50).tolist())
    z = {f: abs(t / n - target.mean()) * n**0.5 / target.std() for f, (n, t) in want.items() if n >= 4}
    assert chosen == {f for f, s in z.items() if s >= 3.0} and features.word_key("toxic") in chosen
    ids, rows, places = features.design(sample, features.Keys(np.array(sorted(chosen), np.uint64)))
    assert len(ids) == len(kept) and np.bincount(places).sum() == sum(want[f][0] for f in chosen)
    assert features.sample_of(docs, labels, "toxic", 10, free=20).count() <= 30
    assert features.sample_of(docs.limit(0), labels, "toxic", 10, free=20).count() == 0


@pytest.mark.parametrize("labels", [[], [(5, 0, 0), (1, 0, 0)], [(5, 1, 1), (1, 0, None), (None, 1, 1)]])
def test_scores_of_edge_rows(spark, labels):
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = edge(spark)
    got = toxicity.score(df, toxicity.fit(df, lb))
    assert got.count() == len(EDGE) and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.reject(df, lb).columns == df.columns and quality.keep(df, lb).columns == df.columns
    graded = quality.score(df, quality.fit(df, lb))
    assert graded.count() == len(EDGE) and graded.where("expected_grade IS NULL").count() == 0
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), lb)).count() == 0
    named = df.withColumnsRenamed({"score": "SCORE", "expected_grade": "Expected_Grade", "tail_probability": "TAIL_probability"})
    again = toxicity.score(named, toxicity.fit(named, lb))
    assert [c.lower() for c in again.columns].count("score") == 1 and again.select("score").count() == len(EDGE)
    regraded = quality.score(named, quality.fit(named, lb))
    assert regraded.select("expected_grade", "tail_probability").count() == len(EDGE) and len(regraded.columns) == len(df.columns)


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2:
                doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in doubled) % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans(spark, sf):
    rng = np.random.default_rng(1)
    texts = ["a@b.c@d.e x@y", "1.2.3.4.5.6.7.8.9 01.002.3.4444", "a@b..c a@.b a@b.c.@d.e", "+1 2 3 4 5 6 7 8 9 0 ) +1+2 +12345678901234567", "4111 1111 1111 1111-4111111111111111"]
    texts += ["".join(rng.choice(list("a1.@+- ()2"), 40)) for _ in range(3000)] + [r["text"] or "" for r in table(spark, sf, "documents").collect()]
    assert all(pii.base_spans(t) == brute_spans(t) for t in texts)
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 300_000 + "@") == []


def test_tagger_gradients_and_decoding():
    tagger = pii.Tagger(hidden=3)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    rng = np.random.default_rng(0)
    c, y = rng.integers(0, pii.CLASSES, (2, 5)), rng.integers(0, pii.TAGS, (2, 5))
    _, g = tagger.gradients(c, y)
    for name in ("A", "first", "out", "Wf", "Ub", "bb"):
        at = tuple(0 for _ in tagger.p[name].shape)
        tagger.p[name][at] += 1e-3
        high = tagger.gradients(c, y)[0]
        tagger.p[name][at] -= 2e-3
        low = tagger.gradients(c, y)[0]
        tagger.p[name][at] += 1e-3
        assert g[name][at] == pytest.approx((high - low) / 2e-3, abs=2e-5)
    e, _ = tagger.emissions(c[:1, :3])

    def path_score(p):
        return tagger.p["first"][p[0]] + sum(e[t, 0, p[t]] for t in range(3)) + sum(tagger.p["A"][p[t - 1], p[t]] for t in (1, 2))

    best = max(np.ndindex(*(pii.TAGS,) * 3), key=path_score)
    assert tuple(tagger.decode(c[:1, :3])[0]) == best


def test_personal_data_query(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    import hashlib

    base_found = tagged = 0
    for r in queries.op6_pii(spark, sf).collect():
        base = brute_spans(texts[r["doc_id"]])
        shown = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [r[f"n_{kind}"] for kind in pii.KINDS] == [sum(k == i for _, k, _ in base) for i in range(4)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(shown) <= set(spans) and len(spans) == len(base) + r["n_added"]
        base_found += len(base)
        tagged += r["n_added"]
    assert base_found > 30 and tagged > 0
    rng, hit, missed, wrong = np.random.default_rng(77), 0, 0, 0
    for _ in range(150):
        text, spans = pii.labelled_text(rng)
        got, want = set(pii.tagged(pii.trained(), [text])[0]), {s for s in spans if pii.formed(s[1], text[s[0] : s[2]])}
        hit, missed, wrong = hit + len(got & want), missed + len(want - got), wrong + len(got - want)
    assert hit / (hit + missed) > 0.9 and hit / (hit + wrong) > 0.9


def test_added_spans_by_one_sweep():
    rng = random.Random(6)
    for _ in range(400):
        spans = lambda n: [(a, rng.randrange(4), a + rng.randrange(1, 9)) for a in (rng.randrange(40) for _ in range(n))]
        base, added = sorted(spans(rng.randrange(6))), spans(rng.randrange(6))
        assert pii.apart(added, base) == [s for s in added if not any(a < s[2] and s[0] < b for a, _, b in base)]
    text = "reach a%d@mail.example.com " * 40_000 % tuple(range(40_000))
    began = time.time()
    base = pii.base_spans(text)
    assert len(base) == 40_000 and pii.apart([(s + 1, 0, s + 3) for s, _, _ in base], base) == [] and time.time() - began < 20


def test_windows_are_reconciled_and_edges_hold(spark):
    alone = "call me@mail7.example.com now"
    for pad in range(20, 60):  # wherever it lies against the windows, the span is one and the same
        text = "x" * pad + " word" * 20 + " " + alone + " word" * 40
        at = text.index("me@")
        assert pii.tagged(pii.trained(), [text])[0] == [(at, 0, at + 20)]
    found = pii.digest(pii.find(edge(spark)))
    assert found.count() == len(EDGE) and found.where("spans <> ''").count() == 0
    assert pii.find(edge(spark).limit(0)).count() == 0
    df = spark.createDataFrame([(1, "mail me@x.org!"), (2, None)], "doc_id long, text string")
    assert {r["text"] for r in pii.redact(df).collect()} == {"mail <email>!", None}
