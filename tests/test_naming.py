"""Names: merged words split, words kept, concepts named by their top members."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import learners, naming


def test_fewest_against_all_splits():
    g = random.Random(5)
    for _ in range(300):
        n = g.randint(1, 8)
        pieces = {(a, b) for a, b in combinations(range(n + 1), 2) if g.random() < 0.5}
        whole = []
        for cuts in (c for k in range(n) for c in combinations(range(1, n), k)):
            ends = [0, *cuts, n]
            way = list(zip(ends, ends[1:]))
            if set(way) <= pieces:
                whole.append(way)
        got = naming.fewest(n, g.sample(sorted(pieces), len(pieces)))
        # of equally few, the last piece is as long as can be, then the one before
        assert got == (min(whole, key=lambda w: (len(w), [a for a, _ in w[::-1]])) if whole else None)


def test_split_words(spark):
    words = spark.createDataFrame([("thekitchen",), ("iwant",), ("the",), ("xyzzy",), ("",), ("theof" * 2000,), ("inab",)], "word string")
    pieces = spark.createDataFrame([(p,) for p in ("the", "kitchen", "kit", "chen", "i", "want", "of", "xy", "zzy", "in", "ab", "the", "a" * 16)], "word string")
    got = {r["word"]: r["parts"] for r in naming.split_words(words, pieces).collect()}
    # "xy" and "ab" are short and no words
    assert got == {"thekitchen": ["the", "kitchen"], "iwant": ["i", "want"], "theof" * 2000: ["the", "of"] * 2000}


def test_name_words(spark):
    docs = spark.createDataFrame([(i, "Covid") for i in range(10)] + [(20, "thekitchen The kitchen' noise"), (21, None), (22, ""), (23, "my iwant"), (23, "my iwant")], "item_id long, text string")
    common = spark.createDataFrame([("the",), ("kitchen",), ("kitchen",), ("my",)], "word string")
    pieces = spark.createDataFrame([("the",), ("kitchen",), ("want",), ("i",)], "word string")
    rows = naming.name_words(docs, "text", common, pieces, ["the"]).collect()
    assert sorted(tuple(r) for r in rows) == [(i, "covid") for i in range(10)] + [(20, "kitchen"), (23, "want")]
    assert naming.name_words(docs.limit(0), "text", common, pieces, []).count() == 0
    assert {r["word"] for r in naming.name_words(docs, "text", common, pieces.limit(0), []).collect()} == {"covid", "the", "kitchen"}


def test_members_and_their_names(spark):
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, x array<double>")
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (2, [1.0, 0.0]), (5, [0.0, 1.0]), (4, [0.6, 0.8])], "id long, x array<double>")
    top = naming.top_members(centres, rows, 2)
    assert sorted((r["concept"], r["rank"], r["item_id"]) for r in top.collect()) == [(0, 1, 2), (0, 2, 3), (1, 1, 5), (1, 2, 4)]
    words = spark.createDataFrame([(2, "b"), (3, "b"), (2, "c"), (3, "a"), (2, "d"), (4, "z")], "item_id long, word string")
    assert dict(naming.names_of_members(top, words).collect()) == {0: "b-a-c", 1: "z"}


def test_bank_names_clusters_without_phrases(spark):
    g = np.random.default_rng(1)
    at = lambda c: [float(v) for v in np.eye(4)[c] * 5 + g.normal(size=4) * 0.05]
    phrases = spark.createDataFrame([(i, at(i % 3), "ab"[i % 2]) for i in range(30)], "item_id long, vec array<double>, word string")
    images = spark.createDataFrame([(i, at(i % 4)) for i in range(40)], "item_id long, vec array<double>")
    captions = spark.createDataFrame([(i, "sky") for i in range(40)] + [(i, "sea") for i in range(3, 40, 4)], "item_id long, word string")
    plain = {r["name"].split("-")[0] for r in learners.concept_bank(phrases, images, 6).collect()}
    named = [r["name"] for r in learners.concept_bank(phrases, images, 6, captions=captions).collect()]
    assert "image" in plain and not any(n.startswith("image") for n in named) and any(n.startswith("s") for n in named)


def test_splits_need_no_table_of_all_substrings(spark, monkeypatch):
    pieces = spark.createDataFrame([(p,) for p in ("the", "kitchen", "kit", "chen", "want", "of", "i", "äöü", "sea", "side")], "word string")
    words = spark.createDataFrame([(w,) for w in ("thekitchen", "iwant", "kitchen", "seaside", "äöüsea", "seasides", "xyzzy", "kitchenseaside")], "word string")
    right = {"thekitchen": ["the", "kitchen"], "iwant": ["i", "want"], "seaside": ["sea", "side"], "äöüsea": ["äöü", "sea"], "kitchenseaside": ["kitchen", "sea", "side"]}
    inner, sent = naming._cut, spark.sparkContext.accumulator(0)

    def counted(batches, least):
        for batch in inner(batches, least):
            sent.add(sum(map(len, batch.column("parts").to_pylist())))
            yield batch

    monkeypatch.setattr(naming, "_cut", counted)
    assert dict(naming.split_words(words, pieces).collect()) == right
    # once every substring met the pieces
    assert sent.value == 12
    # a table that takes everything for a piece: parts are doubted and the result is the same
    monkeypatch.setattr(naming, "_table", lambda pieces: np.full(1 << naming.BITS - 3, 255, np.uint8))
    assert dict(naming.split_words(words, pieces).collect()) == right
