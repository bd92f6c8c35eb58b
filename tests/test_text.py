import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import text

EDGE = [None, "", "   ", "   x y", "²½Ⅷ ªº", "naïvé Ǆǅ", "a_b __ 9٣", "😀 hi 👍🏽", "İSTANBUL ß", "\x1ca\x1db", "a​b", "Ⅰ ⓐ", "A" * 5000 + " b" * 300]


def features(t):
    t = t or ""
    w, n = t.split(), len(t)
    lengths = [len(x) for x in w]
    ratio = lambda k: k / n if n else 0.0
    word = lambda c: c.isalnum() or c == "_"
    return (
        float(n), float(len(w)), sum(lengths) / len(w) if w else 0.0, float(max(lengths, default=0)),
        ratio(sum(c.isupper() for c in t)), ratio(sum(c.isdigit() for c in t)), ratio(sum(not word(c) and not c.isspace() for c in t)),
        ratio(n - sum(c.isalnum() for c in t)), len({x.lower() for x in w}) / len(w) if w else 0.0,
    )


def spark_features(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").coalesce(1)
    return [tuple(r)[1:] for r in df.select("i", *text.shape(F.col("t"))).orderBy("i").collect()]


def test_edges(spark):
    for t, got in zip(EDGE, spark_features(spark, EDGE), strict=True):
        assert got == pytest.approx(features(t), abs=1e-9), t


_old = st.characters(max_codepoint=0x86F, exclude_categories=["Cs", "Cn"])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(_old, max_size=40), min_size=5, max_size=20))
def test_any_text(spark, texts):
    for t, got in zip(texts, spark_features(spark, texts), strict=True):
        assert got == pytest.approx(features(t), abs=1e-9), [unicodedata.name(c, hex(ord(c))) for c in t]


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t"))).first()[0]


def test_normal_forms(spark):
    for t in EDGE[:-1]:
        if t is None or not t.isascii():
            continue
        assert one(spark, text.normal, t) == re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ]", " ", t.lower())).strip()
    assert one(spark, text.tweet, "see https://x.y/z @me  now") == "see now"
    assert one(spark, text.squeeze, "a� b\n c") == "a b c"
    assert one(spark, text.quoted_label, 'concept:"a-b"') == "a-b"
    assert one(spark, text.quoted_label, "plain") == "plain"
    assert one(spark, lambda c: text.has_phrase(c, "b c"), "a b cd") is False


def test_votes(spark):
    assert one(spark, text.majority_vote, ["b", "a", "a", "b"], "array<string>") == "b"
    assert one(spark, text.majority_vote, ["b", "a"], "array<string>") == "-1"
    assert [one(spark, text.yes_no_vote, v, "array<string>") for v in (["YES", "no", "yes"], ["NO"], ["YES", "NO"], [])] == [1, 0, -1, -1]
    cats = ["x", "y", "z"]
    assert one(spark, lambda c: text.top_category(c, cats), [["y"], ["z", "x"], ["z"]], "array<array<string>>") == 2
    assert one(spark, lambda c: text.top_category(c, cats), [["y"], ["x"]], "array<array<string>>") == 0
    assert one(spark, lambda c: text.top_category(c, cats), [[]], "array<array<string>>") == -1


def test_literals_and_splits(spark):
    assert tuple(one(spark, text.parsed_literal, 'NOT says:"a>b">0.25')) == (True, 'says:"a>b"', 0.25)
    assert tuple(one(spark, text.parsed_literal, "flag")) == (False, "flag", None)
    vocabulary = F.array(*map(F.lit, ["a", "woman", "wo", "man", "kitchen"]))
    assert one(spark, lambda c: text.split_merged(c, vocabulary), "womankitchen") == ["woman", "kitchen"]
    assert one(spark, lambda c: text.split_merged(c, vocabulary), "xyz") == ["xyz"]
    assert one(spark, lambda c: text.naming_tokens(c, ["the"]), "The cat's hat, at") == ["cat", "hat"]


def test_perturbed(spark):
    got = one(spark, lambda c: text.perturbed(c, F.lit(4)), "One, two THREE")
    assert got == "one three"
    assert one(spark, lambda c: text.perturbed(c, F.lit(4)), "One two") == "one two"


def test_normal_form_in_one_pass(spark):
    rows = spark.createDataFrame([(t,) for t in EDGE], "t string")
    two = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("t", F.lit(""))), "[^a-z0-9 ]", " "), r"\s+", " "))
    assert all(a == b for a, b in rows.select(text.normal(F.col("t")), two).collect())
    assert str(text.normal(F.col("t"))).count("regexp_replace") == 1


def test_normal_forms_in_batches(spark):
    import hashlib

    import pyarrow as pa

    texts = [None, "", "  Ab -- c\x00D!", "é", "xKyİz", "a\n\tb", "ß" * 3 + "9", "Größe 12 ", " q", "\U0001f600a", "aΣ b", " ", "ZZ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    want = {r["id"]: r["n"] for r in rows.select("id", text.normal(F.col("t")).alias("n")).collect()}
    assert [f.decode() for f in text.normal_forms(pa.array(texts))] == [want[k] for k in range(len(texts))]
    for least in (1, 3):
        got = {r["id"]: bytes(r["digest"]) for r in text.normal_digests(rows, "t", "id", least=least).collect()}
        assert got == {k: hashlib.sha256(n.encode()).digest() for k, n in want.items() if len(n) >= least}
    assert text.normal_forms(pa.array([], pa.string())) == []


def test_copies_are_found_by_digests(spark):
    from plumbline.operators import duplicates

    rows = spark.createDataFrame([(1, "A b!", "train"), (2, "a  B", "test"), (3, "other", "test"), (4, "", "test"), (5, None, "train")], "item_id long, text string, split string")
    assert duplicates.exact_duplicates(rows).collect() == [(2, "a b")] and duplicates.exact_keys(rows).collect() == [(2,)]
    # once both sides were parted by whole normal forms
    plan = duplicates.exact_keys(rows)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and "digest" in plan
