"""Side-by-side shape models and checks on planted runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import metrics, text
from plumbline.operators import calibration, learners


def items(spark, n=300):
    """Two classes whose texts look alike; `lang` b has one class in capitals."""
    g = np.random.default_rng(5)
    rows = []
    for i in range(n):
        y, lang = int(i % 3 == 0), "ab"[i % 2]
        t = " ".join(g.choice(["word", "other", "text", "more"], g.integers(3, 12)))
        rows.append((i, t.upper() if lang == "b" and y else t, y, lang, ["s", "t"][int(g.integers(2))], ["train", "train", "train", "val", "test"][i // 6 % 5]))
    return spark.createDataFrame(rows, "item_id long, text string, y long, lang string, source string, split string")


def test_groups_side_by_side_are_those_alone(spark, monkeypatch):
    df = items(spark)
    shaped = text.with_shape(df, F.col("text"), "item_id", "split", "y", "lang")
    got = {r["lang"]: r for r in learners.d3_by(shaped, "lang", 2).collect()}
    assert got["b"]["lift"] > 0.3 > 0.15 > got["a"]["lift"] and got["b"]["n_test"] == df.where("lang = 'b' AND split = 'test'").count()
    for lang in "ab":
        alone = learners.d3_surface(df.where(F.col("lang") == lang), "text", "y", 2, b=50).first()
        assert alone["shape_f1"] == pytest.approx(got[lang]["shape_f1"]) and alone["majority_f1"] == pytest.approx(got[lang]["majority_f1"])
    # pieces change nothing
    monkeypatch.setattr(learners, "PIECE", 7)
    again = {r["lang"]: r["shape_f1"] for r in learners.d3_by(shaped, "lang", 2).collect()}
    assert all(again[lang] == pytest.approx(got[lang]["shape_f1"]) for lang in "ab")
    d4 = {r["lang"]: r for r in learners.d4_by(df, "lang", "text", "source", "y").collect()}
    assert all(r["sources"] == 2 and r["auc"] < 0.8 and r["verdict"] == "ok" for r in d4.values())
    v = {r["lang"]: r["v"] for r in metrics.cramers_v_by(df, "lang", "source", "y").collect()}
    for lang in "ab":
        assert v[lang] == pytest.approx(metrics.cramers_v(df.where(F.col("lang") == lang), "source", "y").first()["v"])
    assert learners.d3_by(shaped.limit(0), "lang", 2).count() == 0


def test_planted_cues_are_found_by_d3_and_controls_are_not(spark):
    df = items(spark).withColumn("text", F.lower("text"))
    runs = {r["run"]: r for r in calibration.d3_runs(df, 2, (0.5, 1.0), (0,)).collect()}
    assert set(runs) == {"base-0-0", "leak-500-0", "leak-1000-0", "control-500-0", "control-1000-0"}
    whole = runs["leak-1000-0"]
    assert whole["planted"] == df.where("y = 1").count() and whole["oracle_lift"] > 0.4 and whole["d3_lift"] == pytest.approx(whole["oracle_lift"], abs=0.1)
    assert runs["base-0-0"]["oracle_lift"] == 0 and abs(runs["control-1000-0"]["oracle_lift"]) < 0.2
    rows = spark.createDataFrame([("base", 0.01), ("control", 0.06), ("leak", 0.2), ("leak", 0.4)], "kind string, lift double")
    table = {r["t"]: r for r in calibration.thresholds(rows, "lift", (0.05, 0.1, 0.3), F.lit(True)).collect()}
    assert table[0.1]["chosen"] and table[0.05]["false_flag"] == 0.5 and table[0.3]["detect"] == 0.5 and not table[0.05]["chosen"]


def test_planted_copies_are_looked_up(spark):
    df = items(spark).withColumn("text", F.concat_ws(" ", F.lower("text"), F.col("item_id").cast("string")))
    runs = {r["run"]: r for r in calibration.d6_runs(df, (0.5, 1.0), (0,), 2).collect()}
    assert runs["base-0-0"]["dup_share"] == 0 and runs["leak-1000-0"]["leaky_share"] == 1 and runs["control-1000-0"]["leaky_share"] == 0
    assert runs["leak-500-0"]["dup_share"] == runs["control-500-0"]["dup_share"] and 0.2 < runs["leak-500-0"]["dup_share"] < 0.8
