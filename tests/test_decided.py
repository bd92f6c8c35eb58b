"""Decision rules on rows of their own: every branch, ties, missing values."""

import math

from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import decisions, pooling, relations, system, tasks

D3 = [("a", 0.35, 0.90), ("b", 0.20, 0.80), ("c", 0.05, 0.99), ("d", 0.20, 0.50), ("e", 0.40, None), ("f", 0.15, 0.75), ("g", 0.30, 0.84), ("h", -0.1, None)]


def test_d3_levels_and_flips(spark):
    rows = spark.createDataFrame(D3, "task string, lift double, share double")
    level = rows.select("task", decisions.d3_level(F.col("lift"), F.col("share")).alias("level")).withColumn("verdict", decisions.d3_verdict(F.col("level")))
    got = {r["task"]: (r["level"], r["verdict"]) for r in level.collect()}
    flag = lambda x: (x, "FLAG")
    assert got == {"a": flag("severe"), "b": flag("notable"), "c": ("clean", "ok"), "d": ("", "note"), "e": ("", "note"), "f": flag("notable"), "g": flag("notable"), "h": ("clean", "ok")}
    flips = {r["task"]: (r["below"], r["above"]) for r in decisions.flip_points(rows).collect()}
    assert flips["f"] == (None, 1.005) and flips["a"] == (None, 1.17) and flips["h"] == (None, None) and flips["c"] == (0.5, None)


def test_d4_and_rollup(spark):
    rows = spark.createDataFrame([("a", 0.9, 0.6, 3), ("b", 0.9, 0.4, 3), ("c", 0.7, 0.9, 2), ("d", None, 0.0, 1)], "task string, auc double, v double, sources int")
    got = rows.select("task", decisions.d4_verdict(F.col("auc"), F.col("v"), F.col("sources")).alias("v")).collect()
    assert [r["v"] for r in sorted(got)] == ["FLAG", "ok", "ok", "note"]
    several = spark.createDataFrame([("a", "ok"), ("a", "FLAG"), ("b", "note"), ("b", "ok"), ("c", "note")], "task string, v string")
    assert dict(several.groupBy("task").agg(relations.worst(F.col("v")).alias("v")).collect()) == {"a": "FLAG", "b": "ok", "c": "note"}


def _tail(k, n, p):
    return math.log10(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))


def test_false_flag_counts_by_halving(spark):
    cases = [(p, n) for p in (0.05, 0.3, 0.5, 0.9, 0.95, 0.97) for n in (1, 2, 20, 59, 200)]
    got = {(r["base"], r["n"]): (r["k_min"], r["log10_rate"]) for r in relations.false_flag_rates(spark.createDataFrame([*cases, (1.0, 50)], "base double, n long")).collect()}
    assert got[1.0, 50] == (None, None)
    for p, n in cases:
        fit = [k for k in range(1, n + 1) if k >= n * 0.95 - 1e-9 and _tail(k, n, p) <= -3]
        k, rate = got[p, n]
        assert k == (fit[0] if fit else None)
        assert (rate is None) == (not fit) and (not fit or abs(rate - _tail(k, n, p)) < 1e-6)


def test_provenance_and_literals(spark):
    rows = spark.createDataFrame([("title", "a", "typed"), ("title", "b", "first line"), ("text", "a", "crawl")], "field string, source string, method string")
    assert [r["verdict"] for r in sorted(relations.provenance(rows, ["caption", "text", "title"]).collect())] == ["note", "ok", "FLAG"]
    names = spark.createDataFrame([(n,) for n in ("NOT a>0.5", 'says:"x"', "b>c>-1.25", "NOT flag", "d>2e-3", "", None)], "name string")
    got = [tuple(r) for r in names.select(text.parsed_literal(F.col("name")).alias("p")).select("p.*").collect()]
    assert got == [(True, "a", 0.5), (False, 'says:"x"', None), (False, "b>c", -1.25), (True, "flag", None), (False, "d", 0.002), (False, "", None), (None, None, None)]


def test_small_inventories(spark):
    out = tasks.thresholds(spark.createDataFrame([("support", 15.0), ("lift", 3.0)], "name string, value double"), spark.createDataFrame([("lift", 2.5), ("other", 1.0)], "name string, value double"))
    assert dict(out.collect()) == {"support": 15.0, "lift": 2.5}
    done = tasks.status(spark.createDataFrame([("a",), ("b",)], "task string"), spark.createDataFrame([("a", "D3"), ("a", "D3"), ("a", "D6")], "task string, check string"))
    assert {tuple(r) for r in done.collect()} == {("a", True, 2), ("b", False, 0)}
    why = tasks.dispatch(spark.createDataFrame([("a", 1, 1, 0, 2), ("b", None, 3, 2, 1)], "task string, texts int, sources int, encoders int, systems int"))
    assert {(r["task"], r["check"]) for r in why.collect() if not r["run"]} == {("a", "D4"), ("a", "D5"), ("b", "D3"), ("b", "D6"), ("b", "S2")}
    lp = spark.createDataFrame([(None,), (2,)], "a int").select(pooling.answer_log_probs(F.col("a"), 4).alias("lp")).collect()
    assert all(abs(x - math.log(0.25)) < 1e-12 for x in lp[0]["lp"]) and abs(lp[1]["lp"][2] - math.log(0.85)) < 1e-12


def test_s2_and_s6(spark):
    s2 = spark.createDataFrame([("equal", 0.012, -0.01, None), ("caption", 0.19, 0.15, 0.10), ("ocr", 0.03, 0.005, -0.02), ("none", -0.02, -0.05, -0.03)], "config string, margin double, margin_lo double, swing_lo double")
    got = system.s2_verdict(s2, "equal").first()
    assert (got["gains"], got["gain_partly_from_inputs"], got["verdict"], got["verdict_no_gain_survives"]) == (["caption", "ocr"], ["caption"], "FLAG", "FLAG") and abs(got["swing"] - 0.178) < 1e-9
    deltas = spark.createDataFrame([(0, "f", 0.1), (1, "f", 0.3), (0, "a", 0.0), (1, "a", 0.0)], "partition int, metric string, value double")
    both = {r["metric"]: (r["met"], r["verdict"]) for r in system.s6_verdict(deltas, spark.createDataFrame([("f", 0.2), ("a", 0.005)], "metric string, criterion double")).collect()}
    assert both == {"f": (True, "FLAG"), "a": (False, "FLAG")}
