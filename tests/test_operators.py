"""Verdicts on planted cases, invariants, and edge rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import graph, metrics, rng, vectors
from plumbline.operators import calibration, decisions, duplicates, learners, mining, pooling, relations, resampling, review, system
from plumbline.plans.fixtures import embedded, labelled


def test_binomial_tail(spark):
    def exact(k, n, p):
        return math.log10(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))

    cases = [(20, 20, 0.5), (19, 20, 0.9), (5, 50, 0.3), (0, 10, 0.2), (10, 10, 1.0), (300, 400, 0.5)]
    df = spark.createDataFrame(cases, "k long, n long, p double")
    got = [r[0] for r in df.select(relations.log10_binomial_tail(F.col("k"), F.col("n"), F.col("p"))).collect()]
    assert got == pytest.approx([exact(*c) if c[2] < 1 else 0.0 for c in cases], abs=1e-8)


def test_planted_relation_is_flagged(spark):
    rows = [(i, "same" if i < 40 else f"a{i}", "same" if i < 40 else f"b{i}", "x" if i < 40 or i % 3 == 0 else "y") for i in range(200)] + [(999, None, " ", "y")]
    df = spark.createDataFrame(rows, "item_id long, a string, b string, label string")
    got = {r["relation"]: r for r in relations.relations(df, ["a", "b"], "label").collect()}
    assert got["a == b"]["verdict"] == "FLAG" and got["a == b"]["support"] == 40
    assert "a inside b" not in got and got["a and b both empty"]["support"] == 1


def test_worst(spark):
    df = spark.createDataFrame([("g", "ok"), ("g", "note"), ("h", "FLAG"), ("i", "note")], "k string, v string")
    assert {r["k"]: r["w"] for r in df.groupBy("k").agg(relations.worst(F.col("v")).alias("w")).collect()} == {"g": "ok", "h": "FLAG", "i": "note"}


def test_absent_class_counts_in_macro_f1(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 0)], "y long, pred long")
    row = metrics.macro(metrics.confusion(df, []), [], 3).first()
    assert row["macro_f1"] == pytest.approx((2 * 2 / 5 + 2 / 3) / 3) and row["acc"] == 0.75


def test_cramers_v(spark):
    perfect = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1)], "s string, y int")
    single = spark.createDataFrame([("a", 0), ("a", 1)], "s string, y int")
    assert metrics.cramers_v(perfect, "s", "y").first()["v"] == pytest.approx(1)
    assert metrics.cramers_v(single, "s", "y").first()["v"] == 0


def test_splits_are_repeatable_and_stratified(spark, sf):
    rows = labelled(spark, sf).select("item_id", "y")
    a = rng.stratified_split(rows, "y", "item_id")
    assert sorted(a.collect()) == sorted(rng.stratified_split(rows.repartition(7), "y", "item_id").collect())
    folds = rng.stratified_folds(rows, "y", "item_id", 4).groupBy("y").pivot("fold").count().na.fill(0).collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in folds)


def test_exact_matches_that_disagree_take_the_lowest_label(spark):
    rows = [(0, "Same text!", 2, "train"), (1, "same TEXT", 1, "val"), (2, "same text", 1, "test"), (3, "", 0, "test"), (4, "", 0, "train"), (5, None, 0, "test")]
    df = spark.createDataFrame(rows, "item_id long, text string, y long, split string")
    got = {r["item_id"]: (r["dup"], r["answer"]) for r in duplicates.lookup(df).collect()}
    assert got == {2: (True, 1), 3: (False, -1), 5: (False, -1)}


def test_planted_copies_leak(spark):
    rows = [(i, f"word{i} text{i * 7} more{i % 5} item{i}", i % 2, "test" if i % 4 == 0 else "train") for i in range(400)]
    df = spark.createDataFrame(rows, "item_id long, text string, y long, split string")
    copied = df.unionByName(df.where("split = 'test' AND item_id % 8 = 0").withColumns({"item_id": F.col("item_id") + 1000, "split": F.lit("train")}))
    assert duplicates.d6(copied, reps=5).first()["verdict"] == "FLAG"
    assert duplicates.d6(df, reps=5).first()["verdict"] == "ok"
    assert calibration.plant_copies(df, 0.5).where("item_id < 0").count() > 20


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(graph.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert {got[i] for i in range(61)} == {0} and got[101] == got[100] == 100 and len(got) == 63
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_stay_on_one_side(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 90) if i % 3 != 2], "a long, b long")
    items = spark.createDataFrame([(i, i % 4) for i in range(300)], "item_id long, y long")
    split = duplicates.group_split(duplicates.components(items, links), items)
    assert split.count() == 300 and duplicates.crossing(links, split).count() == 0
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert abs(counts["test"] - 45) < 15 and abs(counts["val"] - 45) < 15


def test_nearest_ties_take_the_smaller_id(spark):
    q = spark.createDataFrame([(9, [1.0, 0.0])], "id long, x array<double>")
    r = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, x array<double>")
    assert [x["id"] for x in vectors.nearest(q, r, 2).orderBy("rank").collect()] == [1, 3]
    assert [tuple(x)[:2] for x in vectors.close_pairs(r, 0.9).collect()] == [(1, 3)]


def test_close_pairs_of_a_block_that_comes_in_two_orders(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k in range(8)], "id long, x array<double>").coalesce(1)
    plain = vectors._pack
    monkeypatch.setattr(vectors, "_pack", lambda r, block, size: plain(r.orderBy(F.desc("id") if block == "rb" else "id").coalesce(1), block, size))
    assert sorted(tuple(x)[:2] for x in vectors.close_pairs(rows, 0.9).collect()) == [(a, b) for a in range(8) for b in range(a + 1, 8) if (a - b) % 2 == 0]


def test_blocks_meet_in_strips(spark, monkeypatch):
    monkeypatch.setattr(vectors, "STRIP", 3)
    rows = spark.createDataFrame([(k, [float(k % 3 == c) for c in range(3)]) for k in range(10)], "id long, x array<double>")
    met = vectors.block_pairs(rows, rows, lambda ids, x, rids, rx, same: [[len(ids)], [len(rids)]], "n long, m long")
    most = [tuple(r) for r in met.collect()]
    assert max(n for n, _ in most) <= 3 and sum(n * m for n, m in most) == 100
    found = vectors.nearest(rows, rows, 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in found] == [(k, other) for k in range(10) for other in (k % 3, k % 3 + 3)]


def test_softmax(spark):
    z = [1000.0, 1001.0, -5.0]
    got = spark.createDataFrame([(z,)], "z array<double>").select(vectors.log_softmax(F.col("z"))).first()[0]
    x = np.array(z) - max(z)
    assert got == pytest.approx(x - np.log(np.exp(x).sum()))


def macro_f1(y, p, k):
    d = [(2 * ((y == c) & (p == c)).sum(), (y == c).sum() + (p == c).sum()) for c in range(k)]
    return sum(a / b if b else 0.0 for a, b in d) / k


def test_registered_bootstraps_draw_all_resamples(spark):
    """Lift and share of the registered query, against numpy with 2000 resamples on a small table: units by the hash of what they hold."""
    import hashlib

    from plumbline.functions import rng
    from plumbline.plans import fixtures, system_tier

    assert system_tier.REPS == resampling.B == 2000
    rows = [(r["y"], r["pa"]) for r in fixtures.predictions(spark, "/root/testdata/sf0.001").where("seed = 0").collect()]
    rows.sort(key=lambda r: hashlib.md5(f"1|{r[0]}|{r[1]}x1".encode()).hexdigest())
    y, pa = (np.array([r[c] for r in rows]) for c in (0, 1))
    n, k = len(rows), fixtures.CLASSES
    f = np.array([(macro_f1(y[d], pa[d], k), macro_f1(y[d], np.ones(n, int), k)) for d in (rng.places(43, b, 0, n, n) for b in range(2000))])
    want = {"lift": np.percentile(f[:, 0] - f[:, 1], [2.5, 97.5]), "share": np.percentile(f[:, 0] / 0.8, [2.5, 97.5])}
    for r in system_tier.bootstrap_lift(spark, "/root/testdata/sf0.001").collect():
        assert [r["lo"], r["hi"]] == pytest.approx(want[r["metric"]], abs=2e-6)


def predicted(spark, n, seeds=3, k=3, groups=None):
    """pos, seed, y, pa, pb of n rows as a frame, and as arrays (y; seeds x n)."""
    g = np.random.default_rng(7)
    y = g.integers(0, k, n)
    hard = (g.random(groups)[np.arange(n) % groups] if groups else g.random(n)) < 0.3
    side = lambda p: np.where(hard & (g.random((seeds, n)) < 0.8) | (g.random((seeds, n)) < p), g.integers(0, k, (seeds, n)), y)
    pa, pb = side(0.1), side(0.2)
    frame = {"pos": np.tile(np.arange(n), seeds), "seed": np.repeat(np.arange(seeds), n), "y": np.tile(y, seeds), "pa": pa.ravel(), "pb": pb.ravel()}
    return spark.createDataFrame(pd.DataFrame(frame)), y, pa, pb


def plain_intervals(y, pa, pb, k, draw, b):
    stats = lambda i: np.mean([[macro_f1(y[i], a[i], k) - macro_f1(y[i], c[i], k), (a[i] == y[i]).mean() - (c[i] == y[i]).mean()] for a, c in zip(pa, pb, strict=True)], axis=0)
    boot = np.array([stats(draw()) for _ in range(b)])
    return stats(np.arange(len(y))), np.percentile(boot, [2.5, 97.5], axis=0)


def test_row_bootstrap_of_many_rows_is_the_plain_one(spark):
    """10,000 rows: mean and ends against draws row by row, within what 600 resamples leave open."""
    n, k = 10_000, 3
    frame, y, pa, pb = predicted(spark, n, k=k)
    g = np.random.default_rng(1)
    mean, ends = plain_intervals(y, pa, pb, k, lambda: g.integers(0, n, n), 600)
    for r in resampling.paired_interval(frame, n, k).collect():
        m = ["d_macro_f1", "d_acc"].index(r["metric"])
        width = ends[1, m] - ends[0, m]
        assert r["mean"] == pytest.approx(mean[m]) and abs(r["lo"] - ends[0, m]) < 0.12 * width and abs(r["hi"] - ends[1, m]) < 0.12 * width


def test_cluster_bootstrap_draws_whole_clusters(spark):
    """6,000 clusters, one of them large: as whole clusters drawn plainly, and wider than rows."""
    n, groups, k = 12_000, 6_000, 3
    frame, y, pa, pb = predicted(spark, n, 2, k, groups)
    group = np.arange(n) % groups
    group[9_000:] = 17
    members = [np.flatnonzero(group == c) for c in range(groups)]
    g = np.random.default_rng(2)
    mean, ends = plain_intervals(y, pa, pb, k, lambda: np.concatenate([members[c] for c in g.integers(0, groups, groups)]), 500)
    place = spark.createDataFrame(pd.DataFrame({"pos": np.arange(n), "group": group}))
    drawn = frame.join(resampling.group_positions(place), "pos").drop("pos").withColumnRenamed("place", "pos")
    for r in resampling.paired_interval(drawn, groups, k).collect():
        m = ["d_macro_f1", "d_acc"].index(r["metric"])
        width = ends[1, m] - ends[0, m]
        assert r["mean"] == pytest.approx(mean[m]) and abs(r["lo"] - ends[0, m]) < 0.12 * width and abs(r["hi"] - ends[1, m]) < 0.12 * width


def test_blocks_and_chunks_change_no_draw(spark, monkeypatch):
    n = 700
    frame, *_ = predicted(spark, n, 2)
    by = ["seed", "y", "pa", "pb"]
    rows = lambda: sorted(tuple(r) for r in resampling.resampled(frame, by, n, 30).collect())
    one = rows()
    assert sum(r[-1] for r in one) == 30 * n * 2
    monkeypatch.setattr(resampling, "ENTRIES", 40)
    monkeypatch.setattr(resampling, "CHUNK", 100)
    assert rows() == one
    assert resampling.resampled(frame.limit(0), by, 0, 30).count() == 0


def test_positions_and_bootstrap_of_equals(spark):
    p = spark.createDataFrame([(i * 3, s, i % 3, i % 3, i % 3) for i in range(30) for s in range(2)], "item_id long, seed long, y long, pa long, pb long")
    pos = resampling.positions(p)
    assert sorted(r["pos"] for r in pos.collect()) == list(range(30))
    got = resampling.paired_interval(p.join(pos, "item_id"), 30, 3, b=20).collect()
    assert all((r["mean"], r["lo"], r["hi"]) == (0, 0, 0) for r in got)


def test_system_verdicts(spark):
    inputs = spark.createDataFrame([("a", "image"), ("b", "image")], "component string, input string")
    assert system.s1_inventory(inputs, ["a"], ["b"], ["image"]).first()["verdict"] == "ok"
    assert system.s1_inventory(inputs, ["a"], ["b"], []).first()["verdict"] == "FLAG"
    rows = spark.createDataFrame([(1, 1, 1)] * 99 + [(1, 1, 0)], "y long, pred_full long, pred_without long")
    got = system.s4_influence(rows).first()
    assert (got["n_changed"], got["fixes"], got["breaks"], got["verdict"]) == (1, 1, 0, "FLAG")


def test_claims_of_single_seeds(spark):
    rows = [(e, o, v, s, f) for s in range(3) for e, o in (("weak", 0), ("strong", 1)) for v, f in (("image", 0.5), ("text", 0.6), ("both", 0.7 if s else 0.6))]
    got = {(r["image_claim"], r["verdict"]): r["seeds"] for r in decisions.d5_stability(spark.createDataFrame(rows, "encoder string, enc_order int, view string, seed long, macro_f1 double")).collect()}
    assert got == {("contributes under every encoder", "ok"): 2, ("adds little under the strongest encoder", "ok"): 1}


def test_unfaithful_explanations_are_flagged(spark):
    g = np.random.default_rng(0)
    w = [[1.0, 0, 0, 0, 0, 0], [-1.0, 0, 0, 0, 0, 0]]
    z = [(i, [float(v) for v in g.normal(size=6)]) for i in range(120)]
    df = spark.createDataFrame(z, "item_id long, z array<double>")
    label = (w, [0.0, 0.01])
    best = F.when(F.col("z")[0] >= 0.01 - F.col("z")[0], 1.0).otherwise(-1.0)
    true = df.withColumn("contrib", F.transform("z", lambda x, i: F.when(i == 0, x * best).otherwise(0.0)))
    assert system.s5_verdict(system.s5_faithfulness(true, *label, reps=5)).first()["verdict"] == "FLAG"  # three of six at random often hold the only one
    one = system.s5_faithfulness(true, *label, ks=(1,), reps=5)
    assert system.s5_verdict(one, k=1).first()["verdict"] == "ok"
    assert system.s5_verdict(system.s5_faithfulness(calibration.shuffled_contributions(true), *label, ks=(1,), reps=5), k=1).first()["verdict"] == "FLAG"


def test_attribution_sums_to_the_margin(spark, sf):
    e = embedded(spark, sf).select("item_id", F.slice("vec", 1, 5).alias("z"), vectors.log_softmax(F.slice("vec", 6, 3)).alias("ln"))
    g = np.random.default_rng(1)
    card = pooling.Scorecard(list("abcde"), [0.0] * 5, [1.0] * 5, g.normal(size=(3, 5)).tolist(), g.normal(size=3).tolist(), [-1.0, -2.0, -0.5])
    d = pooling.decompose(e, card, 0.3)
    gap = F.abs(F.aggregate("contrib", F.lit(0.0), lambda s, x: s + x) + F.col("bias") - F.col("margin_concept"))
    assert d.agg(F.max(gap)).first()[0] < 1e-6
    margin = F.abs(F.element_at("scores", (F.col("pred") + 1).cast("int")) - F.element_at("scores", (F.col("runner_up") + 1).cast("int")) - F.col("margin_concept") - F.col("margin_neural"))
    assert d.agg(F.max(margin)).first()[0] < 1e-9
    card.save(spark, "/tmp/checkpoints/card.parquet")
    assert pooling.Scorecard.load(spark, "/tmp/checkpoints/card.parquet") == card


def test_small_row_functions(spark):
    row = spark.createDataFrame([(None, 2)], "a int, b int")
    got = row.select(pooling.answer_log_probs(F.col("a"), 4).alias("x"), pooling.answer_log_probs(F.col("b"), 4).alias("y")).first()
    assert np.exp(got["x"]) == pytest.approx([0.25] * 4) and np.exp(got["y"]) == pytest.approx([0.05, 0.05, 0.85, 0.05])
    d = spark.createDataFrame([([0.2, 0.7], [True, False])], "s array<double>, f array<boolean>")
    scores = pooling.linear_policy(F.col("s"), F.col("f"), [[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0], [0.6, -5.0])
    assert d.select(scores).first()[0] == pytest.approx([0.8, 0.7])


def test_deferral_closed_form_is_the_mean_of_draws(spark):
    rows = spark.createDataFrame([(i, i % 3, int(i % 4 == 0)) for i in range(60)], "item_id long, s int, err long")
    exact = review.deferral(rows, "s", (0.2,)).first()["caught"]
    drawn = review.deferral_draws(rows, "s", 0.2, 400).agg(F.avg("caught")).first()[0]
    assert exact == pytest.approx(drawn, abs=0.03)


def test_source_null_is_about_a_half(spark):
    rows = spark.createDataFrame([(i, float(i % 17), i % 3 == 0) for i in range(300)], "item_id long, score double, positive boolean")
    got = calibration.source_null(rows, reps=10).first()
    assert 0.5 <= got["mean"] < 0.58 and got["max"] >= got["p99"]


def test_planted_cue_is_seen_by_form(spark):
    rows = [(i, f"plain words number {i % 7} here", i % 2, ["train", "train", "val", "test"][i // 2 % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "item_id long, text string, y long, split string")
    cued = calibration.plant_cue(df, F.col("y") == 1, 0.9)
    got = learners.d3_surface(cued, "text", "y", 2, text_ref=1.0).first()
    assert got["verdict"] == "FLAG" and got["level"] == "severe"
    assert learners.d3_surface(df, "text", "y", 2).first()["level"] in ("clean", "")


def test_single_source_is_a_note(spark):
    df = spark.createDataFrame([(1, "a", "s", "x", "train"), (2, "b", "s", "y", "test")], "item_id long, text string, source string, label string, split string")
    assert learners.d4_source(df, "text", "source", "label").first()["verdict"] == "note"


def test_scorecard_and_medoids(spark):
    rows = [(i, [float(i % 3 == c) + 0.01 * (i % 5) for c in range(3)], i % 3, ["train", "train", "val", "test"][i % 4]) for i in range(120)]
    df = spark.createDataFrame(rows, "item_id long, vec array<double>, y long, split string")
    card = learners.scorecard(df, list("abc"), 3, prior=True)
    pred = df.select("y", vectors.argmax(card.logits(card.standardised(F.col("vec")))).alias("p"))
    assert pred.where("y <> p").count() == 0
    clusters, centres = learners.kmeans(df.select("item_id", "vec"), 3)
    assert learners.medoids(df, clusters, centres).count() == 3


def test_rule_firing_and_prediction_ties(spark):
    fires = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "item_id long, lit_id long")
    rules = spark.createDataFrame([("b", [0, 1], 0.8), ("a", [1], 0.8), ("c", [9], 0.9)], "class string, lits array<long>, precision double")
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    fired = mining.fire(fires, rules, items)
    assert {(r["item_id"], r["class"]) for r in fired.where("fired").collect()} == {(1, "a"), (1, "b"), (2, "a")}
    assert {r["item_id"]: r["pred"] for r in mining.rule_prediction(fired, "none").collect()} == {1: "a", 2: "a", 3: "none"}


def test_levels():
    assert decisions.SEVERE > decisions.NOTABLE and decisions.CLEAN_LIFT < decisions.NOTABLE[0]


def test_learned_cuts_and_beam(spark):
    from plumbline.operators import regimes

    g = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(240):
        c = "a" if i % 3 == 0 else "b"
        labels.append((i, c))
        rows += [(i, "f0", float(g.normal(2.0 if c == "a" else 0.0))), (i, "f1", float(g.normal()))]
    scores, lb = spark.createDataFrame(rows, "item_id long, feature string, value double"), spark.createDataFrame(labels, "item_id long, class string")
    got = {}
    for r in regimes.learned_cuts(scores, lb).collect():
        got.setdefault(r["feature"], []).append(r["cut"])
    assert len(got["f0"]) == 3 and any(0.7 < c < 1.9 for c in got["f0"])
    lits = mining.literals(scores, lb)
    fires = mining.true_literals(scores, lits)
    cands = mining.clauses(fires, lits, lb)
    greedy = {}
    for r in mining.greedy_dnf(cands, fires, lb).collect():
        greedy[r["class"]] = max(greedy.get(r["class"], 0), r["dnf_fbeta"])
    beam = {r["class"]: r["fbeta"] for r in regimes.beam_dnf(cands, fires, lb).collect()}
    assert set(beam) == set(greedy) and all(beam[c] >= greedy[c] - 1e-9 for c in beam)
    shapes = regimes.complexity_by_folds(fires, lits, lb, grid=((1, 1), (2, 1)), folds=2).collect()
    assert {r["class"] for r in shapes} == {"a", "b"}


def test_banks(spark):
    from plumbline.operators import regimes

    bank = regimes.random_bank(5, 7)
    assert np.linalg.norm(bank, axis=1) == pytest.approx(np.ones(5)) and bank == regimes.random_bank(5, 7)
    g = np.random.default_rng(0)
    side = lambda: spark.createDataFrame([(i, g.normal(size=4).tolist()) for i in range(60)], "item_id long, vec array<double>")
    assert np.linalg.norm(regimes.unsupervised_bank(side(), side(), 3, 5), axis=1) == pytest.approx(np.ones(3))


def test_routed_system_end_to_end(spark, tmp_path):
    from plumbline.operators import routed

    g = np.random.default_rng(2)
    rows = []
    for i in range(240):
        c = i % 2
        centre = np.array([1.0, 0, 0, 0]) if c else np.array([0, 1.0, 0, 0])
        ln = np.log([0.7, 0.3] if (c == 0) == (i % 7 > 0) else [0.3, 0.7])
        split = ["train", "train", "train", "val", "test"][i % 5]
        rows.append((i, (centre + g.normal(size=4) * 0.2).tolist(), (centre + g.normal(size=4) * 0.2).tolist(), f"w{c}", "neg pos".split()[c], split, ln.tolist()))
    df = spark.createDataFrame(rows, "item_id long, image array<double>, words array<double>, word string, label string, split string, ln array<double>")
    system = routed.fit(df, concepts=4, folds=2)
    got = routed.decide(df, system)
    right = got.where("split = 'test' AND label = label_pred").count()
    assert right > 40 and got.count() == 240
    system.save(str(tmp_path / "m"))
    again = routed.decide(df, routed.load(spark, str(tmp_path / "m")))
    same = [tuple(r) for r in got.select("item_id", "label_pred", "state").orderBy("item_id").collect()]
    assert same == [tuple(r) for r in again.select("item_id", "label_pred", "state").orderBy("item_id").collect()]


def test_probes_learn_without_their_rows_in_the_driver(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k % 2), 1.0, 0.5 * (k % 3)], k % 2, ("train", "val", "test")[k % 3]) for k in range(60)], "item_id long, vec array<double>, y long, split string")

    def refused(self):
        raise AssertionError("rows collected")

    monkeypatch.setattr(type(rows), "toArrow", refused)
    assert len(learners.mlp_scores({"a": rows}, 2, [1, 2])["a"]) == 2


def test_tree_histograms_repeat_no_rows():
    import tracemalloc

    from plumbline.functions import boosting

    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 9))
    y = (x[:, 0] > 0).astype(int)
    tracemalloc.start()
    model = boosting.fit_trees(x, y, 2, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # once rows and features were flattened and repeated as 8-byte numbers, several times over
    assert peak < 4 * x.nbytes
    binned = model.binned(x)
    assert binned.dtype == np.uint8 and all((binned[:, j] == np.searchsorted(model.edges[j], x[:, j])).all() for j in range(9))


def _plain_phrases(rows, k, min_df):
    """All terms counted, one class after the other."""
    counts, sizes = {}, {}
    for text, c in rows:
        sizes[c] = sizes.get(c, 0) + 1
        for g in mining.ngrams(text):
            counts.setdefault(g, {})[c] = counts.get(g, {}).get(c, 0) + 1
    out, total, a = set(), sum(sizes.values()), mining.ALPHA
    for c, n in sizes.items():
        scored = []
        for g, by in counts.items():
            if (df := sum(by.values())) >= min_df:
                own, rest = by.get(c, 0), df - by.get(c, 0)
                scored.append((-round(np.log((own + a) / (n - own + a)) - np.log((rest + a) / (total - n - rest + a)), 12), g))
        best = sorted(scored)[: 3 * k]
        out |= {(c, i + 1, g) for i, (_, g) in enumerate(sorted(best, key=lambda s: (s[0], -len(s[1].split(" ")), s[1]))[:k])}
    return out


def test_phrases_by_bounds_equal_all_phrases(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        c = "abc"[i % 3]
        # common words, words of a class, words of few texts
        words = [f"w{x}" for x in rng.zipf(1.5, 25) if x < 60] + [f"{c}{x}" for x in rng.integers(0, 6, 4)] + [f"r{x}" for x in rng.integers(0, 900, 12)]
        rows.append((" ".join(rng.permutation(words)), c))
    docs = spark.createDataFrame(rows, "text string, label string")
    spread, inner = [], mining.gram_counts

    def seen(*a, **b):
        spread.append((out := inner(*a, **b)).count())
        return out

    monkeypatch.setattr(mining, "gram_counts", seen)
    for k, how in ((2, {}), (2, {"wide": 5}), (4, {"wide": 20}), (4, {"most": 3}), (400, {})):
        got = {(r["class"], r["rank"], r["term"]) for r in mining.mine_phrases(docs, "text", "label", k, **how).collect()}
        assert got == _plain_phrases(rows, k, mining.MIN_DF)
        if k == 2:
            # once every n-gram went from task to task
            assert sum(spread) < inner(docs, "text", "label").count() / 2
        spread.clear()
    assert mining.mine_phrases(docs.limit(0), "text", "label", 2).count() == 0


def test_concept_bank_does_not_make_its_rows_for_every_step(spark):
    g = np.random.default_rng(6)
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return v

    touch = F.udf(counted, "array<double>")
    at = lambda i: (np.eye(4)[i % 3] * 5 + g.normal(size=4) * 0.05).tolist()
    phrases = spark.createDataFrame([(i, at(i), "abc"[i % 3]) for i in range(30)], "item_id long, vec array<double>, word string")
    images = spark.createDataFrame([(i, at(i)) for i in range(40)], "item_id long, vec array<double>")
    bank = learners.concept_bank(phrases.withColumn("vec", touch("vec")), images.withColumn("vec", touch("vec")), 3).collect()
    assert {(r["name"], r["n_text"]) for r in bank} == {("a", 10), ("b", 10), ("c", 10)} and sum(r["n_img"] for r in bank) == 40
    # nine times before: for means, clusters, sizes, names and both sides of the joins between them
    assert seen.value <= 3 * 70


def test_learners_see_all_rows(spark):
    import pickle

    import numpy as np

    from plumbline.functions import text

    n = 215_000
    rows = spark.range(n).select(F.col("id").alias("item_id"), F.when(F.col("id") % 10 < 8, "train").otherwise("val").alias("split"), (F.col("id") % 1000 == 1).cast("long").alias("y"), *(F.lit(1.0).alias(c) for c in text.FEATURES))
    model = learners.fit_shape(rows, 2)
    assert np.allclose(np.exp(model.start), [1 - 215 / 172_000, 215 / 172_000], rtol=1e-12)

    def ids(job, batches):
        got = np.concatenate([b.column("id").to_numpy() for b in batches])
        return pickle.dumps((job, len(got), bool((np.diff(got) > 0).all())))

    assert learners._streamed([(rows, [0, 2]), (rows.where("item_id < 5"), [1])], "item_id", [], ids) == {0: (0, n, True), 1: (1, 5, True), 2: (2, n, True)}


def test_learners_from_files_are_those_from_memory():
    import numpy as np

    from plumbline.functions import boosting

    rng = np.random.default_rng(5)
    x, held_x = rng.normal(size=(300, 6)), rng.normal(size=(90, 6))
    y, held_y = (x[:, 0] > 0).astype(int), (held_x[:, 0] > 0).astype(int)
    held, own = boosting.Stored(6), boosting.Stored(6)
    for part in np.array_split(x, 7):
        own.add(boosting.normal_rows(part))
    held.add(held_x[:0])
    held.add(held_x)
    got, want = boosting.fit_probe(own, y, held, held_y, 2, 3, epochs=4), boosting.fit_probe(x, y, held_x, held_y, 2, 3, epochs=4)
    assert all(np.array_equal(a, b) for a, b in zip(got.p, want.p, strict=True))
    assert np.array_equal(np.concatenate(list(held.pieces(40))), held_x.astype(np.float32)) and np.array_equal(held[np.array([88, 0])], held_x[[88, 0]].astype(np.float32))


def test_plans_of_the_data_tier_do_not_hold_how_embeddings_came_about(spark, monkeypatch):
    from plumbline.plans import audit

    rows = spark.createDataFrame([(k, f"text {k % 7}", ("a", "b")[k % 2], ("train", "val", "test")[k % 3]) for k in range(30)], "item_id long, text string, label string, split string")
    made = rows.select("item_id").repartition(3).withColumn("made_here", F.col("item_id") * 2.0)
    emb = made.select("item_id", F.lit("e").alias("encoder"), F.lit("text:text").alias("view"), F.lit(0).alias("enc_order"), F.array("made_here", F.lit(1.0)).alias("vec"))
    plans = []

    class Stop(Exception):
        pass

    def scores(views, k, seeds):
        plans.extend(v._jdf.queryExecution().optimizedPlan().toString() for v in views.values())
        raise Stop

    monkeypatch.setattr(audit.learners, "fit_shapes", lambda jobs: {})
    monkeypatch.setattr(audit.learners, "mlp_scores", scores)
    with pytest.raises(Stop):
        audit.run_data_tier(rows, audit.AuditSpec("label", ["text"], "split", embeddings=emb))
    assert len(plans) == 1 and "made_here" not in plans[0] and "Repartition" not in plans[0]
