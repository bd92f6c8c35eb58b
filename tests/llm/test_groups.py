"""Line dedup, near duplicates, mixing, top-k and the pipeline, against SQL or brute force."""

import heapq
import sys
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from compare import assert_same, connect  # noqa: E402

import corpus_pipeline
from plumbline.llm import jaccard, line_dedup, mixing, queries, topk


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name])


def docs(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


def test_repeated_lines(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\n a \nb\nc\nd\ny"), (3, "b\nc"), (4, "z\nz\nz\nz\nz"), (5, None), (6, ""), (7, "\n\n\n\n"), (8, "\n\n\n"), (None, "q\nr\ns"), (9, "q\nr\ns"), (1, "a\nb\nc\nd")]
    df = docs(spark, [(*r, 1, "k", 2) for r in rows], ", n_lines int, _p string, _gone int")
    got = {(r["doc_id"], r["text"]): r["n_removed"] for r in line_dedup.dedup(df, report=True).collect()}
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup(df).collect() if r["text"] is not None)
    assert (2, "x\ny") in kept and (3, "b\nc") in kept and (4, "z") in kept and (7, "\n\n\n\n") in kept
    assert kept.count((1, "a\nb\nc\nd")) == 2 and (0, "q\nr\ns") in kept and (9, "") in kept
    assert got[(9, "")] == 3 and line_dedup.dedup(df).columns == df.columns
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_hot_windows(spark):
    hot = "one\ntwo\nthree"
    rows = [(i, f"{hot}\nown {i}\nmore {i}") for i in range(3000)]
    got = line_dedup.dedup(docs(spark, rows), report=True)
    assert got.where("n_removed = 3").count() == 2999 and got.where("doc_id = 0").first()["n_removed"] == 0


def test_many_lines_take_time_in_proportion(spark):
    """Two equal documents of 80,000 lines, and a document that repeats itself."""
    text = "\n".join(f"line {i}" for i in range(80_000))
    rows = [(1, text), (2, text), (3, "\n".join(["a", "b", "c"] * 20_000))]
    line_dedup.dedup(docs(spark, rows[:1])).count()
    began = time.time()
    got = {r["doc_id"]: r for r in line_dedup.dedup(docs(spark, rows).withColumns({"N_LINES": F.lit(0), "_LINES": F.lit(0), "Text_": F.lit(0)}), report=True).collect()}
    assert time.time() - began < 20
    assert got[1]["n_removed"] == 0 and got[1]["text"] == text and got[2]["text"] == "" and got[2]["n_removed"] == 80_000
    assert got[3]["text"] == "a\nb\nc" and got[3]["n_lines"] == 60_000 and got[3]["_LINES"] == 0


def test_repeated_rows_against_sql(spark, tmp_path):
    """Rows that repeat, share an id, or have none: the SQL holds for them too."""
    hot = "one\ntwo\nthree"
    rows = [(1, f"{hot}\nx"), (1, f"{hot}\nx"), (1, f"y\n{hot}"), (None, hot), (None, f"z\n{hot}\n"), (4, None), (4, None), (5, ""), (6, "\n\n\n"), (7, f" one\ntwo \nthree\n{hot}")]
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}), f"{tmp_path}/documents.parquet")
    assert_same(queries.op5_line_dedup(spark, str(tmp_path)), connect(tmp_path), queries.ORACLES["op5_line_dedup"])


def shingles(text, k=4):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, least=85):
    sets, at = [shingles(t) for _, t in rows], defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            at[x].add(i)
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j, c in Counter(j for x in s for j in at[x] if j > i).items():
            if 100 * c >= least * (len(s) + len(sets[j]) - c):
                up[find(j)] = find(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def planted(seed=4, families=6, size=40, words=150):
    rng = np.random.default_rng(seed)
    common = " ".join(f"boiler{j}" for j in range(25))
    rows = []
    for f in range(families):
        base = [f"w{f}x{j}" for j in range(words)]
        for c in range(size):
            text = list(base)
            for _ in range(rng.integers(0, 4)):
                text[rng.integers(0, words)] = f"new{rng.integers(0, 9999)}"
            rows.append(" ".join(text) + (" " + common if c % 3 == 0 else ""))
    rows += [f"{common} single {i} of {i * 7} kind {i * 3} more {i * 5} yet {i * 11}" for i in range(120)]
    rows += ["", "a b", "a b", "A  B", "a b c d", "a b c d e", "x" * 30_000, "same " * 5000]
    order = rng.permutation(len(rows))
    return [(int(i), rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("budget", [jaccard.BUDGET, 5_000])
def test_components_of_near_copies(spark, budget):
    rows = planted()
    got = sorted(tuple(r) for r in jaccard.near_duplicates(docs(spark, rows).repartition(5), budget=budget).collect())
    assert got == brute_components(rows)


def test_weak_chains_in_blocks(spark):
    """Each document links to its neighbour only, so no pivot sees a family; blocks must still find all links."""
    rows = [(i, " ".join(f"t{j}" for j in range(i * 4, i * 4 + 120))) for i in range(80)]
    got = sorted(tuple(r) for r in jaccard.near_duplicates(docs(spark, rows), budget=1500).collect())
    assert got == brute_components(rows) and {r[2] for r in got} == {0}


def test_a_hot_group_is_dealt_to_blocks(spark, monkeypatch):
    """Most rows in one group of near copies of many sizes: blocks stay small, and components are those of brute force."""
    monkeypatch.setattr(jaccard, "LEAST_BLOCK", 300)
    rng = np.random.default_rng(12)
    base = [f"b{j}" for j in range(120)]
    rows = []
    for i in range(300):
        text = list(base) + [f"e{j}" for j in range(rng.integers(0, 60))]
        for _ in range(rng.integers(0, 6)):
            text[rng.integers(0, len(text))] = f"n{rng.integers(0, 50)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:30])]
    most = []
    kept = jaccard._search
    monkeypatch.setattr(jaccard, "_search", lambda groups, keys, least: (most.append(groups.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0), kept(groups, keys, least))[1])
    got = sorted(tuple(r) for r in jaccard.near_duplicates(docs(spark, rows).repartition(6)).collect())
    assert got == brute_components(rows) and max(most) < 120


def test_the_longest_lists_fit_their_bitmap(spark, monkeypatch):
    counted = spark.createDataFrame([(i, 9 + i % 60) for i in range(200)], "shingle long, count long")
    for bits, want in ((8, range(64, 69)), (6, ()), (10, range(64, 69)), (12, range(9, 69))):  # 15 lists of 64 and more, 96 of 32 to 63
        monkeypatch.setattr(jaccard, "BITMAP_BITS", bits)
        assert {r["count"] for r in jaccard.longest(counted).collect()} == set(want)
    assert jaccard.longest(counted.limit(0)).count() == 0


def test_divide_skip_is_exact():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 60)).astype(np.uint64)) for _ in range(120)]
    sets += [np.unique(np.concatenate([s[2:], rng.integers(0, 400, 2).astype(np.uint64)])) for s in sets[:60]]
    index = jaccard.Index(sets)
    for q in sets:
        want = [i for i, s in enumerate(sets) if 100 * (c := len(np.intersect1d(q, s))) >= 85 * (len(q) + len(s) - c)]
        assert sorted(index.overlapping(q, 85).tolist()) == want


def test_short_lists_count_as_a_heap_merge_of_them_would():
    """The counts that stand for the heap of cursors: of the same lists, member by member."""
    rng = np.random.default_rng(18)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 40)).astype(np.uint64)) for _ in range(80)]
    index = jaccard.Index(sets)
    for q in sets:
        begin, end = index.lists(q)
        merged = Counter(heapq.merge(*(index.members[a:b].tolist() for a, b in zip(begin, end, strict=True))))
        assert merged == {k: c for k, c in enumerate(index.merged(begin, end).tolist()) if c}


def test_near_duplicate_edges(spark):
    df = docs(spark, [(None, "a b c d e", 1), (3, "a b c d e", 1), (3, "a b c d e", 1), (4, None, 1), (5, " ", 1), (None, None, 1)], ", _gone int")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect())
    assert got == [(-1, 0, None), (-1, 2, 3), (3, 2, 3), (3, 2, 3), (4, 0, 4), (5, 0, 5)]
    assert jaccard.keep_first(df).columns == df.columns and jaccard.keep_first(df).count() == 6
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
    kept = jaccard.keep_first(docs(spark, [(2, "a b c d e"), (1, "a b c d e"), (9, "q r s t u")])).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 9]


def test_mixing(spark):
    rows = [(i, "w " * (5 + i % 7), "big" if i < 600 else f"s{i % 4}") for i in range(700)] + [(800, None, None), (801, "", "empty"), (802, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"epoch": F.lit("mine"), "_times": F.lit(1)})
    plan = mixing.schedule(df, repetition=2.0, blocks=10)
    assert plan.where("epoch = 0").count() == 703
    w = {r["source"]: r for r in mixing.weights(df, repetition=2.0).collect()}
    assert max(r["epochs"] for r in w.values()) == pytest.approx(2.0, abs=1e-4) and w["big"]["epochs"] == 1
    assert sum(r["weight"] for r in w.values()) == pytest.approx(1)
    tokens = {r["source"]: r["t"] for r in plan.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    assert tokens["s1"] == pytest.approx(w["s1"]["epochs"] * w["s1"]["tokens"], abs=15)
    blocks = plan.where("source = 'big'").groupBy("block").agg(F.sum("tokens").alias("t")).collect()
    assert len(blocks) == 10 and max(r["t"] for r in blocks) - min(r["t"] for r in blocks) < 40
    mixed = mixing.mix(df, repetition=2.0)
    assert mixed.columns == df.columns and mixed.count() == plan.count()
    assert mixing.mix(df.limit(0), repetition=2.0).count() == 0
    lean = mixing.schedule(df, repetition=2.0, budget=1500)
    spent = {r["source"]: r["t"] for r in lean.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    assert 1500 <= sum(spent.values()) <= 1500 + 6 * 12 and spent["big"] == pytest.approx(1500 * w["big"]["weight"], abs=12)
    assert lean.where("tokens = 0").count() == 2  # rows without tokens come once
    files = mixing.mix(df, repetition=2.0, blocks=3).withColumn("_p", F.spark_partition_id()).collect()
    at = {(r["source"], r["id"]): [] for r in plan.collect()}
    for place, r in enumerate(files):
        at[r["source"], r["doc_id"]].append((r["_p"], place))
    three = {(r["source"], r["id"], r["epoch"]): (r["block"], r["order"] + str(r["epoch"])) for r in mixing.schedule(df, repetition=2.0, blocks=3).collect()}
    by_task = defaultdict(list)
    for (s, i, e), (b, o) in three.items():
        if len(at[s, i]) == 1:
            by_task[at[s, i][0][0]].append((at[s, i][0][1], b, o))
    assert by_task and all([x[1:] for x in sorted(v)] == sorted(x[1:] for x in v) for v in by_task.values())  # each task's rows lie in the permutation's order
    even = mixing.weights(df.where("source LIKE 's%' OR source = 'big'"), entropy=0.999).collect()
    assert -sum(r["weight"] * np.log(r["weight"]) for r in even) >= 0.999 * np.log(5) - 1e-6
    assert mixing.exponent(mixing.weights(df), None, None) == 1.0


def plainly_filled(tokens, power, repetition, goal):
    """Epochs by handing what capped sources leave to the others, one by one."""
    capped = set()
    while True:
        left = goal - sum(repetition * tokens[s] for s in capped)
        z = sum(power[s] for s in tokens if s not in capped)
        over = {s for s in tokens if s not in capped and left * power[s] / z > repetition * tokens[s] * (1 + 1e-9)}
        if not over:
            return {s: repetition if s in capped else left * power[s] / z / tokens[s] for s in tokens}
        capped |= over


@pytest.mark.parametrize(("budget", "entropy"), [(300, 0.98), (1500, 0.98), (2500, 0.9), (2999, 1.0), (3060, 0.98)])
def test_a_budget_keeps_the_repetition_limit(spark, budget, entropy):
    tokens = {"big": 850, "mid": 100, "small": 50, "tiny": 20}
    df = docs(spark, [(k * 1000 + i, "w " * 5, s) for k, (s, t) in enumerate(tokens.items()) for i in range(t // 5)], ", source string")
    a = mixing.exponent(mixing.weights(df), entropy, 3.0)
    want = plainly_filled(tokens, {s: (t / 850) ** a for s, t in tokens.items()}, 3.0, budget)
    found = {r["source"]: r for r in mixing.weights(df, entropy=entropy, repetition=3.0, budget=budget).collect()}
    for s in tokens:
        assert found[s]["epochs"] == pytest.approx(want[s], abs=2e-6) and found[s]["weight"] == pytest.approx(want[s] * tokens[s] / budget, abs=1e-6)
    plan = mixing.schedule(df, entropy=entropy, repetition=3.0, budget=budget)
    spent = {r["source"]: (r["t"], r["e"]) for r in plan.groupBy("source").agg(F.sum("tokens").alias("t"), F.max("epoch").alias("e")).collect()}
    assert all(t <= 3 * tokens[s] and e < 3 and abs(t - want[s] * tokens[s]) <= 5 for s, (t, e) in spent.items())


def test_budgets_that_cannot_be_met(spark):
    df = docs(spark, [(1, "a " * 1000, "x"), (2, "b " * 20, "y")], ", source string")
    for how in ({"budget": 20_000, "repetition": 3.0}, {"budget": 500}, {"passes": 3.1, "repetition": 3.0}):
        with pytest.raises(ValueError):
            mixing.schedule(df, entropy=0.98, **how)
    huge = docs(spark, [(i, "a " * 5000, "x") for i in range(200)] + [(999, "b", "y")], ", source string")
    with pytest.raises(ValueError):
        mixing.schedule(huge, entropy=1.0)
    empty = docs(spark, [(1, "", "x"), (2, None, "y"), (3, " ", None)], ", source string")
    for how in ({}, {"passes": 2.0}, {"budget": 0}):
        assert mixing.schedule(empty, entropy=0.98, repetition=3.0, **how).where("tokens = 0 and epoch = 0 and weight = 0").count() == 3
    assert mixing.schedule(empty.limit(0), repetition=3.0, passes=2.0).count() == 0


def brute_top(ids, x, asked, k):
    out = []
    for j in asked:
        s = sorted(((-int(x[i] @ x[j]), ids[i]) for i in range(len(ids)) if ids[i] != ids[j]))[:k]
        out += [(ids[j], r + 1, i, -v) for r, (v, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("sparse", [False, True])
def test_top_k(spark, monkeypatch, sparse):
    monkeypatch.setattr(topk, "ROWS", 100)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 16)) * (rng.random((400, 16)) < (0.2 if sparse else 1))
    v[5] = v[6] = v[7]
    rows = [(i, [float(a) for a in r]) for i, r in enumerate(v)]
    bad = [(1000, None), (1001, [float("nan")] * 16), (1002, [None] * 16), (1003, []), (None, rows[0][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 20 = 0"), k=9).collect())
    assert got == brute_top(range(400), np.floor(64 * v).astype(int), range(0, 400, 20), 9)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert topk.top_k(few, few, k=20).count() == 6


def test_pruned_search_is_exact():
    rng = np.random.default_rng(6)
    # few large components and many small ones, where the proof stops early
    x = np.where(rng.random((800, 24)) < 0.1, rng.integers(-900, 900, (800, 24)), rng.integers(-2, 3, (800, 24)))
    ids = np.arange(800)
    j, got, score = topk.search(ids, topk.Segments(x), ids[:40], x[:40], 5)
    assert sorted(zip(ids[:40][j].tolist(), got.tolist(), score.tolist(), strict=True)) == sorted((a, c, d) for a, _, c, d in brute_top(ids.tolist(), x, range(40), 5))


def test_postings_are_skipped():
    """Sparse vectors: a query meets the postings of its own dimensions only, and no more than a proof needs."""
    rng = np.random.default_rng(7)
    x = np.where(rng.random((2000, 400)) < 0.01, rng.integers(-60, 60, (2000, 400)), 0)
    index, ids = topk.Segments(x), np.arange(2000)
    asked = list(range(0, 2000, 50))
    j, got, score = topk.search(ids, index, ids[asked], x[asked], 10)
    assert sorted(zip(ids[asked][j].tolist(), got.tolist(), score.tolist(), strict=True)) == sorted((a, c, d) for a, _, c, d in brute_top(ids.tolist(), x, asked, 10))
    meeting = sum(int((x[:, np.flatnonzero(x[a])] != 0).sum()) for a in asked)
    assert index.walked <= meeting < np.count_nonzero(x) * len(asked) / 20
    # one great component decides: the proof stops before small ones are walked
    y = np.where(rng.random((2000, 40)) < 0.02, 1, 0)
    y[:, 0] = rng.permutation(2000) * 50
    index = topk.Segments(y)
    topk.search(ids, index, ids[:5], y[:5], 3)
    assert index.walked < 5 * np.count_nonzero(y) / 4


def test_top_k_of_repeated_ids_and_clashing_names(spark):
    rows = [(20, [1.0, 0.0], 1), (20, [0.0, 1.0], 1), (20, [0.0, 1.0], 2), (1, [1.0, 0.5], 1), (2, [0.5, 1.0], 1), (3, [0.0, 0.0], 1), (4, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").withColumns({"ID": F.lit(0), "x": F.lit(0), "block": F.lit(0), "rank": F.lit(0), "Query": F.lit(0)})
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id = 20"), k=2).collect())
    assert got == [(20, 1, 1, 4096), (20, 1, 2, 4096), (20, 2, 1, 2048), (20, 2, 2, 2048)]


def test_pipeline(spark, sf, monkeypatch):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard_join", "source_mixing", "bpe"]
    start = spark.read.parquet(f"{sf}/documents.parquet")
    frames = [start]
    for _, stage in corpus_pipeline.STAGES[:4]:
        frames.append(stage(spark, frames[-1], sf).persist())
        assert frames[-1].columns == start.columns
    scored = queries.op4_toxicity(spark, sf)
    assert {r[0] for r in frames[1].select("doc_id").collect()} == {r[0] for r in scored.where("predicted = 0").select("doc_id").collect()}
    assert frames[2].count() == frames[1].count()
    rows = sorted((r["doc_id"], r["text"]) for r in frames[2].select("doc_id", "text").collect())
    monkeypatch.setitem(globals(), "shingles", lambda text, of=shingles: of(text, corpus_pipeline.WORDS))
    keep = {d for d, n, c in brute_components(rows, corpus_pipeline.LEAST) if n == 0 or d == c}
    assert {r[0] for r in frames[3].select("doc_id").collect()} == keep
    assert {r[0] for r in frames[4].select("doc_id").distinct().collect()} == keep
    final = corpus_pipeline.run(spark, sf)
    assert Counter(r[0] for r in final.select("doc_id").collect()) == Counter(r[0] for r in frames[4].select("doc_id").collect())
    texts = {r["doc_id"]: r["text"] for r in frames[4].collect()}
    import hashlib

    assert all(r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() for r in final.collect())


PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(tmp_path, rows, labels):
    """documents (with columns of clashing names) and labels as files."""
    extra = {c: pa.array([k for k in range(len(rows))], pa.int64()) for c in ("n_Shingles", "_Gone", "SCORE", "n_tokens", "epoch", "_lines", "known")}
    columns = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] for r in rows], pa.string())}
    pq.write_table(pa.table(columns | extra), f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in labels], pa.int64()), "quality": pa.array([1] * len(labels), pa.int64()), "toxic": pa.array([r[1] for r in labels], pa.int64())}), f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pipeline_edges(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing names; then an empty table."""
    long = "x" * 20_000 + " " + "word " * 20_000
    rows = [(1, "a b c d e f g h", "s"), (1, "a b c d e f g h", "s"), (2, "a b c d e f g h", "t"), (3, None, None), (4, "", "s"), (None, "q r s t u v", "s"), (None, None, None), (5, long, "s"), (5, "other words of five here", "t"), (6, "l1\nl2\nl3\nm", "s"), (7, "l1\nl2\nl3\nn", None)]
    folder = corpus(tmp_path, rows, [(1, 0), (2, None), (None, 1), (4, 1)])
    start = spark.read.parquet(f"{folder}/documents.parquet")
    frames = [start]
    for _, stage in corpus_pipeline.STAGES[:4]:
        frames.append(stage(spark, frames[-1], folder).persist())
        assert frames[-1].columns == start.columns
    assert frames[1].count() == frames[2].count() == len(rows)
    assert {r["doc_id"]: r["text"] for r in frames[2].collect()}[7] == "n"
    # 2 is a copy of 1, whose two rows stay; rows without id or words stay
    assert Counter(r["doc_id"] for r in frames[3].collect()) == Counter({1: 2, 3: 1, 4: 1, None: 2, 5: 2, 6: 1, 7: 1})
    assert {(r["doc_id"], r["text"]) for r in frames[4].collect()} == {(r["doc_id"], r["text"]) for r in frames[3].collect()}
    final = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in final.collect()} == {1, 3, 4, None, 5, 6, 7}
    assert final.where("doc_id IN (3, 4) AND n_tokens <> 0").count() == 0 and final.where("doc_id = 5").agg(F.max("n_tokens")).first()[0] > 20_000


def test_pipeline_of_an_empty_table(spark, tmp_path):
    folder = corpus(tmp_path, [], [])
    out = corpus_pipeline.run(spark, folder)
    assert out.count() == 0 and "decoded_sha256" in out.columns
    start = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, start, folder).columns == start.columns and stage(spark, start, folder).count() == 0


def test_pipeline_drops_near_copies_at_five_words_and_80(spark, sf, monkeypatch):
    base = [f"w{j}" for j in range(60)]
    rows = [(0, " ".join(base)), (1, " ".join(base + [f"more{j}" for j in range(12)])), (2, " ".join(base + [f"much{j}" for j in range(20)]))]
    one = [f"v{j}" for j in range(50)]
    rows += [(3, " ".join(one)), (4, " ".join([*one[:25], "other", *one[26:]])), (5, " ".join([*one[:12], "a", *one[13:37], "b", *one[38:]])), (6, ""), (7, "")]
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"]
    assert sorted(r["doc_id"] for r in stage(spark, docs(spark, rows), sf).collect()) == [0, 2, 3, 5, 6, 7]
    rows = planted() + [(1000 + d, t) for d, t in rows]
    got = sorted(r["doc_id"] for r in stage(spark, docs(spark, rows), sf).collect())
    monkeypatch.setitem(globals(), "shingles", lambda text, of=shingles: of(text, 5))
    assert got == sorted(d for d, n, c in brute_components(rows, 80) if n == 0 or d == c)


def test_long_sets_with_few_shingles_in_common_are_no_candidates(spark):
    own = lambda node, first, n: [(x, node, n) for x in range(first, first + 330)]
    # two sets of 2,000 with 5 posted shingles in common, and two with 200
    rows = own(1, 0, 2000) + own(2, 325, 2000) + own(3, 10_000, 2000) + own(4, 10_130, 2000)
    posted = spark.createDataFrame(rows, "shingle long, node long, n int")
    assert [tuple(r) for r in jaccard.candidates(posted, 85).collect()] == [(3, 4)]


def test_sets_are_sent_smaller_than_their_hashes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeinorst"), 5)) for _ in range(400)]
    rows = []
    for i in range(20):
        text = list(rng.choice(words, 600))
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text[:-1], "É"]))]
    sent, kept = [], jaccard._search

    def search(groups, keys, least):
        held = groups.withColumn("bytes", sum(F.length(c) for c, kind in groups.dtypes if kind == "binary"))
        sent.append(held.agg(F.sum("bytes"), F.sum("n")).first())
        return kept(groups, keys, least)

    monkeypatch.setattr(jaccard, "_search", search)
    got = sorted(tuple(r) for r in jaccard.near_duplicates(docs(spark, rows)).collect())
    assert got == brute_components(rows) and sent[0][1] > 20_000 and sent[0][0] < 4 * sent[0][1]


def test_packed_sets_come_back():
    texts = pa.array(["", " ", "one", "One  two\tthree", "a b c d e f a b c d", "É è " * 300, "x" * 5000])
    want = [s.tolist() for _, s in jaccard.sets_of(texts)]
    sent = pa.array([jaccard.packed(t, jaccard.K) for t in texts], pa.binary())
    assert [s.tolist() for s in jaccard.unpacked(sent)] == want


def test_shuffles_of_the_join_are_deleted(spark):
    where = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = lambda: where.shuffleStatuses().size()
    rows = planted()
    jaccard.linked(docs(spark, rows), "text", jaccard.K, jaccard.LEAST)
    before, most = held(), time.time() + 20
    jaccard.linked(docs(spark, rows), "text", jaccard.K, jaccard.LEAST)
    while held() > before + 8 and time.time() < most:
        time.sleep(0.2)
    assert held() <= before + 8


def test_stages_of_the_pipeline_leave_no_shuffles(spark, monkeypatch, tmp_path):
    docs(spark, [(i, f"text {i}") for i in range(50)]).write.parquet(str(tmp_path / "documents.parquet"))
    where = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    seen = []

    def stage(spark, frame, sf_dir):
        most = time.time() + 10
        while seen and where.shuffleStatuses().size() > seen[0] and time.time() < most:
            time.sleep(0.2)
        seen.append(where.shuffleStatuses().size())
        for k in range(5, 8):
            frame = frame.repartition(k, "text")
            frame.count()
        return frame.groupBy("doc_id").agg(F.max("text").alias("text"))

    jaccard.swept(spark)
    time.sleep(2)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"s{k}", stage) for k in range(4)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 50
    assert max(seen) <= seen[0]
