"""Phrases, literals, clauses and rules mined from data, and their firing."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.tables import saved

#: Mining constants.
TOP_K, NGRAMS, MIN_DF, ALPHA = 12, (1, 3), 3, 0.5
QUANTILES, MAX_SUPPORT_FRAC = (0.50, 0.75, 0.90), 0.90
BETA, MIN_SUPPORT, MAX_LEN, MAX_CLAUSES, POOL, MAX_NEG = 0.5, 15, 3, 3, 40, 1
MIN_PREC_ABS, MIN_LIFT, PREC_CAP, CAND_CAP = 0.35, 3.0, 0.80, 2000

#: N-grams whose counts a task holds before it sends them on.
HELD_GRAMS = 400_000
#: Most frequent words of a class whose phrases are counted first, and words that are sent to tasks at most (beyond, all phrases are counted).
WIDE, MOST_WORDS = 1000, 100_000
#: English words that phrases leave out unless another list is given (see stop_words).
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down "
    "during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now "
    "of off on once only or other our out over own re same she should so some such than that the their them then there these they this those through to "
    "too under until up very was we were what when where which while who whom why will with would you your"
).split()


def stop_words(path: str) -> list[str]:
    """A longer list than STOP_WORDS, one word a line, from a file; # begins a comment."""
    with open(path) as lines:
        return [w for line in lines if (w := line.partition("#")[0].strip())]


def ngrams(text: str | None, sizes: tuple[int, int] = NGRAMS, stops: frozenset[str] = frozenset(STOP_WORDS)) -> set[str]:
    """Distinct n-grams of lower-cased words of two characters at least, stop words left out first."""
    words = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in stops]
    return {" ".join(words[i : i + n]) for n in range(sizes[0], sizes[1] + 1) for i in range(len(words) - n + 1)}


def gram_counts(docs: DataFrame, text: str, label: str, stops: list[str] = STOP_WORDS, sizes: tuple[int, int] = NGRAMS, masks: dict[str, int] | None = None) -> DataFrame:
    """term, class, c: documents of the class that have the n-gram. Counted in Arrow batches first, so that few strings are shuffled.

    masks: words and the classes (as bits) whose phrases they may be part of; n-grams without a class that all of their words share are left out.
    """
    out_of = frozenset(stops)
    held = None if masks is None else docs.sparkSession.sparkContext.broadcast(masks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        known = None if held is None else held.value

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[1] for k in counts], pa.string()), pa.array([k[0] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "class", "c"])

        for batch in batches:
            for t, kind in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                grams = ngrams(t.as_py(), sizes, out_of) if known is None else masked_ngrams(t.as_py(), known, sizes, out_of)
                counts.update((kind, g) for g in grams)
                if len(counts) > HELD_GRAMS:
                    yield out()
                    counts.clear()
        yield out()

    met = docs.select(F.col(text).alias("t"), F.col(label).cast("string").alias("k")).mapInArrow(run, "term string, class string, c long")
    return met.groupBy("term", "class").agg(F.sum("c").alias("c"))


def masked_ngrams(text: str | None, masks: dict[str, int], sizes: tuple[int, int] = NGRAMS, stops: frozenset[str] = frozenset(STOP_WORDS)) -> set[str]:
    """Those of `ngrams` whose words share a class (a bit of their masks)."""
    words = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in stops]
    own = [masks.get(w, 0) for w in words]
    found = set()
    for i, mask in enumerate(own):
        for n in range(1, min(sizes[1], len(words) - i) + 1):
            mask &= own[i + n - 1]
            if not mask:
                break
            if n >= sizes[0]:
                found.add(" ".join(words[i : i + n]))
    return found


def _scored(counts: DataFrame, sizes: DataFrame, min_df: int, alpha: float) -> DataFrame:
    """class, term, logodds of all terms of `min_df` documents at least. sizes: class, n."""
    by_term = counts.groupBy("term").agg(F.sum("c").alias("df"), F.map_from_entries(F.collect_list(F.struct("class", "c"))).alias("by")).where(F.col("df") >= min_df)
    total = sizes.agg(F.sum("n").alias("total"))
    # labels are few: a row for each
    met = by_term.join(F.broadcast(sizes.join(total))).withColumn("c", F.coalesce(F.try_element_at("by", "class"), F.lit(0)))
    rest, rest_n = F.col("df") - F.col("c"), F.col("total") - F.col("n")
    odds = F.log((F.col("c") + alpha) / (F.col("n") - F.col("c") + alpha)) - F.log((rest + alpha) / (rest_n - rest + alpha))
    return met.select("class", "term", F.round(odds, 12).alias("logodds"))


def _leading(scored: DataFrame, most: int) -> DataFrame:
    """The `most` best terms of each class, by log odds and then by term."""
    first = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("logodds"), "term"))
    return scored.withColumn("r", first).where(F.col("r") <= most)


def needed(n: int, total: int, least: float, alpha: float = ALPHA) -> int:
    """The fewest documents of a class of n (of `total`) by which a term that no other class has reaches the log odds `least`; n + 1 if none do."""
    low, high = 0, n + 1
    while low < high:
        c = (low + high) // 2
        if math.log((c + alpha) / (n - c + alpha)) - math.log(alpha / (total - n + alpha)) >= least - 1e-9:
            high = c
        else:
            low = c + 1
    return low


def mine_phrases(docs: DataFrame, text: str, label: str, k: int = TOP_K, min_df: int = MIN_DF, alpha: float = ALPHA, stops: list[str] = STOP_WORDS, wide: int = WIDE, most: int = MOST_WORDS) -> DataFrame:
    """class, rank, term, logodds: the k terms whose presence speaks most for each class, of all terms of `min_df` documents at least.

    Smoothed log odds; of the 3k best (then by term) those with more words first on ties. `class` is a string. A phrase is in no more
    documents of a class than any of its words, so the log odds it can reach are bounded by its words' counts: words are counted first, then
    the phrases of each class's `wide` most frequent words, whose 3k-th best is a limit, then those of all words by which a phrase
    can reach it. What is left out is never among the 3k best. With over `most` such words all phrases are counted.
    """
    sizes = saved(docs.groupBy(F.col(label).cast("string").alias("class")).agg(F.count("*").alias("n")))
    classes = {r["class"]: (place, r["n"]) for place, r in enumerate(sizes.orderBy("class").collect())}
    total = sum(n for _, n in classes.values())
    words = saved(gram_counts(docs, text, label, stops, (1, 1)))

    def limits(counts: DataFrame) -> dict[str, int]:
        """By class: the documents that a word of one of its 3k best phrases has at least."""
        worst = {r["class"]: r["logodds"] for r in _leading(_scored(counts, sizes, min_df, alpha), 3 * k).where(F.col("r") == 3 * k).collect()}
        return {c: max(1, needed(n, total, worst[c], alpha)) if c in worst else 0 for c, (_, n) in classes.items()}

    def masks(least: dict[str, int]) -> dict[str, int] | None:
        """The words that reach their class's count; None if there are too many, or a class has no limit."""
        if not all(least.values()):
            return None
        bars = F.create_map(*(F.lit(x) for pair in least.items() for x in pair))
        enough = words.where(F.col("c") >= F.try_element_at(bars, F.col("class")))
        rows = enough.select("term", "class").limit(most + 1).collect()
        if len(rows) > most:
            return None
        out: dict[str, int] = {}
        for r in rows:
            out[r["term"]] = out.get(r["term"], 0) | 1 << classes[r["class"]][0]
        return out

    def with_phrases(known: dict[str, int] | None) -> DataFrame:
        longer = gram_counts(docs, text, label, stops, (NGRAMS[0] + 1, NGRAMS[1]), known)
        return saved(words.unionByName(longer))

    if None in classes:
        counts = gram_counts(docs, text, label, stops)
    else:
        least = limits(words)
        # the count that each class's `wide` most frequent words have
        place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("c"), "term"))
        first = {r["class"]: r["c"] for r in words.withColumn("r", place).where(F.col("r") == wide).collect()} if all(least.values()) else {}
        start = {c: max(v, first.get(c, 0)) for c, v in least.items()}
        known = masks(start)
        counts = with_phrases(known)
        if known is not None and start != least:
            better = {c: max(v, least[c]) for c, v in limits(counts).items()}
            # counted already where no class needs less than it had
            if any(better[c] < start[c] for c in start):
                counts = with_phrases(masks({c: min(better[c], start[c]) for c in start}))
    best = _leading(_scored(counts, sizes, min_df, alpha), 3 * k)
    last = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("logodds"), F.desc(F.size(F.split("term", " "))), "term"))
    return best.withColumn("rank", last.cast("long")).where(F.col("rank") <= k).select("class", "rank", "term", "logodds")


def document_frequency(docs: DataFrame, tokens: Column, top: int) -> DataFrame:
    """rank, token, df: the most frequent tokens by documents, then by token."""
    counted = docs.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    best = counted.orderBy(F.desc("df"), "token").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("df"), "token")).cast("long"))


def cuts(scores: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """feature, cut: distinct exact quantiles (interpolated). scores: item_id, feature, value."""
    q = F.percentile("value", F.array(*map(F.lit, quantiles)))
    return scores.groupBy("feature").agg(F.array_distinct(q).alias("q")).select("feature", F.explode("q").alias("cut"))


def literals(scores: DataFrame, calib: DataFrame, max_support: float = MAX_SUPPORT_FRAC) -> DataFrame:
    """lit_id, feature, cut, negated, support: literals value > cut and their negations that are not nearly always true.

    Ids run over features and cuts in order, negations after all positives.
    """
    part = scores.join(calib.select("item_id"), "item_id", "left_semi")
    limits = cuts(part)
    total = calib.agg(F.count("*").alias("total"))
    held = part.join(F.broadcast(limits), "feature").groupBy("feature", "cut").agg(F.sum((F.col("value") > F.col("cut")).cast("long")).alias("t"))
    both = held.join(total).select("feature", "cut", F.explode(F.array(F.struct(F.lit(False).alias("negated"), F.col("t").alias("support")), F.struct(F.lit(True).alias("negated"), (F.col("total") - F.col("t")).alias("support")))).alias("s"), "total").select("feature", "cut", "s.*", "total")
    kept = both.where(F.col("support") <= max_support * F.col("total"))
    ids = F.row_number().over(Window.orderBy("negated", "feature", "cut")) - 1
    return kept.withColumn("lit_id", ids.cast("long")).select("lit_id", "feature", "cut", "negated", "support")


def true_literals(scores: DataFrame, lits: DataFrame) -> DataFrame:
    """item_id, lit_id of every literal that holds."""
    holds = F.col("value") > F.col("cut")
    return scores.join(F.broadcast(lits), "feature").where(holds != F.col("negated")).select("item_id", "lit_id")


def f_beta(tp: Column, fired: Column, n_pos: Column, beta: float = BETA) -> Column:
    """F-beta with the zero guards of counts."""
    p, r, b2 = tp / F.greatest(fired, F.lit(1)), tp / F.greatest(n_pos, F.lit(1)), beta * beta
    return (1 + b2) * p * r / F.greatest(b2 * p + r, F.lit(1e-9))


#: More than the places of a pool: the base in which conjunctions are numbered.
PLACES = 1024


def _conjunctions(batches: Iterator[pa.RecordBatch], held: dict, max_len: int) -> Iterator[pa.RecordBatch]:
    """target, code, fired, tp: conjunctions of one to `max_len` pool literals of different features that rows of the batch have."""
    for batch in batches:
        rows = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("has").offsets.to_numpy()))
        has, kinds = batch.column("has").flatten().to_numpy(), np.array(batch.column("class").to_pylist(), object)
        for target, pool in held.items():
            lits, names = np.array([x for x, _ in pool]), [f for _, f in pool]
            order = np.argsort(lits)
            at = np.minimum(np.searchsorted(lits[order], has), len(lits) - 1)
            hit = lits[order][at] == has
            m = np.zeros((batch.num_rows, len(pool)))
            m[rows[hit], order[at[hit]]] = 1
            own = m * (kinds == target)[:, None]
            apart = np.triu(np.array([[a != b for b in names] for a in names]), 1)
            found = [(np.arange(len(pool)) + 1, m.sum(axis=0), own.sum(axis=0))]
            if max_len > 1:
                i, j = np.nonzero(apart)
                found.append(((i + 1) * PLACES + j + 1, (m.T @ m)[i, j], (own.T @ m)[i, j]))
            for i in range(len(pool) if max_len > 2 else 0):
                j, k = np.nonzero(apart & apart[i][:, None] & apart[i][None, :])
                if len(j):
                    both = m * m[:, i : i + 1]
                    found.append((((i + 1) * PLACES + j + 1) * PLACES + k + 1, (m.T @ both)[j, k], (own.T @ both)[j, k]))
            code, fired, tp = (np.concatenate([f[c] for f in found]).astype(np.int64) for c in range(3))
            some = fired > 0
            yield pa.RecordBatch.from_arrays([pa.array([target] * int(some.sum())), pa.array(code[some]), pa.array(fired[some]), pa.array(tp[some])], names=["target", "code", "fired", "tp"])


def clauses(fires: DataFrame, lits: DataFrame, labels: DataFrame, max_len: int = MAX_LEN, pool: int = POOL, min_support: int = MIN_SUPPORT, cap: int = CAND_CAP) -> DataFrame:
    """class, lits (ids in pool order), path (places in the pool), tp, fired, precision, recall, fbeta: candidate conjunctions.

    fires: item_id, lit_id over the calibration rows; labels: item_id, class. Each class has a pool of its literals
    of highest F-beta (higher id first on ties). Rows become 0/1 matrices over a pool, whose products count all pairs
    and triples of a batch at once; batches send on their counts, of which a pool has a bounded number.
    """
    if not 1 <= max_len <= 3:
        raise ValueError("clauses have one to three literals")
    sizes = labels.groupBy("class").agg(F.count("*").alias("n_pos"))
    total = labels.agg(F.count("*").alias("total"))
    class_of = sizes.join(total)
    classes = sizes.select(F.col("class").alias("target"))
    seen = fires.join(labels, "item_id")
    per = seen.groupBy("lit_id", "class").agg(F.count("*").alias("c"))
    fired = per.groupBy("lit_id").agg(F.sum("c").alias("fired")).where(F.col("fired") >= min_support)
    singles = fired.join(classes).join(per.withColumnRenamed("class", "target"), ["lit_id", "target"], "left").select("target", "lit_id", "fired", F.coalesce("c", F.lit(0)).alias("tp")).join(F.broadcast(class_of.withColumnRenamed("class", "target")), "target")
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc(F.round("fb", 12)), F.desc("lit_id")))
    pooled = saved(singles.withColumn("fb", f_beta(F.col("tp"), F.col("fired"), F.col("n_pos"))).withColumn("pos", rank - 1).where(F.col("pos") < pool).join(F.broadcast(lits.select("lit_id", "feature", "negated")), "lit_id"))
    held: dict = {}
    for r in pooled.select("target", "pos", "lit_id", "feature").orderBy("target", "pos").collect():
        held.setdefault(r["target"], []).append((r["lit_id"], r["feature"]))
    sets = seen.join(F.broadcast(pooled.select("lit_id").distinct()), "lit_id", "left_semi").groupBy("item_id", "class").agg(F.collect_set("lit_id").alias("has"))
    counted = sets.select("class", "has").mapInArrow(lambda batches: _conjunctions(batches, held, max_len), T.StructType([T.StructField("target", labels.schema["class"].dataType), *(T.StructField(c, T.LongType()) for c in ("code", "fired", "tp"))]))
    counts = counted.groupBy("target", "code").agg(F.sum("fired").alias("fired"), F.sum("tp").alias("tp")).where(F.col("fired") >= min_support)
    # a code holds the places plus one, as digits
    digit = lambda k: F.floor(F.col("code") / (PLACES**k)) % PLACES
    path = F.filter(F.array(*(digit(k).cast("int") - 1 for k in (2, 1, 0))), lambda x: x >= 0)
    by_place = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    dims = pooled.groupBy("target").agg(by_place("lit_id").alias("_l"), by_place("negated").alias("_n"))
    placed = counts.withColumn("path", path).join(F.broadcast(dims), "target")
    pick = lambda c: F.transform("path", lambda x: F.get(F.col(c), x))
    out = placed.select("target", pick("_l").alias("lits"), "path", F.size(F.filter(pick("_n"), lambda x: x)).alias("neg"), "tp", "fired")
    floor = F.greatest(F.lit(MIN_PREC_ABS), F.least(MIN_LIFT * F.col("n_pos") / F.col("total"), F.lit(PREC_CAP)))
    scored = out.join(F.broadcast(class_of.withColumnRenamed("class", "target")), "target").withColumns({"precision": F.col("tp") / F.col("fired"), "recall": F.col("tp") / F.col("n_pos"), "fbeta": f_beta(F.col("tp"), F.col("fired"), F.col("n_pos"))})
    good = scored.where((F.col("neg") <= MAX_NEG) & (F.col("neg") < F.size("lits")) & (F.col("precision") >= floor))
    order = F.row_number().over(Window.partitionBy("target").orderBy(F.desc(F.round("fbeta", 12)), "path"))
    return good.withColumn("rank", order).where(F.col("rank") <= cap).select(F.col("target").alias("class"), "lits", "path", "tp", "fired", "precision", "recall", "fbeta", F.col("rank").cast("long").alias("rank"))


def greedy_dnf(cands: DataFrame, fires: DataFrame, labels: DataFrame, max_clauses: int = MAX_CLAUSES) -> DataFrame:
    """class, clause_id, lits, precision, recall, support, dnf_fbeta: clauses added while they raise the union's F-beta (first of equals).

    Each round is one aggregate over the rows that no chosen clause covers.
    """
    cands = saved(cands)
    sizes = labels.groupBy("class").agg(F.count("*").alias("n_pos"))
    used = cands.select(F.explode("lits").alias("lit_id")).distinct()
    rows = saved(fires.join(used, "lit_id", "left_semi").groupBy("item_id").agg(F.collect_set("lit_id").alias("has")).join(labels, "item_id"))
    heads = cands.select(F.col("class").alias("target"), "rank", "lits", F.get("lits", F.lit(0)).alias("lit_id"))
    hits = saved(rows.withColumn("lit_id", F.explode("has")).join(heads, "lit_id").where(F.forall("lits", lambda x: F.array_contains("has", x))).select("item_id", "target", "rank", (F.col("class") == F.col("target")).cast("long").alias("pos")))
    state = sizes.select(F.col("class").alias("target"), "n_pos", F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fired"), F.lit(-1.0).alias("best"))
    left, chosen = hits, None
    for step in range(max_clauses):
        gains = left.groupBy("target", "rank").agg(F.sum("pos").alias("dtp"), F.count("*").alias("dfired"))
        every = cands.select(F.col("class").alias("target"), "rank").join(gains, ["target", "rank"], "left").na.fill(0).join(state, "target")
        union = every.withColumn("fb", f_beta(F.col("tp") + F.col("dtp"), F.col("fired") + F.col("dfired"), F.col("n_pos"))).where(F.round("fb", 12) > F.round("best", 12))
        pick = union.groupBy("target").agg(F.max_by(F.struct("rank", "dtp", "dfired", "fb"), F.struct(F.round("fb", 12), -F.col("rank"))).alias("p")).select("target", "p.*")
        pick = saved(pick)
        if pick.isEmpty():
            break
        row = pick.select("target", "rank", F.lit(step).cast("long").alias("clause_id"), F.col("fb").alias("dnf_fbeta"))
        chosen = row if chosen is None else chosen.unionByName(row)
        state = saved(state.join(pick.select("target", "dtp", "dfired", "fb"), "target", "left").select("target", "n_pos", (F.col("tp") + F.coalesce("dtp", F.lit(0))).alias("tp"), (F.col("fired") + F.coalesce("dfired", F.lit(0))).alias("fired"), F.when(F.col("fb").isNull(), F.lit(2.0)).otherwise(F.col("fb")).alias("best")))
        covered = left.join(pick.select("target", "rank"), ["target", "rank"], "left_semi").select("target", "item_id")
        left = saved(left.join(covered, ["target", "item_id"], "left_anti"))
    if chosen is None:
        chosen = cands.select(F.col("class").alias("target"), "rank", F.lit(0).cast("long").alias("clause_id"), F.lit(0.0).alias("dnf_fbeta")).limit(0)
    full = chosen.join(cands.withColumnRenamed("class", "target"), ["target", "rank"])
    return full.select(F.col("target").alias("class"), "clause_id", "lits", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.col("fired").alias("support"), "dnf_fbeta")


def fire(fires: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, class, fired, trigger (the best fired clause's precision, 0 if none), n_clauses, for every item and class with rules.

    Rules are a model's few clauses: they are broadcast when the planner's size estimate allows.
    """
    used = rules.select(F.explode("lits").alias("lit_id")).distinct()
    has = fires.join(used, "lit_id", "left_semi").groupBy("item_id").agg(F.collect_set("lit_id").alias("has"))
    clauses_ = rules.groupBy("class").agg(F.collect_list(F.struct("lits", "precision")).alias("rules"))
    every = items.select("item_id").join(has, "item_id", "left").join(F.broadcast(clauses_))
    none = F.array().cast("array<bigint>")
    hit = F.filter("rules", lambda r: F.forall(r["lits"], lambda x: F.array_contains(F.coalesce("has", none), x)))
    return every.select("item_id", "class", hit.alias("hit")).select("item_id", "class", (F.size("hit") > 0).alias("fired"), F.coalesce(F.array_max(F.transform("hit", lambda r: r["precision"])), F.lit(0.0)).alias("trigger"), F.size("hit").cast("long").alias("n_clauses"))


def rule_prediction(fired: DataFrame, default: str | None = None) -> DataFrame:
    """item_id, pred, conf: the fired class of highest trigger (the first on ties); the default without any."""
    best = F.max_by(F.struct("class", "trigger"), F.struct("trigger", F.col("order")))
    ordered = fired.withColumn("order", -F.dense_rank().over(Window.partitionBy("item_id").orderBy("class")))
    got = ordered.where("fired").groupBy("item_id").agg(best.alias("b"))
    return fired.select("item_id").distinct().join(got, "item_id", "left").select("item_id", F.coalesce("b.class", F.lit(default)).alias("pred"), F.coalesce("b.trigger", F.lit(0.0)).alias("conf"))


def rule_precision(fired: DataFrame, labels: DataFrame) -> DataFrame:
    """class, tp, fired, precision = tp / max(fired, 1) of whole rule sets."""
    joined = fired.withColumnRenamed("class", "target").join(labels, "item_id")
    hit = F.col("fired").cast("long")
    got = joined.groupBy(F.col("target").alias("class")).agg(F.sum(hit * (F.col("class") == F.col("target")).cast("long")).alias("tp"), F.sum(hit).alias("fired"))
    return got.withColumn("precision", F.col("tp") / F.greatest("fired", F.lit(1)))


def hand_rules(rows: DataFrame, classes: list[str], thresholds: dict[str, float]) -> DataFrame:
    """Hand-written rules per class: subject and context and (image or text stereotype); adds <class>_fired, <class>_trigger, pred, conf, any.

    rows: item_id, subject, and <class>_context, <class>_stereotype, <class>_text per class. Confidence is the larger of the two cues;
    the best fired class wins, the first on ties; pred is -1 without any.
    """
    over = lambda c, kind: F.col(c) > thresholds[kind]
    out = rows
    for c in classes:
        cue = over(f"{c}_stereotype", "stereotype") | over(f"{c}_text", "text")
        fired = over("subject", "subject") & over(f"{c}_context", "context") & cue
        out = out.withColumns({f"{c}_fired": fired, f"{c}_trigger": F.when(fired, F.greatest(f"{c}_stereotype", f"{c}_text")).otherwise(0.0)})
    best = F.array_max(F.array(*(F.struct(F.col(f"{c}_fired").alias("f"), F.col(f"{c}_trigger").alias("t"), F.lit(-i).alias("i")) for i, c in enumerate(classes))))
    return out.withColumn("_b", best).withColumns({"any": F.col("_b.f"), "pred": F.when(F.col("_b.f"), -F.col("_b.i")).otherwise(-1).cast("long"), "conf": F.when(F.col("_b.f"), F.col("_b.t")).otherwise(0.0)}).drop("_b")
