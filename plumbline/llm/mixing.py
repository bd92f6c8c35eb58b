"""Temperature mixing of sources, in DataFrame operations only.

A source with share s of all tokens gets weight s**a / sum(s**a). The exponent a
between 0 (even) and 1 (as found) is found by bisection: the largest whose
entropy reaches a target, or, if that repeats some source too often, the
smallest that keeps within the repetition limit. Five steps of the bisection
are read off one aggregate over the sources, so neither driver nor any task
holds them all.

The weights are realised within a budget of tokens. A budget that is given needs
a repetition limit too: no source is seen more often, and what sources at the
limit leave goes to the others in their weights (a level found by bisection over
aggregates); a budget beyond what the limit allows is an error. Without a budget
nothing is lost: it is the least at which every source is seen whole at least
once. A source is gone through in epochs; each
epoch is a permutation of its documents by hash, and the last is cut where the
source's token budget ends. The permuted documents, laid along [0, 1) by tokens
within their source, are cut into blocks of which each has all sources in
their weights. `mix` writes a block's documents in the permutation's order, in
pieces by the order's first digits. Places along a source are prefix sums in two levels, of about
the square root of its documents each, so a source with a third of all rows
meets in no one task.

Rows equal in source and id move together as one unit; a null source or id is a
value of its own. Documents of no words, or null text, have no tokens: they
come once, at their place in the first epoch (a source without tokens has
weight 0 and comes once too). Very long texts are counted whole and are one unit;
ties in the order go by id. An empty table gives an empty result. Other columns
stay, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, saved

BLOCKS = 64
SEED = "mix"
#: Bisection steps for each aggregate, and aggregates.
STEPS, ROUNDS = 5, 9
#: Pieces of the mix for a shuffle partition, at least, when it is written.
PIECES = 64
#: Epochs of a source, at most: a mix without a repetition limit that needs more is an error.
MOST_EPOCHS = 10_000


def tokens_of(text: Column) -> Column:
    """Words, parted by space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, entropy: float | None, repetition: float | None) -> float:
    """The exponent for a table with a `tokens` column, one row per source.

    entropy: the target, as a share of the logarithm of the number of sources with tokens.
    repetition: the most epochs of any source when the largest (by weight against tokens) is seen once.
    """
    live = sources.where("tokens > 0")
    head = live.agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.max("tokens").alias("hi"), F.min("tokens").alias("lo")).first()
    if not head["n"] or head["hi"] == head["lo"]:
        return 1.0
    a = 1.0 if repetition is None else 0.0
    if entropy is not None:
        goal, lo, hi = entropy * math.log(head["n"]), 0.0, 1.0
        share = F.col("tokens") / float(head["t"])
        for _ in range(ROUNDS):
            width = (hi - lo) / 2**STEPS
            points = [lo + width * k for k in range(1, 2**STEPS + 1)]
            sums = [c for k, x in enumerate(points) for w in [F.pow(share, F.lit(x))] for c in (F.sum(w).alias(f"z{k}"), F.sum(w * x * F.log(share)).alias(f"l{k}"))]
            row = live.agg(*sums).first()
            # entropy falls as the exponent rises
            ok = [math.log(row[f"z{k}"]) - row[f"l{k}"] / row[f"z{k}"] >= goal - 1e-12 for k in range(len(points))]
            if ok[-1]:
                lo = hi = points[-1]
                break
            k = ok.index(False)
            lo, hi = points[k] - width, points[k]
        a = lo
    if repetition is not None:
        # the most epochs are (largest / smallest) ** (1 - a), whose monotone bisection needs no further pass
        ratio, lo, hi = math.log(head["hi"] / head["lo"]), a, 1.0
        if ratio * (1 - a) > math.log(repetition):
            for _ in range(STEPS * ROUNDS):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if ratio * (1 - mid) <= math.log(repetition) else (mid, hi)
            a = hi
    return round(a, 9)


def weights(docs: DataFrame, source: str = "source", text: str = "text", entropy: float | None = None, repetition: float | None = None, budget: int | None = None, passes: float | None = None) -> DataFrame:
    """One row per source: source, docs, tokens, weight, and epochs (how often the budget of tokens goes through it)."""
    counted = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("docs"), F.sum(tokens_of(F.col(text))).alias("tokens"))
    return _weights(saved(counted), entropy, repetition, budget, passes)


def _weights(sources: DataFrame, entropy: float | None, repetition: float | None, budget: int | None = None, passes: float | None = None) -> DataFrame:
    a = exponent(sources, entropy, repetition)
    head = sources.agg(F.max("tokens").alias("hi"), F.sum("tokens").alias("t")).first()
    hi, total = head["hi"] or 1, head["t"] or 0
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / float(hi), F.lit(a))).otherwise(0.0)
    if budget is None and passes is None:
        # n**(a - 1) is the weight against tokens; it is least for the largest source, which is seen once
        z = sources.agg(F.sum(power).alias("z")).first()["z"] or 1.0
        made = sources.withColumn("weight", power / z)
        seen = F.pow(float(hi) / F.col("tokens"), F.lit(1.0 - a))
    else:
        goal = float(budget if budget is not None else passes * total)
        if repetition is None:
            raise ValueError("a budget needs a repetition limit")
        if goal > repetition * total * (1 + 1e-12):
            raise ValueError(f"a budget of {goal:.0f} tokens repeats {total} tokens more than {repetition} times")
        capped = F.least(F.lit(_level(sources, power, repetition, goal)) * power, repetition * F.col("tokens"))
        made = sources.withColumn("weight", F.when(F.lit(goal > 0), capped / F.lit(goal or 1.0)).otherwise(0.0))
        seen = capped / F.col("tokens")
    made = made.withColumn("epochs", F.round(F.when(F.col("tokens") > 0, seen).otherwise(1.0), 6))
    if (made.agg(F.max("epochs").alias("e")).first()["e"] or 0) > MOST_EPOCHS:
        raise ValueError(f"a source would come more than {MOST_EPOCHS} times; give a repetition limit")
    return made


def _level(sources: DataFrame, power: Column, repetition: float, goal: float) -> float:
    """The least level, to 45 halvings of the highest one, at which sum(min(level * power, repetition * tokens)) reaches the goal."""
    most = repetition * F.col("tokens")
    live = sources.where("tokens > 0")
    top = live.agg(F.max(most / power).alias("x")).first()["x"] or 0.0
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        width = (hi - lo) / 2**STEPS
        points = [lo + width * k for k in range(1, 2**STEPS)]
        row = live.agg(*(F.sum(F.least(F.lit(top * x) * power, most)).alias(f"s{k}") for k, x in enumerate(points))).first()
        k = next((k for k in range(len(points)) if (row[f"s{k}"] or 0.0) >= goal * (1 - 1e-12)), len(points))
        lo, hi = lo + width * k, lo + width * (k + 1)
    return top * hi


def schedule(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", entropy: float | None = None, repetition: float | None = None, blocks: int = BLOCKS, seed: str = SEED, budget: int | None = None, passes: float | None = None) -> DataFrame:
    """One row for each unit and epoch: source, id, tokens, epoch, block, and `order` to sort by within a block.

    budget: tokens in all, which may leave out documents or repeat them; or passes, the budget as a multiple of all tokens. By default
    every document comes at least once.
    """
    units = docs.groupBy(F.col(source).alias("source"), F.col(key).alias("id")).agg(F.sum(tokens_of(F.col(text))).alias("tokens"))
    units = saved(units)
    sources = units.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    plan = _weights(saved(sources), entropy, repetition, budget, passes).select(F.col("source").alias("_s"), F.col("docs").alias("_docs"), F.col("tokens").alias("_tokens"), "weight", "epochs")
    joined = units.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    every = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("epochs").cast("int"), F.lit(1)) - 1)))
    digest = F.md5(F.concat_ws("|", F.lit(seed), name("source"), F.col("epoch").cast("string"), name("id")))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    rooms = F.ceil(F.sqrt("_docs")).cast("long")
    placed = every.select("source", "id", "tokens", "epoch", "epochs", "weight", "_tokens", digest.alias("order"), F.floor(place * rooms / F.lit(float(1 << 32))).cast("long").alias("_room"))
    # tokens before each room of an epoch, then before each unit of a room
    by_room = placed.groupBy("source", "epoch", "_room").agg(F.sum("tokens").alias("_sum"))
    ahead = by_room.withColumn("_ahead", F.sum("_sum").over(Window.partitionBy("source", "epoch").orderBy("_room")) - F.col("_sum")).drop("_sum").select(F.col("source").alias("_s2"), F.col("epoch").alias("_e2"), F.col("_room").alias("_r2"), "_ahead")
    within = Window.partitionBy("source", "epoch", "_room").orderBy("order", "id")
    laid = placed.withColumn("_before", F.sum("tokens").over(within) - F.col("tokens"))
    laid = laid.join(ahead, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("epoch") == F.col("_e2")) & (F.col("_room") == F.col("_r2")))
    start = F.col("_ahead") + F.col("_before") + F.col("epoch") * F.col("_tokens")
    end = F.col("epochs") * F.col("_tokens")
    once = (F.col("epoch") == 0) & (F.lit(budget is None and passes is None) | (F.col("tokens") == 0))
    laid = laid.withColumn("_start", start).where(once | (F.col("tokens") > 0) & (F.col("_start") < end))
    block = F.when(end > 0, F.least(F.floor(F.col("_start") * blocks / end), F.lit(blocks - 1))).otherwise(0).cast("int")
    return laid.select("source", "id", "tokens", F.col("epoch").cast("int").alias("epoch"), block.alias("block"), "order", "weight")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The rows of `docs`, each as often as the schedule has it, block by block in the permutation's order; columns stay as they are.

    A block is dealt to tasks by the first digits of the order, as many as make PIECES pieces or more for a shuffle partition, so
    a task holds whole pieces of the permutation, sorted.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = next(d for d in range(1, 33) if how.get("blocks", BLOCKS) * 16**d >= PIECES * partitions)
    s, i, b, o = (fresh(name, docs) for name in ("_s", "_i", "_b", "_o"))
    times = schedule(docs, key, source, text, **how).select(F.col("source").alias(s), F.col("id").alias(i), F.col("block").alias(b), F.concat(F.col("order"), F.col("epoch").cast("string")).alias(o))
    joined = docs.join(times, docs[key].eqNullSafe(times[i]) & docs[source].eqNullSafe(times[s]))
    return joined.repartition(F.col(b), F.substring(o, 1, digits)).sortWithinPartitions(b, o).select(*docs.columns)


def sql(entropy: float, repetition: float, passes: float, blocks: int = BLOCKS, seed: str = SEED) -> str:
    """The schedule of `documents` in DuckDB: doc_id, source, tokens, epoch, block, place (to sort by in a block), weight (6 places)."""
    return f"""
WITH RECURSIVE unit AS (
  SELECT source, doc_id, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS tokens FROM documents GROUP BY 1, 2),
src AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS n FROM unit GROUP BY 1),
head AS (SELECT list(n::DOUBLE ORDER BY n) FILTER (WHERE n > 0) AS ns, max(n)::DOUBLE AS hi, min(n) FILTER (WHERE n > 0)::DOUBLE AS lo, sum(n)::DOUBLE AS t FROM src),
bis(k, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN m ELSE lo END, CASE WHEN ok THEN hi ELSE m END FROM (
    SELECT k, b.lo, b.hi, m, ln(z) - l / z >= {entropy} * ln(len(ns)) - 1e-12 AS ok FROM (
      SELECT bis.*, ns, (bis.lo + bis.hi) / 2 AS m, list_sum(list_transform(ns, lambda x: pow(x / t, (bis.lo + bis.hi) / 2))) AS z,
        list_sum(list_transform(ns, lambda x: pow(x / t, (bis.lo + bis.hi) / 2) * (bis.lo + bis.hi) / 2 * ln(x / t))) AS l FROM bis, head WHERE k < {STEPS * ROUNDS}) b)),
ent AS (SELECT CASE WHEN -list_sum(list_transform(ns, lambda x: x / t * ln(x / t))) >= {entropy} * ln(len(ns)) - 1e-12 THEN 1.0 ELSE (SELECT lo FROM bis ORDER BY k DESC LIMIT 1) END AS a FROM head),
pick AS (SELECT CASE WHEN head.hi = head.lo THEN 1.0 ELSE round(greatest(a, 1 - ln({repetition}) / ln(head.hi / head.lo)), 9) END AS a, head.hi AS top FROM ent, head),
live AS (SELECT list(n::DOUBLE ORDER BY n) AS ns, list(pow(n / top, a) ORDER BY n) AS ps, sum(n)::DOUBLE * {passes} AS goal, max({repetition} * n / pow(n / top, a)) AS far FROM src, pick WHERE n > 0),
lev(k, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN lo ELSE m END, CASE WHEN ok THEN m ELSE hi END FROM (
    SELECT lev.*, (lev.lo + lev.hi) / 2 AS m, list_sum(list_transform(range(1, len(ns) + 1), lambda i: least(far * ((lev.lo + lev.hi) / 2) * ps[i], {repetition} * ns[i]))) >= goal * (1 - 1e-12) AS ok FROM lev, live WHERE k < {STEPS * ROUNDS})),
lvl AS (SELECT far * (SELECT hi FROM lev ORDER BY k DESC LIMIT 1) AS level, goal FROM live),
plan AS (
  SELECT source, n, CASE WHEN n > 0 THEN least(level * pow(n / top, a), {repetition} * n) / goal ELSE 0 END AS weight,
    CASE WHEN n > 0 THEN round(least(level * pow(n / top, a), {repetition} * n) / n, 6) ELSE 1 END AS epochs FROM src, pick, lvl),
every AS (
  SELECT u.*, p.n, p.weight, p.epochs, unnest(range(greatest(CAST(ceil(p.epochs) AS BIGINT), 1))) AS epoch FROM unit u JOIN plan p ON u.source IS NOT DISTINCT FROM p.source),
drawn AS (SELECT *, md5('{seed}|' || coalesce(source, chr(0)) || '|' || epoch || '|' || coalesce(doc_id::VARCHAR, chr(0))) AS digest FROM every),
laid AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source, epoch ORDER BY digest, doc_id) - tokens + epoch * n AS start FROM drawn)
SELECT doc_id, source, tokens, CAST(epoch AS INTEGER) AS epoch, digest AS place,
  CAST(CASE WHEN epochs * n > 0 THEN least(floor(start * {blocks} / (epochs * n)), {blocks} - 1) ELSE 0 END AS INTEGER) AS block, round(weight, 6) AS weight
FROM laid WHERE epoch = 0 AND tokens = 0 OR tokens > 0 AND start < epochs * n
"""
