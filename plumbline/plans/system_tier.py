"""Queries of the system tier: S1 to S6 and resampling intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import rng, vectors
from plumbline.operators import resampling, system
from plumbline.plans.fixtures import CLASSES, EMBEDDED_SQL, LABELLED_SQL, PRED_SQL, embedded, labelled, predictions
from plumbline.plans.registry import ORACLES, query, rounded

H = rng.draw_sql
#: Resamples in the queries and their SQL.
REPS = resampling.B


def _draws(columns: str, unit: str = "item_id", where: str = "true") -> str:
    """w: b, item_id and how often its unit is drawn; units lie by the hash of their patterns' counts, `columns` say which."""
    return f"""un AS (SELECT item_id, {unit} AS unit, concat_ws('|', {columns}) AS k FROM pred WHERE {where}),
  uc AS (SELECT unit, k || 'x' || count(*) AS k FROM un GROUP BY un.unit, un.k), uh AS (SELECT unit, md5(string_agg(k, ';' ORDER BY k)) AS h FROM uc GROUP BY 1),
  pl AS (SELECT unit, row_number() OVER (ORDER BY h, unit) - 1 AS place, count(*) OVER () AS n FROM uh), nn AS (SELECT count(*) AS n FROM uh),
  dr AS (SELECT b, {rng.places_sql("'43'", 'b', 'i', 'n')} AS place, count(*) AS w FROM nn, (SELECT unnest(range({REPS})) AS b), (SELECT unnest(range((SELECT n FROM nn))) AS i) GROUP BY 1, 2),
  w AS (SELECT b, m.item_id, dr.w FROM dr JOIN pl USING (place) JOIN (SELECT DISTINCT item_id, unit FROM un) m USING (unit))"""


_DRAWS = _draws("1, seed, y, pa, pb")
_C = f"cls AS (SELECT unnest(range({CLASSES})) AS class)"


def _f1(side: str, weight: str, source: str, by: str) -> str:
    """Macro-F1 and accuracy of one side per group."""
    one = f"""SELECT {by}, class, sum(CASE WHEN y = class AND {side} = class THEN {weight} ELSE 0 END) AS tp, sum(CASE WHEN y = class THEN {weight} ELSE 0 END) + sum(CASE WHEN {side} = class THEN {weight} ELSE 0 END) AS d FROM {source}, cls GROUP BY {by}, class"""
    return f"SELECT {by}, avg(CASE WHEN d > 0 THEN 2 * tp / d ELSE 0.0 END) AS f FROM ({one}) GROUP BY {by}"


def _paired_sql(draws: str) -> str:
    return f"""WITH {PRED_SQL}, {draws}, {_C},
  j AS (SELECT w.b, pred.seed, y, pa, pb, w.w FROM pred JOIN w USING (item_id)),
  fa AS ({_f1('pa', 'w', 'j', 'b, seed')}), fb AS ({_f1('pb', 'w', 'j', 'b, seed')}),
  ac AS (SELECT b, seed, sum(CASE WHEN pa = y THEN w ELSE 0 END) / sum(w) - sum(CASE WHEN pb = y THEN w ELSE 0 END) / sum(w) AS d FROM j GROUP BY 1, 2),
  bt AS (SELECT fa.b, avg(fa.f - fb.f) AS df, (SELECT avg(d) FROM ac WHERE ac.b = fa.b) AS da FROM fa JOIN fb USING (b, seed) GROUP BY 1),
  pa_ AS ({_f1('pa', '1', 'pred', 'seed')}), pb_ AS ({_f1('pb', '1', 'pred', 'seed')})
  SELECT 'd_macro_f1' AS metric, (SELECT round(avg(pa_.f - pb_.f), 6) FROM pa_ JOIN pb_ USING (seed)) AS mean, round(quantile_cont(df, 0.025), 6) AS lo, round(quantile_cont(df, 0.975), 6) AS hi FROM bt
  UNION ALL SELECT 'd_acc', (SELECT round(avg(CAST(pa = y AS DOUBLE)) - avg(CAST(pb = y AS DOUBLE)), 6) FROM pred), round(quantile_cont(da, 0.025), 6), round(quantile_cont(da, 0.975), 6) FROM bt"""


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    p = predictions(spark, sf_dir)
    pos = resampling.positions(p)
    return p.join(pos, "item_id"), p.select("item_id").distinct().count()


@query(_paired_sql(_DRAWS))
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = _placed(spark, sf_dir)
    return rounded(resampling.paired_interval(p, n, CLASSES, b=REPS))


@query(_paired_sql(_draws("1, seed, y, pa, pb", "item_id // 10")))
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = _placed(spark, sf_dir)
    groups = p.select(F.floor(F.col("item_id") / 10).alias("group"), "pos").distinct()
    place = resampling.group_positions(groups)
    drawn = p.join(place, "pos").drop("pos").withColumnRenamed("place", "pos")
    return rounded(resampling.paired_interval(drawn, groups.select("group").distinct().count(), CLASSES, b=REPS))


@query(
    f"""WITH {PRED_SQL}, {_draws("1, y, pa", where="seed = 0")}, {_C}, j AS (SELECT w.b, y, pa, 1 AS maj, w.w FROM pred JOIN w USING (item_id) WHERE seed = 0), one AS (SELECT 0 AS b, y, pa, 1 AS maj FROM pred WHERE seed = 0),
  fa AS ({_f1('pa', 'w', 'j', 'b')}), fm AS ({_f1('maj', 'w', 'j', 'b')}), oa AS ({_f1('pa', '1', 'one', 'b')}), om AS ({_f1('maj', '1', 'one', 'b')})
  SELECT 'lift' AS metric, (SELECT round(oa.f - om.f, 6) FROM oa, om) AS mean, round(quantile_cont(fa.f - fm.f, 0.025), 6) AS lo, round(quantile_cont(fa.f - fm.f, 0.975), 6) AS hi FROM fa JOIN fm USING (b)
  UNION ALL SELECT 'share', (SELECT round(f / 0.8, 6) FROM oa), round(quantile_cont(f / 0.8, 0.025), 6), round(quantile_cont(f / 0.8, 0.975), 6) FROM fa"""
)
def bootstrap_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = _placed(spark, sf_dir)
    one = p.where("seed = 0").select("pos", "y", F.col("pa").alias("pred"))
    return rounded(resampling.lift_interval(one, n, CLASSES, majority=1, text_ref=0.8, b=REPS))


@query(
    f"""WITH {PRED_SQL}, {_draws("seed, y, pa")}, {_C}, j AS (SELECT w.b, seed, y, pa, w.w FROM pred JOIN w USING (item_id)),
  c AS (SELECT b, seed, class, sum(CASE WHEN y = class AND pa = class THEN w ELSE 0 END) AS tp, sum(CASE WHEN y = class THEN w ELSE 0 END) + sum(CASE WHEN pa = class THEN w ELSE 0 END) AS d FROM j, cls GROUP BY ALL),
  f AS (SELECT b, class, avg(CASE WHEN d > 0 THEN 2 * tp / d ELSE 0.0 END) AS f FROM c GROUP BY 1, 2),
  o AS (SELECT seed, class, sum(CAST(y = class AND pa = class AS INT)) AS tp, sum(CAST(y = class AS INT)) + sum(CAST(pa = class AS INT)) AS d FROM pred, cls GROUP BY ALL)
  SELECT class, (SELECT round(avg(CASE WHEN d > 0 THEN 2 * tp / d ELSE 0.0 END), 6) FROM o WHERE o.class = f.class) AS mean, round(quantile_cont(f, 0.025), 6) AS lo, round(quantile_cont(f, 0.975), 6) AS hi FROM f GROUP BY 1"""
)
def perclass_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = _placed(spark, sf_dir)
    return rounded(resampling.class_intervals(p.select("pos", "seed", "y", F.col("pa").alias("pred")), n, CLASSES, b=REPS))


@query(
    f"""SELECT CASE WHEN lo > 0 THEN 'caption' ELSE '' END AS gains, CASE WHEN lo > 0 THEN 'caption' ELSE '' END AS gain_partly_from_inputs, round(greatest(mean, 0), 6) AS swing,
    CASE WHEN lo > 0 THEN 'FLAG' ELSE 'ok' END AS verdict, CASE WHEN lo > 0 THEN 'FLAG' ELSE 'ok' END AS verdict_no_gain_survives FROM ({ORACLES['paired_bootstrap']}) p WHERE metric = 'd_macro_f1'"""
)
def s2_same_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins and swings of two input configurations from predictions, down to the verdict."""
    p, n = _placed(spark, sf_dir)
    equal = p.withColumn("pa", F.col("pb")).withColumn("config", F.lit("equal"))
    rich = p.withColumn("config", F.lit("caption"))
    margin = resampling.paired_interval(rich.unionByName(equal), n, CLASSES, ["config"], REPS).where("metric = 'd_macro_f1'").select("config", F.col("mean").alias("margin"), F.col("lo").alias("margin_lo"))
    swing = resampling.paired_interval(rich, n, CLASSES, ["config"], REPS).where("metric = 'd_macro_f1'").select("config", F.col("lo").alias("swing_lo"))
    out = system.s2_verdict(margin.join(swing, "config", "left"), "equal")
    return rounded(out.withColumns({c: F.array_join(c, ",") for c in ("gains", "gain_partly_from_inputs")}))


_S3 = f"""{PRED_SQL}, e AS (SELECT item_id, sum(CAST(pb <> y AS INT)) >= 3 AS err FROM pred GROUP BY 1), a AS (
  SELECT item_id, 'system' AS alternative, sum(CAST(pa = y AS INT)) >= 3 AS ok FROM pred GROUP BY 1 UNION ALL SELECT item_id, 'even', sum(CAST((CASE WHEN item_id % 2 = 0 THEN y ELSE pb END) = y AS INT)) >= 3 FROM pred GROUP BY 1)"""


def _s3(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = predictions(spark, sf_dir)
    even = F.when(F.col("item_id") % 2 == 0, F.col("y")).otherwise(F.col("pb"))
    alt = F.explode(F.array(F.struct(F.lit("system").alias("alternative"), F.col("pa").alias("pred")), F.struct(F.lit("even").alias("alternative"), even.alias("pred")))).alias("s")
    return p.select("item_id", "seed", "y", F.col("pb").alias("pred")), p.select("item_id", "seed", "y", alt).select("item_id", "seed", "y", "s.*")


@query(
    f"""WITH {_S3}, f AS (SELECT item_id, bool_or(ok) AS fixed FROM a GROUP BY 1), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE err) AS s, count(*) FILTER (WHERE err AND fixed) AS x FROM e JOIN f USING (item_id))
  SELECT n, s AS stable_errors, x AS fixed, s - x AS residual, round((s - x) / n, 6) AS residual_share, CAST(3 AS BIGINT) AS stable_threshold, CASE WHEN (s - x) / n < 0.02 THEN 'FLAG' ELSE 'note' END AS verdict FROM t"""
)
def s3_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(system.s3_headroom(*_s3(spark, sf_dir)))


@query(f"WITH {_S3} SELECT alternative, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS fixed FROM a JOIN e USING (item_id) WHERE err GROUP BY 1")
def s3_fixed_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return system.s3_fixed_by(*_s3(spark, sf_dir), 3)


@query(
    f"""WITH {PRED_SQL} SELECT round(avg(CAST(pa <> pb AS DOUBLE)), 6) AS changed, count(*) FILTER (WHERE pa <> pb) AS n_changed, count(*) FILTER (WHERE pa <> pb AND pa = y) AS fixes,
  count(*) FILTER (WHERE pa <> pb AND pb = y) AS breaks, CASE WHEN avg(CAST(pa <> pb AS DOUBLE)) < 0.02 THEN 'FLAG' ELSE 'ok' END AS verdict FROM pred WHERE seed = 0"""
)
def s4_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).where("seed = 0").select("y", F.col("pa").alias("pred_full"), F.col("pb").alias("pred_without"))
    return rounded(system.s4_influence(rows))


#: A fixed linear model over all dimensions, for three classes.
J = 64
_W = [[round(((c * 7 + j * 3) % 11 - 5) / 5, 2) for j in range(J)] for c in range(3)]
_BIAS = [0.01, 0.0, -0.01]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embedded(spark, sf_dir).select("item_id", F.col("vec").alias("z"))
    scores = F.array(*(F.round(vectors.dot(F.col("z"), F.array(*map(F.lit, row))) + b, 9) for row, b in zip(_W, _BIAS, strict=True)))
    best = F.array_position(scores, F.array_max(scores)).cast("int")
    weights = F.array(*(F.array(*map(F.lit, row)) for row in _W))
    return e.withColumn("contrib", F.zip_with("z", F.element_at(weights, best), lambda x, w: x * w))


def _label_sql(z: str) -> str:
    scores = "[" + ", ".join(f"round(list_dot_product({z}, {row}::DOUBLE[]) + {b}, 9)" for row, b in zip(_W, _BIAS, strict=True)) + "]"
    return f"list_position({scores}, list_max({scores}))"


def _mask_sql(places: str, keep: bool, k: int) -> str:
    hit = f"list_contains({places}[1:{k}], i)"
    return f"list_transform(range(0, {J}), lambda i: CASE WHEN {hit if keep else 'NOT ' + hit} THEN z[i + 1] ELSE 0.0 END)"


def _s5_sql() -> str:
    rows = []
    for k in (1, 3, 5):
        top, rand = (lambda keep, p, k=k: _label_sql(f"({_mask_sql(p, keep, k)})") for _ in range(2))
        rows.append(
            f"""SELECT CAST({k} AS BIGINT) AS k, (SELECT round(avg(CAST({top(False, 'ord')} <> lab AS DOUBLE)), 6) FROM t) AS delete_top, (SELECT round(avg(CAST({rand(False, 'rnd')} <> lab AS DOUBLE)), 6) FROM r) AS delete_random,
  (SELECT round(avg(CAST({top(True, 'ord')} = lab AS DOUBLE)), 6) FROM t) AS keep_top, (SELECT round(avg(CAST({rand(True, 'rnd')} = lab AS DOUBLE)), 6) FROM r) AS keep_random"""
        )
    w = str(_W)
    return f"""WITH {EMBEDDED_SQL}, z AS (SELECT item_id, vec AS z FROM embedded), l AS (SELECT *, {_label_sql('z')} AS lab FROM z),
  t AS (SELECT *, list_transform(list_sort(list_transform(range(0, {J}), lambda i: {{'c': -z[i + 1] * (({w}::DOUBLE[][])[lab])[i + 1], 'i': i}})), lambda s: s.i) AS ord FROM l),
  d AS (SELECT t.*, {H('42', 'rep', 'item_id')} AS h FROM t, (SELECT unnest(range(20)) AS rep)),
  x AS (SELECT *, list_transform(range(0, {J}), lambda j: (h + j * j * 40503 + j * 69621) % {system.PRIME}) AS x FROM d),
  r AS (SELECT *, list_transform(list_sort(list_transform(range(0, {J}), lambda j: {{'d': x[j + 1] * x[j + 1] % {system.PRIME} * x[j + 1] % {system.PRIME}, 'j': j}})), lambda s: s.j) AS rnd FROM x)
  {' UNION ALL '.join(rows)}"""


@query(_s5_sql())
def s5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(system.s5_faithfulness(_scored(spark, sf_dir), _W, _BIAS))


_QUOTED = "'split'"


@query(
    f"""WITH {LABELLED_SQL}, pool AS (SELECT item_id, y FROM labelled WHERE split <> 'test'), s AS (SELECT unnest(range(1, 6)) AS seed),
  r AS (SELECT seed, item_id, row_number() OVER (PARTITION BY seed, y ORDER BY {H('seed', _QUOTED, 'item_id')}, item_id) AS rn, count(*) OVER (PARTITION BY seed, y) AS n FROM pool, s)
  SELECT seed, CASE WHEN rn <= round(n * (1 - 0.15 - 0.15)::DOUBLE) THEN 'train' WHEN rn <= round(n * (1 - 0.15)::DOUBLE) THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM r GROUP BY ALL"""
)
def s6_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = labelled(spark, sf_dir).where("split <> 'test'").select("item_id", "y")
    return rng.partitions(pool, "y", "item_id").groupBy(F.col("seed").cast("long").alias("seed"), "split").agg(F.count("*").alias("n"))
