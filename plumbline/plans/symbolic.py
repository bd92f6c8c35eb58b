"""Queries of mining, rules, pooling, evidence, review and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import metrics, text, vectors
from plumbline.operators import mining, pooling, review
from plumbline.plans.fixtures import EMBEDDED_SQL, LABELLED_SQL, embedded, labelled
from plumbline.plans.registry import query, rounded
from plumbline.sources.manifest import table

#: A fixed concept bank, scorecard and rules over the first eight dimensions, for four classes (label modulo 4).
J, K = 32, 4
_NAMES = [f'concept:"c{j}"' for j in range(J)]
_COEF = [[round(((c * 5 + j * 7) % 13 - 6) / 4, 2) for j in range(J)] for c in range(K)]
_CARD = pooling.Scorecard(_NAMES, [0.01 * j for j in range(J)], [0.1 + 0.01 * j for j in range(J)], _COEF, [0.05 * c for c in range(K)])
_PREC = [0.5, 0.6, 0.7, 0.8]
_LN_COEF = [[round(((c * 3 + j * 11) % 7 - 3) / 2, 2) for j in range(J)] for c in range(K)]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, y, split, s (scores), z, ln (another expert's log probabilities), fired, trigger."""
    e = embedded(spark, sf_dir).select("item_id", (F.col("y") % K).alias("y"), "split", F.slice("vec", 1, J).alias("s"), F.slice("vec", J + 1, J).alias("v"))
    ln = vectors.log_softmax(F.array(*(vectors.dot(F.col("v"), F.array(*map(F.lit, w))) * 6.0 for w in _LN_COEF)))
    fired = F.array(*(F.get("s", F.lit(c)) > 0.05 for c in range(K)))
    d = e.withColumns({"z": _CARD.standardised(F.col("s")), "ln": ln, "fired": fired})
    return d.withColumn("trigger", F.zip_with("fired", F.array(*map(F.lit, _PREC)), lambda f, p: F.when(f, p).otherwise(0.0)))


def _dot_sql(x: str, w: list[float]) -> str:
    return "(" + " + ".join(f"{x}[{j + 1}] * ({v}::DOUBLE)" for j, v in enumerate(w)) + ")"


def _lsm_sql(a: str) -> str:
    return f"list_transform({a}, lambda x: x - list_max({a}) - ln(list_sum(list_transform({a}, lambda t: exp(t - list_max({a}))))))"


def _top_sql(a: str) -> str:
    """Places (from 0) by value, the higher place first on ties."""
    return f"list_transform(list_reverse_sort(list_transform(range(0, len({a})), lambda i: {{'x': {a}[i + 1], 'i': i}})), lambda t: t['i'])"


_BASE = f"""{EMBEDDED_SQL}, b0 AS (SELECT item_id, y % {K} AS y, split, vec[1:{J}] AS s, vec[{J + 1}:{2 * J}] AS v FROM embedded),
b1 AS (SELECT *, [{', '.join(f'(s[{j + 1}] - {m}) / {d}' for j, (m, d) in enumerate(zip(_CARD.mu, _CARD.sd, strict=True)))}] AS z,
  [{', '.join(_dot_sql('v', w) + ' * 6.0' for w in _LN_COEF)}] AS nl, [{', '.join(f's[{c + 1}] > 0.05' for c in range(K))}] AS fired FROM b0),
b2 AS (SELECT *, {_lsm_sql('nl')} AS ln, [{', '.join(_dot_sql('z', w) + f' + {b}::DOUBLE' for w, b in zip(_COEF, _CARD.offset, strict=True))}] AS cl, [{', '.join(f'CASE WHEN fired[{c + 1}] THEN {p} ELSE 0.0 END' for c, p in enumerate(_PREC))}] AS trigger FROM b1),
base AS (SELECT *, {_lsm_sql('cl')} AS lc FROM b2)"""


def _pool_sql(w: str) -> str:
    return f"list_transform(range(0, {K}), lambda i: (1 - {w}) * lc[i + 1] + {w} * ln[i + 1])"


def _argmax_sql(a: str) -> str:
    return f"list_position({a}, list_max({a})) - 1"


_MACRO = """f AS (SELECT {by}, class, sum(CAST(y = class AND pred = class AS INT)) AS tp, sum(CAST(y = class AS INT)) + sum(CAST(pred = class AS INT)) AS d FROM {t}, (SELECT unnest(range({k})) AS class) GROUP BY ALL),
points AS (SELECT {by}, avg(CASE WHEN d > 0 THEN 2 * tp / d ELSE 0.0 END) AS macro_f1, any_value(acc) AS acc FROM f JOIN (SELECT {by}, avg(CAST(y = pred AS DOUBLE)) AS acc FROM {t} GROUP BY {by}) USING ({by}) GROUP BY {by})"""

_STOP = "['" + "', '".join(mining.STOP_WORDS) + "']"


@query(
    f"""WITH {LABELLED_SQL}, w AS (SELECT item_id, label, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({_STOP}, x)) AS k FROM labelled),
  g AS (SELECT label, unnest(list_distinct(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]), list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2])))) AS term FROM w),
  c AS (SELECT term, label, count(*) AS c FROM g GROUP BY 1, 2), d AS (SELECT term, sum(c) AS df FROM c GROUP BY 1 HAVING sum(c) >= 3), n AS (SELECT label, count(*) AS n, (SELECT count(*) FROM labelled) AS total FROM labelled GROUP BY 1),
  s AS (SELECT label, term, round(ln((c + 0.5) / (n - c + 0.5)) - ln((df - c + 0.5) / (total - n - df + c + 0.5)), 12) AS lo FROM (SELECT d.term, n.label, coalesce(c.c, 0) AS c, df, n, total FROM d CROSS JOIN n LEFT JOIN c ON c.term = d.term AND c.label = n.label)),
  b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY lo DESC, term) AS r FROM s)
  SELECT label AS class, rank, term, round(lo, 6) AS logodds FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY lo DESC, len(string_split(term, ' ')) DESC, term) AS rank FROM b WHERE r <= 36) WHERE rank <= 12"""
)
def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mining.mine_phrases(labelled(spark, sf_dir), "text", "label"))


@query(
    f"""WITH {LABELLED_SQL}, t AS (SELECT unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x)))) AS token FROM labelled),
  c AS (SELECT token, count(*) AS df FROM t GROUP BY 1) SELECT row_number() OVER (ORDER BY df DESC, token) AS rank, token, df FROM c ORDER BY df DESC, token LIMIT 25"""
)
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.document_frequency(labelled(spark, sf_dir), text.naming_tokens(F.col("text"), mining.STOP_WORDS), 25)


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """scores (item_id, feature, value) of all dimensions, calibration rows and their classes."""
    e = embedded(spark, sf_dir)
    each = F.explode(F.transform("vec", lambda x, j: F.struct(F.concat(F.lit("f"), j.cast("string")).alias("feature"), F.round(x, 6).alias("value")))).alias("s")
    calib = e.where("split <> 'test'").select("item_id", F.when(F.col("y") < 3, "a").when(F.col("y") < 6, "b").otherwise("c").alias("class"))
    return e.select("item_id", each).select("item_id", "s.*"), calib.select("item_id"), calib


_LIT = f"""{EMBEDDED_SQL}, sc AS (SELECT item_id, 'f' || j AS feature, round(vec[j + 1], 6) AS value FROM embedded, (SELECT unnest(range(64)) AS j)),
calib AS (SELECT item_id, CASE WHEN y < 3 THEN 'a' WHEN y < 6 THEN 'b' ELSE 'c' END AS class FROM embedded WHERE split <> 'test'),
qs AS (SELECT DISTINCT feature, q AS cut FROM (SELECT feature, unnest(quantile_cont(value, [0.5, 0.75, 0.9])) AS q FROM sc SEMI JOIN calib USING (item_id) GROUP BY 1)),
hl AS (SELECT feature, cut, count(*) FILTER (WHERE value > cut) AS t FROM sc SEMI JOIN calib USING (item_id) JOIN qs USING (feature) GROUP BY 1, 2),
bl AS (SELECT feature, cut, false AS negated, t AS support FROM hl UNION ALL SELECT feature, cut, true, (SELECT count(*) FROM calib) - t FROM hl),
lits AS (SELECT row_number() OVER (ORDER BY negated, feature, cut) - 1 AS lit_id, * FROM bl WHERE support <= 0.9 * (SELECT count(*) FROM calib)),
fires AS (SELECT item_id, lit_id FROM sc JOIN lits USING (feature) WHERE (value > cut) <> negated)"""


@query(f"WITH {_LIT} SELECT lit_id, feature, round(cut, 6) AS cut, negated, support FROM lits")
def literal_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, calib, _ = _features(spark, sf_dir)
    return rounded(mining.literals(scores, calib))


def _fb(tp: str, fired: str, n: str) -> str:
    p, r = f"({tp} / greatest({fired}, 1))", f"({tp} / greatest({n}, 1))"
    return f"(1.25 * {p} * {r} / greatest(0.25 * {p} + {r}, 1e-9))"


_CL = f"""{_LIT}, ncl AS (SELECT class, count(*) AS n_pos, (SELECT count(*) FROM calib) AS total FROM calib GROUP BY 1),
cf AS (SELECT item_id, lit_id, class FROM fires JOIN calib USING (item_id)),
sg AS (SELECT n.class AS target, lit_id, count(*) AS fired, count(*) FILTER (WHERE cf.class = n.class) AS tp, any_value(n_pos) AS n_pos FROM cf, ncl n GROUP BY 1, 2 HAVING count(*) >= 15),
pl AS (SELECT target, lit_id, pos, feature, negated, n_pos FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round({_fb('tp', 'fired', 'n_pos')}, 12) DESC, lit_id DESC) - 1 AS pos FROM sg) JOIN lits USING (lit_id) WHERE pos < 40),
c1 AS (SELECT target, [lit_id] AS lits, [pos] AS path, CAST(negated AS INT) AS neg FROM pl),
c2 AS (SELECT a.target, [a.lit_id, b.lit_id] AS lits, [a.pos, b.pos] AS path, CAST(a.negated AS INT) + CAST(b.negated AS INT) AS neg FROM pl a JOIN pl b ON a.target = b.target AND a.pos < b.pos AND a.feature <> b.feature),
c3 AS (SELECT a.target, [a.lit_id, b.lit_id, d.lit_id] AS lits, [a.pos, b.pos, d.pos] AS path, CAST(a.negated AS INT) + CAST(b.negated AS INT) + CAST(d.negated AS INT) AS neg
  FROM pl a JOIN pl b ON a.target = b.target AND a.pos < b.pos AND a.feature <> b.feature JOIN pl d ON d.target = a.target AND b.pos < d.pos AND d.feature <> a.feature AND d.feature <> b.feature),
has AS (SELECT item_id, class, list(lit_id) AS h FROM cf GROUP BY 1, 2),
call AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3),
ct AS (SELECT target, lits, path, neg, count(*) AS fired, count(*) FILTER (WHERE class = target) AS tp FROM call JOIN has ON list_has_all(h, lits) GROUP BY ALL HAVING count(*) >= 15),
good AS (SELECT ct.*, n_pos, tp / fired AS precision, tp / n_pos AS recall, {_fb('tp', 'fired', 'n_pos')} AS fbeta FROM ct JOIN ncl ON ncl.class = target
  WHERE neg <= 1 AND neg < len(lits) AND tp / fired >= greatest(0.35, least(3.0 * n_pos / total, 0.8))),
cands AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(fbeta, 12) DESC, path) AS rank FROM good) WHERE rank <= 2000)"""


@query(f"WITH {_CL} SELECT target AS class, array_to_string(lits, ',') AS lits, tp, fired, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fbeta, 6) AS fbeta, rank FROM cands")
def clause_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_clauses(spark, sf_dir)[0].drop("path").withColumn("lits", F.array_join(F.transform("lits", lambda x: x.cast("string")), ",")))


def _clauses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    scores, calib, labels = _features(spark, sf_dir)
    lits = mining.literals(scores, calib)
    every = mining.true_literals(scores, lits)
    fires = every.join(calib, "item_id", "left_semi")
    return mining.clauses(fires, lits, labels), fires, labels, every


def _greedy_sql(rounds: int = mining.MAX_CLAUSES) -> str:
    """Clauses added one by one, a round after the other, while they raise the union's F-beta."""
    parts = [
        "ht AS (SELECT target, rank, item_id, CAST(class = target AS INT) AS pos FROM cands JOIN has ON list_has_all(h, lits))",
        "l0 AS (SELECT * FROM ht), s0 AS (SELECT class AS target, n_pos, 0::BIGINT AS tp, 0::BIGINT AS fired, -1.0::DOUBLE AS best FROM ncl)",
    ]
    for i in range(rounds):
        parts += [
            f"g{i} AS (SELECT target, rank, sum(pos) AS dtp, count(*) AS dfired FROM l{i} GROUP BY 1, 2)",
            f"u{i} AS (SELECT target, rank, coalesce(dtp, 0) AS dtp, coalesce(dfired, 0) AS dfired, best, {_fb('(s.tp + coalesce(dtp, 0))', '(s.fired + coalesce(dfired, 0))', 's.n_pos')} AS fb FROM (SELECT target, rank FROM cands) c LEFT JOIN g{i} USING (target, rank) JOIN s{i} s USING (target))",
            f"p{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(fb, 12) DESC, rank) AS k FROM u{i} WHERE round(fb, 12) > round(best, 12)) WHERE k = 1)",
            f"l{i + 1} AS (SELECT * FROM l{i} ANTI JOIN (SELECT l.target, l.item_id FROM l{i} l SEMI JOIN p{i} p ON p.target = l.target AND p.rank = l.rank) USING (target, item_id))",
            f"s{i + 1} AS (SELECT target, n_pos, tp + coalesce(dtp, 0) AS tp, fired + coalesce(dfired, 0) AS fired, coalesce(fb, 2.0) AS best FROM s{i} LEFT JOIN (SELECT target, dtp, dfired, fb FROM p{i}) USING (target))",
        ]
    parts.append("pk AS (" + " UNION ALL ".join(f"SELECT target, rank, {i}::BIGINT AS clause_id, fb FROM p{i}" for i in range(rounds)) + ")")
    return ", ".join(parts)


@query(
    f"""WITH {_CL}, {_greedy_sql()} SELECT pk.target AS class, clause_id, array_to_string(lits, ',') AS lits, round(precision, 4) AS precision, round(recall, 4) AS recall, c.fired AS support, round(fb, 6) AS dnf_fbeta
  FROM pk JOIN cands c ON c.target = pk.target AND c.rank = pk.rank"""
)
def dnf_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands, fires, labels, _ = _clauses(spark, sf_dir)
    return rounded(mining.greedy_dnf(cands, fires, labels).withColumn("lits", F.array_join(F.transform("lits", lambda x: x.cast("string")), ",")))


_FIRE = f"""{_CL}, rules AS (SELECT * FROM cands WHERE rank <= 3), ah AS (SELECT item_id, list(lit_id) AS h FROM fires GROUP BY 1),
rc AS (SELECT e.item_id, r.target, coalesce(list_has_all(h, lits), false) AS hit, precision FROM (SELECT item_id FROM embedded) e CROSS JOIN rules r LEFT JOIN ah ON ah.item_id = e.item_id),
fr AS (SELECT item_id, target AS class, bool_or(hit) AS fired, max(CASE WHEN hit THEN precision ELSE 0.0 END) AS trigger, count(*) FILTER (WHERE hit) AS n_clauses FROM rc GROUP BY 1, 2)"""


def _fired(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cands, _, labels, every = _clauses(spark, sf_dir)
    rules = cands.where("rank <= 3").select("class", "lits", "precision")
    return mining.fire(every, rules, embedded(spark, sf_dir)), labels


@query(f"WITH {_FIRE} SELECT item_id, class, fired, round(trigger, 6) AS trigger, n_clauses FROM fr")
def rule_firing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_fired(spark, sf_dir)[0])


@query(f"WITH {_FIRE} SELECT fr.class, CAST(sum(CAST(fired AND calib.class = fr.class AS INT)) AS BIGINT) AS tp, CAST(sum(CAST(fired AS INT)) AS BIGINT) AS fired, round(sum(CAST(fired AND calib.class = fr.class AS INT)) / greatest(sum(CAST(fired AS INT)), 1), 6) AS precision FROM fr JOIN calib USING (item_id) GROUP BY 1")
def rule_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mining.rule_precision(*_fired(spark, sf_dir)))


@query(
    f"""WITH {_FIRE}, o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY trigger DESC, class) AS k FROM fr WHERE fired)
  SELECT e.item_id, coalesce(o.class, 'none') AS pred, round(coalesce(o.trigger, 0.0), 6) AS conf FROM (SELECT DISTINCT item_id FROM fr) e LEFT JOIN o ON o.item_id = e.item_id AND k = 1"""
)
def rule_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mining.rule_prediction(_fired(spark, sf_dir)[0], "none"))


_HAND = {"subject": 0.02, "context": 0.0, "stereotype": 0.05, "text": 0.08}


@query(
    f"""WITH {EMBEDDED_SQL}, h AS (SELECT item_id, vec[1] > 0.02 AS s, vec[2] > 0.0 AND (vec[3] > 0.05 OR vec[4] > 0.08) AS a, greatest(vec[3], vec[4]) AS ta, vec[5] > 0.0 AND (vec[6] > 0.05 OR vec[7] > 0.08) AS b, greatest(vec[6], vec[7]) AS tb FROM embedded),
  f AS (SELECT item_id, s AND a AS fa, CASE WHEN s AND a THEN ta ELSE 0.0 END AS ta, s AND b AS fb, CASE WHEN s AND b THEN tb ELSE 0.0 END AS tb FROM h)
  SELECT item_id, fa AS a_fired, fb AS b_fired, CAST(CASE WHEN fa AND (NOT fb OR ta >= tb) THEN 0 WHEN fb THEN 1 ELSE -1 END AS BIGINT) AS pred, round(CASE WHEN fa AND (NOT fb OR ta >= tb) THEN ta WHEN fb THEN tb ELSE 0.0 END, 6) AS conf FROM f"""
)
def hand_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.get("vec", F.lit(k))
    rows = embedded(spark, sf_dir).select("item_id", at(0).alias("subject"), *(at(1 + 3 * i + j).alias(f"{c}_{n}") for i, c in enumerate("ab") for j, n in enumerate(("context", "stereotype", "text"))))
    return rounded(mining.hand_rules(rows, ["a", "b"], _HAND).select("item_id", "a_fired", "b_fired", "pred", "conf"))


_CENT = [[1.0 if j == c else 0.0 for j in range(64)] for c in range(4)]
_MU_T, _MU_I = [0.01] * 64, [0.02 if j % 2 else -0.01 for j in range(64)]


@query(
    f"""WITH {EMBEDDED_SQL}, c AS (SELECT item_id, list_transform(range(0, 64), lambda i: u[i + 1] - 0.01) AS t, list_transform(range(0, 64), lambda i: u[i + 1] - CASE WHEN i % 2 = 1 THEN 0.02 ELSE -0.01 END) AS v FROM unit),
  n AS (SELECT item_id, t, v, greatest(sqrt(list_dot_product(t, t)), 1e-12) AS nt, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS nv FROM c)
  SELECT item_id, {', '.join(f'round(greatest(t[{c + 1}] / nt, v[{c + 1}] / nv), 6) AS concept_{c}' for c in range(4))} FROM n"""
)
def concept_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embedded(spark, sf_dir)
    s = e.select("item_id", pooling.concept_scores(F.col("vec"), F.col("vec"), _CENT, _MU_T, _MU_I).alias("s"))
    return rounded(s.select("item_id", *(F.get("s", F.lit(c)).alias(f"concept_{c}") for c in range(4))))


@query(f"WITH {_BASE} SELECT item_id, CAST({_argmax_sql(_pool_sql('0.4'))} AS BIGINT) AS pred FROM base")
def pooled_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.decompose(_rows(spark, sf_dir), _CARD, 0.4).select("item_id", "pred")


_COEF_SQL = f"{_COEF}::DOUBLE[][]"
_DEC = f"""{_BASE}, d0 AS (SELECT *, {_pool_sql('0.4')} AS sc FROM base), d1 AS (SELECT *, {_top_sql('sc')} AS o FROM d0), d2 AS (SELECT *, o[1] AS k, o[2] AS r FROM d1),
dec AS (SELECT *, 0.6 * (lc[k + 1] - lc[r + 1]) AS mc, 0.4 * (ln[k + 1] - ln[r + 1]) AS mn, list_transform(range(0, {J}), lambda j: 0.6 * (({_COEF_SQL})[k + 1][j + 1] - ({_COEF_SQL})[r + 1][j + 1]) * z[j + 1]) AS contrib,
  0.6 * (({_CARD.offset}::DOUBLE[])[k + 1] - ({_CARD.offset}::DOUBLE[])[r + 1]) AS bias FROM d2)"""


@query(f"WITH {_DEC} SELECT item_id, k AS pred, r AS runner_up, round(mc, 6) AS margin_concept, round(mn, 6) AS margin_neural, round(list_sum(contrib), 6) AS contrib_sum, round(bias, 6) AS bias, round(abs(mc) / (abs(mc) + abs(mn) + 1e-12), 6) AS concept_share FROM dec")
def decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pooling.decompose(_rows(spark, sf_dir), _CARD, 0.4)
    return rounded(d.select("item_id", "pred", "runner_up", "margin_concept", "margin_neural", F.aggregate("contrib", F.lit(0.0), lambda s, x: s + x).alias("contrib_sum"), "bias", "concept_share"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("lc", vectors.log_softmax(_CARD.logits(F.col("z"))))
    return pooling.operating_points(rows.select("y", "lc", "ln"), K)


_OP = f"{_BASE}, g AS (SELECT unnest({list(pooling.W_GRID)}::DOUBLE[]) AS w), p AS (SELECT w, y, {_argmax_sql(_pool_sql('w'))} AS pred FROM base, g), {_MACRO.format(by='w', t='p', k=K)}"


@query(f"WITH {_OP} SELECT w, round(macro_f1, 6) AS macro_f1, round(acc, 6) AS acc FROM points")
def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_points(spark, sf_dir))


@query(f"WITH {_OP}, r AS (SELECT macro_f1 AS rf, acc AS ra FROM points WHERE w = 1.0) SELECT coalesce(min(w) FILTER (WHERE macro_f1 >= rf - 0.01 - 1e-12 AND acc >= ra - 0.01 - 1e-12), 1.0) AS w FROM points, r")
def weight_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pooling.select_weight(_points(spark, sf_dir), acc_tol=0.01))


_TAU, _PLUS, _MINUS = [0.3, 0.5, 0.7, 0.9], [0.0, 0.5, 1.0], [0.0, 0.2]
_POL = f"""{_BASE}, pr AS (SELECT y, list_transform(ln, lambda x: exp(x)) AS p, fired FROM base), g AS (SELECT tau, lp, lm FROM (SELECT unnest({_TAU}::DOUBLE[]) AS tau), (SELECT unnest({_PLUS}::DOUBLE[]) AS lp), (SELECT unnest({_MINUS}::DOUBLE[]) AS lm)),
a AS (SELECT tau, lp, lm, y, p, list_transform(range(0, {K}), lambda i: p[i + 1] + CASE WHEN fired[i + 1] THEN lp * ({_PREC}::DOUBLE[])[i + 1] ELSE -lm END) AS q FROM pr, g),
pp AS (SELECT tau || '|' || lp || '|' || lm AS key, tau, lp, lm, y, CASE WHEN list_max(p) < tau THEN {_argmax_sql('q')} ELSE {_argmax_sql('p')} END AS pred FROM a), {_MACRO.format(by='key', t='pp', k=K)},
gr AS (SELECT DISTINCT tau, lp, lm, macro_f1, acc FROM points JOIN pp USING (key))"""


@query(f"WITH {_POL} SELECT tau, lp AS lam_pos, lm AS lam_neg, round(macro_f1, 6) AS macro_f1, round(acc, 6) AS acc FROM gr ORDER BY round(macro_f1, 12) DESC, round(acc, 12) DESC, tau, lp, lm LIMIT 1")
def policy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("y", F.transform("ln", F.exp).alias("probs"), "fired")
    return rounded(pooling.best_policy(pooling.policy_grid(rows, K, _PREC, _TAU, _PLUS, _MINUS)))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pooling.decompose(_rows(spark, sf_dir), _CARD, 0.4)
    return d.select("*", *pooling.evidence_state(F.col("pred"), F.col("fired"), F.col("trigger")))


_EV = f"""{_DEC}, ev0 AS (SELECT *, fired[k + 1] AS own, list_transform(range(0, {K}), lambda i: fired[i + 1] AND i <> k) AS ot FROM dec),
ev AS (SELECT *, CASE WHEN own AND list_contains(ot, true) THEN 'MIXED' WHEN own THEN 'SUPPORTED' WHEN list_contains(ot, true) THEN 'CONTESTED' ELSE 'NONE' END AS state,
  list_max(list_transform(range(0, {K}), lambda i: CASE WHEN ot[i + 1] THEN trigger[i + 1] ELSE 0.0 END)) - CASE WHEN own THEN trigger[k + 1] ELSE 0.0 END AS suspicion FROM ev0)"""


@query(f"WITH {_EV} SELECT item_id, k AS pred, state, round(CAST(suspicion AS DOUBLE), 6) AS suspicion FROM ev")
def evidence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_evidence(spark, sf_dir).select("item_id", "pred", "state", "suspicion"))


@query(f"WITH {_EV}, s AS (SELECT unnest(['SUPPORTED', 'MIXED', 'CONTESTED', 'NONE']) AS state) SELECT s.state, count(ev.item_id) AS n, round(count(ev.item_id) / (SELECT count(*) FROM ev), 6) AS share, round(avg(CAST(k <> y AS DOUBLE)), 6) AS error_rate FROM s LEFT JOIN ev ON ev.state = s.state GROUP BY 1")
def evidence_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pooling.state_rates(_evidence(spark, sf_dir).withColumn("err", F.col("pred") != F.col("y"))))


_LIST = "array_to_string(list_transform(({x})[1:3], lambda t: 'c' || t['i'] || '=' || CAST(round(t['v'], 3) AS DECIMAL(12, 3))), ',')"


@query(
    f"""WITH {_EV}, q AS (SELECT item_id, list_transform(range(0, {J}), lambda j: {{'o': -contrib[j + 1], 'i': j, 'v': contrib[j + 1]}}) AS a FROM ev)
  SELECT item_id, {_LIST.format(x="list_sort(list_filter(a, lambda t: t['o'] < 0))")} AS evidence_for, {_LIST.format(x="list_sort(list_transform(list_filter(a, lambda t: t['o'] > 0), lambda t: {'o': -t['o'], 'i': t['i'], 'v': t['v']}))")} AS evidence_against FROM q"""
)
def evidence_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"c{j}" for j in range(J)]
    r = pooling.evidence_record(_evidence(spark, sf_dir), names)
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["concept"], F.lit("="), s["contrib"].cast("decimal(12,3)").cast("string"))), ",")
    return r.select("item_id", shown("evidence_for").alias("evidence_for"), shown("evidence_against").alias("evidence_against"))


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _evidence(spark, sf_dir)
    return d.select("item_id", (F.col("pred") != F.col("y")).cast("long").alias("err"), F.transform("ln", F.exp).alias("probs"), "suspicion", (1 - F.col("concept_share")).alias("doubt"))


@query(
    f"""WITH {_EV}, r AS (SELECT item_id, round(suspicion, 9) AS s FROM ev)
  SELECT item_id, round((rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 - 1) / greatest(count(*) OVER () - 1, 1), 6) AS r FROM r"""
)
def rank_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _review(spark, sf_dir).select("item_id", F.round("suspicion", 9).alias("s"))
    return rounded(metrics.rank_norm(d, [], "s", "r").select("item_id", "r"))


_SIG = f"""{_EV}, si AS (SELECT item_id, CAST(k <> y AS BIGINT) AS err, list_reverse_sort(list_transform(ln, lambda x: exp(x))) AS p, suspicion, 1 - abs(mc) / (abs(mc) + abs(mn) + 1e-12) AS doubt FROM ev),
s4 AS (SELECT item_id, err, round(1 - p[1], 9) AS a, round(1 - (p[1] - p[2]), 9) AS b, round(suspicion, 9) AS c, round(doubt, 9) AS d FROM si),
rk AS (SELECT *, {', '.join(f'(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2 - 1) / greatest(count(*) OVER () - 1, 1) AS r{x}' for x in 'abcd')} FROM s4)"""


@query(f"WITH {_SIG} SELECT item_id, round(a, 6) AS low_confidence, round(b, 6) AS small_margin, round(CAST(c AS DOUBLE), 6) AS rules, round(d, 6) AS concept_doubt, round((ra + rc) / 2, 6) AS confidence_and_rules, round((rb + rc) / 2, 6) AS margin_and_rules, round((ra + rd) / 2, 6) AS confidence_and_concepts, round((rc + rd) / 2, 6) AS rules_and_concepts, round((ra + rb + rc + rd) / 4, 6) AS all_signals FROM rk")
def review_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("low_confidence", "small_margin", "rules", "concept_doubt", "confidence_and_rules", "margin_and_rules", "confidence_and_concepts", "rules_and_concepts", "all_signals")
    return rounded(review.signals(_review(spark, sf_dir)).select("item_id", *names))


@query(
    f"""WITH {_SIG}, t AS (SELECT c AS s, count(*) AS n, sum(err) AS e FROM rk GROUP BY 1), o AS (SELECT *, sum(n) OVER (ORDER BY s DESC) - n AS ahead, sum(n) OVER () AS total, sum(e) OVER () AS errors FROM t),
  g AS (SELECT unnest([0.1, 0.2]::DOUBLE[]) AS budget), h AS (SELECT budget, ceil(round(budget * total, 9)) AS m, total, errors, e * greatest(least((ceil(round(budget * total, 9)) - ahead) / n, 1.0), 0.0) AS hit FROM o, g)
  SELECT budget, round(sum(hit) / greatest(any_value(errors), 1), 6) AS caught, round(1 - (any_value(errors) - sum(hit)) / (any_value(total) - any_value(m)), 6) AS retained_acc FROM h GROUP BY 1"""
)
def deferral(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _review(spark, sf_dir).withColumn("rules", F.round("suspicion", 9))
    return rounded(review.deferral(d, "rules"))


@query(
    f"""WITH {_BASE} SELECT item_id, {', '.join(f'round(exp(ln[{c + 1}]), 6) AS p{c}' for c in range(K))}, round(list_max(list_transform(ln, lambda x: exp(x))), 6) AS conf,
  {', '.join(f'CASE WHEN fired[{c + 1}] THEN 1.0::DOUBLE ELSE 0.0 END AS f{c}' for c in range(K))}, {', '.join(f'CASE WHEN fired[{c + 1}] THEN {p}::DOUBLE ELSE 0.0 END AS w{c}' for c, p in enumerate(_PREC))} FROM base"""
)
def policy_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _rows(spark, sf_dir).select("item_id", pooling.policy_state(F.transform("ln", F.exp), F.col("fired"), _PREC).alias("s"))
    names = [*(f"p{c}" for c in range(K)), "conf", *(f"f{c}" for c in range(K)), *(f"w{c}" for c in range(K))]
    return rounded(s.select("item_id", *(F.get("s", F.lit(i)).alias(n) for i, n in enumerate(names))))


@query(
    """WITH v AS (SELECT user_id, list(event_type ORDER BY event_id) AS v FROM events GROUP BY 1), c AS (SELECT user_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM v),
  n AS (SELECT user_id, x, count(*) AS n, min(i) AS first FROM c GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM n)
  SELECT user_id, CASE WHEN n >= 2 THEN x ELSE '-1' END AS vote FROM b WHERE k = 1"""
)
def annotator_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    votes = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"]).alias("v"))
    return votes.select("user_id", text.majority_vote(F.col("v")).cast("string").alias("vote"))


@query(
    """WITH v AS (SELECT user_id, sum(CAST(value > 50 AS INT)) AS y, sum(CAST(NOT value > 50 AS INT)) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
  SELECT user_id, CAST(CASE WHEN y > n THEN 1 WHEN n > y THEN 0 ELSE -1 END AS BIGINT) AS vote FROM v"""
)
def hard_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    votes = e.groupBy("user_id").agg(F.collect_list(F.when(F.col("value") > 50, "YES").otherwise("no")).alias("v"))
    return rounded(votes.select("user_id", text.yes_no_vote(F.col("v")).alias("vote")))


_CATS = ["view", "click", "purchase", "login"]


@query(
    f"""WITH c AS (SELECT unnest({_CATS}) AS cat, unnest(range({len(_CATS)})) AS place), n AS (SELECT user_id, place, count(*) AS n FROM events JOIN c ON cat = event_type GROUP BY 1, 2),
  b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, place) AS k FROM n) SELECT u.user_id, CAST(coalesce(place, -1) AS BIGINT) AS category FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN b ON b.user_id = u.user_id AND k = 1"""
)
def multilabel_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    votes = e.groupBy("user_id").agg(F.collect_list(F.array("event_type")).alias("v"))
    return rounded(votes.select("user_id", text.top_category(F.col("v"), _CATS).alias("category")))


@query(
    f"""WITH {LABELLED_SQL}, p AS (SELECT unnest(['of the', 'idiot', 'que de', 'license']) AS predicate), s AS (
    SELECT predicate, label = 'toxic' AS pos, CAST(contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') || ' ', ' ' || predicate || ' ') AS INT) AS x FROM labelled, p)
  SELECT predicate, round((sum(CAST(a.pos AND NOT b.pos AND a.x > b.x AS INT)) + sum(CAST(a.pos AND NOT b.pos AND a.x = b.x AS INT)) / 2) / sum(CAST(a.pos AND NOT b.pos AS INT)), 6) AS auc FROM s a JOIN s b USING (predicate) GROUP BY 1"""
)
def predicate_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = labelled(spark, sf_dir).select("label", text.phrase_normal(F.col("text")).alias("n"))
    each = n.select("label", F.explode(F.array(*(F.struct(F.lit(p).alias("predicate"), text.has_phrase(F.col("n"), p).cast("int").alias("x")) for p in ("of the", "idiot", "que de", "license")))).alias("s")).select("label", "s.*")
    return rounded(metrics.auc(each, ["predicate"], "x", F.col("label") == "toxic"))


