"""Learners behind the checks: shape models, probes, scorecards, concept banks, out-of-fold scores."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import boosting, metrics, text, vectors
from plumbline.functions.rng import SEED, draw, seed_list
from plumbline.functions.tables import saved
from plumbline.operators import decisions, naming, resampling
from plumbline.operators.pooling import Scorecard

#: Inverse regularisation grids, least first.
PROBE_CS, CARD_CS = (0.01, 0.1, 1.0), (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
#: A column of more values than this is no source.
MOST_SOURCES = 1000


def shape_frame(df: DataFrame, field: str, target: str, key: str = "item_id", *keep: str) -> DataFrame:
    """key, split, y, `keep` and the nine shape features."""
    return text.with_shape(df, F.col(field), key, "split", F.col(target).cast("long").alias("y"), *keep)


def _fit_trees(column: Callable[[int], np.ndarray], y: np.ndarray, val: np.ndarray, k: int, source: bool) -> boosting.Trees:
    """D3's trees, ended by the loss on val rows (of a drawn 15% of train without any), or D4's: 200 rounds at 0.1, ended by a drawn tenth of over 10,000 rows, as the reference's learner is by default."""
    if source:
        held = np.random.default_rng(SEED).random(len(y)) < (0.1 if len(y) > 10_000 else 0)
        return boosting.fit_columns(column, len(text.FEATURES), y, held, k, rounds=200, rate=0.1)
    held = val if val.any() else np.random.default_rng(SEED).random(len(y)) < 0.15
    return boosting.fit_columns(column, len(text.FEATURES), y, held, k)


def fit_shape(rows: DataFrame, k: int, key: str = "item_id") -> boosting.Trees:
    """Boosted trees on the shape of train rows."""
    return fit_shapes({"": (rows, k, False)}, key)[""]


def _streamed(jobs: list[tuple[DataFrame, list[int]]], key: str, columns: list[Column], run: Callable[[int, Iterator[pa.RecordBatch]], bytes]) -> dict[int, object]:
    """What `run` pickles of all train and val rows of each number's job, in the order of keys. Each number has a task of its own, which its rows stream through; none goes through the driver."""
    every = None
    for rows, numbers in jobs:
        part = rows.where("split IN ('train', 'val')").select(F.explode(F.array(*map(F.lit, numbers))).alias("job"), F.col(key).alias("id"), (F.col("split") == "val").alias("val"), F.col("y").cast("long").alias("y"), *columns)
        every = part if every is None else every.unionByName(part)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is not None:
            job = first.column("job")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([job], pa.int32()), pa.array([run(job, chain([first], batches))], pa.binary())], names=["job", "model"])

    dealt = every.repartitionById(1 + max(n for _, numbers in jobs for n in numbers), F.col("job")).sortWithinPartitions("id")
    return {r["job"]: pickle.loads(r["model"]) for r in dealt.mapInArrow(each, "job int, model binary").collect()}


def fit_shapes(jobs: dict[str, tuple[DataFrame, int, bool]], key: str = "item_id") -> dict[str, boosting.Trees]:
    """Models by name, fitted on all train and val rows, side by side, each in a task of its own that keeps its columns in files. jobs: name -> (rows with shape features, split and y; classes; whether it is D4's)."""
    names, width = list(jobs), len(text.FEATURES)
    how = [rest for _, *rest in jobs.values()]

    def fit(job: int, batches: Iterator[pa.RecordBatch]) -> bytes:
        columns, y, val = [boosting.Stored(1, np.float64) for _ in range(width)], [], []
        for batch in batches:
            for held, c in zip(columns, text.FEATURES, strict=True):
                held.add(batch.column(c).to_numpy(zero_copy_only=False)[:, None])
            y.append(batch.column("y").to_numpy())
            val.append(batch.column("val").to_numpy(zero_copy_only=False))
        return pickle.dumps(_fit_trees(lambda j: columns[j].whole()[:, 0], np.concatenate(y), np.concatenate(val), *how[job]))

    models = _streamed([(rows, [i]) for i, (rows, *_) in enumerate(jobs.values())], key, [F.col(c).cast("double").alias(c) for c in text.FEATURES], fit) if jobs else {}
    none = np.zeros((0, width))
    return {name: models.get(i) or boosting.fit_trees(none, np.zeros(0, int), how[i][0]) for i, name in enumerate(names)}


#: Rows that a model of one of many groups is fitted on at most, and rows of a group that a task scores.
MOST_EACH, PIECE = 20_000, 50_000


def shape_models(rows: DataFrame, by: str, k: int, key: str = "item_id", most: int = MOST_EACH, rounds: int = 500, rate: float = 0.08) -> DataFrame:
    """`by`, key, y, p: class probabilities of every test row by its group's own shape model; groups are fitted side by side, each in a task.

    A group's sample is bounded by drawn order, and its test rows are dealt to tasks in pieces, each with the group's model, so neither a
    group nor a model meets all rows or the driver. A group without train and val rows has no results. rows: by, key, split, y and shape.
    """
    known = rows.where("split IN ('train', 'val')")
    sizes = known.groupBy(by).agg(F.count("*").alias("_n"))
    sample = known.join(F.broadcast(sizes), by).where((F.col("_n") <= most) | (draw("fit", F.col(key)) % F.col("_n") < most)).select(by, key, "split", F.col("y").cast("long").alias("y"), *text.FEATURES)

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by(key)
        x, y = np.stack([group.column(c).to_numpy() for c in text.FEATURES], axis=1), group.column("y").to_numpy()
        held = np.array(group.column("split").to_pylist()) == "val"
        if not held.any():
            held = np.random.default_rng(SEED).random(len(y)) < 0.15
        model = boosting.fit_trees(x[~held], y[~held], k, x[held], y[held], rounds, rate)
        return pa.table({by: group.column(by).slice(0, 1), "model": pa.array([pickle.dumps(model)], pa.binary())})

    models = saved(sample.groupBy(by).applyInArrow(fit, T.StructType([rows.schema[by], T.StructField("model", T.BinaryType())])))
    test = rows.where("split = 'test'").select(by, key, F.col("y").cast("long").alias("y"), *text.FEATURES)
    pieces = test.groupBy(by).agg(F.ceil(F.count("*") / PIECE).cast("int").alias("_pieces"))
    dealt = test.join(F.broadcast(pieces), by).withColumn("_piece", (draw("piece", F.col(key)) % F.col("_pieces")).cast("int")).drop("_pieces")
    sent = models.join(F.broadcast(pieces), by).select(by, F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_piece"), "model")

    schema = T.StructType([rows.schema[by], rows.schema[key], T.StructField("y", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))])

    def score(group: pa.Table, model: pa.Table) -> pa.Table:
        if not len(group) or not len(model):
            return pa.table({f: pa.array([], t) for f, t in ((by, group.schema.field(by).type), (key, group.schema.field(key).type), ("y", pa.int64()), ("p", pa.list_(pa.float64())))})
        p = pickle.loads(model.column("model")[0].as_py()).probabilities(np.stack([group.column(c).to_numpy() for c in text.FEATURES], axis=1))
        return pa.table({by: group.column(by), key: group.column(key), "y": group.column("y"), "p": pa.array(p.tolist(), pa.list_(pa.float64()))})

    return dealt.groupBy(by, "_piece").cogroup(sent.groupBy(by, "_piece")).applyInArrow(score, schema)


def d3_by(rows: DataFrame, by: str, k: int, key: str = "item_id", **how) -> DataFrame:
    """by, n_test, shape_f1, majority_f1, lift, level, verdict of D3 within every group at once (no intervals, no text reference).

    rows: by, key, split, y and shape.
    """
    scored = saved(shape_models(rows, by, k, key, **how).select(by, "y", (F.array_position("p", F.array_max("p")) - 1).alias("pred")))
    top = rows.where("split IN ('train', 'val')").groupBy(by, "y").count().groupBy(by).agg(F.max_by("y", F.struct("count", -F.col("y"))).alias("top"))
    f1 = lambda cells, name: metrics.macro(metrics.confusion(cells, [by]), [by], k).select(by, F.col("macro_f1").alias(name))
    base = scored.join(F.broadcast(top), by).drop("pred").withColumnRenamed("top", "pred")
    out = scored.groupBy(by).agg(F.count("*").alias("n_test")).join(f1(scored, "shape_f1"), by).join(f1(base, "majority_f1"), by).withColumn("lift", F.col("shape_f1") - F.col("majority_f1"))
    return out.withColumn("level", decisions.d3_level(F.col("lift"), F.lit(None).cast("double"))).withColumn("verdict", decisions.d3_verdict(F.col("level")))


def d4_by(df: DataFrame, by: str, field: str, source: str, label: str, key: str = "item_id") -> DataFrame:
    """by, sources, auc, v, verdict of D4 within every group at once. df: by, key, split, the text field, source and label."""
    names = sorted(r[0] for r in df.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s")).distinct().limit(MOST_SOURCES + 1).collect())
    if len(names) > MOST_SOURCES:
        raise ValueError(f"{source} has over {MOST_SOURCES} values: no source column")
    code = F.array_position(F.array(*map(F.lit, names)), F.coalesce(F.col(source).cast("string"), F.lit(""))) - 1
    rows = text.with_shape(df, F.col(field), key, "split", by, code.alias("y"))
    p = shape_models(rows, by, len(names), key, rounds=200, rate=0.1).select(by, "y", F.posexplode("p").alias("code", "p"))
    own = rows.select(by, "y").distinct()
    # a source that the group lacks has no curve
    auc = metrics.auc(p.withColumn("p", F.round("p", 9)), [by, "code"], "p", F.col("y") == F.col("code")).join(own.withColumnRenamed("y", "code"), [by, "code"], "left_semi").groupBy(by).agg(F.avg("auc").alias("auc"))
    v = metrics.cramers_v_by(df, by, source, label)
    counted = own.groupBy(by).agg(F.count("*").alias("sources"))
    return counted.join(auc, by, "left").join(v, by, "left").select(by, "sources", "auc", "v", decisions.d4_verdict(F.col("auc"), F.col("v"), F.col("sources")).alias("verdict"))


def with_probabilities(rows: DataFrame, model: boosting.Trees, out: str = "p") -> DataFrame:
    """`rows` (with the shape features) and the class probabilities."""
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(*columns: pa.Array) -> pa.Array:
        p = model.probabilities(np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))

    return rows.withColumn(out, score(*text.FEATURES))


def d3_surface(df: DataFrame, field: str, target: str, k: int, text_ref: float | None = None, keep: DataFrame | None = None, key: str = "item_id", shaped: DataFrame | None = None, model: boosting.Trees | None = None, b: int = resampling.B) -> DataFrame:
    """One row: macro-F1 of a model that sees form only, of the majority class, lift and share with their 95% intervals, level, verdict.

    `keep`: keys of test rows to score (a duplicate-free slice). `shaped`, `model`: what shape_frame and fit_shape give, if at hand.
    """
    rows = shape_frame(df, field, target, key) if shaped is None else shaped
    model = model or fit_shape(rows, k, key)
    test = rows.where("split = 'test'")
    if keep is not None:
        test = test.join(keep.select(key), key, "left_semi")
    scored = with_probabilities(test, model).select(key, "y", (F.array_position("p", F.array_max("p")) - 1).alias("pred")).persist()
    n = scored.count()
    sizes = {r["y"]: r["count"] for r in rows.where("split IN ('train', 'val')").groupBy("y").count().collect()}
    majority = min(sizes, key=lambda c: (-sizes[c], c)) if sizes else 0
    shape, base = (metrics.macro(metrics.confusion(scored.withColumn("pred", c), []), [], k).select(F.col("macro_f1").alias(name)) for c, name in ((F.col("pred"), "shape_f1"), (F.lit(majority), "majority_f1")))
    lift = F.col("shape_f1") - F.col("majority_f1")
    share = F.col("shape_f1") / F.lit(text_ref).cast("double")
    out = shape.join(base).select("*", lift.alias("lift"), share.alias("share"), F.lit(n).cast("long").alias("n_test"), F.lit(len(model.rounds)).cast("long").alias("rounds"))
    placed = scored.join(resampling.positions(scored, key), key)
    ends = {r["metric"]: r for r in resampling.lift_interval(placed, n, k, majority, text_ref, b).collect()} if n else {}
    end = lambda m, side: F.lit(ends[m][side] if m in ends else None).cast("double").alias(f"{m}_{side}")
    whole = out.select("*", *(end(m, side) for m in ("lift", "share") for side in ("lo", "hi")))
    done = df.sparkSession.createDataFrame([whole.first()], whole.schema)
    scored.unpersist()
    return done.withColumn("level", decisions.d3_level(F.col("lift"), F.col("share"))).withColumn("verdict", decisions.d3_verdict(F.col("level")))


def source_rows(df: DataFrame, field: str, source: str, key: str = "item_id", shaped: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Shape features with the source's code as y, and how many sources there are."""
    names = [r[0] for r in df.select(F.col(source).cast("string")).distinct().orderBy(source).limit(MOST_SOURCES + 1).collect()]
    if len(names) > MOST_SOURCES:
        raise ValueError(f"{source} has over {MOST_SOURCES} values: no source column")
    code = F.array_position(F.array(*map(F.lit, names)), F.col(source).cast("string")) - 1
    rows = text.with_shape(df, F.col(field), key, "split", source) if shaped is None else shaped
    return rows.withColumn("y", F.coalesce(code, F.lit(names.index(None) if None in names else 0))), len(names)


def d4_source(df: DataFrame, field: str, source: str, label: str, key: str = "item_id", shaped: DataFrame | None = None, model: boosting.Trees | None = None) -> DataFrame:
    """One row: one-vs-rest AUC of shape for the source (mean over sources), Cramer's V of source and label, verdict.

    `shaped`, `model`: shape features beside the source column, and a model of fit_shapes, if at hand.
    """
    v = metrics.cramers_v(df, source, label)
    rows, k = source_rows(df, field, source, key, shaped)
    if k < 2:
        return v.select(F.lit(None).cast("double").alias("auc"), "v", F.lit(k).cast("long").alias("sources"), F.lit("note").alias("verdict"))
    model = model or fit_shapes({"": (rows, k, True)}, key)[""]
    p = with_probabilities(rows.where("split = 'test'"), model).select("y", F.posexplode("p").alias("code", "p"))
    auc = metrics.auc(p.withColumn("p", F.round("p", 9)), ["code"], "p", F.col("y") == F.col("code")).agg(F.avg("auc").alias("auc"))
    return auc.join(v).select("auc", "v", F.lit(k).cast("long").alias("sources"), decisions.d4_verdict(F.col("auc"), F.col("v"), F.lit(k)).alias("verdict"))


def length_auc(df: DataFrame, field: str, positive) -> DataFrame:
    """One row, auc: of the text's length alone (either direction)."""
    a = metrics.auc(df.withColumn("_l", F.length(text.raw(F.col(field)))), [], "_l", positive)
    return a.select(F.greatest("auc", 1 - F.col("auc")).alias("auc"))


def standardiser(rows: DataFrame, vector: str) -> tuple[list[float], list[float]]:
    """Means and population standard deviations by element (1 where there is no spread)."""
    each = rows.select(F.posexplode(vector).alias("j", "x")).groupBy("j").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("j").collect()
    return [r["m"] for r in each], [r["s"] if r["s"] else 1.0 for r in each]


def _weighted(rows: DataFrame, k: int) -> tuple[DataFrame, float]:
    """Class-balanced weights n / (k * class size), and their sum."""
    total = rows.count()
    sizes = rows.groupBy("y").agg(F.count("*").alias("_c"))
    return rows.join(F.broadcast(sizes), "y").withColumn("w", F.lit(float(total)) / (k * F.greatest("_c", F.lit(1)))).drop("_c"), float(total)


def logistic_probe(rows: DataFrame, k: int, cs: tuple[float, ...] = PROBE_CS, l1: bool = False):
    """(model, mu, sd, C): class-balanced multinomial regression on standardised vectors, C by validation macro-F1 (first of equals).

    rows: vec, y, split.
    """
    mu, sd = standardiser(rows.where("split = 'train'"), "vec")
    lit = lambda v: F.array(*map(F.lit, v))
    z = F.zip_with(F.zip_with("vec", lit(mu), lambda x, m: x - m), lit(sd), lambda x, s: x / s)
    ready = rows.select("y", "split", array_to_vector(z).alias("features")).withColumn("y", F.col("y").cast("double"))
    train, total = _weighted(ready.where("split = 'train'"), k)
    train.persist()
    best = None
    for c in cs:
        model = LogisticRegression(labelCol="y", featuresCol="features", weightCol="w", family="multinomial", standardization=False, regParam=1.0 / (c * total), elasticNetParam=1.0 if l1 else 0.0, maxIter=100).fit(train)
        if len(cs) == 1:
            best = (0.0, c, model)
            break
        scored = model.transform(ready.where("split = 'val'")).select(F.col("y").cast("long").alias("y"), F.col("prediction").cast("long").alias("pred"))
        f1 = metrics.macro(metrics.confusion(scored, []), [], k).first()["macro_f1"]
        if best is None or f1 > best[0]:
            best = (f1, c, model)
    train.unpersist()
    return best[2], mu, sd, best[1]


def scorecard(rows: DataFrame, names: list[str], k: int, l1: bool = False, prior: bool = False, cs: tuple[float, ...] = CARD_CS) -> Scorecard:
    """A scorecard over concept scores, trained on train, its C chosen on val (if there is a choice); with the classes' log shares added if `prior`."""
    return chosen_scorecard(rows, names, k, l1, prior, cs)[0]


def chosen_scorecard(rows: DataFrame, names: list[str], k: int, l1: bool = False, prior: bool = False, cs: tuple[float, ...] = CARD_CS) -> tuple[Scorecard, float]:
    """The same, and its C."""
    model, mu, sd, c = logistic_probe(rows, k, cs, l1)
    m = model.coefficientMatrix.toArray()
    log_prior = None
    if prior:
        counts = {int(r["y"]): r["count"] for r in rows.where("split = 'train'").groupBy("y").count().collect()}
        import math

        log_prior = [math.log(max(counts.get(c, 0), 1) / sum(counts.values())) for c in range(k)]
    return Scorecard(names, mu, sd, [list(map(float, w)) for w in m], list(map(float, model.interceptVector.toArray())), log_prior), c


def probe_f1(rows: DataFrame, k: int) -> float:
    """Test macro-F1 of a logistic probe."""
    model, mu, sd, _ = logistic_probe(rows, k)
    lit = lambda v: F.array(*map(F.lit, v))
    z = F.zip_with(F.zip_with("vec", lit(mu), lambda x, m: x - m), lit(sd), lambda x, s: x / s)
    scored = model.transform(rows.where("split = 'test'").select("y", array_to_vector(z).alias("features"))).select(F.col("y").cast("long").alias("y"), F.col("prediction").cast("long").alias("pred"))
    return metrics.macro(metrics.confusion(scored, []), [], k).first()["macro_f1"]


def _probes(views: dict[str, DataFrame], k: int, seeds: list[int], key: str) -> dict[tuple[str, int], boosting.Probe]:
    """Probes by view and place of the seed, fitted on all train rows side by side, each in a task of its own that keeps its rows in files."""
    jobs = [(name, s) for name in views for s in range(len(seeds))]

    def fit(job: int, batches: Iterator[pa.RecordBatch]) -> bytes:
        x = held_x = None
        y, val = [], []
        for batch in batches:
            z = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x, held_x = (x, held_x) if x else (boosting.Stored(z.shape[1]), boosting.Stored(z.shape[1]))
            y.append(batch.column("y").to_numpy())
            val.append(batch.column("val").to_numpy(zero_copy_only=False))
            x.add(boosting.normal_rows(z[~val[-1]]))
            held_x.add(z[val[-1]])
        y, val = np.concatenate(y), np.concatenate(val)
        return pickle.dumps(boosting.fit_probe(x, y[~val], held_x, y[val], k, seeds[jobs[job][1]]).p)

    numbers = lambda name: [i for i, (own, _) in enumerate(jobs) if own == name]
    return {jobs[i]: boosting.Probe(p) for i, p in _streamed([(rows, numbers(name)) for name, rows in views.items()], key, [F.col("vec").cast("array<float>").alias("x")], fit).items()}


def mlp_scores(views: dict[str, DataFrame], k: int, seeds: list[int], key: str = "item_id") -> dict[str, list[float]]:
    """Test macro-F1 of the two-layer probe, per view and seed, fitted on all train rows and scored on all test rows. views: name -> key, vec, y, split."""
    if not views:
        return {}
    models = _probes(views, k, seeds, key)
    scored = None
    for name, rows in views.items():
        part = _probed(rows, [models[name, s] for s in range(len(seeds))]).withColumn("view", F.lit(name))
        scored = part if scored is None else scored.unionByName(part)
    found = {(r["view"], r["s"]): r["macro_f1"] for r in metrics.macro(metrics.confusion(scored, ["view", "s"]), ["view", "s"], k).collect()}
    return {name: [found.get((name, i), 0.0) for i in range(len(seeds))] for name in views}


def mlp_logits(rows: DataFrame, k: int, seed: int = SEED, key: str = "item_id") -> DataFrame:
    """key, logits: class scores of the two-layer probe on standardised vectors, fitted on all train rows, its epoch chosen on val. rows: key, vec, y, split."""
    mu, sd = map(np.array, standardiser(rows.where("split = 'train'"), "vec"))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def standard(vec: pa.Array) -> pa.Array:
        z = (vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1) - mu) / sd
        return pa.array(z.tolist(), pa.list_(pa.float64()))

    probe = _probes({"": rows.select(key, "y", "split", standard("vec").alias("vec"))}, k, [seed], key)["", 0]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(vec: pa.Array) -> pa.Array:
        own = (vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1) - mu) / sd
        return pa.array(probe.scores(own.astype(np.float32)).astype(np.float64).tolist(), pa.list_(pa.float64()))

    return rows.select(key, score("vec").alias("logits"))


def _probed(rows: DataFrame, probes: list[boosting.Probe]) -> DataFrame:
    """view's test rows as y, s (place of the probe), pred."""
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def labels(vec: pa.Array) -> pa.Array:
        z = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)
        return pa.array(np.stack([m.labels(z) for m in probes], axis=1).tolist(), pa.list_(pa.int64()))

    return rows.where("split = 'test'").select("y", F.posexplode(labels("vec")).alias("s", "pred"))


def modality_scores(encoders: dict[str, tuple[DataFrame, DataFrame]], labels: DataFrame, k: int, key: str = "item_id", seeds: int = 3, probe: str = "mlp") -> DataFrame:
    """encoder, enc_order, view, seed, macro_f1 of probes on image, text and both; encoders weakest first.

    encoders: name -> (image, text) tables of key, vec; labels: key, y, split. probe: mlp, or logreg (which no seed changes, so it is fitted once).
    """
    drawn, frames = seed_list(seeds), {}
    for name, (image, words) in encoders.items():
        both = image.join(words.select(key, F.col("vec").alias("u")), key).select(key, F.concat("vec", "u").alias("vec"))
        frames |= {f"{view}:{name}": frame.select(key, "vec").join(labels, key) for view, frame in (("image", image), ("text", words), ("both", both))}
    scores = mlp_scores(frames, k, drawn, key) if probe == "mlp" else {v: [probe_f1(rows, k)] * seeds for v, rows in frames.items()}
    out = [(name, order, view, s, float(f)) for order, name in enumerate(encoders) for view in ("image", "text", "both") for s, f in zip(drawn, scores[f"{view}:{name}"], strict=True)]
    return labels.sparkSession.createDataFrame(out, "encoder string, enc_order int, view string, seed long, macro_f1 double")


def kmeans(rows: DataFrame, k: int, seeds: int = 4, key: str = "item_id", keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[list[float]]]:
    """(key, keep, cluster), centres: the best of several starts by within-cluster cost. rows: key, vec, keep.

    Iterations are matrix products over blocks of rows. Pass rows that are kept: clusters are told from them again when they are asked for.
    """
    ready = rows.select(key, *keep, array_to_vector("vec").alias("features"))
    points = ready.select("features").persist()
    best = None
    for s in range(seeds):
        model = KMeans(k=k, seed=SEED + s, featuresCol="features", predictionCol="cluster", solver="block").fit(points)
        if best is None or model.summary.trainingCost < best[0]:
            best = (model.summary.trainingCost, model)
    out = best[1].transform(ready).select(key, *keep, F.col("cluster").cast("long").alias("cluster"))
    centres = [list(map(float, c)) for c in best[1].clusterCenters()]
    points.unpersist()
    return out, centres


def medoids(rows: DataFrame, clusters: DataFrame, centres: list[list[float]], key: str = "item_id") -> DataFrame:
    """cluster, key, cos: each cluster's member nearest its centre (the smaller key on ties)."""
    table = F.array(*(F.array(*map(F.lit, c)) for c in centres))
    cos = vectors.dot(vectors.unit(F.col("vec")), vectors.unit(F.element_at(table, (F.col("cluster") + 1).cast("int"))))
    joined = rows.join(clusters, key).withColumn("cos", F.round(cos, 12))
    return joined.groupBy("cluster").agg(F.max_by(F.struct(key, "cos"), F.struct("cos", -F.col(key))).alias("m")).select("cluster", "m.*")


def mean_unit(rows: DataFrame, column: str = "vec") -> list[float]:
    """The mean of the rows' unit vectors; empty without rows."""
    units = rows.select(F.lit(1).alias("k"), vectors.unit(F.col(column)).alias("u"))
    got = vectors.mean_vector(units, ["k"], "u", "m").first()
    return list(got["m"]) if got else []


def concept_bank(phrases: DataFrame, images: DataFrame, k: int, members: int = 2, captions: DataFrame | None = None, means: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """concept_id, name, centroid, n_text, n_img: clusters of centred unit vectors of both modalities with `members` at least.

    phrases: item_id, vec, word; images: item_id, vec. Each modality is centred by its mean (means: those of phrases and images, if they are
    known). A concept is named by its most frequent words (three at most, by count, then alphabet); one without phrases by the captions of
    the images of largest product with its centre (captions: item_id, word, each once), or "image" without any. Equal names get -2, -3 in
    the order of clusters.
    """
    def centred(df: DataFrame, mean: list[float]) -> DataFrame:
        u = df.withColumn("_u", vectors.unit(F.col("vec")))
        return u.select(*df.columns, vectors.unit(vectors.minus(F.col("_u"), F.array(*map(F.lit, mean)).cast("array<double>"))).alias("c"))

    mu_t, mu_v = means or (mean_unit(phrases), mean_unit(images))
    t, v = centred(phrases, mu_t).select("item_id", "c", "word", F.lit(1).alias("t")), centred(images, mu_v).select("item_id", "c", F.lit(None).cast("string").alias("word"), F.lit(0).alias("t"))
    # kept, so that the starts, sizes and names read the same rows and none is joined to its cluster
    every = saved(t.unionByName(v))
    joined, centres = kmeans(every.withColumnRenamed("c", "vec"), k, keep=("word", "t"))
    sizes = joined.groupBy("cluster").agg(F.sum("t").cast("long").alias("n_text"), F.sum(1 - F.col("t")).cast("long").alias("n_img")).where(F.col("n_text") + F.col("n_img") >= members)
    counted = joined.where("word IS NOT NULL").groupBy("cluster", "word").count()
    top = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("count"), "word"))
    names = counted.withColumn("r", top).where("r <= 3").groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda s: s["word"]), "-").alias("base"))
    again = F.row_number().over(Window.partitionBy("base").orderBy("cluster"))
    if captions is not None:
        bare = sizes.join(names, "cluster", "left_anti").select("cluster").collect()  # k at most
        if bare:
            spark = phrases.sparkSession
            heads = spark.createDataFrame([(int(r[0]), [float(x) for x in centres[r[0]]]) for r in bare], "id long, x array<double>")
            top = naming.top_members(heads, every.where("t = 0").select(F.col("item_id").alias("id"), F.col("c").alias("x")))
            names = names.unionByName(naming.names_of_members(top, captions).select(F.col("concept").alias("cluster"), F.col("name").alias("base")))
    named = sizes.join(names, "cluster", "left").withColumn("base", F.coalesce("base", F.lit("image"))).withColumn("n", again)
    table = F.array(*(F.array(*map(F.lit, c)) for c in centres))
    return named.select(F.col("cluster").alias("concept_id"), F.when(F.col("n") > 1, F.concat_ws("-", "base", F.col("n").cast("string"))).otherwise(F.col("base")).alias("name"), F.element_at(table, (F.col("cluster") + 1).cast("int")).alias("centroid"), "n_text", "n_img")


def out_of_fold(rows: DataFrame, k: int, folds: int = 5, key: str = "item_id") -> DataFrame:
    """key, lc: log probabilities of a probe that has not seen the row's fold. rows: key, vec, y, fold."""
    out = None
    for f in range(folds):
        part = rows.withColumn("split", F.when(F.col("fold") == f, "test").when(F.col("fold") == (f + 1) % folds, "val").otherwise("train"))
        model, mu, sd, _ = logistic_probe(part, k)
        lit = lambda v: F.array(*map(F.lit, v))
        z = F.zip_with(F.zip_with("vec", lit(mu), lambda x, m: x - m), lit(sd), lambda x, s: x / s)
        held = part.where("split = 'test'").select(key, array_to_vector(z).alias("features"))
        got = model.transform(held).select(key, F.transform(vector_to_array("probability"), lambda p: F.log(F.greatest(p, F.lit(1e-12)))).alias("lc"))
        out = got if out is None else out.unionByName(got)
    return out


def stacked_model(rows: DataFrame, k: int):
    """A logistic model over two experts' log probabilities. rows: lc, ln, y, split."""
    return logistic_probe(rows.select(F.concat("lc", "ln").alias("vec"), "y", "split"), k)


__all__ = ["concept_bank", "d3_surface", "d4_source", "fit_shape", "kmeans", "length_auc", "logistic_probe", "medoids", "mlp_scores", "modality_scores", "out_of_fold", "probe_f1", "scorecard", "shape_frame", "stacked_model"]
