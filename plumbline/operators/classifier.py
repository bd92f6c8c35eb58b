"""Classifiers over frozen vectors and a learned decision policy, fitted data-parallel.

Rows are packed into blocks of a bounded size once, as a written table. A step of
Adam is one job: every task adds up its blocks' gradients, and the sums are added
in two levels, so no task or driver holds rows. Steps use all rows (no batches or
dropout to draw), so the result depends on the partitioning by rounding only.

Several models of one shape learn side by side from the same pass: a row says by
bits which of them it teaches (`fit`) and which it checks (`check`). That is how a
cross-fit costs as many jobs as a single fit. Of all steps the one of highest
macro-F1 on a model's own check rows stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.rng import SEED, draw, stratified_folds
from plumbline.functions.tables import dropped, written
from plumbline.operators import duplicates, pooling

#: Numbers of a block at most, and models side by side.
NUMBERS, MOST_MODELS = 1 << 21, 62
STEPS, RATE, DECAY = 60, 0.05, 1e-4
#: A tenth of the rows that a fold's model may see picks its step.
CHECK_SHARE = 10

Compute = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Blocks:
    """Packed rows: a kept table of x, y, n, fit, check (bytes), its partitions and where it is written."""

    table: DataFrame
    parts: int
    path: str

    def release(self) -> None:
        self.table.unpersist()
        dropped(self.table.sparkSession, self.path)


def packed(rows: DataFrame) -> Blocks:
    """rows: x (array<double>, of one length), y, n (how often the row counts), fit, check (bits of models)."""
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            rest = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("y", "n", "fit", "check")]
            step = max(1, NUMBERS // max(x.shape[1], 1))
            for a in range(0, len(x), step):
                columns = [x[a : a + step].astype("<f8"), *(c[a : a + step] for c in rest)]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["x", "y", "n", "fit", "check"])

    cast = [F.col("x").cast("array<double>").alias("x"), *(F.col(c).cast("long").alias(c) for c in ("y", "n", "fit", "check"))]
    table, path = written(rows.select(*cast).mapInArrow(run, "x binary, y binary, n binary, fit binary, check binary"))
    # no more tasks a step than there are blocks
    parts = max(1, min(2 * spark.sparkContext.defaultParallelism, table.count()))
    return Blocks(table.repartition(parts).persist(), parts, path)


def _total(blocks: Blocks, compute: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum of compute(x, y, n, fit, check) over all blocks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x, *rest in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "fit", "check")), strict=True):
                whole = [np.frombuffer(r, np.int64) for r in rest]
                part = compute(np.frombuffer(x, "<f8").reshape(len(whole[0]), -1), *whole)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.frombuffer(s) for batch in batches for s in batch.column(0).to_pylist()]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(sums, axis=0).tobytes()], pa.binary())], names=["s"])

    made = blocks.table.mapInArrow(each, "s binary")
    if blocks.parts > 64:
        made = made.repartition(int(blocks.parts**0.5)).mapInArrow(add, "s binary")
    return np.sum([np.frombuffer(r["s"]) for r in made.collect()], axis=0)


def _macro_f1(cells: np.ndarray) -> np.ndarray:
    """Macro-F1 of models x k x k cells (truth, prediction)."""
    hit = np.einsum("mii->mi", cells)
    both = cells.sum(axis=1) + cells.sum(axis=2)
    return np.where(both > 0, 2 * hit / np.maximum(both, 1e-12), 0.0).mean(axis=1)


def descend(blocks: Blocks, theta: np.ndarray, compute: Compute, k: int, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, macro-F1 on check rows) of models x size parameters. compute gives models x (size gradients, k * k cells), flat."""
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    best, kept = np.full(len(theta), -1.0), theta.copy()
    for step in range(steps + 1):
        out = _total(blocks, partial(compute, theta)).reshape(len(theta), -1)
        f1 = _macro_f1(out[:, theta.shape[1] :].reshape(len(theta), k, k))
        better = f1 > best + 1e-12
        best[better], kept[better] = f1[better], theta[better]
        if step == steps:
            break
        g = out[:, : theta.shape[1]] + decay * theta
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - rate * (first / (1 - 0.9 ** (step + 1))) / (np.sqrt(second / (1 - 0.999 ** (step + 1))) + 1e-8)
    return kept, best


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@dataclass
class Classifier:
    """Standardisation and one or two layers; theta is W1, b1, W2, b2 (or W, b without a hidden layer), flat."""

    theta: np.ndarray
    mu: np.ndarray
    sd: np.ndarray
    k: int
    hidden: int | None

    def layers(self) -> list[np.ndarray]:
        d, out, at = len(self.mu), [], 0
        shapes = [(d, self.k), (self.k,)] if self.hidden is None else [(d, self.hidden), (self.hidden,), (self.hidden, self.k), (self.k,)]
        for s in shapes:
            n = int(np.prod(s))
            out.append(self.theta[at : at + n].reshape(s))
            at += n
        return out

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        z = (x - self.mu) / self.sd
        w = self.layers()
        if self.hidden is None:
            return z, None, z @ w[0] + w[1]
        a = np.maximum(z @ w[0] + w[1], 0)
        return z, a, a @ w[2] + w[3]

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of sum(weight * cross-entropy), flat like theta."""
        z, a, out = self.forward(x)
        d = np.exp(_log_softmax(out))
        d[np.arange(len(y)), y] -= 1
        d *= weight[:, None]
        if a is None:
            return np.concatenate([(z.T @ d).ravel(), d.sum(axis=0)])
        back = (d @ self.layers()[2].T) * (a > 0)
        return np.concatenate([(z.T @ back).ravel(), back.sum(axis=0), (a.T @ d).ravel(), d.sum(axis=0)])


def _cells(y: np.ndarray, pred: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    return np.bincount(y * k + pred, n, k * k)


def fit(rows: DataFrame, k: int, models: int = 1, hidden: int | None = None, class_weighted: bool = True, standardise: bool = True, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, seed: int | list[int] = SEED) -> tuple[list[Classifier], list[float]]:
    """Models side by side, and their macro-F1 on check rows. rows: x, y, fit, check (bits of models); class weights are each model's own.

    seed: of the start, one for all models or one for each.
    """
    if models > MOST_MODELS:
        raise ValueError(f"{models} models side by side; {MOST_MODELS} at most")
    blocks = packed(rows.withColumn("n", F.lit(1)))

    def counted(x: np.ndarray, y: np.ndarray, n: np.ndarray, fits: np.ndarray, checks: np.ndarray) -> np.ndarray:
        out = []
        for m in range(models):
            mine = (fits >> m) & 1 == 1
            out.append(np.concatenate([np.bincount(y[mine], minlength=k), x[mine].sum(axis=0), (x[mine] ** 2).sum(axis=0)]))
        return np.concatenate(out)

    try:
        total = _total(blocks, counted)
        if not np.ndim(total):
            raise ValueError("no rows to learn from")
        stats = total.reshape(models, -1)
        sizes, (sums, squares) = stats[:, :k], np.split(stats[:, k:], 2, axis=1)
        n = np.maximum(sizes.sum(axis=1, keepdims=True), 1)
        mu = sums / n if standardise else np.zeros_like(sums)
        sd = np.maximum(np.sqrt(np.maximum(squares / n - (sums / n) ** 2, 0)), 1e-6) if standardise else np.ones_like(sums)
        weights = n / (k * np.maximum(sizes, 1)) if class_weighted else np.ones_like(sizes)
        wsum = np.maximum((weights * sizes).sum(axis=1), 1e-12)
        d = mu.shape[1]

        def start(seed: int) -> np.ndarray:
            g = np.random.default_rng(seed)
            uniform = lambda i, o: [g.uniform(-1, 1, i * o) / np.sqrt(i), g.uniform(-1, 1, o) / np.sqrt(i)]
            return np.concatenate(uniform(d, k) if hidden is None else [*uniform(d, hidden), *uniform(hidden, k)])

        starts = np.stack([start(s) for s in (seed if isinstance(seed, list) else [seed] * models)])

        def compute(theta: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, fits: np.ndarray, checks: np.ndarray) -> np.ndarray:
            out = []
            for m in range(models):
                model = Classifier(theta[m], mu[m], sd[m], k, hidden)
                mine, seen = (fits >> m) & 1 == 1, (checks >> m) & 1 == 1
                out.append(model.gradient(x[mine], y[mine], weights[m][y[mine]] / wsum[m]))
                out.append(_cells(y[seen], model.forward(x[seen])[2].argmax(axis=1), n[seen], k))
            return np.concatenate(out)

        theta, f1 = descend(blocks, starts, compute, k, steps, rate, decay)
    finally:
        blocks.release()
    return [Classifier(t, m, s, k, hidden) for t, m, s in zip(theta, mu, sd, strict=True)], f1.tolist()


def logits(models: list[Classifier], vec: Column, which: Column) -> Column:
    """Class scores of a row by the model of number `which`."""
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(x: pa.Array, m: pa.Array) -> pa.Array:
        z, m = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), m.to_numpy(zero_copy_only=False)
        out = np.zeros((len(z), models[0].k))
        for k in np.unique(m):
            out[m == k] = models[int(k)].forward(z[m == k])[2]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))

    return score(vec.cast("array<double>"), which.cast("long"))


def classifier(rows: DataFrame, k: int, **how) -> tuple[Classifier, float]:
    """One classifier and its val macro-F1. rows: vec, y, split."""
    bit = lambda s: F.when(F.col("split") == s, 1).otherwise(0)
    models, f1 = fit(rows.where("split IN ('train', 'val')").select(F.col("vec").alias("x"), "y", bit("train").alias("fit"), bit("val").alias("check")), k, **how)
    return models[0], f1[0]


def folds_of(rows: DataFrame, folds: int, groups: DataFrame | None = None, key: str = "item_id", seed: int = SEED) -> DataFrame:
    """key, fold: stratified by y; with groups (key, component) no group is parted. rows: key, y."""
    if groups is None:
        return stratified_folds(rows.select(key, "y"), "y", key, folds, seed).select(key, "fold")
    return duplicates.group_folds(groups, rows.select(key, "y"), folds, key).select(key, "fold")


def crossfit(rows: DataFrame, k: int, folds: int = 5, groups: DataFrame | None = None, key: str = "item_id", seed: int = SEED, **how) -> tuple[list[Classifier], DataFrame]:
    """(models, key, fold, logits): the full model and one per fold, and scores of every row, those of train and val by the model of
    their fold, which saw neither them nor (with groups) a row of their group; all others by the full model (fold null).

    A fold's model picks its step on a tenth of its own rows. rows: key, vec, y, split.
    """
    known = rows.where("split IN ('train', 'val')")
    dealt = folds_of(known, folds, groups, key, seed)
    placed = rows.join(dealt, key, "left")
    picked = lambda f: draw(seed, "check", f, F.col(key)) % CHECK_SHARE == 0
    role = lambda own, check: (F.when(own, 1).otherwise(0) + sum((F.when((F.col("fold") != f) & (picked(f) if check else ~picked(f)), 2 << f).otherwise(0) for f in range(folds)), F.lit(0)))
    taught = placed.where("fold IS NOT NULL").select(F.col("vec").alias("x"), "y", role(F.col("split") == "train", False).alias("fit"), role(F.col("split") == "val", True).alias("check"))
    models, _ = fit(taught, k, folds + 1, seed=seed, **how)
    return models, placed.select(key, "fold", logits(models, F.col("vec"), F.coalesce(F.col("fold") + 1, F.lit(0))).alias("logits"))


@dataclass
class Policy:
    """A linear decision policy: free weights on class probabilities, confidence and affect; a class's own rule adds evidence, never takes it."""

    free: np.ndarray  # classes x (classes + 1 + affect)
    bias: np.ndarray
    fired: np.ndarray
    trusted: np.ndarray
    precision: np.ndarray
    f1: float = 0.0

    def own(self) -> np.ndarray:
        """What a class's score gains when its rule has fired."""
        return np.maximum(self.fired, 0) + np.maximum(self.trusted, 0) * self.precision

    def change(self, probs: Column, fired: Column, affect: Column | None = None) -> Column:
        """What the policy adds to each class's logit."""
        k = len(self.bias)
        padded = np.concatenate([self.free[:, : k + 1], np.zeros((k, 2 * k)), self.free[:, k + 1 :]], axis=1)
        state = pooling.policy_state(probs, fired, self.precision.tolist(), affect)
        return pooling.linear_policy(state, fired, padded.tolist(), self.bias.tolist(), self.own().tolist())


def learned_policy(rows: DataFrame, k: int, precision: list[float], entropy: float = 0.01, penalty: float = 0.0, steps: int = 150, rate: float = RATE) -> Policy:
    """The policy of greatest expected reward: a class-balanced point for a right decision, less `penalty` for leaving the classifier's,
    and `entropy` times the decision's entropy.

    The gradient is the policy gradient in expectation over decisions, so none is drawn. It starts at no change. rows: logits, fired
    (booleans by class), affect (an array, or no such column), y, split; rows of equal state are counted once for all.
    """
    affect = F.col("affect").cast("array<double>") if "affect" in rows.columns else F.array().cast("array<double>")
    state = F.concat(F.col("logits").cast("array<double>"), F.transform("fired", lambda f: f.cast("double")), affect)
    known = rows.where("split IN ('train', 'val')").select(state.alias("x"), "y", (F.col("split") == "train").cast("int").alias("fit"), (F.col("split") == "val").cast("int").alias("check"))
    blocks = packed(known.groupBy("x", "y", "fit", "check").agg(F.count("*").alias("n")))
    prec = np.asarray(precision, float)

    def parts(theta: np.ndarray, x: np.ndarray) -> tuple:
        z, fired, more = x[:, :k], x[:, k : 2 * k], x[:, 2 * k :]
        p = np.exp(_log_softmax(z))
        seen = np.concatenate([p, p.max(axis=1, keepdims=True), more], axis=1)
        f = seen.shape[1]
        free, bias, own, trust = theta[: k * f].reshape(k, f), theta[k * f : k * f + k], theta[k * f + k : k * f + 2 * k], theta[k * f + 2 * k :]
        moved = z + seen @ free.T + bias + fired * (np.maximum(own, 0) + np.maximum(trust, 0) * prec)
        return z, fired, seen, moved, own, trust

    try:
        sizes = _total(blocks, lambda x, y, n, fits, checks: np.concatenate([np.bincount(y[fits == 1], n[fits == 1], k), [x.shape[1] * len(x), len(x)]]))
        width = round(sizes[-2] / sizes[-1]) - 2 * k + k + 1
        sizes = sizes[:k]
        weights, total = sizes.sum() / (k * np.maximum(sizes, 1)), max(sizes.sum(), 1.0)

        def compute(theta: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, fits: np.ndarray, checks: np.ndarray) -> np.ndarray:
            z, fired, seen, moved, own, trust = parts(theta[0], x)
            logp = _log_softmax(moved)
            p = np.exp(logp)
            right = np.zeros_like(p)
            right[np.arange(len(y)), y] = weights[y]
            stay = np.zeros_like(p)
            stay[np.arange(len(y)), z.argmax(axis=1)] = penalty
            gain = right + stay - entropy * logp
            # the gradient of an expected value under softmax: each decision's gain over the mean gain
            d = p * (gain - (p * gain).sum(axis=1, keepdims=True))
            d = -d * (n * (fits == 1))[:, None] / total
            on = (fired * d).sum(axis=0)
            gradient = np.concatenate([(d.T @ seen).ravel(), d.sum(axis=0), on * (own > 0), on * prec * (trust > 0)])
            held = checks == 1
            return np.concatenate([gradient, _cells(y[held], moved[held].argmax(axis=1), n[held], k)])

        start = np.concatenate([np.zeros(k * width + k), np.full(2 * k, 0.01)])
        theta, f1 = descend(blocks, start[None, :], compute, k, steps, rate, 0.0)
    finally:
        blocks.release()
    theta = theta[0]
    at = k * width
    return Policy(theta[:at].reshape(k, width), theta[at : at + k], theta[at + k : at + 2 * k], theta[at + 2 * k :], prec, float(f1[0]))
