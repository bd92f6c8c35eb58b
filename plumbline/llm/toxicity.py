"""Toxicity by weak supervision.

Many voters look at a text: lexicons of insults, contempt, threats and abuse in
four languages, patterns (a second person beside an insult, shouting), and
lexicons mined from labelled rows, in parts. A generative label model, fitted
by EM over the counts of all documents' vote patterns, estimates the prior, each
voter's accuracy in either class and the correlations between voters: given the
class, votes depend on each other along a tree that is estimated too. Labelled
rows hold their class fixed; nowhere else do labels count. The classifier is
linear over hashed words, word beginnings and the votes, and learns the label
model's posteriors of a bounded sample: at most `most` labelled documents and
`most` of all (MOST), by the least hashes of their ids.

Only rows whose crc32 of the id modulo 3 is not 1 teach labels or are in the
sample. Scores depend on the text alone. Null and empty texts get the bias.
Very long texts are read whole, one at a time. Repeated rows and ties are scored
each, equal texts alike. Without any label in one of the classes the score is a
constant (the least share of toxic rows that counts, about 0) and no row is
rejected. An empty table gives an empty result. Other columns stay; one that has
the score's name, in any case, is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import added, crc_mod3, fresh, giving_back
from plumbline.llm.features import UNIT, Keys, design, feature_counts, fit_logistic, letter_features, presence, sample_of, select, strongest, word_key
from plumbline.llm.words import SPACE, chunks, spans

#: Labelled rows that the mined lexicons and the classifier learn from, at most; and rows of all documents that the classifier learns from besides.
MOST = 5000
#: Features of the classifier, and words of the mined lexicons, at most.
WIDTH = 20_000
THRESHOLD = 0.7

#: Words that voters know.
LEXICONS: dict[str, str] = {
    "insult": "idiot idiots moron morons stupid dumb fool fools imbecile loser losers clown clowns dimwit halfwit cretin dunce jerk",
    "contempt": "pathetic worthless disgusting trash scum garbage vermin filth filthy vile repulsive despicable useless disgrace lowlife parasite parasites",
    "abuse": "bastard bitch damn crap asshole slut whore shit fuck fucking bullshit retard retarded freak freaks pig pigs",
    "threat": "kill murder destroy strangle beat shoot stab hang die exterminate burn",
    "french": "imbécile crétin débile stupide ordure déchet pathétique minable salaud connard abruti dégoûtant",
    "german": "dumm dummkopf vollidiot trottel abschaum müll widerlich erbärmlich wertlos arschloch versager",
    "spanish": "idiota imbécil estúpido basura escoria patético inútil asqueroso perdedor payaso tonto",
}
#: Second persons that make an insult a pattern.
SECOND_PERSONS = "you your youre tu toi du ihr usted eres"
MINED_PARTS = 5


@dataclass
class Voters:
    """Known words and the voters (as bits) that each is a hit for."""

    names: list[str]
    keys: Keys
    bits: np.ndarray
    insults: Keys
    persons: Keys

    def votes(self, found: list[tuple[np.ndarray, np.ndarray]], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One bit pattern per row of a chunk. found: what letter_features gives for it."""
        out = np.zeros(len(offsets) - 1, np.int64)
        for row, features in found:
            near, at = self.keys.find(features)
            np.bitwise_or.at(out, row[near], self.bits[at])
        rows, words = found[0]
        insult, _ = self.insults.find(words)
        person, _ = self.persons.find(words)
        near = np.zeros(len(words) + 4, bool)
        for step in (0, 1, 2):
            inside = person + step + 1 < len(words)
            place = person[inside] + step + 1
            near[place[rows[place] == rows[person[inside]]]] = True
        out[rows[insult[near[insult]]]] |= 1 << self.names.index("second person")
        upper = np.bincount(np.searchsorted(offsets, np.flatnonzero((data >= 65) & (data <= 90)), side="right") - 1, minlength=len(out))[: len(out)]
        bangs = np.bincount(np.searchsorted(offsets, np.flatnonzero(data == 33), side="right") - 1, minlength=len(out))[: len(out)]
        starts, _, first = spans(SPACE[data], offsets)
        words_in = np.maximum(np.diff(first), 1)
        shouting = (upper > 2 * words_in) & (bangs * 4 > words_in)
        out[shouting] |= 1 << self.names.index("shouting")
        return out

    def columns(self, votes: np.ndarray) -> np.ndarray:
        """Rows x voters, 0/1, of bit patterns."""
        return (np.asarray(votes, np.int64)[:, None] >> np.arange(len(self.names))) & 1


def make_voters(mined: np.ndarray) -> Voters:
    """The fixed voters and those of mined features (the best first), in parts of falling strength."""
    names = [*LEXICONS, "second person", "shouting", *(f"mined {k}" for k in range(MINED_PARTS))]
    bits: dict[int, int] = {}
    for name, words in LEXICONS.items():
        for word in words.split():
            bits[word_key(word)] = bits.get(word_key(word), 0) | 1 << names.index(name)
    for place, key in enumerate(mined.tolist()):
        bits[key] = bits.get(key, 0) | 1 << names.index(f"mined {place * MINED_PARTS // len(mined)}")
    keys = Keys(np.array(list(bits), np.uint64))
    insults = [word_key(w) for name in ("insult", "contempt", "abuse", "french", "german", "spanish") for w in LEXICONS[name].split()]
    return Voters(names, keys, np.array([bits[int(k)] for k in keys.keys], np.int64), Keys(np.array(insults, np.uint64)), Keys(np.array([word_key(w) for w in SECOND_PERSONS.split()], np.uint64)))


def mined(counted: DataFrame, share: float, least_hits: int = 3, least_odds: float = 2.5) -> np.ndarray:
    """Features whose smoothed log odds of the toxic class, less a standard error, over the base rate's reach `least_odds`. share: of toxic rows."""
    hits, rest = F.col("total") / UNIT, F.col("n") - F.col("total") / UNIT
    odds = F.log((hits + 0.5) / (rest + 0.5)) - float(np.log(share / (1 - share)))
    error = F.sqrt(1 / (hits + 0.5) + 1 / (rest + 0.5))
    return strongest(counted.where(hits >= least_hits), odds - error, least_odds, least_hits, WIDTH)


@dataclass
class LabelModel:
    """P(class) and, along a tree, P(vote | parent's vote, class)."""

    prior: float
    parent: np.ndarray
    table: np.ndarray  # voters x class x parent's vote: P(vote = 1)
    accuracy: np.ndarray  # voters x class: P(vote = 1 | class)
    correlation: np.ndarray  # voters x voters, of votes within classes

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1 | votes) for rows of 0/1 votes."""
        logs = np.log([1 - self.prior, self.prior])[None, :].repeat(len(votes), 0)
        for j, up in enumerate(self.parent):
            above = votes[:, up] if up >= 0 else np.zeros(len(votes), np.int64)
            p = self.table[j][:, above]
            logs += np.log(np.where(votes[:, j] == 1, p, 1 - p)).T
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -60, 60)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, known: np.ndarray, steps: int = 50, smooth: float = 0.5) -> LabelModel:
    """EM over distinct rows: `votes` 0/1, `counts` how many documents, `known` 0, 1 or -1 for a free class."""
    m = votes.shape[1]
    anyhow = votes.sum(axis=1)
    q = np.where(known >= 0, known, np.clip(0.05 + 0.3 * anyhow, 0, 0.95)).astype(float)
    model = None
    for step in range(steps):
        weight = np.stack([counts * (1 - q), counts * q])
        total = weight.sum(axis=1)
        prior = float(np.clip((total[1] + smooth) / (total.sum() + 2 * smooth), 1e-4, 1 - 1e-4))
        one = (weight @ votes + smooth) / (total[:, None] + 2 * smooth)
        both = np.einsum("cn,ni,nj->cij", weight, votes, votes)
        if model is None or step % 10 == 0:
            parent, correlation = _tree(both, weight @ votes, total)
        table = np.empty((m, 2, 2))
        for j, up in enumerate(parent):
            if up < 0:
                table[j] = one[:, j][:, None]
                continue
            ups = weight @ votes[:, up]
            table[j, :, 1] = (both[:, j, up] + smooth * one[:, j] * 2) / (ups + 2 * smooth)
            table[j, :, 0] = ((weight @ votes[:, j]) - both[:, j, up] + smooth * one[:, j] * 2) / (total - ups + 2 * smooth)
        model = LabelModel(prior, parent, np.clip(table, 1e-6, 1 - 1e-6), one, correlation)
        fresh = np.where(known >= 0, known, model.posterior(votes))
        change, q = np.abs(fresh - q).max(), fresh
        if change < 1e-9:
            break
    return model


def _tree(both: np.ndarray, ones: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents along the tree of most mutual information within classes, and the votes' correlations within classes."""
    m = both.shape[1]
    info, cov = np.zeros((m, m)), np.zeros((m, m))
    n = max(total.sum(), 1e-9)
    for c in range(2):
        if total[c] <= 0:
            continue
        p11 = both[c] / total[c]
        p = ones[c] / total[c]
        cov += (p11 - np.outer(p, p)) * total[c] / n
        for a, pa_ in ((1, p), (0, 1 - p)):
            for b, pb in ((1, p), (0, 1 - p)):
                joint = {(1, 1): p11, (1, 0): p[:, None] - p11, (0, 1): p[None, :] - p11, (0, 0): 1 - p[:, None] - p[None, :] + p11}[a, b]
                info += np.where(joint > 1e-12, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(np.outer(pa_, pb), 1e-12)), 0) * total[c] / n
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    parent = np.full(m, -1)
    inside, best, via = {0}, info[0].copy(), np.zeros(m, int)
    while len(inside) < m:
        j = max((j for j in range(m) if j not in inside), key=lambda j: (best[j], -j))
        parent[j] = via[j]
        inside.add(j)
        closer = info[j] > best
        via[closer], best[closer] = j, info[j][closer]
    return parent, cov / np.outer(spread, spread)


@dataclass
class Model:
    """A fitted scorer with its label model."""

    voters: Voters
    label_model: LabelModel | None
    keys: Keys
    weights: np.ndarray
    voter_weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for first, last, data, offsets in chunks(texts):
            found = list(letter_features(data, offsets))
            rows, places = presence(found, self.keys)
            votes = self.voters.columns(self.voters.votes(found, data, offsets))
            out[first:last] = np.bincount(rows, self.weights[places], last - first)[: last - first] + votes @ self.voter_weights + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def voted(rows: DataFrame, voters: Voters) -> DataFrame:
    """`rows` (with a column text) with `votes` for the text, one bit per voter."""
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "text"), T.StructField("votes", T.LongType())])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [voters.votes(list(letter_features(data, offsets)), data, offsets) for _, _, data, offsets in chunks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def vote_counts(docs: DataFrame, labels: DataFrame, voters: Voters, label: str, key: str, text: str) -> DataFrame:
    """Over all documents: votes, known class (-1 if not taught), and how many. At most 3 * 2**voters rows."""
    taught = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (crc_mod3(key) != 1)).groupBy(F.col(key).alias("id")).agg(F.max(F.col(label).cast("int")).alias("known"))
    return voted(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), voters).join(taught, "id", "left").groupBy("votes", F.coalesce("known", F.lit(-1)).alias("known")).count()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", most: int = MOST) -> Model:
    """Mines voters from a bounded sample, fits the label model over all documents' votes and the classifier on posteriors."""
    sample = sample_of(docs, labels, label, most, key, text, free=most)
    taught = sample.where("known IS NOT NULL")
    classes = {r["known"]: r["count"] for r in taught.groupBy("known").count().collect()}
    none = np.zeros(0, np.uint64)
    if len(classes) < 2:
        voters = make_voters(none)
        return Model(voters, None, Keys(none), np.zeros(0), np.zeros(len(voters.names)), float(np.log(1e-4)))
    voters = make_voters(mined(feature_counts(taught, lambda known, *_: known), classes.get(1, 0) / sum(classes.values())))
    counted = vote_counts(docs, labels, voters, label, key, text).orderBy("votes", "known").collect()
    label_model = fit_label_model(voters.columns([r["votes"] for r in counted]), np.array([r["count"] for r in counted], float), np.array([r["known"] for r in counted]))
    own = voters.columns(voted(sample.select("id", "text"), voters).toArrow().sort_by("id").column("votes").to_numpy())
    target = label_model.posterior(own)

    def posterior(_: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return label_model.posterior(voters.columns(voters.votes(list(letter_features(data, offsets)), data, offsets)))

    keys = Keys(select(feature_counts(sample, posterior), target, least_rows=4, z=3.5, most=WIDTH))
    _, rows, places = design(sample, keys)
    width = len(keys.keys)
    row, voter = np.nonzero(own)
    weights, bias = fit_logistic(np.concatenate([rows, row]), np.concatenate([places, width + voter]), target, width + len(voters.names))
    return Model(voters, label_model, keys, weights[:width], weights[width:], bias)


def score(docs: DataFrame, model: Model, text: str = "text", score_column: str = "score") -> DataFrame:
    """All rows and columns of `docs` with a score (replacing a column of that name)."""
    schema = added(docs, T.StructField(score_column, T.DoubleType(), False))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), pa.array(held.value.scores(batch.column(text)))], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", **how) -> DataFrame:
    """`docs` without the rows that score at least `threshold`."""
    name = fresh("_toxic_score", docs)
    return score(docs, fit(docs, labels, text=text, **how), text, name).where(F.col(name) < threshold).drop(name)
