"""Toxicity by weak supervision: voters, a label model and a linear classifier.

Voters look at the whole text and vote toxic or abstain: fixed lexicons, fixed patterns, and
words and word beginnings mined from the labelled sample. The given label is one more voter, and
silence of all others votes clean through the rates below. The label model is generative: a
class prior and, for each voter, the rate at which it votes in toxic and in clean documents,
fitted by expectation and maximisation. Voters that also vote together within a class (a word
and its beginning, say) are correlated; their correlations given the class are estimated from
the posterior and each voter's evidence is divided by the number of voters it amounts to. A
logistic regression over words and word beginnings is trained on the posterior labels, and
scores every document.

The fit uses at most ``SAMPLE`` labelled rows, those whose hashed ids are smallest. Labels,
languages, sources and ids are no features. Null and empty texts have no words; their score is
the classifier's intercept. Of repeated labels of one id a toxic one wins; labels without id or
value are skipped; without any usable label the score is 0. Repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import drop_state, kept, short_batches, whole

SAMPLE = 12_000
MINED = 300  # mined voters
FEATURES = 1_500  # features of the classifier
SUPPORT = 3
# least strength (root of a likelihood ratio) of a feature and of a mined voter
LEAST_FEATURE, LEAST_VOTER = 3.5, 5.0
PREFIXES = (4, 5, 6)

LEXICONS = {
    "insults_en": "idiot stupid moron loser pathetic worthless trash scum clown disgusting dumb fool jerk",
    "insults_de": "idiot dumm trottel versager abschaum widerlich wertlos erbärmlich arschloch",
    "insults_fr": "idiot stupide crétin minable ordure dégoûtant imbécile abruti connard",
    "insults_es": "idiota estúpido imbécil basura asqueroso patético escoria inútil payaso",
}
PATTERNS = {
    "you_are_a": r"\byou(?:'re| are) (?:an? |such )?(?:\w+ )?(?:idiot|moron|loser|clown|fool|trash)",
    "shouting": r"(?:\b[A-Z]{4,}\b[^\w]+){4,}",
    "masked": r"\b[a-z]+\*{2,}[a-z]*\b",
    "threat": r"\b(?:kill|hurt|destroy) (?:you|him|her|them)\b",
}
_WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str) -> set[str]:
    """Distinct words, and beginnings of words marked by a star."""
    words = set(_WORD.findall(text.lower()))
    out = set(words)
    for size in PREFIXES:
        out.update(w[:size] + "*" for w in words if len(w) >= size)
    return out


def fixed_votes(text: str) -> list[int]:
    words = set(_WORD.findall(text.lower()))
    votes = [int(not words.isdisjoint(lexicon.split())) for lexicon in LEXICONS.values()]
    return votes + [int(re.search(p, text) is not None) for p in PATTERNS.values()]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id is not held out."""
    rest = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))
    return F.coalesce(rest == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Text and label of at most ``rows`` documents that may be learned from."""
    known = (
        labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
        .where(F.col("toxic").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` pairs of numbers, so the broadcast is bounded
    joined = docs.select("doc_id", whole(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # rows that share an id count once, so that the bound holds for rows too
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("first")
    return joined.groupBy("doc_id").agg(first).select("first.text", "first.label")


def mine(sample: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """Features by signed strength and the number of clean and toxic rows.

    Each batch is counted on its own; counts of a feature meet by its name. Only features
    with at least ``SUPPORT`` rows, and of these the strongest, reach the driver.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(*(batch.column(c).to_pylist() for c in ("text", "label")), strict=True):
                counts[label].update(features_of(text))
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_pydict(
                {
                    "feature": pa.array(names, pa.string()),
                    "clean": pa.array([counts[0][n] for n in names], pa.int64()),
                    "toxic": pa.array([counts[1][n] for n in names], pa.int64()),
                }
            )

    sizes = np.zeros(2)
    for row in sample.groupBy("label").count().collect():
        sizes[row["label"]] = row["count"]
    if not sizes.all():
        return {}, sizes
    table = sample.mapInArrow(counted, "feature STRING, clean BIGINT, toxic BIGINT")
    table = table.groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    # root of the likelihood ratio of a feature and the class, with the sign of its direction
    share = sizes / sizes.sum()
    both = F.col("c") + F.col("t")

    def part(count: str, k: int) -> Column:
        seen = F.col(count)
        return F.when(seen > 0, seen * F.log(seen / (both * float(share[k])))).otherwise(0.0)

    side = F.when(F.col("t") > both * float(share[1]), 1.0).otherwise(-1.0)
    z = side * F.sqrt(F.greatest(2 * (part("c", 0) + part("t", 1)), F.lit(0.0)))
    strong = table.where(both >= SUPPORT).withColumn("z", z)
    best = strong.where(F.abs("z") > LEAST_FEATURE).orderBy(F.desc(F.abs("z")), "feature")
    return {r.feature: r.z for r in best.limit(FEATURES).collect()}, sizes


@dataclass
class LabelModel:
    """Class prior and voting rates of voters, with their correlations given the class.

    The first ``anchors`` voters are independent of the others (people, not lexicons).
    Correlations below ``noise`` count as none.
    """

    rounds: int = 30
    anchors: int = 1
    noise: float = 0.2
    prior: float = 0.5
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    clean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, votes: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Posterior of toxic for rows of votes (1 or 0); ``start`` is the first guess of it."""
        posterior = start
        for _ in range(self.rounds):
            total = posterior.sum()
            self.prior = float((total + 1) / (len(posterior) + 2))
            self.toxic = (posterior @ votes + 0.1) / (total + 0.2)
            self.clean = ((1 - posterior) @ votes + 0.1) / (len(posterior) - total + 0.2)
            self.weight = 1 / self.amounts(votes, posterior)
            after = self.posterior(votes)
            done = np.abs(after - posterior).max(initial=0) < 1e-4
            posterior = after
            if done:
                break
        return posterior

    def amounts(self, votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        """For each voter how many voters it amounts to: itself and its correlations."""
        # two tables of the size of the votes, not one for each step
        rest, work = posterior[:, None] * self.toxic, (1 - posterior)[:, None] * self.clean
        rest += work
        np.subtract(votes, rest, out=rest)
        spread = np.sqrt(np.multiply(rest, rest, out=work).sum(0)) + 1e-9
        rest /= spread
        correlation = rest.T @ rest
        np.fill_diagonal(correlation, 0)
        correlation[correlation < self.noise] = 0
        correlation[: self.anchors] = correlation[:, : self.anchors] = 0
        return correlation.sum(0) + 1

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        voted = np.log(self.toxic / self.clean)
        silent = np.log((1 - self.toxic) / (1 - self.clean))
        evidence = votes @ (self.weight * (voted - silent)) + (self.weight * silent).sum()
        return _sigmoid(np.log(self.prior / (1 - self.prior)) + evidence)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(
    rows: np.ndarray, columns: np.ndarray, size: int, posterior: np.ndarray, decay: float = 1e-4, steps: int = 300
) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels; cells (row, column) hold a one."""
    weights, momentum, second = (np.zeros(size + 1) for _ in range(3))
    weights[-1] = np.log((posterior.mean() + 1e-3) / (1 - posterior.mean() + 1e-3))
    for step in range(1, steps + 1):
        margin = weights[-1] + np.bincount(rows, weights[columns], len(posterior))
        error = (_sigmoid(margin) - posterior) / len(posterior)
        slope = np.append(np.bincount(columns, error[rows], size), error.sum())
        slope[:-1] += decay * weights[:-1]
        momentum = 0.9 * momentum + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        weights -= 0.1 * (momentum / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


@dataclass
class Classifier:
    weights: dict[str, float]
    intercept: float

    def score(self, text: str) -> float:
        get = self.weights.get
        total = self.intercept + sum(map(get, features_of(text) & self.weights.keys()))
        return float(_sigmoid(np.float64(total)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Classifier:
    short_batches(docs.sparkSession)
    sample = kept(labelled_sample(docs, labels, rows), "toxicity-sample")
    strength, _ = mine(sample)
    if not strength:
        return Classifier({}, -30.0)
    names = list(strength)
    number = {n: k for k, n in enumerate(names)}
    voters = sorted((n for n in names if strength[n] > LEAST_VOTER), key=lambda n: -strength[n])[:MINED]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [sorted(number[n] for n in features_of(t) & number.keys()) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "label": batch.column("label"),
                    "fixed": pa.array([fixed_votes(t) for t in texts], pa.list_(pa.int32())),
                    "found": pa.array(found, pa.list_(pa.int32())),
                }
            )

    table = sample.mapInArrow(cells, "label INT, fixed ARRAY<INT>, found ARRAY<INT>")
    # at most ``rows`` rows of at most ``FEATURES`` numbers
    read = table.orderBy("label", "fixed", "found").toArrow().combine_chunks()
    label = read.column("label").to_numpy().astype(float)
    found = read.column("found").combine_chunks()
    at = np.repeat(np.arange(len(label)), np.diff(found.offsets.to_numpy()))
    columns = found.flatten().to_numpy().astype(np.int64)
    fixed = read.column("fixed").combine_chunks().flatten().to_numpy().reshape(len(label), -1)
    place = np.full(len(names), -1)
    place[[number[n] for n in voters]] = np.arange(len(voters))
    mined = np.zeros((len(label), len(voters)))
    seen = place[columns] >= 0
    mined[at[seen], place[columns[seen]]] = 1
    votes = np.hstack([label[:, None], fixed.astype(float), mined])
    posterior = LabelModel().fit(votes, 0.05 + 0.9 * label)
    weights, intercept = fit_linear(at, columns, len(names), posterior)
    return Classifier({n: float(w) for n, w in zip(names, weights, strict=True) if w}, intercept)


def score(text: Column, model: Classifier) -> Column:
    """Score of a whole text, from 0 to 1; more means toxic is likelier."""

    @F.arrow_udf("DOUBLE")
    def run(texts: pa.Array) -> pa.Array:
        drop_state()
        return pa.array([model.score(t) for t in texts.to_pylist()], pa.float64())

    return run(whole(text))
