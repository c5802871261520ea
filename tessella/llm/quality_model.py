"""Quality by ordinal cumulative-link regression on graded ratings.

Grades are ordered classes 0..K-1.  One latent score f(x) = w.x over hashed
text features is shared by all grades, and P(grade <= k) = sigmoid(t_k - f)
with ordered thresholds t_0 < t_1 < ...: the sum of the tails is the expected
grade, and the last tail is the probability of the best grade, by which
documents are selected.

Features are presences of hashed words, word beginnings and style marks
(shares of symbols, capitals, repeated words and the like, in bins) of the
whole text.  Those are used whose score test against some tail of the grades
is significant in a bounded sample of labelled documents; their weights and
the thresholds minimise the sample's elastic-net likelihood by full-batch
steps.  A text is scored by its words' few active features, which workers
remember by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import fsum, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import tidy, utf8_batches, written

BITS = 20
BEGINNINGS = (3, 4, 5, 6)
#: Words that a worker remembers at once; longer words are never remembered.
REMEMBERED, REMEMBERED_CHARS = 200_000, 40
#: Documents whose features are summed at once in a step of the fit.
PART = 1024
_LETTERS = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]\\^~=_@]")
_CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]")


@dataclass(frozen=True)
class Fit:
    #: expected number of labelled documents in the sample: the only rows the model is fitted on
    sample: int = 12_000
    #: standard deviations of the score test, and documents, that a feature needs
    least_z: float = 4.0
    least_documents: int = 3
    steps: int = 300
    rate: float = 0.1
    l1: float = 1.0
    l2: float = 0.1
    seed: int = 11


def _hash(name: str) -> int:
    return crc32(name.encode()) & ((1 << BITS) - 1)


def _bin(x: float) -> int:
    """Shares in powers of two: 0 for none, to 12."""
    return 0 if x <= 0 else max(1, min(12, 10 + int(log(x, 2))))


def _of_word(word: str) -> set[int]:
    return {_hash(word), *(_hash(f"p:{word[:n]}") for n in BEGINNINGS if len(word) >= n)}


def _style(text: str, words: list[str]) -> set[int]:
    raw = text.split()
    n, chars = max(1, len(raw)), max(1, len(text))
    lines = [line for line in text.split("\n") if line.strip()]
    letters = max(1, sum(map(len, words)))
    style = (
        ("sym", _bin(len(_SYMBOLS.findall(text)) / n)),
        ("cap", _bin(len(_CAPITALS.findall(text)) / letters)),
        ("bang", _bin(text.count("!") / n)),
        ("bar", _bin(text.count("|") / n)),
        ("digit", _bin(sum(map(text.count, "0123456789")) / chars)),
        ("rep", _bin(1 - len(set(raw)) / n)),
        ("rep10", int(10 * (1 - len(set(raw)) / n))),
        ("dup", _bin(1 - len(set(lines)) / max(1, len(lines)))),
        ("len", int(log(n, 2))),
        ("wl", min(20, int(letters / max(1, len(words))))),
    )
    return {_hash(f"s:{k}:{v}") for k, v in style}


def features(text: str) -> np.ndarray:
    """Distinct hashed features of a whole text, sorted."""
    words = _LETTERS.findall(text.lower())
    found = _style(text, words)
    for w in set(words):
        found |= _of_word(w)
    return np.array(sorted(found), np.uint32)


@dataclass
class Model:
    #: by feature, those that have one; None: nothing was labelled
    weights: dict[int, float] | None
    thresholds: tuple[float, ...] = (0.0,)

    def tails(self, score: Column) -> list[Column]:
        """P(grade > k) for k = 0..K-2."""
        return [1 / (1 + F.exp(F.lit(t) - score)) for t in self.thresholds]


class Scorer:
    """score(text): the latent score of a whole text."""

    def __init__(self, weights: dict[int, float]):
        self.weights = weights
        self._active: dict[str, tuple[int, ...]] = {}

    def score(self, text: str) -> float:
        words = _LETTERS.findall(text.lower())
        found = {h for h in _style(text, words) if h in self.weights}
        for w in set(words):
            active = self._active.get(w)
            if active is None:
                active = tuple(h for h in _of_word(w) if h in self.weights)
                if len(w) <= REMEMBERED_CHARS:
                    if len(self._active) >= REMEMBERED:
                        self._active.clear()
                    self._active[w] = active
            found.update(active)
        return fsum(self.weights[h] for h in found)


def significant(counts: np.ndarray, sizes: np.ndarray, how: Fit) -> np.ndarray:
    """Features whose score test against a tail of the grades is significant.

    counts: (grades, features) documents of each grade that have the feature; sizes: documents of each grade.
    """
    n, df = sizes.sum(), counts.sum(axis=0)
    keep = np.zeros(counts.shape[1], bool)
    for k in range(len(sizes) - 1):
        p = sizes[k + 1 :].sum() / n
        score = counts[k + 1 :].sum(axis=0) - p * df
        keep |= np.abs(score) > how.least_z * np.sqrt(p * (1 - p) * df * (1 - df / n)) + 1e-9
    return np.flatnonzero(keep & (df >= how.least_documents))


def fit(rows: list[tuple[int, np.ndarray]], ids: np.ndarray, grades: int, how: Fit) -> Model:
    """A model of (grade, positions in ids) rows; ids are the features that may have a weight."""
    if not rows:
        return Model(None, tuple(float(k) for k in range(grades - 1)))
    g = np.array([k for k, _ in rows])
    n, m = len(rows), len(ids)
    parts = [rows[k : k + PART] for k in range(0, n, PART)]
    # row and column of each present feature, in parts: a step's temporaries are of a part's size
    cells = [(np.repeat(np.arange(len(p), dtype=np.int32), [len(x) for _, x in p]), np.concatenate([x for _, x in p]).astype(np.int32)) for p in parts]
    below = np.cumsum(np.bincount(g, minlength=grades) + 1.0)
    below = below[:-1] / below[-1]
    at = np.concatenate([np.zeros(m), np.log(below / (1 - below))])
    mean, square = np.zeros_like(at), np.zeros_like(at)
    has_upper, has_lower = g < grades - 1, g > 0
    upper, lower = np.minimum(g, grades - 2), np.maximum(g - 1, 0)

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))

    for step in range(how.steps):
        w, t = at[:m], at[m:]
        f = np.concatenate([np.bincount(row, weights=w[col], minlength=len(p)) for p, (row, col) in zip(parts, cells)])
        a = np.where(has_upper, sigmoid(t[upper] - f), 1.0)
        b = np.where(has_lower, sigmoid(t[lower] - f), 0.0)
        p = np.maximum(a - b, 1e-9)
        slope = how.l2 * w + how.l1 * np.sign(w)
        for k, (row, col) in enumerate(cells):
            slope += np.bincount(col, weights=(1 - a - b)[k * PART : (k + 1) * PART][row], minlength=m)
        tilt = np.bincount(lower, weights=has_lower * b * (1 - b) / p, minlength=grades - 1)
        tilt -= np.bincount(upper, weights=has_upper * a * (1 - a) / p, minlength=grades - 1)
        gradient = np.concatenate([slope, tilt]) / n
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient * gradient
        rate = how.rate * (1 - step / how.steps)
        at = at - rate * (mean / (1 - 0.9 ** (step + 1))) / (np.sqrt(square / (1 - 0.999 ** (step + 1))) + 1e-8)
        at[m:] = np.maximum.accumulate(at[m:] + 1e-3 * np.arange(grades - 1)) - 1e-3 * np.arange(grades - 1)
    return Model({int(h): float(x) for h, x in zip(ids, at[:m])}, tuple(map(float, at[m:])))


def train(docs: DataFrame, ratings: DataFrame, grades: int, how: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """ratings: (id, grade), one row a document.  The sample is a hash range of ids whose width follows from their number."""
    ratings = ratings.toDF("id", "grade").where("id is not null and grade is not null")
    n = ratings.count()
    share = int(min(1.0, how.sample / max(1, n)) * (1 << 30))
    sampled = ratings.where(F.pmod(F.xxhash64(F.lit(how.seed), "id"), F.lit(1 << 30)) < share)
    sampled = written(sampled.withColumn("grade", F.col("grade").cast("int")), "rated")

    def rated(batches):
        for ids, texts, given in utf8_batches(batches, ["id", "text", "grade"]):
            data = [features(t or "").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(given, pa.int32()), pa.array(data, pa.binary())], ["id", "grade", "features"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # about how.sample rows of two numbers are sent
    joined = texts.join(F.broadcast(sampled), "id").select("id", "text", "grade")
    known = written(joined.mapInArrow(rated, "id long, grade int, features binary"), "rated-features")
    # one task fits the model: the sample is bounded, and the driver sees the weights only
    fitted = written(known.coalesce(1).mapInArrow(lambda batches: _fitted(batches, grades, how), "feature long, weight double"), "model").collect()
    tidy(docs.sparkSession)
    weights = {r["feature"]: r["weight"] for r in fitted if r["feature"] >= 0}
    thresholds = sorted((-1 - r["feature"], r["weight"]) for r in fitted if r["feature"] < 0)
    if not thresholds:
        return fit([], np.zeros(0, np.int64), grades, how)
    return Model(weights, tuple(t for _, t in thresholds))


def _fitted(batches: Iterator[pa.RecordBatch], grades: int, how: Fit) -> Iterator[pa.RecordBatch]:
    """Of the whole sample (id, grade, features): rows (feature, weight), and thresholds as features -1, -2, ...; no rows of a sample of none."""
    rows = sorted((i, g, x) for parts in utf8_batches(batches, ["id", "grade", "features"]) for i, g, x in zip(*parts))
    if not rows:
        return
    counts, sizes = np.zeros((grades, 1 << BITS), np.int32), np.zeros(grades, np.int64)
    for _, g, x in rows:
        counts[g, np.frombuffer(x, np.uint32)] += 1
        sizes[g] += 1
    ids = significant(counts, sizes, how)
    place = np.full(1 << BITS, -1, np.int32)
    place[ids] = np.arange(len(ids))
    known = []
    for _, g, x in rows:
        at = place[np.frombuffer(x, np.uint32)]
        known.append((g, at[at >= 0]))
    model = fit(known, ids, grades, how)
    features = [*model.weights, *(-1 - k for k in range(len(model.thresholds)))]
    yield pa.RecordBatch.from_arrays([pa.array(features, pa.int64()), pa.array([*model.weights.values(), *model.thresholds], pa.float64())], ["feature", "weight"])


def scorer(docs: DataFrame, model: Model):
    """A function of a text column: the latent score of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model.weights)  # at most a weight a hash value

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = sent.value
        of = Scorer(weights).score if weights is not None else lambda text: 35.0
        for texts in parts:
            # a few texts at a time as Python strings: a batch may be of many long ones
            scores = [of(t or "") for at in range(0, len(texts), 64) for t in texts.slice(at, 64).to_pylist()]
            yield pa.array(scores, pa.float64())

    return score


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, grade) of labels (quality, toxic): a point for good quality and one for being clean.

    A document's labels count together, as the worst of them; rows without
    quality count as none, and a null toxic as 0.
    """
    worst = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return worst.select("id", ((F.col("q") >= 1).cast("int") + (F.col("t") <= 0).cast("int")).alias("grade"))


def _has_text(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.75, how: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, expected_grade, tail_probability, kept) for each row of docs.

    tail_probability is that of the best grade; a document is kept when it is
    at least cut.  Texts without words (null, empty, separators) are not kept
    and have grade and probability 0.  Without labels every text with words
    is kept.  Repeated rows are scored each; an empty table gives no rows.
    """
    model = train(docs, graded(labels, id_col), 3, how, id_col, text_col)
    score = scorer(docs, model)
    scored = docs.select(F.col(id_col).alias("id"), _has_text(F.col(text_col)).alias("has"), score(F.col(text_col)).alias("score"))
    tails = model.tails(F.col("score"))
    return scored.select(
        F.col("id").alias(id_col),
        "score",
        F.when(F.col("has"), sum(tails[1:], tails[0])).otherwise(0.0).alias("expected_grade"),
        F.when(F.col("has"), tails[-1]).otherwise(0.0).alias("tail_probability"),
        (F.col("has") & (tails[-1] >= cut)).alias("kept"),
    )


def accepted(docs: DataFrame, labels: DataFrame, cut: float = 0.75, how: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that classify() keeps, their columns untouched; no row is moved."""
    model = train(docs, graded(labels, id_col), 3, how, id_col, text_col)
    score = scorer(docs, model)
    return docs.where(_has_text(docs[text_col]) & (model.tails(score(docs[text_col]))[-1] >= cut))
