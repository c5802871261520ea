"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lowered, everything but its letters becomes a single space, and its
n-grams of one to four code points are hashed.  Term frequencies are weighed
with inverse document frequencies over all learning documents and brought to
unit length.  Weights are trained by follow-the-regularised-leader with
elastic-net penalties on a bounded sample for each language; a part of the
sample is kept aside to choose the temperature that calibrates probabilities.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import literal_rows, utf8_batches, written
from tessella.llm.ftrl import FTRL

BITS = 15
UNKNOWN = "und"
MAX_LANGUAGES = 1000
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Fit:
    #: expected number of documents of each language in the sample: the only rows weights are fitted on
    sample: int = 700
    aside: float = 0.25
    epochs: int = 3
    alpha: float = 2.0
    l1: float = 0.02
    l2: float = 0.01
    seed: int = 5


def has_letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text (distinct, sorted) and how often each occurs."""
    clean = " " + " ".join(_WORDS.findall(text.lower())) + " "
    c = np.frombuffer(clean.encode("utf-32-le"), np.uint32)
    counts = np.zeros(1 << BITS, np.int64)
    h = c * np.uint32(0x9E3779B1)
    for n in range(1, 5):
        if n > 1:
            if len(c) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n - 1 :] * np.uint32(0x9E3779B1)
        mixed = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) + np.uint32(n)
        counts += np.bincount(mixed >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (features, languages)
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return (x / max(1e-9, float(np.sqrt(x @ x)))).astype(np.float32)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(at, counts) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letters(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(*ngrams(text)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def _document_frequencies(learn: DataFrame) -> tuple[np.ndarray, int]:
    """Over all learning documents: per hash value, and their number."""

    def count(batches):
        seen, n = np.zeros(1 << BITS, np.int64), 0
        for (texts,) in utf8_batches(batches, ["text"]):
            for text in texts:
                if has_letters(text):
                    seen[ngrams(text)[0]] += 1
                    n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["h", "n"])

    rows = learn.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()  # 2**BITS rows at most
    df, n = np.zeros(1 << BITS), 0
    for h, k in rows:
        if h < 0:
            n = k
        else:
            df[h] = k
    return df, n


def train(learn: DataFrame, how: Fit = Fit()) -> Model:
    """From (doc_id, text, lang), lang not null.  No documents give a model that knows no language; more than MAX_LANGUAGES languages raise ValueError."""
    spark = learn.sparkSession
    learn = learn.select("doc_id", "text", "lang")
    per = learn.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(per) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in per)
    df, n = _document_frequencies(learn)
    idf = np.log((1 + n) / (1 + df)) + 0.05
    model = Model(languages, idf, np.zeros((1 << BITS, len(languages)), np.float32), np.zeros(len(languages), np.float32))
    shares = literal_rows(spark, [{"of": r["lang"], "share": min(1.0, how.sample / r["n"])} for r in per], "of string, share double")
    drawn = F.pmod(F.xxhash64(F.lit(how.seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = learn.join(F.broadcast(shares), F.col("lang") == F.col("of")).where(drawn < F.col("share"))  # a row a language is sent

    def rows(batches):
        for keys, texts, langs in utf8_batches(batches, ["doc_id", "text", "lang"]):
            out = [(k, lang, *ngrams(t)) for k, t, lang in zip(keys, texts, langs) if has_letters(t)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in out], pa.int64()),
                        pa.array([r[1] for r in out], pa.string()),
                        pa.array([r[2].astype("<u2").tobytes() for r in out], pa.binary()),
                        pa.array([r[3].astype("<u4").tobytes() for r in out], pa.binary()),
                    ],
                    ["doc_id", "lang", "at", "counts"],
                )

    kind = "doc_id long, lang string, at binary, counts binary"
    got = written(sample.select("doc_id", "text", "lang").mapInArrow(rows, kind), "language-sample").collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["lang"], bytes(r["at"]), bytes(r["counts"])) for r in got)
    data = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(c, "<u4").astype(np.float64), languages.index(lang)) for _, _, lang, a, c in got]
    if len(data) and len(languages) > 1:
        _descend(model, data, how)
    return model


def _descend(model: Model, data: list, how: Fit) -> None:
    rng = np.random.default_rng(how.seed)
    order = rng.permutation(len(data))
    aside = order[: int(len(data) * how.aside)] if len(data) >= 40 else order
    fitted = order[len(aside) :] if len(data) >= 40 else order
    k = len(model.languages)
    learner, bias = FTRL(model.weights.shape, how.alpha, 1.0, how.l1, how.l2), FTRL((1, k), how.alpha / 10)
    only = np.array([0])
    for _ in range(how.epochs):
        for j in rng.permutation(fitted):
            at, counts, y = data[j]
            x = model.vector(at, counts)
            w, b = learner.weights(at), bias.weights(only)
            g = _softmax(x @ w + b[0]).astype(np.float32)
            g[y] -= 1
            learner.step(at, x[:, None] * g, w)
            bias.step(only, g[None, :], b)
    model.weights, model.bias = learner.weights(), bias.weights()[0]
    logits = np.array([model.logits(data[j][0], data[j][1]) for j in aside])
    truth = np.array([data[j][2] for j in aside])

    def loss(temperature: float) -> float:
        x = logits / temperature
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), truth]).mean())

    lo, hi = np.log(0.05), np.log(20.0)
    for _ in range(60):  # the loss is unimodal in the logarithm of the temperature
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, hi)
    model.temperature = float(np.exp((lo + hi) / 2))


def identify(docs: DataFrame, learn: DataFrame, how: Fit = Fit()) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs (doc_id, text), by a model of learn (doc_id, text, lang).

    Only the text is an input of a prediction.  A null text, or one without
    letters, is `und` with score 0, as is every text when nothing was learned.
    score is the calibrated probability of the predicted language.  Ties go to
    the language that sorts first.  Repeated rows are predicted each; an
    empty table gives no rows.  Other columns of docs and learn may have any
    names and are not read.  More than MAX_LANGUAGES languages raise
    ValueError.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(learn, how))  # 4 bytes a hash value and language

    def predict(batches):
        model = sent.value
        for keys, texts in utf8_batches(batches, ["doc_id", "text"]):
            langs, scores = zip(*map(model.predict, texts))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
