"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each model sees the words of a document and the probabilities of the
categories before it. A later model is trained on out-of-fold probabilities, so it learns from them as they will be
on documents that no model has seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored

#: The chain: category, and the condition on a row of labels that makes it true.
CHAIN = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
#: Labelled rows to learn from at most (about), words that the models know at most, least z of a
#: word's share in a category, and documents of the sample that a known word is in.
SAMPLE, WORDS, LEAST_Z = 8_000, 400, 5.0
LEAST_DOCUMENTS = 5
FOLDS, STEPS, RATE, PENALTY = 5, 400, 0.1, 5e-5

_WORD = re.compile(r"[^\W\d_]+")
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_CLASS[65:91] = 2
_CLASS[10] = 3


def words(text: str) -> set[str]:
    """Different words in lower case: runs of letters."""
    return set(_WORD.findall(text.lower()))


def style(text: str) -> list[float]:
    """Shares of ASCII marks, capitals and line ends in the UTF-8 bytes, and the length, each about 0 to 1."""
    data = np.frombuffer(text.encode(), np.uint8)
    marks, capitals, ends = np.bincount(_CLASS[data], minlength=4)[1:4] / max(1, len(data))
    return [4 * marks, capitals, 50 * ends, np.log10(max(1, len(data))) / 6]


@dataclass
class Chain:
    """Categories, known words, weights (a column a category: words, style, earlier probabilities, constant), and
    each category's threshold."""

    categories: list[str]
    vocabulary: dict[str, int]
    weights: list[np.ndarray]
    thresholds: list[float]

    def predict(self, texts: list[str]) -> np.ndarray:
        x = rows([[self.vocabulary[w] for w in words(t) & self.vocabulary.keys()] for t in texts], [style(t) for t in texts], len(self.vocabulary))
        for w in self.weights:
            p = sigmoid(np.hstack([x, np.ones((len(x), 1))]) @ w)
            x = np.hstack([x, p[:, None]])
        return x[:, x.shape[1] - len(self.weights) :]


def rows(known: list[list[int]], styles: list[list[float]], many: int) -> np.ndarray:
    """A row a text: each of `many` known words as 0 or 1, then style."""
    out = np.zeros((len(known), many + 4))
    for i, (some, own) in enumerate(zip(known, styles, strict=True)):
        out[i, some] = 1
        out[i, many:] = own
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def linear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights, the constant last, by Adam on the whole set with an L2 penalty."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    y = y.astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    if not len(y):
        return w
    for k in range(1, STEPS + 1):
        g = x.T @ (sigmoid(x @ w) - y) / len(y) + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


def fit(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, categories: list[str], vocabulary: dict[str, int]) -> Chain:
    """x: a row a text, of rows(); labels: a column of 0 and 1 for each category, in the chain's order; fold: the
    fold that each row is dealt to, equal for equal texts, so that no copy of a text is learned from for its fold."""
    weights, thresholds = [], []
    for k in range(len(categories)):
        y = labels[:, k]
        out = np.zeros(len(x))
        for f in range(FOLDS):
            seen = fold != f
            w = linear(x[seen], y[seen])
            out[~seen] = sigmoid(np.hstack([x[~seen], np.ones((int((~seen).sum()), 1))]) @ w)
        weights.append(linear(x, y))
        tried = np.linspace(0.1, 0.9, 33)
        score = [2 * (y * (out >= t)).sum() / max(1, y.sum() + (out >= t).sum()) for t in tried]
        best = np.flatnonzero(np.array(score) >= max(score) - 1e-9)
        thresholds.append(float(tried[best].mean()))
        x = np.hstack([x, out[:, None]])
    return Chain(categories, vocabulary, weights, thresholds)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", chain: tuple = CHAIN) -> Chain | None:
    """A chain from labelled rows, about SAMPLE of them by a hash of the id; None where there are none.

    Rows without a text or with a null in a condition's column aren't learned from. Of a doc_id's clashing labels
    those that make a category true count; a doc_id with several texts lends its labels to each. Known words are the
    WORDS whose share of documents differs most between a category and the rest, counted and chosen in Spark; to the
    driver come, for each row of the sample, the known words that it has and its style, and no text.
    """
    names = [c for c, _ in chain]
    known = labels.select(F.col("doc_id").alias("__id"), *(F.expr(e).cast("int").alias(c) for c, e in chain)).dropna().groupBy("__id").agg(*(F.max(c).alias(c) for c in names))
    n = known.count()
    if not n:
        return None
    known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < min(1.0, SAMPLE / n) * (1 << 20))
    own = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).where("text is not null")
    some = own.join(known, "__id").select("text", F.xxhash64("text").alias("hash"), F.array(*names).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                texts = part["text"].to_pylist()
                yield pa.RecordBatch.from_arrays([part["hash"], part["y"], pa.array([sorted(words(t)) for t in texts], pa.list_(pa.string())), pa.array([style(t) for t in texts], pa.list_(pa.float64()))], names=["hash", "y", "words", "style"])

    some = stored(some.mapInArrow(run, "hash long, y array<int>, words array<string>, style array<double>"), "labelled")
    chosen = _vocabulary(some, len(names))
    vocabulary = {w: k for k, w in enumerate(chosen)}
    mine = F.array_intersect("words", F.array(*map(F.lit, chosen))) if chosen else F.array().cast("array<string>")
    got = sorted(some.select("hash", "y", "style", mine.alias("words")).collect(), key=lambda r: (r["hash"], r["y"]))
    if not got:
        return None
    x = rows([[vocabulary[w] for w in r["words"]] for r in got], [r["style"] for r in got], len(vocabulary))
    return fit(x, np.array([r["y"] for r in got], float), np.array([r["hash"] % FOLDS for r in got]), names, vocabulary)


def _vocabulary(some: DataFrame, categories: int) -> list[str]:
    """Words whose share differs between a category and the rest with |z| >= LEAST_Z, the surest first."""
    sums = lambda: [F.sum(F.col("y")[k]).cast("double").alias(f"s{k}") for k in range(categories)]
    whole = some.agg(F.count("*").alias("n"), *sums()).first()
    n = whole["n"]
    counts = some.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("c"), *sums()).where(F.col("c") >= LEAST_DOCUMENTS)
    share, size = F.col("c") / F.lit(float(max(1, n))), n / max(1, n - 1)

    def z(k: int):
        positive = whole[f"s{k}"] or 0.0
        spread = max(positive * (1 - positive / max(1, n)), 1e-9)
        return F.abs((F.col(f"s{k}") - positive * share) / F.sqrt(spread * share * (1 - share) * size + 1e-9))

    best = [z(k) for k in range(categories)]
    found = counts.select("word", F.greatest(*best).alias("z") if len(best) > 1 else best[0].alias("z")).where(F.col("z") >= LEAST_Z)
    return [r["word"] for r in found.orderBy(F.desc(F.round("z", 9)), "word").limit(WORDS).collect()]


def classify(docs: DataFrame, chain: Chain | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, p_<category>..., <category>...) for each row: the chain's probabilities and decisions.

    Null counts as empty. Without a chain probabilities are null and decisions false. Rows aren't joined or grouped;
    other columns aren't read.
    """
    names = chain.categories if chain else [c for c, _ in CHAIN]
    shipped = docs.sparkSession.sparkContext.broadcast(chain)
    schema = ", ".join(["doc_id long", *(f"p_{c} double" for c in names), *(f"{c} boolean" for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                if own is None:
                    columns = [pa.nulls(len(part), pa.float64())] * len(names) + [pa.array([False] * len(part))] * len(names)
                else:
                    p = own.predict([t or "" for t in part["text"].to_pylist()])
                    columns = [pa.array(x) for x in p.T] + [pa.array(x >= t) for x, t in zip(p.T, own.thresholds, strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
