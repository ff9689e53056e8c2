"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte 2-, 3- and 4-grams within words, each hashed to a bucket; a linear
layer and a softmax follow. Both layers are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows; a temperature fitted on a validation part (0.25 at least, as that part may be without an error) calibrates the probability. The
threshold below which a text is rejected lies between its low tail on that part and its high tail on random letters. To predict, both layers fold into one table of a row a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import blocks, tidy, utf8

BUCKET_BITS, DIMENSIONS, GRAMS = 14, 12, (2, 3, 4)
#: Labelled rows to learn from: about SAMPLE in all, shared evenly by languages, but EACH of a language at least (or
#: all it has). Every language is learned.
SAMPLE, EACH = 2_000, 10
#: Numbers that a prediction holds at once: places in a text times languages.
CELLS = 1 << 22
#: Passes over the sample, or more where it is so small that there would be fewer steps than this.
EPOCHS, BATCH, RATE, LEAST_STEPS = 6, 32, 40.0, 400
#: Of validation texts with the right prediction so many score less than the clean bound, and of JUNK texts of random
#: letters so many more than the junk bound; the threshold is halfway between both in log-odds.
REJECTED, JUNK_ABOVE, JUNK = 0.001, 0.01, 300
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_CLASS = np.full(256, 32, np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def buckets(offsets: np.ndarray, data: np.ndarray) -> Iterator[np.ndarray]:
    """For each length of grams the bucket at each place of the rows laid out with a space before each and three
    at the end; the last bucket + 1 stands for no gram. Row i begins at offsets[i] + i."""
    rows = len(offsets) - 1
    laid = np.full(len(data) + rows + 3, 32, np.uint32)
    laid[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(offsets))] = _CLASS[data]
    end = len(data) + rows
    space = laid == 32
    gram = laid[:end].copy()
    for n in range(2, max(GRAMS) + 1):
        gram = gram * np.uint32(257) + laid[n - 1 : end + n - 1]
        if n in GRAMS:
            hashed = (gram * np.uint32(2654435761) ^ np.uint32(n * 0x1E3779B1)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BUCKET_BITS)
            none = space[:end] & space[1 : end + 1] if n == 2 else space[1 : end + 1].copy()
            for k in range(2, n - 1):
                none |= space[k : end + k]
            hashed[none] = 1 << BUCKET_BITS
            yield hashed


@dataclass
class Model:
    """Languages, log-odds by bucket (a zero row at the end), bias, temperature and rejection threshold."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        total, many = np.zeros((rows, len(self.languages))), np.zeros(rows)
        starts = offsets[:-1] + np.arange(rows)
        step = max(1, CELLS // len(self.languages))
        for hashed in buckets(offsets, data):
            many += np.add.reduceat((hashed < 1 << BUCKET_BITS).astype(np.float32), starts)
            for a in range(0, len(hashed), step):  # by parts, as a place has a number for each language
                first = int(np.searchsorted(starts, a, "right")) - 1
                last = int(np.searchsorted(starts, min(a + step, len(hashed)), "left"))
                cuts = np.maximum(starts[first:last] - a, 0)
                total[first:last] += np.add.reduceat(self.table[hashed[a : a + step]], cuts, axis=0)
        return softmax((total / np.maximum(many, 1)[:, None] + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], seed: int = 5) -> Model:
    """Trains on (buckets, counts) and labels; every fifth row is for validation."""
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    embed = rng.normal(0, 0.1, (size + 1, DIMENSIONS)).astype(np.float32)
    linear = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    order = rng.permutation(len(rows))
    held, used = order[::5], np.setdiff1d(order, order[::5]) if len(rows) >= 20 else order

    def batch(some: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]] = rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.concatenate([rows[i][0] for i in some])
        weight = np.concatenate([rows[i][1] / rows[i][1].sum() for i in some]).astype(np.float32)
        return at, weight, np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in some])[:-1]])

    def mean(at: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(embed[at] * weight[:, None], starts, axis=0)

    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(used))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        rng.shuffle(used)
        for k in range(0, len(used), BATCH):
            some = used[k : k + BATCH]
            at, weight, starts = batch(some)
            x = mean(at, weight, starts)
            slope = softmax(x @ linear + bias).astype(np.float32)
            slope[np.arange(len(some)), labels[some]] -= 1
            slope /= len(some)
            back = slope @ linear.T
            each = np.repeat(np.arange(len(some)), np.diff([*starts, len(at)]))
            np.add.at(embed, at, -rate * back[each] * weight[:, None])
            linear -= rate / 20 * (x.T @ slope)
            bias -= rate / 20 * slope.sum(axis=0)
    embed[size] = 0
    logits = np.concatenate([mean(*batch(held[k : k + 256])) @ linear + bias for k in range(0, len(held), 256)])
    losses = {t: -np.log(softmax(logits / t)[np.arange(len(held)), labels[held]] + 1e-12).mean() for t in np.geomspace(0.25, 5, 30)}
    temperature = min(losses, key=losses.get)
    p = softmax(logits.astype(np.float64) / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == labels[held]]
    junk = mean(*batch(np.arange(JUNK), random_letters(rng, JUNK))) @ linear + bias
    bound = np.quantile(softmax(junk.astype(np.float64) / temperature).max(axis=1), 1 - JUNK_ABOVE)
    threshold = halfway(float(np.quantile(right, REJECTED)), float(bound)) if len(right) else 0.0
    return Model(languages, (embed @ linear).astype(np.float32), bias, float(temperature), threshold)


def random_letters(rng: np.random.Generator, many: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of texts of random letters and spaces."""
    letters, out = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz    ", np.uint8), []
    for size in rng.integers(30, 300, many).tolist():
        full = np.bincount(np.concatenate(list(buckets(np.array([0, size]), rng.choice(letters, size)))), minlength=(1 << BUCKET_BITS) + 1)[:-1]
        out.append((np.flatnonzero(full), full[full > 0]))
    return out


def halfway(clean: float, junk: float) -> float:
    """The score halfway between both in log-odds; the clean one where junk scores as high."""
    if junk >= clean:
        return clean
    odds = [np.log(p) - np.log(max(1 - p, 1e-15)) for p in (clean, junk)]
    return float(1 / (1 + np.exp(-sum(odds) / 2)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = utf8(batch["text"])
        at, counts = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            hashed = np.concatenate(list(buckets(np.array([0, b - a]), data[a:b])))
            full = np.bincount(hashed, minlength=(1 << BUCKET_BITS) + 1)[:-1]
            at.append(np.flatnonzero(full).astype(np.int32))
            counts.append(full[at[-1]].astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(at, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["lang", "at", "counts"])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model from text and non-null lang of rows that aren't held out; None where there is none to learn from.

    Of each language about sample / languages rows are taken by a hash of id and text, so the sample doesn't depend
    on partitions; only their histograms of buckets come to the driver.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id))
    counts = rows.groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return None
    share = {r["lang"]: min(1.0, max(EACH, sample / len(counts)) / r["count"]) for r in counts}
    part = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[F.col(lang)]
    some = rows.where(F.pmod(F.xxhash64(doc_id, text), F.lit(1 << 20)) < part * (1 << 20)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    got = some.mapInArrow(tidy(_histograms), "lang string, at array<int>, counts array<int>").toArrow().combine_chunks()
    labels = got["lang"].to_pylist()
    at, counts = (got[c].combine_chunks() if isinstance(got[c], pa.ChunkedArray) else got[c] for c in ("at", "counts"))
    ends, at, counts = at.offsets.to_numpy(), at.values.to_numpy(), counts.values.to_numpy().astype(np.float32)
    found = [(lang, at[a:b], counts[a:b]) for lang, a, b in zip(labels, ends[:-1], ends[1:], strict=True) if b > a]
    found.sort(key=lambda g: (g[0], len(g[1]), g[1].tobytes(), g[2].tobytes()))
    if not found:
        return None
    languages = sorted({g[0] for g in found})
    return fit([(g[1], g[2]) for g in found], np.array([languages.index(g[0]) for g in found]), languages)


def _predicted(texts: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; "und" and 0 for null, for no letter, and without a model."""
    offsets, data = utf8(texts)
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return names, scores
    for a, b in blocks(offsets):
        p = model.probabilities(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
        best = p.argmax(axis=1)
        for i, t in enumerate(texts.slice(a, b - a).to_pylist()):
            if t is not None and _LETTER.search(t):
                names[a + i], scores[a + i] = model.languages[best[i]], p[i, best[i]]
    return names, scores


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for each row, from its text alone.

    lang_pred is "und" with score 0 for null texts, texts without a letter, and without a model; these and scores
    below the model's threshold are rejected. Null ids aren't held out. Rows aren't joined or grouped; other
    columns aren't read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            names, scores = _predicted(batch["text"], own)
            rejected = [n == UNKNOWN or bool(s < own.threshold) for n, s in zip(names, scores, strict=True)]
            columns = [batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return own.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of docs that aren't rejected, with their columns as they are; all without a model."""
    if model is None:
        return docs
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            names, scores = _predicted(batch.column(batch.schema.names.index(text)), own)
            yield batch.filter(pa.array([n != UNKNOWN and bool(s >= own.threshold) for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
