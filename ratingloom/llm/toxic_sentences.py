"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

Sentences (cut at . ! ? and line ends) have a logistic score over their words; a
document's score is the noisy-or of its sentences, 1 - prod(1 - p). The weights
are fitted from document labels alone, through the noisy-or, on a bounded sample
of labelled rows; the sentences that make a document toxic are then located.

The features of a word (a run of letters, lower-cased in A-Z) are itself and its
beginnings of 3 to 8 bytes, so inflected and compounded forms share them; each
is known by a 64-bit hash. The sample keeps those that clearly prefer toxic documents.

Defined results: a text without words (NULL, empty) has no sentence and scores 0;
repeated rows are scored each; without labels of both kinds every score is the
share of label 1 (0 without labels); columns beside those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm import textkernel as K
from ratingloom.llm.registry import given, query
from ratingloom.llm.sampling import bounded

#: Labelled rows the model is fitted on at most.
SAMPLE_ROWS = 8_000
#: Bytes of a word's beginnings that are features of it.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: A feature is kept if at least so many toxic documents have it, and so many standard deviations more than expected.
LEAST_DOCUMENTS, LEAST_SURPRISE = 4, 4.0
#: A weight must save about `LASSO` documents' worth of loss to leave zero; steps with that penalty, and then without it.
LASSO, STEPS, RATE = 0.3, (300, 200), 0.3
_STOPS = K.classes(b".!?\n")
_FILTER_BITS = 1 << 20


@dataclass
class Sentences:
    """Features of a slice by sentence: hash and sentence of each; of each sentence its text and its span."""

    hash: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def sentences(s: K.Slice) -> Sentences:
    w = K.words(s, K.LETTER_BYTES)
    if len(w.hash) == 0:
        none = np.zeros(0, np.int64)
        return Sentences(w.hash, none, none, none, none)
    key = np.cumsum(_STOPS[s.data], dtype=np.int32)[w.start]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (w.text[1:] != w.text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(key) - 1)
    number = np.cumsum(new) - 1
    hashes, places = [w.hash], [number]
    for size, begin in zip(BEGINNINGS, K.beginnings(s.data, w.start, w.end, BEGINNINGS), strict=True):
        longer = np.flatnonzero(w.end - w.start > size)
        hashes.append(begin[longer])
        places.append(number[longer])
    return Sentences(np.concatenate(hashes), np.concatenate(places), w.text[first], w.start[first], w.end[last])


@dataclass
class Model:
    """Weights of known words (hashes in order) and the bias of a sentence."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    constant: float | None = None

    def __post_init__(self) -> None:
        self.bits = np.zeros(_FILTER_BITS, bool)
        self.bits[(self.words & np.uint64(_FILTER_BITS - 1)).astype(np.int64)] = True

    def odds(self, found: Sentences) -> np.ndarray:
        """Log odds of every sentence."""
        z = np.full(len(found.text), self.bias)
        maybe = np.flatnonzero(self.bits[(found.hash & np.uint64(_FILTER_BITS - 1)).astype(np.int64)])
        if len(maybe) and len(self.words):
            h = found.hash[maybe]
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            z += np.bincount(found.sentence[maybe], weights=np.where(self.words[at] == h, self.weights[at], 0.0), minlength=len(z))
        return z

    def scores(self, found: Sentences, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Noisy-or of every text, and the log odds of the sentences."""
        z = self.odds(found)
        if self.constant is not None:
            return np.where(np.bincount(found.text, minlength=count) > 0, self.constant, 0.0), z
        return -np.expm1(-np.bincount(found.text, weights=np.logaddexp(0, z), minlength=count)), z


def _members(part: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are among the ordered features, and their numbers."""
    if len(features) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(features, part), len(features) - 1)
    found = np.flatnonzero(features[at] == part)
    return found, at[found]


def _documents(found: Sentences) -> np.ndarray:
    return found.text[found.sentence] if len(found.text) else found.sentence


def selected(texts: pa.Array, label: np.ndarray) -> np.ndarray:
    """Hashes, in order, of the features that clearly prefer toxic documents.

    Copies of one text count once, as all their words would agree by chance.
    """
    once = np.zeros(len(label), bool)
    seen: set[bytes] = set()
    toxic: list[np.ndarray] = []
    for s in K.slices(texts):
        for k in range(s.count):
            digest = hashlib.blake2b(s.text(k), digest_size=16).digest()
            once[s.first + k] = digest not in seen
            seen.add(digest)
    positive = once & (label > 0.5)
    for s in K.slices(texts.filter(pa.array(positive))):
        found = sentences(s)
        pairs = np.unique(np.stack((_documents(found).astype(np.uint64), found.hash)), axis=1) if len(found.hash) else np.zeros((2, 0), np.uint64)
        toxic.append(pairs[1])
    if not toxic:
        return np.zeros(0, np.uint64)
    features, plus = np.unique(np.concatenate(toxic), return_counts=True)
    features, plus = features[plus >= LEAST_DOCUMENTS], plus[plus >= LEAST_DOCUMENTS]
    minus = np.zeros(len(features), np.int64)
    for s in K.slices(texts.filter(pa.array(once & (label <= 0.5)))):
        found = sentences(s)
        at, number = _members(found.hash, features)
        pairs = np.unique(_documents(found)[at].astype(np.int64) * max(len(features), 1) + number)
        minus += np.bincount(pairs % max(len(features), 1), minlength=len(features))
    rate = positive.sum() / max(once.sum(), 1)
    total = plus + minus
    return features[plus - rate * total >= LEAST_SURPRISE * np.sqrt(rate * (1 - rate) * total)]


def fitted(texts: pa.Array, label: np.ndarray) -> Model:
    """Sparse weights that maximise the likelihood of the document labels under the noisy-or.

    The absolute penalty leaves features at zero that explain only a few documents
    or that another one explains better; the others are then fitted on without it.
    Steps are scaled per weight (Adam), and so is the shrinkage.
    """
    none = np.zeros(0, np.uint64)
    if len(np.unique(label)) < 2:
        return Model(none, np.zeros(0), 0.0, float(label.mean()) if len(label) else 0.0)
    names = selected(texts, label)
    features, places, texts_of, count = [], [], [], 0
    for s in K.slices(texts):
        found = sentences(s)
        at, number = _members(found.hash, names)
        features.append(number)
        places.append(found.sentence[at] + count)
        texts_of.append(found.text + s.first)
        count += len(found.text)
    feature, sentence, text = np.concatenate(features), np.concatenate(places), np.concatenate(texts_of)
    n = len(label)
    w, bias = np.zeros(len(names)), float(np.log(label.mean() / max(count / n, 1)))
    for steps, penalty in zip(STEPS, (LASSO, 0.0), strict=True):
        free = (w > 0) | (penalty > 0)  # without the penalty only chosen features move on
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for t in range(1, steps + 1):
            z = np.clip(bias + np.bincount(sentence, weights=w[feature], minlength=count), -60, 60)
            total = np.clip(np.bincount(text, weights=np.logaddexp(0, z), minlength=n), 1e-12, 500)
            slope = np.where(label > 0.5, -1 / np.expm1(total), 1.0) / n  # of the loss by the sum of a document
            gz = slope[text] / (1 + np.exp(-z))
            g, gb = np.bincount(feature, weights=gz[sentence], minlength=len(w)) * free, float(gz.sum())
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            a, b = 1 - 0.9**t, 1 - 0.99**t
            rate = RATE * min(1.0, 2.0 * (1 - t / (steps + 1)))
            scale = rate / (np.sqrt(v / b) + 1e-2 / n)
            w = np.maximum(w - scale * (m / a + penalty / n), 0)
            bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-9)
    return Model(names[w != 0], w[w != 0], bias)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model from at most about `rows` labelled rows, which come to the driver."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(bounded(known, rows)), "doc_id")
    table = sample.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fitted(table["text"].combine_chunks(), np.array(table["label"], np.float64))


def _offsets(s: K.Slice, text: int, start: int, end: int) -> tuple[int, int]:
    """A span of bytes of a slice as code points of its text."""
    begin = s.bounds[text]
    lead = lambda a, b: int(((s.data[a:b] & 0xC0) != 0x80).sum())
    first = lead(begin, start)
    return first, first + lead(start, end)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, n_sentences, n_toxic and the span of the worst sentence (NULL unless predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for s in K.slices(batch.column(1)):
                found = sentences(s)
                score, z = model.scores(found, s.count)
                total = np.bincount(found.text, minlength=s.count)
                bad = np.bincount(found.text, weights=z >= 0, minlength=s.count).astype(np.int64)
                spans = [(None, None)] * s.count
                cuts = np.concatenate(([0], np.cumsum(total)))
                for k in np.flatnonzero(score >= 0.5):
                    if total[k]:
                        worst = cuts[k] + int(np.argmax(z[cuts[k] : cuts[k + 1]]))
                        spans[k] = _offsets(s, k, int(found.start[worst]), int(found.end[worst]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.first, s.count), pa.array(np.clip(score, 0, 1)), pa.array((score >= 0.5).astype(np.int32)), pa.array(total.astype(np.int64)),
                        pa.array(bad), pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64()),
                    ],
                    names=["doc_id", "score", "predicted", "n_sentences", "n_toxic", "worst_start", "worst_end"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double, predicted int, n_sentences bigint, n_toxic bigint, worst_start bigint, worst_end bigint"
    )


def located(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, score, sentence of every sentence that scores at least `least`; offsets are code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    limit = float(np.log(least / (1 - least)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(1)):
                found = sentences(s)
                z = shared.value.odds(found)
                hit = np.flatnonzero(z >= limit)
                spans = [_offsets(s, int(found.text[k]), int(found.start[k]), int(found.end[k])) for k in hit]
                texts = [s.data[found.start[k] : found.end[k]].tobytes().decode() for k in hit]
                ids = batch.column(0).take(pa.array(s.first + found.text[hit], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64()), pa.array(1 / (1 + np.exp(-z[hit]))), pa.array(texts, pa.string())],
                    names=["doc_id", "start", "end", "score", "sentence"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, start bigint, end bigint, score double, sentence string")


def held_out(id_col: str = "doc_id"):
    """Rows labels are never learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


@query("op1_toxic_sentences")
def op1_toxic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    model = train(docs, given(spark, sf_dir, "labels").where(~held_out()))
    return scored(docs, model).withColumn("held_out", held_out())
