"""A scorer of articles that is learned: hashed words and a multinomial logistic model.

Words are hashed to a fixed number of features, an article is the shares of its words. The weights are fitted by
synchronous gradients over all labelled rows: an epoch is one job whose tasks add up the gradients of
their rows, so neither rows nor words come to the driver. The model is saved as a table with the
class names in it; it goes to the workers once per job, each of which sets it up once, and
`score_articles` calls it in batches.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.operators.boosting import softmax
from ratingloom.session import cut_lineage

#: Hashed features, epochs, step size, decay of the two means of gradients, weight penalty.
FEATURES, EPOCHS, RATE, DECAY, PENALTY = 1 << 13, 60, 0.3, (0.9, 0.999), 1e-5
_WORD = re.compile(r"[^\W_]+")


def word_shares(text: str | None, tokens: int | None = None) -> tuple[list[int], list[float]]:
    """(features, root-scaled counts of unit length) of a text's words, or of its first `tokens` words where a model's window is that long."""
    words = _WORD.findall((text or "").lower())
    counts = Counter(zlib.crc32(w.encode()) % FEATURES for w in (words[:tokens] if tokens else words))
    values = np.sqrt(np.array(list(counts.values()), float))
    length = float(np.sqrt((values * values).sum())) or 1.0
    return list(counts), (values / length).tolist()


@dataclass
class ArticleModel:
    """Class names in the order of the columns of `weights`, whose last row is the bias."""

    classes: list[str]
    weights: np.ndarray
    tokens: int | None = None

    def probabilities(self, texts: Sequence[str | None]) -> np.ndarray:
        z = np.tile(self.weights[-1], (len(texts), 1))
        for k, text in enumerate(texts):
            columns, values = word_shares(text, self.tokens)
            z[k] += np.array(values) @ self.weights[columns] if columns else 0
        return softmax(z) if len(texts) else z

    def score(self, texts: Sequence[str | None], positive: str, negative: str) -> np.ndarray:
        """P(positive) - P(negative); a text without a word scores 0."""
        p = self.probabilities(texts)
        worded = np.array([bool(_WORD.search(t or "")) for t in texts])
        return np.where(worded, p[:, self.classes.index(positive)] - p[:, self.classes.index(negative)], 0.0)


def fit(articles: DataFrame, text: str, label: str, epochs: int = EPOCHS, tokens: int | None = None) -> ArticleModel:
    """The model of the rows that have a label; every class weighs the same."""
    known = articles.where(F.col(label).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row per class
    classes = sorted(sizes)
    shape = (FEATURES + 1, len(classes))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_shares(t, tokens) for t in batch.column(0).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([classes.index(x) for x in batch.column(1).to_pylist()], pa.int32())], names=["f", "v", "label"])

    weights, first, second = (np.zeros(shape) for _ in range(3))
    if len(classes) < 2:
        return ArticleModel(classes, weights, tokens)
    state = cut_lineage(known.mapInArrow(shares, "f array<int>, v array<double>, label int"), "article-words")
    of_class = np.array([1.0 / (len(classes) * sizes[c]) for c in classes])
    for step in range(1, epochs + 1):

        def add(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                labels = batch.column(2).to_numpy()
                features, values = batch.column(0), batch.column(1)
                row = np.repeat(np.arange(len(labels)), np.asarray(features.value_lengths()))
                f, v = features.flatten().to_numpy(), values.flatten().to_numpy()
                z = weights[-1] + np.stack([np.bincount(row, v * weights[f, k], len(labels)) for k in range(shape[1])], axis=1)
                back = softmax(z) if len(labels) else z
                back[np.arange(len(labels)), labels] -= 1
                back *= of_class[labels][:, None]
                for k in range(shape[1]):
                    total[:-1, k] += np.bincount(f, v * back[row, k], FEATURES)
                total[-1] += back.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["g"])

        sums = state.mapInArrow(add, "g array<double>").agg(Summarizer.sum(array_to_vector("g")).alias("g")).first()["g"].toArray().reshape(shape)
        g = sums + PENALTY * weights
        first, second = DECAY[0] * first + (1 - DECAY[0]) * g, DECAY[1] * second + (1 - DECAY[1]) * g * g
        rate = RATE * np.sqrt(1 - DECAY[1] ** step) / (1 - DECAY[0] ** step)
        weights = weights - rate * first / (np.sqrt(second) + 1e-8)
    return ArticleModel(classes, weights, tokens)


def save(model: ArticleModel, spark: SparkSession, path: str) -> None:
    """As a table: the weights of each class, its place and name, and the window."""
    rows = [(k, c, model.tokens, model.weights[:, k].tolist()) for k, c in enumerate(model.classes)]
    spark.createDataFrame(rows, "place int, class string, tokens int, weights array<double>").write.parquet(path)


def load(spark: SparkSession, path: str) -> ArticleModel:
    """A saved model; the order of its classes is the saved one."""
    rows = spark.read.schema("place int, class string, tokens int, weights array<double>").parquet(path).orderBy("place").collect()
    return ArticleModel([r["class"] for r in rows], np.array([r["weights"] for r in rows]).T, rows[0]["tokens"] if rows else None)


def scorer(model: ArticleModel, spark: SparkSession, positive: str, negative: str) -> Callable[[], Callable]:
    """What `score_articles` takes: called once in each worker, it gives the function that scores a batch."""
    shared = spark.sparkContext.broadcast(model)

    def load_scorer():
        model = shared.value
        return lambda texts: model.score(texts, positive, negative)

    return load_scorer
