"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the byte pairs and hashed byte triples of the lower-cased text,
weighed by their share of the text and by inverse document frequency, counted
over all documents that may be learned from. The languages are all that those documents have;
the weights are fitted on a bounded sample of them, of which a rare language has a
guaranteed part, by follow-the-regularised-leader with elastic-net
penalties (an absolute one that keeps weights at zero, and a quadratic one), and
a temperature, fitted on a part of the sample that the weights have not seen,
calibrates the probabilities.

Defined results: a text that is NULL or has no letter is `und` with score 0; so
is every text if there is nothing to learn from; with one language known, that
one has score 1; repeated rows are predicted each; columns beside those named are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm import textkernel as K
from ratingloom.llm.registry import given, query
from ratingloom.llm.sampling import SPACE

#: Documents the weights are fitted on, about, and those that every language has at least (all it has, if fewer); every fourth document sets the temperature.
SAMPLE_ROWS, LANGUAGE_ROWS, CALIBRATION = 4_000, 100, 4
PAIRS = 1 << 16
FEATURES = 2 * PAIRS
#: Learning rate, its smoothing, and the absolute and quadratic penalties.
ALPHA, BETA, ABSOLUTE, QUADRATIC = 0.5, 1.0, 1e-4, 1e-4
PASSES, SCALE = 2, 20.0
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTERS = K.classes(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[0x41:0x5B] += 32


def grams(s: K.Slice) -> tuple[np.ndarray, np.ndarray]:
    """For every byte the feature of the pair and of the triple that begin there; FEATURES where the text ends before."""
    data = _LOWER[s.data]
    n = len(data)
    pair, triple = np.full(n, FEATURES), np.full(n, FEATURES)
    if n > 1:
        pair[:-1] = data[:-1] << 8 | data[1:]
    if n > 2:
        mixed = (data[:-2] * 0x9E3779B1 + data[1:-1] * 0x85EBCA6B + data[2:] * 0xC2B2AE35) & 0xFFFFFFFF
        triple[:-2] = PAIRS + ((mixed ^ mixed >> 15) * 0x2C1B3C6D >> 12 & PAIRS - 1)
    ends = s.bounds[1:]
    last, before = ends[ends > 0] - 1, ends[ends > 1] - 2
    pair[last] = FEATURES
    triple[last] = FEATURES
    triple[before] = FEATURES
    return pair, triple


@dataclass
class Model:
    """Languages, weights already multiplied by inverse document frequency, and the temperature."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, s: K.Slice) -> np.ndarray:
        n = s.count
        if len(s.data) == 0:
            return np.tile(self.bias, (n, 1))
        pair, triple = grams(s)
        starts = np.minimum(s.bounds[:-1], len(s.data) - 1)
        total = np.add.reduceat(self.table[pair], starts, axis=0) + np.add.reduceat(self.table[triple], starts, axis=0)
        size = np.diff(s.bounds)
        known = np.maximum(2 * size - 3, 1)
        return np.where(size[:, None] > 0, total * (SCALE / known[:, None]), 0) + self.bias

    def predict(self, s: K.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Number and probability of the likeliest language of every text."""
        p = softmax(self.logits(s) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """For each feature the number of documents that have it, and the number of documents.

    Each task adds up its documents and sends one row per feature; Spark sums
    them, and the driver gets one number per feature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(FEATURES + 1, np.int64)
        total = 0
        for batch in batches:
            for s in K.slices(batch.column(0)):
                pair, triple = grams(s)
                total += s.count
                seen = np.zeros(FEATURES + 1, bool)
                for a, b in zip(s.bounds[:-1], s.bounds[1:], strict=True):
                    seen[:] = False
                    seen[pair[a:b]] = True
                    seen[triple[a:b]] = True
                    counts += seen
        some = np.flatnonzero(counts[:FEATURES])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], total))], names=["feature", "k"])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "feature bigint, k bigint").groupBy("feature").agg(F.sum("k").alias("k")).toArrow()
    out, total = np.zeros(FEATURES, np.int64), 0
    feature, k = np.array(sums["feature"], np.int64), np.array(sums["k"], np.int64)
    out[feature[feature >= 0]] = k[feature >= 0]
    if (feature < 0).any():
        total = int(k[feature < 0].sum())
    return out, total


def fitted(texts: pa.Array, label: np.ndarray, languages: list[str], idf: np.ndarray) -> Model:
    """Weights by follow-the-regularised-leader over the sample, then the temperature."""
    k = len(languages)
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))
    target = np.eye(k)

    def weights(rows: np.ndarray | slice) -> np.ndarray:
        own = z[rows]
        w = -(own - np.sign(own) * ABSOLUTE) / ((BETA + np.sqrt(n[rows])) / ALPHA + QUADRATIC)
        return np.where(np.abs(own) > ABSOLUTE, w, 0)

    documents = []
    for s in K.slices(texts):
        pair, triple = grams(s)
        for j in range(s.count):
            a, b = s.bounds[j], s.bounds[j + 1]
            found, count = np.unique(np.concatenate((pair[a:b], triple[a:b])), return_counts=True)
            inside = found < FEATURES
            found, count = found[inside], count[inside]
            x = count * idf[found] * (SCALE / max(2 * (b - a) - 3, 1))
            documents.append((np.append(found, FEATURES), np.append(x, 1.0)))  # the last is the bias
    order = [j for j in range(len(documents)) if j % CALIBRATION or len(documents) < 50]
    for _ in range(PASSES):
        for j in order:
            found, x = documents[j]
            w = weights(found)
            g = np.outer(x, softmax(x @ w) - target[label[j]])
            squared = n[found] + g * g
            z[found] += g - (np.sqrt(squared) - np.sqrt(n[found])) / ALPHA * w
            n[found] = squared
    w = weights(slice(None))
    model = Model(languages, (w * np.append(idf, 0.0)[:, None]).astype(np.float32), w[FEATURES].copy(), 1.0)
    unseen = [j for j in range(len(documents)) if not j % CALIBRATION] if len(documents) >= 50 else list(range(len(documents)))
    logits = np.array([documents[j][1] @ w[documents[j][0]] for j in unseen])
    truth = label[unseen]
    heat = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() + 1e-3 * np.log(t) ** 2 for t in heat]
    model.temperature = float(heat[int(np.argmin(loss))])
    return model


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model from the rows of `docs` that have a language; about `rows` of them come to the driver, and LANGUAGE_ROWS more of each rare language."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts, total = document_frequencies(known, text_col)
    idf = np.log((1 + total) / (1 + counts)) + 1
    sizes = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}  # one row per language
    languages = sorted(sizes)
    share = min(1.0, rows / max(sum(sizes.values()), 1))
    wanted = {x: min(1.0, max(share, LANGUAGE_ROWS / n)) for x, n in sizes.items()}
    named = known.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sample = named.where("false")
    if languages:
        quota = F.create_map(*[F.lit(v) for x, p in wanted.items() for v in (x, int(SPACE * p))])[F.col("lang")]
        # by a hash of the text where ids repeat, so that copies of a row are not drawn together for its id alone
        sample = named.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SPACE)) < quota).limit(2 * (rows + LANGUAGE_ROWS * len(languages)))
    table = sample.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending"), ("lang", "ascending")])
    if not languages:
        return Model([], np.zeros((FEATURES + 1, 0), np.float32), np.zeros(0), 1.0)
    shuffled = np.random.default_rng(7).permutation(table.num_rows)
    table = table.take(pa.array(shuffled))
    label = np.array([languages.index(x) for x in table["lang"].to_pylist()])
    return fitted(table["text"].combine_chunks(), label, languages, idf)


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages + [UNKNOWN], dtype=object)
        for batch in batches:
            for s in K.slices(batch.column(1)):
                if model.languages:
                    best, score = model.predict(s)
                else:
                    best, score = np.zeros(s.count, np.int64), np.zeros(s.count)
                sums = np.concatenate(([0], np.cumsum(_ASCII_LETTERS[s.data])))
                for k in np.flatnonzero(sums[s.bounds[1:]] == sums[s.bounds[:-1]]):
                    if not _LETTER.search(s.text(k).decode()):
                        best[k], score[k] = len(model.languages), 0.0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.count), pa.array(names[best].tolist(), pa.string()), pa.array(score.astype(np.float64))], names=["doc_id", "lang_pred", "score"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows nothing is learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    return predicted(docs, train(docs.where(~held_out()))).withColumn("held_out", held_out())
