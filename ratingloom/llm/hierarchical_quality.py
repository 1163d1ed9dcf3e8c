"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is a logistic model over binned measures of its whole
text (length, repetition, symbols, capitals, ...), fitted on a bounded sample of
labelled rows. Hosts and the paths below them have posteriors: sums of evidence
over all their documents, shrunk towards the level above by a strength that the
spread between the groups determines (method of moments). A sparse host so has
the global prior, a sparse path that of its host. The score of a document is its
evidence with the prior of its path in place of the global one.

Groups are sums and counts, combined before the shuffle; the table of paths goes
back by a join that Spark broadcasts or splits by size.

Defined results: a text without words (NULL, empty, blank) has no evidence of its
own and the score of its path; NULL host or path is a group of its own; without
labels, or with one label only, evidence is the share of label 1 (1 without any)
and everything at 0.5 or more is kept; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingloom.llm import textkernel as K
from ratingloom.llm.registry import given, query
from ratingloom.llm.sampling import bounded
from ratingloom.llm.scratch import Scratch, numbered

#: Labelled rows the model is fitted on at most, and bins of each measure.
SAMPLE_ROWS, BINS = 12_000, 16
#: Evidence is kept off 0 and 1 by this.
EDGE = 1e-4
_SYMBOLS = [
    K.classes(bytes(range(0x41, 0x5B))), K.classes(bytes(range(0x61, 0x7B))), K.classes(b"0123456789"),
    K.classes(b"#$%&*|<>{}[]\\^~@_=+/"), K.classes(b"!?"), K.classes(b"\n"), K.classes(b".,;:"),
]
MEASURES = 4 + len(_SYMBOLS)


def measures(s: K.Slice) -> np.ndarray:
    """A row of measures for each text of a slice."""
    n, size = s.count, np.diff(s.bounds)
    w = K.words(s)
    count = np.bincount(w.text, minlength=n)
    some, bytes_ = np.maximum(count, 1), np.maximum(size, 1)
    length = np.bincount(w.text, weights=w.end - w.start, minlength=n)
    again = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
    order = np.lexsort((w.hash, w.text)) if len(w.hash) else np.zeros(0, np.int64)
    h, t = w.hash[order], w.text[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    out = [np.log1p(count), length / some, np.bincount(t[first], minlength=n) / some, np.bincount(w.text[1:][again], minlength=n) / some]
    sums = np.zeros(len(s.data) + 1, np.int64)
    for table in _SYMBOLS:
        np.cumsum(table[s.data], out=sums[1:])
        out.append((sums[s.bounds[1:]] - sums[s.bounds[:-1]]) / bytes_)
    return np.stack(out, axis=1)


@dataclass
class Model:
    """Cut points and weights of every measure, and the share of label 1."""

    cuts: list[np.ndarray]
    weights: list[np.ndarray]
    bias: float
    prior: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; the prior where there are no words."""
        z = np.full(len(x), self.bias)
        for j, (cut, weight) in enumerate(zip(self.cuts, self.weights, strict=True)):
            z += weight[np.searchsorted(cut, x[:, j])]
        p = 1 / (1 + np.exp(-z))
        return np.clip(np.where(x[:, 0] > 0, p, self.prior), EDGE, 1 - EDGE)


def fitted(x: np.ndarray, y: np.ndarray) -> Model:
    """Penalised logistic regression over the bins, by Newton's method."""
    prior = float(np.clip(y.mean() if len(y) else 1.0, EDGE, 1 - EDGE))
    if len(np.unique(y)) < 2:
        return Model([], [], float(np.log(prior / (1 - prior))), prior)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, BINS))) for j in range(x.shape[1])]
    sizes = [len(c) + 1 for c in cuts]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    a = np.zeros((len(x), starts[-1] + 1))
    for j, cut in enumerate(cuts):
        a[np.arange(len(x)), starts[j] + np.searchsorted(cut, x[:, j])] = 1
    a[:, -1] = 1
    w, ridge = np.zeros(a.shape[1]), np.eye(a.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(15):
        p = 1 / (1 + np.exp(-(a @ w)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + ridge, a.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Model(cuts, [w[starts[j] : starts[j + 1]] for j in range(len(cuts))], float(w[-1]), prior)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The document model from at most about `rows` labelled rows; their measures, not their texts, come to the driver."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    sample = bounded(known, rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(0)):
                x = measures(s)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, MEASURES, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([values, batch.column(1).slice(s.first, s.count)], names=["x", "label"])

    table = texts.select("text", "label").mapInArrow(run, "x array<double>, label double").toArrow()
    if table.num_rows == 0:
        return fitted(np.zeros((0, MEASURES)), np.zeros(0))
    x = np.array(table["x"].to_pylist())
    order = np.lexsort(x.T)  # the same model for any order of the rows
    return fitted(x[order], np.array(table["label"])[order])


def with_evidence(docs: DataFrame, model: Model, text_col: str = "text", name: str = "evidence") -> DataFrame:
    """The given rows with their evidence as one more column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(at)):
                part = batch.slice(s.first, s.count)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.evidence(measures(s)))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def _strength(groups: DataFrame, above: str) -> float:
    """How many documents the level above is worth, from the spread of the groups around it."""
    row = groups.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(above), 2)).alias("spread"),
        F.sum(F.col(above) * (1 - F.col(above))).alias("noise"), F.sum(F.col("n") * F.col(above) * (1 - F.col(above))).alias("inner"),
    ).first()
    if not row["n"]:
        return 1.0
    between = max(row["spread"] / row["n"] - row["noise"] / row["n"], 1e-9)
    return float(np.clip(row["inner"] / row["n"] / between - 1, 1.0, 1e6))


def posteriors(scored: DataFrame) -> DataFrame:
    """host, path, host_posterior, path_posterior and the global prior, from rows (host, path, evidence)."""
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    prior = total if total is not None else 0.5
    hosts = hosts.withColumn("prior", F.lit(prior))
    k = _strength(hosts, "prior")
    hosts = hosts.select(F.col("host").alias("above"), "prior", ((F.col("s") + k * F.col("prior")) / (F.col("n") + k)).alias("host_posterior"))
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("above"))).select("host", "path", "n", "s", "prior", "host_posterior")
    k = _strength(both, "host_posterior")
    return both.select("host", "path", "prior", "host_posterior", ((F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior"))


def judged(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows with host_posterior, path_posterior, score and keep."""
    names = {"host": "group_host", "path": "group_path"}
    table = groups.withColumnsRenamed(names)
    odds = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    joined = scored.join(table, F.col("host").eqNullSafe(F.col("group_host")) & F.col("path").eqNullSafe(F.col("group_path"))).drop(*names.values())
    z = odds("evidence") + odds("path_posterior") - odds("prior")
    return joined.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("keep", F.col("score") >= 0.5)


def scored_documents(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, host, path, evidence, host_posterior, path_posterior, score, keep of every row."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    scored = Scratch(docs.sparkSession, "quality").write(with_evidence(plain, model).drop("text"), "scored")
    return judged(scored, posteriors(scored)).select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "score", "keep")


def kept(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The rows of `docs` whose score is at least 0.5.

    The texts are measured twice, once for the groups and once beside the
    decision, so they need not be moved.
    """
    model = train(docs, labels)
    plain = docs.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"), "text")
    scratch = Scratch(docs.sparkSession, "quality")
    groups = scratch.write(posteriors(scratch.write(with_evidence(plain, model).drop("text"), "scored")), "groups")
    scratch.drop("scored")
    plain, name = numbered(docs)
    placed = plain.withColumns({"host": F.col(name[host_col]), "path": F.col(name[path_col])})
    return judged(with_evidence(placed, model, name["text"]), groups).where("keep").select(*name.values()).toDF(*docs.columns)


@query("op9_hierarchical_quality")
def op9_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(given(spark, sf_dir, "documents"), given(spark, sf_dir, "labels"))
