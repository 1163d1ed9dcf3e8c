"""Per-row feature attributions of boosted trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.operators.boosting import Boosted, Leaf, matrix_of
from ratingloom.operators.models import class_name
from ratingloom.operators.profiles import with_descriptions

#: Comparisons of a group of leaves whose outcomes are tabled together (two to their power patterns), and rows explained at a time.
TESTS, EXPLAINED_ROWS = 7, 4_096


def base_value(leaves: Sequence[Leaf]) -> float:
    """The model's mean output over its training rows' paths."""
    return float(sum(v * np.prod([share for *_, share in path]) for v, path in leaves))


def shapley_values(x: np.ndarray, leaves: Sequence[Leaf]) -> np.ndarray:
    """Exact path-dependent Shapley values of a batch of rows.

    A leaf pays its value when all features on its path agree: a known feature
    by the row, an unknown one with its share. For such a product game the
    sums over coalitions of each size are coefficients of a polynomial.
    """
    out = np.zeros(x.shape, dtype=float)
    for value, path in leaves:
        follows = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, lo, hi, _ in path]
        for (feature, *_), part in zip(path, _paid(value, path, follows)):
            out[:, feature] += part
    return out


def _paid(value: float, path: Sequence[tuple[int, float, float, float]], follows: Sequence[np.ndarray]) -> Iterator[np.ndarray]:
    """What each feature of a leaf's path gets, given who follows it (1 or 0)."""
    m = len(path)
    for i, (*_, share) in enumerate(path):
        coefficients = [np.ones(len(follows[i]))]
        for j, (*_, other) in enumerate(path):
            if j == i:
                continue
            grown = [c * other for c in coefficients] + [np.zeros(len(follows[i]))]
            for size, c in enumerate(coefficients):
                grown[size + 1] = grown[size + 1] + c * follows[j]
            coefficients = grown
        weighted = sum(
            c * (factorial(size) * factorial(m - size - 1) / factorial(m)) for size, c in enumerate(coefficients)
        )
        yield value * (follows[i] - share) * weighted


@dataclass(frozen=True)
class Patterns:
    """Attributions of some leaves over few comparisons, for every pattern of their outcomes.

    What a leaf pays depends on a row only by which of its features follow the path, so rows of
    the same outcomes share their attributions and these are worked out once per pattern.
    """

    tests: list[tuple[int, float]]  # (feature, cut): whether a value lies above the cut
    features: np.ndarray
    values: np.ndarray  # (patterns, features)


def tabled(leaves: Sequence[Leaf]) -> list[Patterns]:
    """Leaves in the order of their trees, in groups of at most `TESTS` comparisons."""
    groups: list[tuple[dict[tuple[int, float], None], list[Leaf]]] = []
    for leaf in leaves:
        own = {(f, cut): None for f, lo, hi, _ in leaf[1] for cut in (lo, hi) if np.isfinite(cut)}
        if not groups or len({**groups[-1][0], **own}) > max(TESTS, len(own)):
            groups.append(({}, []))
        groups[-1][0].update(own)
        groups[-1][1].append(leaf)
    out = []
    for tests, held in groups:
        number = {test: i for i, test in enumerate(tests)}
        features = sorted({f for f, _ in tests})
        above = (np.arange(2 ** len(tests))[:, None] >> np.arange(len(tests))) & 1 == 1
        values = np.zeros((len(above), len(features)))
        for value, path in held:
            follows = [
                (above[:, number[f, lo]] if np.isfinite(lo) else True) & (~above[:, number[f, hi]] if np.isfinite(hi) else True) & np.ones(len(above), bool) for f, lo, hi, _ in path
            ]
            for i, part in enumerate(_paid(value, path, [f.astype(float) for f in follows])):
                values[:, features.index(path[i][0])] += part
        out.append(Patterns(list(tests), np.array(features, int), values))
    return out


def pattern_values(x: np.ndarray, tables: Sequence[Patterns]) -> np.ndarray:
    """The Shapley values of `shapley_values`, looked up per group of leaves."""
    out = np.zeros((x.shape[1], len(x)))
    columns = np.ascontiguousarray(x.T)
    for table in tables:
        code = np.zeros(len(x), np.int64)
        for i, (feature, cut) in enumerate(table.tests):
            code |= (columns[feature] > cut).astype(np.int64) << i
        for k, feature in enumerate(table.features):
            out[feature] += table.values[:, k][code]
    return np.ascontiguousarray(out.T)


def predicted_index(fitted: Boosted) -> Column:
    """Number of the class a row is predicted to have."""
    return F.array_position(F.array(*[F.lit(c) for c in fitted.classes]), F.col("predicted_category")) - 1


def attributions(table: DataFrame, fitted: Boosted, keep: Sequence[str], wanted: Column | None = None) -> DataFrame:
    """(keep, predicted, features, class_index, base, shap_values, margin) per row and class.

    With `wanted` (a class number over the scored row) only that class of a row is
    explained. Only the tree nodes travel to the tasks. The margin is the model's own
    score, for checking that base and values add up to it.
    """
    per_class = fitted.leaves()
    bases = [base_value(leaves) for leaves in per_class]
    values = vector_to_array("features")
    scored = fitted.predict(table.withColumn("_features", values))
    rows = scored.select(
        *keep, "predicted_category", "confidence", F.col("_features").alias("features"), "margins",
        (wanted if wanted is not None else F.lit(-1)).cast("int").alias("wanted"),
    )
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
        + ["class_index int", "base double", "shap_values array<double>"]
    )

    tables = [tabled(leaves) for leaves in per_class]
    shared = table.sparkSession.sparkContext.broadcast(tables)
    at, width = len(keep) + 2, len(fitted.cuts)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, EXPLAINED_ROWS):
                batch = whole.slice(start, EXPLAINED_ROWS)
                asked = batch.column(batch.num_columns - 1).to_numpy()
                for index, leaves in enumerate(shared.value):
                    own = (asked == index) | (asked == -1)
                    if own.any():
                        part = batch.filter(pa.array(own))
                        found = pattern_values(matrix_of(part.column(at), width), leaves)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * width, pa.int32()), pa.array(found.ravel()))
                        columns = [*part.columns, pa.array(np.full(len(found), index, np.int32)), pa.array(np.full(len(found), bases[index])), lists]
                        yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "class_index", "base", "shap_values"])

    explained = rows.mapInArrow(explain, schema)
    return explained.withColumn("margin", F.get("margins", F.col("class_index"))).drop("margins", "wanted")


def mean_magnitudes(table: DataFrame, fitted: Boosted, features: Sequence[str]) -> DataFrame:
    """feature_index, feature, mean_abs_shap: the mean absolute attribution over rows and classes.

    Each batch gives one sum per feature, so no value of a row leaves its task.
    """
    shared = table.sparkSession.sparkContext.broadcast([tabled(leaves) for leaves in fitted.leaves()])
    width = len(fitted.cuts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, EXPLAINED_ROWS):
                x = matrix_of(whole.column(0).slice(start, EXPLAINED_ROWS), width)
                total = sum(np.abs(pattern_values(x, leaves)).sum(axis=0) for leaves in shared.value)
                columns = [pa.array(np.arange(width, dtype=np.int32)), pa.array(total), pa.array(np.full(width, len(x) * len(shared.value), np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["feature_index", "total", "n"])

    sums = table.select(vector_to_array("features").alias("features")).mapInArrow(add, "feature_index int, total double, n long")
    means = sums.groupBy("feature_index").agg((F.sum("total") / F.sum("n")).alias("mean_abs_shap"))
    return means.withColumn("feature", class_name(F.col("feature_index"), features))


def long_form(explained: DataFrame, keep: Sequence[str], classes: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keep, class, feature, feature_value, shap_value), one row per value."""
    flat = explained.select(
        *keep, class_name(F.col("class_index"), classes).alias("class"), "features", F.posexplode("shap_values").alias("feature_index", "shap_value")
    )
    return flat.select(
        *keep, "class", "feature_index", class_name(F.col("feature_index"), features).alias("feature"),
        F.get("features", F.col("feature_index")).alias("feature_value"), "shap_value",
    )


def global_importance(per_feature: DataFrame) -> DataFrame:
    """Rank and share of each feature by its mean absolute attribution."""
    every = Window.partitionBy()  # one row per feature
    ranked = per_feature.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_shap"), "feature_index")))
    share = 100 * F.col("mean_abs_shap") / (F.sum("mean_abs_shap").over(every) + 1e-12)
    return with_descriptions(ranked.withColumn("share_pct", share).drop("feature_index"))


def top_factors(explained: DataFrame, keep: Sequence[str], classes: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Per row the feature with the largest absolute attribution for the predicted class.

    The first feature wins ties. Works inside each row, without a shuffle.
    """
    own = explained.where(class_name(F.col("class_index"), classes) == F.col("predicted_category"))  # if all classes were explained
    marked = F.transform(
        "shap_values", lambda v, i: F.struct(F.abs(v).alias("size"), (-i).alias("back"), v.alias("value"))
    )
    best = F.array_max(marked)
    place = -best["back"]
    return own.select(
        *keep, "predicted_category", class_name(place, features).alias("top_feature"),
        best["value"].alias("shap_value"), F.get("features", place).alias("feature_value"),
    )


def reported_factors(factors: DataFrame, order: Sequence[str], rows: int = V.REPORTED_FACTORS) -> DataFrame:
    """The first rows of the factor table, as the printed report shows them."""
    return factors.orderBy(*order).limit(rows)


def dependence(
    explained: DataFrame, keep: Sequence[str], class_index: int, features: Sequence[str], pairs=tuple(V.DEPENDENCE_PAIRS)
) -> DataFrame:
    """(pair, x, shap, colour) of each feature pair for one class, from each row alone."""
    place = {f: i for i, f in enumerate(features)}
    points = F.array(
        *[
            F.struct(
                F.lit(f"{x}/{colour}").alias("pair"),
                F.get("features", F.lit(place[x])).alias("x"),
                F.get("shap_values", F.lit(place[x])).alias("shap"),
                F.get("features", F.lit(place[colour])).alias("colour"),
            )
            for x, colour in pairs
            if x in place and colour in place
        ]
    )
    own = explained.where(F.col("class_index") == class_index)
    return own.select(*keep, F.explode(points).alias("_p")).select(*keep, "_p.*")
