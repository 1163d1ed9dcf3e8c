"""Leave-one-out evaluation in one pass: every row is predicted from all others without a fit per row.

The Gaussian model needs counts, sums and sums of squares per class, from which a row's own
part is subtracted again; the neighbour model needs one neighbour more, of which the row
itself is left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.operators.metrics import PREDICTED
from ratingloom.operators.neighbours import nearest, standardise, vote
from ratingloom.session import cut_lineage

#: Share of the largest feature variance that is added to every variance, and the least variance.
SMOOTHING, LEAST_VARIANCE = 1e-9, 1e-300


def gaussian_leave_one_out(df: DataFrame, by: str, label: str, classes: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Adds the class that Gaussian naive Bayes, fitted on the other rows of the same `by`, gives each row.

    One aggregate of counts, sums and squares per group and class is joined to the rows; the
    row's own values are taken out of its class before means and variances are formed.
    A class without other rows is never predicted; a row that is alone in its group gets NULL.
    """
    x = [F.col(f).cast("double") for f in features]
    sums = df.groupBy(by, label).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*[F.sum(c * c) for c in x]).alias("q")
    )
    groups = sums.where(F.col(label).isin(list(classes))).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(label, F.struct("n", "s", "q")))).alias("_m"))
    rows = df.join(groups, by)

    def known(c: str, part: str) -> list[Column]:
        held = F.col("_m")[F.lit(c)][part]
        own = (F.col(label) == c).cast("double")
        return [F.coalesce(held, F.lit(0.0)) - own] if part == "n" else [F.coalesce(held[i], F.lit(0.0)) - own * (v if part == "s" else v * v) for i, v in enumerate(x)]

    # the sums without the row, by class, stored as columns so that every later term is short
    named = {f"_{part}{k}_{i}": v for k, c in enumerate(classes) for part in "nsq" for i, v in enumerate(known(c, part))}
    rows = rows.withColumns(named)
    column = lambda part, k, i=0: F.col(f"_{part}{k}_{i}")
    every = range(len(classes))
    total = sum((column("n", k) for k in every), F.lit(0.0))

    def mean(part: str, i: int) -> Column:
        return F.try_divide(sum((column(part, k, i) for k in every), F.lit(0.0)), F.col("_total"))

    spread = F.greatest(*[mean("q", i) - mean("s", i) * mean("s", i) for i in range(len(x))], F.lit(0.0))
    rows = rows.withColumn("_total", total).withColumn("_e", F.greatest(spread * SMOOTHING, F.lit(LEAST_VARIANCE)))

    def likelihood(k: int) -> Column:
        out = F.log(column("n", k)) - F.log("_total")
        for i, v in enumerate(x):
            m = F.try_divide(column("s", k, i), column("n", k))
            variance = F.greatest(F.try_divide(column("q", k, i), column("n", k)) - m * m, F.lit(0.0)) + F.col("_e")
            out = out - (F.log(variance * (2 * math.pi)) / 2 + (v - m) * (v - m) / (variance * 2))
        return F.when(column("n", k) > 0, out)

    scores = F.array(*[likelihood(k) for k in every])
    place = F.array_position("_scores", F.array_max("_scores")).cast("int") - 1
    named_class = F.get(F.array(*[F.lit(c) for c in classes]), place)
    return rows.withColumn("_scores", scores).withColumn(PREDICTED, named_class).select(*df.columns, PREDICTED)


def neighbours_leave_one_out(df: DataFrame, key: str, label: str, labels: Sequence[str], k: int = V.NEIGHBOURS, features: str = "features") -> DataFrame:
    """key, label, prediction, confidence: each row by its k nearest other rows, features standardised over all rows."""
    table = cut_lineage(df.select(key, label, features), "leave-one-out")
    rows, _ = standardise(table, table, features)
    near = nearest(rows, rows, key, label, k + 1, features)
    others = F.slice(F.filter("neighbours", lambda n: n["key"] != F.col(key)), 1, k)
    voted = vote(near.withColumn("neighbours", others), labels)
    return table.select(key, label).join(voted, key)


def accuracy(predictions: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """rows and the share predicted right per group."""
    right = F.coalesce((F.col(label) == F.col(PREDICTED)).cast("double"), F.lit(0.0))
    return predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg(right).alias("accuracy"))
