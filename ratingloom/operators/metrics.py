"""Classification metrics from counted (actual, predicted) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.functions.ratings import rating_notch

ACTUAL, PREDICTED = "rating_category", "predicted_category"


def _pairs(predictions: DataFrame, by: Sequence[str], actual: str, predicted: str) -> DataFrame:
    return predictions.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion(
    predictions: DataFrame, classes: Sequence[str] = tuple(V.CATEGORIES), by: Sequence[str] = (),
    actual: str = ACTUAL, predicted: str = PREDICTED,
) -> DataFrame:
    """Long confusion table with every class pair, empty ones as 0."""
    counted = _pairs(predictions, by, actual, predicted)
    cells = F.explode(F.array(*[F.lit(c) for c in classes]))
    groups = counted.select(*by).distinct() if by else predictions.sparkSession.range(1)
    grid = groups.select(*by, cells.alias("actual")).select(*by, "actual", cells.alias("predicted"))
    return grid.join(counted, [*by, "actual", "predicted"], "left").fillna(0, ["n"])


def confusion_wide(
    predictions: DataFrame, classes: Sequence[str] = tuple(V.CATEGORIES), actual: str = ACTUAL, predicted: str = PREDICTED
) -> DataFrame:
    """One row per actual class, one column per predicted class."""
    long = confusion(predictions, classes, (), actual, predicted)
    return long.groupBy("actual").pivot("predicted", list(classes)).agg(F.sum("n"))


def class_report(
    predictions: DataFrame, by: Sequence[str] = (), actual: str = ACTUAL, predicted: str = PREDICTED
) -> DataFrame:
    """Precision, recall, F1 and support per class that occurs; 0 for a zero denominator."""
    counted = _pairs(predictions, by, actual, predicted)
    n, hit = F.col("n"), F.col("actual") == F.col("predicted")
    as_actual = counted.select(*by, F.col("actual").alias("label"), n.alias("support"), F.lit(0).cast("long").alias("said"), F.when(hit, n).otherwise(0).alias("right"))
    as_predicted = counted.select(*by, F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), n.alias("said"), F.lit(0).cast("long").alias("right"))
    sums = as_actual.unionByName(as_predicted).groupBy(*by, "label").agg(
        F.sum("support").alias("support"), F.sum("said").alias("_said"), F.sum("right").alias("_right")
    )
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return sums.select(
        *by,
        "label",
        share(F.col("_right"), F.col("_said")).alias("precision"),
        share(F.col("_right"), F.col("support")).alias("recall"),
        share(F.col("_right") * 2, F.col("_said") + F.col("support")).alias("f1"),
        "support",
    )


def summary_scores(
    predictions: DataFrame, by: Sequence[str] = (), actual: str = ACTUAL, predicted: str = PREDICTED
) -> DataFrame:
    """Accuracy, macro F1 and weighted F1 per group.

    Weighted recall is the accuracy, so the report alone gives all three.
    """
    report = class_report(predictions, by, actual, predicted)
    support = F.col("support")
    return report.groupBy(*by).agg(
        (F.sum(F.col("recall") * support) / F.sum(support)).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * support) / F.sum(support)).alias("f1_weighted"),
    )


def fold_summary(scores: DataFrame, by: Sequence[str], metrics: Sequence[str] = ("accuracy", "f1_macro", "f1_weighted")) -> DataFrame:
    """Mean and population deviation of fold scores."""
    return scores.groupBy(*by).agg(
        *[a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    )


def error_pairs(predictions: DataFrame, actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    """"actual → predicted" of wrong rows with their count, most frequent first."""
    wrong = misclassified(predictions, actual, predicted)
    counted = wrong.groupBy(F.concat(F.col(actual), F.lit(" → "), F.col(predicted)).alias("pair")).agg(
        F.count(F.lit(1)).alias("errors")
    )
    return counted.orderBy(F.desc("errors"), "pair")


def misclassified(predictions: DataFrame, actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    return predictions.where(F.col(actual) != F.col(predicted))


def binary_scores(predictions: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """F1 of the positive class and Matthews correlation of two 0/1 columns."""
    a, p = F.col(actual), F.col(predicted)
    cell = lambda x, y: F.sum(((a == x) & (p == y)).cast("long")).cast("double")
    counts = predictions.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    zero = F.lit(0.0)
    return counts.select(
        *by,
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
        F.coalesce(F.try_divide(tp * tn - fp * fn, root), zero).alias("mcc"),
    )


def investment_grade_scores(predictions: DataFrame, actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    flag = lambda c: F.col(c).isin(V.INVESTMENT_CATEGORIES).cast("int")
    return binary_scores(predictions.select(flag(actual).alias("a"), flag(predicted).alias("p")), "a", "p")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns, ties sharing their mean rank.

    Ranks are taken over distinct (x) and (y) values with counts, and the
    correlation over distinct (x, y) pairs with counts; rating columns have few
    distinct values, so no row of the input is ever ordered. Meant for such
    ordinal columns.
    """
    from pyspark.sql import Window

    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )

    def ranks(c: str) -> DataFrame:
        sizes = pairs.groupBy(c).agg(F.sum("n").alias("_n"))
        upto = F.sum("_n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        return sizes.select(c, (upto - (F.col("_n") - 1) / 2).alias(f"r{c}"))

    r = pairs.join(ranks("x"), "x").join(ranks("y"), "y")
    n, a, b = F.col("n"), F.col("rx"), F.col("ry")
    sums = r.agg(
        F.sum(n).alias("n"), F.sum(n * a).alias("a"), F.sum(n * b).alias("b"),
        F.sum(n * a * a).alias("aa"), F.sum(n * b * b).alias("bb"), F.sum(n * a * b).alias("ab"),
    )
    c = F.col
    cov = c("ab") - c("a") * c("b") / c("n")
    spread = F.sqrt(c("aa") - c("a") * c("a") / c("n")) * F.sqrt(c("bb") - c("b") * c("b") / c("n"))
    return sums.select(F.try_divide(cov, spread).alias("spearman"), c("n").cast("long").alias("rows"))


def rating_rank_correlation(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Spearman correlation of two letter columns on the notch scale."""
    return spearman(df.select(rating_notch(F.col(actual)).alias("a"), rating_notch(F.col(predicted)).alias("p")), "a", "p")


def rank_by(df: DataFrame, score: str, name: str) -> DataFrame:
    """A small result table ordered by score, best first, ties by name."""
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), name)))
