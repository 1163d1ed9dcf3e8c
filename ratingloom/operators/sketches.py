"""Distinct counts and quantiles from mergeable sketches that are kept as state.

A sketch is built once per fine key (a source, a day, a year), stored as a binary column,
and merged upward to any coarser key; new rows add their own sketches and nothing is
counted again. Sketches are aggregates, so of all values only one sketch per task and key is
shuffled. Estimates come with a bound: distinct counts within three times the sketch's
relative standard error, quantiles within a rank error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.text import blank_separated

#: Size of the distinct-count sketches (2**LG_K cells) and of the quantile sketches, and the bound of their ranks.
LG_K, QUANTILE_K, RANK_BOUND = 12, 400, 0.02
#: Relative bound of a distinct count: three standard errors.
DISTINCT_BOUND = 3 * 1.04 / 2 ** (LG_K / 2)


def distinct_state(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, rows, sketch): how many rows, and a sketch of the distinct values."""
    return values.groupBy(*keys).agg(F.count(value).alias("rows"), F.hll_sketch_agg(value, LG_K).alias("sketch"))


def merge_distinct(state: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The state of coarser keys, from that of finer ones."""
    return state.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))


def distinct_estimates(state: DataFrame) -> DataFrame:
    """(keys, rows, estimate) of a state."""
    return state.withColumn("estimate", F.hll_sketch_estimate("sketch")).drop("sketch")


def trigram_rows(df: DataFrame, text: Column, keys: Sequence[str]) -> DataFrame:
    """(keys, gram), one row per three-word run; only to be sketched, it is not shuffled."""
    tokens = df.select(*keys, blank_separated(text).alias("_t")).where(F.size("_t") >= 3)
    runs = F.transform(F.sequence(F.lit(0), F.size("_t") - 3), lambda i: F.concat_ws(" ", *[F.get("_t", i + k) for k in range(3)]))
    return tokens.select(*keys, F.explode(runs).alias("gram"))


def quantile_state(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, feature, rows, sketch) of each column's values that are not NULL."""
    tall = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), "feature", "value")
    return tall.where(F.col("value").isNotNull()).groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("rows"), F.kll_sketch_agg_double("value", QUANTILE_K).alias("sketch"))


def merge_quantiles(state: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The state of coarser keys, per feature."""
    return state.groupBy(*keys, "feature").agg(F.sum("rows").alias("rows"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile_estimates(state: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(keys, feature, rows, p, estimate) of a state."""
    each = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("estimate")) for p in probabilities])
    return state.select(*[c for c in state.columns if c != "sketch"], F.inline(each))


def quantile_bounds(values: DataFrame, estimates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds to each estimate whether its true rank lies within the bound of the wanted one.

    values: (keys, feature, value). A value that occurs more than once has all ranks from its
    first copy to its last.
    """
    columns = [*keys, "feature"]
    joined = values.join(F.broadcast(estimates.select(*columns, "p", "estimate")), columns)  # a few rows per key and feature
    ranks = joined.groupBy(*columns, "p").agg(
        F.count_if(F.col("value") < F.col("estimate")).alias("below"), F.count_if(F.col("value") <= F.col("estimate")).alias("upto"), F.count(F.lit(1)).alias("n")
    )
    slack = F.lit(RANK_BOUND) * F.col("n") + 1
    within = (F.col("below") <= F.col("p") * F.col("n") + slack) & (F.col("upto") >= F.col("p") * F.col("n") - slack)
    return estimates.join(ranks.select(*columns, "p", within.alias("within")), [*columns, "p"])
