"""Sketches that are merged upward, against exact values."""

import pytest
from pyspark.sql import functions as F

from ratingloom.operators import sketches as SK


@pytest.fixture(scope="module")
def values(spark):
    return spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 2).alias("side"), (F.col("id") * 7919 % 20_011).cast("string").alias("v"), (F.col("id") * 31 % 997).cast("double").alias("x"))


def test_distinct_counts_merge(values):
    state = SK.distinct_state(values, ["day", "side"], "v")
    exact = {r["side"]: r["n"] for r in values.groupBy("side").agg(F.count_distinct("v").alias("n")).collect()}
    for r in SK.distinct_estimates(SK.merge_distinct(state, ["side"])).collect():
        assert r["rows"] == 30_000 and abs(r["estimate"] - exact[r["side"]]) <= exact[r["side"]] * SK.DISTINCT_BOUND
    # merging in steps, or the sketch of all rows at once, give the same
    once = SK.distinct_estimates(SK.distinct_state(values, [], "v")).first()
    assert SK.distinct_estimates(SK.merge_distinct(SK.merge_distinct(state, ["side"]))).first() == SK.distinct_estimates(SK.merge_distinct(state)).first()
    assert abs(once["estimate"] - SK.distinct_estimates(SK.merge_distinct(state)).first()["estimate"]) <= 20_011 * SK.DISTINCT_BOUND


def test_new_rows_are_added_to_the_state(values):
    old, new = values.where("day < 5"), values.where("day >= 5")
    both = SK.distinct_state(old, ["day"], "v").unionByName(SK.distinct_state(new, ["day"], "v"))
    assert SK.distinct_estimates(SK.merge_distinct(both)).first() == SK.distinct_estimates(SK.merge_distinct(SK.distinct_state(values, ["day"], "v"))).first()


def test_quantiles_merge(values):
    state = SK.merge_quantiles(SK.quantile_state(values.withColumn("empty", F.lit(None).cast("double")), ["day", "side"], ["x", "empty"]), ["side"])
    estimates = SK.quantile_estimates(state, [0.25, 0.5, 0.9])
    tall = values.select("side", F.lit("x").alias("feature"), F.col("x").alias("value"))
    got = SK.quantile_bounds(tall, estimates, ["side"]).collect()
    assert len(got) == 6 and all(r["within"] and r["rows"] == 30_000 for r in got)
    wrong = estimates.withColumn("estimate", F.col("estimate") + 100)
    assert not any(r["within"] for r in SK.quantile_bounds(tall, wrong, ["side"]).where("p < 0.8").collect())
