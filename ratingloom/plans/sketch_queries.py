"""Queries that keep sketches as state and merge them upward."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.operators import sketches as SK
from ratingloom.operators import verdicts as VD
from ratingloom.plans import roles as R
from ratingloom.plans.evaluation_queries import predicted_panel
from ratingloom.plans.registry import query
from ratingloom.plans.roles import with_roles
from ratingloom.plans.verdict_queries import _GRAMS
from ratingloom.session import cut_lineage


@query(
    "sketched_diversity",
    "WITH " + _GRAMS.format(by="lang", text="text", source="documents") + " SELECT lang, count(DISTINCT gram) AS unique_trigrams, count(*) AS total_trigrams, true AS within FROM g GROUP BY 1",
)
def sketched_diversity(spark, sf):
    """Three-word runs per language from sketches kept per source, beside the exact number; within: the estimate keeps its bound."""
    docs = R.table(spark, sf, "documents")
    state = cut_lineage(SK.distinct_state(SK.trigram_rows(docs, F.col("text"), ["lang", "source"]), ["lang", "source"], "gram"), "trigram-sketches")
    estimated = SK.distinct_estimates(SK.merge_distinct(state, ["lang"]))
    exact = VD.trigram_diversity(docs, F.col("text"), ["lang"])
    near = F.abs(F.col("estimate") - F.col("unique_trigrams")) <= F.col("unique_trigrams") * SK.DISTINCT_BOUND + 1
    return exact.join(estimated, "lang").select("lang", "unique_trigrams", F.col("rows").alias("total_trigrams"), near.alias("within"))


@query(
    "sketched_quartiles",
    with_roles(
        ["predicted"],
        " UNION ALL ".join(
            f"SELECT rating_category, '{c}' AS feature, p, count({c}) AS rows, true AS within FROM predicted, (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS p) GROUP BY 1, 3 HAVING count({c}) > 0" for c in V.RATIOS
        ),
    ),
)
def sketched_quartiles(spark, sf):
    """Quartiles of the ratios per category from sketches kept per year; within: their true ranks keep the bound."""
    keys = ["rating_category"]
    frame = cut_lineage(predicted_panel(spark, sf).select(*keys, "fiscal_year", *V.RATIOS), "sketch-values")
    state = cut_lineage(SK.quantile_state(frame, [*keys, "fiscal_year"], V.RATIOS), "quantile-sketches")
    estimates = cut_lineage(SK.quantile_estimates(SK.merge_quantiles(state, keys), [0.25, 0.5, 0.75]), "quartiles")
    values = frame.select(*keys, *[F.col(c).cast("double").alias(c) for c in V.RATIOS]).unpivot(keys, list(V.RATIOS), "feature", "value").where(F.col("value").isNotNull())
    return SK.quantile_bounds(values, estimates, keys).drop("estimate")
