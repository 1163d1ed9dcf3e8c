"""Ratings of several agencies: long form, consensus, disagreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.functions.cleaning import blank_to_null
from ratingloom.functions.ratings import harmonise, notch_to_rating, rating_notch


def unpivot_agencies(wide: DataFrame, keys: Sequence[str], agencies: Sequence[str] = tuple(V.AGENCY_COLUMNS)) -> DataFrame:
    """One (key, agency, rating, notch) row per given rating on the common scale."""
    cells = F.array(*[F.struct(F.lit(a).alias("agency"), F.col(a).alias("given")) for a in agencies])
    tall = wide.select(*keys, F.explode(cells).alias("_c"))
    tall = tall.select(*keys, "_c.agency", harmonise(blank_to_null(F.col("_c.given"))).alias("rating"))
    return tall.where(F.col("rating").isNotNull()).select(*keys, "agency", "rating", rating_notch(F.col("rating")).alias("notch"))


def unknown_letters(wide: DataFrame, keys: Sequence[str], agencies: Sequence[str] = tuple(V.AGENCY_COLUMNS)) -> DataFrame:
    """(key, agency, given, rating) of the given ratings that are not on the common scale and so have no notch."""
    cells = F.array(*[F.struct(F.lit(a).alias("agency"), F.col(a).alias("given")) for a in agencies])
    tall = wide.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")
    rated = tall.withColumn("rating", harmonise(blank_to_null(F.col("given")))).where(F.col("rating").isNotNull())
    return rated.where(rating_notch(F.col("rating")).isNull())


def consensus(long: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Median notch over agencies and its letter, a half notch going down.

    The 22 possible values bound the state of the median whatever the group size.
    """
    found = long.where(F.col("notch").isNotNull()).groupBy(*keys).agg(
        F.median("notch").alias("median_notch"), F.count(F.lit(1)).alias("ratings")
    )
    return found.withColumn("consensus", notch_to_rating(F.floor("median_notch")))


def disagreement(long: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Spread in notches, with the best and worst letter and the number of agencies."""
    found = long.where(F.col("notch").isNotNull()).groupBy(*keys).agg(
        F.max("notch").alias("_hi"),
        F.min("notch").alias("_lo"),
        F.count_distinct("agency").alias("agencies"),
    )
    return found.select(
        *keys,
        (F.col("_hi") - F.col("_lo")).alias("spread"),
        notch_to_rating(F.col("_hi")).alias("best"),
        notch_to_rating(F.col("_lo")).alias("worst"),
        "agencies",
    )


def consolidate_sources(sources: Sequence[tuple[int, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """Union of rating sources, the lowest-numbered source winning per key."""
    from ratingloom.operators.picking import pick_first

    out = None
    for rank, df in sources:
        part = df.withColumn("source_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return pick_first(out, list(keys), [F.col("source_rank")])
