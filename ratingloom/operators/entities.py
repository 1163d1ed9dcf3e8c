"""Recognising financial-sector issuers and leaving them out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.functions.cleaning import text_or_empty
from ratingloom.operators.picking import pick_first


def _any_part(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def is_financial(ticker: Column, sector: Column, industry: Column, name: Column) -> Column:
    """By listed ticker, exact sector, part of the industry, or part of the name."""
    lower_name = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.trim(ticker).isin(V.FINANCIAL_TICKERS)
        | F.lower(text_or_empty(sector)).isin(V.FINANCIAL_SECTORS)
        | _any_part(F.lower(text_or_empty(industry)), V.FINANCIAL_INDUSTRY_PARTS)
        | _any_part(lower_name, V.FINANCIAL_NAME_PARTS)
    )


def rated_entities(ratings: DataFrame, tie: str) -> DataFrame:
    """One (ticker, name, sector, industry) per rated ticker.

    The sector is the newest one given, the industry that of the same row. The
    name is the newest one given, but only rows up to the one with the sector
    count; otherwise it is blank. Two minima over (newest first) decide this
    without ordering a ticker's rows.
    """
    place = F.struct((-F.col("fiscal_year")).alias("y"), F.col(tie).alias("t"))
    name, sector = text_or_empty(F.col("company_name")), text_or_empty(F.col("sector"))
    found = ratings.groupBy(F.trim("ticker").alias("ticker")).agg(
        F.min(F.when(name != "", F.struct(place.alias("p"), name.alias("v")))).alias("_n"),
        F.min(
            F.when(sector != "", F.struct(place.alias("p"), sector.alias("v"), text_or_empty(F.col("industry")).alias("i")))
        ).alias("_s"),
    )
    in_reach = F.col("_s").isNull() | (F.col("_n.p") <= F.col("_s.p"))
    return found.select(
        "ticker",
        F.when(in_reach, F.coalesce(F.col("_n.v"), F.lit(""))).otherwise("").alias("company_name"),
        F.coalesce(F.col("_s.v"), F.lit("")).alias("sector"),
        F.coalesce(F.col("_s.i"), F.lit("")).alias("industry"),
    )


def financial_tickers(ratings: DataFrame, panel: DataFrame, tie: str) -> DataFrame:
    """Distinct tickers to leave out: rated ones by all rules, unrated ones by name."""
    rated = rated_entities(ratings, tie)
    unrated = pick_first(
        panel.select(F.trim("ticker").alias("ticker"), "fiscal_year", "company_name"), ["ticker"], [F.col("fiscal_year")]
    ).join(rated.select("ticker"), "ticker", "left_anti")
    everyone = rated.unionByName(
        unrated.select("ticker", "company_name", F.lit("").alias("sector"), F.lit("").alias("industry"))
    )
    flagged = is_financial(F.col("ticker"), F.col("sector"), F.col("industry"), F.col("company_name"))
    return everyone.where(flagged).select("ticker")


def drop_tickers(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows whose trimmed ticker is not excluded."""
    right = excluded.select(F.col("ticker").alias("_excluded"))
    return df.join(right, F.trim(df["ticker"]) == right["_excluded"], "left_anti")
