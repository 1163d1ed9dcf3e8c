"""Nested statement documents: one JSON object per issuer, three statements by period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom import schemas
from ratingloom.functions.cleaning import nan_to_null
from ratingloom.functions.ratios import core_ratios_by_name, first_line_item
from ratingloom.operators.panel import pick_period

STATEMENTS = ["balance_sheet", "income_statement", "cashflow"]


def read_statements(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Statement documents with the declared schema; a bare NaN is read as a number."""
    reader = spark.read.schema(schemas.STATEMENT_DOCUMENT).option("multiLine", multi_line)
    return reader.option("mode", "PERMISSIVE").option("allowNonNumericNumbers", True).json(path)


def statement_lines(documents: DataFrame) -> DataFrame:
    """(ticker, statement, period, item, value), one row per reported line, NaN as NULL."""
    sections = F.explode(F.array(*[F.struct(F.lit(s).alias("statement"), F.col(s).alias("periods")) for s in STATEMENTS]))
    by_section = documents.select("ticker", sections.alias("s")).select("ticker", "s.statement", F.explode("s.periods").alias("period", "lines"))
    items = by_section.select("ticker", "statement", "period", F.explode("lines").alias("item", "value"))
    return items.withColumn("value", nan_to_null(F.col("value")))


def yearly_lines(documents: DataFrame, statement: str) -> DataFrame:
    """(ticker, fiscal_year, period_end, lines) with one period per year: 31 December, else the latest."""
    periods = documents.select("ticker", F.explode(statement).alias("period", "lines"))
    end = F.coalesce(F.try_to_timestamp("period", F.lit("yyyy-MM-dd")), F.try_to_timestamp("period", F.lit("yyyy"))).cast("date")
    entries = F.transform_values("lines", lambda _, v: nan_to_null(v))
    # entries as an array: maps have no order, and the pick is a minimum over rows
    rows = periods.select("ticker", end.alias("period_end"), F.sort_array(F.map_entries(entries)).alias("lines"))
    picked = pick_period(rows, ["ticker"])
    return picked.withColumn("lines", F.map_from_entries("lines"))


def statement_ratios(documents: DataFrame) -> DataFrame:
    """Totals and the four ratios per ticker and year.

    Without a balance sheet of the year every value is NULL; the period end is
    then the income statement's.
    """
    balance = yearly_lines(documents, "balance_sheet").select("ticker", "fiscal_year", F.col("period_end").alias("_b"), F.col("lines").alias("_bl"))
    income = yearly_lines(documents, "income_statement").select("ticker", "fiscal_year", F.col("period_end").alias("_i"), F.col("lines").alias("_il"))
    both = balance.join(income, ["ticker", "fiscal_year"], "full")
    lines = {n: first_line_item(F.col("_il" if n == "ebit" else "_bl"), n) for n in V.LINE_ITEM_ALIASES}
    named = both.select("ticker", "fiscal_year", F.coalesce("_b", "_i").cast("string").alias("statement_period_end"), *[c.alias(n) for n, c in lines.items()])
    ratios = [c.alias(n) for n, c in core_ratios_by_name().items()]
    return named.select("ticker", "fiscal_year", "statement_period_end", "total_assets", "total_liabilities", "total_equity", *ratios)
