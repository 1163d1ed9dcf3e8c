"""Column functions that turn loose text and NaN into typed values or NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java also reads "1d" and "0x1p3" as numbers; the inputs do not mean that.
_NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def nan_to_null(c: Column) -> Column:
    """NaN compares greater than every number in Spark, so it must not survive ingest."""
    return F.when(~F.isnan(c), c)


def to_number(c: Column) -> Column:
    """Double, or NULL for anything that is not a plain number."""
    text = c.cast("string")
    return F.when(text.rlike(_NUMERIC), text.try_cast("double"))


def to_year(c: Column) -> Column:
    """Integer year from 2023, "2023" or "2023.0"; NULL otherwise."""
    return to_number(c).try_cast("int")


def to_flag(c: Column) -> Column:
    """Integer code, NULL and text becoming 0."""
    return F.coalesce(to_number(c).try_cast("int"), F.lit(0))


def strip(c: Column) -> Column:
    """Without leading and trailing blanks, tabs and line ends."""
    return F.btrim(c, F.lit(" \t\n\r\f\x0b"))


def blank_to_null(c: Column) -> Column:
    trimmed = strip(c)
    return F.when(trimmed != "", trimmed)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def to_date_dmy(c: Column) -> Column:
    """Date from dd/MM/yyyy text, NULL when it does not parse."""
    return F.try_to_timestamp(c, F.lit("dd/MM/yyyy")).cast("date")


def in_fiscal_year(stamp: Column, year: Column) -> Column:
    """Whether a timestamp lies between 1 January and 31 December 23:59:59 of the year."""
    return F.year(stamp) == year
