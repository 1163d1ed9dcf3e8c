"""Small helpers of the registered queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Floating columns rounded, so that engines can be compared by value."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def longs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def r6(expression: str, alias: str, digits: int = 6) -> str:
    """The SQL side of `rounded`; adding 0 turns -0 into 0."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0) AS {alias}"


def rlist(columns: Sequence[str], prefix: str = "") -> str:
    return ", ".join(r6(prefix + c, c) for c in columns)


def i8(expression: str, alias: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {alias}"


def ilist(columns: Sequence[str], prefix: str = "") -> str:
    return ", ".join(i8(prefix + c, c) for c in columns)


def rounded_news(df: DataFrame) -> DataFrame:
    """Sentiment aggregates rounded; means of four-decimal scores tie at six digits, not at nine."""
    return rounded(rounded(df, ["sentiment_std", "sentiment_pos_pct", "sentiment_neg_pct"]), ["sentiment_mean"], 9)


def news_sql(prefix: str = "", default: str | None = None) -> str:
    """The SQL side of `rounded_news`."""
    columns = {"sentiment_mean": 9, "sentiment_std": 6, "sentiment_pos_pct": 6, "sentiment_neg_pct": 6}
    given = {c: f"coalesce({prefix}{c}, {default})" if default is not None else prefix + c for c in columns}
    return ", ".join(r6(given[c], c, digits) for c, digits in columns.items())
