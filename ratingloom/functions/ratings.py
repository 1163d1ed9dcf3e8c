"""Rating letters: categories, notches, binary targets, scale harmonisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom import fixed_values as V


def _literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def rating_category(c: Column, trim: bool = False) -> Column:
    """AA, A, BBB or BB; unknown and missing letters are BB."""
    letter = F.trim(c) if trim else c
    out = F.lit(V.DEFAULT_CATEGORY)
    for category, letters in V.CATEGORY_LETTERS.items():
        out = F.when(letter.isin(letters), F.lit(category)).otherwise(out)
    return out


def is_known_rating(c: Column) -> Column:
    """False for the letters that `rating_category` silently turns into BB."""
    return F.coalesce(c.isin([letter for letter, _ in V.RATING_SCALE]), F.lit(False))


def rating_notch(c: Column) -> Column:
    """Ordinal 0 (D) to 21 (AAA); NULL for unknown letters."""
    return _literal_map(V.RATING_SCALE)[c]


def notch_to_rating(c: Column) -> Column:
    return _literal_map([(n, letter) for letter, n in V.RATING_SCALE])[c.cast("int")]


def rating_scale(spark: SparkSession) -> DataFrame:
    """The 22-row scale as a dimension table."""
    return spark.createDataFrame(V.RATING_SCALE, "rating string, notch int")


def binary_below_investment_grade(c: Column) -> Column:
    """1 below BBB-; a missing rating is 0."""
    letter = F.upper(F.trim(c))
    return F.when(c.isNull(), 0).when(letter.rlike("^(A|BBB)"), 0).otherwise(1)


def binary_below_a(c: Column) -> Column:
    """1 below A-; unknown and missing ratings are 1. Shipped targets follow this one."""
    return F.when(F.coalesce(rating_notch(c), F.lit(0)) >= V.NOTCH_A_MINUS, 0).otherwise(1)


def binary_investment_grade(c: Column) -> Column:
    """1 for BBB- and better, 0 below, NULL when unknown."""
    return (rating_notch(c) >= V.NOTCH_INVESTMENT_GRADE).cast("int")


def risk_class(category: Column) -> Column:
    return F.when(category.isin(V.INVESTMENT_CATEGORIES), V.RISK_CLASS_INVESTMENT).otherwise(V.RISK_CLASS_SPECULATIVE)


def risk_grade(letter: Column) -> Column:
    """The two-way text by notch, used in instruction sets."""
    notch = F.coalesce(rating_notch(letter), F.lit(0))
    return F.when(notch >= V.NOTCH_INVESTMENT_GRADE, "Investment Grade").otherwise("Speculative Grade")


def moodys_to_common(c: Column) -> Column:
    """Moody's letter on the common scale; other letters unchanged."""
    return F.coalesce(_literal_map(V.MOODYS_TO_COMMON.items())[c], c)


def drop_national_scale(c: Column) -> Column:
    """NULL for ratings given on a national scale."""
    return F.when(~c.rlike(V.NATIONAL_SCALE_PATTERN), c)


def harmonise(c: Column) -> Column:
    return drop_national_scale(moodys_to_common(F.trim(c)))
