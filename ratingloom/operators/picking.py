"""Choosing one row per key, and ranks, without putting a whole key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key that comes first in `order` (ascending).

    A minimum over structs, so it is combined before the shuffle and a key with
    a third of all rows is no worse than any other. Remaining columns close the
    order, so the choice does not depend on how rows are partitioned.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(F.min(ranked).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def prefer_agency(column: str, preferred: str) -> Column:
    """0 for the preferred agency, 1 for others: an ascending sort key."""
    return F.when(F.lower(F.trim(F.col(column))) == preferred, 0).otherwise(1)


def rank_by_buckets(
    df: DataFrame, bucket: Sequence[Column], order: Sequence[Column], within: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """0-based row number in `order` per `within` group, exact for groups of any size.

    `bucket` is a coarse key that never decreases along `order`. Rows are
    numbered inside (group, bucket) and shifted by the number of rows in earlier
    buckets, so only the table of bucket counts is ever ordered as a whole.
    """
    marked = df
    cols = []
    for i, b in enumerate(bucket):
        cols.append(f"_b{i}")
        marked = marked.withColumn(cols[-1], b)
    cells = [*within, *cols]
    counts = marked.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*within).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*cells, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*cells).orderBy(*order)
    ranked = marked.withColumn("_inside", F.row_number().over(inside) - 1)
    return ranked.join(offsets, cells).withColumn(name, F.col("_offset") + F.col("_inside")).drop(
        *cols, "_inside", "_offset"
    )
