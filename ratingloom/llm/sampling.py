"""A bounded sample of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = 1 << 30


def bounded(labels: DataFrame, rows: int, id_col: str = "doc_id") -> DataFrame:
    """About `rows` of the labelled rows, all if there are fewer, chosen by a hash of the id.

    The same ids give the same sample on every run. The table is counted first,
    so the sample has that size whatever the size of the table; `limit` makes the
    bound strict.
    """
    n = labels.count()
    if n <= rows:
        return labels
    return labels.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(SPACE)) < int(SPACE * rows / n)).limit(rows + rows // 5)
