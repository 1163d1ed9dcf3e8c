"""Tables an operator writes for itself in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.session import remove_path, scratch_path


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns named by position, and the new name of each.

    An operator that carries all columns of its input works on this one, so that
    no column can clash with its own.
    """
    names = [f"column_{k}" for k in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


#: Ids up to which a list of them is sent to every task (a few megabytes); beyond it Spark joins by shuffle.
BROADCAST_IDS = 500_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of documents with a stored list of ids; the texts are moved only for a long list."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


class Scratch:
    """One folder per run of an operator.

    Tables that later jobs read more than once are written here, so they
    survive the loss of executors and are not computed again. `drop` removes a
    table as soon as nothing reads it any more; what the returned DataFrame
    still reads stays until `clear` or the end of the cluster's scratch period.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = scratch_path(spark, name)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove_path(self.spark, self.path(name))

    def clear(self) -> None:
        remove_path(self.spark, self.folder)
