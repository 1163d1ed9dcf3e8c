"""News that arrives as files: each file is taken once, aggregates follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingloom.operators.panel import KEYS
from ratingloom.operators.picking import pick_first


def read_news_stream(spark: SparkSession, path: str, glob: str = "*_news.json") -> DataFrame:
    """(file_name, value) of news files as they appear; a file name is taken once."""
    reader = spark.readStream.option("wholetext", True).option("pathGlobFilter", glob)
    return reader.text(path).select(F.col("_metadata.file_name").alias("file_name"), "value")


def read_table_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of Parquet files as they appear."""
    return spark.readStream.schema(schema).parquet(path)


def keep_aggregates(aggregates: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything available and write each batch's changed keys below `out`.

    A batch replaces its own folder, so a batch repeated after a failure leaves
    no second copy. State is one row per key.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    started = (
        aggregates.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    started.awaitTermination()


def read_aggregates(spark: SparkSession, out: str, keys=tuple(KEYS)) -> DataFrame:
    """The newest aggregate of each key."""
    versions = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return pick_first(versions, list(keys), [-F.col("batch")]).drop("batch")
