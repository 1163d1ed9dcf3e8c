"""Reading and writing tables: CSV, Parquet, JSON lines, reports, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingloom import fixed_values as V
from ratingloom import schemas
from ratingloom.functions.cleaning import nan_to_null, to_year
from ratingloom.operators.verdicts import records_as_jsonl


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema; bad cells and NaN become NULL.

    Columns are matched by header name, so the files may have fewer or reordered
    columns; those they lack are NULL. All files of one path must have the same
    header; reading fails at a file whose header is another.
    """
    header = spark.read.option("header", True).csv(path).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.schema(text).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").csv(path)
    cells = []
    for f in schema.fields:
        if f.name not in header:
            cells.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.DoubleType):
            cells.append(nan_to_null(F.col(f.name).try_cast("double")).alias(f.name))
        elif isinstance(f.dataType, T.IntegerType):
            cells.append(to_year(F.col(f.name)).alias(f.name))
        else:
            cells.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return raw.select(*cells)


def write_csv(df: DataFrame, path: str) -> None:
    """The whole table, replacing what is there, in as many files as it has partitions."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_panel(df: DataFrame, path: str, by: str = "fiscal_year") -> None:
    """Parquet partitioned by year.

    Rows are rebalanced by year first: few files per year, but a year with a
    third of all rows is split over several tasks.
    """
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)


def read_panel(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_jsonl(records: DataFrame, path: str) -> None:
    """Instruction-set records, one JSON object per line."""
    records_as_jsonl(records).write.mode("overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Instruction-set records with the verdict inside `output` parsed."""
    rows = spark.read.schema(schemas.SFT_RECORD).json(path)
    return rows.withColumn("verdict", F.from_json("output", V.VERDICT_SCHEMA))


def long_report(df: DataFrame, keys: Sequence[str], section: str) -> DataFrame:
    """A result table as (section, key, metric, value) rows, the common report form."""
    metrics = [c for c in df.columns if c not in keys]
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    flat = df.select(key.alias("key"), *[F.col(m).cast("double").alias(m) for m in metrics])
    return flat.unpivot("key", metrics, "metric", "value").select(F.lit(section).alias("section"), "key", "metric", "value")


def report_json(report: DataFrame) -> DataFrame:
    """One JSON object per report section and key, metrics in name order."""
    pairs = F.sort_array(F.collect_list(F.struct("metric", "value")))
    return report.groupBy("section", "key").agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def write_report(report: DataFrame, path: str) -> None:
    report_json(report).write.mode("overwrite").json(path)


def retain_years(df: DataFrame, retired: Sequence[int] = tuple(V.RETIRED_YEARS), columns: Sequence[str] = tuple(V.YEAR_COLUMNS)) -> DataFrame:
    """Rows of years that are not retired; a year that does not parse is kept.

    A table without a year column is returned as it is.
    """
    out = df
    for c in columns:
        if c in df.columns:
            out = out.where(~F.coalesce(to_year(F.col(c)).isin(list(retired)), F.lit(False)))
    return out


def retirement_counts(df: DataFrame, table: str, retired: Sequence[int] = tuple(V.RETIRED_YEARS), columns: Sequence[str] = tuple(V.YEAR_COLUMNS)) -> DataFrame:
    """How many rows a retention run leaves in a table; unchanged tables need no rewrite."""
    gone = F.lit(False)
    for c in columns:
        if c in df.columns:
            gone = gone | F.coalesce(to_year(F.col(c)).isin(list(retired)), F.lit(False))
    counted = df.agg(F.count(F.lit(1)).alias("rows_in"), F.count(F.when(~gone, 1)).alias("rows_out"))
    return counted.select(F.lit(table).alias("table_name"), "rows_in", "rows_out", (F.col("rows_in") != F.col("rows_out")).cast("int").alias("changed"))
