"""Named queries of this subpackage with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ratingloom.plans.registry import Query
from ratingloom.session import ship_package

#: Rows of an Arrow batch: texts are long, and each worker holds a batch and what it makes of it.
BATCH_ROWS, BATCH_ROWS_KEY = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers and keep Arrow batches of texts small; a smaller setting stays."""
    ship_package(spark)
    if not 0 < int(spark.conf.get(BATCH_ROWS_KEY)) <= BATCH_ROWS:
        spark.conf.set(BATCH_ROWS_KEY, str(BATCH_ROWS))


def prepared(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    return run

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = prepared(fn)
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with the schema its files have now."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
