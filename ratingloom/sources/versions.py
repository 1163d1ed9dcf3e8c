"""Tables kept in versions, of which a new one rewrites only the partitions that changed.

A version is a list of partitions, each with the folder it lies in, its rows and a checksum that
does not depend on their order. Writing compares checksums, writes the
changed partitions to a folder of the new version, and then adds the version's list in one file,
which is the moment it becomes the current one; until then, and after a failure, readers
see the one before. Unchanged partitions keep their files. Older versions stay readable until
they are cleared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.session import remove_path

_LIST = "version int, partition string, folder int, rows bigint, checksum string"


def checksum(columns: Sequence[str]) -> list:
    """Aggregates of a group: the number of its rows and a checksum that ignores their order."""
    row = F.xxhash64(*[F.col(c) for c in sorted(columns)])
    # two sums of different hashes, so that rows cannot cancel out by one
    both = F.concat_ws("-", F.sum(row.cast("decimal(38,0)")).cast("string"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).cast("string"))
    return [F.count(F.lit(1)).alias("rows"), both.alias("checksum")]


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, partition, folder, rows, checksum) of every version that was completed; none for a new table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], _LIST)
    return spark.read.schema(_LIST).parquet(f"{root}/versions")


def _listed(spark: SparkSession, root: str, version: int | None) -> list:
    known = versions(spark, root)
    wanted = version if version is not None else known.agg(F.max("version")).first()[0]
    return known.where(F.col("version") == F.lit(wanted)).orderBy("partition").collect() if wanted is not None else []


def write_version(df: DataFrame, root: str, by: str = "fiscal_year") -> DataFrame:
    """Makes `df` the current version; (partition, rewritten, rows) of every partition there is or was.

    rewritten is 1 for a partition that is new, has other rows, or is gone (then with 0 rows). A row
    without a value of `by` belongs to the partition NULL. `df` is read twice. One row per
    partition comes to the driver.
    """
    spark = df.sparkSession
    name = F.coalesce(F.col(by).cast("string"), F.lit("NULL"))
    before = {r["partition"]: r for r in _listed(spark, root, None)}
    number = max((r["version"] for r in before.values()), default=-1) + 1
    now = {r["partition"]: r for r in df.groupBy(name.alias("partition")).agg(*checksum(df.columns)).collect()}
    changed = [p for p, r in now.items() if p not in before or (before[p]["rows"], before[p]["checksum"]) != (r["rows"], r["checksum"])]
    if changed:
        parts = df.where(name.isin(changed)).withColumn("_partition", name)
        # what a failed write left in the folder is replaced; few files per partition, but one with a third of all rows is split over several tasks
        parts.hint("rebalance", "_partition").write.mode("overwrite").partitionBy("_partition").parquet(f"{root}/data/{number}")
    listed = [(number, p, number if p in changed else before[p]["folder"], r["rows"], r["checksum"]) for p, r in sorted(now.items())]
    if changed or set(before) - set(now):
        rows = listed or [(number, "", number, 0, "")]  # an empty version is a version
        spark.createDataFrame(rows, _LIST).coalesce(1).write.mode("append").parquet(f"{root}/versions")
    report = [(p, int(p in changed), r["rows"]) for p, r in now.items()] + [(p, 1, 0) for p in before if p not in now and p]
    return spark.createDataFrame(sorted(report), "partition string, rewritten int, rows bigint")


def read_version(spark: SparkSession, root: str, schema, version: int | None = None, partitions: Sequence[str] | None = None) -> DataFrame:
    """The rows of a version, by default the current one; with `partitions` only those are opened."""
    chosen = [r for r in _listed(spark, root, version) if r["rows"] and (partitions is None or r["partition"] in partitions)]
    paths = [f"{root}/data/{r['folder']}/_partition={r['partition']}" for r in chosen]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def clear_before(spark: SparkSession, root: str, version: int) -> list[int]:
    """Deletes the folders that no version from this one on uses; gives their numbers. Older versions can then no longer be read."""
    used = versions(spark, root).groupBy("folder").agg(F.max("version").alias("last")).where(F.col("last") < version).orderBy("folder").collect()
    for r in used:
        remove_path(spark, f"{root}/data/{r['folder']}")
    return [r["folder"] for r in used]
