"""Versioned tables: only changed partitions are written anew."""

from pyspark.sql import functions as F

from ratingloom.session import scratch_path
from ratingloom.sources import versions as SV

SCHEMA = "ticker string, fiscal_year int, x double"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(df):
    return {f.rsplit("/", 1)[1] for f in df.inputFiles()}


def test_versions(spark):
    root = scratch_path(spark, "test-versions")
    first = [("a", 2020, 1.0), ("b", 2020, 2.0), ("b", 2020, 2.0), ("a", 2021, None), ("a", None, 3.0)]
    make = lambda data: spark.createDataFrame(data, SCHEMA)
    assert rows(SV.read_version(spark, root, SCHEMA)) == []
    assert rows(SV.write_version(make(first).repartition(3), root)) == [("2020", 1, 3), ("2021", 1, 1), ("NULL", 1, 1)]
    kept = files(SV.read_version(spark, root, SCHEMA, partitions=["2020"]))
    # another order, one year changed, one gone, one new
    second = [("b", 2020, 2.0), ("a", 2020, 1.0), ("b", 2020, 2.0), ("a", 2021, 0.5), ("c", 2022, 1.0)]
    assert rows(SV.write_version(make(second).repartition(2), root)) == [("2020", 0, 3), ("2021", 1, 1), ("2022", 1, 1), ("NULL", 1, 0)]
    assert files(SV.read_version(spark, root, SCHEMA, partitions=["2020"])) == kept
    assert rows(SV.read_version(spark, root, SCHEMA)) == sorted(second, key=str)
    assert rows(SV.read_version(spark, root, SCHEMA, version=0)) == sorted(first, key=str)
    # the same again writes nothing; a copy more is a change
    assert all(r["rewritten"] == 0 for r in SV.write_version(make(second), root).collect())
    assert SV.versions(spark, root).agg(F.max("version")).first()[0] == 1
    assert rows(SV.write_version(make([*second, second[0]]), root))[0] == ("2020", 1, 4)
    assert SV.clear_before(spark, root, 1) == []  # version 1 still has 2020 from folder 0
    assert SV.clear_before(spark, root, 2) == [0]
    assert rows(SV.read_version(spark, root, SCHEMA)) == sorted([*second, second[0]], key=str)
    assert rows(SV.write_version(make([]), root)) == [("2020", 1, 0), ("2021", 1, 0), ("2022", 1, 0)]
    assert rows(SV.read_version(spark, root, SCHEMA)) == []
    assert rows(SV.write_version(make(second[:1]), root)) == [("2020", 1, 1)]


def test_a_failed_write_leaves_the_current_version(spark):
    root = scratch_path(spark, "test-versions")
    SV.write_version(spark.createDataFrame([("a", 2020, 1.0)], SCHEMA), root)
    spark.createDataFrame([("x", 2020, 9.0)], SCHEMA).withColumn("_partition", F.lit("2020")).write.partitionBy("_partition").parquet(f"{root}/data/1/unfinished")
    assert rows(SV.read_version(spark, root, SCHEMA)) == [("a", 2020, 1.0)]
    SV.write_version(spark.createDataFrame([("b", 2020, 2.0)], SCHEMA), root)
    assert rows(SV.read_version(spark, root, SCHEMA)) == [("b", 2020, 2.0)]
