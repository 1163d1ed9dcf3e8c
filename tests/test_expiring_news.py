"""Late and repeated articles, expiring state and compaction of the endless news stream."""

import datetime as dt

from pyspark.sql import functions as F

from ratingloom.streaming import expiring_news as EN

SCHEMA = "ticker string, fiscal_year int, ts timestamp, url string, score double"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_late_repeated_and_expired(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")

    def arrive(*rows):
        spark.createDataFrame([(t, 2024, ts, url, score) for t, ts, url, score in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        return EN.run_available(EN.daily_sums(stream, "1 day"), out, mark)

    def found():
        return {(r["ticker"], r["day"].day): (r["rows"], round(r["total"], 6)) for r in EN.read_days(spark, out).collect()}

    arrive(("a", at(1, 9), "u", 1.0), ("a", at(1, 9), "u", 1.0), ("a", at(1, 10), "u ", 1.0), ("a", at(1, 11), None, 0.5), ("a", at(1, 12), "", -0.5), ("b", at(1, 9), "u", -1.0))
    run()
    assert found() == {}  # the day is still open
    arrive(("a", at(4), "v", 0.25))
    run()
    assert found() == {("a", 1): (3, 1.0), ("b", 1): (1, -1.0)}
    # the first day is closed: an article of it comes too late
    arrive(("a", at(1, 15), "late", 1.0), ("b", at(4, 1), "w", 0.5), ("b", at(4, 2), "w", 0.5))
    run()
    arrive(("a", at(20), "x", 1.0))
    states = run()
    assert found() == {("a", 1): (3, 1.0), ("b", 1): (1, -1.0), ("a", 4): (1, 0.25), ("b", 4): (1, 0.5)}
    assert states[-1] == 2  # only the url and the day of the last article are kept
    # compaction changes no row, deletes the batches, and later batches are added to it
    folders = EN._folders(spark, out)
    assert EN.compact(spark, out) == len(folders) > 2 and len(EN._folders(spark, out)) == 1 and EN.compact(spark, out) == 0
    arrive(("a", at(30), "y", 1.0))
    run()
    assert found()[("a", 20)] == (1, 1.0) and len(found()) == 5
    assert EN.compact(spark, out) >= 2 and len(found()) == 5
    got = {r["ticker"]: r for r in EN.aggregates(EN.read_days(spark, out)).collect()}
    scores = [1.0, 0.5, -0.5, 0.25, 1.0]
    mean = sum(scores) / 5
    assert got["a"]["news_count"] == 5 and abs(got["a"]["sentiment_mean"] - mean) < 1e-12
    assert abs(got["a"]["sentiment_std"] - (sum((s - mean) ** 2 for s in scores) / 5) ** 0.5) < 1e-12
    assert (got["a"]["sentiment_pos_pct"], got["a"]["sentiment_neg_pct"], got["b"]["news_count"]) == (0.8, 0.2, 2)


def test_nothing_written_yet(spark, tmp_path):
    assert EN.read_days(spark, str(tmp_path / "none")).count() == 0 and EN.compact(spark, str(tmp_path / "none")) == 0
    assert EN.aggregates(EN.read_days(spark, str(tmp_path / "none"))).where(F.lit(True)).count() == 0
