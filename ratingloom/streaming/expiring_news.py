"""News as an endless stream: late and repeated articles are dropped, state expires, batches are compacted.

Articles are aggregated per key and day of their event time. An article whose url was seen within
the watermark is a repeat, one older than the watermark is too late; both are left out. Once the
watermark has passed a day's end its sums are written once and leave the state, so state grows with the
open days and not with the history. Sums of days add up to the aggregates of a key. The
many small batches are rewritten into one from time to time; a list of them says
which folders are valid, so a reader never sees a batch twice or not at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.operators.panel import KEYS
from ratingloom.session import remove_path

_SUMS = "day date, rows bigint, total double, squares double, positive bigint, negative bigint"


def daily_sums(articles: DataFrame, delay: str, time: str = "ts", url: str = "url", keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """(keys, day, sums) of a stream of scored articles, each url of a key once within `delay`.

    An article without a url is never a repeat. Rows come out when their day can get no more
    articles.
    """
    bounded = articles.withWatermark(time, delay)
    # a missing url becomes one of its own, made of the whole row
    whole = F.concat_ws("|", F.lit("none"), *[F.col(c).cast("string") for c in articles.columns])
    named = bounded.withColumn("_url", F.when(F.trim(F.coalesce(F.col(url), F.lit(""))) != "", F.trim(F.col(url))).otherwise(whole))
    once = named.dropDuplicatesWithinWatermark([*keys, "_url"])
    score = F.col("score")
    sums = once.groupBy(*keys, F.window(time, "1 day").alias("_w")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(score).alias("total"), F.sum(score * score).alias("squares"),
        F.count_if(score > 0).alias("positive"), F.count_if(score < 0).alias("negative"),
    )
    return sums.select(*keys, F.col("_w.start").cast("date").alias("day"), "rows", "total", "squares", "positive", "negative")


def run_available(sums: DataFrame, out: str, checkpoint: str) -> list[int]:
    """Processes what is there and writes each batch's finished days below `out`; gives the rows of state after each batch.

    A batch writes its own folder, so one repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/days/batch={number}")

    started = sums.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    started.awaitTermination()
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in started.recentProgress]


def _folders(spark: SparkSession, out: str) -> list[str]:
    """The folders that hold the current rows: the newest compaction and the batches after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(out).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(folder: str, prefix: str) -> list[int]:
        place = path(f"{out}/{folder}")
        if not files.exists(place):
            return []
        names = [s.getPath() for s in files.listStatus(place)]
        return sorted(int(p.getName().removeprefix(prefix)) for p in names if p.getName().startswith(prefix) and files.exists(path(p, "_SUCCESS")))

    merged = numbers("merged", "upto=")
    last = merged[-1] if merged else -1
    return [*[f"{out}/merged/upto={last}" for _ in merged[-1:]], *[f"{out}/days/batch={b}" for b in numbers("days", "batch=") if b > last]]


def read_days(spark: SparkSession, out: str, keys: str = "ticker string, fiscal_year int") -> DataFrame:
    """(keys, day, sums) written so far."""
    schema, folders = f"{keys}, {_SUMS}", _folders(spark, out)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def compact(spark: SparkSession, out: str, keys: str = "ticker string, fiscal_year int") -> int:
    """Rewrites the batches so far into one folder and deletes them; gives how many folders that were.

    The new folder counts from the moment it is complete, and it names the last batch in it, so readers
    change over at once and a batch that arrives meanwhile is kept.
    """
    before = _folders(spark, out)
    batches = [f for f in before if "/days/batch=" in f]
    if len(before) < 2 or not batches:
        return 0
    last = int(batches[-1].rsplit("=", 1)[1])
    spark.read.schema(f"{keys}, {_SUMS}").parquet(*before).hint("rebalance").write.mode("overwrite").parquet(f"{out}/merged/upto={last}")
    for folder in before:
        remove_path(spark, folder)
    return len(before)


def aggregates(days: DataFrame, keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """Mean, population deviation, shares of positive and negative scores, and count per key, from the sums of days."""
    n = F.sum("rows")
    mean = F.sum("total") / n
    spread = F.sqrt(F.greatest(F.sum("squares") / n - mean * mean, F.lit(0.0)))
    return days.groupBy(*keys).agg(
        mean.alias("sentiment_mean"), F.when(n > 1, spread).otherwise(0.0).alias("sentiment_std"), (F.sum("positive") / n).alias("sentiment_pos_pct"),
        (F.sum("negative") / n).alias("sentiment_neg_pct"), n.alias("news_count"),
    )
