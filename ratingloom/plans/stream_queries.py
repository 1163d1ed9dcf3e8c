"""Queries that run as streams until nothing new is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratingloom.operators.news import aggregate_scores
from ratingloom.plans import roles as R
from ratingloom.plans.common import news_sql, rounded_news
from ratingloom.plans.registry import query
from ratingloom.plans.roles import with_roles
from ratingloom.session import scratch_path
from ratingloom.streaming import expiring_news as EN
from ratingloom.streaming.news_stream import keep_aggregates, read_aggregates, read_table_stream


@query("news_stream", with_roles(["news"], f"SELECT ticker, fiscal_year, {news_sql()}, news_count FROM news"))
def news_stream(spark, sf):
    """The news aggregates, kept up to date by a stream over the events."""
    schema = R.table(spark, sf, "events").schema
    events = read_table_stream(spark, f"{sf}/events.parquet*", schema)
    out = scratch_path(spark, "news-stream")
    keep_aggregates(aggregate_scores(R.articles_of(events)), out, f"{out}-checkpoint")
    return rounded_news(read_aggregates(spark, out))


# A url is an event type of a user on one day; a repeat is a later event of it on that day. The last
# day stays open, as no later event moves the watermark past it.
@query(
    "expiring_news_stream",
    with_roles(
        ["articles"],
        f"""WITH u AS (SELECT *, event_type || '/' || CAST(ts AS DATE) AS url FROM articles),
once AS (SELECT ticker, CAST(ts AS DATE) AS day, url, count(*) AS copies FROM u GROUP BY 1, 2, 3),
open_from AS (SELECT CAST(max(ts) - INTERVAL 1 DAY AS TIMESTAMP) AS mark FROM u)
SELECT ticker, CAST(count(*) AS BIGINT) AS news_count FROM once, open_from WHERE day + INTERVAL 1 DAY <= mark GROUP BY 1""",
    ),
)
def expiring_news_stream(spark, sf):
    """Different articles per ticker of the days that are closed, from an endless stream whose state expires."""
    schema = R.table(spark, sf, "events").schema
    events = R.articles_of(read_table_stream(spark, f"{sf}/events.parquet*", schema))
    named = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("url", F.concat("event_type", F.lit("/"), F.col("ts").cast("date").cast("string"))).select("ticker", "fiscal_year", "ts", "url", "score")
    out = scratch_path(spark, "expiring-news")
    EN.run_available(EN.daily_sums(named.drop("fiscal_year"), "1 day", keys=["ticker"]), out, f"{out}-checkpoint")
    EN.compact(spark, out, "ticker string")
    return EN.aggregates(EN.read_days(spark, out, "ticker string"), ["ticker"]).select("ticker", "news_count")
