import json
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from ratingloom import schemas
from ratingloom.operators import news as N
from ratingloom.sources import news_files as NF
from ratingloom.streaming import news_stream as S


def rows(df):
    return [tuple(r) for r in df.orderBy(*df.columns).collect()]


def write_news(folder, name, articles, text=None):
    body = text if text is not None else json.dumps({"ticker": "x", "year": 2023, "articles": articles})
    (folder / name).write_text(body, encoding="utf-8")


def news_folder(tmp_path):
    folder = tmp_path / "news"
    folder.mkdir()
    write_news(folder, "1_SR_2023_news.json", [{"title": "Strong profit", "description": "x", "url": "u1"}, {"title": "Loss", "snippet": "risk", "url": "u1"}])
    write_news(folder, "1_SR_2022_news.json", [])
    write_news(folder, "2_SR_2023_NEWS.json", [{"title": "Plain"}])
    write_news(folder, "bad_news.json", [{"title": "Gain"}])
    write_news(folder, "3_SR_2023_news.json", None, '{"articles": [{"title": "cut')
    write_news(folder, "4_SR_2023_news.json", None, "not json")
    return str(folder)


def test_news_files(spark, tmp_path):
    # the file name pattern ignores case; the listing pattern is the caller's
    parsed = NF.parse_news(NF.read_news_files(spark, news_folder(tmp_path), "*.json"))
    assert rows(NF.rejected(parsed)) == [("3_SR_2023_news.json", "json"), ("4_SR_2023_news.json", "json"), ("bad_news.json", "file name")]
    assert rows(NF.file_index(parsed)) == [("1.SR", 2022, 0), ("1.SR", 2023, 2), ("2.SR", 2023, 1)]
    articles = NF.article_rows(parsed)
    assert rows(articles.select("ticker", "fiscal_year", "text")) == [
        ("1.SR", 2022, None), ("1.SR", 2023, "Loss risk"), ("1.SR", 2023, "Strong profit x"), ("2.SR", 2023, "Plain"),
    ]


def test_aggregate_matches_plain_statistics(spark):
    data = {("a", 1): [0.5, -0.25, 0.0], ("b", 1): [0.3], ("c", 1): []}
    flat = [(k, y, s) for (k, y), ss in data.items() for s in (ss or [None])]
    got = {(r[0], r[1]): tuple(r)[2:] for r in N.aggregate_scores(spark.createDataFrame(flat, "ticker string, fiscal_year int, score double")).collect()}
    assert got[("c", 1)] == (0.0, 0.0, 0.0, 0.0, 0)
    assert got[("b", 1)] == (0.3, 0.0, 1.0, 0.0, 1)
    mean, std, pos, neg, n = got[("a", 1)]
    s = data[("a", 1)]
    assert abs(mean - statistics.mean(s)) < 1e-12 and abs(std - statistics.pstdev(s)) < 1e-12
    assert abs(pos - 1 / 3) < 1e-12 and abs(neg - 1 / 3) < 1e-12 and n == 3


def test_update_and_panel(spark):
    schema = "ticker string, fiscal_year int, sentiment_mean double, sentiment_std double, sentiment_pos_pct double, sentiment_neg_pct double, news_count long"
    base = spark.createDataFrame([("a", 1, 0.1, 0.1, 0.1, 0.1, 5), ("b", 1, 0.2, 0.2, 0.2, 0.2, 6)], schema)
    fresh = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0, 0.0, 0), ("z", 1, 0.9, 0.9, 0.9, 0.9, 9)], schema)
    assert rows(N.update_news(base, fresh).select("ticker", "sentiment_mean", "news_count")) == [("a", 0.0, 0), ("b", 0.2, 6)]
    panel = spark.createDataFrame([("a", 1), ("c", 1)], "ticker string, fiscal_year int")
    got = N.news_on_panel(panel, base).select("ticker", "sentiment_mean", "news_count", "has_news_coverage")
    assert rows(got) == [("a", 0.1, 5, 1), ("c", None, 0, 0)]  # no news stays NULL, not 0


def test_gaps_and_allow_list(spark):
    panel = spark.createDataFrame([("a", 1, "A"), ("b", 1, "B"), ("c", 1, "C")], "ticker string, fiscal_year int, company_name string")
    files = spark.createDataFrame([("a", 1, 3), ("b", 1, 0)], "ticker string, fiscal_year int, article_count int")
    assert rows(N.news_gap(panel, files).select("ticker")) == [("c",)]
    gap = N.news_gap(panel, files, refetch_empty=True)
    assert rows(gap.select("ticker")) == [("b",), ("c",)]
    allowed = N.parse_pairs(spark.createDataFrame([("b:1",), (" a : 1",), ("x:y:7",)], "pair string"))
    assert rows(N.keep_allowed(gap, allowed).select("ticker")) == [("b",)]
    assert rows(N.allowed_outside_gap(gap, allowed)) == [("a", 1), ("x:y", 7)]


def test_alias_copy_rewrites_tickers(spark):
    gap = spark.createDataFrame([("7204.SR", 2023), ("1.SR", 2023)], "ticker string, fiscal_year int")
    aliases = spark.createDataFrame([("7204.SR", "2070.SR")], "ticker string, source_ticker string")
    documents = spark.createDataFrame([("2070.SR", 2023, [("2070.SR", "t")]), ("2070.SR", 2022, [("2070.SR", "t")])], "ticker string, fiscal_year int, articles array<struct<ticker:string,title:string>>")
    got = N.copy_alias_news(gap, aliases, documents).select("ticker", "fiscal_year", F.col("articles")[0]["ticker"].alias("article_ticker"), "source_ticker")
    assert rows(got) == [("7204.SR", 2023, "7204.SR", "2070.SR")]
    files = documents.select("ticker", "fiscal_year")
    assert rows(N.gap_after_aliases(gap, aliases, files)) == [("1.SR", 2023)]


def test_urls(spark):
    data = [("a", 1, "u", 1), ("a", 1, "u ", 2), ("a", 1, "", 3), ("a", 1, None, 4), ("a", 2, "u", 5)]
    df = spark.createDataFrame(data, "ticker string, fiscal_year int, url string, n int")
    assert sorted(r["n"] for r in N.dedupe_urls(df, [F.col("n")]).collect()) == [1, 3, 4, 5]


def test_matching_tiers(spark):
    entities = spark.createDataFrame([("a", "Alpha Oil (Holding)"), ("b", "Beta")], "ticker string, company_name string")
    articles = spark.createDataFrame(
        [(1, 2023, "About alpha, OIL today: alpha oil"), (2, 2023, "alpha gas oil"), (3, 2023, "betamax"), (4, 2023, "see Beta!"), (5, 2024, "Bravo news"), (6, 2023, "Bravo")],
        "article_id long, fiscal_year int, text string",
    )
    symbols = spark.createDataFrame([(2, "a")], "article_id long, symbol string")
    phrases = N.entity_phrases(entities, {"b": ["Bravo"]})
    hits = [rows(N.phrase_hits(articles.repartition(n), phrases)) for n in (1, 3)]
    assert hits[0] == hits[1] == [(1, "a", 3), (4, "b", 3), (5, "b", 4), (6, "b", 4)]
    got = N.match_articles(entities, articles, symbols, phrases).select("ticker", "fiscal_year", "article_id", "tier")
    # a symbol hit hides the phrase hit of the same year; an extra phrase counts only where the name fails
    assert rows(got) == [("a", 2023, 2, 0), ("b", 2023, 4, 3), ("b", 2024, 5, 4)]


def test_batched_scoring_keeps_order_and_batches(spark):
    def load():
        def score(texts):
            assert len(texts) <= 16
            return [float(len(t)) for t in texts]

        return score

    df = spark.range(100).select(F.col("id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t")).repartition(3)
    got = N.score_articles(df, F.col("t"), load).select("id", "score").collect()
    assert len(got) == 100 and all(r["id"] == r["score"] for r in got)


def test_stream_takes_each_file_once(spark, tmp_path):
    from ratingloom.functions.text import lexicon_score

    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()

    def run():
        parsed = NF.parse_news(S.read_news_stream(spark, str(folder)))
        scored = NF.article_rows(parsed).withColumn("score", F.when(F.col("text").isNotNull(), lexicon_score(F.col("text"))))
        S.keep_aggregates(N.aggregate_scores(scored), out, mark)
        return rows(S.read_aggregates(spark, out).select("ticker", "fiscal_year", "sentiment_mean", "news_count"))

    write_news(folder, "1_SR_2023_news.json", [{"title": "profit"}])
    write_news(folder, "2_SR_2023_news.json", [])
    assert run() == [("1.SR", 2023, 1.0, 1), ("2.SR", 2023, 0.0, 0)]
    write_news(folder, "b1_SR_2023_news.json", [{"title": "loss"}])
    assert run() == [("1.SR", 2023, 1.0, 1), ("2.SR", 2023, 0.0, 0), ("b1.SR", 2023, -1.0, 1)]


def test_article_schema_is_declared():
    assert "articles" in schemas.NEWS_DOCUMENT.fieldNames()


@pytest.mark.parametrize("chars", [N.AUTOMATON_CHARS, 60])
def test_phrases_of_any_length_are_found_whole(spark, monkeypatch, chars):
    """Against a plain search; with a small bound the phrases need several automata."""
    monkeypatch.setattr(N, "AUTOMATON_CHARS", chars)
    chance = random.Random(2)
    texts = [(i, " ".join(chance.choice(["a", "b", "ab", "É", "日本", "c-d"]) for _ in range(chance.choice([0, 3, 200])))) for i in range(60)] + [(60, None), (61, "")]
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    long_one = plain(next(t for _, t in texts if len(t) > 300))[40:260].strip().partition(" ")[2].rpartition(" ")[0]
    phrases = [("x", 3, "a"), ("x", 4, "a B"), ("y", 3, "a b"), ("y", 5, "É 日本"), ("z", 3, long_one), ("z", 4, "!!"), ("z", 5, None), ("w", 3, "ab ab a"), ("w", 3, "ab ab a")]
    found = N.phrase_hits(spark.createDataFrame(texts, "article_id long, text string"), spark.createDataFrame(phrases, "ticker string, tier int, phrase string"))
    expected = {(i, t, tier) for i, text in texts for t, tier, p in phrases if plain(p).strip() and plain(p) in plain(text)}
    assert any(t == "z" for _, t, _ in expected) and rows(found) == sorted(expected)


def _opened(df):
    """How many files the planned scan opens."""
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).selectedPartitions().totalNumberOfFiles()


def test_files_of_other_keys_are_not_opened(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("1_SR_2020_news.json", "1_SR_2021_news.json", "2_SR_2021_NEWS.json", "deep/3_SR_2021_news.json", "nokey_news.json", "other.json"):
        write_news(tmp_path, name, [{"title": name}])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        every = NF.read_news_folder(spark, str(tmp_path))
        assert every.count() == 5 and _opened(every) == 5
        year = NF.read_news_folder(spark, str(tmp_path), years=[2021])
        assert sorted(r["file_name"] for r in year.collect()) == ["1_SR_2021_news.json", "2_SR_2021_NEWS.json", "3_SR_2021_news.json", "nokey_news.json"] and _opened(year) == 4
        both = NF.read_news_folder(spark, str(tmp_path), tickers=["1.SR"], years=[2021])
        assert _opened(both) == 2 and [(r["ticker"], r["fiscal_year"]) for r in NF.accepted(NF.parse_news(both)).collect()] == [("1.SR", 2021)]
        assert NF.folder_index(spark, str(tmp_path)).where("fiscal_year = 2021").count() == 3
        files = spark.createDataFrame([("7_SR_2022_news.json", json.dumps({"ticker": "7.SR", "year": 2022, "articles": []})), ("8_SR_2023_news.json", "{")], "file_name string, value string")
        NF.write_news_folder(files, str(tmp_path / "written"))
        back = NF.read_news_folder(spark, str(tmp_path / "written"), years=[2022])
        assert [(r["ticker"], r["reject_reason"]) for r in NF.parse_news(back).collect()] == [("7.SR", None)] and _opened(back) == 1
        assert NF.rejected(NF.parse_news(NF.read_news_folder(spark, str(tmp_path / "written")))).collect()[0]["file_name"] == "8_SR_2023_news.json"
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
