import datetime as dt

import pytest
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom import schemas
from ratingloom.operators import agencies as A
from ratingloom.operators import entities as E
from ratingloom.operators import panel as P
from ratingloom.operators.picking import pick_first, rank_by_buckets
from ratingloom.operators.profiles import exact_quantiles
from ratingloom.sources import statements as SS
from ratingloom.sources import tables as ST


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_keys_are_trimmed_and_typed(spark):
    df = spark.createDataFrame([(" 1.SR ", "2023.0"), ("2.SR", ""), ("3.SR", "abc"), (None, "2020")], "ticker string, fiscal_year string")
    assert rows(P.clean_keys(df)) == [("1.SR", 2023)]


def test_preferred_agency_in_any_case(spark):
    data = [("1.SR", 2023, "Fitch", "A"), ("1.SR", 2023, "  TASSNIEF ", "BBB"), ("2.SR", 2023, "SP", "B"), ("2.SR", 2023, "Fitch", "A")]
    df = spark.createDataFrame(data, "ticker string, fiscal_year int, rating_agency string, rating string")
    got = P.dedupe_by_agency(df, [F.col("rating_agency"), F.col("rating")])
    assert rows(got.select("ticker", "rating")) == [("1.SR", "BBB"), ("2.SR", "A")]


def test_pick_does_not_depend_on_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), (F.col("id") % 3).alias("o"), F.md5(F.col("id").cast("string")).alias("v"))
    picks = [rows(pick_first(df.repartition(n), ["k"], [F.col("o")])) for n in (1, 4, 50)]
    assert picks[0] == picks[1] == picks[2]


def test_ranks_of_a_group_with_most_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise("other").alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    got = rank_by_buckets(df, [F.substring("h", 1, 2)], [F.col("h")], ["g"]).collect()
    for group in ("hot", "other"):
        mine = sorted((r["h"], r["rank"]) for r in got if r["g"] == group)
        assert [r for _, r in mine] == list(range(len(mine)))


PANEL = [("1.SR", 2022, "One", "A"), ("1.SR", 2023, "One", None), ("2.SR", 2023, "Two", "BB")]
PANEL_SCHEMA = "ticker string, fiscal_year int, company_name string, rating string"


def test_align_financials(spark):
    panel = spark.createDataFrame(PANEL, PANEL_SCHEMA)
    fin = spark.createDataFrame(
        [("1.SR", 2022, "Other name", "Fitch", "BBB+", 0.1, 1), ("1.SR", 2022, "Other name", "Tassnief", None, 0.2, None), ("9.SR", 2022, "No", "SP", "A", 0.3, 0)],
        "ticker string, fiscal_year int, company_name string, rating_agency string, rating string, liquid double, binary_target int",
    )
    got = P.align_financials(panel, fin)
    assert got.columns == V.ALIGNED_FINANCIALS
    # one row per panel row; own name, rating filled from the panel, target computed where missing
    assert rows(got.select("ticker", "fiscal_year", "company_name", "rating_agency", "rating", "liquid", "binary_target")) == [
        ("1.SR", 2022, "One", "Tassnief", "A", 0.2, 0),
        ("1.SR", 2023, "One", "", None, None, 0),
        ("2.SR", 2023, "Two", "", "BB", None, 1),
    ]


def test_supplement(spark):
    base = spark.createDataFrame([("1.SR", 2023, 0.5, 7.0), ("2.SR", 2023, 0.6, 8.0)], "ticker string, fiscal_year int, liquid double, total_assets double")
    data = [
        (1, " 1.SR", "2023", 100.0, 50.0, 30.0, None, " "),
        (2, "1.SR", "2023.0", 200.0, None, None, 20.0, "2023-12-31"),  # later row wins where it has a value
        (3, "7.SR", "2023", 1.0, 1.0, 1.0, None, None),
    ]
    sup = spark.createDataFrame(
        data, "n int, ticker string, fiscal_year string, total_assets double, current_assets double, current_liabilities double, operating_profit double, statement_period_end string"
    )
    got = P.merge_supplement(base, sup, "n")
    assert rows(got.select("ticker", "liquid", "total_assets", "profitab", "statement_period_end")) == [
        ("1.SR", 0.2, 200.0, 0.1, "2023-12-31"),
        ("2.SR", 0.6, 8.0, None, None),
    ]
    assert rows(P.unmatched_supplement(base, sup).select("ticker")) == [("7.SR",)]


def test_upsert(spark):
    base = spark.createDataFrame([("1.SR", 2023, "One", 0.1), ("2.SR", 2023, "Two", 0.2)], "ticker string, fiscal_year int, company_name string, liquid double")
    fresh = spark.createDataFrame([("1.SR", 2023, "New", 0.9), ("3.SR", 2023, "Three", 0.3)], "ticker string, fiscal_year int, company_name string, liquid double")
    assert rows(P.upsert_refreshed(base, fresh).select("ticker", "company_name", "liquid")) == [
        ("1.SR", "One", 0.9), ("2.SR", "Two", None), ("3.SR", "Three", 0.3),
    ]


def test_period_pick(spark):
    d = dt.date
    df = spark.createDataFrame([("a", d(2023, 6, 30), 1), ("a", d(2023, 12, 31), 2), ("b", d(2023, 3, 31), 3), ("b", d(2023, 6, 30), 4), ("a", d(2022, 6, 30), 5)], "ticker string, period_end date, v int")
    assert rows(P.pick_period(df, ["ticker"]).select("ticker", "fiscal_year", "v")) == [("a", 2022, 5), ("a", 2023, 2), ("b", 2023, 4)]


def test_growth_needs_the_year_before(spark):
    df = spark.createDataFrame([("a", 2020, 10.0), ("a", 2021, 15.0), ("a", 2023, 30.0), ("b", 2021, 0.0), ("b", 2022, 5.0)], "ticker string, fiscal_year int, r double")
    assert rows(P.growth(df, "r", "g").select("ticker", "fiscal_year", "g")) == [
        ("a", 2020, None), ("a", 2021, 0.5), ("a", 2023, None), ("b", 2021, None), ("b", 2022, None),
    ]


def test_financial_entities(spark):
    data = [
        ("8050.SR", "", "", "Plain"), ("1.SR", " Financial Services ", "", "Plain"), ("2.SR", "", "Reinsurance - Specialty", "Plain"),
        ("3.SR", "", "", "First National Bank of X"), ("4.SR", "", "", "Big Bank"), ("5.SR", "", "", "Bankside Foods"), ("6.SR", None, None, None),
    ]
    df = spark.createDataFrame(data, "t string, s string, i string, n string")
    got = df.select(E.is_financial(F.col("t"), F.col("s"), F.col("i"), F.col("n"))).collect()
    assert [r[0] for r in got] == [True, True, True, True, True, False, False]


def test_entity_names_stop_at_the_sector_row(spark):
    data = [
        ("1.SR", 2023, 1, None, "Energy", "Oil"), ("1.SR", 2022, 2, "Old Islamic Bank", "Energy", "Oil"),  # name below the sector row: not seen
        ("2.SR", 2023, 3, "A Islamic Bank", " ", None), ("2.SR", 2022, 4, "Other", "Energy", None),
        ("3.SR", 2023, 5, "Fine", "", "Insurance - Life"), ("3.SR", 2022, 6, "Fine", "Energy", None),  # industry of the sector's row
    ]
    ratings = spark.createDataFrame(data, "ticker string, fiscal_year int, n int, company_name string, sector string, industry string")
    panel = spark.createDataFrame([("1.SR", 2023, "Old Islamic Bank"), ("9.SR", 2023, "Z Insurance")], "ticker string, fiscal_year int, company_name string")
    assert rows(E.financial_tickers(ratings, panel, "n")) == [("2.SR",), ("9.SR",)]
    kept = E.drop_tickers(spark.createDataFrame([(" 9.SR",), ("1.SR",)], "ticker string"), E.financial_tickers(ratings, panel, "n"))
    assert rows(kept) == [("1.SR",)]


def test_agencies(spark):
    wide = spark.createDataFrame([("1.SR", "Baa1", "BBB", None, "A-", "AAA (sau)")], ", ".join(["ticker string", *[f"{a} string" for a in V.AGENCY_COLUMNS]]))
    long = A.unpivot_agencies(wide, ["ticker"])
    assert rows(long.select("agency", "notch")) == [("fitch", 13), ("moodys", 14), ("tassnief", 15)]
    assert rows(A.consensus(long).select("median_notch", "consensus")) == [(14.0, "BBB+")]
    assert rows(A.disagreement(long)) == [("1.SR", 2, "A-", "BBB", 3)]


def test_quantiles_by_brackets(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    data = np.concatenate([rng.normal(size=20000), np.full(10000, 0.25), rng.exponential(50, 500)])
    df = spark.createDataFrame([(float(x),) for x in data], "value double").withColumn("k", F.lit("a")).repartition(8)
    got = {r["p"]: r["quantile"] for r in exact_quantiles(df, ["k"], [0.25, 0.5, 0.75], accuracy=500).collect()}
    for p, q in got.items():
        assert abs(q - np.quantile(data, p)) < 1e-12
    assert len(got) == 3


def test_csv_with_missing_and_bad_cells(spark, tmp_path):
    (tmp_path / "f.csv").write_text("fiscal_year,ticker,liquid,leverage,binary_target\n2023.0,1.SR,NaN,0.5,1\n,2.SR,abc,,x\n")
    got = ST.read_csv(spark, str(tmp_path / "f.csv"), schemas.FINANCIALS)
    assert rows(got.select("ticker", "fiscal_year", "liquid", "leverage", "binary_target", "company_name")) == [
        ("1.SR", "2023.0", None, 0.5, 1, None), ("2.SR", None, None, None, None, None),
    ]
    assert rows(P.clean_keys(got).select("ticker", "fiscal_year")) == [("1.SR", 2023)]


def test_csv_files_with_another_header_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ticker,liquid,cumprof\n1.SR,1,2\n")
    (tmp_path / "b.csv").write_text("ticker,cumprof,liquid\n2.SR,3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        ST.read_csv(spark, str(tmp_path), schemas.FINANCIALS).collect()


def test_statement_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{\n "ticker": "1.SR", "balance_sheet": {"2023-06-30": {"Total Assets": 1.0}, "2023-12-31": {"Total Assets": NaN, "TotalAssets": 10.0,'
        ' "Current Assets": 4.0, "Current Liabilities": 2.0}}, "income_statement": {"2023-12-31": {"EBIT": 1.0}}, "cashflow": null}'
    )
    (tmp_path / "b.json").write_text('{"ticker": "2.SR", "balance_sheet": null, "income_statement": null, "cashflow": null}')
    documents = SS.read_statements(spark, str(tmp_path))
    assert documents.count() == 2
    got = SS.statement_ratios(documents).select("ticker", "fiscal_year", "statement_period_end", "total_assets", "liquid", "profitab", "leverage")
    assert rows(got) == [("1.SR", 2023, "2023-12-31", 10.0, 0.2, 0.1, None)]
    assert SS.statement_lines(documents).count() == 6


def test_retention(spark):
    df = spark.createDataFrame([("2019",), ("2020.0",), ("2021",), ("",), ("n/a",)], "fiscal_year string")
    assert rows(ST.retain_years(df)) == [("",), ("2021",), ("n/a",)]
    plain = spark.createDataFrame([(2019,)], "year int")
    assert ST.retain_years(plain).count() == 1


def test_training_frame_fills_last(spark):
    fin = spark.createDataFrame([("1.SR", 2023, "A", 0.1, 0.1, 0.1, 1.0), ("2.SR", 2023, "B", None, 0.1, 0.1, 1.0)], "ticker string, fiscal_year int, rating string, liquid double, cumprof double, profitab double, leverage double")
    news = spark.createDataFrame([("1.SR", 2023, None, None, None, None, 0, 0), ("2.SR", 2023, 0.1, 0.0, 1.0, 0.0, 1, 1)], "ticker string, fiscal_year int, sentiment_mean double, sentiment_std double, sentiment_pos_pct double, sentiment_neg_pct double, news_count int, has_news_coverage int")
    panel = spark.createDataFrame([("1.SR", 2023, "BBB", 1), ("2.SR", 2023, "A", 0)], "ticker string, fiscal_year int, rating string, REVKAM int")
    got = P.training_frame(fin, news, panel)
    row = got.collect()
    assert len(row) == 1 and row[0]["sentiment_mean"] == 0.0 and row[0]["has_news_coverage"] == 0
    assert row[0]["REVKAM"] == 1 and row[0]["GCKAM"] == 0 and row[0]["rating_category"] == "A"
    assert P.training_frame(fin, news, panel, "panel").first()["rating_category"] == "BBB"
