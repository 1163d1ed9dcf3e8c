import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.functions import cleaning as C
from ratingloom.functions import ratings as RT
from ratingloom.functions import ratios as RA
from ratingloom.functions import text as TX


def values(df, column, *exprs):
    return [tuple(r) if len(r) > 1 else r[0] for r in df.select(*exprs).collect()]


def column(spark, rows, kind="string"):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}").orderBy("i")


def test_years(spark):
    df = column(spark, ["2023.0", " 2021 ", "", "abc", None, "1d", "nan", "2.02e3"])
    assert values(df, "x", C.to_year(F.col("x"))) == [2023, 2021, None, None, None, None, None, 2020]


def test_nan_becomes_null(spark):
    df = column(spark, [1.5, float("nan"), None], "double")
    assert values(df, "x", C.nan_to_null(F.col("x"))) == [1.5, None, None]
    assert values(df, "x", C.to_number(F.col("x"))) == [1.5, None, None]


def test_flags_and_blanks(spark):
    df = column(spark, ["1", "0.0", "x", None, " "])
    assert values(df, "x", C.to_flag(F.col("x"))) == [1, 0, 0, 0, 0]
    df = column(spark, ["\t a\n", "  ", None])
    assert values(df, "x", C.blank_to_null(F.col("x"))) == ["a", None, None]


RATING_CASES = [
    # letter, category, category when trimmed, below grade, below A, investment grade, notch
    ("AAA", "AA", "AA", 0, 0, 1, 21),
    ("A-", "A", "A", 0, 0, 1, 15),
    ("BBB+", "BBB", "BBB", 0, 1, 1, 14),
    ("BBB-", "BBB", "BBB", 0, 1, 1, 12),
    ("BB+", "BB", "BB", 1, 1, 0, 11),
    ("D", "BB", "BB", 1, 1, 0, 0),
    (" A ", "BB", "A", 0, 1, None, None),
    (None, "BB", "BB", 0, 1, None, None),
    ("XYZ", "BB", "BB", 1, 1, None, None),
]


def test_rating_maps(spark):
    df = column(spark, [c[0] for c in RATING_CASES])
    x = F.col("x")
    got = values(
        df, "x", x, RT.rating_category(x), RT.rating_category(x, trim=True), RT.binary_below_investment_grade(x),
        RT.binary_below_a(x), RT.binary_investment_grade(x), RT.rating_notch(x),
    )
    assert got == RATING_CASES


def test_scale_is_a_bijection(spark):
    scale = RT.rating_scale(spark)
    back = scale.select("rating", RT.notch_to_rating(F.col("notch"))).collect()
    assert len(back) == 22 and all(a == b for a, b in back)


def test_harmonise(spark):
    df = column(spark, ["Baa1", "Aaa", "A2", "AAA (sau)", "KsaAAA", "BB-", " A+ "])
    assert values(df, "x", RT.harmonise(F.col("x"))) == ["BBB+", "AAA", "A", None, None, "BB-", "A+"]


def test_ratios_with_zero_and_missing(spark):
    names = ["total_assets", "current_assets", "current_liabilities", "retained_earnings", "total_equity", "total_liabilities", "ebit"]
    rows = [
        (100.0, 50.0, 30.0, 10.0, 40.0, 60.0, 8.0),
        (0.0, 50.0, 30.0, 10.0, 40.0, 0.0, 8.0),
        (None, 50.0, 30.0, 10.0, 40.0, None, 8.0),
        (100.0, None, 30.0, None, None, 60.0, None),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    ratios = RA.core_ratios_by_name()
    assert [tuple(r) for r in df.select(*[ratios[k] for k in V.RATIOS]).collect()] == [
        (0.2, 0.1, 0.08, 40.0 / 60.0),
        (None, None, None, None),
        (None, None, None, None),
        (None, None, None, None),
    ]


def test_first_line_item(spark):
    df = spark.sql("SELECT map('Total Assets', CAST(NULL AS double), 'TotalAssets', 5.0D, 'EBIT', 2.0D) AS m")
    got = df.select(RA.first_line_item(F.col("m"), "total_assets"), RA.first_line_item(F.col("m"), "ebit"), RA.first_line_item(F.col("m"), "total_equity")).first()
    assert tuple(got) == (5.0, 2.0, None)


@pytest.mark.parametrize(
    "title, description, snippet, expected",
    [
        (" T ", " D ", "S", "T D"),
        ("T", None, " S ", "T S"),
        ("T", "", "S", "T S"),
        ("T", "  ", "S", "T"),  # a blank description is not replaced
        (None, None, None, " "),
        ("", "D", None, "D"),
    ],
)
def test_article_text(spark, title, description, snippet, expected):
    df = spark.createDataFrame([(title, description, snippet)], "t string, d string, s string")
    assert df.select(TX.article_text(F.col("t"), F.col("d"), F.col("s"))).first()[0] == expected


def test_search_phrase(spark):
    df = column(spark, ["  Al  Rajhi (Holding)  Co ", "(only)", "x" * 200])
    assert values(df, "x", TX.search_phrase(F.col("x"), 120)) == ["Al Rajhi Co", "(only)", "x" * 120]


def test_file_names(spark):
    df = column(spark, ["4263_SR_2025_news.json", "a_b_SR_2020_NEWS.JSON", "4263_2025_news.json", "notes.json"])
    ticker, year = TX.news_file_key(F.col("x"))
    assert values(df, "x", ticker, year) == [("4263.SR", 2025), ("a_b.SR", 2020), (None, None), (None, None)]


def test_numbers_in_text(spark):
    df = column(spark, ["LIQUID=0.1234, -1.50 and 3.1 or 12.345%"])
    assert values(df, "x", TX.numbers_in(F.col("x"))) == [["0.1234", "-1.50", "12.345"]]


def test_fixed_rounds_like_exact_binary(spark):
    rng = random.Random(3)
    numbers = [0.2345, -0.2345, 0.00015, 2.5, 0.5, 1.5, -0.00001, 0.12345, 1.00005, 0.0, 123456.78905]
    numbers += [round(rng.uniform(-3, 3), 5) for _ in range(500)]
    df = column(spark, numbers, "double")
    assert values(df, "x", TX.fixed(F.col("x"), 4)) == [f"{x:.4f}" for x in numbers]
    assert values(df, "x", TX.fixed(F.col("x"), 3)) == [f"{x:.3f}" for x in numbers]
    shares = [i / 200 for i in range(201)]
    assert values(column(spark, shares, "double"), "x", TX.percent(F.col("x"))) == [f"{x:.0%}" for x in shares]


def test_json_object_is_what_json_writes(spark):
    record = {"a": 'quote " back\\slash', "n": 7, "s": ["one — dash", "two\nlines"], "e": []}
    df = spark.createDataFrame([(record["a"], record["n"], record["s"], record["e"])], "a string, n int, s array<string>, e array<string>")
    text = df.select(TX.json_object([("a", F.col("a"), "string"), ("n", F.col("n"), "number"), ("s", F.col("s"), "strings"), ("e", F.col("e"), "strings")])).first()[0]
    assert text == json.dumps(record, indent=2)


def test_normalised_article(spark):
    rows = spark.sql(
        """SELECT named_struct('title', ' T ', 'description', repeat('d', 5000), 'snippet', CAST(NULL AS string), 'published_at', '2024-01-01',
        'source', ' site ', 'url', CAST(NULL AS string), 'entities', array(named_struct('symbol', ' '), named_struct('symbol', ' X.SR '))) AS i"""
    )
    for cut, length in ((None, 5000), (4000, 4000)):
        a = rows.select(TX.normalise_article(F.col("i"), F.lit("1.SR"), F.lit("fallback"), cut).alias("a")).first()["a"]
        assert (a["ticker"], a["title"], len(a["description"]), a["snippet"], a["url"], a["search_term"], a["sentiment_neu"]) == (
            "1.SR", "T", length, "", "", "X.SR", 1.0,
        )


def test_lexicon_score(spark):
    df = column(spark, ["Record profit, strong GROWTH", "loss after downgrade", "gain and loss", "nothing", ""])
    got = values(df, "x", TX.lexicon_score(F.col("x")))
    assert got == [1.0, -1.0, 0.0, 0.0, 0.0]
    assert not any(math.isnan(x) for x in got)
