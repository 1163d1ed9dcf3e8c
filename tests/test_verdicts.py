import json

import pytest
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.operators import verdicts as VD
from ratingloom.sources import tables as ST

ROW = "ticker string, fiscal_year int, company_name string, rating_agency string, rating string, rating_category string, liquid double, cumprof double, profitab double, leverage double, sentiment_mean double, news_count int, REVKAM int, ASSETKAM int, predicted_category string, confidence double"


def frame(spark, **changes):
    base = dict(
        ticker="1.SR", fiscal_year=2023, company_name="One", rating_agency="Fitch", rating="A", rating_category="A", liquid=0.2, cumprof=0.3,
        profitab=0.1, leverage=2.0, sentiment_mean=0.1, news_count=3, REVKAM=0, ASSETKAM=0, predicted_category="A", confidence=0.125,
    )
    names = [c.split()[0] for c in ROW.split(", ")]
    return spark.createDataFrame([tuple({**base, **changes}[n] for n in names)], ROW)


def verdict(spark, **changes):
    return VD.template_verdict(frame(spark, **changes)).first()["verdict"]


LIMITS = [
    ("liquid", 0.15, "Adequate liquidity (LIQUID=0.1500)"), ("liquid", 0.05, "Low liquidity (LIQUID=0.0500)"), ("liquid", -0.05, "Negative liquidity (LIQUID=-0.0500)"),
    ("cumprof", 0.20, "Positive cumulative profitability (CUMPROF=0.2000)"), ("cumprof", 0.05, "Modest cumulative"), ("cumprof", 0.0, "Negative cumulative"),
    ("profitab", 0.03, "Low operational profitability (PROFITAB=0.0300)"), ("profitab", 0.0, "Negative profitability"),
    ("leverage", 0.8, "Elevated debt reliance (LEVERAGE=0.8000)"), ("leverage", 0.3, "High leverage risk"),
]


@pytest.mark.parametrize("ratio, value, text", LIMITS)
def test_a_value_on_a_limit_takes_the_lower_step(spark, ratio, value, text):
    v = verdict(spark, **{ratio: value})
    assert any(x.startswith(text) for x in v["strengths"] + v["weaknesses"])


def test_neutral_steps_say_nothing(spark):
    v = verdict(spark, profitab=0.08, leverage=1.5)
    assert not any("PROFITAB" in x or "LEVERAGE" in x for x in v["strengths"] + v["weaknesses"])
    assert v["weaknesses"] == [V.NO_WEAKNESS_TEXT]


def test_fillers_come_before_news_and_flags(spark):
    v = verdict(spark, liquid=-0.2, cumprof=-0.1, profitab=0.05, leverage=1.0, ASSETKAM=1, REVKAM=1, sentiment_mean=-0.3)
    assert v["strengths"] == [V.NO_STRENGTH_TEXT, V.ASSET_FLAG_TEXT]
    assert v["weaknesses"][-1] == "Negative FinBERT news tone (sentiment_mean=-0.300 across 3 articles)"
    assert v["key_risks"][-1] == V.REVENUE_FLAG_TEXT
    assert verdict(spark, news_count=0)["key_risks"] == [V.NO_RISK_TEXT, V.NO_NEWS_TEXT]


def test_overall_and_analysis(spark):
    v = verdict(spark)
    assert v["overall_assessment"] == (
        "One (1.SR) shows a solid financial profile for FY2023, with the ML model predicting a A "
        "(Investment-grade (AA / A / BBB buckets)) rating at 12% confidence."
    )
    assert v["prediction_analysis"].startswith("Ratios align with an investment-grade-style bucket (A): LIQUID=0.2000")
    other = verdict(spark, predicted_category="BB")
    assert other["risk_classification"] == V.RISK_CLASS_SPECULATIVE
    assert other["prediction_analysis"].startswith("Mixed signals: model predicts BB with avg ratio score 0.2000")
    assert other["prediction_analysis"].endswith(" Note: actual agency rating is A (category A) vs predicted category BB.")
    assert "Note" not in verdict(spark, predicted_category="BB", rating=None)["prediction_analysis"]
    assert verdict(spark, liquid=0.04, cumprof=0.05, profitab=0.05)["prediction_analysis"].startswith("The model predicts A but average")


def test_score_against_the_row(spark):
    scored = VD.score_verdict(VD.template_verdict(frame(spark))).first()
    assert scored["overall_score"] == 1.0 and scored["ratios_cited"] == 4 and scored["citation_rate"] == 1.0
    wrong = frame(spark, liquid=9.9999).select("*").join(VD.template_verdict(frame(spark)).select("verdict"))
    assert VD.score_verdict(wrong).first()["numbers_accuracy"] < 1.0


def test_replies(spark):
    good = json.dumps({"company": "One", "strengths": ["a", "b"], "overall_assessment": "x" * 30, "prediction_analysis": "LIQUID=0.10 CUMPROF=0.20 " + "y" * 20, "weaknesses": ["w"]}, indent=2)
    bad = [good[:-8], "", "no braces", "[1, 2]", None, "{'company': 'X'}", good + "\n" + good, good + " thanks }", '{"company": "a\tb"}', good + "}", '{"a": 1} {"b": 2}']
    replies = [good, f"```json\n{good}\n```", f"Here:\n{good}\nDone.", '{"company": "it\'s {braces} \\"here\\""}', *bad]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    parsed = df.select("i", VD.reply_json(F.col("reply")).alias("reply_json"), VD.parse_reply(F.col("reply")).alias("verdict"))
    got = [r["verdict"] for r in parsed.orderBy("i").collect()]
    assert [g is not None for g in got] == [True] * 4 + [False] * len(bad)
    assert got[2]["company"] == "One" and got[2]["strengths"] == ["a", "b"] and got[3]["company"] == "it's {braces} \"here\""
    scores = [r["overall_score"] for r in VD.score_reply(parsed).orderBy("i").collect()]
    assert scores[0] == 1.0 and scores[4] == 0.0


def test_reply_with_other_fields(spark):
    text = json.dumps({"company": "One", "strengths": "solid", "weaknesses": [], "recommendation": "LIQUID 0.1234 CUMPROF 0.2345"})
    row = VD.score_reply(spark.createDataFrame([(text,)], "reply_json string")).first()
    assert (row["ratios_cited"], row["numbers_found"], row["has_strengths"], row["has_weaknesses"]) == (2, 2, True, False)


def test_choice_of_method(spark):
    df = spark.sql("SELECT 1 AS i, 'model' AS a, CAST(NULL AS string) AS b, 'template' AS t UNION ALL SELECT 2, NULL, 'service', 'template' UNION ALL SELECT 3, NULL, NULL, 'template'")
    chosen, method = VD.choose_verdict([("m", F.col("a")), ("s", F.col("b")), ("t", F.col("t"))], "t_fallback")
    assert [tuple(r) for r in df.orderBy("i").select(chosen, method).collect()] == [("model", "m"), ("service", "s"), ("template", "t_fallback")]


def test_output_is_the_verdict_as_json(spark, tmp_path):
    made = VD.template_verdict(frame(spark, news_count=0)).withColumns({"predicted_rating": F.col("predicted_category"), "sector": F.lit("Energy")})
    records = VD.instruction_set(made)
    record, v = records.first(), made.first()["verdict"]
    assert record["output"] == json.dumps({f: v[f] for f in V.VERDICT_FIELDS}, indent=2)
    assert record["input"].split("\n")[2] == "ML Predicted: A (Investment Grade) | Confidence: 12%"
    ST.write_jsonl(records, str(tmp_path / "sft"))
    back = ST.read_jsonl(spark, str(tmp_path / "sft")).first()
    assert back["output"] == record["output"] and back["verdict"] == v
    line = [x for f in (tmp_path / "sft").glob("*.txt") for x in f.read_text().splitlines()][0]
    assert line == json.dumps({k: record[k] for k in ("instruction", "input", "output")})


def test_prompt_leaves_missing_lines_out(spark):
    rows = frame(spark, liquid=None).withColumns({c: F.lit(0) for c in ("GCKAM", "LIABKAM", "OTHERKAM")}).withColumns({c: F.lit(None).cast("double") for c in ("sentiment_std", "sentiment_pos_pct", "sentiment_neg_pct")})
    text = rows.select(VD.service_prompt(rows)).first()[0]
    assert "Liquidity (Working" not in text and "Dispersion" not in text
    assert "  - Leverage (Book Equity / Total Liabilities): 2.0000\n" in text
    assert "  Model confidence: 12.5%\n  Actual Rating (Fitch): A\n" in text
    assert text.endswith(V.PROMPT_TAIL)


def test_diversity(spark):
    df = spark.createDataFrame([("A b c d",), ("a B c",), ("x y",), (None,)], "t string")
    assert tuple(VD.trigram_diversity(df, F.col("t")).first()) == (2, 3, 2 / 3)


def test_patches_are_keyed(spark):
    records = spark.createDataFrame([("1.SR", 2023, "old"), ("2.SR", 2023, "old")], "ticker string, fiscal_year int, output string")
    patches = spark.createDataFrame([("2.SR", 2023, "new"), ("9.SR", 2023, "lost")], "ticker string, fiscal_year int, output string")
    assert sorted((r["ticker"], r["output"]) for r in VD.patch_outputs(records, patches).collect()) == [("1.SR", "old"), ("2.SR", "new")]
