"""Queries that write, prompt, parse and score verdicts and build instruction sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.functions.ratings import rating_category, risk_grade
from ratingloom.operators import verdicts as VD
from ratingloom.operators.panel import KEYS, drop_null_ratios
from ratingloom.plans import roles as R
from ratingloom.plans.common import i8, longs, r6, rounded
from ratingloom.plans.panel_queries import panel_frame
from ratingloom.plans.registry import query
from ratingloom.plans.roles import ROLE_SQL, category_sql, with_roles
from ratingloom.session import cut_lineage, scratch_path
from ratingloom.sources import tables as ST


def predicted_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel rows with all ratios, and as prediction the category of the key's last rating.

    Confidence stands for a model's: the share of final orders, one added on both sides.
    """
    rows = R.rating_rows(spark, sf_dir)
    guess = rows.groupBy(*KEYS).agg(
        F.max(F.struct("rating_id", "rating"))["rating"].alias("predicted_letter"),
        ((F.count_if(F.col("status") == "F") + 1) / (F.count(F.lit(1)) + 1)).alias("confidence"),
    )
    names = R.issuers(spark, sf_dir).select("ticker", "company_name", F.col("sector"))
    panel = drop_null_ratios(panel_frame(spark, sf_dir)).withColumn("rating_agency", F.trim("rating_agency"))
    out = panel.join(guess, KEYS).join(names, "ticker")
    return out.withColumn("predicted_category", rating_category(F.col("predicted_letter")))


ROLE_SQL["predicted"] = (
    ["picked", "flags", "news", "issuers", "rating_rows"],
    f"""SELECT p.ticker, p.fiscal_year, i.company_name, i.sector, trim(p.rating_agency) AS rating_agency, p.rating, {category_sql("p.rating")} AS rating_category,
  p.liquid, p.cumprof, p.profitab, p.leverage, n.sentiment_mean, n.sentiment_std, n.sentiment_pos_pct, n.sentiment_neg_pct,
  coalesce(n.news_count, 0) AS news_count, f.AUSIZE, f.GCKAM, f.REVKAM, f.ASSETKAM, f.LIABKAM, f.OTHERKAM,
  g.predicted_letter, {category_sql("g.predicted_letter")} AS predicted_category, g.confidence
FROM picked p JOIN flags f ON p.ticker = f.ticker AND p.fiscal_year = f.fiscal_year
JOIN (SELECT DISTINCT ticker, fiscal_year, last_value(rating) OVER (PARTITION BY ticker, fiscal_year ORDER BY rating_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS predicted_letter,
    (count(*) FILTER (status = 'F') OVER (PARTITION BY ticker, fiscal_year) + 1) / (count(*) OVER (PARTITION BY ticker, fiscal_year) + 1)::DOUBLE AS confidence FROM rating_rows) g
  ON p.ticker = g.ticker AND p.fiscal_year = g.fiscal_year
JOIN issuers i ON i.ticker = p.ticker LEFT JOIN news n ON p.ticker = n.ticker AND p.fiscal_year = n.fiscal_year
WHERE p.liquid IS NOT NULL AND p.cumprof IS NOT NULL AND p.profitab IS NOT NULL AND p.leverage IS NOT NULL""",
)


# --- the verdict in SQL ---------------------------------------------------------------------


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fill_sql(template: str, **values: str) -> str:
    out, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [_quote(head), f"({values[name]})"]
    return " || ".join([*out, _quote(rest)])


def _f4(x: str, digits: int = 4) -> str:
    return f"printf('%.{digits}f', {x})"


def _ladder_sql(ratio: str, side: str) -> str:
    parts = []
    for limit, step, text in V.VERDICT_LADDERS[ratio]:
        value = _fill_sql(text, v=_f4(ratio)) if step == side else "NULL"
        parts.append(f"ELSE {value} END" if limit is None else f"WHEN {ratio} > {limit} THEN {value}")
    return "CASE " + " ".join(parts)


def _list_sql(items: list[str], filler: str, more: list[str]) -> str:
    kept = lambda xs: f"list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL)"
    base = kept(items)
    return f"list_concat(CASE WHEN len({base}) = 0 THEN [{_quote(filler)}] ELSE {base} END, {kept(more)})"


_AVG = "((liquid + cumprof + profitab) / 3)"
_RISK = f"CASE WHEN predicted_category = 'BB' THEN '{V.RISK_CLASS_SPECULATIVE}' ELSE '{V.RISK_CLASS_INVESTMENT}' END"
_PLACES = {r: _f4(r) for r in V.RATIOS} | {"p": "predicted_category", "avg": _f4(_AVG)}
_ANALYSIS = (
    f"CASE WHEN predicted_category <> 'BB' AND {_AVG} > 0.05 THEN {_fill_sql(V.ANALYSIS_ALIGNED, **_PLACES)} "
    f"WHEN predicted_category <> 'BB' THEN {_fill_sql(V.ANALYSIS_MODEST, **_PLACES)} "
    f"WHEN {_AVG} < 0.05 THEN {_fill_sql(V.ANALYSIS_WEAK, **_PLACES)} ELSE {_fill_sql(V.ANALYSIS_MIXED, **_PLACES)} END "
    f"|| CASE WHEN rating IS NOT NULL AND predicted_category <> rating_category THEN {_fill_sql(V.ANALYSIS_NOTE, actual='rating', category='rating_category', p='predicted_category')} ELSE '' END"
)
_OVERALL = _fill_sql(
    V.OVERALL_TEXT, name="company_name", ticker="ticker", year="CAST(fiscal_year AS VARCHAR)", p="predicted_category", risk=_RISK,
    profile=f"CASE WHEN {_AVG} > 0.08 THEN 'solid' WHEN {_AVG} > 0.03 THEN 'moderate' ELSE 'weak' END",
    confidence="printf('%.0f', confidence * 100) || '%'",
)
_STRENGTHS = _list_sql(
    [_ladder_sql(r, "strength") for r in V.RATIOS], V.NO_STRENGTH_TEXT, [f"CASE WHEN ASSETKAM = 1 THEN {_quote(V.ASSET_FLAG_TEXT)} END"]
)
_WEAKNESSES = _list_sql(
    [_ladder_sql(r, "weakness") for r in V.RATIOS], V.NO_WEAKNESS_TEXT,
    [f"CASE WHEN news_count <> 0 AND sentiment_mean < -0.2 THEN {_fill_sql(V.NEGATIVE_NEWS_TEXT, v=_f4('sentiment_mean', 3), n='CAST(news_count AS VARCHAR)')} END"],
)
_RISKS = _list_sql(
    [f"CASE WHEN {r} < {limit} THEN {_quote(text)} END" for r, limit, text in V.RISK_RULES], V.NO_RISK_TEXT,
    [f"CASE WHEN news_count = 0 THEN {_quote(V.NO_NEWS_TEXT)} END", f"CASE WHEN REVKAM = 1 THEN {_quote(V.REVENUE_FLAG_TEXT)} END"],
)
_VERDICT = f"""v AS (SELECT *, {_RISK} AS risk_classification, {_OVERALL} AS overall_assessment, {_STRENGTHS} AS strengths,
  {_WEAKNESSES} AS weaknesses, {_RISKS} AS key_risks, {_ANALYSIS} AS prediction_analysis FROM predicted)"""


@query(
    "verdict_template",
    with_roles(
        ["predicted"],
        f"""WITH {_VERDICT} SELECT ticker, fiscal_year, company_name AS company, predicted_category AS predicted_rating, risk_classification, overall_assessment,
  array_to_string(strengths, ' | ') AS strengths, array_to_string(weaknesses, ' | ') AS weaknesses, array_to_string(key_risks, ' | ') AS key_risks, prediction_analysis FROM v""",
    ),
)
def verdict_template(spark, sf):
    out = VD.template_verdict(predicted_panel(spark, sf)).select("verdict.*")
    return out.withColumns({c: F.array_join(c, " | ") for c in ("strengths", "weaknesses", "key_risks")})


_SCORED = f"""{_VERDICT},
t AS (SELECT *, lower(concat_ws(' ; ', 'risk_classification', company_name, ticker, risk_classification, overall_assessment, array_to_string(strengths, ' ; '),
    array_to_string(weaknesses, ' ; '), array_to_string(key_risks, ' ; '), prediction_analysis)) AS text FROM v),
n AS (SELECT *, regexp_extract_all(text, '-?\\d+\\.\\d{{2,}}') AS nums, [{", ".join(_f4(r) for r in V.RATIOS)}] AS written,
  CAST({" + ".join(f"CAST(contains(text, '{r}') AS INTEGER)" for r in V.RATIOS)} AS BIGINT) AS ratios_cited FROM t),
a AS (SELECT *, ratios_cited / 4.0::DOUBLE AS citation_rate,
  len(list_filter(nums, lambda x: len(list_filter(written, lambda w: contains(w, x))) > 0)) / greatest(len(nums), 1)::DOUBLE AS numbers_accuracy,
  {" OR ".join(f"contains(text, '{w}')" for w in V.RISK_WORDS)} AS mentions_risk, {" OR ".join(f"contains(text, '{w}')" for w in V.STRENGTH_WORDS)} AS mentions_strength FROM n),
s AS (SELECT *, (CAST(length(overall_assessment) > 20 AS INTEGER) + 1 + 1 + CAST(length(prediction_analysis) > 20 AS INTEGER) + CAST(citation_rate >= 0.5 AS INTEGER)
  + CAST(numbers_accuracy >= 0.5 AS INTEGER) + CAST(mentions_risk AS INTEGER) + CAST(mentions_strength AS INTEGER)) / 8.0::DOUBLE AS overall_score FROM a)"""


@query(
    "verdict_score",
    with_roles(
        ["predicted"],
        f"""WITH {_SCORED} SELECT ticker, fiscal_year, ratios_cited, {r6("citation_rate", "citation_rate")}, {r6("numbers_accuracy", "numbers_accuracy")},
  {i8("mentions_risk", "mentions_risk")}, {i8("mentions_strength", "mentions_strength")}, {r6("overall_score", "overall_score")} FROM s""",
    ),
)
def verdict_score(spark, sf):
    out = VD.score_verdict(VD.template_verdict(predicted_panel(spark, sf)))
    out = out.select(*KEYS, "ratios_cited", "citation_rate", "numbers_accuracy", "mentions_risk", "mentions_strength", "overall_score")
    return longs(rounded(out, ["citation_rate", "numbers_accuracy", "overall_score"]), ["ratios_cited", "mentions_risk", "mentions_strength"])


@query(
    "verdict_summary",
    with_roles(
        ["predicted"],
        f"""WITH {_SCORED} SELECT count(*) AS total_verdicts, {r6("avg(overall_score)", "avg_overall_score")}, {r6("avg(citation_rate)", "avg_citation_rate")},
  {r6("avg(numbers_accuracy)", "avg_number_accuracy")}, {r6("min(overall_score)", "min_score")}, {r6("max(overall_score)", "max_score")},
  {i8("sum(CAST(predicted_category = rating_category AS INTEGER))", "category_correct")}, {r6("avg(CAST(predicted_category = rating_category AS INTEGER))", "category_accuracy")} FROM s""",
    ),
)
def verdict_summary(spark, sf):
    out = VD.verdict_summary(VD.score_verdict(VD.template_verdict(predicted_panel(spark, sf))))
    return rounded(out, ["avg_overall_score", "avg_citation_rate", "avg_number_accuracy", "min_score", "max_score", "category_accuracy"])


# --- replies --------------------------------------------------------------------------------


def _replies(spark, sf) -> DataFrame:
    """Replies as a model would give them: plain, fenced, inside prose, cut off, none, not quite JSON, or with more or other fields."""
    made = VD.template_verdict(predicted_panel(spark, sf))
    text, agency, year = VD.verdict_json(F.col("verdict")), F.col("rating_agency"), F.col("fiscal_year")
    as_string = F.regexp_replace(text, r'"strengths":\s*\[[^\]]*\]', '"strengths": "none"')
    more = F.concat(F.regexp_replace(text, r"\}\s*$", ""), F.lit(', "recommendation": "LIQUID 0.1234 CUMPROF 0.2345"}'))
    reply = (
        F.when((agency == "Fitch") & (year % 2 == 0), F.concat(F.lit("```json\n"), as_string, F.lit("\n```")))
        .when(agency == "Fitch", F.concat(F.lit("```json\n"), text, F.lit("\n```")))
        .when(agency == "Moodys", F.concat(F.lit("Here is the verdict:\n"), text, F.lit("\nDone.")))
        .when(agency == "SP", text.substr(F.lit(1), F.length(text) - 10))
        .when(agency == "Financial Analytics", F.lit(None).cast("string"))
        .when(year % 5 == 0, F.replace(text, F.lit('"'), F.lit("'")))
        .when(year % 5 == 1, F.concat(text, F.lit("\n"), text))
        .when(year % 5 == 2, F.concat(text, F.lit(" thanks }")))
        .when(year % 5 == 3, more)
        .otherwise(F.concat(F.lit('{"note": "a\tb", '), F.regexp_replace(text, r"^\s*\{", "")))
    )
    return made.withColumn("reply", reply)


_MORE = "rating_agency NOT IN ('Fitch', 'Moodys', 'SP', 'Financial Analytics') AND fiscal_year % 5 = 3"
_AS_STRING = "rating_agency = 'Fitch' AND fiscal_year % 2 = 0"
_VALID = f"(rating_agency IN ('Fitch', 'Moodys') OR {_MORE})"


@query(
    "reply_parse",
    with_roles(
        ["predicted"],
        f"""WITH {_VERDICT} SELECT ticker, fiscal_year, {i8(_VALID, "valid")}, CASE WHEN {_VALID} THEN company_name END AS company,
  CASE WHEN {_VALID} THEN overall_assessment END AS overall_assessment, CASE WHEN {_VALID} THEN array_to_string(key_risks, ' | ') END AS key_risks FROM v""",
    ),
)
def reply_parse(spark, sf):
    parsed = VD.parse_reply(F.col("reply"))
    rows = _replies(spark, sf).select(*KEYS, parsed.alias("v"))
    return rows.select(
        *KEYS, F.col("v").isNotNull().cast("long").alias("valid"), F.col("v.company").alias("company"),
        F.col("v.overall_assessment").alias("overall_assessment"), F.array_join("v.key_risks", " | ").alias("key_risks"),
    )


_REPLY_SCORE = f"""{_SCORED},
e AS (SELECT *, lower(concat_ws(' ; ', company_name, ticker, risk_classification, overall_assessment, CASE WHEN {_AS_STRING} THEN 'none' ELSE array_to_string(strengths, ' ; ') END,
    array_to_string(weaknesses, ' ; '), array_to_string(key_risks, ' ; '), prediction_analysis, CASE WHEN {_MORE} THEN 'liquid 0.1234 cumprof 0.2345' END)) AS reply_text FROM a),
q AS (SELECT *, CASE WHEN {_VALID} THEN len(regexp_extract_all(reply_text, '-?\\d+\\.\\d{{2,}}')) ELSE 0 END AS numbers_found,
  CASE WHEN {_VALID} THEN CAST({" + ".join(f"CAST(contains(reply_text, '{r}') AS INTEGER)" for r in V.RATIOS)} AS BIGINT) ELSE 0 END AS reply_cited FROM e),
z AS (SELECT *, CASE WHEN {_VALID} THEN (5 + CAST(reply_cited >= 2 AS INTEGER) + CAST(numbers_found >= 2 AS INTEGER)) / 7.0::DOUBLE ELSE 0 END AS reply_score FROM q)"""


@query(
    "reply_score",
    with_roles(
        ["predicted"],
        f"""WITH {_REPLY_SCORE} SELECT ticker, fiscal_year, {i8(_VALID, "json_valid")}, {i8("reply_cited", "ratios_cited")}, {i8("numbers_found", "numbers_found")}, {r6("reply_score", "overall_score")} FROM z""",
    ),
)
def reply_score(spark, sf):
    scored = VD.score_reply(_replies(spark, sf).withColumn("reply_json", VD.reply_json(F.col("reply"))))
    out = scored.select(*KEYS, "json_valid", "ratios_cited", "numbers_found", "overall_score")
    return longs(rounded(out, ["overall_score"]), ["json_valid", "ratios_cited", "numbers_found"])


@query(
    "verdict_fallback",
    with_roles(
        ["predicted"],
        f"SELECT ticker, fiscal_year, company_name AS company, CASE WHEN {_VALID} THEN 'model' WHEN fiscal_year % 2 = 1 THEN 'service' ELSE 'template_fallback' END AS generation_method FROM predicted",
    ),
)
def verdict_fallback(spark, sf):
    rows = _replies(spark, sf)
    # the service is asked where the model failed; here it answers for every other year
    service = F.when(F.col("fiscal_year") % 2 == 1, F.concat(F.lit("Certainly.\n"), VD.verdict_json(F.col("verdict"))))
    # each reply is parsed once: as columns of their own, which both the verdict and its method read
    rows = rows.withColumn("_model", VD.parse_reply(F.col("reply")))
    rows = rows.withColumn("_service", F.when(F.col("_model").isNull(), VD.parse_reply(service)))
    steps = [("model", F.col("_model")), ("service", F.col("_service")), ("template", F.col("verdict"))]
    chosen, method = VD.choose_verdict(steps, "template_fallback")
    return rows.select(*KEYS, chosen.alias("v"), method.alias("generation_method")).select(*KEYS, F.col("v.company").alias("company"), "generation_method")


_GRAMS = """w AS (SELECT {by}, list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda x: x <> '') AS t FROM {source}),
g AS (SELECT {by}, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS gram FROM (SELECT {by}, t, unnest(range(1, len(t) - 1)) AS i FROM w))"""


@query(
    "trigram_diversity",
    "WITH " + _GRAMS.format(by="lang", text="text", source="documents")
    + f" SELECT lang, count(DISTINCT gram) AS unique_trigrams, count(*) AS total_trigrams, {r6('count(DISTINCT gram) / count(*)::DOUBLE', 'diversity_ratio')} FROM g GROUP BY 1",
)
def trigram_diversity(spark, sf):
    return rounded(VD.trigram_diversity(R.table(spark, sf, "documents"), F.col("text"), ["lang"]), ["diversity_ratio"])


@query(
    "method_comparison",
    with_roles(
        ["predicted"],
        f"""WITH {_REPLY_SCORE}, {_GRAMS.format(by="m", text="overall_assessment", source=f"(SELECT 'template' AS m, overall_assessment FROM z UNION ALL SELECT 'model', overall_assessment FROM z WHERE {_VALID})")},
d AS (SELECT count(DISTINCT gram) FILTER (m = 'template') / count(*) FILTER (m = 'template')::DOUBLE AS td, count(DISTINCT gram) FILTER (m = 'model') / count(*) FILTER (m = 'model')::DOUBLE AS md FROM g),
x AS (SELECT 1.0 AS tj, avg(CAST({_VALID} AS INTEGER)) AS mj, avg(citation_rate) AS tc, avg(reply_cited / 4.0) AS mc,
  avg((5 + CAST(ratios_cited >= 2 AS INTEGER) + CAST(len(nums) >= 2 AS INTEGER)) / 7.0::DOUBLE) AS ts, avg(reply_score) AS ms, avg(ratios_cited) AS tr, avg(reply_cited) AS mr FROM z),
r AS (SELECT 'json_success_rate' AS metric, tj AS b, mj AS c FROM x UNION ALL SELECT 'avg_citation_rate', tc, mc FROM x UNION ALL SELECT 'avg_overall_score', ts, ms FROM x
  UNION ALL SELECT 'avg_ratios_cited', tr, mr FROM x UNION ALL SELECT 'diversity_ratio', td, md FROM d)
SELECT metric, {r6("b", "baseline")}, {r6("c", "candidate")}, {r6("c - b", "delta")} FROM r""",
    ),
)
def method_comparison(spark, sf):
    rows = _replies(spark, sf)
    both = F.array(
        F.struct(F.lit("template").alias("method"), VD.verdict_json(F.col("verdict")).alias("reply_json")),
        F.struct(F.lit("model").alias("method"), VD.reply_json(F.col("reply")).alias("reply_json")),
    )
    # scored and counted from here; the replies are not made again
    stacked = cut_lineage(rows.select(F.explode(both).alias("x")).select("x.*"), "compared").withColumn("verdict", F.from_json("reply_json", V.VERDICT_SCHEMA))
    scored = VD.score_reply(stacked)
    diversity = VD.trigram_diversity(stacked.where(F.col("verdict").isNotNull()), F.col("verdict.overall_assessment"), ["method"])
    out = VD.compare_methods(scored, "method", "template", "model", diversity)
    return rounded(out, ["baseline", "candidate", "delta"])


# --- prompts and instruction sets -----------------------------------------------------------

_RATIO_LINE = "'Ratios: LIQUID=' || " + " || ".join(
    f"{_f4(r)} || '{tail}'" for r, tail in zip(V.RATIOS, [", CUMPROF=", ", PROFITAB=", ", LEVERAGE=", ""])
)
_PERCENT = "printf('%.0f', confidence * 100) || '%'"
_HEAD = (
    "'Company: ' || company_name || ' | Ticker: ' || ticker || ' | Sector: ' || sector || E'\\n' || 'Fiscal Year: ' || fiscal_year || ' | Agency: ' || rating_agency "
    "|| ' | Actual Rating: ' || coalesce(rating, 'N/A') || E'\\n' || "
)


@query(
    "model_prompt",
    with_roles(
        ["predicted"],
        f"""SELECT ticker, fiscal_year, {_HEAD} 'ML Predicted category: ' || predicted_category || ' (' || {_RISK} || ') | Confidence: ' || {_PERCENT} || E'\\n' || {_RATIO_LINE}
  || E'\\nKAM dummies (0/1): GCKAM=' || GCKAM || ', REVKAM=' || REVKAM || ', ASSETKAM=' || ASSETKAM || ', LIABKAM=' || LIABKAM || ', OTHERKAM=' || OTHERKAM
  || E'\\nNews / FinBERT aggregates: SENT_MEAN=' || {_f4("coalesce(sentiment_mean, 0)")} || ', SENT_STD=' || {_f4("coalesce(sentiment_std, 0)")}
  || ', POS_PCT=' || {_f4("coalesce(sentiment_pos_pct, 0)", 2)} || ', NEG_PCT=' || {_f4("coalesce(sentiment_neg_pct, 0)", 2)} || ', NEWS_N=' || news_count AS prompt FROM predicted""",
    ),
)
def model_prompt(spark, sf):
    rows = predicted_panel(spark, sf)
    return rows.select(*KEYS, VD.model_prompt(rows).alias("prompt"))


def _service_sql() -> str:
    nl = "E'\\n'"
    ratio_lines = f"concat_ws({nl}, " + ", ".join(f"'  - {lab}: ' || {_f4(r)}" for r, lab in V.PROMPT_RATIO_LABELS.items()) + ")"
    flag_lines = f"concat_ws({nl}, " + ", ".join(f"'  - {lab}: ' || {k}" for k, lab in V.PROMPT_FLAG_LABELS.items()) + ")"
    news_lines = f"concat_ws({nl}, " + ", ".join(
        f"'  - {lab}: ' || " + ("news_count" if k == "news_count" else _f4(k)) for k, lab in V.PROMPT_NEWS_LABELS.items()
    ) + ")"
    hints = "\n".join(f'  "{f}": {h}{"," if i < 4 else ""}' for i, (f, h) in enumerate(V.PROMPT_REPLY_HINTS))
    parts = [
        _quote(V.PROMPT_HEAD + "\n\nCOMPANY INFORMATION:\n  Company: "), "company_name", _quote("\n  Ticker: "), "ticker",
        _quote("\n  Rating Agency: "), "rating_agency", _quote("\n  Fiscal Year: "), "fiscal_year",
        _quote("\n\nFINANCIAL RATIOS (Altman-style components):\n"), ratio_lines,
        _quote("\n\nKEY AUDIT MATTER (KAM) DUMMIES (1 = topic disclosed as KAM, 0 = absent):\n"), flag_lines,
        _quote("\n\nNEWS SENTIMENT (FinBERT aggregates for this fiscal year):\n"), news_lines,
        _quote("\n\nML MODEL PREDICTION (multicategory XGBoost: AA / A / BBB / BB):\n  Predicted category: "), "predicted_category",
        _quote("\n  Risk bucket: "), _RISK, _quote("\n  Model confidence: "), "printf('%.1f', confidence * 100) || '%'", _quote("\n  "),
        "CASE WHEN rating IS NOT NULL THEN 'Actual Rating (' || rating_agency || '): ' || rating ELSE 'Actual Rating: Not available' END",
        _quote("\n\n" + V.PROMPT_TASK + '\n\n{\n  "company": "'), "company_name", _quote('",\n  "ticker": "'), "ticker",
        _quote('",\n  "fiscal_year": '), "fiscal_year", _quote(',\n  "predicted_rating": "'), "predicted_category",
        _quote('",\n  "risk_classification": "'), _RISK, _quote('",\n' + hints + "\n}\n\n" + V.PROMPT_TAIL),
    ]
    return " || ".join(f"({p})" for p in parts)


@query("service_prompt", with_roles(["predicted"], f"SELECT ticker, fiscal_year, {_service_sql()} AS prompt FROM predicted"))
def service_prompt(spark, sf):
    rows = predicted_panel(spark, sf)
    return rows.select(*KEYS, VD.service_prompt(rows).alias("prompt"))


def _sft_rows(spark, sf) -> DataFrame:
    made = VD.template_verdict(predicted_panel(spark, sf))
    return VD.instruction_set(made.withColumn("predicted_rating", F.col("predicted_category")))


_GRADE = "CASE WHEN predicted_category = 'BB' THEN 'Speculative Grade' ELSE 'Investment Grade' END"


def _json_list(c: str) -> str:
    items = f"array_to_string(list_transform({c}, lambda x: '\"' || replace(x, '—', '\\u2014') || '\"'), E',\\n    ')"
    return f"E'[\\n    ' || {items} || E'\\n  ]'"


_SFT_OUTPUT = " || ".join(
    [
        "E'{\\n  \"company\": \"' || company_name || E'\",\\n  \"ticker\": \"' || ticker || E'\",\\n  \"fiscal_year\": ' || fiscal_year",
        "E',\\n  \"predicted_rating\": \"' || predicted_category || E'\",\\n  \"risk_classification\": \"' || risk_classification",
        "E'\",\\n  \"overall_assessment\": \"' || overall_assessment || E'\",\\n  \"strengths\": ' || " + _json_list("strengths"),
        "E',\\n  \"weaknesses\": ' || " + _json_list("weaknesses") + " || E',\\n  \"key_risks\": ' || " + _json_list("key_risks"),
        "E',\\n  \"prediction_analysis\": \"' || prediction_analysis || E'\"\\n}'",
    ]
)
_SFT_INPUT = f"{_HEAD} 'ML Predicted: ' || predicted_category || ' (' || {_GRADE} || ') | Confidence: ' || {_PERCENT} || E'\\n' || {_RATIO_LINE}"


@query(
    "sft_set",
    with_roles(["predicted"], f"WITH {_VERDICT} SELECT ticker, fiscal_year, {_quote(V.SFT_INSTRUCTION)} AS instruction, {_SFT_INPUT} AS input, {_SFT_OUTPUT} AS output FROM v"),
)
def sft_set(spark, sf):
    return _sft_rows(spark, sf)


@query(
    "paired_verdicts",
    with_roles(["predicted"], f"WITH {_VERDICT} SELECT ticker, fiscal_year, {_SFT_INPUT} AS input, overall_assessment FROM v WHERE rating_agency <> 'SP'"),
)
def paired_verdicts(spark, sf):
    """Feature rows with the verdicts of the same keys, from two tables."""
    features = predicted_panel(spark, sf).withColumn("predicted_rating", F.col("predicted_category"))
    verdicts = VD.template_verdict(predicted_panel(spark, sf).where("rating_agency <> 'SP'"))
    paired = VD.pair_with_verdicts(features, verdicts)
    return paired.select(*KEYS, VD.instruction_input(paired).alias("input"), F.col("verdict.overall_assessment").alias("overall_assessment"))


@query(
    "sft_patched",
    with_roles(
        ["predicted"],
        f"WITH {_VERDICT} SELECT ticker, fiscal_year, CASE WHEN rating_agency = 'Fitch' THEN 'curated ' || ticker ELSE {_SFT_OUTPUT} END AS output FROM v",
    ),
)
def sft_patched(spark, sf):
    fitch = predicted_panel(spark, sf).where("rating_agency = 'Fitch'")
    patches = fitch.select(*KEYS, F.concat(F.lit("curated "), F.col("ticker")).alias("output"))
    return VD.patch_outputs(_sft_rows(spark, sf), patches).select(*KEYS, "output")


@query(
    "sft_jsonl",
    with_roles(["predicted"], f"WITH {_VERDICT} SELECT ticker, CAST(fiscal_year AS INTEGER) AS fiscal_year, {_SFT_INPUT} AS input, length({_SFT_OUTPUT}) AS output_length, array_to_string(key_risks, ' | ') AS key_risks FROM v"),
)
def sft_jsonl(spark, sf):
    path = scratch_path(spark, "sft")
    ST.write_jsonl(_sft_rows(spark, sf), path)
    back = ST.read_jsonl(spark, path)
    return back.select(
        F.col("verdict.ticker").alias("ticker"), F.col("verdict.fiscal_year").alias("fiscal_year"), "input",
        F.length("output").cast("long").alias("output_length"), F.array_join("verdict.key_risks", " | ").alias("key_risks"),
    )


@query(
    "chat_text",
    """SELECT u.conv_id, u.turn, '<|im_start|>system' || E'\\n' || coalesce(s.text, 'none') || E'<|im_end|>\\n<|im_start|>user\\n' || u.text
  || E'<|im_end|>\\n<|im_start|>assistant\\n' || a.text || E'<|im_end|>\\n' AS chat
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
LEFT JOIN conversations s ON s.conv_id = u.conv_id AND s.turn = 0 AND s.role = 'system' WHERE u.role = 'user'""",
)
def chat_text(spark, sf):
    rows = R.table(spark, sf, "conversations")
    user = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user"))
    reply = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant"))
    system = rows.where("role = 'system' AND turn = 0").select("conv_id", F.col("text").alias("system"))
    joined = user.join(reply, ["conv_id", "turn"]).join(system, "conv_id", "left")
    messages = VD.chat_messages(F.coalesce("system", F.lit("none")), F.col("user"), F.col("assistant"))
    return joined.select("conv_id", "turn", VD.render_chat(messages).alias("chat"))


@query(
    "risk_grades",
    with_roles(["predicted"], f"SELECT ticker, fiscal_year, {_GRADE} AS grade, {_RISK} AS risk FROM predicted"),
)
def risk_grades(spark, sf):
    from ratingloom.functions.ratings import risk_class

    p = F.col("predicted_category")
    return predicted_panel(spark, sf).select(*KEYS, risk_grade(p).alias("grade"), risk_class(p).alias("risk"))
