"""Structured verdicts as columns: writing, prompting, parsing, scoring, instruction sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.functions.ratings import risk_class, risk_grade
from ratingloom.functions.ratios import mean_ratio_score
from ratingloom.functions.text import blank_separated, fill, fixed, json_object, json_string, numbers_in, percent
from ratingloom.operators.panel import KEYS

_c = F.col

#: Characters of the texts whose word runs one task combines.
RUN_CHARS = 1 << 23


# Columns of written numbers, made once per row and used in many texts.
_TEXT = {name: f"_{name}_text" for name in [*V.RATIOS, "score"]}
_SCORE = "_score"


def _with_texts(df: DataFrame) -> DataFrame:
    scored = df.withColumn(_SCORE, mean_ratio_score(_c("liquid"), _c("cumprof"), _c("profitab")))
    written = {_TEXT[r]: fixed(_c(r), 4) for r in V.RATIOS} | {_TEXT["score"]: fixed(_c(_SCORE), 4)}
    return scored.withColumns({**written, "_confidence_text": percent(_c("confidence"))})


def _present(items: list[Column]) -> Column:
    return F.array_compact(F.array(*items))


def _ladder(ratio: str, side: str) -> Column:
    """The ladder's text if its step falls on this side, else NULL."""
    out = F.lit(None).cast("string")
    for limit, step_side, text in reversed(V.VERDICT_LADDERS[ratio]):
        step = fill(text, v=_c(_TEXT[ratio])) if step_side == side else F.lit(None).cast("string")
        out = step if limit is None else F.when(_c(ratio) > limit, step).otherwise(out)
    return out


def _or_filler(items: Column, filler: str) -> Column:
    return F.when(F.size(items) == 0, F.array(F.lit(filler))).otherwise(items)


def _optional(condition: Column, text: Column) -> Column:
    return F.array_compact(F.array(F.when(condition, text)))


def _value(name: str, df: DataFrame, default: Column) -> Column:
    return F.coalesce(_c(name), default) if name in df.columns else default


def template_verdict(df: DataFrame, method: str = "template") -> DataFrame:
    """Adds the `verdict` struct written from ratios, flags and news of each row.

    Needs the four ratios, predicted_category and confidence. Fillers ("none
    found") are decided before news and flags add their own lines.
    """
    given = df.columns
    df = _with_texts(df)
    zero = F.lit(0)
    count = _value("news_count", df, zero).cast("int")
    mean = _value("sentiment_mean", df, F.lit(0.0))
    negative_news = (count != 0) & (mean < V.NEGATIVE_NEWS_LIMIT)
    strengths = F.concat(
        _or_filler(_present([_ladder(r, "strength") for r in V.RATIOS]), V.NO_STRENGTH_TEXT),
        _optional(_value("ASSETKAM", df, zero) == 1, F.lit(V.ASSET_FLAG_TEXT)),
    )
    weaknesses = F.concat(
        _or_filler(_present([_ladder(r, "weakness") for r in V.RATIOS]), V.NO_WEAKNESS_TEXT),
        _optional(negative_news, fill(V.NEGATIVE_NEWS_TEXT, v=fixed(mean, 3), n=count)),
    )
    risks = F.concat(
        _or_filler(_present([F.when(_c(r) < limit, F.lit(text)) for r, limit, text in V.RISK_RULES]), V.NO_RISK_TEXT),
        _optional(count == 0, F.lit(V.NO_NEWS_TEXT)),
        _optional(_value("REVKAM", df, zero) == 1, F.lit(V.REVENUE_FLAG_TEXT)),
    )
    predicted = _c("predicted_category")
    return df.withColumn(
        "verdict",
        F.struct(
            _value("company_name", df, F.lit("Unknown")).alias("company"),
            _c("ticker").alias("ticker"),
            _c("fiscal_year").cast("int").alias("fiscal_year"),
            predicted.alias("predicted_rating"),
            risk_class(predicted).alias("risk_classification"),
            _overall(df).alias("overall_assessment"),
            strengths.alias("strengths"),
            weaknesses.alias("weaknesses"),
            risks.alias("key_risks"),
            _analysis(df).alias("prediction_analysis"),
        ),
    ).select(*given, "verdict", F.lit(method).alias("generation_method"))


def _analysis(df: DataFrame) -> Column:
    score, predicted = _c(_SCORE), _c("predicted_category")
    investment = predicted.isin(V.INVESTMENT_CATEGORIES)
    places = {r: _c(_TEXT[r]) for r in V.RATIOS} | {"p": predicted, "avg": _c(_TEXT["score"])}
    text = (
        F.when(investment & (score > V.ANALYSIS_LIMIT), fill(V.ANALYSIS_ALIGNED, **places))
        .when(investment, fill(V.ANALYSIS_MODEST, **places))
        .when(score < V.ANALYSIS_LIMIT, fill(V.ANALYSIS_WEAK, **places))
        .otherwise(fill(V.ANALYSIS_MIXED, **places))
    )
    if not {"rating", "rating_category"} <= set(df.columns):
        return text
    differs = (_c("rating") != "") & (_c("rating_category") != "") & (predicted != _c("rating_category"))
    note = fill(V.ANALYSIS_NOTE, actual=_c("rating"), category=_c("rating_category"), p=predicted)
    return F.concat(text, F.when(differs, note).otherwise(""))


def _overall(df: DataFrame) -> Column:
    profile = F.lit(V.PROFILE_LIMITS[-1][1])
    for limit, word in reversed(V.PROFILE_LIMITS[:-1]):
        profile = F.when(_c(_SCORE) > limit, word).otherwise(profile)
    predicted = _c("predicted_category")
    return fill(
        V.OVERALL_TEXT,
        name=_value("company_name", df, F.lit("Unknown")),
        ticker=_c("ticker"),
        profile=profile,
        year=_c("fiscal_year"),
        p=predicted,
        risk=risk_class(predicted),
        confidence=_c("_confidence_text"),
    )


# --- prompts --------------------------------------------------------------------------------


def _lines(items: list[Column], none: str | None = None) -> Column:
    joined = F.concat_ws("\n", *items)  # concat_ws leaves NULL lines out
    return joined if none is None else F.when(joined == "", none).otherwise(joined)


def service_prompt(df: DataFrame) -> Column:
    """Prompt for a model service; lines of missing values are left out."""
    c, predicted = _c, _c("predicted_category")
    ratios = _lines(
        [F.when(c(r).isNotNull(), F.concat(F.lit(f"  - {label}: "), fixed(c(r), 4))) for r, label in V.PROMPT_RATIO_LABELS.items()],
        V.PROMPT_NO_RATIOS,
    )
    flags = _lines(
        [F.concat(F.lit(f"  - {label}: "), F.coalesce(c(k), F.lit(0)).cast("int").cast("string")) for k, label in V.PROMPT_FLAG_LABELS.items()]
    )
    news = _lines(
        [
            F.when(
                c(k).isNotNull(),
                F.concat(F.lit(f"  - {label}: "), c(k).cast("int").cast("string") if k == "news_count" else fixed(c(k), 4)),
            )
            for k, label in V.PROMPT_NEWS_LABELS.items()
        ],
        V.PROMPT_NO_NEWS,
    )
    name, ticker, year = c("company_name"), c("ticker"), c("fiscal_year").cast("string")
    actual = F.when(
        c("rating") != "", F.concat(F.lit("Actual Rating ("), c("rating_agency"), F.lit("): "), c("rating"))
    ).otherwise("Actual Rating: Not available")
    reply = [
        fill('  "company": "{x}",', x=name), fill('  "ticker": "{x}",', x=ticker), fill('  "fiscal_year": {x},', x=year),
        fill('  "predicted_rating": "{x}",', x=predicted), fill('  "risk_classification": "{x}",', x=risk_class(predicted)),
    ]
    hints = ",\n".join(f'  "{field}": {hint}' for field, hint in V.PROMPT_REPLY_HINTS)
    sections = [
        F.lit(V.PROMPT_HEAD),
        F.concat(F.lit("COMPANY INFORMATION:\n"), fill("  Company: {n}\n  Ticker: {t}\n  Rating Agency: {a}\n  Fiscal Year: {y}", n=name, t=ticker, a=c("rating_agency"), y=year)),
        F.concat(F.lit("FINANCIAL RATIOS (Altman-style components):\n"), ratios),
        F.concat(F.lit("KEY AUDIT MATTER (KAM) DUMMIES (1 = topic disclosed as KAM, 0 = absent):\n"), flags),
        F.concat(F.lit("NEWS SENTIMENT (FinBERT aggregates for this fiscal year):\n"), news),
        F.concat(
            F.lit("ML MODEL PREDICTION (multicategory XGBoost: AA / A / BBB / BB):\n"),
            fill("  Predicted category: {p}\n  Risk bucket: {r}\n  Model confidence: {k}\n  {a}", p=predicted, r=risk_class(predicted), k=percent(c("confidence"), 1), a=actual),
        ),
        F.lit(V.PROMPT_TASK),
        F.concat(F.lit("{\n"), F.concat_ws("\n", *reply), F.lit(f"\n{hints}\n}}")),
        F.lit(V.PROMPT_TAIL),
    ]
    return F.concat_ws("\n\n", *sections)


def _prompt_head(sector: Column, predicted: Column, label: str, risk: Column) -> Column:
    return fill(
        "Company: {n} | Ticker: {t} | Sector: {s}\nFiscal Year: {y} | Agency: {a} | Actual Rating: {r}\n"
        + label + ": {p} ({k}) | Confidence: {c}\n",
        n=_c("company_name"), t=_c("ticker"), s=sector, y=_c("fiscal_year"), a=_c("rating_agency"),
        r=F.coalesce(_c("rating"), F.lit("N/A")), p=predicted, k=risk, c=percent(_c("confidence")),
    )


def _ratio_line() -> Column:
    return fill(
        "Ratios: LIQUID={liquid}, CUMPROF={cumprof}, PROFITAB={profitab}, LEVERAGE={leverage}",
        **{r: fixed(_c(r), 4) for r in V.RATIOS},
    )


def model_prompt(df: DataFrame) -> Column:
    """User message for the tuned model: ratios, flags and news on one line each."""
    c, predicted = _c, _c("predicted_category")
    flags = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(c(k), F.lit(0)).cast("int").cast("string")) for k in V.KAM_FIVE])
    value = {k: F.coalesce(c(k), F.lit(0)).cast("double") for k in V.NEWS_FEATURES}
    news = fill(
        "SENT_MEAN={m}, SENT_STD={s}, POS_PCT={p}, NEG_PCT={n}, NEWS_N={k}",
        m=fixed(value["sentiment_mean"], 4), s=fixed(value["sentiment_std"], 4), p=fixed(value["sentiment_pos_pct"], 2),
        n=fixed(value["sentiment_neg_pct"], 2), k=value["news_count"].cast("int"),
    )
    head = _prompt_head(_value("sector", df, F.lit("N/A")), predicted, "ML Predicted category", risk_class(predicted))
    return F.concat(head, _ratio_line(), F.lit("\nKAM dummies (0/1): "), flags, F.lit("\nNews / FinBERT aggregates: "), news)


def instruction_input(df: DataFrame) -> Column:
    """Input text of an instruction-set record."""
    predicted = _c("predicted_rating")
    return F.concat(_prompt_head(_value("sector", df, F.lit("N/A")), predicted, "ML Predicted", risk_grade(predicted)), _ratio_line())


# --- replies --------------------------------------------------------------------------------


#: A JSON object whose strings are double-quoted and hold no raw control character; outside them neither stands.
_STRICT = r"""(?s)^\s*\{(?:[^"'\x00-\x08\x0b\x0c\x0e-\x1f]|"(?:[^"\\\x00-\x1f]|\\.)*+")*+$"""


def _json_text(c: Column) -> Column:
    """The text if it is one strict JSON object and nothing else, else NULL.

    Spark's reader is lenient: it takes single quotes and raw tabs and stops after
    the first object. The pattern rejects the first two; of braces outside strings the
    last must be the one that closes the first.
    """
    outside = F.regexp_replace(c, r'"(?:[^"\\]|\\.)*+"', '""')
    braces = F.regexp_replace(outside, r"[^{}]", "")
    # a closing brace followed by an opening one at the outermost level would be a second object
    depth = F.aggregate(
        F.split(braces, ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("closed")),
        lambda s, x: F.struct(
            (s["d"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)).alias("d"), (s["closed"] + ((x == "}") & (s["d"] == 1)).cast("int")).alias("closed")
        ),
    )
    return F.when(c.rlike(_STRICT) & c.rlike(r"\}\s*$") & (depth["d"] == 0) & (depth["closed"] == 1) & F.json_object_keys(c).isNotNull(), c)


def reply_json(reply: Column) -> Column:
    """The JSON object in a reply: as it is, without fence lines, or from the first { to the last }."""
    text = F.btrim(reply, F.lit(" \t\n\r"))
    kept = F.filter(F.split(text, "\n"), lambda line: ~F.ltrim(line).startswith("```"))
    text = F.when(text.startswith("```"), F.array_join(kept, "\n")).otherwise(text)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(_json_text(text), F.when(inner != "", _json_text(inner)))


def parse_reply(reply: Column) -> Column:
    """Verdict struct of a reply, NULL when there is no JSON object in it."""
    return F.from_json(reply_json(reply), V.VERDICT_SCHEMA)


def choose_verdict(candidates: Sequence[tuple[str, Column]], fallback: str) -> tuple[Column, Column]:
    """The first candidate struct that is there, and the method it came from.

    The last candidate is the template; `fallback` names it when earlier
    methods were asked and failed.
    """
    verdict = F.coalesce(*[c for _, c in candidates])
    method = F.lit(None).cast("string")
    for i, (name, c) in reversed(list(enumerate(candidates))):
        label = fallback if i == len(candidates) - 1 and i > 0 else name
        method = F.when(c.isNotNull(), F.lit(label)).otherwise(method)
    return verdict, method


# --- scoring --------------------------------------------------------------------------------


def _any_word(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _long(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0)) > 20


def _filled(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def _share(parts: list[Column]) -> Column:
    total = parts[0].cast("int")
    for p in parts[1:]:
        total = total + p.cast("int")
    return total / F.lit(len(parts))


def _with_verdict_text(df: DataFrame, verdict: str) -> DataFrame:
    """The verdict as lower-case JSON text ("" for none) and the decimals in it."""
    text = F.coalesce(F.lower(F.to_json(_c(verdict), {"writeNonAsciiCharacterAsCodePoint": "true"})), F.lit(""))
    return df.withColumn("_text", text).withColumn("_numbers", numbers_in(_c("_text")))


def score_verdict(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Adds the checks of a verdict against the row's ratios and their mean over eight.

    A number counts as right when it is part of any of the four ratios written
    with four decimals. A NULL ratio is written as "nan".
    """
    v, text, numbers, written = _c(verdict), _c("_text"), _c("_numbers"), _c("_written")
    prepared = _with_verdict_text(df, verdict).withColumn(
        "_written", F.array(*[F.coalesce(fixed(_c(r), 4), F.lit("nan")) for r in V.RATIOS])
    )
    right = F.size(F.filter(numbers, lambda n: F.exists(written, lambda w: w.contains(n))))
    cited = sum((text.contains(r).cast("int") for r in V.RATIOS), F.lit(0))
    out = prepared.withColumns(
        {
            "has_company_name": F.coalesce(v["company"], F.lit("")) != "",
            "has_overall_assessment": _long(v["overall_assessment"]),
            "has_strengths": _filled(v["strengths"]),
            "has_weaknesses": _filled(v["weaknesses"]),
            "has_prediction_analysis": _long(v["prediction_analysis"]),
            "ratios_cited": cited,
            "citation_rate": cited / F.lit(len(V.RATIOS)),
            "numbers_accuracy": right / F.greatest(F.size(numbers), F.lit(1)),
            "mentions_risk": _any_word(text, V.RISK_WORDS),
            "mentions_strength": _any_word(text, V.STRENGTH_WORDS),
        }
    )
    parts = [
        _c("has_overall_assessment"), _c("has_strengths"), _c("has_weaknesses"), _c("has_prediction_analysis"),
        _c("citation_rate") >= 0.5, _c("numbers_accuracy") >= 0.5, _c("mentions_risk"), _c("mentions_strength"),
    ]
    return out.withColumn("overall_score", _share(parts)).drop("_text", "_numbers", "_written")


def _reply_field(text: Column, name: str) -> Column:
    """Length of a string field or number of entries of a list, 0 if it is missing or null."""
    value = F.get_json_object(text, f"$.{name}")
    return F.coalesce(F.json_array_length(value), F.length(value), F.lit(0))


def score_reply(df: DataFrame, reply: str = "reply_json") -> DataFrame:
    """The second scoring, over the accepted JSON text of a reply; NULL fails every check.

    Fields the model added count like the others, and a strength or weakness given as
    plain text counts by its length.
    """
    text = F.lower(F.coalesce(_c(reply), F.lit("")))
    cited = sum((_c("_text").contains(r).cast("int") for r in V.RATIOS), F.lit(0))
    out = df.withColumn("_text", text).withColumn("_numbers", numbers_in(_c("_text"))).withColumns(
        {
            "json_valid": _c(reply).isNotNull(),
            "has_company": F.coalesce(F.get_json_object(_c(reply), "$.company"), F.lit("")) != "",
            "has_overall": _reply_field(_c(reply), "overall_assessment") > 20,
            "has_strengths": _reply_field(_c(reply), "strengths") > 0,
            "has_weaknesses": _reply_field(_c(reply), "weaknesses") > 0,
            "has_analysis": _reply_field(_c(reply), "prediction_analysis") > 20,
            "ratios_cited": cited,
            "citation_rate": cited / F.lit(len(V.RATIOS)),
            "numbers_found": F.size("_numbers"),
        }
    )
    parts = [
        _c("json_valid"), _c("has_overall"), _c("has_strengths"), _c("has_weaknesses"), _c("has_analysis"),
        _c("citation_rate") >= 0.5, _c("numbers_found") >= 2,
    ]
    return out.withColumn("overall_score", _share(parts)).drop("_text", "_numbers")


def verdict_summary(scored: DataFrame) -> DataFrame:
    """One row of averages over scored verdicts, with the category accuracy."""
    match = (_c("predicted_category") == _c("rating_category")).cast("int")
    return scored.agg(
        F.count(F.lit(1)).alias("total_verdicts"),
        F.avg("overall_score").alias("avg_overall_score"),
        F.avg("citation_rate").alias("avg_citation_rate"),
        F.avg("numbers_accuracy").alias("avg_number_accuracy"),
        F.min("overall_score").alias("min_score"),
        F.max("overall_score").alias("max_score"),
        F.coalesce(F.sum(match), F.lit(0)).alias("category_correct"),
        F.coalesce(F.avg(match), F.lit(0.0)).alias("category_accuracy"),
    )


def trigram_diversity(df: DataFrame, text: Column, by: Sequence[str] = ()) -> DataFrame:
    """Distinct and total three-word runs, and their quotient, per group.

    Runs are counted first, so a frequent one is a single row after the
    map-side combine. 128 bits of hash stand for a run, so no text is made or moved for it.
    """
    # where most runs are distinct the combine holds nearly all of a task's runs, so tasks get texts of bounded size
    texts = df.select(*by, text.alias("_text")).where(_c("_text").isNotNull())
    parts = -(-(texts.agg(F.sum(F.length("_text").cast("long"))).first()[0] or 0) // RUN_CHARS)
    if parts > df.sparkSession.sparkContext.defaultParallelism:
        texts = texts.repartition(parts)
    tokens = texts.select(*by, blank_separated(_c("_text")).alias("_t")).where(F.size("_t") >= 3)
    words = lambda i: [F.get("_t", i + k) for k in range(3)]
    runs = F.transform(
        F.sequence(F.lit(0), F.size("_t") - 3),
        lambda i: F.struct(F.xxhash64(*words(i)).alias("_a"), F.xxhash64(F.lit(1), *words(i)).alias("_b")),
    )
    grams = tokens.select(*by, F.inline(runs))
    counted = grams.groupBy(*by, "_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    out = counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("unique_trigrams"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total_trigrams")
    )
    ratio = F.coalesce(F.try_divide(_c("unique_trigrams").cast("double"), _c("total_trigrams").cast("double")), F.lit(0.0))
    return out.withColumn("diversity_ratio", ratio)


_COMPARED = {
    "json_success_rate": F.avg, "avg_citation_rate": F.avg, "avg_overall_score": F.avg, "avg_ratios_cited": F.avg,
}


def compare_methods(scored: DataFrame, method: str, baseline: str, candidate: str, diversity: DataFrame) -> DataFrame:
    """Per metric: the baseline's value, the candidate's, and the difference.

    `scored` is the output of `score_reply` with a method column; `diversity`
    that of `trigram_diversity` per method.
    """
    source = {
        "json_success_rate": _c("json_valid").cast("int"), "avg_citation_rate": _c("citation_rate"),
        "avg_overall_score": _c("overall_score"), "avg_ratios_cited": _c("ratios_cited"),
    }
    wide = scored.groupBy(method).agg(*[agg(source[name]).alias(name) for name, agg in _COMPARED.items()])
    wide = wide.join(diversity.select(method, _c("diversity_ratio")), method, "left").fillna(0.0, ["diversity_ratio"])
    metrics = [*_COMPARED, "diversity_ratio"]
    tall = wide.unpivot(method, metrics, "metric", "value")
    out = tall.groupBy("metric").agg(
        F.max(F.when(_c(method) == baseline, _c("value"))).alias("baseline"),
        F.max(F.when(_c(method) == candidate, _c("value"))).alias("candidate"),
    )
    return out.withColumn("delta", _c("candidate") - _c("baseline"))


# --- instruction sets -----------------------------------------------------------------------

_FIELD_KINDS = {"fiscal_year": "number", "strengths": "strings", "weaknesses": "strings", "key_risks": "strings"}


def verdict_json(v: Column) -> Column:
    """The verdict as an indented JSON object in its field order."""
    return json_object([(f, v[f], _FIELD_KINDS.get(f, "string")) for f in V.VERDICT_FIELDS])


def pair_with_verdicts(features: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Feature rows with the verdict of the same key."""
    return features.join(verdicts.select(*KEYS, "verdict"), KEYS)


def instruction_set(df: DataFrame) -> DataFrame:
    """(key, instruction, input, output) from rows with a verdict, predicted rating and confidence."""
    return df.select(
        *KEYS,
        F.lit(V.SFT_INSTRUCTION).alias("instruction"),
        instruction_input(df).alias("input"),
        verdict_json(_c("verdict")).alias("output"),
    )


def patch_outputs(records: DataFrame, patches: DataFrame) -> DataFrame:
    """Records with the curated output of their key where there is one."""
    new = patches.select(*KEYS, _c("output").alias("_patch"))
    joined = records.join(new, KEYS, "left")
    return joined.withColumn("output", F.coalesce(_c("_patch"), _c("output"))).drop("_patch")


def chat_messages(system: Column, user: Column, assistant: Column) -> Column:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("system", system), turn("user", user), turn("assistant", assistant))


def render_chat(messages: Column) -> Column:
    """Turns between start and end marks, one after the other."""
    lines = F.transform(
        messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))
    )
    return F.array_join(lines, "")


def records_as_jsonl(records: DataFrame) -> DataFrame:
    """One JSON text per record, for a line-per-record sink."""
    line = F.concat(
        F.lit('{"instruction": '), json_string(_c("instruction")), F.lit(', "input": '), json_string(_c("input")),
        F.lit(', "output": '), json_string(_c("output")), F.lit("}"),
    )
    return records.select(line.alias("value"))
