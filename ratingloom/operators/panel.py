"""Building one row per (ticker, fiscal_year): alignment, merges, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.functions.cleaning import blank_to_null, nan_to_null, to_flag, to_number, to_year
from ratingloom.functions.ratings import binary_below_investment_grade, is_known_rating, rating_category
from ratingloom.functions.ratios import core_ratios, supplement_ebit
from ratingloom.operators.picking import pick_first, prefer_agency

KEYS = ["ticker", "fiscal_year"]


# --- cleaning -------------------------------------------------------------------------------


def clean_keys(df: DataFrame, year: str = "fiscal_year") -> DataFrame:
    """Ticker trimmed, year an integer; rows without either are dropped."""
    out = df.withColumn("ticker", F.trim("ticker")).withColumn(year, to_year(F.col(year)))
    return out.where(F.col("ticker").isNotNull() & F.col(year).isNotNull())


def with_columns_of(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """Add the contract's missing columns as typed NULLs."""
    missing = {c: F.lit(None).cast(t) for c, t in contract.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def select_contract(df: DataFrame, contract: Sequence[str]) -> DataFrame:
    """The contract's columns in its order, those that exist."""
    return df.select(*[c for c in contract if c in df.columns])


def coerce_flags(df: DataFrame, flags: Sequence[str] = tuple(V.FLAGS)) -> DataFrame:
    """Flags as integers, missing values and columns as 0."""
    return df.withColumns({c: to_flag(F.col(c)) if c in df.columns else F.lit(0) for c in flags})


def build_panel(raw: DataFrame) -> DataFrame:
    """The audit-matter table that defines the panel's rows."""
    out = coerce_flags(clean_keys(raw))
    return select_contract(out, ["ticker", "company_name", "fiscal_year", "rating", *V.FLAGS])


def financial_columns(df: DataFrame) -> DataFrame:
    """Contract columns of the financial table with numeric ratios."""
    present = [c for c in V.RATIOS if c in df.columns]
    out = df.drop(*V.UNUSED_FINANCIAL_COLUMNS).withColumns({c: to_number(F.col(c)) for c in present})
    return select_contract(out, V.FINANCIAL_CONTRACT)


def drop_null_ratios(df: DataFrame) -> DataFrame:
    return df.dropna(how="any", subset=V.RATIOS)


def fill_features(df: DataFrame) -> DataFrame:
    """The last step before training: no sentiment becomes 0, no flag becomes 0.

    `has_news_coverage` stays beside the filled values when it is there, since
    a filled 0 and a neutral 0 look alike.
    """
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("double") for c in V.NEWS_FEATURES})
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") if c in df.columns else F.lit(0) for c in V.FLAGS})


# --- joins ----------------------------------------------------------------------------------


def dedupe_by_agency(
    df: DataFrame, tie: Sequence[Column], preferred: str = V.PREFERRED_AGENCY, agency: str = "rating_agency"
) -> DataFrame:
    """One row per key: the preferred agency first, then the given tie order."""
    return pick_first(df, KEYS, [prefer_agency(agency, preferred), *tie])


def align_to_panel(panel: DataFrame, df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Every panel key once per panel row, with the first matching row of `df`."""
    return panel.select(*KEYS).join(pick_first(df, KEYS, order), KEYS, "left")


def align_financials(panel: DataFrame, financials: DataFrame, preferred: str = V.PREFERRED_AGENCY) -> DataFrame:
    """Multi-agency financials on the panel.

    The panel's company name wins, its rating fills a missing one, and an
    existing binary target wins over the computed one.
    """
    picked = dedupe_by_agency(financials.drop("company_name"), [F.col("rating_agency"), F.col("rating")], preferred)
    picked = with_columns_of(picked, {**{c: "double" for c in V.RATIOS}, "binary_target": "int"})
    right = picked.withColumnRenamed("rating", "_rating")
    joined = panel.select(*KEYS, "company_name", "rating").join(right, KEYS, "left")
    rating = F.coalesce(F.col("_rating"), F.col("rating"))
    return joined.select(
        "ticker",
        "company_name",
        F.coalesce(F.col("rating_agency"), F.lit("")).alias("rating_agency"),
        rating.alias("rating"),
        "fiscal_year",
        *V.RATIOS,
        F.coalesce(to_number(F.col("binary_target")).cast("int"), binary_below_investment_grade(rating)).alias("binary_target"),
    )


def join_keeping_left(left: DataFrame, right: DataFrame, keys: Sequence[str] = tuple(KEYS), how: str = "inner") -> DataFrame:
    """Join in which a shared column is the left one."""
    shared = set(left.columns) - set(keys)
    return left.join(right.select(*[c for c in right.columns if c not in shared]), list(keys), how)


def join_sources(financials: DataFrame, panel: DataFrame, news: DataFrame) -> DataFrame:
    """Financials, audit flags and news of the keys all three have."""
    merged = join_keeping_left(join_keeping_left(financials, panel), news)
    return with_sector_and_agency(merged)


def with_sector_and_agency(df: DataFrame, agency: str = "Tassnief") -> DataFrame:
    """Sector from the statement source, and the default agency where none is known."""
    sector = F.coalesce(F.col("yfinance_sector"), F.lit("")) if "yfinance_sector" in df.columns else F.lit("")
    known = blank_to_null(F.col("rating_agency")) if "rating_agency" in df.columns else F.lit(None)
    return df.withColumns({"sector": sector, "rating_agency": F.coalesce(known, F.lit(agency))})


def training_frame(financials: DataFrame, news: DataFrame, panel: DataFrame, label_source: str = "financials") -> DataFrame:
    """The 21-feature frame with its rating category.

    The two published scripts take the label from different tables, hence
    `label_source`: "financials" or "panel".
    """
    extra = [c for c in ("company_name", "rating_agency") if c in financials.columns]
    fin = financials.select(*KEYS, "rating", *V.RATIOS, *extra)
    coverage = [c for c in ("has_news_coverage",) if c in news.columns]
    flags = panel.select(*KEYS, *[c for c in V.FLAGS if c in panel.columns], F.col("rating").alias("_panel_rating"))
    merged = drop_null_ratios(fin).join(news.select(*KEYS, *V.NEWS_FEATURES, *coverage), KEYS).join(flags, KEYS)
    if label_source == "panel":
        merged = merged.withColumn("rating", F.col("_panel_rating"))
    return fill_features(merged.drop("_panel_rating")).withColumn("rating_category", rating_category(F.col("rating")))


def join_on_renamed_year(
    panel: DataFrame, preferred_source: DataFrame | None, other_source: DataFrame | None
) -> DataFrame:
    """Financials joined to a panel whose year column has its own name.

    Uses the ratio table when there is one, else the multi-agency table with
    one row per key; in the second case the label is the panel's.
    """
    flags = panel.withColumnRenamed("fiscal_year", "fiscal_year_kam").withColumnRenamed("ticker", "_ticker")
    if preferred_source is not None:
        left, right = preferred_source, flags.select("_ticker", "fiscal_year_kam", *V.FLAGS)
    elif other_source is not None:
        left = dedupe_by_agency(clean_keys(other_source), [F.col("rating_agency"), F.col("rating")])
        left = left.select(*KEYS, *V.RATIOS, *[c for c in ("company_name", "rating_agency") if c in left.columns])
        right = flags.select("_ticker", "fiscal_year_kam", "rating", *V.FLAGS)
    else:
        raise ValueError("one of the two financial tables is needed")
    on = (left["ticker"] == right["_ticker"]) & (left["fiscal_year"] == right["fiscal_year_kam"])
    return left.join(right, on, "inner").drop("_ticker")


# --- supplement and refresh -----------------------------------------------------------------

_SUPPLEMENT_NUMBERS = [
    "total_assets", "total_liabilities", "total_equity", "current_assets", "current_liabilities",
    "retained_earnings", "operating_profit", "ebit",
]
_SUPPLEMENT_TEXTS = ["statement_period_end", "yfinance_sector", "yfinance_industry"]


def supplement_updates(supplement: DataFrame, order: str) -> DataFrame:
    """What each key's supplement rows overwrite: per column the last value given."""
    s = with_columns_of(supplement, {**{c: "double" for c in _SUPPLEMENT_NUMBERS}, **{c: "string" for c in _SUPPLEMENT_TEXTS}})
    s = clean_keys(s).withColumns({c: nan_to_null(F.col(c).cast("double")) for c in _SUPPLEMENT_NUMBERS})
    c = F.col
    ratios = core_ratios(
        c("total_assets"), c("current_assets"), c("current_liabilities"), c("retained_earnings"),
        c("total_equity"), c("total_liabilities"), supplement_ebit(c("operating_profit"), c("ebit")),
    )
    values = {
        **ratios,
        **{n: c(n) for n in ("total_assets", "total_liabilities", "total_equity")},
        **{n: blank_to_null(c(n)) for n in _SUPPLEMENT_TEXTS},
    }
    rows = s.select(*KEYS, c(order).alias("_order"), *[v.alias(n) for n, v in values.items()])
    last = [F.max_by(n, F.when(c(n).isNotNull(), c("_order"))).alias(n) for n in values]
    return rows.groupBy(*KEYS).agg(*last)


def merge_supplement(base: DataFrame, supplement: DataFrame, order: str) -> DataFrame:
    """Base rows with the supplement's non-null values written over them."""
    updates = supplement_updates(supplement, order)
    fields = [n for n in updates.columns if n not in KEYS]
    renamed = updates.select(*KEYS, *[F.col(n).alias(f"_new_{n}") for n in fields])
    joined = base.join(renamed, KEYS, "left")
    merged = {
        n: F.coalesce(F.col(f"_new_{n}"), F.col(n)) if n in base.columns else F.col(f"_new_{n}") for n in fields
    }
    return joined.withColumns(merged).drop(*[f"_new_{n}" for n in fields])


def unmatched_supplement(base: DataFrame, supplement: DataFrame) -> DataFrame:
    """Supplement rows that no base row takes."""
    return clean_keys(supplement).join(base.select(*KEYS), KEYS, "left_anti")


def upsert_refreshed(base: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Replace the refreshed columns of every base row and append new keys.

    A base key missing from the refresh gets NULL in these columns. One full
    outer join does both halves.
    """
    taken = [c for c in V.REFRESHED_COLUMNS if c in refreshed.columns]
    kept = [c for c in base.columns if c not in V.REFRESHED_COLUMNS and c not in KEYS]
    left = base.select(*KEYS, *kept, F.lit(True).alias("_in_base"))
    right = refreshed.select(
        *KEYS, *taken, *[F.col(c).alias(f"_new_{c}") for c in kept if c in refreshed.columns]
    )
    joined = left.join(right, KEYS, "full")
    carried = [
        F.when(F.col("_in_base"), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c) if c in refreshed.columns else F.col(c)
        for c in kept
    ]
    return joined.select(*KEYS, *carried, *taken)


def with_first_rating_date(panel: DataFrame, ratings: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rating date of the first matching row, blank when there is none."""
    dates = pick_first(ratings.select(*KEYS, "rating_date", *[c.alias(f"_k{i}") for i, c in enumerate(order)]), KEYS, [F.col(f"_k{i}") for i in range(len(order))])
    joined = panel.join(dates.select(*KEYS, "rating_date"), KEYS, "left")
    return joined.withColumn("rating_date", F.coalesce(F.col("rating_date").cast("string"), F.lit("")))


def attach_latest_rating(panel: DataFrame, ratings: DataFrame, date: str = "rating_date") -> DataFrame:
    """The latest rating dated on or before the end of each panel year.

    The as-of part is an equi-join on the ticker against one row per ticker
    and rating year, followed by a maximum, so no row pairs within a year are
    formed.
    """
    latest = F.max(F.struct(F.col(date).alias("rating_date"), F.col("rating").alias("rating")))
    per_year = ratings.where(F.col(date).isNotNull()).groupBy("ticker", F.year(date).alias("_ry")).agg(latest.alias("_r"))
    joined = panel.select(*KEYS).distinct().join(per_year, "ticker", "left").where(
        F.col("_ry").isNull() | (F.col("_ry") <= F.col("fiscal_year"))
    )
    best = joined.groupBy(*KEYS).agg(F.max("_r").alias("_r"))
    out = panel.select(*KEYS).distinct().join(best, KEYS, "left")
    return out.select(*KEYS, F.col("_r.rating").alias("rating"), F.col("_r.rating_date").alias("rating_date"))


# --- windows over a key ---------------------------------------------------------------------


def pick_period(statements: DataFrame, keys: Sequence[str], period: str = "period_end") -> DataFrame:
    """Of the periods ending in a fiscal year, 31 December if reported, else the latest."""
    end = F.col(period).cast("date")
    rows = statements.where(end.isNotNull()).withColumn("fiscal_year", F.year(end))
    year_end = (F.month(end) == 12) & (F.dayofmonth(end) == 31)
    order = [F.when(year_end, 0).otherwise(1), -F.unix_date(end)]
    return pick_first(rows, [*keys, "fiscal_year"], order)


def growth(df: DataFrame, value: str, name: str) -> DataFrame:
    """Change against the directly preceding year, NULL without one.

    A self-join on year - 1 instead of a window: nothing is ordered and only
    equal keys meet.
    """
    before = df.select("ticker", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col(value).alias("_before"))
    joined = df.join(before, KEYS, "left")
    return joined.withColumn(
        name, F.try_divide((F.col(value) - F.col("_before")).cast("double"), F.col("_before").cast("double"))
    ).drop("_before")


def latest_listing(df: DataFrame) -> DataFrame:
    """The newest row of each ticker, for pickers and listings."""
    return pick_first(df, ["ticker"], [-F.col("fiscal_year")])


def company_list(df: DataFrame) -> DataFrame:
    """Distinct companies by ticker, sorted by name."""
    rows = pick_first(df.select("ticker", "company_name", "fiscal_year"), ["ticker"], [F.col("fiscal_year")])
    return rows.select("ticker", "company_name").orderBy("company_name", "ticker")


# --- quality --------------------------------------------------------------------------------


def quality_report(panel: DataFrame, ratings: DataFrame, articles: DataFrame) -> DataFrame:
    """Rows breaking each rule: keys, rating letters, rating dates, article dates."""
    per_rule = [
        ("panel_key_missing", panel, F.col("ticker").isNull() | F.col("fiscal_year").isNull()),
        ("rating_unknown", ratings, ~is_known_rating(F.col("rating"))),
        ("rating_after_fiscal_year", ratings, F.year("rating_date") > F.col("fiscal_year")),
        ("article_outside_fiscal_year", articles, F.year("published_at") != F.col("fiscal_year")),
    ]
    out = None
    for rule, df, broken in per_rule:
        row = df.agg(
            F.lit(rule).alias("rule"),
            F.count(F.when(broken, 1)).alias("violations"),
            F.count(F.lit(1)).alias("rows_checked"),
        )
        out = row if out is None else out.unionByName(row)
    return out
