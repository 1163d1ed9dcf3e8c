"""Declared schemas of the input tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from ratingloom import fixed_values as V


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


STRING, INT, DOUBLE = T.StringType(), T.IntegerType(), T.DoubleType()

# CSV years arrive as text ("2023.0", "", "abc") and are coerced after the read.
PANEL = _struct(
    ticker=STRING, company_name=STRING, fiscal_year=STRING, rating=STRING, **{c: STRING for c in V.FLAGS}
)
FINANCIALS = _struct(
    ticker=STRING, company_name=STRING, rating_agency=STRING, rating=STRING, fiscal_year=STRING,
    **{c: DOUBLE for c in V.RATIOS}, binary_target=INT,
)
NEWS_FEATURE_TABLE = _struct(
    ticker=STRING, fiscal_year=STRING, **{c: DOUBLE for c in V.SENTIMENTS}, news_count=INT, has_news_coverage=INT
)
AGENCY_WIDE = _struct(
    ticker=STRING, company_name=STRING, sector=STRING, **{c: STRING for c in V.AGENCY_COLUMNS}, source=STRING
)
SCRAPED_RATINGS = _struct(
    ticker=STRING, company_name=STRING, rating_date=STRING, rating=STRING, outlook=STRING, rating_type=STRING,
    is_solicited=STRING, rating_basis=STRING, fiscal_year_applicable=STRING, source_url=STRING,
    pdf_link=STRING, rating_action=STRING,
)
SUPPLEMENT = _struct(
    ticker=STRING, fiscal_year=STRING, total_assets=DOUBLE, total_liabilities=DOUBLE, total_equity=DOUBLE,
    current_assets=DOUBLE, current_liabilities=DOUBLE, retained_earnings=DOUBLE, operating_profit=DOUBLE,
    statement_period_end=STRING, yfinance_sector=STRING, yfinance_industry=STRING, source_url=STRING, notes=STRING,
)

_LINES = T.MapType(STRING, T.MapType(STRING, DOUBLE))
STATEMENT_DOCUMENT = _struct(
    ticker=STRING, fetch_date=STRING, company_name=STRING, sector=STRING, industry=STRING,
    balance_sheet=_LINES, income_statement=_LINES, cashflow=_LINES,
)
ARTICLE = _struct(
    ticker=STRING, title=STRING, description=STRING, snippet=STRING, published_at=STRING, source_name=STRING,
    url=STRING, search_term=STRING, sentiment_compound=DOUBLE, sentiment_pos=DOUBLE, sentiment_neg=DOUBLE,
    sentiment_neu=DOUBLE,
)
NEWS_DOCUMENT = _struct(
    ticker=STRING, year=INT, fetch_date=STRING, article_count=INT, articles=T.ArrayType(ARTICLE)
)
SFT_RECORD = _struct(instruction=STRING, input=STRING, output=STRING)
