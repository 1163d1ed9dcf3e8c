"""Queries that clean, align and merge the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.functions.cleaning import in_fiscal_year, to_date_dmy, to_number
from ratingloom.functions.ratings import rating_category
from ratingloom.functions.ratios import extended_ratios, first_line_item, mean_ratio_score
from ratingloom.operators import panel as P
from ratingloom.operators.news import aggregate_scores, finalise_news, news_on_panel
from ratingloom.operators.picking import pick_first
from ratingloom.operators.profiles import with_descriptions
from ratingloom.plans import roles as R
from ratingloom.plans.common import i8, ilist, longs, news_sql, r6, rlist, rounded, rounded_news
from ratingloom.plans.registry import query
from ratingloom.plans.roles import category_sql, with_roles

KEYS = P.KEYS
FLAG_LIST = ", ".join(V.FLAGS)


def panel_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios, preferred agency rating, news and flags, one row per key with a rating and statements.

    Line items are read once: ratios and flags come from the same aggregate.
    """
    facts = R.key_facts(spark, sf_dir)
    amounts = [(F.col(n) / F.lit(10000.0)).alias(n) for n in R.LINES]
    total = (R.total_of_lines() / F.lit(10000.0)).alias("total_assets")
    flag_source = [c for c in facts.columns if c not in KEYS and c not in R.LINES]
    both = R.with_ratios(facts.select(*KEYS, *amounts, total, *flag_source))
    flags = R.flag_expressions()
    with_flags = both.select(*KEYS, *V.RATIOS, *[v.cast("int").alias(n) for n, v in flags.items()])
    ratings = R.rating_rows(spark, sf_dir).select(*KEYS, "rating_agency", "rating", "rating_date", "rating_id")
    picked = P.dedupe_by_agency(ratings, [F.col("rating_agency"), F.col("rating")]).select(*KEYS, "rating_agency", "rating")
    news = aggregate_scores(R.articles(spark, sf_dir))
    joined = picked.join(with_flags, KEYS)
    covered = joined.join(news, KEYS, "left").withColumns(
        {"news_count": F.coalesce("news_count", F.lit(0)), "has_news_coverage": (F.coalesce("news_count", F.lit(0)) > 0).cast("int")}
    )
    return covered.withColumn("rating_category", rating_category(F.col("rating")))


_THREE_WAY = with_roles(
    ["picked", "flags", "news"],
    f"""SELECT p.ticker, p.fiscal_year, p.rating, {category_sql("p.rating")} AS rating_category, {rlist(V.RATIOS, "p.")},
  {news_sql("n.")}, {i8("coalesce(n.news_count, 0)", "news_count")},
  {i8("CASE WHEN n.news_count > 0 THEN 1 ELSE 0 END", "has_news_coverage")}, {ilist(V.FLAGS, "f.")}
FROM picked p JOIN flags f ON p.ticker = f.ticker AND p.fiscal_year = f.fiscal_year
LEFT JOIN news n ON p.ticker = n.ticker AND p.fiscal_year = n.fiscal_year""",
)


@query("panel_three_way", _THREE_WAY)
def panel_three_way(spark, sf):
    out = panel_frame(spark, sf).drop("rating_agency")
    return longs(rounded_news(rounded(out, V.RATIOS)), ["news_count", "has_news_coverage", *V.FLAGS])


@query(
    "ratios",
    with_roles(["ratios"], f"SELECT ticker, fiscal_year, {rlist(V.RATIOS)}, {r6('(liquid + cumprof + profitab) / 3', 'mean_score')} FROM ratios"),
)
def ratios(spark, sf):
    out = R.with_ratios(R.statements(spark, sf))
    out = out.withColumn("mean_score", mean_ratio_score(F.col("liquid"), F.col("cumprof"), F.col("profitab")))
    return rounded(out.select(*KEYS, *V.RATIOS, "mean_score"), [*V.RATIOS, "mean_score"])


_EXTENDED_SQL = {
    "current_ratio": ("current_assets", "current_liabilities"),
    "quick_ratio": ("current_assets - ebit", "current_liabilities"),
    "debt_to_equity": ("total_liabilities", "total_equity"),
    "debt_to_assets": ("total_liabilities", "total_assets"),
    "interest_coverage": ("ebit", "current_liabilities"),
    "debt_service_coverage": ("retained_earnings", "total_liabilities"),
    "return_on_assets": ("retained_earnings", "total_assets"),
    "return_on_equity": ("retained_earnings", "total_equity"),
    "net_margin": ("retained_earnings", "current_assets"),
    "operating_margin": ("ebit", "current_assets"),
    "asset_turnover": ("current_assets", "total_assets"),
}


@query(
    "extended_ratios",
    with_roles(
        ["statements"],
        "SELECT ticker, fiscal_year, "
        + ", ".join(r6(f"CASE WHEN {b} <> 0 THEN ({a}) / {b} END", n) for n, (a, b) in _EXTENDED_SQL.items())
        + " FROM statements",
    ),
)
def extended_ratio_set(spark, sf):
    c = F.col
    stand_in = {
        "inventory": c("ebit"), "total_debt": c("total_liabilities"), "interest_expense": c("current_liabilities"),
        "operating_cash_flow": c("retained_earnings"), "total_debt_service": c("total_liabilities"),
        "net_income": c("retained_earnings"), "revenue": c("current_assets"), "operating_income": c("ebit"),
    }
    wide = R.statements(spark, sf).withColumns(stand_in)
    values = extended_ratios()
    return rounded(wide.select(*KEYS, *[v.alias(n) for n, v in values.items()]), list(values))


# Each line is reported under the alias of its order's status, so a key can have several.
_ALIAS_STATUS = {"F": 0, "O": 1, "P": 2}


def _alias_case_sql() -> str:
    parts = []
    for name, code in R.LINES.items():
        aliases = V.LINE_ITEM_ALIASES[name]
        for status, i in _ALIAS_STATUS.items():
            parts.append(f"WHEN l_returnflag || l_linestatus = '{code}' AND o_orderstatus = '{status}' THEN '{aliases[min(i, len(aliases) - 1)]}'")
    return "CASE " + " ".join(parts) + " END"


def _first_sql(name: str) -> str:
    picks = ", ".join(f"max(CASE WHEN item = '{a}' THEN value END)" for a in V.LINE_ITEM_ALIASES[name])
    return r6(f"coalesce({picks}) / 10000.0::DOUBLE", name, 4) if name != "total_assets" else ""


@query(
    "first_item",
    f"""WITH lines AS (SELECT CAST(o_custkey AS VARCHAR) || '.SR' AS ticker, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
  {_alias_case_sql()} AS item, CAST(sum({R._CENTS}) AS BIGINT) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)
SELECT ticker, fiscal_year, {", ".join(_first_sql(n) for n in R.LINES)} FROM lines GROUP BY 1, 2""",
)
def first_item(spark, sf):
    item, orders = R.table(spark, sf, "lineitem"), R.table(spark, sf, "orders")
    item = item.select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("kind"), R.line_amount().alias("cents"))
    per_order = item.groupBy("l_orderkey", "kind").agg(F.sum("cents").alias("cents"))
    sums = per_order.join(orders, per_order["l_orderkey"] == orders["o_orderkey"]).groupBy(
        "o_custkey", F.year("o_orderdate").alias("fiscal_year"), "kind", "o_orderstatus"
    ).agg((F.sum("cents") / F.lit(10000.0)).alias("value"))
    names = {}
    for line, code in R.LINES.items():
        aliases = V.LINE_ITEM_ALIASES[line]
        for status, i in _ALIAS_STATUS.items():
            names[code + status] = aliases[min(i, len(aliases) - 1)]
    alias = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    lines = sums.groupBy("o_custkey", "fiscal_year", alias[F.concat("kind", "o_orderstatus")].alias("item")).agg(F.sum("value").alias("value"))
    # at most one entry per alias name and key
    maps = lines.groupBy("o_custkey", "fiscal_year").agg(F.map_from_entries(F.collect_list(F.struct("item", "value"))).alias("lines"))
    named = [first_line_item(F.col("lines"), n).alias(n) for n in R.LINES]
    return rounded(maps.select(R.ticker_of(F.col("o_custkey")).alias("ticker"), "fiscal_year", *named), list(R.LINES), 4)


@query(
    "agency_dedupe",
    with_roles(["picked"], "SELECT ticker, fiscal_year, rating_agency, rating, CAST(rating_date AS VARCHAR) AS rating_date, rating_id FROM picked"),
)
def agency_dedupe(spark, sf):
    rows = R.rating_rows(spark, sf)
    out = P.dedupe_by_agency(rows, [F.col("rating_agency"), F.col("rating")])
    return out.select(*KEYS, "rating_agency", "rating", F.col("rating_date").cast("string").alias("rating_date"), "rating_id")


@query(
    "plain_dedupe",
    with_roles(
        ["rating_rows"],
        """SELECT ticker, fiscal_year, rating_agency, rating, rating_id FROM
  (SELECT *, row_number() OVER (PARTITION BY ticker, fiscal_year ORDER BY rating_id) AS rn FROM rating_rows) WHERE rn = 1""",
    ),
)
def plain_dedupe(spark, sf):
    rows = R.rating_rows(spark, sf)
    return pick_first(rows, KEYS, [F.col("rating_id")]).select(*KEYS, "rating_agency", "rating", "rating_id")


@query(
    "fiscal_pick",
    """WITH p AS (SELECT CAST(o_custkey AS VARCHAR) || '.SR' AS ticker, last_day(CAST(o_orderdate AS DATE)) AS period_end,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS amount FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker, year(period_end)
  ORDER BY CASE WHEN month(period_end) = 12 AND day(period_end) = 31 THEN 0 ELSE 1 END, period_end DESC) AS rn FROM p)
SELECT ticker, CAST(year(period_end) AS INTEGER) AS fiscal_year, CAST(period_end AS VARCHAR) AS period_end, amount FROM r WHERE rn = 1""",
)
def fiscal_pick(spark, sf):
    orders = R.table(spark, sf, "orders")
    periods = orders.groupBy(R.ticker_of(F.col("o_custkey")).alias("ticker"), F.last_day("o_orderdate").alias("period_end")).agg(
        F.sum(F.rint(F.col("o_totalprice") * 100).cast("long")).alias("amount")
    )
    picked = P.pick_period(periods, ["ticker"])
    return picked.select(*KEYS, F.col("period_end").cast("string").alias("period_end"), "amount")


@query(
    "align_panel",
    with_roles(
        ["panel_names", "picked"],
        f"""SELECT n.ticker, n.fiscal_year, p.rating_agency, p.rating, {rlist(V.RATIOS, "p.")}
FROM panel_names n LEFT JOIN picked p ON n.ticker = p.ticker AND n.fiscal_year = p.fiscal_year AND p.liquid IS NOT NULL""",
    ),
)
def align_panel(spark, sf):
    rows = R.agency_financials(spark, sf).where(F.col("liquid").isNotNull())
    order = [P.prefer_agency("rating_agency", V.PREFERRED_AGENCY), F.col("rating_agency"), F.col("rating")]
    out = P.align_to_panel(R.panel_names(spark, sf), rows, order)
    return rounded(out.select(*KEYS, "rating_agency", "rating", *V.RATIOS), V.RATIOS)


@query(
    "align_financials",
    with_roles(
        ["panel_names", "picked"],
        f"""SELECT n.ticker, n.company_name, coalesce(p.rating_agency, '') AS rating_agency, coalesce(p.rating, n.rating) AS rating,
  n.fiscal_year, {rlist(V.RATIOS, "p.")}, {i8('''coalesce(p.binary_target, CASE WHEN coalesce(p.rating, n.rating) IS NULL THEN 0
    WHEN starts_with(coalesce(p.rating, n.rating), 'A') OR starts_with(coalesce(p.rating, n.rating), 'BBB') THEN 0 ELSE 1 END)''', "binary_target")}
FROM panel_names n LEFT JOIN picked p ON n.ticker = p.ticker AND n.fiscal_year = p.fiscal_year""",
    ),
)
def align_financials(spark, sf):
    out = P.align_financials(R.panel_names(spark, sf), R.agency_financials(spark, sf))
    return longs(rounded(out, V.RATIOS), ["binary_target"])


@query(
    "training_frame",
    with_roles(
        ["picked", "news", "panel"],
        f"""SELECT p.ticker, p.fiscal_year, p.rating, {category_sql("p.rating")} AS rating_category, {rlist(V.RATIOS, "p.")},
  {news_sql("n.", "0")}, {r6("coalesce(n.news_count, 0)", "news_count")}, {i8("CASE WHEN n.news_count > 0 THEN 1 ELSE 0 END", "has_news_coverage")},
  {", ".join(i8(f"coalesce(f.{c}, 0)", c) for c in V.FLAGS)}
FROM picked p JOIN panel f ON p.ticker = f.ticker AND p.fiscal_year = f.fiscal_year
LEFT JOIN news n ON p.ticker = n.ticker AND p.fiscal_year = n.fiscal_year
WHERE p.liquid IS NOT NULL AND p.cumprof IS NOT NULL AND p.profitab IS NOT NULL AND p.leverage IS NOT NULL""",
    ),
)
def training_frame(spark, sf):
    facts = R.stored_facts(spark, sf)
    panel = R.panel(spark, sf, facts)
    fin = P.dedupe_by_agency(R.agency_financials(spark, sf, facts), [F.col("rating_agency"), F.col("rating")])
    news = news_on_panel(panel, aggregate_scores(R.articles(spark, sf)))
    out = P.training_frame(fin, news, panel).drop("rating_agency")
    return longs(rounded_news(rounded(out, V.RATIOS)), ["has_news_coverage", *V.FLAGS])


@query(
    "join_sources",
    with_roles(
        ["picked", "panel", "news"],
        f"""SELECT p.ticker, p.fiscal_year, p.rating, coalesce(nullif(trim(p.rating_agency), ''), 'Tassnief') AS rating_agency,
  '' AS sector, f.company_name, {rlist(V.RATIOS, "p.")}, {news_sql("n.")}, {i8("n.news_count", "news_count")}, {ilist(V.KAM_FIVE, "f.")}
FROM picked p JOIN panel f ON p.ticker = f.ticker AND p.fiscal_year = f.fiscal_year
JOIN news n ON p.ticker = n.ticker AND p.fiscal_year = n.fiscal_year""",
    ),
)
def join_sources(spark, sf):
    facts = R.stored_facts(spark, sf)
    fin = P.dedupe_by_agency(R.agency_financials(spark, sf, facts), [F.col("rating_agency"), F.col("rating")])
    news = finalise_news(aggregate_scores(R.articles(spark, sf))).drop("has_news_coverage")
    out = P.join_sources(fin, R.panel(spark, sf, facts), news)
    out = out.select(*KEYS, "rating", "rating_agency", "sector", "company_name", *V.RATIOS, *V.NEWS_FEATURES, *V.KAM_FIVE)
    return longs(rounded_news(rounded(out, V.RATIOS)), ["news_count", *V.KAM_FIVE])


@query(
    "renamed_year_join",
    with_roles(
        ["picked", "panel"],
        f"""SELECT p.ticker, p.fiscal_year, f.fiscal_year AS fiscal_year_kam, f.rating, {rlist(V.RATIOS, "p.")}, {ilist(V.FLAGS, "f.")}
FROM picked p JOIN panel f ON p.ticker = f.ticker AND p.fiscal_year = f.fiscal_year""",
    ),
)
def renamed_year_join(spark, sf):
    out = P.join_on_renamed_year(R.panel(spark, sf), None, R.agency_financials(spark, sf))
    out = out.select(*KEYS, "fiscal_year_kam", "rating", *V.RATIOS, *V.FLAGS)
    return longs(rounded(out, V.RATIOS), V.FLAGS)


@query(
    "renamed_year_join_ratios",
    with_roles(
        ["ratios", "panel"],
        f"""SELECT r.ticker, r.fiscal_year, f.fiscal_year AS fiscal_year_kam, {rlist(V.RATIOS, "r.")}, {ilist(V.FLAGS, "f.")}
FROM ratios r JOIN panel f ON r.ticker = f.ticker AND r.fiscal_year = f.fiscal_year""",
    ),
)
def renamed_year_join_ratios(spark, sf):
    """The same with the ratio table, which is preferred where there is one."""
    source = R.with_ratios(R.statements(spark, sf)).select(*KEYS, *V.RATIOS)
    out = P.join_on_renamed_year(R.panel(spark, sf), source, R.agency_financials(spark, sf))
    return longs(rounded(out.select(*KEYS, "fiscal_year_kam", *V.RATIOS, *V.FLAGS), V.RATIOS), V.FLAGS)


# The base has the keys with a final order; supplement rows come from pending ones,
# so some have no base row. Figures are missing by priority.
_SUPPLEMENT_SQL = """
base AS (SELECT r.ticker, r.fiscal_year, r.liquid, r.cumprof, r.profitab, r.leverage, r.total_assets, r.total_liabilities, r.total_equity
  FROM ratios r JOIN (SELECT DISTINCT ticker, fiscal_year FROM rating_rows WHERE status = 'F') k
  ON r.ticker = k.ticker AND r.fiscal_year = k.fiscal_year),
sup AS (SELECT ticker, fiscal_year, rating_id,
  CASE WHEN trim(rating_agency) <> 'SP' THEN amount * 3 END AS total_assets,
  CASE WHEN trim(rating_agency) <> 'Fitch' THEN amount END AS total_liabilities,
  amount * 2 AS total_equity, amount / 2 AS current_assets, amount / 4 AS current_liabilities,
  CASE WHEN trim(rating_agency) <> 'Moodys' THEN amount / 5 END AS retained_earnings,
  CASE WHEN trim(rating_agency) <> 'Tassnief' THEN amount / 8 END AS operating_profit,
  CASE WHEN trim(rating_agency) = 'Tassnief' THEN amount / 10 END AS ebit,
  CASE WHEN trim(rating_agency) <> 'SP' THEN fiscal_year || '-12-31' ELSE ' ' END AS statement_period_end
  FROM rating_rows WHERE status = 'P'),
upd AS (SELECT *, (current_assets - current_liabilities) / total_assets AS liquid, retained_earnings / total_assets AS cumprof,
  coalesce(operating_profit, ebit) / total_assets AS profitab, total_equity / total_liabilities AS leverage FROM sup)"""


def _base_and_supplement(spark, sf) -> tuple[DataFrame, DataFrame]:
    c = F.col
    rows = R.rating_rows(spark, sf)
    final = rows.where(c("status") == "F").select(*KEYS).distinct()
    base = R.with_ratios(R.statements(spark, sf)).select(*KEYS, *V.RATIOS, "total_assets", "total_liabilities", "total_equity").join(final, KEYS)
    agency, amount = F.trim("rating_agency"), c("amount")
    supplement = rows.where(c("status") == "P").select(
        *KEYS, "rating_id",
        F.when(agency != "SP", amount * 3).alias("total_assets"),
        F.when(agency != "Fitch", amount).alias("total_liabilities"),
        (amount * 2).alias("total_equity"), (amount / 2).alias("current_assets"), (amount / 4).alias("current_liabilities"),
        F.when(agency != "Moodys", amount / 5).alias("retained_earnings"),
        F.when(agency != "Tassnief", amount / 8).alias("operating_profit"),
        F.when(agency == "Tassnief", amount / 10).alias("ebit"),
        F.when(agency != "SP", F.concat(c("fiscal_year").cast("string"), F.lit("-12-31"))).otherwise(" ").alias("statement_period_end"),
    )
    return base, supplement


_SUP_COLUMNS = [*V.RATIOS, "total_assets", "total_liabilities", "total_equity"]


@query(
    "supplement_merge",
    with_roles(
        ["ratios", "rating_rows"],
        "WITH " + _SUPPLEMENT_SQL.strip()
        + ", last AS (SELECT ticker, fiscal_year, "
        + ", ".join(f"arg_max({c}, rating_id) FILTER ({c} IS NOT NULL) AS {c}" for c in _SUP_COLUMNS)
        + ", arg_max(trim(statement_period_end), rating_id) FILTER (trim(statement_period_end) <> '') AS statement_period_end FROM upd GROUP BY 1, 2)\n"
        + "SELECT b.ticker, b.fiscal_year, "
        + ", ".join(r6(f"coalesce(l.{c}, b.{c})", c, 4) for c in _SUP_COLUMNS)
        + ", l.statement_period_end FROM base b LEFT JOIN last l ON b.ticker = l.ticker AND b.fiscal_year = l.fiscal_year",
    ),
)
def supplement_merge(spark, sf):
    base, supplement = _base_and_supplement(spark, sf)
    out = P.merge_supplement(base, supplement, "rating_id")
    return rounded(out.select(*KEYS, *_SUP_COLUMNS, "statement_period_end"), _SUP_COLUMNS, 4)


@query(
    "supplement_unmatched",
    with_roles(
        ["ratios", "rating_rows"],
        "WITH " + _SUPPLEMENT_SQL.strip()
        + "\nSELECT s.ticker, s.fiscal_year, s.rating_id FROM sup s WHERE NOT EXISTS "
        "(SELECT 1 FROM base b WHERE b.ticker = s.ticker AND b.fiscal_year = s.fiscal_year)",
    ),
)
def supplement_unmatched(spark, sf):
    base, supplement = _base_and_supplement(spark, sf)
    return P.unmatched_supplement(base, supplement).select(*KEYS, "rating_id")


# Base: keys with a final order and their old values. Refresh: keys with an open order.
@query(
    "upsert_financials",
    with_roles(
        ["ratios", "rating_rows", "panel_names"],
        f"""WITH fin AS (SELECT DISTINCT ticker, fiscal_year FROM rating_rows WHERE status = 'F'),
opn AS (SELECT DISTINCT ticker, fiscal_year FROM rating_rows WHERE status = 'O'),
base AS (SELECT n.ticker, n.fiscal_year, n.company_name, n.rating FROM panel_names n JOIN fin USING (ticker, fiscal_year)),
fresh AS (SELECT n.ticker, n.fiscal_year, n.company_name, n.rating, r.liquid, r.cumprof, r.profitab, r.leverage, r.total_assets
  FROM panel_names n JOIN opn USING (ticker, fiscal_year) LEFT JOIN ratios r ON r.ticker = n.ticker AND r.fiscal_year = n.fiscal_year)
SELECT coalesce(b.ticker, f.ticker) AS ticker, coalesce(b.fiscal_year, f.fiscal_year) AS fiscal_year,
  CASE WHEN b.ticker IS NOT NULL THEN b.company_name ELSE f.company_name END AS company_name,
  CASE WHEN b.ticker IS NOT NULL THEN b.rating ELSE f.rating END AS rating, {rlist(V.RATIOS, "f.")}, {r6("f.total_assets", "total_assets", 4)}
FROM base b FULL JOIN fresh f ON b.ticker = f.ticker AND b.fiscal_year = f.fiscal_year""",
    ),
)
def upsert_financials(spark, sf):
    rows, names = R.rating_rows(spark, sf), R.panel_names(spark, sf)
    of_status = lambda s: rows.where(F.col("status") == s).select(*KEYS).distinct()
    values = R.with_ratios(R.statements(spark, sf)).select(*KEYS, *V.RATIOS, "total_assets")
    base = names.join(of_status("F"), KEYS).join(values.select(*KEYS, (F.col("liquid") * 0).alias("liquid")), KEYS, "left")
    fresh = names.join(of_status("O"), KEYS).join(values, KEYS, "left")
    out = P.upsert_refreshed(base, fresh).select(*KEYS, "company_name", "rating", *V.RATIOS, "total_assets")
    return rounded(rounded(out, V.RATIOS), ["total_assets"], 4)


@query(
    "rating_date_lookup",
    with_roles(
        ["panel_names", "rating_rows"],
        """SELECT n.ticker, n.fiscal_year, coalesce(CAST(d.rating_date AS VARCHAR), '') AS rating_date FROM panel_names n
LEFT JOIN (SELECT ticker, fiscal_year, arg_min(rating_date, rating_id) AS rating_date FROM rating_rows WHERE status <> 'P' GROUP BY 1, 2) d
  ON n.ticker = d.ticker AND n.fiscal_year = d.fiscal_year""",
    ),
)
def rating_date_lookup(spark, sf):
    rated = R.rating_rows(spark, sf).where(F.col("status") != "P")
    out = P.with_first_rating_date(R.panel_names(spark, sf), rated, [F.col("rating_id")])
    return out.select(*KEYS, "rating_date")


@query(
    "latest_rating_asof",
    with_roles(
        ["panel_names", "rating_rows"],
        """SELECT n.ticker, n.fiscal_year, x.rating, CAST(x.rating_date AS VARCHAR) AS rating_date FROM panel_names n LEFT JOIN LATERAL
  (SELECT rating, rating_date FROM rating_rows r WHERE status <> 'P' AND r.ticker = n.ticker AND year(r.rating_date) <= n.fiscal_year
   ORDER BY rating_date DESC, rating DESC NULLS LAST LIMIT 1) x ON TRUE""",
    ),
)
def latest_rating_asof(spark, sf):
    rated = R.rating_rows(spark, sf).where(F.col("status") != "P")
    out = P.attach_latest_rating(R.panel_names(spark, sf), rated)
    return out.withColumn("rating_date", F.col("rating_date").cast("string"))


@query(
    "revenue_growth",
    with_roles(
        ["statements"],
        f"""SELECT s.ticker, s.fiscal_year, {r6("CASE WHEN p.total_assets <> 0 THEN (s.total_assets - p.total_assets) / p.total_assets END", "revenue_growth")}
FROM statements s LEFT JOIN statements p ON p.ticker = s.ticker AND p.fiscal_year = s.fiscal_year - 1""",
    ),
)
def revenue_growth(spark, sf):
    totals = R.statements(spark, sf).select(*KEYS, "total_assets")
    return rounded(P.growth(totals, "total_assets", "revenue_growth").drop("total_assets"), ["revenue_growth"])


@query(
    "latest_listing",
    with_roles(
        ["panel_names"],
        """SELECT ticker, fiscal_year, company_name, rating FROM
  (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) AS rn FROM panel_names) WHERE rn = 1""",
    ),
)
def latest_listing(spark, sf):
    return P.latest_listing(R.panel_names(spark, sf)).select(*KEYS, "company_name", "rating")


@query("company_list", with_roles(["panel_names"], "SELECT DISTINCT ticker, company_name FROM panel_names ORDER BY company_name, ticker"))
def company_list(spark, sf):
    return P.company_list(R.panel_names(spark, sf))


# --- cleaning -------------------------------------------------------------------------------

_YEAR_TEXT_SQL = """CASE o_orderstatus WHEN 'F' THEN year(o_orderdate) || '.0' WHEN 'O' THEN ' ' || year(o_orderdate)
  ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'abc' WHEN o_orderpriority = '1-URGENT' THEN '' ELSE CAST(year(o_orderdate) AS VARCHAR) END END"""


def _year_text():
    year = F.year("o_orderdate").cast("string")
    other = F.when(F.col("o_orderpriority") == "5-LOW", "abc").when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(year)
    status = F.col("o_orderstatus")
    return F.when(status == "F", F.concat(year, F.lit(".0"))).when(status == "O", F.concat(F.lit(" "), year)).otherwise(other)


@query(
    "year_coercion",
    f"""SELECT CAST(o_custkey AS VARCHAR) || '.SR' AS ticker, CAST(TRY_CAST(trim({_YEAR_TEXT_SQL}) AS DOUBLE) AS INTEGER) AS fiscal_year, o_orderkey
FROM orders WHERE TRY_CAST(trim({_YEAR_TEXT_SQL}) AS DOUBLE) IS NOT NULL""",
)
def year_coercion(spark, sf):
    raw = R.table(spark, sf, "orders").select(F.concat(F.lit("  "), R.ticker_of(F.col("o_custkey"))).alias("ticker"), _year_text().alias("fiscal_year"), "o_orderkey")
    return P.clean_keys(raw)


@query(
    "flag_coercion",
    with_roles(
        ["panel"],
        f"""SELECT ticker, company_name, fiscal_year, rating, {", ".join(i8(f"coalesce({c}, 0)", c) if c not in ("GCUP", "FIRMSIZE") else i8("0", c) for c in V.FLAGS)} FROM panel""",
    ),
)
def flag_coercion(spark, sf):
    raw = R.panel(spark, sf).drop("GCUP", "FIRMSIZE")  # two columns missing from the file
    text = raw.withColumns({c: F.coalesce(F.format_string("%d.0", F.col(c)), F.lit("n/a")) for c in V.FLAGS if c in raw.columns})
    return longs(P.build_panel(text), V.FLAGS)


@query(
    "financial_contract",
    with_roles(
        ["picked"],
        f"""SELECT ticker, CAST(rating_date AS VARCHAR) AS rating_date, rating, fiscal_year, {rlist(V.RATIOS)} FROM picked""",
    ),
)
def financial_contract(spark, sf):
    fin = P.dedupe_by_agency(R.agency_financials(spark, sf), [F.col("rating_agency"), F.col("rating")])
    wide = fin.withColumns({"outlook": F.lit("stable"), "rating_action": F.lit(""), "data_available": F.lit(1), "rating_date": F.col("rating_date").cast("string")})
    return rounded(P.financial_columns(wide), V.RATIOS)


@query(
    "safe_numbers",
    """SELECT event_id, round(TRY_CAST(CASE event_type WHEN 'error' THEN 'NaN' WHEN 'view' THEN value || 'd' WHEN 'click' THEN '' ELSE CAST(value AS VARCHAR) END AS DOUBLE), 6) AS number
FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, NULL FROM events WHERE event_type = 'error'""",
)
def safe_numbers(spark, sf):
    kind, value = F.col("event_type"), F.col("value").cast("string")
    text = F.when(kind == "error", "NaN").when(kind == "view", F.concat(value, F.lit("d"))).when(kind == "click", "").otherwise(value)
    return R.table(spark, sf, "events").select("event_id", F.round(to_number(text), 6).alias("number"))


@query(
    "sector_and_agency",
    with_roles(
        ["rating_rows", "issuers"],
        """SELECT r.rating_id, r.ticker, r.fiscal_year, CASE WHEN status = 'P' THEN 'Tassnief' ELSE trim(rating_agency) END AS rating_agency,
  coalesce(i.sector, '') AS sector FROM rating_rows r LEFT JOIN issuers i ON i.ticker = r.ticker AND r.status <> 'F'""",
    ),
)
def sector_and_agency(spark, sf):
    rows = R.rating_rows(spark, sf)
    agency = F.when(F.col("status") == "P", " ").otherwise(F.col("rating_agency"))
    names = R.issuers(spark, sf).select("ticker", F.col("sector").alias("yfinance_sector"))
    joined = rows.withColumn("rating_agency", agency).join(names, "ticker", "left")
    joined = joined.withColumn("yfinance_sector", F.when(F.col("status") != "F", F.col("yfinance_sector")))
    return P.with_sector_and_agency(joined).select("rating_id", *KEYS, "rating_agency", "sector")


@query(
    "feature_labels",
    with_roles(
        ["flags"],
        "SELECT feature, CASE feature "
        + " ".join(f"WHEN '{c}' THEN '{V.FEATURE_LABELS[c]}'" for c in V.FLAGS)
        + f" END AS description, total FROM (UNPIVOT (SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in V.FLAGS)} FROM flags) ON {FLAG_LIST} INTO NAME feature VALUE total)",
    ),
)
def feature_labels(spark, sf):
    sums = R.flags(spark, sf).agg(*[F.sum(c).alias(c) for c in V.FLAGS])
    return with_descriptions(sums.unpivot([], V.FLAGS, "feature", "total"))


@query(
    "quality_report",
    with_roles(
        ["panel_names", "rating_rows", "articles"],
        """SELECT 'panel_key_missing' AS rule, count(*) FILTER (ticker IS NULL OR fiscal_year IS NULL) AS violations, count(*) AS rows_checked FROM panel_names
UNION ALL SELECT 'rating_unknown', count(*) FILTER (rating IS NULL), count(*) FROM rating_rows
UNION ALL SELECT 'rating_after_fiscal_year', count(*) FILTER (year(rating_date) > fiscal_year), count(*) FROM rating_rows
UNION ALL SELECT 'article_outside_fiscal_year', count(*) FILTER (year(ts) <> fiscal_year), count(*) FROM articles""",
    ),
)
def quality_report(spark, sf):
    news = R.articles(spark, sf).withColumn("published_at", F.col("ts"))
    return P.quality_report(R.panel_names(spark, sf), R.rating_rows(spark, sf), news)


@query(
    "date_parsing",
    with_roles(
        ["rating_rows"],
        """SELECT rating_id, CASE WHEN status <> 'P' THEN CAST(rating_date AS VARCHAR) END AS rating_date,
  CASE WHEN status <> 'P' THEN CAST(year(rating_date) AS INTEGER) END AS rating_year,
  CASE WHEN status <> 'P' THEN CAST(year(rating_date) = 1998 AS INTEGER) END AS in_1998 FROM rating_rows""",
    ),
)
def date_parsing(spark, sf):
    written = F.when(F.col("status") != "P", F.date_format("rating_date", "dd/MM/yyyy")).otherwise("31/02/abcd")
    rows = R.rating_rows(spark, sf).select("rating_id", to_date_dmy(written).alias("d"))
    return rows.select(
        "rating_id", F.col("d").cast("string").alias("rating_date"), F.year("d").alias("rating_year"),
        in_fiscal_year(F.col("d"), F.lit(1998)).cast("int").alias("in_1998"),
    )
