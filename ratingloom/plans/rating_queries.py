"""Queries on entities, agency ratings and descriptive profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.functions import ratings as RT
from ratingloom.operators import agencies as A
from ratingloom.operators import entities as E
from ratingloom.operators import profiles as PR
from ratingloom.operators.panel import KEYS
from ratingloom.plans import roles as R
from ratingloom.plans.common import i8, longs, r6, rounded
from ratingloom.plans.panel_queries import panel_frame
from ratingloom.plans.registry import query
from ratingloom.plans.roles import category_sql, letter_sql, notch_sql, with_roles


# --- entities -------------------------------------------------------------------------------


def _financial_sql(ticker: str, sector: str, industry: str, name: str) -> str:
    industries = " OR ".join(f"contains(lower({industry}), '{p}')" for p in V.FINANCIAL_INDUSTRY_PARTS)
    names = " OR ".join(f"contains(lower({name}), '{p}')" for p in V.FINANCIAL_NAME_PARTS)
    tickers = ", ".join(f"'{t}'" for t in V.FINANCIAL_TICKERS)
    return f"({ticker} IN ({tickers}) OR lower(trim({sector})) = 'financial services' OR {industries} OR {names})"


@query(
    "entity_flags",
    with_roles(
        ["issuers"],
        f"SELECT ticker, company_name, CASE WHEN {_financial_sql('ticker', 'sector', 'industry', 'company_name')} THEN 1 ELSE 0 END AS is_financial FROM issuers",
    ),
)
def entity_flags(spark, sf):
    c = F.col
    flagged = E.is_financial(c("ticker"), c("sector"), c("industry"), c("company_name"))
    return R.issuers(spark, sf).select("ticker", "company_name", flagged.cast("int").alias("is_financial"))


def _rated(spark, sf):
    """Rating rows with name, sector and industry partly blank, for issuers not in one segment only."""
    names = R.issuers(spark, sf)
    rows = R.rating_rows(spark, sf).where(F.col("rating_agency") != "SP").join(names, "ticker")
    agency = F.col("rating_agency")
    return rows.withColumns(
        {
            "company_name": F.when(F.col("status") != "P", F.col("company_name")),
            "sector": F.when(agency == "Financial Analytics", " ").otherwise(F.col("sector")),
            "industry": F.when(agency != "Moodys", F.col("industry")),
        }
    )


_ENTITY_CTES = f"""rated AS (SELECT r.ticker, r.fiscal_year, r.rating_id,
  CASE WHEN r.status <> 'P' THEN i.company_name END AS company_name,
  CASE WHEN r.rating_agency = 'Financial Analytics' THEN ' ' ELSE i.sector END AS sector,
  CASE WHEN r.rating_agency <> 'Moodys' THEN i.industry END AS industry
  FROM rating_rows r JOIN issuers i ON i.ticker = r.ticker WHERE r.rating_agency <> 'SP'),
pos AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC, rating_id) AS rn FROM rated),
stop AS (SELECT ticker, min(rn) FILTER (trim(coalesce(sector, '')) <> '') AS at_row FROM pos GROUP BY 1),
ent AS (SELECT p.ticker,
    coalesce(arg_min(trim(p.company_name), p.rn) FILTER (trim(coalesce(p.company_name, '')) <> '' AND (s.at_row IS NULL OR p.rn <= s.at_row)), '') AS company_name,
    coalesce(max(trim(p.sector)) FILTER (p.rn = s.at_row), '') AS sector, coalesce(max(trim(p.industry)) FILTER (p.rn = s.at_row), '') AS industry
  FROM pos p JOIN stop s ON s.ticker = p.ticker GROUP BY 1),
bad AS (SELECT ticker FROM ent WHERE {_financial_sql('ticker', 'sector', 'industry', 'company_name')}
  UNION SELECT n.ticker FROM panel_names n WHERE NOT EXISTS (SELECT 1 FROM ent e WHERE e.ticker = n.ticker)
    AND {_financial_sql('n.ticker', "''", "''", 'n.company_name')})"""


@query("rated_entities", with_roles(["rating_rows", "issuers", "panel_names"], "WITH " + _ENTITY_CTES + "\nSELECT ticker, company_name, sector, industry FROM ent"))
def rated_entities(spark, sf):
    return E.rated_entities(_rated(spark, sf), "rating_id")


@query(
    "entity_filter",
    with_roles(
        ["rating_rows", "issuers", "panel_names"],
        "WITH " + _ENTITY_CTES + "\nSELECT ticker, fiscal_year, company_name FROM panel_names n WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.ticker = n.ticker)",
    ),
)
def entity_filter(spark, sf):
    panel = R.panel_names(spark, sf)
    excluded = E.financial_tickers(_rated(spark, sf), panel, "rating_id")
    return E.drop_tickers(panel, excluded).select(*KEYS, "company_name")


# --- scalar maps ----------------------------------------------------------------------------


@query(
    "rating_maps",
    with_roles(
        ["rating_rows"],
        f"""SELECT rating_id, {category_sql("rating")} AS rating_category, {i8(notch_sql("rating"), "notch")},
  {i8("CASE WHEN rating IS NULL THEN 0 WHEN starts_with(rating, 'A') OR starts_with(rating, 'BBB') THEN 0 ELSE 1 END", "below_grade")},
  {i8(f"CASE WHEN coalesce({notch_sql('rating')}, 0) >= 15 THEN 0 ELSE 1 END", "below_a")},
  {i8(f"CASE WHEN {notch_sql('rating')} >= 12 THEN 1 WHEN {notch_sql('rating')} < 12 THEN 0 END", "investment_grade")},
  CASE WHEN {category_sql("rating")} = 'BB' THEN '{V.RISK_CLASS_SPECULATIVE}' ELSE '{V.RISK_CLASS_INVESTMENT}' END AS risk_class,
  CASE WHEN {notch_sql("rating")} >= 12 THEN 'Investment Grade' ELSE 'Speculative Grade' END AS risk_grade
FROM rating_rows""",
    ),
)
def rating_maps(spark, sf):
    r = F.col("rating")
    out = R.rating_rows(spark, sf).select(
        "rating_id",
        RT.rating_category(r).alias("rating_category"),
        RT.rating_notch(r).alias("notch"),
        RT.binary_below_investment_grade(r).alias("below_grade"),
        RT.binary_below_a(r).alias("below_a"),
        RT.binary_investment_grade(r).alias("investment_grade"),
        RT.risk_class(RT.rating_category(r)).alias("risk_class"),
        RT.risk_grade(r).alias("risk_grade"),
    )
    return longs(out, ["notch", "below_grade", "below_a", "investment_grade"])


@query(
    "scale_join",
    with_roles(["rating_rows"], f"SELECT rating, {i8(notch_sql('rating'), 'notch')}, count(*) AS ratings FROM rating_rows WHERE rating IS NOT NULL GROUP BY 1, 2"),
)
def scale_join(spark, sf):
    counted = R.rating_rows(spark, sf).groupBy("rating").agg(F.count(F.lit(1)).alias("ratings"))
    return longs(counted.join(RT.rating_scale(spark), "rating"), ["notch"])


# --- agencies -------------------------------------------------------------------------------

_AGENCY_OF = {"Moodys": "moodys", "Fitch": "fitch", "SP": "sp", "Tassnief": "tassnief", "Financial Analytics": "financial_analytics"}
_MOODYS = {v: k for k, v in V.MOODYS_TO_COMMON.items()}


def _wide(spark, sf):
    """One column per agency and key; Moody's on its own scale, some local ratings on a national one."""
    rows = R.rating_rows(spark, sf).withColumn("agency", F.trim("rating_agency"))
    own = F.create_map(*[F.lit(x) for k, v in _MOODYS.items() for x in (k, v)])
    local = F.col("agency") == "Financial Analytics"
    written = (
        F.when(F.col("agency") == "Moodys", F.coalesce(own[F.col("rating")], F.col("rating")))
        .when(local & (F.col("status") == "P"), F.concat("rating", F.lit(" (sau)")))
        .when(local & (F.col("status") == "O"), F.concat(F.lit("Ksa"), "rating"))
        .otherwise(F.col("rating"))
    )
    rows = rows.withColumn("written", written)
    aggs = [F.min(F.when(F.col("agency") == name, F.struct("rating_id", "written")))["written"].alias(c) for name, c in _AGENCY_OF.items()]
    return rows.groupBy(*KEYS).agg(*aggs)


_LONG_CTES = f"""cells AS (SELECT ticker, fiscal_year, trim(rating_agency) AS agency, rating, status,
    row_number() OVER (PARTITION BY ticker, fiscal_year, trim(rating_agency) ORDER BY rating_id) AS rn FROM rating_rows),
long AS (SELECT ticker, fiscal_year,
    CASE agency {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _AGENCY_OF.items())} END AS agency, rating, {notch_sql("rating")} AS notch
  FROM cells WHERE rn = 1 AND rating IS NOT NULL AND NOT (agency = 'Financial Analytics' AND status IN ('P', 'O')))"""


@query("agency_unpivot", with_roles(["rating_rows"], "WITH " + _LONG_CTES + f"\nSELECT ticker, fiscal_year, agency, rating, {i8('notch', 'notch')} FROM long"))
def agency_unpivot(spark, sf):
    return longs(A.unpivot_agencies(_wide(spark, sf), KEYS), ["notch"])


@query(
    "unknown_letters",
    with_roles(
        ["rating_rows"],
        "WITH " + _LONG_CTES + """
SELECT ticker, fiscal_year, 'moodys' AS agency, 'Caa1' AS given, 'Caa1' AS rating FROM cells WHERE rn = 1 AND rating IS NOT NULL AND agency = 'Moodys' AND fiscal_year % 3 = 0""",
    ),
)
def unknown_letters(spark, sf):
    """Ratings whose letter the common scale lacks, which consensus and disagreement leave out."""
    lowest = F.when(F.col("moodys").isNotNull() & (F.col("fiscal_year") % 3 == 0), "Caa1").otherwise(F.col("moodys"))
    return A.unknown_letters(_wide(spark, sf).withColumn("moodys", lowest), KEYS)


@query(
    "consensus_rating",
    with_roles(
        ["rating_rows"],
        "WITH " + _LONG_CTES + f"""
SELECT ticker, {r6("median(notch)", "median_notch")}, count(*) AS ratings, {letter_sql("CAST(floor(median(notch)) AS INTEGER)")} AS consensus FROM long GROUP BY 1""",
    ),
)
def consensus_rating(spark, sf):
    return rounded(A.consensus(A.unpivot_agencies(_wide(spark, sf), KEYS)), ["median_notch"])


@query(
    "agency_disagreement",
    with_roles(
        ["rating_rows"],
        "WITH " + _LONG_CTES + f"""
SELECT ticker, fiscal_year, {i8("max(notch) - min(notch)", "spread")}, {letter_sql("max(notch)")} AS best, {letter_sql("min(notch)")} AS worst,
  count(DISTINCT agency) AS agencies FROM long GROUP BY 1, 2""",
    ),
)
def agency_disagreement(spark, sf):
    return longs(A.disagreement(A.unpivot_agencies(_wide(spark, sf), KEYS), KEYS), ["spread"])


@query(
    "consolidated_sources",
    with_roles(
        ["rating_rows"],
        """SELECT ticker, fiscal_year, rating, rating_id, source_rank FROM (SELECT *, row_number() OVER
  (PARTITION BY ticker, fiscal_year ORDER BY source_rank, rating_id) AS rn
  FROM (SELECT *, CASE trim(rating_agency) WHEN 'Fitch' THEN 1 WHEN 'Tassnief' THEN 3 ELSE 2 END AS source_rank FROM rating_rows)) WHERE rn = 1""",
    ),
)
def consolidated_sources(spark, sf):
    rows = R.rating_rows(spark, sf).select(*KEYS, "rating_id", "rating", F.trim("rating_agency").alias("agency"))
    history = rows.where("agency = 'Fitch'").drop("agency")
    local = rows.where("agency = 'Tassnief'").drop("agency")
    others = rows.where("agency NOT IN ('Fitch', 'Tassnief')")
    out = A.consolidate_sources([(1, history), (2, others), (3, local)], KEYS)
    return out.select(*KEYS, "rating", "rating_id", "source_rank")


# --- profiles -------------------------------------------------------------------------------


@query(
    "flag_prevalence",
    with_roles(
        ["flags"],
        " UNION ALL ".join(f"SELECT '{c}' AS flag, {i8(f'sum({c})', 'total')}, {r6(f'avg({c})', 'share')}, {r6(f'var_samp({c})', 'variance')} FROM flags" for c in V.KAM_FIVE),
    ),
)
def flag_prevalence(spark, sf):
    return rounded(PR.flag_prevalence(R.flags(spark, sf)), ["share", "variance"])


_FIVE = ", ".join(V.KAM_FIVE)


@query(
    "flag_profiles",
    with_roles(
        ["flags"],
        f"SELECT {', '.join(i8(c, c) for c in V.KAM_FIVE)}, n AS rows, {r6('n / sum(n) OVER ()', 'share')} FROM (SELECT {_FIVE}, count(*) AS n FROM flags GROUP BY ALL)",
    ),
)
def flag_profiles(spark, sf):
    return longs(rounded(PR.flag_profiles(R.flags(spark, sf)), ["share"]), V.KAM_FIVE)


@query(
    "profile_homogeneity",
    with_roles(
        ["flags"],
        f"SELECT count(*) AS profiles, max(n) AS top_rows, {r6('max(n) / sum(n)', 'top_share')} FROM (SELECT {_FIVE}, count(*) AS n FROM flags GROUP BY ALL)",
    ),
)
def profile_homogeneity(spark, sf):
    return rounded(PR.profile_homogeneity(R.flags(spark, sf)), ["top_share"])


@query(
    "missing_values",
    with_roles(
        ["panel", "ratios"],
        "WITH j AS (SELECT p.*, r.liquid, r.cumprof, r.profitab, r.leverage FROM panel p LEFT JOIN ratios r ON r.ticker = p.ticker AND r.fiscal_year = p.fiscal_year) "
        + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing FROM j" for c in [*V.RATIOS, *V.FLAGS]),
    ),
)
def missing_values(spark, sf):
    ratios = R.with_ratios(R.statements(spark, sf)).select(*KEYS, *V.RATIOS)
    return PR.missing_values(R.panel(spark, sf).join(ratios, KEYS, "left"), [*V.RATIOS, *V.FLAGS])


@query(
    "zero_variance",
    with_roles(["flags"], " UNION ALL ".join(f"SELECT '{c}' AS column_name FROM flags HAVING min({c}) = max({c})" for c in V.FLAGS)),
)
def zero_variance(spark, sf):
    return PR.zero_variance(R.flags(spark, sf), V.FLAGS)


@query(
    "dataset_counters",
    with_roles(["picked"], f"SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, count(DISTINCT {category_sql('rating')}) AS categories FROM picked"),
)
def dataset_counters(spark, sf):
    rows = R.rating_rows(spark, sf)
    from ratingloom.operators.panel import dedupe_by_agency

    picked = dedupe_by_agency(rows, [F.col("rating_agency"), F.col("rating")])
    return PR.dataset_counters(picked.withColumn("rating_category", RT.rating_category(F.col("rating"))))


@query(
    "class_balance",
    with_roles(
        ["rating_rows"],
        f"""SELECT {i8("i", "class_index")}, c AS rating_category, count(r.rating_id) AS rows
FROM (VALUES (0, 'A'), (1, 'AA'), (2, 'BB'), (3, 'BBB')) v(i, c) LEFT JOIN rating_rows r ON {category_sql("r.rating")} = c GROUP BY 1, 2""",
    ),
)
def class_balance(spark, sf):
    rows = R.rating_rows(spark, sf).withColumn("rating_category", RT.rating_category(F.col("rating")))
    return longs(PR.class_balance(rows), ["class_index"])


_PANEL_RATIOS = f"""pf AS (SELECT p.ticker, p.fiscal_year, {category_sql("p.rating")} AS rating_category, p.liquid, p.cumprof, p.profitab, p.leverage
  FROM picked p JOIN flags f ON p.ticker = f.ticker AND p.fiscal_year = f.fiscal_year)"""


@query(
    "box_statistics",
    with_roles(
        ["picked", "flags"],
        f"""WITH {_PANEL_RATIOS},
v AS (UNPIVOT (SELECT rating_category, liquid, cumprof, profitab, leverage FROM pf) ON liquid, cumprof, profitab, leverage INTO NAME feature VALUE value),
q AS (SELECT rating_category, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
  FROM v GROUP BY 1, 2)
SELECT rating_category, feature, {r6("q1", "q1")}, {r6("median", "median")}, {r6("q3", "q3")},
  {r6("min(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))", "whisker_low")},
  {r6("max(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))", "whisker_high")},
  count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS rows
FROM v JOIN q USING (rating_category, feature) GROUP BY rating_category, feature, q.q1, q.median, q.q3""",
    ),
)
def box_statistics(spark, sf):
    return rounded(PR.box_statistics(panel_frame(spark, sf)), ["q1", "median", "q3", "whisker_low", "whisker_high"])


@query(
    "confidence_histogram",
    with_roles(
        ["articles"],
        f"""WITH s AS (SELECT 1 / (1 + exp(-score)) AS confidence FROM articles), e AS (SELECT min(confidence) AS lo, max(confidence) AS hi FROM s),
b AS (SELECT least(CAST(floor((confidence - lo) / ((hi - lo) / 12)) AS INTEGER), 11) AS bin FROM s, e)
SELECT {i8("i", "bin")}, {r6("any_value(lo) + any_value((hi - lo) / 12) * i", "lower")}, count(b.bin) AS rows
FROM range(12) r(i) CROSS JOIN e LEFT JOIN b ON b.bin = i GROUP BY i""",
    ),
)
def confidence_histogram(spark, sf):
    shares = R.articles(spark, sf).select((1 / (1 + F.exp(-F.col("score")))).alias("confidence"))
    return longs(rounded(PR.confidence_histogram(shares), ["lower"]), ["bin"])
