"""The given tables in the roles of the panel's sources.

Issuers come from customers, panel keys and agency ratings from orders,
statement lines and audit flags from line items, news from events. Money is
summed in whole ten-thousandths, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingloom import fixed_values as V
from ratingloom.functions.ratings import notch_to_rating
from ratingloom.functions.ratios import core_ratios_by_name
from ratingloom.session import cut_lineage

LINES = {
    "current_assets": "AF", "current_liabilities": "AO", "retained_earnings": "NF",
    "ebit": "NO", "total_equity": "RF", "total_liabilities": "RO",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with the schema its files have now."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticker_of(c: Column) -> Column:
    return F.concat(c.cast("string"), F.lit(".SR"))


def issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, company_name, sector, industry of every customer."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    balance = F.col("c_acctbal")
    suffix = (
        F.when(balance < -500, " Islamic Bank").when(balance < 0, " Insurance").when(balance < 300, " Finance Company").otherwise(" Trading")
    )
    sector = F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_mktsegment")).otherwise(
        F.when(balance > 5000, " Financial Services ").otherwise("")
    )
    industry = (
        F.when(F.col("n_nationkey") == 7, "Asset Management").when(F.col("n_nationkey") == 11, "Banks - Regional").otherwise(F.col("n_name"))
    )
    return customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"]).select(
        ticker_of(F.col("c_custkey")).alias("ticker"),
        F.concat("c_name", suffix).alias("company_name"),
        sector.alias("sector"),
        industry.alias("industry"),
    )


def rating_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One agency rating per order."""
    orders = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    agency = (
        F.when(p == "1-URGENT", " Tassnief ").when(p == "2-HIGH", "Fitch").when(p == "3-MEDIUM", "Moodys")
        .when(p == "4-NOT SPECIFIED", "SP").otherwise("Financial Analytics")
    )
    notch = F.least(F.lit(21), F.floor(F.col("o_totalprice") / 23000)).cast("int")
    return orders.select(
        ticker_of(F.col("o_custkey")).alias("ticker"),
        F.year("o_orderdate").alias("fiscal_year"),
        agency.alias("rating_agency"),
        F.when(F.col("o_totalprice") >= 5000, notch_to_rating(notch)).alias("rating"),
        F.to_date("o_orderdate").alias("rating_date"),
        F.col("o_orderkey").alias("rating_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("amount"),
    )


def line_amount() -> Column:
    """Discounted price of a line in whole ten-thousandths.

    `rint` instead of `round`: prices have two decimals, so there are no halves
    to decide, and it needs no decimal arithmetic.
    """
    return F.rint(F.col("l_extendedprice") * 100).cast("long") * (100 - F.rint(F.col("l_discount") * 100).cast("long"))


def key_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement lines (in ten-thousandths) and flag facts per panel key, in one pass over line items.

    Line items are reduced to one row per order first; that shuffle is on the
    order key, which the join with orders then reuses.
    """
    item, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    item = item.select(
        "l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        F.concat("l_returnflag", "l_linestatus").alias("kind"), line_amount().alias("cents"),
    )
    kind, cents = F.col("kind"), F.col("cents")
    flag = lambda condition: F.max(condition.cast("int"))
    per_order = item.groupBy("l_orderkey").agg(
        *[F.sum(F.when(kind == code, cents)).alias(name) for name, code in LINES.items()],
        flag(F.col("l_quantity") >= 49).alias("big_quantity"),
        flag(F.col("l_tax") >= 0.08).alias("high_tax"),
        flag(F.col("l_discount") >= 0.1).alias("high_discount"),
        flag(F.col("l_quantity") <= 2).alias("small_quantity"),
        flag((F.col("l_returnflag") == "R") & (F.col("l_discount") <= 0.01)).alias("returned"),
        flag(F.col("l_linestatus") == "O").alias("open_line"),
        F.count(F.lit(1)).alias("line_count"),
    )
    joined = orders.join(per_order, orders["o_orderkey"] == per_order["l_orderkey"])
    maxima = ["big_quantity", "high_tax", "high_discount", "small_quantity", "returned", "open_line"]
    # grouped by the ticker itself, so joins on it need no further shuffle
    return joined.groupBy(ticker_of(F.col("o_custkey")).alias("ticker"), F.year("o_orderdate").alias("fiscal_year")).agg(
        *[F.sum(n).alias(n) for n in LINES],
        *[F.max(n).alias(n) for n in maxima],
        F.sum("line_count").alias("line_count"),
        F.count(F.lit(1)).alias("order_count"),
    )

def total_of_lines() -> Column:
    total = F.lit(0).cast("long")
    for n in LINES:
        total = total + F.coalesce(F.col(n), F.lit(0).cast("long"))
    return total


def statement_columns(facts: DataFrame) -> DataFrame:
    """Wide statements from key facts; total assets is the sum of all lines."""
    wide = facts.select("ticker", "fiscal_year", *LINES, total_of_lines().alias("total_assets"))
    amounts = [(F.col(n) / F.lit(10000.0)).alias(n) for n in [*LINES, "total_assets"]]
    return wide.select("ticker", "fiscal_year", *amounts)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement_columns(key_facts(spark, sf_dir))


def with_ratios(wide: DataFrame) -> DataFrame:
    return wide.withColumns(core_ratios_by_name())


def flag_expressions() -> dict[str, Column]:
    """The twelve flags over key facts, coded 0/1 (INDUSTRY 0 to 2); GCUP is constant."""
    c = F.col
    return {
        "AUSIZE": c("big_quantity"), "AUOP": c("high_tax"), "EMP": (c("line_count") > 6).cast("int"), "GCUP": F.lit(0),
        "GCKAM": ((c("high_tax") == 1) & (c("high_discount") == 1)).cast("int"), "REVKAM": c("high_discount"),
        "ASSETKAM": c("small_quantity"), "LIABKAM": c("returned"), "OTHERKAM": (c("open_line") == 0).cast("int"),
        "FIRMAGE": (c("order_count") > 1).cast("int"), "FIRMSIZE": (c("line_count") > 9).cast("int"),
        "INDUSTRY": F.least(c("order_count") - 1, F.lit(2)).cast("int"),
    }


def flag_columns(facts: DataFrame) -> DataFrame:
    return facts.select("ticker", "fiscal_year", *[v.cast("int").alias(n) for n, v in flag_expressions().items()])


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_columns(key_facts(spark, sf_dir))


def panel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel keys with the company name and the panel's own rating, that of the first order."""
    rows = rating_rows(spark, sf_dir).groupBy("ticker", "fiscal_year").agg(
        F.min(F.struct("rating_id", "rating")).alias("_first")
    )
    names = issuers(spark, sf_dir).select("ticker", "company_name")
    return rows.join(names, "ticker").select("ticker", "fiscal_year", "company_name", F.col("_first.rating").alias("rating"))


def stored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key facts as a table, for queries that need both statements and flags: line items are read once."""
    return cut_lineage(key_facts(spark, sf_dir), "facts")


def panel(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    """The panel with its flags; keys without line items have none."""
    own = flag_columns(facts if facts is not None else key_facts(spark, sf_dir))
    return panel_names(spark, sf_dir).join(own, ["ticker", "fiscal_year"], "left")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored article per event."""
    return articles_of(table(spark, sf_dir, "events"))


def articles_of(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        ticker_of(F.col("user_id")).alias("ticker"),
        (F.lit(1995) + F.pmod("event_id", F.lit(7))).cast("int").alias("fiscal_year"),
        ((F.rint(F.col("value") * 100).cast("long") - 5000) / F.lit(10000.0)).alias("score"),
        "ts",
        "event_type",
        "props",
    )


def agency_financials(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    """Ratios of the key with every agency's rating of it, as the multi-agency table has them."""
    wide = statement_columns(facts if facts is not None else key_facts(spark, sf_dir))
    ratios = with_ratios(wide).select("ticker", "fiscal_year", *V.RATIOS)
    rows = rating_rows(spark, sf_dir)
    target = F.when(F.col("status") == "P", F.lit(None)).otherwise((F.col("amount") < 150000).cast("int"))
    return rows.join(ratios, ["ticker", "fiscal_year"], "left").withColumn("binary_target", target)


# --- the same roles as SQL ------------------------------------------------------------------

_KINDS = {name: f"l_returnflag || l_linestatus = '{code}'" for name, code in LINES.items()}
_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))"
_SCALE_SQL = "CASE " + " ".join(f"WHEN {{x}} = {n} THEN '{letter}'" for letter, n in V.RATING_SCALE) + " END"


def letter_sql(x: str) -> str:
    return _SCALE_SQL.format(x=x)


def notch_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{letter}' THEN {n}" for letter, n in V.RATING_SCALE) + " END"


def category_sql(x: str) -> str:
    parts = []
    for category, letters in V.CATEGORY_LETTERS.items():
        inside = ", ".join(f"'{letter}'" for letter in letters)
        parts.append(f"WHEN {x} IN ({inside}) THEN '{category}'")
    return "CASE " + " ".join(parts) + " ELSE 'BB' END"


ROLE_SQL = {
    "issuers": (
        [],
        """SELECT CAST(c_custkey AS VARCHAR) || '.SR' AS ticker,
  c_name || CASE WHEN c_acctbal < -500 THEN ' Islamic Bank' WHEN c_acctbal < 0 THEN ' Insurance'
    WHEN c_acctbal < 300 THEN ' Finance Company' ELSE ' Trading' END AS company_name,
  CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment
    WHEN c_acctbal > 5000 THEN ' Financial Services ' ELSE '' END AS sector,
  CASE WHEN n_nationkey = 7 THEN 'Asset Management' WHEN n_nationkey = 11 THEN 'Banks - Regional' ELSE n_name END AS industry
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "rating_rows": (
        [],
        f"""SELECT CAST(o_custkey AS VARCHAR) || '.SR' AS ticker, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
  CASE o_orderpriority WHEN '1-URGENT' THEN ' Tassnief ' WHEN '2-HIGH' THEN 'Fitch' WHEN '3-MEDIUM' THEN 'Moodys'
    WHEN '4-NOT SPECIFIED' THEN 'SP' ELSE 'Financial Analytics' END AS rating_agency,
  CASE WHEN o_totalprice >= 5000 THEN {letter_sql("least(21, CAST(floor(o_totalprice / 23000) AS INTEGER))")} END AS rating,
  CAST(o_orderdate AS DATE) AS rating_date, o_orderkey AS rating_id, o_orderstatus AS status, o_totalprice AS amount
FROM orders""",
    ),
    "facts": (
        [],
        "SELECT CAST(o_custkey AS VARCHAR) || '.SR' AS ticker, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, "
        + ", ".join(f"CAST(sum(CASE WHEN {k} THEN {_CENTS} END) AS BIGINT) AS {n}" for n, k in _KINDS.items())
        + """,
  max(CASE WHEN l_quantity >= 49 THEN 1 ELSE 0 END) AS big_quantity, max(CASE WHEN l_tax >= 0.08 THEN 1 ELSE 0 END) AS high_tax,
  max(CASE WHEN l_discount >= 0.1 THEN 1 ELSE 0 END) AS high_discount, max(CASE WHEN l_quantity <= 2 THEN 1 ELSE 0 END) AS small_quantity,
  max(CASE WHEN l_returnflag = 'R' AND l_discount <= 0.01 THEN 1 ELSE 0 END) AS returned,
  max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS open_line, count(*) AS line_count, count(DISTINCT o_orderkey) AS order_count
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    ),
    "statements": (
        ["facts"],
        "SELECT ticker, fiscal_year, "
        + ", ".join(f"{n} / 10000.0::DOUBLE AS {n}" for n in LINES)
        + ", (" + " + ".join(f"coalesce({n}, 0)" for n in LINES) + ") / 10000.0::DOUBLE AS total_assets FROM facts",
    ),
    "ratios": (
        ["statements"],
        """SELECT *, CASE WHEN total_assets <> 0 THEN (current_assets - current_liabilities) / total_assets END AS liquid,
  CASE WHEN total_assets <> 0 THEN retained_earnings / total_assets END AS cumprof,
  CASE WHEN total_assets <> 0 THEN ebit / total_assets END AS profitab,
  CASE WHEN total_liabilities <> 0 THEN total_equity / total_liabilities END AS leverage
FROM statements""",
    ),
    "flags": (
        ["facts"],
        """SELECT ticker, fiscal_year, big_quantity AS AUSIZE, high_tax AS AUOP, CASE WHEN line_count > 6 THEN 1 ELSE 0 END AS EMP,
  0 AS GCUP, CASE WHEN high_tax = 1 AND high_discount = 1 THEN 1 ELSE 0 END AS GCKAM, high_discount AS REVKAM,
  small_quantity AS ASSETKAM, returned AS LIABKAM, CASE WHEN open_line = 0 THEN 1 ELSE 0 END AS OTHERKAM,
  CASE WHEN order_count > 1 THEN 1 ELSE 0 END AS FIRMAGE, CASE WHEN line_count > 9 THEN 1 ELSE 0 END AS FIRMSIZE,
  CAST(least(order_count - 1, 2) AS INTEGER) AS INDUSTRY FROM facts""",
    ),
    "panel_names": (
        ["issuers", "rating_rows"],
        """SELECT r.ticker, r.fiscal_year, i.company_name, r.rating FROM
  (SELECT *, row_number() OVER (PARTITION BY ticker, fiscal_year ORDER BY rating_id) AS rn FROM rating_rows) r
  JOIN issuers i ON i.ticker = r.ticker WHERE rn = 1""",
    ),
    "panel": (
        ["panel_names", "flags"],
        "SELECT n.*, " + ", ".join(f"f.{c}" for c in V.FLAGS)
        + " FROM panel_names n LEFT JOIN flags f ON n.ticker = f.ticker AND n.fiscal_year = f.fiscal_year",
    ),
    "articles": (
        [],
        """SELECT event_id, CAST(user_id AS VARCHAR) || '.SR' AS ticker, CAST(1995 + event_id % 7 AS INTEGER) AS fiscal_year,
  (CAST(round(value * 100) AS BIGINT) - 5000) / 10000.0::DOUBLE AS score, ts, event_type, props FROM events""",
    ),
    "agency_financials": (
        ["ratios", "rating_rows"],
        """SELECT r.*, x.liquid, x.cumprof, x.profitab, x.leverage,
  CASE WHEN status <> 'P' THEN CASE WHEN amount < 150000 THEN 1 ELSE 0 END END AS binary_target
FROM rating_rows r LEFT JOIN ratios x ON r.ticker = x.ticker AND r.fiscal_year = x.fiscal_year""",
    ),
    "news": (
        ["articles"],
        """SELECT ticker, fiscal_year, avg(score) AS sentiment_mean, stddev_pop(score) AS sentiment_std,
  avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END) AS sentiment_pos_pct, avg(CASE WHEN score < 0 THEN 1.0 ELSE 0.0 END) AS sentiment_neg_pct,
  count(*) AS news_count FROM articles GROUP BY 1, 2""",
    ),
    # one row per key: the preferred agency, then agency, rating (none first), and id
    "picked": (
        ["agency_financials"],
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, fiscal_year ORDER BY
  CASE WHEN lower(trim(rating_agency)) = 'tassnief' THEN 0 ELSE 1 END, rating_agency, rating NULLS FIRST, rating_date, rating_id) AS rn
  FROM agency_financials) WHERE rn = 1""",
    ),
}


def with_roles(names: list[str], body: str) -> str:
    """A query with the named roles, and those they need, as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in ROLE_SQL[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({ROLE_SQL[n][1]})" for n in order)
    head, body = ("WITH " + ctes, body.strip())
    return f"{head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"{head}\n{body}"
