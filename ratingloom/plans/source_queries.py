"""Queries that go through files: CSV, Parquet, nested statements, reports, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingloom import fixed_values as V
from ratingloom import schemas
from ratingloom.operators import metrics as M
from ratingloom.operators.panel import KEYS, clean_keys
from ratingloom.plans import roles as R
from ratingloom.plans.common import i8, longs, r6, rlist, rounded
from ratingloom.plans.evaluation_queries import _REPORT, rated_panel
from ratingloom.plans.panel_queries import _YEAR_TEXT_SQL, _year_text
from ratingloom.plans.registry import query
from ratingloom.plans.roles import with_roles
from ratingloom.session import cut_lineage, scratch_path
from ratingloom.sources import statements as SS
from ratingloom.sources import tables as ST
from ratingloom.sources import versions as SV


@query(
    "csv_scan",
    with_roles(
        ["agency_financials"],
        f"""SELECT ticker, trim(rating_agency) AS rating_agency, rating, fiscal_year, {rlist(V.RATIOS)}, {i8("binary_target", "binary_target")}, CAST(NULL AS VARCHAR) AS company_name
FROM agency_financials""",
    ),
)
def csv_scan(spark, sf):
    path = scratch_path(spark, "csv")
    rows = rounded(R.agency_financials(spark, sf), V.RATIOS).withColumn("rating_agency", F.trim("rating_agency"))
    written = rows.withColumns({"leverage": F.coalesce(F.col("leverage").cast("string"), F.lit("NaN")), "fiscal_year": F.col("fiscal_year").cast("double")})
    ST.write_csv(written.select(*KEYS, "rating_agency", "rating", *V.RATIOS, "binary_target"), path)
    return longs(clean_keys(ST.read_csv(spark, path, schemas.FINANCIALS)), ["binary_target"])


@query("parquet_panel", with_roles(["ratios"], f"SELECT ticker, fiscal_year, {rlist(V.RATIOS)} FROM ratios WHERE fiscal_year IN (1996, 1999)"))
def parquet_panel(spark, sf):
    path = scratch_path(spark, "panel")
    ST.write_panel(R.with_ratios(R.statements(spark, sf)).select(*KEYS, *V.RATIOS), path)
    schema = T.StructType([T.StructField("ticker", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in V.RATIOS], T.StructField("fiscal_year", T.IntegerType())])
    back = ST.read_panel(spark, path, schema).where(F.col("fiscal_year").isin(1996, 1999))
    return rounded(back.select(*KEYS, *V.RATIOS), V.RATIOS)


# --- statements -----------------------------------------------------------------------------

_INCOME = ["ebit"]
#: Documents of a written file.
DOCUMENTS_PER_FILE = 50
_ITEM = {n: V.LINE_ITEM_ALIASES[n][0] for n in [*R.LINES, "total_assets"]}


def _statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, period, item, value): odd years end on 30 June and 31 December, even ones on 30 June."""
    wide = R.statements(spark, sf_dir)
    items = F.array(*[F.struct(F.lit(_ITEM[n]).alias("item"), F.col(n).alias("value"), F.lit(int(n in _INCOME)).alias("income")) for n in _ITEM])
    rows = wide.select(*KEYS, F.explode(items).alias("i")).select(*KEYS, "i.*")
    ends = F.when(F.col("fiscal_year") % 2 == 1, F.array(F.lit("-06-30"), F.lit("-12-31"))).otherwise(F.array(F.lit("-06-30")))
    rows = rows.select("ticker", "fiscal_year", "item", "value", "income", F.explode(ends).alias("end"))
    value = F.when(F.col("end") == "-06-30", F.when(F.col("fiscal_year") % 2 == 1, F.col("value") / 2).otherwise(F.col("value"))).otherwise(F.col("value"))
    return rows.select("ticker", F.concat(F.col("fiscal_year").cast("string"), "end").alias("period"), "item", value.alias("value"), "income")


def _write_documents(spark, sf) -> str:
    """One nested document per ticker and period, absent values written as bare NaN."""
    path = scratch_path(spark, "statements")
    rows = _statement_rows(spark, sf)
    number = F.when(F.col("value").isNull(), "NaN").otherwise(F.col("value").cast("string"))
    entry = F.concat(F.lit('"'), F.col("item"), F.lit('": '), number)
    # at most one entry per line item of one period
    lines = rows.groupBy("ticker", "period").agg(
        F.array_join(F.collect_list(F.when(F.col("income") == 0, entry)), ", ").alias("b"),
        F.array_join(F.collect_list(F.when(F.col("income") == 1, entry)), ", ").alias("i"),
    )
    text = F.concat(
        F.lit('{"ticker": "'), F.col("ticker"), F.lit('", "balance_sheet": {"'), F.col("period"), F.lit('": {'), F.col("b"),
        F.lit('}}, "income_statement": {"'), F.col("period"), F.lit('": {'), F.col("i"), F.lit('}}, "cashflow": null}'),
    )
    lines.select(text.alias("value")).write.text(path)
    return path


_LINES_SQL = with_roles(
    ["statements"],
    "WITH long AS (UNPIVOT (SELECT ticker, fiscal_year, " + ", ".join(f"coalesce({n}, -1) AS \"{_ITEM[n]}\"" for n in _ITEM) + " FROM statements) ON "
    + ", ".join(f'"{_ITEM[n]}"' for n in _ITEM)
    + f""" INTO NAME item VALUE v),
e AS (SELECT ticker, fiscal_year || '-06-30' AS period, item, CASE WHEN v <> -1 THEN CASE WHEN fiscal_year % 2 = 1 THEN v / 2 ELSE v END END AS v FROM long
  UNION ALL SELECT ticker, fiscal_year || '-12-31', item, CASE WHEN v <> -1 THEN v END FROM long WHERE fiscal_year % 2 = 1)
SELECT ticker, CASE WHEN item = 'EBIT' THEN 'income_statement' ELSE 'balance_sheet' END AS statement, period, item, {r6("v", "value", 5)} FROM e""",
)


@query("statement_scan", _LINES_SQL)
def statement_scan(spark, sf):
    documents = SS.read_statements(spark, _write_documents(spark, sf), multi_line=False)
    return rounded(SS.statement_lines(documents), ["value"], 5)


def _write_yearly_documents(spark, sf) -> str:
    """Files of several lines per document: one document per ticker, each statement with all its periods, as the providers' files are laid out."""
    path = scratch_path(spark, "yearly-statements")
    rows = _statement_rows(spark, sf)
    number = F.when(F.col("value").isNull(), "NaN").otherwise(F.col("value").cast("string"))
    entry = F.concat(F.lit('      "'), F.col("item"), F.lit('": '), number)
    # bounded groups: the items of a period, the periods of a ticker
    periods = rows.groupBy("ticker", "income", "period").agg(F.array_join(F.collect_list(entry), ",\n").alias("lines"))
    period = F.concat(F.lit('    "'), F.col("period"), F.lit('": {\n'), F.col("lines"), F.lit("\n    }"))
    sections = periods.groupBy("ticker").agg(
        F.array_join(F.collect_list(F.when(F.col("income") == 0, period)), ",\n").alias("b"), F.array_join(F.collect_list(F.when(F.col("income") == 1, period)), ",\n").alias("i")
    )
    text = F.concat(
        F.lit('{\n  "ticker": "'), F.col("ticker"), F.lit('",\n  "balance_sheet": {\n'), F.col("b"), F.lit('\n  },\n  "income_statement": {\n'), F.col("i"), F.lit('\n  },\n  "cashflow": null\n}'),
    )
    sections = cut_lineage(sections, "yearly-sections")  # counted, then written
    files = max(1, sections.count() // DOCUMENTS_PER_FILE)
    listed = sections.groupBy(F.pmod(F.xxhash64("ticker"), F.lit(files)).alias("file")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(text), ",\n"), F.lit("\n]")).alias("value"))
    listed.select("value").write.option("maxRecordsPerFile", 1).text(path)  # one array of documents is one file
    return path


@query("statement_documents", _LINES_SQL)
def statement_documents(spark, sf):
    """The lines of documents of many lines and many periods."""
    documents = SS.read_statements(spark, _write_yearly_documents(spark, sf))
    return rounded(SS.statement_lines(documents), ["value"], 5)


@query(
    "statement_ratios",
    with_roles(
        ["ratios"],
        f"""SELECT ticker, fiscal_year, fiscal_year || CASE WHEN fiscal_year % 2 = 1 THEN '-12-31' ELSE '-06-30' END AS statement_period_end,
  {r6("total_assets", "total_assets", 5)}, {r6("total_liabilities", "total_liabilities", 5)}, {r6("total_equity", "total_equity", 5)}, {rlist(V.RATIOS)} FROM ratios""",
    ),
)
def statement_ratios(spark, sf):
    documents = SS.read_statements(spark, _write_documents(spark, sf), multi_line=False)
    out = SS.statement_ratios(documents)
    return rounded(rounded(out, V.RATIOS), ["total_assets", "total_liabilities", "total_equity"], 5)


# --- reports and retention ------------------------------------------------------------------


@query(
    "report_table",
    with_roles(
        ["rated"],
        "WITH " + _REPORT.format(by="", src="rated")
        + "\n" + " UNION ALL ".join(f"SELECT 'classes' AS section, label AS key, '{m}' AS metric, {r6(m, 'value')} FROM rep" for m in ("precision", "recall", "f1", "support")),
    ),
)
def report_table(spark, sf):
    report = ST.long_report(M.class_report(rated_panel(spark, sf)), ["label"], "classes")
    return rounded(report, ["value"])


@query(
    "report_json",
    with_roles(["rated"], "SELECT 'classes' AS section, rating_category AS key, count(*)::DOUBLE AS support FROM rated GROUP BY 2 UNION ALL SELECT 'errors', rating_category || '/' || predicted_category, count(*)::DOUBLE FROM rated WHERE rating_category <> predicted_category GROUP BY 2"),
)
def report_json(spark, sf):
    path = scratch_path(spark, "report")
    rows = rated_panel(spark, sf)
    classes = rows.groupBy("rating_category").agg(F.count(F.lit(1)).alias("support"))
    errors = M.misclassified(rows).groupBy("rating_category", "predicted_category").agg(F.count(F.lit(1)).alias("support"))
    report = ST.long_report(classes, ["rating_category"], "classes").unionByName(ST.long_report(errors, ["rating_category", "predicted_category"], "errors"))
    ST.write_report(report, path)
    back = spark.read.schema("section string, key string, json string").json(path)
    return back.select("section", "key", F.from_json("json", "support double")["support"].alias("support"))


@query(
    "retention",
    f"SELECT o_orderkey, {_YEAR_TEXT_SQL} AS fiscal_year FROM orders WHERE coalesce(CAST(TRY_CAST(trim({_YEAR_TEXT_SQL}) AS DOUBLE) AS INTEGER) NOT IN (1996, 1999), TRUE)",
)
def retention(spark, sf):
    rows = R.table(spark, sf, "orders").select("o_orderkey", _year_text().alias("fiscal_year"))
    return ST.retain_years(rows, [1996, 1999])


@query(
    "retention_counts",
    """SELECT 'orders' AS table_name, count(*) AS rows_in, count(*) FILTER (year(o_orderdate) NOT IN (1996, 1999)) AS rows_out,
  CAST(count(*) <> count(*) FILTER (year(o_orderdate) NOT IN (1996, 1999)) AS BIGINT) AS changed FROM orders
UNION ALL SELECT 'events', count(*), count(*), 0 FROM events""",
)
def retention_counts(spark, sf):
    orders = R.table(spark, sf, "orders").select(F.year("o_orderdate").cast("string").alias("fiscal_year_applicable"))
    events = R.table(spark, sf, "events").select(F.year("ts").alias("fiscal_year"))
    counts = ST.retirement_counts(orders, "orders", [1996, 1999]).unionByName(ST.retirement_counts(events, "events", [1996, 1999]))
    return longs(counts, ["changed"])


@query(
    "versioned_rewrite",
    with_roles(
        ["ratios"],
        """SELECT CAST(fiscal_year AS VARCHAR) AS partition, CAST(max(CASE WHEN fiscal_year IN (1996, 1999) THEN 1 WHEN fiscal_year = 1997 AND liquid IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS rewritten,
  count(*) FILTER (WHERE fiscal_year NOT IN (1996, 1999)) AS rows, count(*) AS rows_before FROM ratios GROUP BY 1""",
    ),
)
def versioned_rewrite(spark, sf):
    """What a refresh writes anew: two retired years go, the liquidity of one is corrected, the other years keep their files."""
    root = scratch_path(spark, "versions")
    panel = R.with_ratios(R.statements(spark, sf)).select(*KEYS, *V.RATIOS)
    SV.write_version(panel, root)
    corrected = F.when(F.col("fiscal_year") == 1997, F.col("liquid") + 1).otherwise(F.col("liquid"))
    changed = SV.write_version(ST.retain_years(panel, [1996, 1999]).withColumn("liquid", corrected), root)
    before = SV.read_version(spark, root, panel.schema, version=0).groupBy(F.col("fiscal_year").cast("string").alias("partition")).agg(F.count(F.lit(1)).alias("rows_before"))
    return changed.join(before, "partition")
