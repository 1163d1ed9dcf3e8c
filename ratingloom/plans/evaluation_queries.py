"""Queries on folds, metrics, neighbours and the tables behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.functions.ratings import rating_category
from ratingloom.operators import folds as FO
from ratingloom.operators import metrics as M
from ratingloom.operators import models as MO
from ratingloom.operators import neighbours as NB
from ratingloom.operators.panel import KEYS
from ratingloom.plans import roles as R
from ratingloom.plans.common import i8, longs, r6, rounded
from ratingloom.plans.registry import query
from ratingloom.plans.roles import category_sql, notch_sql, with_roles
from ratingloom.plans.verdict_queries import predicted_panel

SEED = V.BOOSTING["seed"]
HASH_SQL = f"md5('{SEED}|' || ticker || '|' || fiscal_year)"
FOLD_SQL = f"CAST((row_number() OVER (PARTITION BY rating_category ORDER BY {HASH_SQL}, ticker, fiscal_year) - 1) % 5 AS INTEGER)"


def rated_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rating with its category and, as prediction, that of the key's first rating."""
    rows = R.rating_rows(spark, sf_dir)
    first = rows.groupBy(*KEYS).agg(F.min(F.struct("rating_id", "rating"))["rating"].alias("predicted"))
    joined = rows.join(first, KEYS)
    return joined.withColumns(
        {"rating_category": rating_category(F.col("rating")), "predicted_category": rating_category(F.col("predicted"))}
    )


R.ROLE_SQL["rated"] = (
    ["rating_rows"],
    f"""SELECT r.*, f.predicted, {category_sql("r.rating")} AS rating_category, {category_sql("f.predicted")} AS predicted_category FROM rating_rows r
JOIN (SELECT ticker, fiscal_year, rating AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY ticker, fiscal_year ORDER BY rating_id) AS rn FROM rating_rows) WHERE rn = 1) f
  ON f.ticker = r.ticker AND f.fiscal_year = r.fiscal_year""",
)


# --- folds ----------------------------------------------------------------------------------


@query("strat_folds", with_roles(["predicted"], f"SELECT ticker, fiscal_year, rating_category, {FOLD_SQL} AS fold FROM predicted"))
def strat_folds(spark, sf):
    rows = predicted_panel(spark, sf).select(*KEYS, "rating_category")
    return FO.stratified_folds(rows, "rating_category", KEYS)


@query(
    "group_folds",
    """WITH RECURSIVE sizes AS (SELECT CAST(o_custkey AS VARCHAR) || '.SR' AS ticker, count(*) AS n FROM orders GROUP BY 1),
ordered AS (SELECT ticker, n, row_number() OVER (ORDER BY n DESC, ticker) AS i FROM sizes),
pack AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS ticker, -1 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL SELECT o.i, o.ticker, list_position(p.loads, list_min(p.loads)) - 1,
    list_transform(p.loads, lambda x, j: CASE WHEN j = list_position(p.loads, list_min(p.loads)) THEN x + o.n ELSE x END)
  FROM pack p JOIN ordered o ON o.i = p.i + 1)
SELECT CAST(d.o_custkey AS VARCHAR) || '.SR' AS ticker, d.o_orderkey, CAST(p.fold AS BIGINT) AS fold FROM orders d JOIN pack p ON p.ticker = CAST(d.o_custkey AS VARCHAR) || '.SR'""",
)
def group_folds(spark, sf):
    rows = R.table(spark, sf, "orders").select(R.ticker_of(F.col("o_custkey")).alias("ticker"), "o_orderkey")
    return longs(FO.group_folds(rows, "ticker"), ["fold"])


@query(
    "leave_one_out_folds",
    f"SELECT s_suppkey, row_number() OVER (ORDER BY md5('{SEED}|' || s_suppkey), s_suppkey) - 1 AS fold FROM supplier",
)
def leave_one_out_folds(spark, sf):
    return longs(FO.leave_one_out_folds(R.table(spark, sf, "supplier").select("s_suppkey"), ["s_suppkey"]), ["fold"])


@query("time_split", with_roles(["predicted"], "SELECT ticker, fiscal_year, CASE WHEN fiscal_year >= 2000 THEN 0 ELSE -1 END AS fold FROM predicted"))
def time_split(spark, sf):
    return FO.time_split(predicted_panel(spark, sf).select(*KEYS), 2000)


@query(
    "even_sample",
    with_roles(
        ["panel_names"],
        f"""WITH h AS (SELECT *, row_number() OVER (ORDER BY {HASH_SQL}, ticker, fiscal_year) - 1 AS position, count(*) OVER () AS n FROM panel_names)
SELECT ticker, fiscal_year, position FROM h WHERE position IN (SELECT CAST(floor(i * ((SELECT max(n) FROM h) - 1) / 7.0::DOUBLE) AS BIGINT) FROM range(8) t(i))""",
    ),
)
def even_sample(spark, sf):
    return longs(FO.even_sample(R.panel_names(spark, sf).select(*KEYS), KEYS), ["position"])


# --- metrics --------------------------------------------------------------------------------

_CLASSES = "(VALUES ('A'), ('AA'), ('BB'), ('BBB'))"


@query(
    "confusion_long",
    with_roles(
        ["rated"],
        f"""SELECT c.x AS actual, d.x AS predicted, count(r.rating_id) AS n FROM {_CLASSES} c(x) CROSS JOIN {_CLASSES} d(x)
LEFT JOIN rated r ON r.rating_category = c.x AND r.predicted_category = d.x GROUP BY 1, 2""",
    ),
)
def confusion_long(spark, sf):
    return M.confusion(rated_panel(spark, sf))


@query(
    "confusion_matrix",
    with_roles(
        ["rated"],
        "SELECT rating_category AS actual, " + ", ".join(f"count(*) FILTER (predicted_category = '{c}') AS \"{c}\"" for c in V.CATEGORIES) + " FROM rated GROUP BY 1",
    ),
)
def confusion_matrix(spark, sf):
    return M.confusion_wide(rated_panel(spark, sf))


_REPORT = """pairs AS (SELECT {by} rating_category AS a, predicted_category AS p, count(*) AS n FROM {src} GROUP BY ALL),
lab AS (SELECT {by} label, sum(sup) AS support, sum(said) AS said, sum(hit) AS hit FROM (
  SELECT {by} a AS label, n AS sup, 0 AS said, CASE WHEN a = p THEN n ELSE 0 END AS hit FROM pairs UNION ALL SELECT {by} p, 0, n, 0 FROM pairs) GROUP BY ALL),
rep AS (SELECT {by} label, coalesce(hit / nullif(said, 0)::DOUBLE, 0) AS precision, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS recall,
  coalesce(2 * hit / nullif(said + support, 0)::DOUBLE, 0) AS f1, support FROM lab)"""


@query(
    "class_report",
    with_roles(
        ["rated"],
        "WITH " + _REPORT.format(by="", src="rated") + f" SELECT label, {r6('precision', 'precision')}, {r6('recall', 'recall')}, {r6('f1', 'f1')}, {i8('support', 'support')} FROM rep",
    ),
)
def class_report(spark, sf):
    return rounded(M.class_report(rated_panel(spark, sf)), ["precision", "recall", "f1"])




def fold_scores_sql(source: str) -> str:
    """Scores per fold (fs) of a source with fold, rating_category and predicted_category."""
    return _REPORT.format(by="fold,", src=source) + (
        ", fs AS (SELECT fold, sum(recall * support) / sum(support) AS accuracy, avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted FROM rep GROUP BY 1)"
    )


_FOLD_SCORES = f"folded AS (SELECT *, {FOLD_SQL} AS fold FROM predicted), " + fold_scores_sql("folded")
_METRICS = ["accuracy", "f1_macro", "f1_weighted"]
SUMMARY_SQL = ", ".join(f"{r6(f'avg({m})', m + '_mean')}, {r6(f'stddev_pop({m})', m + '_std')}" for m in _METRICS)
SUMMARY_COLUMNS = [f"{m}_{s}" for m in _METRICS for s in ("mean", "std")]


def _folded(spark, sf):
    return FO.stratified_folds(predicted_panel(spark, sf).select(*KEYS, "rating_category", "predicted_category"), "rating_category", KEYS, V.MAX_FOLDS)


@query("fold_scores", with_roles(["predicted"], f"WITH {_FOLD_SCORES} SELECT fold, {', '.join(r6(m, m) for m in _METRICS)} FROM fs"))
def fold_scores(spark, sf):
    return rounded(M.summary_scores(_folded(spark, sf), ["fold"]), _METRICS)


@query(
    "fold_summary",
    with_roles(
        ["predicted"],
        f"WITH {_FOLD_SCORES} SELECT 'panel' AS model, {SUMMARY_SQL} FROM fs",
    ),
)
def fold_summary(spark, sf):
    scores = MO.fold_scores(_folded(spark, sf), "rating_category", model="panel")
    return rounded(M.fold_summary(scores, ["model"]), SUMMARY_COLUMNS)


@query(
    "error_pairs",
    with_roles(["rated"], "SELECT rating_category || ' → ' || predicted_category AS pair, count(*) AS errors FROM rated WHERE rating_category <> predicted_category GROUP BY 1"),
)
def error_pairs(spark, sf):
    return M.error_pairs(rated_panel(spark, sf))


@query(
    "misclassified",
    with_roles(
        ["predicted"],
        f"SELECT ticker, company_name, fiscal_year, rating_category, predicted_category, {r6('confidence', 'confidence')} FROM predicted WHERE rating_category <> predicted_category",
    ),
)
def misclassified(spark, sf):
    out = M.misclassified(predicted_panel(spark, sf))
    return rounded(out.select("ticker", "company_name", "fiscal_year", "rating_category", "predicted_category", "confidence"), ["confidence"])


@query(
    "investment_grade_scores",
    with_roles(
        ["rated"],
        f"""WITH c AS (SELECT count(*) FILTER (a AND p)::DOUBLE AS tp, count(*) FILTER (NOT a AND NOT p)::DOUBLE AS tn, count(*) FILTER (NOT a AND p)::DOUBLE AS fp,
  count(*) FILTER (a AND NOT p)::DOUBLE AS fn FROM (SELECT rating_category <> 'BB' AS a, predicted_category <> 'BB' AS p FROM rated))
SELECT {r6("2 * tp / (2 * tp + fp + fn)", "f1")}, {r6("(tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn))", "mcc")} FROM c""",
    ),
)
def investment_grade_scores(spark, sf):
    return rounded(M.investment_grade_scores(rated_panel(spark, sf)), ["f1", "mcc"])


@query(
    "rank_correlation",
    with_roles(
        ["rated"],
        f"""WITH n AS (SELECT {notch_sql("rating")} AS x, {notch_sql("predicted")} AS y FROM rated WHERE rating IS NOT NULL AND predicted IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM n)
SELECT {r6("corr(rx, ry)", "spearman")}, count(*) AS rows FROM r""",
    ),
)
def rank_correlation(spark, sf):
    return rounded(M.rating_rank_correlation(rated_panel(spark, sf), "rating", "predicted"), ["spearman"])


@query(
    "class_weights",
    with_roles(
        ["rated"],
        f"SELECT rating_category, count(*) AS rows, {r6('(SELECT count(*) FROM rated) / (4.0::DOUBLE * count(*))', 'weight')} FROM rated GROUP BY 1",
    ),
)
def class_weights(spark, sf):
    weighted = MO.with_class_weights(rated_panel(spark, sf), "rating_category")
    return rounded(weighted.groupBy("rating_category").agg(F.count(F.lit(1)).alias("rows"), F.max("weight").alias("weight")), ["weight"])


@query(
    "agency_scores",
    with_roles(
        ["rated"],
        f"""SELECT trim(rating_agency) AS rating_agency, {r6("avg(CAST(rating_category = predicted_category AS INTEGER))", "accuracy")}, count(*) AS rows FROM rated GROUP BY 1""",
    ),
)
def agency_scores(spark, sf):
    hit = (F.col("rating_category") == F.col("predicted_category")).cast("double")
    rows = rated_panel(spark, sf).groupBy(F.trim("rating_agency").alias("rating_agency"))
    return rounded(rows.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("rows")), ["accuracy"])


# --- neighbours -----------------------------------------------------------------------------

_KNN_SQL = f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
  CAST((row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}|' || vec_id), vec_id) - 1) % 5 AS INTEGER) AS fold FROM embeddings),
d AS (SELECT fold, vec_id, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e),
st AS (SELECT f.fold, i, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT DISTINCT fold FROM e) f JOIN d ON d.fold <> f.fold GROUP BY 1, 2),
z AS (SELECT f.fold AS test_fold, e.vec_id, any_value(e.label) AS label, any_value(e.fold) AS fold, list((d.x - st.m) / st.s ORDER BY d.i) AS v
  FROM e JOIN d ON d.vec_id = e.vec_id JOIN st ON st.i = d.i JOIN (SELECT DISTINCT fold FROM e) f ON f.fold = st.fold GROUP BY 1, 2),
p AS (SELECT q.vec_id, q.label, q.fold, t.vec_id AS t_id, t.label AS t_label, list_distance(q.v, t.v) AS dist
  FROM z q JOIN z t ON t.test_fold = q.test_fold AND t.fold <> q.test_fold WHERE q.fold = q.test_fold),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, t_id) AS rn FROM p) WHERE rn <= 5),
w AS (SELECT *, CASE WHEN min(dist) OVER (PARTITION BY vec_id) = 0 THEN CAST(dist = 0 AS INTEGER)::DOUBLE ELSE 1 / dist END AS weight FROM k),
s AS (SELECT vec_id, label, fold, t_label, sum(weight) AS votes FROM w GROUP BY ALL)
SELECT vec_id, {i8("any_value(fold)", "fold")}, {i8("any_value(label)", "label")}, {i8("arg_max(t_label, votes - t_label * 1e-12)", "predicted_category")}, {r6("max(votes) / sum(votes)", "confidence")}
FROM s GROUP BY vec_id"""


@query("knn", _KNN_SQL)
def knn(spark, sf):
    vectors = R.table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    folded = FO.stratified_folds(vectors, "label", ["vec_id"], V.MAX_FOLDS)
    labels = [r[0] for r in vectors.select("label").distinct().orderBy("label").collect()]
    out = NB.out_of_fold_neighbours(folded, "vec_id", "label", labels, range(V.MAX_FOLDS))
    return longs(rounded(out, ["confidence"]), ["fold", "label", "predicted_category"])
