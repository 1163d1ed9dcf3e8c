"""Queries that fit models on the panel and explain them.

All fits run with the published settings.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.operators import attribution as AT
from ratingloom.operators import boosting as B
from ratingloom.operators import extra_trees as ET
from ratingloom.operators import folds as FO
from ratingloom.operators import leave_one_out as LO
from ratingloom.operators import metrics as M
from ratingloom.operators import models as MO
from ratingloom.operators import neighbours as NB
from ratingloom.operators.panel import KEYS, drop_null_ratios, fill_features
from ratingloom.plans import roles as R
from ratingloom.plans.common import longs, r6, rounded
from ratingloom.plans.evaluation_queries import FOLD_SQL, SUMMARY_COLUMNS, SUMMARY_SQL, fold_scores_sql
from ratingloom.plans.panel_queries import panel_frame
from ratingloom.plans.registry import query
from ratingloom.plans.roles import with_roles
from ratingloom.session import cut_lineage

TARGET = "rating_category"
CLASSES = V.CATEGORIES


_FEATURE_SQL = ", ".join(
    f"CAST({c} AS DOUBLE)" for c in [*[f"p.{r}" for r in V.RATIOS], *[f"coalesce(f.{c}, 0)" for c in V.FLAGS], *[f"coalesce(p.{c}, 0)" for c in V.NEWS_FEATURES]]
)


def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 21 features, the category and a stratified fold, as a table all fits read."""
    frame = fill_features(drop_null_ratios(panel_frame(spark, sf_dir)))
    frame = frame.withColumn("rating_agency", F.trim("rating_agency"))
    table = cut_lineage(frame.select(*KEYS, "rating_agency", TARGET, *V.ALL_FEATURES), "frame")
    return cut_lineage(FO.stratified_folds(table, TARGET, KEYS), "folded")


def _folds(table: DataFrame) -> list[int]:
    return [r[0] for r in table.select("fold").distinct().orderBy("fold").collect()]


def _training(frame: DataFrame, features=tuple(V.ALL_FEATURES), carry=(*KEYS, "rating_agency"), fits=1) -> DataFrame:
    return MO.training_table(frame, features, TARGET, CLASSES, carry, fits)


@query("boosted_out_of_fold")
def boosted_out_of_fold(spark, sf):
    """Every row's category and confidence from the model that has not seen it."""
    table = _training(model_frame(spark, sf))
    out = MO.out_of_fold(table, MO.boosted_trees(), _folds(table), len(V.ALL_FEATURES), CLASSES)
    return out.select(*KEYS, "fold", TARGET, "predicted_category", "confidence", "probabilities")


@query(
    "out_of_fold_coverage",
    with_roles(
        ["predicted"],
        f"""SELECT fold, rating_category, count(*) AS rows, count(DISTINCT ticker || fiscal_year) AS keys, CAST(0 AS BIGINT) AS bad_shares
FROM (SELECT *, {FOLD_SQL} AS fold FROM predicted) GROUP BY 1, 2""",
    ),
)
def out_of_fold_coverage(spark, sf):
    """Rows predicted per fold and class: each key once, its shares adding up to 1."""
    table = _training(model_frame(spark, sf), fits=V.MAX_FOLDS)
    out = MO.out_of_fold(table, MO.logistic_regression(table.count()), _folds(table), len(V.ALL_FEATURES), CLASSES)
    share = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    wrong = (F.abs(share - 1) > 1e-9) | F.col("predicted_category").isNull()
    return out.groupBy("fold", TARGET).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.concat("ticker", F.col("fiscal_year").cast("string"))).alias("keys"), F.count_if(wrong).alias("bad_shares")
    )


def _first_round_sql() -> str:
    """The first second-order tree of each class, level by level."""
    names = "[" + ", ".join(f"'{f}'" for f in V.ALL_FEATURES) + "]"
    quantiles = ", ".join(f"{k / 64}" for k in range(1, 64))
    parts = [
        f"x AS (SELECT p.ticker || '|' || p.fiscal_year AS r, p.rating_category AS c, [{_FEATURE_SQL}] AS x FROM predicted p JOIN flags f ON p.ticker = f.ticker AND p.fiscal_year = f.fiscal_year)",
        f"tall AS (SELECT r, j, x[j] AS v FROM x, range(1, {len(V.ALL_FEATURES) + 1}) t(j))",
        f"cuts AS (SELECT j, list_sort(list_distinct(quantile_disc(v, [{quantiles}]))) AS q FROM tall GROUP BY 1)",
        "bins AS MATERIALIZED (SELECT r, t.j, q, len(list_filter(q, lambda z: z < v)) AS b FROM tall t JOIN cuts USING (j))",
        f"at0 AS MATERIALIZED (SELECT r, k, 0 AS node, CASE WHEN c = k THEN -0.75::DOUBLE ELSE 0.25::DOUBLE END AS g FROM x, (SELECT unnest({list(CLASSES)}) AS k))",
    ]
    for level in range(V.BOOSTING["depth"]):
        parts += [
            f"s{level} AS (SELECT k, node, j, b, any_value(q) AS q, sum(g) AS g, sum(0.375::DOUBLE) AS h FROM at{level} JOIN bins USING (r) GROUP BY 1, 2, 3, 4)",
            f"w{level} AS (SELECT k, node, j, b, q, sum(g) OVER a AS gl, sum(h) OVER a AS hl, sum(g) OVER e AS g, sum(h) OVER e AS h FROM s{level} WINDOW a AS (PARTITION BY k, node, j ORDER BY b), e AS (PARTITION BY k, node, j))",
            f"v{level} AS (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain FROM w{level} WHERE b < len(q) AND hl >= 1 AND h - hl >= 1)",
            f"best{level} AS MATERIALIZED (SELECT k, node, j, b, q, gain FROM (SELECT *, row_number() OVER (PARTITION BY k, node ORDER BY gain DESC, j, b) AS n FROM v{level}) WHERE n = 1 AND gain > 1e-6)",
            f"at{level + 1} AS MATERIALIZED (SELECT a.r, a.k, 2 * a.node + CASE WHEN i.b <= s.b THEN 1 ELSE 2 END AS node, a.g FROM at{level} a JOIN best{level} s ON s.k = a.k AND s.node = a.node JOIN bins i ON i.r = a.r AND i.j = s.j)",
        ]
    rows = " UNION ALL ".join(f"SELECT * FROM at{level}" for level in range(V.BOOSTING["depth"] + 1))
    splits = " UNION ALL ".join(f"SELECT * FROM best{level}" for level in range(V.BOOSTING["depth"]))
    return f"""WITH {", ".join(parts)}, nodes AS (SELECT k, node, sum(g) AS g, sum(0.375::DOUBLE) AS h FROM ({rows}) GROUP BY 1, 2)
SELECT n.k AS class, CAST(n.node AS BIGINT) AS node, {names}[j] AS feature, {r6("q[b + 1]", "cut")}, {r6("gain", "gain")}, {r6("-0.1 * g / (h + 1)", "value")}, {r6("h", "cover")}
FROM nodes n LEFT JOIN ({splits}) s ON s.k = n.k AND s.node = n.node"""


@query("boosting_first_round", with_roles(["predicted", "flags"], _first_round_sql()))
def boosting_first_round(spark, sf):
    """The nodes of the first tree of each class: split feature, cut and gain, value and cover."""
    fitted = MO.boosted_trees(1).fit(_training(model_frame(spark, sf)), len(V.ALL_FEATURES), CLASSES)
    return rounded(B.tree_nodes(fitted, V.ALL_FEATURES, spark).drop("round"), ["cut", "gain", "value", "cover"])


_ROOTS_SQL = f"""WITH x AS (SELECT p.ticker || '|' || p.fiscal_year AS r, p.rating_category AS c, [{_FEATURE_SQL}] AS x FROM predicted p JOIN flags f ON p.ticker = f.ticker AND p.fiscal_year = f.fiscal_year),
tall AS MATERIALIZED (SELECT r, c, j - 1 AS j, x[j] AS v FROM x, range(1, {len(V.ALL_FEATURES) + 1}) t(j)),
span AS (SELECT j, min(v) AS lo, max(v) AS hi FROM tall GROUP BY 1 HAVING max(v) - min(v) > 1e-7),
draws AS (SELECT t AS tree, j, lo, hi, md5('{V.BOOSTING["seed"]}|' || t || '|0|' || j) AS m FROM span, range({V.FOREST["trees"]}) t(t)),
chosen AS (SELECT tree, j, row_number() OVER (PARTITION BY tree ORDER BY substr(m, 14, 13)) AS place,
  lo + CAST('0x' || substr(m, 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * (hi - lo) AS cut, lo, hi FROM draws),
cuts AS (SELECT tree, j, place, CASE WHEN cut < hi THEN cut ELSE lo END AS cut FROM chosen WHERE place <= {isqrt(len(V.ALL_FEATURES))}),
sides AS (SELECT tree, j, place, any_value(cut) AS cut, c, count(*) AS n, count(*) FILTER (WHERE v <= cut) AS l FROM cuts JOIN tall USING (j) GROUP BY tree, j, place, c),
good AS (SELECT tree, j, place, any_value(cut) AS cut, sum(l) AS rows_left, sum(l * l) / sum(l)::DOUBLE + sum((n - l) * (n - l)) / sum(n - l)::DOUBLE AS good FROM sides
  GROUP BY 1, 2, 3 HAVING sum(l) >= {V.FOREST["min_leaf"]} AND sum(n - l) >= {V.FOREST["min_leaf"]})
SELECT CAST(tree AS BIGINT) AS tree, {[*V.ALL_FEATURES]}[j + 1] AS feature, {r6("cut", "cut")}, CAST(rows_left AS BIGINT) AS rows_left FROM good
QUALIFY row_number() OVER (PARTITION BY tree ORDER BY good DESC, place) = 1"""


@query("extra_trees_roots", with_roles(["predicted", "flags"], _ROOTS_SQL))
def extra_trees_roots(spark, sf):
    """The root split of every extremely randomised tree: its feature, the drawn cut and the rows left of it."""
    table = _training(model_frame(spark, sf))
    forest = ET.grow(table, [B.Fit(tuple(range(len(V.ALL_FEATURES))))], len(V.ALL_FEATURES), len(CLASSES), depth=1)[0]
    rows = [(t, V.ALL_FEATURES[f[0]], float(c[0]), int(n[1].sum())) for t, (f, c, n) in enumerate(zip(forest.feature, forest.cut, forest.counts)) if f[0] >= 0]
    return rounded(spark.createDataFrame(rows, "tree bigint, feature string, cut double, rows_left bigint"), ["cut"])


@query("feature_ablation")
def feature_ablation(spark, sf):
    frame = model_frame(spark, sf)
    return MO.ablation(frame, V.FEATURE_BLOCKS, TARGET, CLASSES, _folds(frame), MO.boosted_trees())


@query("ablation_top_features")
def ablation_top_features(spark, sf):
    return MO.top_features(model_frame(spark, sf), V.FEATURE_BLOCKS, TARGET, CLASSES, MO.boosted_trees())


@query("three_model_ablation")
def three_model_ablation(spark, sf):
    frame = model_frame(spark, sf)
    return MO.ablation(frame, V.THREE_MODELS, TARGET, CLASSES, _folds(frame), MO.boosted_trees())


@query("model_benchmark")
def model_benchmark(spark, sf):
    """Accuracy and F1 of all classifiers over the same folds, with the neighbour model."""
    table = _training(model_frame(spark, sf), fits=V.MAX_FOLDS)
    folds, features = _folds(table), len(V.ALL_FEATURES)
    row_count = table.count()
    rows = NB.as_array(table).withColumn("key", F.concat_ws("|", *KEYS))
    neighbours = NB.out_of_fold_neighbours(rows, "key", TARGET, CLASSES, folds)
    models = MO.benchmark_models(row_count)
    return MO.benchmark(table, models, TARGET, features, CLASSES, folds, {"Nearest Neighbours": neighbours})


_BAYES_SQL = f"""WITH folded AS (SELECT p.ticker, p.fiscal_year, p.rating_category, {FOLD_SQL.replace("ticker", "p.ticker").replace("fiscal_year", "p.fiscal_year")} AS fold, [{_FEATURE_SQL}] AS x
  FROM predicted p JOIN flags f ON p.ticker = f.ticker AND p.fiscal_year = f.fiscal_year),
tall AS (SELECT ticker, fiscal_year, rating_category, fold, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS v FROM folded),
train AS (SELECT k.fold AS test, t.rating_category AS c, t.j, count(*) AS n, sum(t.v) AS s, sum(t.v * t.v) AS q FROM (SELECT DISTINCT fold FROM folded) k JOIN tall t ON t.fold <> k.fold GROUP BY ALL),
least_var AS (SELECT test, 1e-9 * max(q / n - s / n * s / n) AS e FROM (SELECT test, j, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM train GROUP BY ALL) GROUP BY 1),
shape AS (SELECT test, c, j, s / n AS m, e + q / n - s / n * s / n AS v FROM train JOIN least_var USING (test)),
prior AS (SELECT test, c, ln(n) - ln(sum(n) OVER (PARTITION BY test)) AS p FROM (SELECT DISTINCT test, c, n FROM train)),
score AS (SELECT t.ticker, t.fiscal_year, t.fold, t.rating_category, g.c, any_value(r.p) - sum(ln(2 * pi() * g.v) / 2 + (t.v - g.m) * (t.v - g.m) / (2 * g.v)) AS ll
  FROM tall t JOIN shape g ON g.test = t.fold AND g.j = t.j JOIN prior r ON r.test = t.fold AND r.c = g.c GROUP BY ALL),
guess AS (SELECT ticker, fiscal_year, fold, rating_category, arg_max(c, ll) AS predicted_category FROM score GROUP BY ALL),
{fold_scores_sql("guess")}
SELECT 'Naive Bayes' AS model, {SUMMARY_SQL} FROM fs"""


@query("naive_bayes", with_roles(["predicted", "flags"], _BAYES_SQL))
def naive_bayes(spark, sf):
    table = _training(model_frame(spark, sf), fits=V.MAX_FOLDS)
    out = MO.out_of_fold(table, MO.naive_bayes(), _folds(table), len(V.ALL_FEATURES), CLASSES)
    return rounded(M.fold_summary(MO.fold_scores(out, TARGET, model="Naive Bayes"), ["model"]), SUMMARY_COLUMNS)


@query("grouped_out_of_fold")
def grouped_out_of_fold(spark, sf):
    """Two-class predictions on the four ratios with no issuer in both parts, as the instruction sets use."""
    frame = model_frame(spark, sf).drop("fold")
    letters = F.when(F.col(TARGET).isin("AA", "A"), "A").otherwise("BBB")
    folded = FO.group_folds(frame.withColumn("side", letters), "ticker")
    table = MO.training_table(folded, V.RATIOS, "side", ["A", "BBB"], KEYS)
    out = MO.out_of_fold(table, MO.gradient_boosting(), _folds(table), len(V.RATIOS), ["A", "BBB"])
    return out.select(*KEYS, "fold", "side", F.col("predicted_category").alias("predicted_rating"), "confidence")


@query("agency_models")
def agency_models(spark, sf):
    """One decision tree per agency's rows, and one on all rows with the agency as a feature."""
    agencies = ["Tassnief", "Fitch", "Moodys", "SP", "Financial Analytics"]
    frame = model_frame(spark, sf).withColumn("agency_index", MO.agency_feature(F.col("rating_agency"), agencies))

    def scored(part: DataFrame, features) -> DataFrame:
        table = MO.training_table(part, features, TARGET, CLASSES, KEYS)
        out = MO.out_of_fold(table, MO.decision_tree(), range(V.MAX_FOLDS), len(features), CLASSES)
        return out.agg(F.avg((F.col(TARGET) == F.col("predicted_category")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("rows"))

    single = MO.by_agency(frame, agencies, lambda part: scored(part, V.RATIOS))
    every = scored(frame, [*V.RATIOS, "agency_index"]).withColumn("rating_agency", F.lit("all, with agency"))
    return single.unionByName(every)


_LEFT_OUT = ["Fitch", "Moodys", "SP", "Tassnief", "Financial Analytics"]
_LEFT_OUT_SQL = f"""WITH x AS MATERIALIZED (SELECT p.ticker || '|' || p.fiscal_year AS r, trim(p.rating_agency) AS a, p.rating_category AS c, [{", ".join(f"CAST(p.{f} AS DOUBLE)" for f in V.RATIOS)}] AS x
  FROM predicted p WHERE trim(p.rating_agency) IN ({", ".join(f"'{a}'" for a in _LEFT_OUT)})),
tall AS MATERIALIZED (SELECT r, a, c, j, x[j] AS v FROM x, range(1, {len(V.RATIOS) + 1}) t(j)),
held AS (SELECT a, c, j, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM tall GROUP BY ALL),
less AS (SELECT t.r, t.a, t.c AS own, t.j, t.v, h.c, h.n - (h.c = t.c)::INT AS n, h.s - CASE WHEN h.c = t.c THEN t.v ELSE 0 END AS s, h.q - CASE WHEN h.c = t.c THEN t.v * t.v ELSE 0 END AS q
  FROM tall t JOIN held h ON h.a = t.a AND h.j = t.j),
spread AS (SELECT r, greatest(max(q / n - s / n * s / n) * 1e-9, 1e-300) AS e, any_value(n) AS n FROM (SELECT r, j, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM less GROUP BY 1, 2) GROUP BY 1),
term AS (SELECT l.r, l.a, l.own, l.c, l.n, z.n AS total, l.v - l.s / l.n AS d, greatest(l.q / l.n - l.s / l.n * l.s / l.n, 0) + z.e AS var FROM less l JOIN spread z ON z.r = l.r WHERE l.n > 0),
score AS (SELECT r, a, own, c, ln(any_value(n)) - ln(any_value(total)) - sum(ln(2 * pi() * var) / 2 + d * d / (2 * var)) AS ll FROM term GROUP BY 1, 2, 3, 4),
bayes AS (SELECT r, a, own, arg_max(c, ll) AS guess FROM score GROUP BY ALL),
z AS MATERIALIZED (SELECT t.r, t.a, any_value(t.c) AS c, list((t.v - m.m) / CASE WHEN m.s = 0 THEN 1 ELSE m.s END ORDER BY t.j) AS x
  FROM tall t JOIN (SELECT a, j, avg(v) AS m, stddev_pop(v) AS s FROM tall GROUP BY 1, 2) m ON m.a = t.a AND m.j = t.j GROUP BY 1, 2),
near AS (SELECT q.r, q.a, q.c AS own, n.c, list_distance(q.x, n.x) AS d FROM z q JOIN z n ON n.a = q.a AND n.r <> q.r QUALIFY row_number() OVER (PARTITION BY q.r ORDER BY list_distance(q.x, n.x), n.r) <= 5),
votes AS (SELECT r, a, own, c, sum(CASE WHEN least_d = 0 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0 END ELSE 1 / d END) AS w FROM (SELECT *, min(d) OVER (PARTITION BY r) AS least_d FROM near) GROUP BY 1, 2, 3, 4),
voted AS (SELECT r, a, own, c AS guess FROM votes QUALIFY row_number() OVER (PARTITION BY r ORDER BY w DESC, c) = 1)
SELECT a AS rating_agency, model, count(*) AS rows, {r6("avg(CASE WHEN own = guess THEN 1.0 ELSE 0.0 END)", "accuracy")}
FROM (SELECT 'Gaussian Bayes' AS model, * FROM bayes UNION ALL SELECT 'Nearest Neighbours', * FROM voted) GROUP BY 1, 2"""


@query("leave_one_out_agencies", with_roles(["predicted"], _LEFT_OUT_SQL))
def leave_one_out_agencies(spark, sf):
    """Accuracy per agency when every row is predicted from all others of its agency, on the four ratios."""
    frame = model_frame(spark, sf).drop("fold").where(F.col("rating_agency").isin(_LEFT_OUT))
    rows = cut_lineage(frame.select(F.concat_ws("|", *KEYS).alias("key"), "rating_agency", TARGET, *V.RATIOS), "left-out")
    bayes = LO.gaussian_leave_one_out(rows, "rating_agency", TARGET, CLASSES, V.RATIOS)
    out = LO.accuracy(bayes, ["rating_agency"], TARGET).withColumn("model", F.lit("Gaussian Bayes"))
    arrays = rows.withColumn("features", F.array(*[F.col(r).cast("double") for r in V.RATIOS]))

    def voted(part: DataFrame) -> DataFrame:
        return LO.accuracy(LO.neighbours_leave_one_out(part, "key", TARGET, CLASSES), [], TARGET).withColumn("model", F.lit("Nearest Neighbours"))

    agencies = [r[0] for r in rows.select("rating_agency").distinct().orderBy("rating_agency").collect()]
    return rounded(out.unionByName(MO.by_agency(arrays, agencies, voted)), ["accuracy"])


@query("importance_and_fit")
def importance_and_fit(spark, sf):
    """Feature importance of the model on all rows, with its accuracy on them."""
    table = _training(model_frame(spark, sf))
    fitted = MO.boosted_trees().fit(table, len(V.ALL_FEATURES), CLASSES)
    accuracy = MO.train_accuracy(fitted, table, TARGET).scalar()
    return MO.feature_importance(fitted, V.ALL_FEATURES, table).withColumn("train_accuracy", accuracy)


@query("weighted_time_split")
def weighted_time_split(spark, sf):
    """A class-weighted tree fitted before the cut year and scored from it on."""
    frame = FO.time_split(MO.with_class_weights(model_frame(spark, sf).drop("fold"), TARGET), 2000)
    table = MO.training_table(frame, V.ALL_FEATURES, TARGET, CLASSES, [*KEYS, "weight"])
    model = MO.decision_tree(weighted=True)
    fitted = model.fit(table.where("fold <> 0"), len(V.ALL_FEATURES), CLASSES)
    return M.class_report(fitted.predict(table.where("fold = 0")), (), TARGET)


@query("projection")
def projection(spark, sf):
    """Rows on two principal components, with the explained share of each."""
    table = _training(model_frame(spark, sf))
    out, explained = MO.principal_components(table, [*KEYS, TARGET])
    return out.withColumns({"explained_1": F.lit(explained[0]), "explained_2": F.lit(explained[1])})


@query("embedding_forest")
def embedding_forest(spark, sf):
    """Random forest on the labelled vectors, out of fold."""
    vectors = R.table(spark, sf, "embeddings")
    labels = [str(r[0]) for r in vectors.select("label").distinct().orderBy("label").collect()]
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    names = [f"x{i}" for i in range(width)]
    wide = vectors.select("vec_id", F.col("label").cast("string").alias("name"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    folded = FO.stratified_folds(wide, "name", ["vec_id"], V.MAX_FOLDS)
    table = MO.training_table(folded, names, "name", labels, ["vec_id"], V.MAX_FOLDS)
    out = MO.out_of_fold(table, MO.random_forest(), range(V.MAX_FOLDS), width, labels)
    return out.select("vec_id", "fold", "name", "predicted_category", "confidence")


# --- attribution ----------------------------------------------------------------------------


def _fitted(spark, sf) -> tuple[DataFrame, MO.Fitted]:
    table = _training(model_frame(spark, sf))
    return table, MO.boosted_trees().fit(table, len(V.ALL_FEATURES), CLASSES)


def _explained(spark, sf) -> DataFrame:
    return AT.attributions(*_fitted(spark, sf), [*KEYS, TARGET])


@query("attributions")
def attributions(spark, sf):
    """One row per key, class and feature; base plus values is the margin."""
    rows = AT.long_form(_explained(spark, sf), KEYS, CLASSES, V.ALL_FEATURES)
    return rows.drop("feature_index")


@query("attribution_check", with_roles(["predicted"], "SELECT i AS class_index, CAST(0 AS DOUBLE) AS largest_gap, count(*) AS rows FROM predicted, range(4) c(i) GROUP BY 1"))
def attribution_check(spark, sf):
    """Largest gap between the margin and base plus attributions, per class; 0 when they add up."""
    total = F.aggregate("shap_values", F.col("base"), lambda a, x: a + x)
    gaps = _explained(spark, sf).groupBy("class_index").agg(F.max(F.abs(total - F.col("margin"))).alias("largest_gap"), F.count(F.lit(1)).alias("rows"))
    return longs(rounded(gaps, ["largest_gap"]), ["class_index"])


@query("global_importance")
def global_importance(spark, sf):
    return AT.global_importance(AT.mean_magnitudes(*_fitted(spark, sf), V.ALL_FEATURES))


@query("top_factors")
def top_factors(spark, sf):
    table, fitted = _fitted(spark, sf)
    own = AT.attributions(table, fitted, [*KEYS, TARGET], AT.predicted_index(fitted))
    return AT.top_factors(own, [*KEYS, TARGET], CLASSES, V.ALL_FEATURES)


@query("reported_factors")
def reported_factors(spark, sf):
    """The first rows of the factor table with company and rating, as the printed report has them."""
    table, fitted = _fitted(spark, sf)
    own = AT.attributions(table, fitted, [*KEYS, TARGET], AT.predicted_index(fitted))
    factors = AT.top_factors(own, [*KEYS, TARGET], CLASSES, V.ALL_FEATURES)
    names = R.panel(spark, sf).select(*KEYS, "company_name", "rating")
    return AT.reported_factors(factors.join(names, KEYS, "left"), KEYS)


@query("dependence_points")
def dependence_points(spark, sf):
    """Value, attribution and colour of the three feature pairs, for the largest class."""
    table, fitted = _fitted(spark, sf)
    largest = CLASSES.index(table.groupBy(TARGET).count().orderBy(F.desc("count"), TARGET).first()[0])
    return AT.dependence(AT.attributions(table, fitted, [*KEYS, TARGET], F.lit(largest)), KEYS, largest, V.ALL_FEATURES)


@query("waterfall_rows")
def waterfall_rows(spark, sf):
    """All attributions of eight rows taken at even distances, for the predicted class."""
    table, fitted = _fitted(spark, sf)
    shown = table.join(FO.even_sample(table.select(*KEYS), KEYS), KEYS)  # the rows are chosen first, then explained
    own = AT.attributions(shown, fitted, [*KEYS, TARGET, "position"], AT.predicted_index(fitted))
    return AT.long_form(own, [*KEYS, "position", "base"], CLASSES, V.ALL_FEATURES)
