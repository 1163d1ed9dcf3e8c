import itertools
import math
import threading
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratingloom.operators import attribution as AT
from ratingloom.operators import folds as FO
from ratingloom.operators import metrics as M
from ratingloom.operators import models as MO
from ratingloom.operators import neighbours as NB
from ratingloom.operators import profiles as PR


@pytest.mark.parametrize("smallest, expected", [(1, 2), (2, 2), (4, 4), (6, 5)])
def test_fold_count(spark, smallest, expected):
    df = spark.createDataFrame([("a",)] * smallest + [("b",)] * 9, "label string")
    assert FO.fold_count(df, "label") == expected
    assert FO.fold_count(df, "label", at_least=0) == min(5, smallest)


def test_stratified_folds_are_even_and_stable(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "big").otherwise("small").alias("label"))
    first = FO.stratified_folds(df.repartition(1), "label", ["id"], 5)
    again = FO.stratified_folds(df.repartition(40), "label", ["id"], 5)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    sizes = [r["count"] for r in first.groupBy("label", "fold").count().collect()]
    assert sorted(sizes) == [60] * 5 + [140] * 5


def greedy(sizes, folds):
    """One group after another, largest first, to the fold with the fewest rows."""
    loads, out = [0] * folds, {}
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        fold = loads.index(min(loads))
        loads[fold] += n
        out[name] = fold
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(1, 6))
def test_dealing_by_size_equals_one_after_another(sizes, folds):
    named = {f"g{i:03d}": n for i, n in enumerate(sizes)}
    expected, counts = greedy(named, folds), Counter(sizes)
    rows = FO.dealt(sorted(counts.items(), reverse=True), folds)
    got = {}
    for size in counts:
        for rank, name in enumerate(sorted(k for k, n in named.items() if n == size)):
            [(_, first, _, cycle)] = [r for r in rows if r[0] == size and r[1] <= rank < r[2]]
            got[name] = cycle[(rank - first) % len(cycle)]
    assert got == expected


def test_dealing_many_groups_needs_few_rows():
    assert len(FO.dealt([(10**9, 3), (7, 10**12), (1, 10**12)], 5)) < 60


def test_group_folds_are_the_greedy_ones(spark):
    df = spark.range(2400).select(F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 500 * F.col("id") % 313).cast("string"))).alias("ticker"))
    sizes = {r["ticker"]: r["count"] for r in df.groupBy("ticker").count().collect()}
    got = {(r["ticker"], r["fold"]) for r in FO.group_folds(df, "ticker", 5).collect()}
    assert got == set(greedy(sizes, 5).items())


def test_leave_one_out_has_no_limit(spark):
    got = FO.leave_one_out_folds(spark.range(30_000), ["id"])
    assert sorted(r["fold"] for r in got.collect()) == list(range(30_000))


PAIRS = [("A", "A")] * 14 + [("A", "BB")] * 2 + [("A", "BBB")] * 2 + [("AA", "AA")] * 6 + [("BB", "A")] * 4 + [("BB", "BBB")] * 2 + [("BBB", "A")] * 2 + [("BBB", "AA")] * 2 + [("BBB", "BBB")] * 11


def test_metrics_of_a_published_matrix(spark):
    df = spark.createDataFrame(PAIRS, "rating_category string, predicted_category string")
    wide = {r["actual"]: tuple(r)[1:] for r in M.confusion_wide(df).collect()}
    assert wide == {"A": (14, 0, 2, 2), "AA": (0, 6, 0, 0), "BB": (4, 0, 0, 2), "BBB": (2, 2, 0, 11)}
    scores = M.summary_scores(df).first()
    assert abs(scores["accuracy"] - 31 / 45) < 1e-12
    f1 = {"A": 28 / 38, "AA": 12 / 14, "BB": 0.0, "BBB": 22 / 30}
    assert abs(scores["f1_macro"] - sum(f1.values()) / 4) < 1e-12
    assert [tuple(r) for r in M.error_pairs(df).limit(1).collect()] == [("BB → A", 4)]
    assert M.misclassified(df).count() == 14


def test_classes_without_rows_are_shown(spark):
    df = spark.createDataFrame([("A", "A")], "rating_category string, predicted_category string")
    assert M.confusion(df).count() == 16 and M.confusion(df).agg(F.sum("n")).first()[0] == 1
    assert [tuple(r) for r in PR.class_balance(df).orderBy("class_index").collect()] == [(0, "A", 1), (1, "AA", 0), (2, "BB", 0), (3, "BBB", 0)]


def test_rank_correlation_with_ties(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, 300), rng.integers(0, 6, 300)
    y = np.where(rng.random(300) < 0.6, x, y)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x int, y int")
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert abs(M.spearman(df, "x", "y").first()[0] - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-12


def test_histogram_closes_on_the_right(spark):
    df = spark.createDataFrame([(x / 12,) for x in range(13)], "confidence double")
    got = [r["rows"] for r in PR.confidence_histogram(df).orderBy("bin").collect()]
    assert sum(got) == 13 and got == list(np.histogram([x / 12 for x in range(13)], bins=12)[0])
    same = spark.createDataFrame([(0.5,)] * 3, "confidence double")
    assert sum(r["rows"] for r in PR.confidence_histogram(same).collect()) == 3


def test_even_sample(spark):
    assert sorted(r["position"] for r in FO.even_sample(spark.range(45), ["id"]).collect()) == [int(x) for x in np.linspace(0, 44, 8)]
    assert FO.even_sample(spark.range(3), ["id"]).count() == 3


# --- neighbours -----------------------------------------------------------------------------


def brute_force(train, test, k):
    out = {}
    for q, qx in test:
        d = sorted((math.dist(qx, tx), t) for t, tx in train)
        out[q] = [t for _, t in d[:k]]
    return out


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 3)) * 8
    points = [tuple(map(float, centres[0 if i % 3 == 0 else i % 6] + rng.normal(size=3))) for i in range(400)]  # one crowded cluster
    points[10] = points[11]
    rows = [(i, int(i % 4), list(p)) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "id int, label int, features array<double>")
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    expected = brute_force([(i, x) for i, _, x in rows if i % 4], [(i, x) for i, _, x in rows if i % 4 == 0], 5)
    for pivots, block in ((1, 1000), (12, 16)):
        got = NB.nearest(train, test, "id", "label", 5, block_rows=block, pivots=pivots)
        assert {r["id"]: [n["key"] for n in r["neighbours"]] for r in got.collect()} == expected


def test_votes(spark):
    schema = "id int, neighbours array<struct<distance:double,key:int,label:string>>"
    df = spark.createDataFrame([(1, [(1.0, 1, "b"), (1.0, 2, "a"), (4.0, 3, "b")]), (2, [(0.0, 1, "a"), (0.1, 2, "b"), (0.1, 3, "b")]), (3, [(2.0, 1, "b"), (2.0, 2, "a")])], schema)
    got = {r["id"]: (r["predicted_category"], round(r["confidence"], 6)) for r in NB.vote(df, ["a", "b"]).collect()}
    assert got == {1: ("b", round(1.25 / 2.25, 6)), 2: ("a", 1.0), 3: ("a", 0.5)}


# --- models ---------------------------------------------------------------------------------


def game_value(row, known, leaves):
    total = 0.0
    for value, path in leaves:
        part = value
        for f, lo, hi, share in path:
            part *= float(lo < row[f] <= hi) if f in known else share
        total += part
    return total


def test_shapley_equals_all_coalitions():
    rng = np.random.default_rng(2)
    leaves = []
    for _ in range(30):
        chosen = rng.choice(4, rng.integers(1, 4), replace=False)
        leaves.append((float(rng.normal()), [(int(f), -np.inf if rng.random() < 0.5 else -0.3, float(rng.normal()), float(rng.random())) for f in chosen]))
    x = rng.normal(size=(5, 4))
    got = AT.shapley_values(x, leaves)
    for row, values in zip(x, got):
        for i in range(4):
            others = [j for j in range(4) if j != i]
            exact = sum(
                math.factorial(size) * math.factorial(3 - size) / math.factorial(4) * (game_value(row, {*s, i}, leaves) - game_value(row, set(s), leaves))
                for size in range(4)
                for s in itertools.combinations(others, size)
            )
            assert abs(values[i] - exact) < 1e-12


@pytest.fixture(scope="module")
def training(spark):
    df = spark.range(240).select(
        "id", *[F.rand(i).alias(f"x{i}") for i in range(3)], F.when(F.col("id") < 0, 1).otherwise(0).alias("none")
    )
    name = F.when(F.col("x0") > 0.6, "a").when(F.col("x1") > 0.5, "b").otherwise("c")
    folded = FO.stratified_folds(df.withColumn("name", name), "name", ["id"], 3)
    return MO.training_table(folded, ["x0", "x1", "x2"], "name", ["a", "b", "c"], ["id"])


def test_attributions_add_up(training):
    fitted = MO.boosted_trees(rounds=5).fit(training, 3, ["a", "b", "c"])
    explained = AT.attributions(training, fitted, ["id", "name"])
    gaps = [abs(r["base"] + sum(r["shap_values"]) - r["margin"]) for r in explained.collect()]
    assert len(gaps) == 720 and max(gaps) < 1e-9
    long = AT.long_form(explained, ["id"], ["a", "b", "c"], ["x0", "x1", "x2"])
    means = {r["feature"]: r["mean_abs_shap"] for r in long.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap")).collect()}
    ranked = AT.global_importance(AT.mean_magnitudes(training, fitted, ["x0", "x1", "x2"])).orderBy("rank").collect()
    assert ranked[-1]["feature"] == "x2" and all(abs(r["mean_abs_shap"] - means[r["feature"]]) < 1e-12 for r in ranked)
    own = AT.attributions(training, fitted, ["id", "name"], AT.predicted_index(fitted))
    assert own.count() == 240 and own.where(MO.class_name(F.col("class_index"), ["a", "b", "c"]) != F.col("predicted_category")).count() == 0
    factors = AT.top_factors(explained, ["id"], ["a", "b", "c"], ["x0", "x1", "x2"])
    assert factors.count() == 240
    assert [r["id"] for r in AT.reported_factors(factors, ["id"]).collect()] == list(range(25))
    assert AT.dependence(explained, ["id"], 0, ["x0", "x1", "x2"], [("x0", "x1")]).count() == 240


def test_top_features_per_block(spark):
    df = spark.range(200).select("id", *[F.rand(i).alias(f"x{i}") for i in range(4)]).withColumn("name", F.when(F.col("x1") > 0.5, "a").otherwise("b"))
    got = MO.top_features(df, {"all": ["x0", "x1", "x2", "x3"], "pair": ["x0", "x2"]}, "name", ["a", "b"], MO.decision_tree()).collect()
    assert sorted((r["block"], r["rank"]) for r in got) == [("all", 1), ("all", 2), ("all", 3), ("pair", 1), ("pair", 2)]
    assert [r["feature"] for r in got if r["block"] == "all" and r["rank"] == 1] == ["x1"]


@pytest.mark.parametrize("model", [MO.boosted_trees(5), MO.decision_tree(), MO.logistic_regression(160, 50), MO.linear_svc(160, 30), MO.naive_bayes()], ids=lambda m: m.name)
def test_out_of_fold_predictions(training, model):
    got = MO.out_of_fold(training, model, [0, 1, 2], 3, ["a", "b", "c"])
    rows = got.collect()
    assert sorted(r["id"] for r in rows) == list(range(240))
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 and r["confidence"] == max(r["probabilities"]) for r in rows)
    assert sum(r["name"] == r["predicted_category"] for r in rows) / 240 > 0.6


def test_projection(training):
    out, explained = MO.principal_components(training, ["id"])
    x = np.array([r["features"].toArray() for r in training.orderBy("id").collect()])
    z = (x - x.mean(0)) / x.std(0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    got = np.array([[r["pc1"], r["pc2"]] for r in out.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(z @ vt[:2].T), atol=1e-8)
    assert np.allclose(explained, (s**2 / (s**2).sum())[:2], atol=1e-8)


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "name string")
    got = {r["name"]: r["weight"] for r in MO.with_class_weights(df, "name").distinct().collect()}
    assert got == {"a": 4 / 6, "b": 2.0}


def test_groups_whose_names_begin_alike_are_cut_into_buckets(spark, monkeypatch):
    groups = spark.range(500).select(F.concat(F.lit("the same beginning "), F.lpad(F.col("id").cast("string"), 4, "0")).alias("g"))
    assert FO.prefix_length(groups, "g", 1000) == 3 and FO.prefix_length(groups, "g", 20) == 23 and FO.prefix_length(groups.where("false"), "g") == 1
    plain = {r["g"]: r["fold"] for r in FO.group_folds(groups, "g", 4).collect()}
    monkeypatch.setattr(FO, "BUCKET_ROWS", 20)
    monkeypatch.setattr(FO.prefix_length, "__defaults__", (20,))
    assert {r["g"]: r["fold"] for r in FO.group_folds(groups, "g", 4).collect()} == plain


def test_benchmark_keeps_no_model_in_its_plan(training):
    """Predictions of a fitted model are stored before the next one, so the scores' plan only reads tables."""
    out = MO.benchmark(training, [MO.decision_tree(), MO.naive_bayes()], "name", 3, ["a", "b", "c"], [0, 1])
    assert "UDF" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["model"] for r in out.collect()} == {"Decision Tree", "Naive Bayes"}


def test_parts_grow_once_the_fits_occupy_every_core(spark, monkeypatch):
    """Of 1,000 rows in parts of 50 there were 20 parts, whatever the number of fits that read them."""
    monkeypatch.setattr(MO, "PART_ROWS", 50)
    monkeypatch.setattr(MO, "FULL_PART_ROWS", 500)
    df = spark.range(0, 1000, 1, 40).selectExpr("id", "id * 1.0D AS x", "cast(id % 2 AS string) AS name", "cast(id % 5 AS int) AS fold")
    table = MO.training_table(df, ["x"], "name", ["0", "1"], ["id"], fits=5)
    assert table.count() == 1000
    assert len(table.inputFiles()) == max(-(-spark.sparkContext.defaultParallelism // 5), 2)


def test_parts_of_small_and_large_tables():
    assert [MO.part_count(n, 12, 5) for n in (0, 14_000, 140_000, 720_000, 5_000_000)] == [1, 1, 3, 4, 25]
    assert MO.part_count(840_000, 12, 1) == 12


def test_all_folds_are_fitted_at_the_same_time(spark):
    meet = threading.Barrier(5)

    class Waits:
        def fit(self, train, n_features, classes):
            meet.wait(20)  # breaks unless the other folds are being fitted
            return self

        def predict(self, df):
            return df

    table = spark.range(50).selectExpr("id", "cast(id % 5 AS int) AS fold")
    assert MO.out_of_fold(table, Waits(), range(5), 1, ["a"]).count() == 50


def test_a_benchmark_fits_all_folds_of_its_longest_models_at_once(training):
    """Two folds at a time, and the models in the given order, left the longest one for the end."""
    meet, begun = threading.Barrier(4), []

    class Waits(MO.Model):
        def fit(self, train, n_features, classes):
            begun.append(self.name)
            if self.jobs == "many":
                meet.wait(60)  # breaks unless the other folds are being fitted
            return super().fit(train, n_features, classes)

    make = MO.decision_tree().make
    models = [Waits(f"few {i}", make) for i in range(4)] + [Waits("many", make, jobs="many")]
    neighbours = training.select("fold", "name", F.lit("a").alias("predicted_category"))
    out = MO.benchmark(training.withColumn("fold", F.pmod("id", F.lit(4)).cast("int")), models, "name", 3, ["a", "b", "c"], range(4), {"neighbours": neighbours})
    assert {r["model"] for r in out.collect()} == {m.name for m in models} | {"neighbours"}
    assert "many" in begun[:10] and len(begun) == 20
    assert {m.jobs for m in MO.benchmark_models(100) if m.name in ("Linear SVC", "Logistic Regression")} == {"many"}


def test_a_benchmark_gives_the_models_of_many_jobs_few_parts(training, monkeypatch):
    parts = {}

    class Sees(MO.Model):
        def fit(self, train, n_features, classes):
            parts[self.name] = train.rdd.getNumPartitions()
            return super().fit(train, n_features, classes)

    make, table = MO.decision_tree().make, training.repartition(6).withColumn("fold", F.pmod("id", F.lit(4)).cast("int"))
    MO.benchmark(table, [Sees("few", make), Sees("many", make, jobs="many")], "name", 3, ["a", "b", "c"], range(4))
    assert parts == {"few": 6, "many": 1}
