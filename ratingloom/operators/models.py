"""Training and evaluating classifiers on the panel with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.operators import boosting as B
from ratingloom.operators import extra_trees as ET
from ratingloom.operators import perceptron as PN
from ratingloom.operators.metrics import PREDICTED, fold_summary, rank_by, summary_scores
from ratingloom.session import cut_lineage

LABEL = "label"
#: Models whose fits of all folds share their jobs.
Together = B.Boosting | ET.ExtraTrees | PN.Perceptron
TOGETHER = (B.Boosting, ET.ExtraTrees, PN.Perceptron)
PARALLEL_FITS = 4
#: Folds of a forest or tree that a benchmark fits at a time: their growing trees are in the driver.
BENCHMARK_FOLDS = 2
#: Rows of a part of a training table, and of a part when there are parts for all cores.
PART_ROWS, FULL_PART_ROWS = 50_000, 200_000


def label_index(c: Column, classes: Sequence[str]) -> Column:
    """Position of a class in `classes`; alphabetical lists give the usual label encoding."""
    table = F.create_map(*[F.lit(x) for i, name in enumerate(classes) for x in (name, float(i))])
    return table[c]


def class_name(c: Column, classes: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in classes]), c.cast("int"))


def assemble(df: DataFrame, features: Sequence[str], target: str, classes: Sequence[str]) -> DataFrame:
    """Adds the feature vector and the label index."""
    indexed = df.withColumn(LABEL, label_index(F.col(target).cast("string"), classes))
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(indexed)


# --- fitted classifiers ---------------------------------------------------------------------


@dataclass
class Fitted:
    """Fitted parts and how to turn them into one probability array per row."""

    classes: list[str]
    parts: list[Transformer]
    probabilities: Callable[[DataFrame, list[Transformer]], DataFrame]

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds probabilities, confidence (the largest) and predicted_category (first on ties)."""
        return B.with_best(self.probabilities(df, self.parts), self.classes)

    def importances(self):
        """Gain importance of each feature, averaged over per-class members."""
        return sum(p.featureImportances.toArray() for p in self.parts) / len(self.parts)


def _added(df: DataFrame, part: Transformer, pick: Column, name: str) -> DataFrame:
    """`df` with one value taken from the part's output, nothing else of it."""
    scored = part.transform(df)
    return scored.select(*df.columns, pick.alias(name))


def _from_probability(df: DataFrame, parts: list[Transformer]) -> DataFrame:
    return _added(df, parts[0], vector_to_array("probability"), "probabilities")


def _one_against_rest(value: Column) -> Callable[[DataFrame, list[Transformer]], DataFrame]:
    """Per-class positive shares, divided by their sum."""

    def combined(df: DataFrame, parts: list[Transformer]) -> DataFrame:
        out = df
        for i, part in enumerate(parts):
            out = _added(out, part, value, f"_p{i}")
        shares = F.array(*[F.col(f"_p{i}") for i in range(len(parts))])
        total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
        even = F.lit(1.0 / len(parts))
        scaled = F.transform(shares, lambda x: F.coalesce(F.try_divide(x, total), even))
        return out.withColumn("probabilities", scaled).select(*df.columns, "probabilities")

    return combined


@dataclass
class Model:
    """A classifier to fit: one estimator for all classes, or one per class."""

    name: str
    make: Callable[[int, int], Estimator]  # (features, classes) -> estimator
    per_class: bool = False
    value: str = "probability"  # per class: "probability" or "margin"
    note: str = ""
    extra: dict = field(default_factory=dict)
    jobs: str = "few"  # of a fit: "few" with large results, or "many" with small ones

    def fit(self, train: DataFrame, n_features: int, classes: Sequence[str]) -> Fitted:
        classes = list(classes)
        estimator = self.make(n_features, len(classes))
        if not self.per_class:
            return Fitted(classes, [estimator.fit(train)], _from_probability)
        columns = [c for c in ("features", "weight") if c in train.columns]

        def one(i: int) -> Transformer:
            target = (F.col(LABEL) == float(i)).cast("double").alias(LABEL)
            return self.make(n_features, len(classes)).fit(train.select(*columns, target))

        with ThreadPoolExecutor(min(PARALLEL_FITS, len(classes))) as pool:
            parts = list(pool.map(one, range(len(classes))))
        if self.value == "probability":
            pick = F.get(vector_to_array("probability"), F.lit(1))
        else:
            pick = 1 / (1 + F.exp(-F.get(vector_to_array("rawPrediction"), F.lit(1))))
        return Fitted(classes, parts, _one_against_rest(pick))


def _scaled(estimator: Estimator) -> Estimator:
    """Standardised features in front of an estimator that reads `scaled`."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, estimator])


def boosted_trees(rounds: int = V.BOOSTING["rounds"]) -> B.Boosting:
    """Second-order boosting on the softmax loss."""
    return B.Boosting("Boosted Trees", B.SECOND_ORDER, rounds)


def gradient_boosting(rounds: int = V.BOOSTING["rounds"]) -> B.Boosting:
    """Trees fitted to the residuals of the softmax loss, leaves by one Newton step, from the class shares on."""
    return B.Boosting("Gradient Boosting", B.RESIDUALS, rounds)


def random_forest(trees: int = V.FOREST["trees"], seed: int = V.BOOSTING["seed"]) -> Model:
    return Model(
        "Random Forest",
        lambda f, k: RandomForestClassifier(
            labelCol=LABEL, numTrees=trees, maxDepth=V.FOREST["depth"], minInstancesPerNode=V.FOREST["min_leaf"],
            featureSubsetStrategy="sqrt", seed=seed,
        ),
    )


def extra_trees(trees: int = V.FOREST["trees"]) -> ET.ExtraTrees:
    """Trees on the whole sample whose cuts are drawn at random."""
    return ET.ExtraTrees(trees=trees)


def decision_tree(seed: int = V.BOOSTING["seed"], weighted: bool = False) -> Model:
    """With `weighted` rows count by their `weight` column."""
    weight = {"weightCol": "weight"} if weighted else {}
    return Model(
        "Decision Tree",
        lambda f, k: DecisionTreeClassifier(
            labelCol=LABEL, maxDepth=V.SINGLE_TREE["depth"], minInstancesPerNode=V.SINGLE_TREE["min_leaf"], seed=seed, **weight
        ),
    )


def logistic_regression(rows: int, iterations: int = V.ITERATIONS["logistic"]) -> Model:
    """Unit penalty on the sum of losses, which is 1/rows on Spark's mean loss."""
    return Model(
        "Logistic Regression",
        lambda f, k: _scaled(
            LogisticRegression(
                featuresCol="scaled", labelCol=LABEL, family="multinomial", regParam=1.0 / max(rows, 1),
                maxIter=iterations, standardization=False,
            )
        ),
        jobs="many",
    )


def linear_svc(rows: int, iterations: int = V.ITERATIONS["svc"]) -> Model:
    return Model(
        "Linear SVC",
        lambda f, k: _scaled(
            LinearSVC(featuresCol="scaled", labelCol=LABEL, regParam=1.0 / max(rows, 1), maxIter=iterations, standardization=False)
        ),
        per_class=True,
        value="margin",
        note="hinge loss, one against the rest",
        jobs="many",
    )


def perceptron(epochs: int = V.ITERATIONS["perceptron"]) -> PN.Perceptron:
    return PN.Perceptron(epochs=epochs)


def naive_bayes() -> Model:
    return Model("Naive Bayes", lambda f, k: NaiveBayes(labelCol=LABEL, modelType="gaussian"))


def benchmark_models(rows: int, rounds: int = V.BOOSTING["rounds"], trees: int = V.FOREST["trees"], iterations: Mapping[str, int] = V.ITERATIONS) -> list[Model]:
    """The benchmark's models but the neighbour one, which has its own operator."""
    return [
        boosted_trees(rounds),
        gradient_boosting(rounds),
        random_forest(trees),
        extra_trees(trees),
        decision_tree(),
        logistic_regression(rows, iterations["logistic"]),
        linear_svc(rows, iterations["svc"]),
        perceptron(iterations["perceptron"]),
    ]


# --- evaluation -----------------------------------------------------------------------------


def training_table(
    df: DataFrame, features: Sequence[str], target: str, classes: Sequence[str], carry: Sequence[str], fits: int = 1
) -> DataFrame:
    """Vectors, labels, folds and carried columns as a table, read by every fit.

    The table has as many parts as its rows fill, so that the many small jobs of a
    fit do not each start a task per core for a few rows. Each part costs a pass over all
    sums of a level or an iteration (for a forest, those of all nodes are sent), so once the
    parts of the `fits` that run side by side occupy every core, parts grow before there are more of them.
    """
    columns = [*dict.fromkeys([*carry, target]), LABEL, "features"]
    made = assemble(df, features, target, classes)
    made = made.select(*columns, *[c for c in ("fold",) if c in df.columns and c not in columns])
    return cut_lineage(made.coalesce(part_count(made.count(), df.sparkSession.sparkContext.defaultParallelism, fits)), "training")


def part_count(rows: int, cores: int, fits: int) -> int:
    """Parts of a table of some rows that several fits read at the same time."""
    return max(1, min(-(-rows // PART_ROWS), max(-(-cores // fits), -(-rows // FULL_PART_ROWS))))


def out_of_fold(
    table: DataFrame, model: Model | Together, folds: Sequence[int], n_features: int, classes: Sequence[str], parallel: int = V.MAX_FOLDS
) -> DataFrame:
    """Predictions of every row by the model fitted on the other folds."""
    if isinstance(model, TOGETHER):  # all folds at once
        return model.out_of_fold(table, folds, n_features, classes)

    def one(fold: int) -> DataFrame:
        fitted = model.fit(table.where(F.col("fold") != fold), n_features, classes)
        return fitted.predict(table.where(F.col("fold") == fold))

    with ThreadPoolExecutor(min(parallel, len(folds))) as pool:
        parts = list(pool.map(one, folds))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold_scores(predictions: DataFrame, target: str, **tags: str) -> DataFrame:
    """Accuracy and F1 per fold, tagged with constant columns."""
    scores = summary_scores(predictions, ["fold"], target, PREDICTED)
    return scores.withColumns({k: F.lit(v) for k, v in tags.items()}) if tags else scores


def ablation(
    df: DataFrame, blocks: Mapping[str, Sequence[str]], target: str, classes: Sequence[str], folds: Sequence[int],
    model: B.Boosting | None = None,
) -> DataFrame:
    """Fold mean and deviation per feature block, over the same folds, best first.

    The models of all blocks and folds grow together.
    """
    model = model or boosted_trees()
    features, columns = _numbered(blocks)
    table = training_table(df, features, target, classes, ["fold"])
    predicted = model.blocks_out_of_fold(table, columns, folds, len(features), classes)
    sizes = F.create_map(*[F.lit(x) for name, own in blocks.items() for x in (name, len(own))])
    scores = summary_scores(predicted, ["block", "fold"], target, PREDICTED).withColumn("n_features", sizes[F.col("block")])
    return rank_by(fold_summary(scores, ["block", "n_features"]), "accuracy_mean", "block")


def _numbered(blocks: Mapping[str, Sequence[str]]) -> tuple[list[str], dict[str, list[int]]]:
    """The features of all blocks, and each block as their numbers."""
    features = list(dict.fromkeys(f for own in blocks.values() for f in own))
    return features, {name: [features.index(f) for f in own] for name, own in blocks.items()}


def benchmark(
    table: DataFrame, models: Sequence[Model | Together], target: str, n_features: int, classes: Sequence[str], folds: Sequence[int],
    extra: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Fold mean and deviation per model, best first; `extra` adds predictions made elsewhere.

    A model's predictions are stored as soon as it is fitted, so that the driver does not hold
    the models of all folds, nor one plan with all of them, until the last one is there. Fits are many
    short jobs, so those of several models fill the cluster together; models of the most jobs come
    first, since their fits, all folds at a time, last longest. A task of theirs waits longer than it takes,
    so they read as few parts as give every core one. Predictions made elsewhere are stored last.
    """
    out, rows, cores = None, table.count(), table.sparkSession.sparkContext.defaultParallelism

    def stored(predictions: DataFrame) -> DataFrame:
        return cut_lineage(predictions.select("fold", target, PREDICTED), "benchmarked")

    def made(model: Model | Together) -> DataFrame:
        if getattr(model, "jobs", "") == "many":
            own = table.coalesce(part_count(rows, cores, len(folds) * (len(classes) if model.per_class else 1)))
            return stored(out_of_fold(own, model, folds, n_features, classes))
        return stored(out_of_fold(table, model, folds, n_features, classes, BENCHMARK_FOLDS))

    turns = {"many": 0, "few": 2}
    with ThreadPoolExecutor(min(PARALLEL_FITS, len(models))) as pool:
        fits = {m.name: pool.submit(made, m) for m in sorted(models, key=lambda m: turns.get(getattr(m, "jobs", ""), 1))}
        elsewhere = {name: pool.submit(stored, p) for name, p in (extra or {}).items()}
    predicted = {m.name: fits[m.name].result() for m in models} | {name: p.result() for name, p in elsewhere.items()}
    for name, p in predicted.items():
        scores = fold_scores(p, target, model=name)
        out = scores if out is None else out.unionByName(scores)
    return rank_by(fold_summary(out, ["model"]), "accuracy_mean", "model")


def feature_importance(fitted: Fitted | B.Boosted, features: Sequence[str], like: DataFrame) -> DataFrame:
    """Gain importance per feature, most important first."""
    rows = [(f, float(v)) for f, v in zip(features, fitted.importances())]
    made = like.sparkSession.createDataFrame(rows, "feature string, importance double")
    return rank_by(made, "importance", "feature")


def top_features(
    df: DataFrame, blocks: Mapping[str, Sequence[str]], target: str, classes: Sequence[str], model: Model | B.Boosting | None = None, n: int = V.TOP_FEATURES
) -> DataFrame:
    """The n most important features of each block's model, fitted on all rows; boosted models of all blocks grow together."""
    model = model or boosted_trees()
    features, columns = _numbered(blocks)
    if isinstance(model, B.Boosting):
        table = training_table(df, features, target, classes, ())
        models = model.fit_all(table, [B.Fit(tuple(own)) for own in columns.values()], len(features), classes)
        fitted = [(name, features, m, table) for name, m in zip(blocks, models)]
    else:
        tables = {name: training_table(df, own, target, classes, ()) for name, own in blocks.items()}
        fitted = [(name, own, model.fit(tables[name], len(own), classes), tables[name]) for name, own in blocks.items()]
    out = None
    for name, own, made, table in fitted:
        ranked = feature_importance(made, own, table).where(F.col("feature").isin(list(blocks[name])))
        part = ranked.where(F.col("rank") <= n).withColumn("block", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def train_accuracy(fitted: Fitted | B.Boosted, table: DataFrame, target: str) -> DataFrame:
    """Share of training rows the model gets right."""
    return fitted.predict(table).agg(F.avg((F.col(target) == F.col(PREDICTED)).cast("double")).alias("train_accuracy"))


def with_class_weights(df: DataFrame, target: str) -> DataFrame:
    """Adds `weight` = rows / (classes * rows of the class)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    kinds = counts.agg(F.count(F.lit(1))).scalar()
    weights = counts.select(target, (total / (kinds * F.col("_n"))).alias("weight"))
    return df.join(weights, target)


def by_agency(
    df: DataFrame, agencies: Sequence[str], evaluate: Callable[[DataFrame], DataFrame], agency: str = "rating_agency"
) -> DataFrame:
    """One evaluation per agency's rows, tagged with the agency."""
    out = None
    for name in agencies:
        scores = evaluate(df.where(F.col(agency) == name)).withColumn(agency, F.lit(name))
        out = scores if out is None else out.unionByName(scores)
    return out


def agency_feature(c: Column, agencies: Sequence[str]) -> Column:
    """The agency's position as a numeric feature, -1 for others."""
    return F.coalesce(label_index(c, agencies), F.lit(-1.0))


# --- projection -----------------------------------------------------------------------------


def principal_components(table: DataFrame, keep: Sequence[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """Rows on the first components of standardised features, and explained shares.

    Spark's scaler divides by the sample deviation; coordinates are rescaled to
    the population one. Each component points to its largest loading.
    """
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    scaled = scaler.fit(table).transform(table)
    pca = PCA(k=k, inputCol="scaled", outputCol="projected").fit(scaled)
    loadings = pca.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    n = table.count()
    stretch = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
    place = vector_to_array("projected")
    out = pca.transform(scaled).select(
        *keep, *[(F.get(place, F.lit(j)) * (signs[j] * stretch)).alias(f"pc{j + 1}") for j in range(k)]
    )
    return out, [float(x) for x in pca.explainedVariance]
