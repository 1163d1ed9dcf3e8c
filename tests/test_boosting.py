"""Histogram boosting against a plain grower, and its invariants."""

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ratingloom.operators import boosting as B


def plain_tree(bins, g, h, cuts, features, rule, classes, depth, rate):
    """One tree on float sums: (values per row, [(node, feature, cut)])."""
    values, splits = np.zeros(len(bins)), []

    def leaf(rows):
        return rate * float(rule.value(np.array([g[rows].sum(), h[rows].sum(), len(rows) / B.UNIT]) * B.UNIT, classes))

    def split(rows, node, level):
        best = (rule.least_gain, None)
        if level < depth:
            for f in features:
                for cut in range(len(cuts[f])):
                    left = rows[bins[rows, f] <= cut]
                    right = rows[bins[rows, f] > cut]
                    if not len(left) or not len(right):
                        continue
                    sums = [np.array([g[r].sum() * B.UNIT, h[r].sum() * B.UNIT, len(r)]) for r in (left, right)]
                    gain = float(rule.gain(*sums))
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, cut, left, right))
        if best[1] is None:
            values[rows] = leaf(rows)
            return
        f, cut, left, right = best[1]
        splits.append((node, f, cut))
        split(left, 2 * node + 1, level + 1)
        split(right, 2 * node + 2, level + 1)

    split(np.arange(len(bins)), 0, 0)
    return values, sorted(splits)


def plain_margins(x, y, classes, cuts, features, rule, rounds, depth=3, rate=0.1):
    bins = B.binned(x, cuts)
    margins = np.tile(rule.start(np.bincount(y, minlength=classes)), (len(x), 1))
    every = []
    for _ in range(rounds):
        p = B.softmax(margins)
        grown = []
        for k in range(classes):
            g = p[:, k] - (y == k)
            values, splits = plain_tree(bins, g, rule.curvature(p[:, k], g), cuts, features, rule, classes, depth, rate)
            grown.append(values)
            every.append(splits)
        margins = margins + np.stack(grown, axis=1)
    return margins, every


@pytest.fixture(scope="module")
def data():
    chance = np.random.default_rng(4)
    x = np.column_stack([chance.normal(size=300), chance.normal(size=300), chance.integers(0, 2, 300), chance.integers(0, 4, 300).astype(float)])
    y = np.where(x[:, 0] + 0.5 * x[:, 2] > 0.7, 0, np.where(x[:, 1] * x[:, 0] > 0.1, 1, 2))
    y[chance.random(300) < 0.1] = 2
    return x, y


@pytest.fixture(scope="module")
def table(spark, data):
    x, y = data
    rows = [(i, *map(float, r), float(k), i % 3) for i, (r, k) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label double, fold int").repartition(3)
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df)


@pytest.mark.parametrize("rule", [B.SECOND_ORDER, B.RESIDUALS], ids=["second order", "residuals"])
def test_equals_plain_grower(data, table, rule):
    x, y = data
    fits = [B.Fit((0, 1, 2, 3)), B.Fit((1, 3)), B.Fit((0, 1, 2, 3), 1)]
    cuts, start, trees = B.grow(table, fits, 4, 3, rule, 7)
    for fit, s, t in zip(fits, start, trees):
        mine = np.arange(300) % 3 != fit.held_out if fit.held_out is not None else np.ones(300, bool)
        margins, splits = plain_margins(x[mine], y[mine], 3, cuts, fit.features, rule, 7)
        got = s + t.margins(B.binned(x[mine], cuts))
        assert np.abs(got - margins).max() < 1e-6
        grown = [sorted((n, int(f), int(t.cut[r, k, n])) for n, f in enumerate(t.feature[r, k]) if f >= 0) for r in range(7) for k in range(3)]
        assert grown == splits


def test_any_partitioning_gives_the_same_trees(table, monkeypatch):
    _, _, (first,) = B.grow(table, [B.Fit((0, 1, 2, 3))], 4, 3, B.SECOND_ORDER, 4)
    monkeypatch.setattr(B, "SMALL_PART", 40)
    monkeypatch.setattr(B, "STORED_ROUNDS", 1)
    _, _, (second,) = B.grow(table.repartition(7), [B.Fit((0, 1, 2, 3))], 4, 3, B.SECOND_ORDER, 4)
    assert (first.feature == second.feature).all() and (first.cut == second.cut).all() and np.allclose(first.value, second.value, rtol=0, atol=1e-9)


def test_out_of_fold_models_do_not_see_their_fold(table):
    model = B.Boosting("b", B.SECOND_ORDER, 3)
    got = model.out_of_fold(table, [0, 1, 2], 4, ["x", "y", "z"])
    assert got.count() == 300 and got.select(F.max(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, v: a + v) - 1))).first()[0] < 1e-12
    one = model.fit(table.where("fold <> 1"), 4, ["x", "y", "z"])
    alone = {r["id"]: r["predicted_category"] for r in one.predict(table.where("fold = 1")).collect()}
    both = {r["id"]: r["predicted_category"] for r in got.where("fold = 1").collect()}
    # the same rows decide; only the cut points, which no label goes into, are of all rows
    assert sum(alone[i] == both[i] for i in alone) >= 0.9 * len(alone)
    blocks = model.blocks_out_of_fold(table, {"all": [0, 1, 2, 3], "few": [1, 3]}, [0, 1, 2], 4, ["x", "y", "z"])
    assert {r["id"]: r["predicted_category"] for r in blocks.where("block = 'all' AND fold = 1").collect()} == both


def test_a_class_without_rows_and_constant_features(spark):
    rows = [(float(i % 2), 1.0, float(i % 2), 0) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, label double, fold int")
    table = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    for rule in (B.SECOND_ORDER, B.RESIDUALS):
        fitted = B.Boosting("b", rule, 5).fit(table, 2, ["x", "y", "never"])
        out = fitted.predict(table).collect()
        assert all(r["predicted_category"] == ("y" if r["label"] else "x") and np.isfinite(r["margins"]).all() for r in out)
        assert fitted.importances()[1] == 0


def test_parts_are_worth_their_tasks():
    """Every 2,000 rows were a part, so a level of small models was mostly the start of its tasks."""
    assert [B.table_parts(n, 5, 12) for n in (0, 14_000, 84_000, 5_000_000)] == [1, 1, 6, 25]
    assert [B.table_parts(14_000, fits, 8) for fits in (1, 5, 25, 100)] == [1, 1, 5, 8]


def test_stored_margins_are_in_row_groups_of_few_blocks(spark, monkeypatch):
    """Parquet looked at the size after a hundred blocks, so a task held all blocks of its part several times."""
    df = spark.range(4000).select((F.col("id") % 64).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("label"), (F.col("id") % 2).cast("int").alias("fold"))
    table = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    fits, remove, blocks = [B.Fit((0,), 0), B.Fit((0,), 1)], B.remove_path, []

    def seen(spark, path):
        for file in Path(path.removeprefix("file:")).glob("*.parquet"):
            made = pq.ParquetFile(file).metadata
            blocks.append([made.row_group(i).num_rows for i in range(made.num_row_groups)])
        remove(spark, path)

    _, _, plain = B.grow(table, fits, 1, 3, B.SECOND_ORDER, 3)
    monkeypatch.setattr(B, "remove_path", seen)
    monkeypatch.setattr(B, "BLOCK_BYTES", 1 << 10)
    monkeypatch.setattr(B, "SUMMED_BYTES", 1 << 12)
    monkeypatch.setattr(B, "KEPT_BYTES", 0)  # the executors' copies are on disk
    monkeypatch.setattr(B, "BLOCKS_STORED", B.BLOCKS_STORED | {"parquet.block.size": str(1 << 15)})
    monkeypatch.setattr(B, "STORED_ROUNDS", 1)
    _, _, trees = B.grow(table, fits, 1, 3, B.SECOND_ORDER, 3)
    assert len(blocks) >= 3 and all(sum(own) == 16 and max(own) <= 4 for own in blocks)
    assert all((a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value, rtol=0, atol=1e-9) for a, b in zip(plain, trees))
