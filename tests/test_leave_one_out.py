"""Leave-one-out predictions against one fit per row."""

import math

import numpy as np
from pyspark.sql import functions as F

from ratingloom.operators import leave_one_out as LO


def gaussian(x, y, row, classes):
    """The class of a row by a model fitted on the others."""
    rest = np.arange(len(x)) != row
    tx, ty = x[rest], y[rest]
    if not len(tx):
        return None
    e = max(1e-9 * tx.var(axis=0).max(), 1e-300)
    scores = []
    for c in classes:
        own = tx[ty == c]
        scores.append(-np.inf if not len(own) else math.log(len(own) / len(tx)) - sum(math.log(2 * math.pi * (v + e)) / 2 + (a - m) ** 2 / (2 * (v + e)) for a, m, v in zip(x[row], own.mean(axis=0), own.var(axis=0))))
    return classes[int(np.argmax(scores))]


def test_equals_one_fit_per_row(spark):
    chance = np.random.default_rng(3)
    sizes = {"a": 60, "b": 25, "c": 2, "d": 1}
    rows = [(g, f"{g}{i}", "xyz"[int(chance.integers(0, 3))], *map(float, chance.normal(size=3) + (i % 3))) for g, n in sizes.items() for i in range(n)]
    rows = [(g, k, c, *(v + "xyz".index(c) * 0.8 for v in r)) for g, k, c, *r in rows]
    df = spark.createDataFrame(rows, "g string, key string, c string, f0 double, f1 double, f2 double").repartition(3)
    got = {r["key"]: r["predicted_category"] for r in LO.gaussian_leave_one_out(df, "g", "c", ["x", "y", "z"], ["f0", "f1", "f2"]).collect()}
    for g in sizes:
        own = [r for r in rows if r[0] == g]
        x, y = np.array([r[3:] for r in own]), np.array([r[2] for r in own])
        assert [got[r[1]] for r in own] == [gaussian(x, y, i, ["x", "y", "z"]) for i in range(len(own))]
    scored = LO.accuracy(df.withColumn("predicted_category", F.col("c")), ["g"], "c").collect()
    assert {r["g"]: (r["rows"], r["accuracy"]) for r in scored} == {g: (n, 1.0) for g, n in sizes.items()}


def test_neighbours_leave_the_row_out(spark):
    chance = np.random.default_rng(5)
    x = np.round(chance.normal(size=(80, 2)), 1)
    x[10:20] = x[10]  # more equal rows than neighbours
    y = chance.integers(0, 2, 80)
    df = spark.createDataFrame([(f"k{i:02}", "ab"[int(c)], [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))], "key string, c string, features array<double>")
    got = {r["key"]: r["predicted_category"] for r in LO.neighbours_leave_one_out(df, "key", "c", ["a", "b"], 3).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    for i in range(80):
        d = sorted((math.dist(z[i], z[j]), j) for j in range(80) if j != i)[:3]
        exact = [j for v, j in d if v == 0]
        votes = [sum((1.0 if exact else 1 / v) for v, j in d if y[j] == c and (not exact or j in exact)) for c in (0, 1)]
        if abs(votes[0] - votes[1]) > 1e-9:
            assert got[f"k{i:02}"] == "ab"[int(np.argmax(votes))]
