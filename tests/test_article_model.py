"""The learned scorer of articles."""

import random

import numpy as np
from pyspark.sql import functions as F

from ratingloom.operators import article_model as AM
from ratingloom.operators import news as N
from ratingloom.plans import news_queries as Q
from ratingloom.session import scratch_path


def test_learns_saves_and_scores_alike(spark):
    chance = random.Random(4)
    words = {"up": ["gain", "profit", "rise"], "down": ["loss", "fall", "suit"], "flat": ["same", "hold", "meeting"]}
    text = lambda c: " ".join(chance.choice(words[c] if chance.random() < 0.4 else ["the", "of", "a", "Bank"]) for _ in range(15))
    data = [(i, text(c), c) for i in range(400) for c in [chance.choice(["up", "up", "up", "down", "flat"])]] + [(900, None, "up"), (901, "?!", None), (902, "gain", None)]
    df = spark.createDataFrame(data, "id long, t string, c string").repartition(4)
    model = AM.fit(df.where("id % 4 <> 0"), "t", "c", epochs=30)
    assert model.classes == ["down", "flat", "up"]
    path = scratch_path(spark, "article-model")
    AM.save(model, spark, path)
    back = AM.load(spark, path)
    assert back.classes == model.classes and (back.weights == model.weights).all() and back.tokens is None
    got = N.score_articles(df, F.col("t"), AM.scorer(back, spark, "up", "down")).collect()
    scores = {r["id"]: r["score"] for r in got}
    assert np.allclose([scores[i] for i, _, _ in data], model.score([t for _, t, _ in data], "up", "down"), atol=1e-12)
    held = [(scores[i], c) for i, _, c in data if i % 4 == 0 and c in ("up", "down") and i < 400]
    assert sum((s > 0) == (c == "up") for s, c in held) / len(held) > 0.95
    assert scores[901] == 0 and scores[900] == 0 and scores[902] > 0.3
    # the fit does not depend on the partitioning, but for the rounding of sums, which steps of even size enlarge
    again = AM.fit(df.where("id % 4 <> 0").coalesce(1), "t", "c", epochs=30)
    assert np.abs(again.weights - model.weights).max() < 1e-7


def test_window_and_missing_classes(spark):
    assert AM.word_shares("one two Two three", 3)[0] == AM.word_shares("ONE two two")[0]
    model = AM.fit(spark.createDataFrame([("x", "only"), ("y", None)], "t string, c string"), "t", "c")
    assert model.classes == ["only"] and model.probabilities(["x", None]).tolist() == [[1.0], [1.0]]


def test_every_document_is_scored(spark, sf_dir):
    scored = Q.learned_scores(spark, sf_dir).collect()
    assert len({r["doc_id"] for r in scored}) == len(scored) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(-1 <= r["score"] <= 1 for r in scored)
    seen = [r for r in scored if not r["held_out"] and r["quality"] is not None]
    assert np.mean([(r["score"] > 0) == (r["quality"] == 1) for r in seen]) > 0.9  # rows it has learned from
