"""Steps whose tasks hold a bounded part of their input."""

import os

from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from ratingloom.operators import news as N
from ratingloom.operators import verdicts as VD
from ratingloom.plans import source_queries as SQ


def test_runs_are_counted_exactly_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(VD, "RUN_CHARS", 64)
    texts = ["a b c a b c", "ab c d", "a bc d", "x y x y x", "A  B\tC", "one two", "", None]
    df = spark.createDataFrame([(k % 2, t) for k, t in enumerate(texts * 20)], "side int, text string")
    want = {}
    for k, t in enumerate(texts * 20):
        w = (t or "").lower().split()
        want.setdefault(k % 2, []).extend(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    got = {r["side"]: (r["unique_trigrams"], r["total_trigrams"]) for r in VD.trigram_diversity(df, F.col("text"), ["side"]).collect()}
    assert got == {side: (len(set(runs)), len(runs)) for side, runs in want.items() if runs}


def test_a_task_combines_texts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(VD, "RUN_CHARS", 100)
    df = spark.createDataFrame([(f"w{k} a b c",) for k in range(400)], "text string").coalesce(1)
    plan = VD.trigram_diversity(df, F.col("text"))._jdf.queryExecution().toString()
    assert "RoundRobinPartitioning" in plan or "Repartition" in plan


def test_only_the_scored_batch_is_turned_into_texts(spark):
    def load():
        return lambda texts: [float(len(t)) if t is not None and len(texts) <= 3 else -1.0 for t in texts]

    df = spark.createDataFrame([(k, "x" * k if k % 5 else None) for k in range(23)], "k int, text string").coalesce(1)
    scored = N.score_articles(df, F.col("text"), load, 3)
    assert [r["score"] for r in scored.orderBy("k").collect()] == [float(k) if k % 5 else -1.0 for k in range(23)]
    assert "pythonUDF" in (plan := scored._jdf.queryExecution().toString()) and f"], {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in plan


def test_statement_files_lie_in_one_folder(spark, sf_dir):
    path = SQ._write_yearly_documents(spark, sf_dir).removeprefix("file:")
    files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".txt")]
    assert files and not any(os.path.isdir(f"{path}/{x}") for x in os.listdir(path))
    tickers = SQ.SS.read_statements(spark, path).select("ticker")
    assert tickers.count() == tickers.distinct().count() == SQ.R.statements(spark, sf_dir).select("ticker").distinct().count()
