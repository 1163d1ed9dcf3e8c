"""From raw documents to token ids: each stage reads what the one before it kept.

Every stage works on all rows it is given. All but the last return the columns of
the documents; the last returns the ids of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratingloom.llm import byte_bpe, hierarchical_quality, ngram_join, secret_ledger, template_decontamination
from ratingloom.llm.registry import given, prepare
from ratingloom.llm.scratch import Scratch

#: Some stages are models and graph searches, which SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of at least even odds to be good, by their text and their site."""
    prepare(spark)
    return hierarchical_quality.kept(docs, given(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word n-grams at a Jaccard similarity of 0.8 or more."""
    prepare(spark)
    return ngram_join.first_of_each(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, also not one with other numbers or names."""
    prepare(spark)
    return template_decontamination.cleaned(docs, given(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret in its text replaced by its kind."""
    prepare(spark)
    return secret_ledger.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of every document."""
    prepare(spark)
    return byte_bpe.encode(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = given(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
