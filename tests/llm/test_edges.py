"""Every operator on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ratingloom.llm import (
    byte_bpe, hierarchical_quality, language_id, license_inheritance, mtree_search, ngram_join, secret_ledger, template_decontamination, token_files, toxic_sentences,
)
from ratingloom.llm.scratch import Scratch
from tests.llm import brute

LONG = "alpha beta gamma delta " * 20_000
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here today"), (2, "The quick brown fox jumps over the lazy dog and runs far away from here today"),
    (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "ONE two"), (8, "password = 'hunter2x' and AKIA" + "A1" * 8), (9, "é" * 50 + " 0123456789abcdef01234567 token:abcdefg"),
    (10, LONG), (11, LONG + "omega"), (12, "日本語 テキスト 123 !!"), (13, "12 34 --- ..."), (6, "one two"), (None, "a row without an id"), (14, "Released under the MIT License.\nbody text here"),
]
#: Names the operators use for columns of their own.
CLASHES = ["n", "cls", "block", "host", "path", "evidence", "score", "keep", "blob", "text_blob", "hit_blob", "blob_spans", "ids", "component", "hash", "licence"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s") for i, t in TEXTS], "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(1) for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 2)) for i in range(1, 15)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def named():
    return [(i, t) for i, t in TEXTS if i is not None]


def test_byte_bpe(docs):
    merges = byte_bpe.encoder(open(byte_bpe.RANK_FILE, "rb").read(), public_tokenizers.PATTERN)
    assert isinstance(merges, tiktoken.Encoding)
    expected = []
    for i, t in TEXTS:
        ids = merges.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(byte_bpe.round_trip(docs)) == sorted(expected, key=str)
    back = byte_bpe.decode(byte_bpe.encode(docs))
    assert rows(back) == sorted(((i, bytearray((t or "").encode())) for i, t in TEXTS), key=str)


def test_token_files(spark, docs):
    tokenizer = Tokenizer.from_file(token_files.TOKENIZER_FILE)
    special = [(20, "a <|endoftext|> b"), (21, "<|ENDOFTEXT|> then x<|endoftext|><|startoftext|>y <|endoftext"), (22, "<|endoftext|>"), (23, "É<|endoftext|>日本 <|start <|endoftext|>")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(special, "doc_id long, text string"))
    path = Scratch(spark, "test-tokens").path("t")
    token_files.write_tokens(docs, path)
    expected, start = [], 0
    for i, t in sorted(TEXTS + special, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(token_files._placed(token_files.digests(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")) == sorted(expected, key=str)
    assert rows(token_files.read_metadata(spark, path)) == sorted((r[:3] for r in expected), key=str)
    assert {r["doc_id"] for r in token_files.read_tokens(spark, path, 8, 9).collect()} == {8, 9}
    plan = token_files.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]


def test_ngram_join(docs):
    expected = brute.groups(named(), 4, 85)
    got = [r for r in ngram_join.linked(docs, 4, 85).collect() if r["doc_id"] is not None]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted((i, *expected[i]) for i, _ in named())


def test_first_of_each_keeps_columns(docs):
    out = ngram_join.first_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 3, 4, 5, 6, 8, 9, 10, 12, 13, 14]


def test_secrets(spark, docs):
    paths = secret_ledger.paths_of(docs)
    first = Scratch(spark, "test-ledger").write(secret_ledger.scan_unseen(docs, paths, None), "first")
    got = secret_ledger.report(secret_ledger.findings(paths, first)).collect()
    texts = dict(TEXTS)
    assert len(got) == len(TEXTS)
    for r in got:
        assert [r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]] == brute.secrets(texts[r["doc_id"]])
    # nothing is left to scan; a changed rule and a new content are
    assert secret_ledger.unseen(paths, first).count() == 0
    changed = (*secret_ledger.RULES[:-1], secret_ledger.Rule("login", "x{9}", 1))
    assert {tuple(r["versions"]) for r in secret_ledger.unseen(paths, first, changed).collect()} == {(changed[-1].version,)}
    more = secret_ledger.paths_of(spark.createDataFrame([(99, "new text")], "doc_id long, text string"))
    assert [r["doc_id"] for r in secret_ledger.unseen(paths.union(more), first).collect()] == [99]


def test_redaction(docs):
    out = secret_ledger.redacted(docs)
    assert out.columns == docs.columns
    found = {r["doc_id"]: r["text"] for r in out.collect()}
    assert found[8] == "<assign>' and <access>" and found[9] == "é" * 50 + " <hex> <assign>" and found[3] is None and found[10] == LONG


def test_quality(docs, labels):
    scored = hierarchical_quality.scored_documents(docs, labels)
    got = scored.collect()
    assert len(got) == len(TEXTS) and all(0 < r["score"] < 1 and r["keep"] == (r["score"] >= 0.5) for r in got)
    assert hierarchical_quality.kept(docs, labels).columns == docs.columns
    assert hierarchical_quality.kept(docs, labels.where("false")).count() == len(TEXTS)


def test_toxicity(docs, labels):
    model = toxic_sentences.train(docs, labels)
    got = toxic_sentences.scored(docs, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in got if r["doc_id"] in (3, 4, 5))
    none = toxic_sentences.train(docs, labels.where("false"))
    assert {r["score"] for r in toxic_sentences.scored(docs, none).collect()} == {0.0}


def test_language(docs):
    got = language_id.predicted(docs, language_id.train(docs)).collect()
    assert len(got) == len(TEXTS)
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (3, 4, 5, 13)) for r in got)
    assert {r["lang_pred"] for r in language_id.predicted(docs, language_id.train(docs.where("false"))).collect()} == {"und"}


def test_licences(docs):
    found = license_inheritance.notices(docs)
    assert {r["doc_id"]: (r["licence"], r["score"], r["whole"]) for r in found.collect()} == brute.licences(TEXTS, license_inheritance.TEMPLATES, license_inheritance.LEAST)
    assert license_inheritance.inherited(license_inheritance.files_of(docs), found).count() == len(TEXTS)


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, TEXTS[0][1]), (2, None), (3, ""), (4, "too short"), (1, TEXTS[0][1])], "item_id long, text string").withColumn("hash", F.lit(1))
    assert {(r["doc_id"], r["item_id"]) for r in template_decontamination.contaminated(docs, items).collect()} == {(1, 1), (2, 1)}
    out = template_decontamination.cleaned(docs, items)
    assert out.columns == docs.columns and out.count() == len(TEXTS) - 2


def test_empty_tables(spark, docs, labels, sf_dir):
    none, unlabelled = docs.where("false"), labels.where("false")
    items = spark.createDataFrame([], "item_id long, text string")
    paths = secret_ledger.paths_of(none)
    made = [
        byte_bpe.round_trip(none), ngram_join.linked(none), ngram_join.first_of_each(none), secret_ledger.findings(paths, secret_ledger.scan_unseen(none, paths, None)),
        secret_ledger.redacted(none), hierarchical_quality.scored_documents(none, unlabelled), hierarchical_quality.kept(none, unlabelled),
        toxic_sentences.scored(none, toxic_sentences.train(none, unlabelled)), language_id.predicted(none, language_id.train(none)),
        license_inheritance.inherited(license_inheritance.files_of(none), license_inheritance.notices(none)), template_decontamination.contaminated(none, items),
        template_decontamination.contaminated(docs, items),
        mtree_search.searched(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)),
    ]
    assert [df.count() for df in made] == [0] * len(made)
    path = Scratch(spark, "test-none").path("t")
    token_files.write_tokens(none, path)
    assert token_files.read_metadata(spark, path).count() == 0


def test_pipeline_on_hard_rows(spark, docs, sf_dir):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = Scratch(spark, "test-stages").write(stage(spark, kept, sf_dir), name)
        assert kept.columns == docs.columns, name
    assert stage(spark, kept, sf_dir).count() == kept.count()
