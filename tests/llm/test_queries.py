"""The registered queries over whole small tables: against SQL, plain versions and held-out labels."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ratingloom.llm import catalogue, language_id, license_inheritance, mtree_search, ngram_join, template_decontamination, toxic_sentences
from tests.compare import compare, connect
from tests.llm import brute


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def texts(con):
    return con.execute("SELECT doc_id, text FROM documents").fetchall()


def test_all_registered():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, sf_dir, con, name):
    ok, message = compare(spark, con, catalogue.QUERIES[name], catalogue.ORACLES[name], sf_dir)
    assert ok, message


def test_ngram_join(spark, sf_dir, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in catalogue.QUERIES["op6_ngram_join"](spark, sf_dir).collect()}
    assert got == brute.groups(texts, 4, 85)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (2, 50), (1, 34)])
def test_ngram_join_on_edited_copies(spark, width, percent):
    chance, docs = random.Random(width), []
    for i in range(300):
        if docs and chance.random() < 0.6:
            words = docs[chance.randrange(len(docs))][1].split()
            for _ in range(chance.randint(0, 2)):
                if words:
                    words[chance.randrange(len(words))] = "".join(chance.choice("abcdefgh") for _ in range(3))
        else:
            words = ["".join(chance.choice("abcdefgh") for _ in range(2)) for _ in range(chance.choice([0, 1, 3, 8, 30, 60]))]
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(df, width, percent).collect()} == brute.groups(docs, width, percent)


def test_secrets(spark, sf_dir, texts):
    known = dict(texts)
    for r in catalogue.QUERIES["op7_secret_ledger"](spark, sf_dir).collect():
        assert [r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]] == brute.secrets(known[r["doc_id"]])


def test_decontamination(spark, sf_dir, con, texts):
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    got = {(r["doc_id"], r["item_id"]) for r in catalogue.QUERIES["op5_template_decontamination"](spark, sf_dir).collect()}
    assert {(d, i) for d, t in texts for i, x in items if x in t} <= got
    assert all(brute.holds(dict(texts)[d], dict(items)[i], percent=70) for d, i in got)


def test_questions_with_other_numbers(spark):
    ask = "If {a} buys {n} apples for {m} dollars each and {b} eats {n} of them, how much did {a} pay in total for the fruit?"
    item = ask.format(a="Anna", b="Bob", n=12, m=3)
    docs = [
        (1, "Before it. " + item + " After it."), (2, ask.format(a="Carla", b="Dan", n="1,500", m="2.50")),
        (3, ask.format(a="Carla", b="Dan", n=15, m=4).replace("eats 15", "eats 9")), (4, "Anna buys 12 apples."), (5, item.upper()),
    ]
    found = template_decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {(r["doc_id"], r["n_slots"], r["n_changed"]) for r in found.collect()} == {(1, 5, 0), (2, 5, 4), (5, 5, 0)}


def test_licences(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: (r["licence"], r["score"], r["whole"]) for r in license_inheritance.notices(docs).collect()}
    assert got == brute.licences(texts, license_inheritance.TEMPLATES, license_inheritance.LEAST)


def test_licence_files_and_size(spark):
    """Licence texts, tags and notices within a line are found, whatever the size of the table."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    own = [
        (1, "Copyright 2024 Foo. Released under the MIT License."), (2, "/* SPDX-License-Identifier: Apache-2.0 */\nint x;"), (3, "MIT License\n\nCopyright (c) 2024 Foo\n\n" + mit),
        (4, "# This file is released under the MIT License.\ncode"), (5, "We met a person who had a copy of the software"), (6, "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ]
    filler = lambda n: [(100 + i, f"the {i} of a file was under this version and the name{i} is any other w{i % 17}") for i in range(n)]
    for n in (50, 3000):
        docs = spark.createDataFrame(own + filler(n), "doc_id long, text string")
        got = {r["doc_id"]: (r["licence"], r["whole"]) for r in license_inheritance.notices(docs).collect()}
        assert {i: name for i, (name, _) in got.items()} == {1: "MIT", 2: "Apache-2.0", 3: "MIT", 4: "MIT", 6: "GPL-3.0"}, n
        assert got[3][1] and got[6][1]  # they hold the licence's own text


def test_nearest_directory(spark):
    files = spark.createDataFrame([(1, "a", "a/l"), (2, "a/b/c", "a/b/c/x"), (3, "a/b", "a/b/l"), (4, "a", "a/m"), (5, "z", "z/1")], "doc_id long, directory string, path string")
    found = spark.createDataFrame([(1, "MIT", 1.0, True), (3, "ISC", 0.9, True), (4, "BSL-1.0", 0.8, False)], "doc_id long, licence string, score double, whole boolean")
    got = {r["doc_id"]: (r["licence"], r["origin"], r["directory"]) for r in license_inheritance.inherited(files, found).collect()}
    assert got == {1: ("MIT", "file", "a"), 2: ("ISC", "inherited", "a/b"), 3: ("ISC", "file", "a/b"), 4: ("BSL-1.0", "header", "a"), 5: (None, None, None)}


def test_search_with_ties_and_small_pages(spark, monkeypatch):
    for name, value in (("SUBTREE", 50), ("PAGE", 8), ("BLOCK", 7)):
        monkeypatch.setattr(mtree_search, name, value)
    chance = np.random.default_rng(1)
    rows = [(i, [0.5] * 5 if i % 3 == 0 else [float(x) for x in chance.integers(-3, 4, 5) / 7]) for i in range(300)]
    rows = [(i, None if i % 50 == 7 else [None, 1.0] if i % 50 == 8 else [float("nan")] if i % 50 == 9 else v[:3] if i % 50 == 11 else v) for i, v in rows]
    rows += [(None, [1.0]), (21, rows[21][1])]
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = mtree_search.searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("tree", F.lit(1)), F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute.nearest(whole, lambda i: i % 10 == 0, 5)


def test_search_of_huge_and_repeated_vectors(spark, monkeypatch):
    for name, value in (("SUBTREE", 20), ("PAGE", 4)):
        monkeypatch.setattr(mtree_search, name, value)
    rows = [(i, [float(10 ** (i % 14)) * (-1) ** i, float(i)]) for i in range(60)] + [(60, [1e12, 1e12]), (61, [1e300, -1e25]), (62, [1e18, 1.0])]
    rows += [(i, [1e12, 1e12]) for i in range(100, 140)]
    whole = [(i, [int(max(min(np.floor(256.0 * x), 2.0**62), -(2.0**62))) for x in v]) for i, v in rows]
    expected = brute.nearest(whole, lambda i: i % 10 == 0, 5, lambda s: min(max(s, -(2**63)), 2**63 - 1))
    got = mtree_search.searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == expected


def _labels(con):
    return con.execute("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)").df().set_index("doc_id")


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    known = _labels(connect(sf_dir))
    found = catalogue.QUERIES["op3_language_id"](spark, sf_dir).toPandas().set_index("doc_id").join(known)
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.index]).all()
    assert (found[found.held_out].lang_pred == found[found.held_out].lang).mean() > 0.98
    found = catalogue.QUERIES["op1_toxic_sentences"](spark, sf_dir).toPandas().set_index("doc_id").join(known)
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.index]).all()
    judged = found[found.toxic.notna()]
    assert (judged.predicted == judged.toxic).mean() > 0.93
    found = catalogue.QUERIES["op9_hierarchical_quality"](spark, sf_dir).toPandas().set_index("doc_id").join(known)
    judged = found[found.quality.notna()]
    assert (judged.keep == (judged.quality == 1)).mean() > 0.97


def test_a_rare_language_is_learned(spark):
    """However many documents the others have."""
    chance = random.Random(1)
    word = lambda letters: "".join(chance.choice(letters) for _ in range(chance.randint(2, 7)))
    text = lambda letters: " ".join(word(letters) for _ in range(30))
    docs = [(i, text("abcdefg"), "aa") for i in range(6000)] + [(10_000 + i, text("tuvwxyz"), "zz") for i in range(12)] + [(20_000, "nothing", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.train(df, 300)
    assert model.languages == ["aa", "zz"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predicted(df, model).collect()}
    assert all(got[i] == lang for i, _, lang in docs if lang)


def test_offending_sentences_are_found(spark):
    plain = "We met at noon. The weather was fine! Nobody said a word\nThen we left."
    bad = "We met at noon. You are a blargh person! Then we left."
    docs = [(i, (bad if i % 5 == 0 else plain) + f" Number {i}.") for i in range(200)]  # no two alike: copies count once
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxic_sentences.train(df, labels)
    assert {r["doc_id"] for r in toxic_sentences.scored(df, model).where("predicted = 1").collect()} == set(range(0, 200, 5))
    assert {(r["start"], r["end"], r["sentence"]) for r in toxic_sentences.located(df, model).collect()} == {(16, 39, "You are a blargh person")}


def test_tables_stay_small_after_the_join(spark, sf_dir):
    """No pair table grows with the square of a group of near copies."""
    base = " ".join(f"w{k}" for k in range(120))
    docs = [(i, base.replace(f"w{i % 100} ", f"x{i} ")) for i in range(400)]
    got = ngram_join.linked(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()
    assert {r["component_id"] for r in got} == {0} and duckdb.__version__
