"""Ranked search, hard negatives and fingerprints against plain versions, and on hard rows."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ratingloom.llm import catalogue, four_russians, imatch, presence_masks, rounds
from tests.compare import connect
from tests.llm import brute
from tests.llm.test_edges import CLASHES, LONG, TEXTS


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- ranked search ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def articles():
    chance = random.Random(7)
    words = [f"w{int(chance.paretovariate(0.7))}" for _ in range(3000)] + ["Ärger", "日本語", "x1"]
    docs = [(i, " ".join(chance.choice(words) for _ in range(chance.choice([0, 1, 5, 40, 300])))) for i in range(400)]
    docs += [(i + 1000, docs[i % 7 + 20][1]) for i in range(60)]  # copies: equal scores
    docs += TEXTS + [(20, docs[20][1]), (None, "w1 w2 w3"), (5000, LONG)]
    items = [(k, " ".join(chance.choice(words) for _ in range(chance.choice([1, 3, 20, 90])))) for k in range(25)]
    return docs, items + [(3, "W1 w2, w1"), (None, "w1"), (97, None), (98, ""), (99, "neverseen"), (100, "the quick BROWN fox 日本語")]


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, articles, monkeypatch, small):
    docs, items = articles
    if small:  # many packed rows, several blocks, two rounds, few documents scored at a time
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        monkeypatch.setattr(presence_masks, "BLOCK_TERMS", 60)
        monkeypatch.setattr(presence_masks, "STEP", 2)
    try:
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHES}).repartition(4)
        got = presence_masks.best_documents(df, spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1)), 10)
        assert rows(got) == brute.ranked(docs, items, 10)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_ranked_search_of_nothing(spark, articles):
    docs = spark.createDataFrame(articles[0], "doc_id long, text string")
    items = spark.createDataFrame(articles[1], "item_id long, text string")
    assert presence_masks.best_documents(docs.where("false"), items).count() == 0
    assert presence_masks.best_documents(docs, items.where("false")).count() == 0


def test_masks_leave_documents_unscored(spark, articles, monkeypatch):
    """Documents whose mask cannot reach the k-th score are never scored."""
    docs = [(i, "common " + ("rare " if i < 12 else "") + f"own{i}") for i in range(1500)]
    df = presence_masks.packed_postings(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), b"\xff" * (presence_masks.FILTER_BITS // 8))
    seen = []
    monkeypatch.setattr(presence_masks.Postings, "scores", lambda self, r, w, d, f=presence_masks.Postings.scores: seen.append(len(d)) or f(self, r, w, d))
    terms = np.sort(presence_masks.item_terms(spark.createDataFrame([(1, "common rare")], "item_id long, text string")).toArrow()["term"].to_numpy().view(np.uint64))
    best = (np.zeros(0, np.int64),) * 3
    monkeypatch.setattr(presence_masks, "STEP", 1)
    for row in df.collect():
        p = presence_masks.Postings(row.asDict(), terms, len(docs), 3 * len(docs))
        best = presence_masks.best_of(p, terms, np.array([500, 500]), best, 1, 10)
    assert best[1].tolist() == list(range(10)) and sum(seen) == 12


# --- hard negatives ---------------------------------------------------------------------------


def _vectors(seed, rows_, width, labels, spread=3):
    chance = np.random.default_rng(seed)
    return [(i, int(chance.integers(0, labels)), [float(x) for x in chance.integers(-spread, spread + 1, width) / 7]) for i in range(rows_)]


def _whole(data):
    width = max((len(v) for _, _, v in data if v is not None), default=0)
    good = [r for r in data if None not in r and all(x is not None and np.isfinite(x) for x in r[2])]
    return [(i, c, [int(max(min(np.floor(256.0 * x), 2.0**62), -(2.0**62))) for x in v] + [0] * (width - len(v))) for i, c, v in good]


@pytest.mark.parametrize(("count", "width", "labels", "small"), [(300, 11, 3, False), (300, 5, 40, True), (120, 64, 2, True), (40, 1, 1, False)])
def test_hard_negatives(spark, monkeypatch, count, width, labels, small):
    if small:
        for name, value in (("TABLES", 3), ("BLOCK_BYTES", 100)):
            monkeypatch.setattr(four_russians, name, value)
        monkeypatch.setattr(rounds, "TWO_ROUNDS", 2)
        monkeypatch.setattr(rounds, "FIRST", 3)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        data = _vectors(count, count, width, labels)
        data = [(i, c, None if i % 50 == 7 else [None, 1.0] if i % 50 == 8 else [float("nan")] if i % 50 == 9 else [] if i % 50 == 10 else v[:2] if i % 50 == 11 else v) for i, c, v in data]
        data += [(None, 1, [1.0]), (21, None, [1.0]), (20, 0, [0.5] * width), (30, 1, data[30][2]), (15, 0, data[15][2])]
        data += [(1000 + i, i % labels, [0.5] * width) for i in range(60)]  # ties
        df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "slot", "score", "ids")})
        got = four_russians.mined(df.repartition(3), F.col("vec_id") % 10 == 0)
        assert rows(got) == brute.mined(_whole(data), lambda i: i % 10 == 0, 5, 10)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_hard_negatives_of_huge_components(spark):
    data = [(i, i % 2, [float(10 ** (i % 13)) * (-1) ** i, float(i)]) for i in range(60)] + [(100, 0, [1e300, -1e25]), (101, 1, [1e18, 1.0]), (102, 1, [1e308, 0.0])]
    got = four_russians.mined(spark.createDataFrame(data, "vec_id long, label int, embedding array<double>"), F.col("vec_id") % 10 == 0)
    assert rows(got) == brute.mined(_whole(data), lambda i: i % 10 == 0, 5, 10)


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert four_russians.mined(none, F.lit(True)).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert four_russians.mined(one, F.lit(True)).count() == 0


def test_lookups_equal_products():
    chance = np.random.default_rng(3)
    for width, most in ((1, 2), (8, 100), (13, 1 << 20), (64, 200)):
        a, c = (chance.integers(-most, most, (n, width)) for n in (5, 70))
        assert (four_russians.scores(four_russians.subset_sums(a), four_russians.bit_planes(c)) == c @ a.T).all()


# --- fingerprints -----------------------------------------------------------------------------


def _ordered(docs):
    """Distinct (id, text) in the documented order."""
    key = lambda d: (d[0] is not None, d[0] or 0, np.uint64(xxhash.xxh64(d[1].encode(), 42).intdigest()).astype(np.int64))
    return sorted({(i, t or "") for i, t in docs}, key=key)


def _mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def _plain_signature(terms, known, text):
    """The fingerprint, term by term; terms are hashes."""
    kept = sorted(terms & known or terms)
    whole = _mix((sum(_mix((t + 1) % 2**64) for t in kept) + len(kept)) % 2**64) if kept else int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
    subsets = ""
    for scale in range(imatch.SCALES):
        for draw in range(imatch.DRAWS):
            seed, shift = int(imatch._SEEDS[draw]), sum(2 * (s + 1) for s in range(scale))
            own = [v for v in (_mix(t ^ seed) for t in kept) if (v >> shift) % 4 ** (scale + 1) == 0]
            subsets += f"{_mix(sum(_mix((v + scale + 1) % 2**64) for v in own) % 2**64) % 255 + 1 if own else 0:02x}"
    return f"{whole:016x}{len(kept):06x}{subsets}"


def _hashes(text):
    import pyarrow as pa

    return {int(t) for t in imatch.distinct_terms(pa.array([text]))[1]}


def _expected(docs, known=None):
    order, n = _ordered(docs), len(docs)
    held = {}
    for _, t in docs:
        for h in _hashes(t or ""):
            held[h] = held.get(h, 0) + 1
    known = {h for h, df in held.items() if df * imatch.MOST_SHARE <= n <= df * imatch.LEAST_SHARE}
    out = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        out[i, t] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), _plain_signature(_hashes(t), known, t), _plain_signature(_hashes(edited), known, edited))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_fingerprints(spark, monkeypatch, small):
    chance = random.Random(5)
    docs = [(chance.randrange(10**6), " ".join(f"w{int(chance.paretovariate(0.5))}" for _ in range(chance.choice([1, 8, 60])))) for _ in range(120)]
    docs += TEXTS + [(None, "another row without an id"), (6, "one three"), (6, "one two"), (2**62, "last of all"), (-5, "first 日本語 of all, and more")]
    if small:  # many ranges, small batches
        monkeypatch.setattr(imatch, "RANGE_CHARS", 60_000)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("first", "second", "guard", "copies", "n")}).repartition(3)
        got = imatch.fingerprinted(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    expected = _expected(docs)
    plain = sorted((expected[i, t or ""] for i, t in docs), key=str)
    assert sorted((tuple(r)[1:5] for r in got), key=str) == plain
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((i for i, _ in docs), key=str)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert all(r["near_edited"] == 1 for r in got if r["fingerprint"] == r["edited_fingerprint"])


@pytest.mark.parametrize("texts", [[], [(1, "only one text here, and nothing else")], [(4, ""), (5, None)], [(7, "same words"), (7, "same words")]])
def test_fingerprints_of_few(spark, texts):
    got = imatch.fingerprinted(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], *tuple(r)[1:5]) for r in got) == sorted((i, *_expected(texts)[i, t or ""]) for i, t in texts)


def test_fingerprint_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = connect(sf_dir).execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    got = catalogue.QUERIES["op13_imatch"](spark, sf_dir).toPandas().set_index("doc_id")
    for k, (i, t) in enumerate(texts):
        q = len(t) // 4
        edited = t[: len(t) - q] + texts[(k + 1) % len(texts)][1][:q]
        assert (got.n_chars[i], got.edited_sha256[i]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert (got.near_edited >= 0.5).mean() > 0.95 and (got.near_next >= 0.5).mean() < 0.02


def test_likeness_estimates_the_share_in_common():
    import pyarrow as pa

    words = [f"term{k}" for k in range(4000)]
    band = np.sort(np.array([h for w in words for h in _hashes(w)], np.uint64))
    for size in (20, 200, 2000):
        for differing in (0, size // 10, size // 2, size):
            a, b = " ".join(words[:size]), " ".join(words[differing : differing + size])
            estimate = imatch.likeness(*(imatch.signatures(pa.array([x]), band) for x in (a, b)))[0]
            assert abs(estimate - (1 - differing / size)) < 0.2, (size, differing, estimate)
