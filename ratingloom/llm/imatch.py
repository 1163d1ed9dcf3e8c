"""I-Match fingerprints with randomised lexicon subsets.

1. Document frequencies of all terms over all documents; the lexicon is the terms in a
   band of inverse document frequency: at most every `MOST_SHARE`-th and at least every
   `LEAST_SHARE`-th document holds them. So it has at most LEAST_SHARE times as many terms
   as a document has distinct terms on average, whatever the number of documents.
2. A text's terms that are in the lexicon, distinct and sorted, are hashed: once all of
   them, and once for each of several random subsets of the lexicon. Subsets come in
   `DRAWS` draws of `SCALES` sizes (a quarter of the lexicon, a sixteenth, ...). Two
   texts agree on a subset if none of the terms in which they differ is in it. How many
   subsets of each size agree tells how many terms that are, and the likeness is the
   estimated share of terms in common: 1 - differing / (terms of both).
3. Documents are dealt to tasks by ranges of (doc_id, hash of text); each range also gets
   the first document of the next one, so every document meets its successor. Split points
   come from a bounded sample of the ids and only decide how even the ranges are.

A fingerprint is 16 hex digits of the hash of all kept terms, 6 of their number, and two for each subset
(00 where the text has no term of the subset).

Defined results: a NULL text is empty; terms are runs of letters, digits and characters
beyond ASCII, A-Z as a-z, compared by 64-bit hashes; a text none of whose terms is in the
lexicon keeps all its terms, a text without terms is hashed by its characters; equal texts
have equal fingerprints and likeness 1; rows without an id come before the others; rows of
one id go by a hash of their text; rows that repeat id and text have one place in the order
and equal results; a single document is its own successor; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm import textkernel as tk
from ratingloom.llm.registry import given, query
from ratingloom.llm.rounds import group_starts
from ratingloom.llm.scratch import Scratch

#: The band: a term is held by at most one in MOST_SHARE and at least one in LEAST_SHARE documents.
MOST_SHARE, LEAST_SHARE = 10, 500
#: Random draws, and sizes of the subsets of each: 1/4, 1/16, ... of the lexicon.
DRAWS, SCALES = 32, 6
#: Characters of a range of documents, ranges at most, and sampled ids per range that split points are chosen from.
RANGE_CHARS, MOST_RANGES, SAMPLED = 16 << 20, 20_000, 200
TERM_BYTES = ~tk.classes(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

_SEEDS = tk.mix(np.arange(1, DRAWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FIRST = -(2**63)
_RESULT = "doc_id bigint, copies bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def distinct_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of every distinct term of each text, by text, then term."""
    of, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for s in tk.slices(texts):
        w = tk.words(s, TERM_BYTES)
        order = np.lexsort((w.hash, w.text))
        text, term = w.text[order], w.hash[order]
        if len(term):
            new = np.concatenate(([True], (term[1:] != term[:-1]) | (text[1:] != text[:-1])))
            of.append(s.first + text[new])
            terms.append(term[new])
    return np.concatenate(of), np.concatenate(terms)


def lexicon(docs: DataFrame, rows: int, text_col: str = "text") -> DataFrame:
    """The terms (hashes) in the band, from the document frequencies of all terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = np.sort(distinct_terms(batch.column(0))[1])
            at = group_starts(terms)
            yield pa.RecordBatch.from_arrays([pa.array(terms[at].view(np.int64)), pa.array(np.diff(np.append(at, len(terms))))], names=["term", "df"])

    held = docs.select(text_col).mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return held.where((F.col("df") * MOST_SHARE <= rows) & (F.col("df") * LEAST_SHARE >= rows)).select("term")


def signatures(texts: pa.Array, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of all kept terms, their number, hashes of the subsets as bytes) of each text."""
    n = len(texts)
    of, terms = distinct_terms(texts)
    known = band[np.minimum(np.searchsorted(band, terms), len(band) - 1)] == terms if len(band) else np.zeros(len(terms), bool)
    some = np.bincount(of[known], minlength=n) > 0
    keep = known | ~some[of]
    of, terms = of[keep], terms[keep]
    bounds = np.searchsorted(of, np.arange(n + 1))
    count = np.diff(bounds)

    def summed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
        return total[at[1:]] - total[at[:-1]]

    whole = tk.mix(summed(tk.mix(terms + np.uint64(1)), bounds) + count.astype(np.uint64))
    for k in np.flatnonzero(count == 0):
        whole[k] = int.from_bytes(hashlib.sha256((texts[int(k)].as_py() or "").encode()).digest()[:8], "little")
    out = np.zeros((n, SCALES, DRAWS), np.uint8)
    for draw, seed in enumerate(_SEEDS):
        v = tk.mix(terms ^ seed)
        shift = 0
        for scale in range(SCALES):  # each size reads bits of its own
            bits = 2 * (scale + 1)
            inside = np.flatnonzero((v >> np.uint64(shift)) & np.uint64((1 << bits) - 1) == 0)
            at = np.searchsorted(inside, bounds)
            out[:, scale, draw] = np.where(np.diff(at) > 0, tk.mix(summed(tk.mix(v[inside] + np.uint64(scale + 1)), at)) % np.uint64(255) + np.uint64(1), 0)
            shift += bits
    return whole, count, out


def _likelihood() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of differing terms, and per subset size the logarithms of agreeing and of not."""
    differing = np.unique(np.concatenate((np.arange(64), np.geomspace(64, 1e6, 400).round())))
    untouched = (1 - 4.0 ** -np.arange(1, SCALES + 1))[:, None] ** differing[None, :]
    agree = untouched + (1 - untouched) / 255  # hashes of one byte also agree by chance
    return differing, np.log(agree), np.log(np.maximum(1 - agree, 1e-300))


_DIFFERING, _AGREE, _DISAGREE = _likelihood()


def likeness(a: tuple, b: tuple) -> np.ndarray:
    """The estimated share of terms in common, for pairs of signatures; 1 for equal ones."""
    equal = (a[2] == b[2]).sum(axis=2).astype(np.float64)
    likely = equal @ _AGREE + (DRAWS - equal) @ _DISAGREE
    differing = _DIFFERING[likely.argmax(axis=1)]
    terms = a[1] + b[1]
    share = np.where(terms > 0, 1 - differing / np.maximum(terms, 1), 0.0)
    same = (a[0] == b[0]) & (a[1] == b[1]) & (equal == DRAWS).all(axis=1)
    return np.where(same, 1.0, np.clip(share, 0, 1)).round(6)


def fingerprint(whole: int, count: int, subsets: np.ndarray) -> str:
    return f"{int(whole):016x}{int(count):06x}{subsets.tobytes().hex()}"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, its place in the order (first, second) and the text, empty if NULL."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    return named.select("doc_id", F.coalesce("doc_id", F.lit(_FIRST)).alias("first"), F.xxhash64("text").alias("second"), "text")


def split_points(ids: DataFrame, rows: int, chars: int) -> np.ndarray:
    """Places in the order between ranges of about `RANGE_CHARS` characters, from a bounded sample of the ids."""
    ranges = int(min(MOST_RANGES, max(1, -(-chars // RANGE_CHARS))))
    wanted = ranges * SAMPLED
    chosen = ids if rows <= wanted else ids.where(F.pmod(F.xxhash64("first", "second"), F.lit(1 << 30)) < int((1 << 30) * wanted / rows)).limit(2 * wanted)
    sample = chosen.select("first", "second", "n").toArrow()
    place = np.array(list(zip(sample["first"].to_pylist(), sample["second"].to_pylist(), strict=True)), np.dtype([("a", np.int64), ("b", np.int64)]))
    order = np.argsort(place, order=("a", "b"))
    filled = np.cumsum(sample["n"].to_numpy()[order] + 1)
    cuts = np.searchsorted(filled, filled[-1] * np.arange(1, ranges) / ranges) if len(filled) else np.zeros(0, np.int64)
    return np.unique(place[order][cuts])


def range_of(points: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The range of each place: how many split points are not behind it."""
    place = np.empty(len(first), points.dtype)
    place["a"], place["b"] = first, second
    out = np.searchsorted(points["a"], first, side="left")
    while True:  # split points of one id, of which there are few, go by the second key
        at = np.minimum(out, max(len(points) - 1, 0))
        behind = (out < len(points)) & (points["a"][at] == first) & (points["b"][at] <= second) if len(points) else np.zeros(len(first), bool)
        if not behind.any():
            return out
        out = out + behind


def _in_order(docs: DataFrame, ids: DataFrame, points: np.ndarray) -> DataFrame:
    """The documents of each range in one partition, in order, followed by the first of the next range (`guard`).

    Copies of a row within an Arrow batch are one row with their number.
    """
    spark = docs.sparkSession

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = range_of(points, batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *batch.columns], names=["range", "first", "second"])

    heads = ids.select("first", "second").mapInArrow(number, "range int, first bigint, second bigint").groupBy("range").agg(F.min(F.struct("first", "second")).alias("head"))
    known = heads.orderBy("range").collect()  # one row per range
    before = {(r["head"]["first"], r["head"]["second"]): known[k - 1]["range"] for k, r in enumerate(known)}
    shared = spark.sparkContext.broadcast((points, before))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, before = shared.value
        heads = np.array(sorted({a for a, _ in before}), np.int64)
        for batch in batches:
            first, second = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            missing = np.asarray(batch.column(0).is_null())
            order = np.lexsort((missing, second, first))
            new = np.concatenate(([True], (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0) | (missing[order][1:] != missing[order][:-1]))) if len(order) else np.zeros(0, bool)
            rows = order[new]
            copies = np.diff(np.append(np.flatnonzero(new), len(order)))
            at = range_of(points, first[rows], second[rows])
            near = np.flatnonzero(heads[np.minimum(np.searchsorted(heads, first[rows]), len(heads) - 1)] == first[rows])
            guards = [(k, before[int(first[rows[k]]), int(second[rows[k]])]) for k in near if (int(first[rows[k]]), int(second[rows[k]])) in before]
            take = np.concatenate((rows, rows[[k for k, _ in guards]])) if guards else rows
            columns = [
                pa.array(np.concatenate((at, np.array([r for _, r in guards], np.int64))).astype(np.int32)), pa.array(np.arange(len(take)) >= len(rows)),
                *(batch.column(j).take(pa.array(take)) for j in range(3)), pa.array(np.concatenate((copies, np.ones(len(guards), np.int64)))), batch.column(3).take(pa.array(take)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "guard", "doc_id", "first", "second", "copies", "text"])

    dealt = docs.mapInArrow(deal, "range int, guard boolean, doc_id bigint, first bigint, second bigint, copies bigint, text string")
    return dealt.repartitionById(len(points) + 1, "range").sortWithinPartitions("guard", "first", "second", "doc_id")


def _signed(in_order: DataFrame, band: np.ndarray) -> DataFrame:
    """Fingerprints of each document and its edited text, from a table in order."""
    shared = in_order.sparkSession.sparkContext.broadcast(band)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = shared.value
        waiting: list[tuple] = []  # rows of the last place seen: (guard, first, second), doc_id, copies, text

        def results(rows: list[tuple], successors: list[str]) -> pa.RecordBatch:
            texts = [r[3] for r in rows]
            edited = [t[: len(t) - len(t) // 4] + s[: len(t) // 4] for t, s in zip(texts, successors, strict=True)]
            own, other, following = (signatures(pa.array(x, pa.string()), band) for x in (texts, edited, successors))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array([fingerprint(*x) for x in zip(*own, strict=True)], pa.string()),
                    pa.array([fingerprint(*x) for x in zip(*other, strict=True)], pa.string()), pa.array(likeness(own, other)), pa.array(likeness(own, following)),
                ],
                names=["doc_id", "copies", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            flags, ids, first, second, copies, texts = (batch.column(j).to_pylist() for j in range(1, 7))
            rows, successors = [], []
            for row in zip(zip(flags, first, second, strict=True), ids, copies, texts, strict=True):
                if waiting and waiting[0][0] != row[0]:
                    if not waiting[0][0][0]:  # a guard has no successor here
                        rows += waiting
                        successors += [row[3]] * len(waiting)
                    waiting = []
                if waiting and waiting[-1][1] == row[1]:
                    waiting[-1] = (*waiting[-1][:2], waiting[-1][2] + row[2], row[3])
                else:
                    waiting.append(row)
            if rows:
                yield results(rows, successors)

    return in_order.mapInArrow(run, _RESULT)


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    scratch = Scratch(docs.sparkSession, "imatch")
    named = keyed(docs, id_col, text_col)
    ids = scratch.write(named.select("first", "second", F.length("text").cast("bigint").alias("n")), "ids")
    facts = ids.agg(F.count("*").alias("rows"), F.sum("n").alias("chars")).first()
    terms = scratch.write(lexicon(named, facts["rows"]), "lexicon").toArrow()["term"].to_numpy()
    band = np.sort(terms.astype(np.int64).view(np.uint64))
    points = split_points(ids, facts["rows"], facts["chars"] or 0)
    signed = _signed(_in_order(named, ids, points), band)
    copies = F.when(F.col("copies") > 1, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array(F.lit(1).cast("bigint")))
    return signed.select("*", F.explode(copies)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op13_imatch")
def op13_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(given(spark, sf_dir, "documents"))
