"""Ranked lexical search: documents are grouped by which of an item's terms they hold.

1. One pass over the texts counts each document's terms and keeps the postings of
   terms that some item has (a bit filter of fixed size leaves out the others; a
   larger benchmark lets more terms through, never fewer). The documents of an Arrow
   batch are stored as one packed row: their ids and lengths, and per term the
   documents that hold it and how often.
2. Document frequencies are one aggregate over the packed rows; the number of
   documents and of their terms another.
3. Items are searched in blocks of bounded size. Within a packed row every term of
   the block is a bitmap over the documents. The bitmaps of an item's terms are turned
   into one mask per document, and documents of equal masks are one group. A mask's
   maximum is the sum of its terms' largest contributions in the packed row. Masks
   are scored from the largest maximum down; as soon as the next maximum is below the
   k-th score so far, which a task keeps across its packed rows, no document of the
   other masks can be among the best, and they are left out unscored.

Scores are whole numbers: the weight of a term is floor(1000 ln((2N+2)/(2df+1))), its
contribution weight * (10^9 tf div (1000 tf + 8m)) with m = 10 + 90 n N div L, where
N documents have terms, L is all their terms, n the document's own.

Defined results: a term is a run of letters, digits and characters beyond ASCII, A-Z
as a-z; a NULL or empty text has none, as have items of such texts, which give no row;
a document without an id takes no part and is not counted; rows that repeat an id are
documents of their own and rank one after the other; items that share an id are one
item with the terms of all; an item without an id gives no row; equal scores go by the
smaller id; scores of 0 are no hit; empty tables give no rows. Terms are compared by
64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm import textkernel as tk
from ratingloom.llm.registry import given, query
from ratingloom.llm.rounds import blocks_of, group_starts, ranked, search, together
from ratingloom.llm.scratch import Scratch
from ratingloom.llm.template_decontamination import FILTER_BITS, filter_bits

#: Terms of the items of a block at most (an item with more is a block of its own), documents scored at a time at least.
BLOCK_TERMS, STEP = 50_000, 256
TERM_BYTES = ~tk.classes(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

PACKED = "ids binary, lengths binary, terms binary, starts binary, docs binary, tf binary, n_docs bigint, n_terms bigint"
FOUND = "item_id bigint, doc_id bigint, score bigint, matched bigint"


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term (a hash) of every distinct term of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            for s in tk.slices(batch.column(1)):
                w = tk.words(s, TERM_BYTES)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s.first + w.text]), pa.array(w.hash.view(np.int64))], names=["item_id", "term"])

    named = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint"), F.col(text_col))
    return named.mapInArrow(run, "item_id bigint, term bigint").distinct()


def packed_postings(docs: DataFrame, bits: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per Arrow batch of documents: postings of the terms whose bits are set, by term; and the counts of all terms."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            lengths = np.zeros(len(ids), np.int64)
            parts = []
            for s in tk.slices(batch.column(1)):
                w = tk.words(s, TERM_BYTES)
                lengths[s.first : s.first + s.count] = np.bincount(w.text, minlength=s.count)
                chosen = np.flatnonzero(open_[(w.hash & np.uint64(FILTER_BITS - 1)).astype(np.int64)])
                term, doc = w.hash[chosen], s.first + w.text[chosen]
                order = np.lexsort((doc, term))
                term, doc = term[order], doc[order]
                at = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])))) if len(term) else np.zeros(0, np.int64)
                parts.append((term[at], doc[at], np.diff(np.append(at, len(term)))))
            term, doc, tf = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
            order = np.lexsort((doc, term))  # a text lies in one slice, so no pair comes twice
            term, doc, tf = term[order], doc[order], tf[order]
            at = group_starts(term)
            row = [ids.astype("<i8"), lengths.astype("<i8"), term[at].astype("<u8"), np.append(at, len(term)).astype("<i4"), doc.astype("<i4"), tf.astype("<i4")]
            columns = [pa.array([x.tobytes()], pa.binary()) for x in row]
            columns += [pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "lengths", "terms", "starts", "docs", "tf", "n_docs", "n_terms"])

    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint"), F.col(text_col))
    return named.mapInArrow(run, PACKED)


def frequencies(packed: DataFrame) -> DataFrame:
    """term, df over all packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = np.diff(np.frombuffer(starts, "<i4").astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, "<i8")), pa.array(held)], names=["term", "df"])

    return packed.select("terms", "starts").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


@dataclass
class Block:
    """Items searched together: their ids, and per item its terms (hashes, ascending) with their weights."""

    ids: list[int]
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    documents: int
    total: int


def block_of(items: pa.Table, held: dict[int, int], documents: int, total: int) -> Block:
    """Terms that no document holds are left out."""
    out = Block([], [], [], documents, total)
    for item, terms in zip(items["item_id"].to_pylist(), items["terms"].to_pylist(), strict=True):
        known = np.array([t for t in terms if t in held], np.int64)
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held[t] + 1))) for t in known.tolist()], np.int64)
        order = np.argsort(known.view(np.uint64))
        out.ids.append(item)
        out.terms.append(known.view(np.uint64)[order])
        out.weights.append(weight[order])
    return out


class Postings:
    """A packed row, with what the block's items need of it."""

    def __init__(self, row: dict[str, bytes], wanted: np.ndarray, documents: int, total: int):
        self.ids, lengths = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lengths"], "<i8")
        terms, starts = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["starts"], "<i4").astype(np.int64)
        docs, tf = np.frombuffer(row["docs"], "<i4").astype(np.int64), np.frombuffer(row["tf"], "<i4").astype(np.int64)
        if float(lengths.max(initial=0)) * 90 * documents < 2**62:
            m = 10 + (90 * lengths * documents) // total
        else:
            m = np.array([10 + (90 * n * documents) // total for n in lengths.tolist()], np.int64)
        at = np.flatnonzero(np.isin(terms, wanted, assume_unique=True))
        self.terms, sizes = terms[at], (starts[1:] - starts[:-1])[at]
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        place = np.repeat(starts[at] - self.starts[:-1], sizes) + np.arange(self.starts[-1])  # postings of the wanted terms
        of, doc = np.repeat(np.arange(len(at)), sizes), docs[place]
        self.part = (1_000_000_000 * tf[place]) // (1000 * tf[place] + 8 * m[doc])
        self.most = np.maximum.reduceat(self.part, self.starts[:-1]) if len(at) else np.zeros(0, np.int64)
        self.key = of * len(self.ids) + doc
        self.width = -(-len(self.ids) // 8)
        cell = of * self.width + (doc >> 3)
        first = group_starts(cell)
        self.bitmaps = np.zeros(len(at) * self.width, np.uint8)
        if len(first):
            self.bitmaps[cell[first]] = np.bitwise_or.reduceat((128 >> (doc & 7)).astype(np.uint8), first)
        self.bitmaps = self.bitmaps.reshape(len(at), self.width)

    def masks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct masks as flags per term, the mask of each document) of some terms' bitmaps."""
        flags = np.unpackbits(self.bitmaps[rows], axis=1, count=len(self.ids))
        by_doc = np.packbits(flags, axis=0).T
        words = np.zeros((len(self.ids), -(-by_doc.shape[1] // 8) * 8), np.uint8)
        words[:, : by_doc.shape[1]] = by_doc
        keys = words.view(np.uint64)[:, 0] if words.shape[1] == 8 else words.view(f"V{words.shape[1]}")[:, 0]
        _, first, of = np.unique(keys, return_index=True, return_inverse=True)
        return flags[:, first].T, of

    def scores(self, rows: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
        keys = (rows[:, None] * len(self.ids) + docs[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        part = np.where(self.key[at] == keys, self.part[at], 0).reshape(len(rows), len(docs))
        return weights @ part


Best = tuple[np.ndarray, np.ndarray, np.ndarray]  # scores, document ids, matched terms; best first


def best_of(p: Postings, terms: np.ndarray, weights: np.ndarray, best: Best, floor: int, k: int) -> Best:
    """The k best of those so far and the packed row's documents, its masks by descending maximum."""
    at = np.minimum(np.searchsorted(p.terms, terms), max(len(p.terms) - 1, 0))
    here = np.flatnonzero(p.terms[at] == terms) if len(p.terms) else np.zeros(0, np.int64)
    if not len(here):
        return best
    rows, weights = at[here], weights[here]
    flags, of = p.masks(rows)
    most = flags.astype(np.int64) @ (weights * p.most[rows])
    order = np.argsort(-most, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    docs = np.argsort(place[of], kind="stable")  # the documents, mask after mask
    ends = np.cumsum(np.bincount(place[of], minlength=len(order)))
    mask = done = 0
    while mask < len(order):
        cut = max(floor, int(best[0][-1]) if len(best[0]) == k else 1)
        if most[order[mask]] < cut:
            break
        last = int(np.searchsorted(ends, done + STEP))  # whole masks, and only those that may reach the cut
        last = max(mask, min(last, len(order) - 1))
        last = min(last, mask + int(np.searchsorted(-most[order[mask:]], -cut, side="right")) - 1)
        chosen = docs[done : ends[last]]
        scores = p.scores(rows, weights, chosen)
        keep = np.flatnonzero(scores >= cut)
        merged = (
            np.concatenate((best[0], scores[keep])), np.concatenate((best[1], p.ids[chosen[keep]])),
            np.concatenate((best[2], flags.sum(axis=1, dtype=np.int64)[of[chosen[keep]]])),
        )
        top = np.lexsort((merged[1], -merged[0]))[:k]
        best = merged[0][top], merged[1][top], merged[2][top]
        mask, done = last + 1, int(ends[last])
    return best


def _searched(packed: DataFrame, block: Block, floors: dict[int, int], k: int) -> DataFrame:
    shared = packed.sparkSession.sparkContext.broadcast((block, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, floors = shared.value
        wanted = np.unique(np.concatenate(block.terms)) if block.terms else np.zeros(0, np.uint64)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        best = [none] * len(block.ids)
        for batch in batches:
            for row in batch.to_pylist():
                p = Postings(row, wanted, block.documents, block.total)
                for i, (item, terms, weights) in enumerate(zip(block.ids, block.terms, block.weights, strict=True)):
                    best[i] = best_of(p, terms, weights, best[i], floors.get(item, 1), k)
        columns = [np.repeat(np.array(block.ids, np.int64), [len(b[0]) for b in best]), *(np.concatenate([none[j], *(b[j] for b in best)]) for j in (1, 0, 2))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score", "matched"])

    return packed.select("ids", "lengths", "terms", "starts", "docs", "tf").mapInArrow(run, FOUND)


def best_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score, matched (how many of the item's terms the document holds): each item's k best documents."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "masks")
    terms = scratch.write(item_terms(items), "terms")
    packed = scratch.write(packed_postings(docs, filter_bits(terms.withColumnRenamed("term", "hash"))), "postings")
    counts = packed.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l"), F.count("*").alias("rows")).first()
    held = scratch.write(frequencies(packed), "frequencies")
    grouped = terms.groupBy("item_id").agg(F.collect_list("term").alias("terms")).withColumn("size", F.size("terms"))
    parts = max(1, -(-terms.count() // BLOCK_TERMS))
    blocks = scratch.write(blocks_of(grouped.coalesce(parts), "size", BLOCK_TERMS), "blocks")
    order = [F.col("score").desc(), F.col("doc_id"), F.col("matched").desc()]
    best = lambda found: ranked(found.select("item_id", "doc_id", "score", "matched"), ["item_id"], order, k)

    def floors(first: DataFrame) -> dict[int, int]:
        full = first.groupBy("item_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).toArrow()
        return dict(zip(full["item_id"].to_pylist(), full["least"].to_pylist(), strict=True))

    def found() -> Iterator[DataFrame]:
        for number, (b,) in enumerate(blocks.select("block").distinct().orderBy("block").toLocalIterator()):
            own = blocks.where(F.col("block") == b)
            df = held.join(own.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").toArrow()  # at most the terms of a block
            block = block_of(own.select("item_id", "terms").toArrow(), dict(zip(df["term"].to_pylist(), df["df"].to_pylist(), strict=True)), counts["n"] or 0, counts["l"] or 1)
            yield search(packed, counts["rows"], "ids", lambda part, low, block=block: _searched(part, block, low, k), best, floors, scratch, f"first-{number}")

    out = together(found(), scratch, "found")
    if out is None:
        out = best(spark.createDataFrame([], FOUND))
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", "matched")


_TERMS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, {_TERMS} FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} FROM benchmark WHERE item_id IS NOT NULL)),
n AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY 1),
c AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c WHERE term IN (SELECT term FROM q) GROUP BY 1),
s AS (
  SELECT q.item_id, p.r, any_value(p.doc_id) AS doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n.n * nn) // l)))) AS BIGINT) AS score, count(*) AS matched
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN n ON n.r = p.r, c GROUP BY 1, 2
), o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, matched DESC) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score, matched FROM o WHERE rank <= 10
"""


@query("op11_presence_masks", ORACLE)
def op11_presence_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_documents(given(spark, sf_dir, "documents"), given(spark, sf_dir, "benchmark"))
