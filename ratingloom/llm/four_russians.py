"""Hard negatives by full exact scores from subset-sum tables (the Four Russians' method).

Vectors become whole numbers, floor(256 * x). A candidate is stored as bit planes:
plane p holds bit p of every component (two's complement), eight components a byte.
For each group of eight dimensions an anchor has a table with the sum of its
components over each of the 256 subsets, so the sum over one plane of a candidate is
one lookup per byte, and the inner product is the planes' sums shifted by their place
and added; the plane of the sign is subtracted.

Candidates are packed once, an Arrow batch a row. Anchors go in blocks of bounded size;
each task builds their tables, a few anchors at a time, and keeps the best rows so far:
first of the anchors' own label (the positives), then, with those scores known, of
the other labels within each positive's range (the negatives). Where there are many
packed rows, a part of them is scored first and gives floors for the rest.

Defined results: rows whose id, label or vector is NULL, or whose vector holds NULL or
a component that is not finite, take no part; a shorter vector counts as zero where it
ends, an empty one as zero throughout; a component beyond 2**62 once scaled counts as
2**62 of its sign, a score beyond 64 bits as the nearest such number; rows with the anchor's id are neither positives nor negatives;
equal scores go by the smaller id; a row that repeats an id is a candidate of its own;
anchors that share an id are answered once, by the one with the smallest label, then
vector; a positive without negatives in range gives no row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm.registry import given, query
from ratingloom.llm.rounds import group_starts, ranked, search, together
from ratingloom.llm.scratch import Scratch

GROUP, SCALE, LARGEST = 8, 256, 2**62
#: Bytes of the vectors of a block of anchors at most, and anchors whose tables are made at a time.
BLOCK_BYTES, TABLES = 8 << 20, 128
LONG = (-(2**63), 2**63 - 1)

SCALED = "vec_id bigint, label bigint, width bigint, largest double, v binary"
PACKED = "ids binary, labels binary, planes binary, n_planes bigint, n_groups bigint"
PAIRS = "anchor_id bigint, slot bigint, vec_id bigint, score bigint"


def scaled(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """vec_id, label, components as 64-bit integers, their number and the largest magnitude, of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, raw, width, largest = [], [], [], []
            for k, row in enumerate(batch.column(2)):
                if not row.is_valid or row.values.null_count:
                    continue
                x = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(SCALE * x), -float(LARGEST), float(LARGEST))
                chosen.append(k)
                raw.append(x.astype("<i8").tobytes())
                width.append(len(x))
                largest.append(float(np.abs(x).max(initial=0)))
            kept = [batch.column(j).take(pa.array(chosen, pa.int64())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(width, pa.int64()), pa.array(largest, pa.float64()), pa.array(raw, pa.binary())], names=["vec_id", "label", "width", "largest", "v"])

    named = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("v"))
    return named.where("vec_id IS NOT NULL AND label IS NOT NULL").mapInArrow(run, SCALED)


def matrix(raw: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(raw), width), np.int64)
    for k, x in enumerate(raw):
        row = np.frombuffer(x, "<i8")
        out[k, : len(row)] = row
    return out


def bit_planes(x: np.ndarray) -> np.ndarray:
    """(planes, groups, rows): bit p of eight components of a row as a byte; the last plane is the sign."""
    planes = max(int(v).bit_length() for v in (x.max(initial=0), ~x.min(initial=0))) + 1
    wide = np.zeros((len(x), -(-x.shape[1] // GROUP) * GROUP), np.int64)
    wide[:, : x.shape[1]] = x
    return np.stack([np.packbits(((wide >> p) & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(planes)])


def packed_rows(stored: DataFrame, width: int) -> DataFrame:
    """One row per Arrow batch: ids and labels by label and id, and the bit planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels = (np.asarray(batch.column(j).to_numpy(zero_copy_only=False), np.int64) for j in (0, 1))
            order = np.lexsort((ids, labels))
            planes = bit_planes(matrix(batch.column(2).to_pylist(), width)[order])
            row = [ids[order].astype("<i8").tobytes(), labels[order].astype("<i8").tobytes(), np.ascontiguousarray(planes).tobytes()]
            columns = [pa.array([x], pa.binary()) for x in row] + [pa.array([n], pa.int64()) for n in planes.shape[:2]]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "planes", "n_planes", "n_groups"])

    return stored.select("vec_id", "label", "v").mapInArrow(run, PACKED)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each group of eight dimensions the sum over every subset of them."""
    n, width = anchors.shape
    wide = np.zeros((n, -(-width // GROUP) * GROUP), anchors.dtype)
    wide[:, :width] = anchors
    parts = wide.reshape(n, -1, GROUP)
    out = np.zeros((parts.shape[1], 1 << GROUP, n), anchors.dtype)
    for bit in range(GROUP):  # subsets with this bit: those without it, and the component
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + parts[:, :, bit].T[:, None, :]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): the inner products, by lookups, shifts and sums."""
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    for p in range(len(planes) - 1, -1, -1):  # from the sign down: shift what is there, add the plane
        plane = np.zeros_like(total)
        for g in range(planes.shape[1]):
            plane += tables[g][planes[p, g]]
        total = total * 2 + plane if p < len(planes) - 1 else -plane
    return total if total.dtype != object else np.minimum(np.maximum(total, LONG[0]), LONG[1]).astype(np.int64)


class Best:
    """The first k rows of each (anchor, slot) so far: scores down, then ids up."""

    def __init__(self, keys: int, k: int):
        self.k, self.cut = k, np.full(keys, LONG[0])
        self.key, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(key):
            return
        key, ids, score = np.concatenate((self.key, key)), np.concatenate((self.id, ids)), np.concatenate((self.score, score))
        order = np.lexsort((ids, ~score, key))
        key = key[order]
        starts = group_starts(key)
        sizes = np.diff(np.append(starts, len(key)))
        keep = np.arange(len(key)) - np.repeat(starts, sizes) < self.k
        self.key, self.id, self.score = key[keep], ids[order][keep], score[order][keep]
        full = np.flatnonzero(sizes >= self.k)
        self.cut[key[starts[full]]] = score[order][starts[full] + self.k - 1]


def most_of(values: np.ndarray, k: int) -> np.ndarray:
    """Per column the k-th largest value (the least, if fewer)."""
    return np.partition(values, len(values) - k, axis=0)[len(values) - k] if len(values) > k else values.min(axis=0)


Anchors = dict[str, np.ndarray]


def positives_in(row: dict, planes: np.ndarray, anchors: Anchors, best: Best) -> None:
    """Adds the row's candidates of the anchors' own labels."""
    ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
    for start in range(0, len(anchors["id"]), TABLES):
        part = slice(start, start + TABLES)
        own = anchors["label"][part]
        tables = None
        for label in np.unique(own):
            a, b = np.searchsorted(labels, label), np.searchsorted(labels, label, side="right")
            if a == b:
                continue
            tables = subset_sums(anchors["v"][part]) if tables is None else tables
            mine = np.flatnonzero(own == label)
            s = scores(tables[:, :, mine], planes[:, :, a:b])
            key = start + mine
            bar = np.maximum(best.cut[key], most_of(s, best.k + 1))  # one more, as the anchor itself may be among them
            r, c = np.nonzero((s >= bar) & (ids[a:b, None] != anchors["id"][key]))
            best.add(key[c], ids[a:b][r], s[r, c])


def negatives_in(row: dict, planes: np.ndarray, anchors: Anchors, best: Best) -> None:
    """Adds the row's candidates of other labels that lie in the range of each of the anchors' positives."""
    ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
    slots = anchors["low"].shape[1]
    for start in range(0, len(anchors["id"]), TABLES):
        part = slice(start, start + TABLES)
        s = scores(subset_sums(anchors["v"][part]), planes)
        other = (labels[:, None] != anchors["label"][part]) & (ids[:, None] != anchors["id"][part])
        keys = (np.arange(len(anchors["id"]))[part] * slots)[:, None] + np.arange(slots)
        for j in range(slots):
            inside = other & (s <= anchors["high"][part, j]) & (s >= np.maximum(anchors["low"][part, j], best.cut[keys[:, j]]))
            if len(s) > best.k and inside.any():
                bar = most_of(np.where(inside, s, LONG[0]), best.k)
                inside &= s >= bar
            r, c = np.nonzero(inside)
            best.add(keys[c, j], ids[r], s[r, c])


def ranges(positive: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest negative score of each positive score: 30 p <= 100 n <= 90 p, in whole numbers."""
    return np.array([-((-30 * p) // 100) for p in positive], np.int64), np.array([(90 * p) // 100 for p in positive], np.int64)


def _scored(packed: DataFrame, anchors: Anchors, exact: bool, k: int, negatives: bool, floors: np.ndarray | None) -> DataFrame:
    """The best rows of each task for the anchors of a block."""
    shared = packed.sparkSession.sparkContext.broadcast((anchors, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, floors = shared.value
        slots = anchors["low"].shape[1] if negatives else 1
        known = anchors | {"v": anchors["v"].astype(object)} if exact else anchors
        best = Best(len(anchors["id"]) * slots, k)
        if floors is not None:
            best.cut[:] = floors
        for batch in batches:
            for row in batch.to_pylist():
                planes = np.frombuffer(row["planes"], np.uint8).reshape(row["n_planes"], row["n_groups"], -1)
                (negatives_in if negatives else positives_in)(row, planes, known, best)
        columns = [anchors["id"][best.key // slots], best.key % slots, best.id, best.score]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "slot", "vec_id", "score"])

    return packed.mapInArrow(run, PAIRS)


def _rounds(packed: DataFrame, count: int, anchors: Anchors, exact: bool, k: int, negatives: bool, scratch: Scratch, name: str) -> DataFrame:
    slots = anchors["low"].shape[1] if negatives else 1
    best = lambda found: ranked(found.select("anchor_id", "slot", "vec_id", "score"), ["anchor_id", "slot"], [F.col("score").desc(), F.col("vec_id")], k)

    def floors(first: DataFrame) -> dict:
        full = first.groupBy("anchor_id", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).toArrow()
        cut = np.full(len(anchors["id"]) * slots, LONG[0], np.int64)
        place = np.searchsorted(anchors["id"], full["anchor_id"].to_numpy()) * slots + full["slot"].to_numpy()
        cut[place] = full["least"].to_numpy()
        return {"cut": cut}

    return search(packed, count, "ids", lambda part, low: _scored(part, anchors, exact, k, negatives, low.get("cut")), best, floors, scratch, name)


def mined(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `is_anchor` reads vec_id and label. An anchor's positives are its best other rows of
    the same label; a positive's negatives the best rows of other labels with 30 % to 90 % of its score.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    stored = scratch.write(scaled(vectors, id_col, label_col, vector_col), "vectors")
    facts = stored.agg(F.max("width").alias("w"), F.max("largest").alias("m")).first()
    width, largest = max(facts["w"] or 0, 1), facts["m"] or 0.0
    exact = largest * largest * width * 2 >= 2.0**62  # beyond this the sums are made of Python's integers
    spread = spark.sparkContext.defaultParallelism
    packed = packed_rows(stored, width)
    packed = scratch.write(packed.repartition(spread, F.xxhash64("ids")), "packed")
    count = packed.count()

    chosen = stored.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.label", "a.v")
    anchors = scratch.write(chosen, "anchors")
    per_block = max(TABLES, BLOCK_BYTES // (8 * width))
    blocks = max(1, -(-anchors.count() // per_block))
    at = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))

    def found() -> Iterator[DataFrame]:
        for b in range(blocks):
            table = anchors.where(at == b).orderBy("vec_id").toArrow()  # a block of bounded bytes
            if not table.num_rows:
                continue
            block = {"id": table["vec_id"].to_numpy(), "label": table["label"].to_numpy(), "v": matrix(table["v"].to_pylist(), width)}
            positives = scratch.write(_rounds(packed, count, block, exact, n_positives, False, scratch, f"first-positives-{b}").select("anchor_id", "rank", "vec_id", "score"), f"positives-{b}")
            known = positives.toArrow()
            place = np.searchsorted(block["id"], known["anchor_id"].to_numpy()), known["rank"].to_numpy() - 1
            low, high = np.ones((len(block["id"]), n_positives), np.int64), np.zeros((len(block["id"]), n_positives), np.int64)  # no positive, no range
            low[place], high[place] = ranges(known["score"].to_pylist())
            negatives = _rounds(packed, count, block | {"low": low, "high": high}, exact, n_negatives, True, scratch, f"first-negatives-{b}")
            named = positives.select("anchor_id", (F.col("rank") - 1).cast("bigint").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
            out = negatives.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").join(named, ["anchor_id", "slot"])
            yield out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

    out = together(found(), scratch, "found")
    if out is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return out


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(CAST(a.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), r AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""


@query("op12_four_russians", ORACLE)
def op12_four_russians(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = given(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)
