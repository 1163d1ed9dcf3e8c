"""Jaccard self-join of word n-gram sets, and the groups its links form.

The join uses prefix filtering with the rarest n-grams first:

1. Texts are packed into blocks of a few megabytes. Each block sends its
   distinct n-gram keys, with the number of its texts that hold them, to key
   ranges; each range adds up and answers every block. So every block learns the
   number of texts that hold each of its n-grams, and a frequent n-gram is one
   number per block.
2. Within a set the n-grams are ordered by that number, then by hash. Two sets
   can only link if they share one of the first n - ceil(t * n) + 1. A set
   whose unique n-grams fill that prefix has no partner and goes no further.
3. Sets that are equal are one class from here on. Prefix n-grams are
   joined; the positions bound what two sets can still share (positional
   filter), their sizes must fit (length filter), and counts of n-grams by hash
   class bound their difference (suffix filter). What is left is verified once
   per pair on the whole sets.
4. In a list of classes with the same prefix n-gram, first each is tried
   against the one with the fewest unique n-grams. Classes linked so far are one
   component; then only pairs of different components are tried, each member
   outside the list's largest component against the others. A group of near
   copies so costs its size, and no link between components is missed.

Every text is used whole. Hashes of n-grams have 64 bits and classes 128.

Defined results: NULL, empty and wordless texts have no n-grams and link with
nothing; fewer words than `width` are one n-gram; repeated rows are kept, and
rows with the same id are one document for `component_id`; rows without an id
are counted, but name no group; columns beside the id and the text are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm import textkernel as K
from ratingloom.llm.components import connected
from ratingloom.llm.registry import given, query
from ratingloom.llm.scratch import Scratch, by_ids

#: Bytes of text in a block; keys that one range adds up.
BLOCK_BYTES, RANGE_KEYS = 3 << 20, 4 << 20
#: Hash classes of the suffix filter.
SUFFIX_CLASSES = 16
#: Counting uses the upper 48 bits of a hash.
KEY_SHIFT = np.uint64(16)


def _compress(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def blocks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """block, ids, size, bounds, texts: the texts packed and compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(1), BLOCK_BYTES):
                raw = s.data.tobytes()
                ids = batch.column(0).slice(s.first, s.count)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, s.count], pa.int32()), ids),
                        pa.array([len(raw)], pa.int64()), pa.array([s.bounds.astype("<i8").tobytes()], pa.binary()), pa.array([_compress(raw)], pa.binary()),
                    ],
                    names=["block", "ids", "size", "bounds", "texts"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"block string, ids array<{kind}>, size bigint, bounds binary, texts binary"
    )


def _sets(size: int, bounds: bytes, texts: bytes, width: int) -> list[np.ndarray]:
    """The n-gram sets of a block's texts."""
    data = np.frombuffer(pa.decompress(texts, decompressed_size=size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    edges = np.frombuffer(bounds, "<i8")
    out: list[np.ndarray] = []
    start, n = 0, len(edges) - 1
    while start < n:
        end = min(n, max(start + 1, int(np.searchsorted(edges, edges[start] + K.SLICE_BYTES, side="right")) - 1))
        part = K.Slice(data[edges[start] : edges[end]], edges[start : end + 1] - edges[start], start)
        out.extend(K.shingles(K.words(part), width, part.count))
        start = end
    return out


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a block in order, and how many of its texts hold each."""
    if not sets:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(np.concatenate(sets) >> KEY_SHIFT, return_counts=True)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    steps = np.diff(keys)
    wide = bool(len(steps) and steps.max() >= 1 << 32)
    body = steps.astype("<u8" if wide else "<u4").tobytes()
    return struct.pack("<qQ?q", len(keys), int(keys[0]), wide, len(body)) + body + _compress(counts.astype("<u4").tobytes())


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, first, wide, size = struct.unpack_from("<qQ?q", raw)
    at = struct.calcsize("<qQ?q")
    keys = np.empty(n, np.uint64)
    keys[0] = first
    keys[1:] = np.frombuffer(raw, "<u8" if wide else "<u4", count=n - 1, offset=at)
    np.cumsum(keys, out=keys)
    counts = np.frombuffer(pa.decompress(raw[at + size :], decompressed_size=4 * n, codec="zstd", asbytes=True), "<u4")
    return keys, counts


def _range_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(48 - bits)).astype(np.int64)


def counted(blocks: DataFrame, width: int, bits: int) -> DataFrame:
    """block, part, found: for each key range of a block the number of texts, in all blocks, that hold each key."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = _keys(_sets(row["size"], row["bounds"], row["texts"], width))
                of = _range_of(keys, bits)
                parts = np.unique(of)
                cuts = np.append(np.searchsorted(of, parts), len(of))
                packed = [_pack(keys[a:b], counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts, pa.int64()), pa.array([row["block"]] * len(parts), pa.string()), pa.array(packed, pa.binary())], names=["part", "block", "keys"]
                )

    def add(rows: pa.Table) -> pa.Table:
        lists = [_unpack(x) for x in rows.column("keys").to_pylist()]
        keys, counts = np.concatenate([k for k, _ in lists]), np.concatenate([c for _, c in lists]).astype(np.int64)
        _, place = np.unique(keys, return_inverse=True)
        total = np.minimum(np.bincount(place, weights=counts), 0xFFFFFFFF)[place].astype("<u4")
        ends = np.cumsum([len(k) for k, _ in lists])
        found = [_compress(total[e - len(k) : e].tobytes()) for e, (k, _) in zip(ends, lists, strict=True)]
        sizes = pa.array([len(k) for k, _ in lists], pa.int64())
        return pa.table({"block": rows.column("block"), "part": rows.column("part"), "size": sizes, "found": pa.array(found, pa.binary())})

    sent = blocks.select("block", "size", "bounds", "texts").mapInArrow(send, "part bigint, block string, keys binary")
    return sent.groupBy("part").applyInArrow(add, "block string, part bigint, size bigint, found binary")


def prepared(blocks: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame:
    """One row per document: n, cls, and for those that may have a partner unique, prefix, shape, grams.

    unique is the number of n-grams no other text has; prefix holds the others
    of the prefix, rarest first; shape counts n-grams by hash class.
    """
    kind = blocks.schema["ids"].dataType.elementType

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        [row] = left.to_pylist()
        sets = _sets(row["size"], row["bounds"], row["texts"], width)
        keys, _ = _keys(sets)
        answers = sorted(right.to_pylist(), key=lambda r: r["part"])
        total = [np.frombuffer(pa.decompress(r["found"], decompressed_size=4 * r["size"], codec="zstd", asbytes=True), "<u4") for r in answers]
        held = np.concatenate(total) if total else np.zeros(0, "<u4")
        if len(held) != len(keys):
            raise ValueError(f"block {row['block']}: {len(held)} counts for {len(keys)} keys")
        sizes, names, uniques, prefixes, shapes, grams = [], [], [], [], [], []
        for own in sets:
            n = len(own)
            sizes.append(n)
            names.append(hashlib.blake2b(own.astype("<u8").tobytes(), digest_size=16).hexdigest() if n else None)
            length = n - -(-percent * n // 100) + 1
            often = held[np.searchsorted(keys, own >> KEY_SHIFT)]
            unique = int((often == 1).sum())
            if n == 0 or unique >= length:
                uniques.append(None), prefixes.append(None), shapes.append(None), grams.append(None)
                continue
            order = np.lexsort((own, often))
            uniques.append(unique)
            prefixes.append(own[order[unique:length]].view(np.int64))
            shapes.append(np.bincount((own & np.uint64(SUFFIX_CLASSES - 1)).astype(np.int64), minlength=SUFFIX_CLASSES).astype(np.int32))
            grams.append(own.view(np.int64))
        return pa.table({
            "doc_id": pa.array(row["ids"], left.schema.field("ids").type.value_type), "n": pa.array(sizes, pa.int64()), "cls": pa.array(names, pa.string()),
            "unique": pa.array(uniques, pa.int32()), "prefix": pa.array(prefixes, pa.list_(pa.int64())),
            "shape": pa.array(shapes, pa.list_(pa.int32())), "grams": pa.array(grams, pa.list_(pa.int64())),
        })

    schema = f"doc_id {kind.simpleString()}, n bigint, cls string, unique int, prefix array<bigint>, shape array<int>, grams array<bigint>"
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, schema)


def least_shared(na: Column, nb: Column, percent: int) -> Column:
    """The n-grams two sets of these sizes must share to link."""
    return F.ceil(percent * (na + nb) / (100 + percent))


def _possible(percent: int) -> Column:
    """Length and positional filter for a shared prefix n-gram of p and q."""
    na, nb = F.col("p.n"), F.col("q.n")
    rest = F.least(na - F.col("p.pos"), nb - F.col("q.pos"))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (rest >= least_shared(na, nb, percent))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, each checked on the whole sets after the suffix filter."""
    of = lambda s: sets.select(F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("shape").alias(f"shape{s}"), F.col("grams").alias(f"grams{s}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    apart = F.aggregate(F.zip_with("shapea", "shapeb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    na, nb = F.col("na"), F.col("nb")
    shared = F.size(F.array_intersect("gramsa", "gramsb"))
    fits = both.where(apart <= na + nb - 2 * least_shared(na, nb, percent))
    return fits.where(100 * shared >= percent * (na + nb - shared)).select("a", "b")


def linked(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Two documents link when 100 * shared >= percent * union of their distinct
    `width`-word n-grams; component_id is the smallest id reachable by links.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram-join")
    blocks = scratch.write(blocks_of(docs, id_col, text_col), "blocks", compression="none")
    size = blocks.agg(F.sum("size")).first()[0] or 0
    bits = max(6, int(size / 6 / RANGE_KEYS).bit_length())  # a word and its space are about six bytes
    rows = scratch.write(prepared(blocks, counted(blocks, width, bits), width, percent), "rows")
    scratch.drop("blocks")

    candidates = rows.where("unique IS NOT NULL")
    reps = candidates.groupBy("cls").agg(F.min("doc_id").alias("rep"))
    sets = scratch.write(
        candidates.join(reps.select("cls", F.col("rep").alias("doc_id")), ["cls", "doc_id"]).dropDuplicates(["cls"]).select("cls", "doc_id", "n", "unique", "prefix", "shape", "grams"), "sets"
    )
    postings = sets.select("cls", "n", "unique", F.posexplode("prefix").alias("i", "gram")).select("gram", "cls", "n", "unique", (F.col("unique") + F.col("i")).alias("pos"))
    shared = postings.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram")
    postings = scratch.write(postings.join(shared, "gram"), "postings")

    heads = postings.groupBy("gram").agg(F.min(F.struct((F.col("unique") / F.col("n")).alias("share"), "cls", "n", "pos")).alias("h")).select("gram", "h.cls", "h.n", "h.pos")
    star = postings.alias("p").join(heads.alias("q"), F.col("p.gram") == F.col("q.gram")).where((F.col("p.cls") != F.col("q.cls")) & _possible(percent))
    links = verified(_pairs(star), sets, percent)
    first = scratch.write(connected(links, scratch, "first"), "first")

    placed = postings.join(first.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    placed = scratch.write(placed, "placed")
    parts = placed.groupBy("gram", "component").agg(F.count("*").alias("k"))
    main = parts.groupBy("gram").agg(F.max(F.struct("k", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("gram", F.col("main.component").alias("main"))
    outside = placed.join(main, "gram").where("component <> main")
    cross = outside.alias("p").join(placed.alias("q"), F.col("p.gram") == F.col("q.gram")).where((F.col("p.component") != F.col("q.component")) & _possible(percent))
    more = verified(_pairs(cross), sets, percent)
    label = lambda s: first.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
    joined = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = scratch.write(connected(joined, scratch, "second"), "second")

    merged = second.select(F.col("node").alias("component"), F.col("component").alias("joined"))
    groups = (
        sets.select("cls", "doc_id").join(first.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        .join(merged, "component", "left").withColumn("component", F.coalesce("joined", "component"))
    )
    smallest = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    answer = scratch.write(groups.join(smallest, "component").select("cls", "component_id"), "answer")
    scratch.drop("sets", "postings", "placed", "first", "second")
    alone = rows.where("unique IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    grouped = candidates.join(answer, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return alone.union(grouped)


def _pairs(joined: DataFrame) -> DataFrame:
    """Each pair of classes once, the smaller name first."""
    a, b = F.col("p.cls"), F.col("q.cls")
    return joined.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def first_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` whose document is the smallest id of its group.

    A repeated id stays once; rows without an id all stay.
    """
    scratch = Scratch(docs.sparkSession, "first-of-each")
    groups = scratch.write(linked(docs, width, percent).where("doc_id IS NOT NULL"), "groups")
    others = scratch.write(groups.where("doc_id <> component_id").select("doc_id").distinct(), "others")
    repeated = scratch.write(groups.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    kept = by_ids(docs, others, "left_anti")
    once = by_ids(kept, repeated, "left_semi").dropDuplicates(["doc_id"])
    return by_ids(kept, repeated, "left_anti").union(once).select(*docs.columns)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM both_ways UNION SELECT r.a, t.b FROM r JOIN both_ways t ON r.b = t.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.b, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY 1) m ON m.a = s.doc_id
"""


@query("op6_ngram_join", ORACLE)
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(given(spark, sf_dir, "documents"), width=4, percent=85)
