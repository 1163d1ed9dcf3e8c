"""Benchmark decontamination by templates.

Texts become tokens (runs of letters, runs of digits). Numbers, units after a
number and names (capitalised words inside a sentence) become typed placeholders
and their values go into slots, so a question asked again with other numbers or
names has the same template. Every five consecutive tokens are a window.

1. Windows of the benchmark set bits in a filter of fixed size, which the scan of
   the documents uses to send on only windows that may match.
2. The rarest windows of an item that must be touched to reach the coverage find
   candidates by a hash join; all windows of the candidates are then joined per
   document.
3. A document holds an item if it has at least `percent` of its windows and, on the
   alignment with most matches, each value of the item stands for one value of
   the document throughout.

Windows with fewer than two literal tokens say nothing and do not count. A
capitalised word that begins a sentence of an item may follow other words in a
document, where it reads as a name; windows of items are indexed under both
readings, and under the second one the word has to be the same.

Every item is also found by its whole token sequence, case aside, which finds items with
few windows and copies whose names are written in another case: there every character of three or more bytes is
a token of its own, so items in scripts without spaces take part. A sequence is
sent on by a filter like the windows are, and joined by its length and hash.

Defined results: NULL and short texts hold nothing; repeated rows with one id are
one document; rows without an id are not judged (and stay when a corpus is
cleaned); only pairs (document, item) that hold are returned; columns beside
the id and the text are not read; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratingloom.llm import textkernel as K
from ratingloom.llm.registry import given, query
from ratingloom.llm.scratch import Scratch, by_ids

WIDTH, PERCENT, LITERALS = 5, 80, 2
#: Bits of the filter.
FILTER_BITS = 1 << 22
#: Words that are a unit when they follow a number.
UNITS = (
    "mm cm m km kilometers kilometres meters metres meter metre miles mile inch inches feet foot ft yards yard "
    "mg g kg grams gram kilograms kilogram pounds pound lbs lb ounces ounce oz tons ton "
    "ml l liters litres liter litre gallons gallon cups cup "
    "seconds second sec minutes minute min hours hour hr days day weeks week months month years year "
    "dollars dollar cents cent euros euro usd eur gbp percent degrees degree watts watt kw volts volt amps amp joules joule "
    "mph kph hz khz mhz ghz kb mb gb tb"
).split()

_LETTERS, _DIGITS = K.LETTER_BYTES, K.classes(b"0123456789")
_UPPER, _LOWER = K.classes(bytes(range(0x41, 0x5B))), K.classes(bytes([*range(0x61, 0x7B), *range(0x80, 0x100)]))
_STOPS = K.classes(b".!?\n")
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0x4E554D, 0x554E4954, 0x4E414D45))


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    start, end = K.runs(_LETTERS[data], np.array([0, len(data)]))
    return np.sort(K.span_hashes(data, start, end))


_UNIT_HASHES = _unit_hashes()


def _numbers(s: K.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the numbers of a slice that has digits."""
    first, last = K.runs(_DIGITS[s.data], s.bounds)
    joined = np.zeros(len(first), bool)  # 1,000 and 3.14 are one number
    if len(first) > 1:
        gap = first[1:] - last[:-1] == 1
        between = s.data[last[:-1]]
        joined[1:] = gap & ((between == 0x2C) | (between == 0x2E)) & (K.text_of(s, first[1:]) == K.text_of(s, first[:-1]))
    keep = np.flatnonzero(~joined)
    first, last = first[keep], last[np.append(keep[1:] - 1, len(last) - 1)]
    return first, last


def templates(s: K.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens of a slice: template hash, value hash, whether a placeholder, the text they are in, whether elsewhere a name."""
    data = s.data
    letter, digit = _LETTERS[data], _DIGITS[data]
    start, end = K.runs(letter, s.bounds)
    number = np.zeros(len(start), bool)
    if digit.any():
        first, last = _numbers(s)
        order = np.argsort(np.concatenate((start, first)), kind="stable")
        number = np.concatenate((number, np.ones(len(first), bool)))[order]
        start, end = np.concatenate((start, first))[order], np.concatenate((end, last))[order]
    value, text = K.span_hashes(data, start, end), K.text_of(s, start)
    template = value.copy()
    slot = number.copy()
    template[number] = _NUMBER
    if number.any():
        after = np.flatnonzero(number[:-1] & ~number[1:] & (text[:-1] == text[1:])) + 1
        after = after[np.isin(value[after], _UNIT_HASHES)]
        template[after], slot[after] = _UNIT, True
    second = np.minimum(start + 1, max(len(data) - 1, 0))
    capital = np.flatnonzero(_UPPER[data[start]] & (end - start > 1) & _LOWER[data[second]] & ~number) if len(start) else np.zeros(0, np.int64)
    inner = capital[capital > 0]
    inner = inner[text[inner - 1] == text[inner]]
    stops = np.flatnonzero(_STOPS[data])
    names = inner[np.searchsorted(stops, end[inner - 1]) == np.searchsorted(stops, start[inner])]
    template[names], slot[names] = _NAME, True
    either = np.zeros(len(start), bool)
    either[capital] = True
    return template, value, slot, text, either & ~slot


def windows_of(docs: DataFrame, id_col: str, text_col: str, bits: bytes | None = None) -> DataFrame:
    """id, hash, pos, slots of every window that counts; with a filter only of those whose bit is set."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bits) if bits is not None else None
    width = WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").astype(bool) if shared is not None else None
        for batch in batches:
            for s in K.slices(batch.column(1)):
                template, value, slot, text, _ = templates(s)
                at, h = K.windows(template, text, width)
                if table is not None and len(at):
                    chosen = table[(h & np.uint64(FILTER_BITS - 1)).astype(np.int64)]
                    at, h = at[chosen], h[chosen]
                if len(at) and slot.any():
                    before = np.concatenate(([0], np.cumsum(slot)))
                    chosen = width - (before[at + width] - before[at]) >= LITERALS
                    at, h = at[chosen], h[chosen]
                if len(at) == 0:
                    continue
                begins = np.searchsorted(text, np.arange(s.count))
                inside = at[:, None] + np.arange(width)
                held = slot[inside]
                bounds = np.concatenate(([0], np.cumsum(held.sum(axis=1)))).astype(np.int32)
                slots = pa.ListArray.from_arrays(pa.array(bounds), pa.array(value[inside][held].view(np.int64)))
                ids = batch.column(0).take(pa.array(s.first + text[at]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(h.view(np.int64)), pa.array((at - begins[text[at]]).astype(np.int32)), slots], names=["id", "hash", "pos", "slots"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, hash bigint, pos int, slots array<bigint>")


ITEM_FIELDS = "base bigint, hash bigint, item_pos int, item_slots array<bigint>, item_fixed array<boolean>"


def item_windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, base, hash, item_pos, item_slots, item_fixed of every window that counts, under each reading.

    base is the hash under the item's own reading; a fixed slot has to hold the item's word.
    """
    width = WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(1)):
                template, value, slot, text, either = templates(s)
                at, base = K.windows(template, text, width)
                if len(at) == 0:
                    continue
                begins = np.searchsorted(text, np.arange(s.count))
                inside = at[:, None] + np.arange(width)
                counts = width - slot[inside].sum(axis=1) >= LITERALS
                for flags in range(1 << width):  # which words of the window read as names instead
                    read = np.array([flags >> k & 1 for k in range(width)], bool)
                    chosen = np.flatnonzero((either[inside] | ~read).all(axis=1) & counts)
                    if len(chosen) == 0:
                        continue
                    w, of = inside[chosen], text[at[chosen]]
                    _, h = K.windows(np.where(read, _NAME, template[w]).ravel(), np.repeat(np.arange(len(w)), width), width)
                    held = slot[w] | read
                    bounds = pa.array(np.concatenate(([0], np.cumsum(held.sum(axis=1)))).astype(np.int32))
                    slots = pa.ListArray.from_arrays(bounds, pa.array(value[w][held].view(np.int64)))
                    fixed = pa.ListArray.from_arrays(bounds, pa.array(np.broadcast_to(read, held.shape)[held]))
                    arrays = [pa.array(base[chosen].view(np.int64)), pa.array(h.view(np.int64)), pa.array((at[chosen] - begins[of]).astype(np.int32)), slots, fixed]
                    names = ["item_id", "base", "hash", "item_pos", "item_slots", "item_fixed"]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(s.first + of)), *arrays], names=names)

    kind = benchmark.schema[id_col].dataType.simpleString()
    return benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"item_id {kind}, {ITEM_FIELDS}")


#: Longest sequence that is looked up at every position; longer ones only where their beginning is found.
BEGINNING = 8
#: Lead bytes of characters of three or more bytes, and the two bytes that begin U+2000 to U+207F (spaces, dashes, quotes).
_LONG, _INNER = K.classes(bytes(range(0xE0, 0xF8))), K.classes(bytes(range(0x80, 0xC0)))
_TWO_BYTES = K.classes(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xE0)]))


def plain_tokens(s: K.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Value hash and text of each run of letters, number, and character of three or more bytes."""
    data = s.data
    lead = np.flatnonzero(_LONG[data])
    size = np.where(data[lead] >= 0xF0, 4, 3)
    wide = np.zeros(len(data) + 4, bool)
    for k in range(4):
        wide[lead[size > k] + k] = True
    wide = wide[: len(data)]
    last = max(len(data) - 1, 0)
    mark = (data[lead] == 0xE2) & np.isin(data[np.minimum(lead + 1, last)], (0x80, 0x81))
    begin, stop = [lead[~mark]], [(lead + size)[~mark]]
    for inside, found in (((_TWO_BYTES[data] | _INNER[data]) & ~wide, lambda flags: K.runs(flags, s.bounds)), (_DIGITS[data], lambda _: _numbers(s))):
        if inside.any():
            first, end = found(inside)
            begin.append(first)
            stop.append(end)
    start, end = np.concatenate(begin), np.concatenate(stop)
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    return K.span_hashes(data, start, end), K.text_of(s, start)


def sequence_hashes(value: np.ndarray) -> Callable[[np.ndarray, int], np.ndarray]:
    """A function of positions and a length: the hash of so many tokens from each position on."""
    n = len(value)
    up, down = K.powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * up[:n], dtype=np.uint64)))
    return lambda at, size: K.mix((sums[at + size] - sums[at]) * down[at] + np.uint64(size))


def whole_sequences(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, size, hash, beginning of every text that has a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(1)):
                value, text = plain_tokens(s)
                of, hashes = np.arange(s.count), sequence_hashes(value)
                begins, ends = np.searchsorted(text, of), np.searchsorted(text, of, side="right")
                rows = np.flatnonzero(ends > begins)
                at, size = begins[rows], (ends - begins)[rows]
                first = np.array([hashes(at[k : k + 1], min(int(size[k]), BEGINNING))[0] for k in range(len(rows))], np.uint64)
                whole = np.array([hashes(at[k : k + 1], int(size[k]))[0] for k in range(len(rows))], np.uint64)
                ids = batch.column(0).take(pa.array(s.first + rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(size.astype(np.int32)), pa.array(whole.view(np.int64)), pa.array(first.view(np.int64))], names=["item_id", "size", "hash", "beginning"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"item_id {kind}, size int, hash bigint, beginning bigint")


def sequences_of(docs: DataFrame, sizes: list[int], beginnings: bytes, bits: bytes, id_col: str, text_col: str) -> DataFrame:
    """doc_id, size, hash of the token sequences of the given sizes whose bits are set, each once a slice and text."""
    shared = docs.sparkSession.sparkContext.broadcast((sizes, beginnings, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, whole = (np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little").astype(bool) for b in shared.value[1:])
        low = np.uint64(FILTER_BITS - 1)
        for batch in batches:
            for s in K.slices(batch.column(1)):
                value, text = plain_tokens(s)
                hashes, ends = sequence_hashes(value), np.searchsorted(text, np.arange(s.count), side="right")
                left = ends[text] - np.arange(len(text))  # tokens to the end of the text
                long = np.flatnonzero(left >= BEGINNING)
                long = long[first[(hashes(long, BEGINNING) & low).astype(np.int64)]]
                for size in shared.value[0]:
                    at = np.flatnonzero(left >= size) if size < BEGINNING else long[left[long] >= size]
                    h = hashes(at, size)
                    chosen = whole[(h & low).astype(np.int64)]
                    if not chosen.any():
                        continue
                    found = np.unique(np.stack((text[at[chosen]].astype(np.uint64), h[chosen])), axis=1)
                    ids = batch.column(0).take(pa.array(s.first + found[0].astype(np.int64)))
                    sized = pa.array(np.full(found.shape[1], size, np.int32))
                    yield pa.RecordBatch.from_arrays([ids, sized, pa.array(np.ascontiguousarray(found[1]).view(np.int64))], names=["doc_id", "size", "hash"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, size int, hash bigint")


def copies(docs: DataFrame, items: DataFrame, scratch: Scratch, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame | None:
    """doc_id and item_id of every document that has an item's whole token sequence; None if no item has tokens."""
    wanted = scratch.write(whole_sequences(items, item_col, item_text_col).distinct(), "sequences")
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().toLocalIterator())  # as many as there are lengths
    if not sizes:
        return None
    beginnings = filter_bits(wanted.where(F.col("size") >= BEGINNING).select(F.col("beginning").alias("hash")))
    found = sequences_of(docs, sizes, beginnings, filter_bits(wanted), id_col, text_col).where("doc_id IS NOT NULL")
    return found.join(wanted.select("item_id", "size", "hash"), ["size", "hash"]).select("doc_id", "item_id").distinct()


def filter_bits(windows: DataFrame) -> bytes:
    """A bit for the lower bits of every window's hash; the driver gets at most FILTER_BITS bits."""
    bit = F.col("hash").bitwiseAND(FILTER_BITS - 1)
    cell = windows.select(F.shiftright(bit, 5).cast("int").alias("cell"), F.expr(f"shiftleft(1L, cast((hash & {FILTER_BITS - 1}) & 31 AS int))").alias("flag"))
    out = np.zeros(FILTER_BITS // 32, "<u4")
    for row in cell.groupBy("cell").agg(F.bit_or("flag").alias("flags")).toLocalIterator():
        out[row["cell"]] = row["flags"]
    return out.tobytes()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, n_slots, n_changed of every document that holds an item."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "templates")
    items = scratch.write(item_windows(benchmark, item_col, item_text_col).dropDuplicates(["item_id", "item_pos", "hash"]), "items")
    distinct = items.select("item_id", "base").distinct()
    held_by = distinct.groupBy("base").agg(F.count("*").alias("items"))
    ranked = distinct.join(held_by, "base").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("items", "base")))
    total = scratch.write(distinct.groupBy("item_id").agg(F.count("*").alias("n_windows")), "total")
    needed = F.ceil(F.col("n_windows") * percent / 100)
    rare = ranked.join(total, "item_id").where(F.col("rank") <= F.col("n_windows") - needed + 1).select("item_id", "base")
    finders = items.join(rare, ["item_id", "base"]).select("item_id", "hash").distinct()

    hits = windows_of(docs, id_col, text_col, filter_bits(items)).withColumnRenamed("id", "doc_id")
    hits = scratch.write(hits.where("doc_id IS NOT NULL").join(items.select("hash").distinct(), "hash", "left_semi"), "hits")
    candidates = hits.select("doc_id", "hash").distinct().join(finders, "hash").select("doc_id", "item_id").distinct()
    same = ~F.exists(F.arrays_zip("item_fixed", "item_slots", "slots"), lambda v: v["item_fixed"] & (v["item_slots"] != v["slots"]))
    both = hits.join(candidates.join(items, "item_id"), ["doc_id", "hash"]).where(same)
    per_window = both.select("doc_id", "item_id", "base").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_matched"))
    enough = scratch.write(per_window.join(total, "item_id").where(F.col("n_matched") >= needed), "enough")

    # the alignment of a pair with most windows, and what its slots hold
    placed = both.join(enough.select("doc_id", "item_id"), ["doc_id", "item_id"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    per_shift = placed.groupBy("doc_id", "item_id", "shift").agg(F.count("*").alias("k"))
    best = per_shift.groupBy("doc_id", "item_id").agg(F.min_by("shift", F.struct(-F.col("k"), F.col("shift"))).alias("shift"))
    values = placed.join(best, ["doc_id", "item_id", "shift"]).select("doc_id", "item_id", F.explode(F.arrays_zip("item_slots", "slots", "item_fixed")).alias("v")).where("NOT v.item_fixed").select("doc_id", "item_id", "v.item_slots", "v.slots").distinct()
    stands = values.groupBy("doc_id", "item_id", "item_slots").agg(F.count("*").alias("k"), F.max((F.col("item_slots") != F.col("slots")).cast("int")).alias("changed"))
    slots = stands.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_slots"), F.sum("changed").alias("n_changed"), F.max("k").alias("most"))
    judged = enough.join(slots, ["doc_id", "item_id"], "left").where("coalesce(most, 1) = 1")
    by_windows = judged.select("doc_id", "item_id", "n_windows", "n_matched", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("n_changed", F.lit(0)).alias("n_changed"))

    # whole copies in any case of letters: of items too short for windows to be missing, and of longer ones whose names are written otherwise
    copied = copies(docs, benchmark.where(F.col(item_col).isNotNull()), scratch, id_col, text_col, item_col, item_text_col)
    if copied is None:
        return by_windows
    by_windows = scratch.write(by_windows, "by_windows")
    held = items.select("item_id", F.explode(F.arrays_zip("item_slots", "item_fixed")).alias("v")).where("NOT v.item_fixed").groupBy("item_id").agg(F.countDistinct("v.item_slots").alias("n_slots"))
    rest = copied.join(by_windows.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti").join(total, "item_id", "left").join(held, "item_id", "left")
    none = F.lit(0).cast("bigint")
    counted = F.coalesce("n_windows", none)
    return by_windows.unionByName(rest.select("doc_id", "item_id", counted.alias("n_windows"), counted.alias("n_matched"), F.coalesce("n_slots", none).alias("n_slots"), none.alias("n_changed")))


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no item."""
    found = Scratch(docs.sparkSession, "cleaned").write(contaminated(docs, benchmark).select("doc_id").distinct(), "found")
    return by_ids(docs, found, "left_anti").select(*docs.columns)


@query("op5_template_decontamination")
def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(given(spark, sf_dir, "documents"), given(spark, sf_dir, "benchmark"))
