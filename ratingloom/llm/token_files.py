"""Token ids of a corpus as Parquet files that can be read selectively.

The documents are put in ascending order of their id, encoded, and written with
Spark's Parquet writer: one row per document, its ids as a list column in
dictionary encoding, the numbers beside it in delta encoding, with bounded row
groups and pages and the page indexes the writer adds. A reader that wants
counts reads no ids; one that wants a range of documents reads the pages of
that range.

The place of a document in the stream of all ids is the number of ids before it
in its file plus the sum of the files before; only one number per file meets in
one task.

Defined results: NULL is an empty text; every document ends with `end_id`, so an
empty one has that id alone; rows with the same id are ordered by their text and
kept each; columns beside the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ratingloom.llm.registry import given, query
from ratingloom.llm.scratch import Scratch

TOKENIZER_FILE = public_tokenizers.path("word_bpe_49k.json")
#: How the files are laid out.
FILE_OPTIONS = {
    "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20), "parquet.writer.version": "v2", "compression": "zstd",
}
#: Runs and pieces an encoder remembers, and the longest of them.
REMEMBERED, REMEMBERED_LENGTH = 800_000, 48
_RUNS = re.compile(r"[^ \t\n\r]+")
#: Python takes these for white space, the tokenizer doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Texts that are lower-cased letter by letter and need no normalising: ASCII and Latin letters (but not U+0130).
_PLAIN = re.compile("[\x09-\x0d\x20-\x7e\u00c0-\u012f\u0131-\u017f]*")
#: On these, what the tokenizer's own pattern matches.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def _byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else the next from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + rest.index(b)) for b in range(256)]


class WordEncoder:
    """Ids of a text, put together from the ids of its runs without white space.

    The tokenizer drops white space, and neither its normaliser nor its pattern
    looks across it. A run that holds an added token (such as the end of text) goes through
    the whole tokenizer, which gives that token's id; so does every text where added tokens
    are found in another way than letter by letter. Runs of a text of ASCII and Latin letters are lower-cased and
    cut by the tokenizer's pattern here, and only new pieces go through its
    merges; the other runs go through the whole tokenizer. What is remembered is
    emptied when it is full and never changes a result.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.whole = any(t.normalized or t.single_word or t.lstrip or t.rstrip or not t.content or re.search(r"\s", t.content) for t in added)
        self.added = re.compile("|".join(re.escape(t.content) for t in added) or "(?!)")
        self.merges = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}

    def _remember(self, run: str, ids: bytes) -> bytes:
        if len(run) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[run] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        found = [t.id for t in self.merges.tokenize(shown)]
        return self._remember(piece, struct.pack(f"<{len(found)}I", *found))

    def _run(self, run: str) -> bytes:
        """The ids of a lower-cased plain run that is not known."""
        if run.isalpha():
            return self._piece(run)
        get = self.known.get
        return self._remember(run, b"".join([get(p) or self._piece(p) for p in _PIECES.findall(run)]))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        get, run = self.known.get, self._run
        if self.whole:
            return self._packed(text)
        special = self.added.search(text)
        if not special and _PLAIN.fullmatch(text):
            return b"".join([get(r) or run(r) for r in text.lower().split()])
        out = []
        for r in _RUNS.findall(text) if _SEPARATORS.search(text) else text.split():
            if _PLAIN.fullmatch(r) and not (special and self.added.search(r)):
                out.append(get(r.lower()) or run(r.lower()))
            else:
                out.append(self._packed(r))
        return b"".join(out)

    def _packed(self, text: str) -> bytes:
        found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(definition: str) -> WordEncoder:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(definition)
    return _ENCODERS[key]


def write_tokens(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str = TOKENIZER_FILE) -> None:
    """Encode every row and write the files below `path`."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before = encoder(definition.value), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [words.encode(t.as_py() or "") + end for t in part.column(1)]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                values = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(before + bounds[:-1]), pa.array(sizes), values], names=["doc_id", "before", "n_tokens", "ids"]
                )
                before += int(bounds[-1])

    kind = docs.schema[id_col].dataType.simpleString()
    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(run, f"doc_id {kind}, before bigint, n_tokens bigint, ids array<int>")
    encoded.withColumn("part", F.spark_partition_id()).write.options(**FILE_OPTIONS).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens of every document; the ids are not read."""
    rows = spark.read.parquet(path).select("part", "doc_id", "before", "n_tokens")
    return _placed(rows).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id and ids of the documents from `first` to `last`; other row groups and pages are skipped."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.select("doc_id", "ids")


def _placed(rows: DataFrame) -> DataFrame:
    """With `start`: the ids before the file plus those before the document in it."""
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))  # one row per file
    earlier = sums.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return rows.join(earlier, "part").withColumn("start", F.col("before") + F.col("offset"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_id, before, n_tokens and the CRC-32 of the ids of every document, from the files."""
    rows = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            bounds = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1] if len(lists) else np.zeros(1, np.int32)
            values = np.asarray(lists.values).astype("<u4", copy=False)
            sums = [zlib.crc32(values[bounds[k] : bounds[k + 1]].tobytes()) for k in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], names=["part", "doc_id", "before", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("part", "doc_id", "before", "n_tokens", "ids").mapInArrow(run, f"part int, doc_id {kind}, before bigint, n_tokens bigint, ids_crc32 bigint")


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op8").path("tokens")
    write_tokens(given(spark, sf_dir, "documents"), path)
    return _placed(digests(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
