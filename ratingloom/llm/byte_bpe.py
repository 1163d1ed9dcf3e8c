"""Byte-level BPE: encoding and decoding with the tiktoken library and a local rank file.

The rank file is read once by the driver and sent to the workers (its size is
that of a vocabulary, not of the data). Long texts are cut beforehand at places
where no match of the pattern can run across: a single space between two
letters or digits. The ids of the pieces, put together, are those of the whole.

Defined results: NULL is an empty text, an empty text has no ids; columns
beside the id and the text are not read; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm.registry import given, query

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Characters above which a text is cut.
LONG_TEXT = 1 << 16
_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")

_ENCODERS: dict[bytes, tiktoken.Encoding] = {}


def encoder(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file's content; one per worker process."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _ENCODERS:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _ENCODERS[key]


def pieces(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """The text in pieces of at least `size` characters, cut only at safe places."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(encoding: tiktoken.Encoding, text: str | None, size: int = LONG_TEXT) -> list[int]:
    if not text:
        return []
    if len(text) <= size:
        return encoding.encode_ordinary(text)
    return [i for piece in pieces(text, size) for i in encoding.encode_ordinary(piece)]


def _ranks(spark: SparkSession, rank_file: str) -> Broadcast:
    with open(rank_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str = RANK_FILE, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids, n_tokens of every row."""
    ranks = _ranks(docs.sparkSession, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                ids = [np.array(encode_text(encoding, t), np.int32) for t in part.column(1).to_pylist()]
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), values, pa.array(np.diff(bounds).astype(np.int64))], names=["doc_id", "ids", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens bigint")


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", rank_file: str = RANK_FILE, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and the bytes of every row's ids; NULL ids are an empty text."""
    ranks = _ranks(tokens.sparkSession, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = [encoding.decode_bytes(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str = RANK_FILE, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode and decode every row in one pass and keep digests of both."""
    ranks = _ranks(docs.sparkSession, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks.value, pattern)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = encode_text(encoding, text.as_py())
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(encoding.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(given(spark, sf_dir, "documents"))
