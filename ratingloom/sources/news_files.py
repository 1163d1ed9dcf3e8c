"""News documents: one JSON file per ticker and year, the key in the file name."""

from __future__ import annotations

import bz2
import gzip
import os
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby, islice
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom import schemas
from ratingloom.functions.text import article_text, news_file_key

_CORRUPT = "_corrupt"
#: Tasks per core that write or read a folder of files, and the subfolders that hold them.
FILE_TASKS, SUBFOLDERS = 4, 64
#: Files and bytes of texts that a task that lists or reads a folder holds at a time, and files whose list the driver may hold.
HELD_FILES, HELD_BYTES, DRIVER_FILES = 4_096, 8 << 20, 10_000

#: The file's name in its path; files that Spark wrote partitioned by name lie in a folder of that name.
_NAME_IN_PATH = r"([^/=]+?)(?:/part-[^/]*)?$"


def read_news_files(spark: SparkSession, path: str, glob: str = "*_news.json") -> DataFrame:
    """(file_name, value) of every news file; the file is the unit of parsing."""
    reader = spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return reader.text(path).select(F.col("_metadata.file_name").alias("file_name"), "value")


def read_news_folder(spark: SparkSession, path: str, tickers: Sequence[str] | None = None, years: Sequence[int] | None = None) -> DataFrame:
    """(file_name, value) of the news files of a folder, by any of their keys.

    The key stands in a file's name, so the wanted tickers and years are a condition on the
    path: files of other keys are not opened. Files whose name has no key are kept, for the table of
    rejects. Spark's file source applies the condition when it plans the scan, wherever Spark can read; its list
    of all files is in the driver, so a mounted folder of many files is listed and read by the tasks instead.
    """
    root = _large_folder(spark, path)
    if root is None:
        reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
        found, at = reader.text(path), F.col("_metadata.file_path")
    else:
        found, at = _listed(spark, root), F.col("uri")
    name = F.regexp_extract(at, _NAME_IN_PATH, 1)
    ticker, year = news_file_key(name)
    files = found.where(F.lower(name).endswith("_news.json"))
    if tickers is not None:
        files = files.where(ticker.isNull() | ticker.isin(list(tickers)))
    if years is not None:
        files = files.where(year.isNull() | year.isin([int(y) for y in years]))
    if root is None:
        return files.select(name.alias("file_name"), "value")
    dealt = files.select(name.alias("file_name"), "path").repartition(FILE_TASKS * spark.sparkContext.defaultParallelism, "path")
    return dealt.mapInArrow(_read, "file_name string, value string")


def folder_index(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, ticker, fiscal_year, bytes) of the news files of a folder, from the listing alone."""
    root = _large_folder(spark, path)
    if root is None:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        listed = listed.select(F.col("_metadata.file_path").alias("uri"), F.col("length").alias("bytes"))
    else:
        listed = _listed(spark, root)
    ticker, year = news_file_key(F.col("file_name"))
    files = listed.select(F.regexp_extract("uri", _NAME_IN_PATH, 1).alias("file_name"), "bytes").where(F.lower("file_name").endswith("_news.json"))
    return files.select("file_name", ticker.alias("ticker"), year.alias("fiscal_year"), "bytes")


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The path in the file system that is mounted; none for a store that only Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


def _large_folder(spark: SparkSession, path: str) -> str | None:
    """The path of a mounted folder with more files than the driver may list; none for others."""
    root = _mounted(spark, path)
    if root is None or not os.path.isdir(root):
        return None
    some = islice(_walked([root]), DRIVER_FILES + 1)
    return root if sum(1 for _ in some) > DRIVER_FILES else None


def _entries(folder: str) -> Iterator[os.DirEntry]:
    """What Spark's readers see of a folder: no name that begins or ends like a file in the making."""
    with os.scandir(folder) as found:
        for entry in found:
            name = entry.name
            hidden = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
            if not hidden or (entry.is_dir() and name.startswith(("_metadata", "_common_metadata"))):
                yield entry


def _row(entry: os.DirEntry) -> tuple[str, int, bool]:
    """(path, bytes, whether it is a folder)"""
    return (entry.path, 0, True) if entry.is_dir() else (entry.path, entry.stat().st_size, False)


def _walked(folders: list[str]) -> Iterator[tuple[str, int, bool]]:
    """All files below some folders."""
    todo = list(folders)
    while todo:
        for found in map(_row, _entries(todo.pop())):
            if found[2]:
                todo.append(found[0])
            else:
                yield found


#: Characters that a path's URI has as their bytes: all but the legal ones of ASCII, and spaces and control characters beyond it.
_QUOTED = re.compile(r"[^\w\-!.~'()*:@&=+$,;/\u0080-\U0010ffff]|[\u0080-\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", re.ASCII)


def _uri(path: str) -> str:
    return _QUOTED.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), path)


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, uri, bytes) of all files below a mounted folder that are not empty; `uri` is the path as Spark's readers show it.

    One task lists the folder itself; what is below its subfolders is listed by all tasks.
    """
    schema = "path string, uri string, bytes bigint, folder boolean"

    def in_batches(rows: Iterator[tuple[str, int, bool]]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, bool]] = []
        for row in rows:
            held.append(row)
            if len(held) == HELD_FILES:
                yield _batch(held)
                held = []
        yield _batch(held)

    def _batch(rows: list[tuple[str, int, bool]]) -> pa.RecordBatch:
        paths, sizes, folders = zip(*rows, strict=True) if rows else ((), (), ())
        columns = [pa.array(paths, pa.string()), pa.array(map(_uri, paths), pa.string()), pa.array(sizes, pa.int64()), pa.array(folders, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["path", "uri", "bytes", "folder"])

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from in_batches(map(_row, _entries(root)))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.to_pylist()
            yield from in_batches((r["path"], r["bytes"], False) for r in given if not r["folder"])
            yield from in_batches(_walked([r["path"] for r in given if r["folder"]]))

    first = spark.range(0, 1, 1, 1).mapInArrow(top, schema)
    return first.repartition(FILE_TASKS * spark.sparkContext.defaultParallelism, "path").mapInArrow(below, schema).where("bytes > 0").select("path", "uri", "bytes")


#: How files are unpacked that a writer of compressed text made, by the end of their names.
_UNPACKED: dict[str, Callable[[bytes], bytes]] = {".gz": gzip.decompress, ".bz2": bz2.decompress, ".deflate": zlib.decompress}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names and lines of the files at some paths, as Spark's reader splits them."""
    for batch in batches:
        names, values, size = [], [], 0
        for name, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with open(path, "rb") as file:
                content = file.read()
            lines = _UNPACKED.get(os.path.splitext(path)[1], bytes)(content).removeprefix(b"\xef\xbb\xbf").splitlines()
            names += [name] * len(lines)
            values += lines
            size += len(content)
            if size > HELD_BYTES:
                yield _texts(names, values)
                names, values, size = [], [], 0
        yield _texts(names, values)


def _texts(names: list[str], values: list[bytes]) -> pa.RecordBatch:
    # the bytes as they are, also where they are no valid text
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.binary()).view(pa.string())], names=["file_name", "value"])


def write_news_folder(files: DataFrame, path: str) -> None:
    """Writes (file_name, value) rows, one file each, below the folder. Names must differ.

    Making a file takes longer than filling it, so the names are dealt to all tasks, however few
    bytes the rows have. In a file system that is mounted, tasks make the files themselves, in some
    subfolders that Spark lists side by side; elsewhere Spark's writer gives each file a folder of its name.
    """
    spark = files.sparkSession
    parts = FILE_TASKS * spark.sparkContext.defaultParallelism
    dealt = files.select("file_name", "value").repartition(parts, "file_name")
    root = _mounted(spark, path)
    if root is None:
        # each task puts its own files in place; else the driver moves all of them, one by one
        dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("file_name").text(path)
        return
    for number in range(SUBFOLDERS):
        os.makedirs(os.path.join(root, f"{number:02x}"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((name, value or "") for batch in batches for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        made = 0
        for name, same in groupby(rows, key=lambda row: row[0]):
            safe = name.replace("/", "%2F")
            folder = os.path.join(root, f"{zlib.crc32(safe.encode()) % SUBFOLDERS:02x}")
            # under a name of its own first, so a task that is run again or twice leaves no half file
            unfinished = os.path.join(folder, f".{uuid4().hex}")
            with open(unfinished, "w", encoding="utf-8", newline="") as file:
                file.writelines(value + "\n" for _, value in same)
            os.replace(unfinished, os.path.join(folder, safe))
            made += 1
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], names=["files"])

    named = dealt.where(F.col("file_name").isNotNull()).sortWithinPartitions("file_name")
    named.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def parse_news(files: DataFrame) -> DataFrame:
    """Adds the key from the name, the document, and why a file is rejected."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.NEWS_DOCUMENT.fields)
    ticker, year = news_file_key(F.col("file_name"))
    # an object whose keys can be listed to the end is complete JSON
    complete = F.json_object_keys("value").isNotNull()
    document = F.from_json("value", f"{fields}, {_CORRUPT} string", {"columnNameOfCorruptRecord": _CORRUPT})
    parsed = files.select("file_name", ticker.alias("ticker"), year.alias("fiscal_year"), document.alias("d"), complete.alias("_ok"))
    reason = F.when(F.col("ticker").isNull(), "file name").when(~F.col("_ok") | F.col(f"d.{_CORRUPT}").isNotNull(), "json")
    articles = F.coalesce(F.col("d.articles"), F.array().cast(schemas.NEWS_DOCUMENT["articles"].dataType))
    return parsed.select("file_name", "ticker", "fiscal_year", articles.alias("articles"), reason.alias("reject_reason"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull()).select("file_name", "reject_reason")


def file_index(parsed: DataFrame) -> DataFrame:
    """(ticker, fiscal_year, article_count) of each accepted file."""
    return accepted(parsed).select("ticker", "fiscal_year", F.size("articles").alias("article_count"))


def article_rows(parsed: DataFrame) -> DataFrame:
    """One row per article; an empty file keeps one row without text, so its key still counts."""
    rows = accepted(parsed).select("ticker", "fiscal_year", F.explode_outer("articles").alias("a"))
    text = F.when(F.col("a").isNotNull(), article_text(F.col("a.title"), F.col("a.description"), F.col("a.snippet")))
    return rows.select("ticker", "fiscal_year", text.alias("text"), F.col("a.url").alias("url"), F.col("a.published_at").alias("published_at"))
