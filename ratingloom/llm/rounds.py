"""Best-k searches of bounded query blocks over a stored table of packed rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.llm.scratch import Scratch

#: Share of the packed rows that the first round reads (one in so many), and the rows from which two rounds pay.
FIRST, TWO_ROUNDS = 16, 64


def blocks_of(rows: DataFrame, size: str, most: int) -> DataFrame:
    """The rows with a column `block`: rows of one block have sizes that add up to `most` at most, or it is one row.

    Rows are packed within their partition, so blocks need no order and no count
    of all rows.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["block string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, filled = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            names = []
            for n in batch.column(batch.schema.get_field_index(size)).to_pylist():
                if filled and filled + n > most:
                    block, filled = block + 1, 0
                filled += n
                names.append(f"{part}-{block}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], names=[*batch.schema.names, "block"])

    return rows.mapInArrow(run, schema)


def ranked(found: DataFrame, key: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, with their rank."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def search(
    packed: DataFrame, count: int, part_of: str, run: Callable[[DataFrame, dict[Any, int]], DataFrame], best: Callable[[DataFrame], DataFrame],
    floors: Callable[[DataFrame], dict[Any, int]], scratch: Scratch, name: str,
) -> DataFrame:
    """The best rows over all packed rows, found in two rounds where there are many.

    A small part of the packed rows (by a hash of the column `part_of`) gives each
    query a floor, the score of its k-th row there, below which no row of the rest can be
    wanted. So tasks of the second round pass on few rows however many tasks there
    are. The result does not depend on the part.
    """
    if count < TWO_ROUNDS:
        return best(run(packed, {}))
    early = F.pmod(F.xxhash64(part_of), F.lit(FIRST)) == 0
    first = scratch.write(best(run(packed.where(early), {})), name)
    rest = run(packed.where(~early), floors(first))
    return best(first.select(*rest.columns).union(rest))


def together(parts: Iterator[DataFrame], scratch: Scratch, name: str) -> DataFrame | None:
    """All rows of the parts; the parts of several blocks are stored one after the other, so that no plan holds them all."""
    first = next(parts, None)
    second = next(parts, None)
    if second is None:
        return first
    paths = []
    for k, part in enumerate(chain([first, second], parts)):
        scratch.write(part, f"{name}-{k}")
        paths.append(scratch.path(f"{name}-{k}"))
    return first.sparkSession.read.schema(first.schema).parquet(*paths)


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
