"""Boosted trees for any number of classes, grown from histograms of gradients.

Features are binned at quantiles. All models of a call (cross-validation folds, feature
blocks) and all their classes grow together: a level of all their trees is one pass over
the binned table, which sums gradients and curvatures per (model, class, node, feature, bin),
in each task first and then in one aggregate. The driver gets these sums, whose
number depends on the models and not on the rows, and chooses the splits. Only the
smaller index of two siblings is summed; the other is the parent less it. So a model of
r rounds and depth d takes r * d jobs, whatever the number of folds and classes.

Gradients are summed as whole numbers (multiples of 2**-30), so the trees do not depend on
how the rows are partitioned. Margins are stored every few rounds in the shared folder;
between, each pass adds the few trees grown since. No pass depends on state in an executor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.operators.metrics import PREDICTED
from ratingloom.session import remove_path, scratch_path

LABEL = "label"
#: Bins per feature, rounds after which margins are stored, unit of the summed gradients.
BINS, STORED_ROUNDS, UNIT = 64, 5, 2.0**30
#: Rows times models of a part of the binned table while there are parts for fewer tasks than cores (starting a task takes as long as
#: their sums), and rows of a part when there are more.
SMALL_PART, LARGE_PART = 75_000, 200_000
#: Combinations of bins that are summed together, in tasks of few and of many rows.
SMALL_BUNDLE, LARGE_BUNDLE = 256, 4_096
#: Bytes of a block of rows in the stored table, of the blocks that are summed together, and of a part's margins up to which its copy
#: is kept in the memory of executors.
BLOCK_BYTES, SUMMED_BYTES, KEPT_BYTES = 1 << 20, 1 << 23, 32 << 20
#: A block is a page and some blocks a row group. By default Parquet looks at the size after a hundred rows, here the blocks of a
#: whole part, which a task then holds several times over, outside what Spark counts.
BLOCKS_STORED = {"parquet.block.size": str(16 * BLOCK_BYTES), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


def with_best(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Adds confidence (the largest probability) and predicted_category (first on ties)."""
    best = F.array_max("probabilities")
    place = F.array_position("probabilities", best) - 1
    return df.withColumns({"confidence": best, PREDICTED: F.get(F.array(*[F.lit(c) for c in classes]), place.cast("int"))})


# --- rules of growing -----------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """How splits are valued and leaves filled. Sums are of gradient (p - y), curvature, rows."""

    second_order: bool
    penalty: float = 1.0  # of squared leaf values
    least_curvature: float = 1.0  # in a child
    least_gain: float = 1e-6

    def curvature(self, p: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.maximum(2 * p * (1 - p), 1e-16) if self.second_order else np.abs(g) * (1 - np.abs(g))

    def gain(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of splits into sums `left` and `right` (..., 3); -inf where a side is too small."""
        (gl, hl, nl), (gr, hr, nr) = np.moveaxis(left, -1, 0), np.moveaxis(right, -1, 0)
        if self.second_order:
            gl, hl, gr, hr = gl / UNIT, hl / UNIT, gr / UNIT, hr / UNIT
            out = gl * gl / (hl + self.penalty) + gr * gr / (hr + self.penalty) - (gl + gr) * (gl + gr) / (hl + hr + self.penalty)
            return np.where((hl >= self.least_curvature) & (hr >= self.least_curvature), out, -np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            between = gl / UNIT / nl - gr / UNIT / nr
            return np.where((nl >= 1) & (nr >= 1), nl * nr / (nl + nr) * between * between, -np.inf)

    def value(self, sums: np.ndarray, classes: int) -> np.ndarray:
        g, h, _ = np.moveaxis(sums / UNIT, -1, 0)
        if self.second_order:
            return -g / (h + self.penalty)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(h > 0, -g / h, 0.0) * ((classes - 1) / classes)

    def start(self, counts: np.ndarray) -> np.ndarray:
        """Margins before the first round, from the class counts."""
        if self.second_order:
            return np.zeros(len(counts))
        share = counts / max(counts.sum(), 1)
        tiny = float(np.finfo(np.float32).eps)
        return np.log(np.clip(share, tiny, 1 - tiny))


SECOND_ORDER = Rule(True)
RESIDUALS = Rule(False, least_gain=1e-12)


# --- trees ----------------------------------------------------------------------------------


@dataclass
class Trees:
    """Trees of some rounds for every class of one model, as heaps: node i has children 2i+1 and 2i+2.

    A node that is a leaf sends all rows to the left, so that values stand at the last
    level; `value`, `cover` (curvature or rows of training) and `gain` are of every node.
    """

    feature: np.ndarray  # (rounds, classes, inner nodes), -1 for a leaf
    cut: np.ndarray  # bins up to this one go left
    gain: np.ndarray
    value: np.ndarray  # (rounds, classes, nodes)
    cover: np.ndarray

    @staticmethod
    def none(rounds: int, classes: int, depth: int) -> "Trees":
        inner, nodes = 2**depth - 1, 2 ** (depth + 1) - 1
        shape = (rounds, classes)
        return Trees(
            np.full((*shape, inner), -1, np.int32), np.full((*shape, inner), BINS, np.int32), np.zeros((*shape, inner)), np.zeros((*shape, nodes)), np.zeros((*shape, nodes))
        )

    def part(self, first: int, end: int) -> "Trees":
        return Trees(*(getattr(self, k)[first:end] for k in ("feature", "cut", "gain", "value", "cover")))

    @property
    def depth(self) -> int:
        return (self.feature.shape[2] + 1).bit_length() - 1

    def places(self, columns: np.ndarray, r: int, k: int, levels: int) -> list[np.ndarray]:
        """Per level whether each row goes right in the tree of round r and class k; `columns` has a row per feature."""
        feature, cut, sides = np.maximum(self.feature[r, k], 0), self.cut[r, k], []
        for level in range(levels):
            nodes = range(2**level - 1, 2 ** (level + 1) - 1)
            right = [columns[feature[n]] > int(cut[n]) for n in nodes]
            for side in reversed(sides):  # of two siblings the one a row is in
                right = [a ^ (side & (a ^ b)) for a, b in zip(right[::2], right[1::2], strict=True)]
            sides.append(right[0])
        return sides

    def margins_by_class(self, columns: np.ndarray) -> np.ndarray:
        """(classes, rows): the sum of the trees' values."""
        rounds, classes = self.feature.shape[:2]
        total = np.zeros((classes, columns.shape[1]))
        for r in range(rounds):
            for k in range(classes):
                total[k] += self.value[r, k, 2**self.depth - 1 :][numbered(self.places(columns, r, k, self.depth), columns.shape[1])]
        return total

    def margins(self, bins: np.ndarray) -> np.ndarray:
        """(rows, classes): the sum of the trees' values."""
        return np.ascontiguousarray(self.margins_by_class(np.ascontiguousarray(bins.T)).T)


def numbered(sides: Sequence[np.ndarray], rows: int) -> np.ndarray:
    """The place in its level that each row's turns lead to."""
    at = np.zeros(rows, np.intp)
    for side in sides:
        at += at
        at += side
    return at


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Fit:
    """One model to grow: the features it sees and the fold it does not."""

    features: tuple[int, ...]
    held_out: int | None = None


def bundles(features: Sequence[int], widths: Sequence[int], most: int) -> list[list[int]]:
    """Places of features in groups of at most `most` combinations of bins (or alone), so that one sum over combinations serves a group."""
    out: list[tuple[int, list[int]]] = []
    for place in sorted(range(len(features)), key=lambda i: (-widths[features[i]], i)):
        width = widths[features[place]]
        at = next((i for i, (cells, _) in enumerate(out) if cells * width <= most), None)
        if at is None:
            out.append((width, [place]))
        else:
            out[at] = (out[at][0] * width, [*out[at][1], place])
    return [own for _, own in out]


class GradientSums:
    """Sums of one level of all trees over the rows of a task, batch by batch.

    `grown` has the trees since the margins were stored, the last of them in growth. Cells count up over fits, classes,
    left siblings, features, bins. Rows are added into combinations of the bins of several features, which
    `cells` adds up per feature at the end; whole numbers, so the order does not matter.
    """

    def __init__(self, fits: Sequence[Fit], grown: Sequence[Trees], level: int, rule: Rule, widths: Sequence[int], most: int):
        self.fits, self.grown, self.level, self.rule, self.widths = fits, grown, level, rule, widths
        self.half = max(1, 2 ** (level - 1))
        self.groups = {fit.features: bundles(fit.features, widths, most) for fit in fits}
        self.sums: list[dict] = [{} for _ in fits]

    def _sizes(self, features: Sequence[int], group: Sequence[int]) -> list[int]:
        return [self.widths[features[i]] for i in group]

    def add(self, bins: np.ndarray, labels: np.ndarray, folds: np.ndarray, margins: np.ndarray) -> None:
        """`bins` (features, rows), `margins` (fits, classes, rows) as they are stored."""
        for fold in dict.fromkeys(fit.held_out for fit in self.fits):
            rows = np.flatnonzero(folds != fold) if fold is not None else None
            own, truth = (bins, labels) if rows is None else (bins.take(rows, axis=1), labels[rows])
            codes: dict = {}
            for j, fit in enumerate(self.fits):
                if fit.held_out == fold:
                    if fit.features not in codes:
                        codes[fit.features] = [self._codes(own, fit.features, g) for g in self.groups[fit.features]]
                    self._add_fit(j, own, truth, margins[j] if rows is None else margins[j].take(rows, axis=1), codes[fit.features])

    def _codes(self, columns: np.ndarray, features: Sequence[int], group: Sequence[int]) -> np.ndarray:
        code = np.zeros(columns.shape[1], np.intp)
        for i, width in zip(group, self._sizes(features, group), strict=True):
            code *= width
            code += columns[features[i]]
        return code

    def _add_fit(self, j: int, columns: np.ndarray, labels: np.ndarray, margins: np.ndarray, codes: Sequence[np.ndarray]) -> None:
        mine, rows = self.grown[j], columns.shape[1]
        last, classes = len(mine.feature) - 1, mine.feature.shape[1]
        m = margins
        if last:
            m = m + mine.part(0, last).margins_by_class(columns)
        p = np.exp(m - m.max(axis=0))
        p /= p.sum(axis=0)
        g = p.copy()
        g[labels, np.arange(rows)] -= 1
        h = self.rule.curvature(p, g)
        weights = [np.rint(w * UNIT) for w in (g, h)]
        for k in range(classes):
            sides, chosen, at = mine.places(columns, last, k, self.level), None, 0
            if self.level:
                parent = numbered(sides[:-1], rows)
                split = mine.feature[last, k, 2 ** (self.level - 1) - 1 : 2**self.level - 1] >= 0
                left = ~sides[-1]
                chosen = np.flatnonzero(left if split.all() else left & split[parent])
                at = parent[chosen]
            own = [w[k] if chosen is None else w[k][chosen] for w in weights]
            for place, (group, code) in enumerate(zip(self.groups[self.fits[j].features], codes, strict=True)):
                width = int(np.prod(self._sizes(self.fits[j].features, group)))
                key = code if chosen is None else at * width + code[chosen]
                found = [np.bincount(key, w, self.half * width) for w in own]
                found += [] if self.rule.second_order else [np.bincount(key, minlength=self.half * width)]
                if (k, place) not in self.sums[j]:
                    self.sums[j][k, place] = np.zeros((len(found), self.half * width), np.int64)
                for total, some in zip(self.sums[j][k, place], found, strict=True):
                    np.add(total, some, out=total, casting="unsafe")

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """(cells, sums of gradients, of curvatures, of rows); rows are not counted for a rule of second order."""
        cells, sums, offset = [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)], 0
        for j, fit in enumerate(self.fits):
            classes, n = self.grown[j].feature.shape[1], len(fit.features)
            whole = np.zeros((classes, self.half, n, BINS, 3), np.int64)
            for (k, place), totals in self.sums[j].items():
                group = self.groups[fit.features][place]
                sizes = self._sizes(fit.features, group)
                shaped = totals.reshape(len(totals), self.half, *sizes)
                for axis, i in enumerate(group):
                    others = tuple(2 + x for x in range(len(group)) if x != axis)
                    whole[k, :, i, : sizes[axis], : len(totals)] = np.moveaxis(shaped.sum(axis=others), 0, -1)
            flat = whole.reshape(-1, 3)
            some = np.flatnonzero(flat.any(axis=1))
            cells.append(offset + some)
            sums.append(flat[some])
            offset += len(flat)
        return np.concatenate(cells), np.concatenate(sums)


def choose_splits(trees: Trees, r: int, level: int, sums: np.ndarray, fit: Fit, cuts: Sequence[np.ndarray], rule: Rule, rate: float) -> None:
    """Splits the nodes of a level of round r, given their sums (classes, nodes, features, bins, 3).

    The first feature, then the lowest cut wins ties.
    """
    classes, nodes, features = sums.shape[:3]
    left = sums.cumsum(axis=3)
    whole = left[:, :, 0, -1]
    gain = rule.gain(left, left[:, :, :, -1:] - left)
    allowed = np.arange(BINS)[None, :] < np.array([len(cuts[f]) for f in fit.features])[:, None]
    gain = np.where(allowed, gain, -np.inf)
    best = gain.reshape(classes, nodes, -1).argmax(axis=2)
    first = 2**level - 1
    if level == 0:
        trees.value[r, :, 0] = rate * rule.value(whole[:, 0], classes)
        trees.cover[r, :, 0] = whole[:, 0, 1] / UNIT if rule.second_order else whole[:, 0, 2]
    for k in range(classes):
        for n in range(nodes):
            node, (f, b) = first + n, divmod(int(best[k, n]), BINS)
            splits = gain[k, n, f, b] > rule.least_gain
            if splits:
                trees.feature[r, k, node], trees.cut[r, k, node], trees.gain[r, k, node] = fit.features[f], b, gain[k, n, f, b]
            for child, part in ((2 * node + 1, left[k, n, f, b]), (2 * node + 2, whole[k, n] - left[k, n, f, b])):
                trees.value[r, k, child] = rate * rule.value(part, classes) if splits else trees.value[r, k, node]
                trees.cover[r, k, child] = (part[1] / UNIT if rule.second_order else part[2]) if splits else 0.0


# --- growing --------------------------------------------------------------------------------


def cut_points(table: DataFrame, n_features: int, features: str = "features") -> list[np.ndarray]:
    """Ascending distinct quantiles of each feature; a value up to a cut lies left of it.

    The quantiles are Spark's, with an error of a ten-thousandth of the rows at most, and
    exact on tables of some ten thousand rows.
    """
    x = vector_to_array(features)
    points = [k / BINS for k in range(1, BINS)]
    columns = table.select(*[F.get(x, F.lit(i)).alias(f"x{i}") for i in range(n_features)])
    row = columns.agg(*[F.percentile_approx(f"x{i}", points, 10_000).alias(f"q{i}") for i in range(n_features)]).first()
    return [np.unique(np.array(q or [], float)) for q in row]


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """(rows, features) bin numbers: how many cuts lie below each value."""
    return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8) if len(cuts) else np.zeros((len(x), 0), np.uint8)


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def table_parts(rows: int, fits: int, cores: int) -> int:
    """Parts of the binned table; a level of all trees starts a task for each."""
    return max(1, min(cores, -(-rows * fits // SMALL_PART)), -(-rows // LARGE_PART))


def grow(
    table: DataFrame, fits: Sequence[Fit], n_features: int, classes: int, rule: Rule, rounds: int, depth: int = V.BOOSTING["depth"], rate: float = V.BOOSTING["learning_rate"]
) -> tuple[list[np.ndarray], list[np.ndarray], list[Trees]]:
    """(cut points, margins at the start, trees) of every fit.

    `table` has `features` (a vector), `label` (a class number) and, if a fit holds one
    out, `fold`. All fits share the cut points, which no label goes into.
    """
    spark = table.sparkSession
    cuts = cut_points(table, n_features)
    folds = F.col("fold").cast("int") if "fold" in table.columns else F.lit(-1)
    base = table.select(vector_to_array("features").alias("x"), F.col(LABEL).cast("int").alias("label"), folds.alias("fold"))
    counts = {(r["fold"], r["label"]): r["n"] for r in base.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    start = []
    for fit in fits:
        own = np.zeros(classes)
        for (fold, label), n in counts.items():
            if fit.held_out is None or fold != fit.held_out:
                own[label] += n
        start.append(rule.start(own))
    first = np.stack(start)
    rows = sum(counts.values())
    parts = table_parts(rows, len(fits), spark.sparkContext.defaultParallelism)

    # blocks of rows whose numbers lie one after the other: a megabyte, whatever the number of models
    block, together = (max(256, size // (8 * first.size + n_features)) for size in (BLOCK_BYTES, SUMMED_BYTES))

    def packed(bins: np.ndarray, labels: np.ndarray, of: np.ndarray, margins: np.ndarray) -> list[pa.Array]:
        return [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (bins, labels, of, margins)]

    names = ["bins", "label", "fold", "margins"]

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, block):
                part = batch.slice(begin, block)
                bins = binned(matrix_of(part.column(0), n_features), cuts).T
                margins = np.repeat(first[:, :, None], part.num_rows, axis=2)
                yield pa.RecordBatch.from_arrays(packed(bins, part.column(1).to_numpy(), part.column(2).to_numpy(), margins), names=names)

    schema = "bins binary, label binary, fold binary, margins binary"
    # hundreds of small jobs: without a plan that adapts between their two stages, which costs more than the stages
    passes = spark.newSession()
    passes.conf.set("spark.sql.adaptive.enabled", "false")
    passes.conf.set("spark.sql.shuffle.partitions", str(min(parts, 32)))

    for setting in ("arrow.maxRecordsPerBatch", "parquet.columnarReaderBatchSize"):
        passes.conf.set(f"spark.sql.{'execution.' if setting.startswith('arrow') else ''}{setting}", "1")
    copy = StorageLevel.DISK_ONLY if 8 * first.size * rows > KEPT_BYTES * parts else StorageLevel.MEMORY_AND_DISK_DESER
    widths = [len(c) + 1 for c in cuts]
    most = LARGE_BUNDLE if rows // parts >= 10_000 else SMALL_BUNDLE

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for k in range(batch.num_rows):
            bins, labels, of, margins = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in enumerate((np.uint8, np.int32, np.int32, np.float64)))
            yield bins.reshape(n_features, len(labels)), labels, of, margins.reshape(len(fits), classes, len(labels))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """Blocks side by side, until they have rows enough for one sum."""
        held: list[tuple[np.ndarray, ...]] = []
        for rows in (rows for batch in batches for rows in read(batch)):
            held.append(rows)
            if sum(len(labels) for _, labels, _, _ in held) >= together:
                yield tuple(np.concatenate(c, axis=-1) for c in zip(*held, strict=True))
                held = []
        if held:
            yield tuple(np.concatenate(c, axis=-1) for c in zip(*held, strict=True))

    def stored(df: DataFrame) -> tuple[DataFrame, str]:
        """The table on disk, and a copy by the executors that is read again from there if it is lost."""
        path = scratch_path(spark, "margins")
        df.write.options(**BLOCKS_STORED).parquet(path)
        made = passes.read.schema(schema).parquet(path)
        return (made.coalesce(1) if parts == 1 else made).persist(copy), path

    state, path = stored(base.repartition(parts).mapInArrow(prepare, schema))
    trees = [Trees.none(rounds, classes, depth) for _ in fits]
    since = 0
    for r in range(rounds):
        above: list[np.ndarray] = []
        for level in range(depth):
            grown = [t.part(since, r + 1) for t in trees]

            def add(batches: Iterator[pa.RecordBatch], grown=grown, level=level) -> Iterator[pa.RecordBatch]:
                total = GradientSums(fits, grown, level, rule, widths, most)
                for rows in gathered(batches):
                    total.add(*rows)
                cells, sums = total.cells()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cells, *sums.T)], names=["cell", "g", "h", "n"])

            found = state.mapInArrow(add, "cell bigint, g bigint, h bigint, n bigint").groupBy("cell").agg(F.sum("g"), F.sum("h"), F.sum("n")).toArrow()
            above = _all_nodes(found, above, fits, trees, r, level, classes)
            for t, sums, fit in zip(trees, above, fits, strict=True):
                choose_splits(t, r, level, sums, fit, cuts, rule, rate)
        if r + 1 < rounds and r + 1 - since >= STORED_ROUNDS:
            grown = [t.part(since, r + 1) for t in trees]

            def move(batches: Iterator[pa.RecordBatch], grown=grown) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for bins, labels, of, margins in read(batch):
                        now = margins + np.stack([t.margins_by_class(bins) for t in grown])
                        yield pa.RecordBatch.from_arrays(packed(bins, labels, of, now), names=names)

            old, old_path = state, path
            state, path = stored(old.mapInArrow(move, schema))
            old.unpersist()
            remove_path(spark, old_path)
            since = r + 1
    state.unpersist()
    remove_path(spark, path)
    return cuts, start, trees


def _all_nodes(found: pa.Table, above: list[np.ndarray], fits: Sequence[Fit], trees: Sequence[Trees], r: int, level: int, classes: int) -> list[np.ndarray]:
    """Per fit the sums of all nodes of a level, right siblings as the parent less the left one."""
    cell, values = found.column(0).to_numpy(), np.stack([found.column(k).to_numpy() for k in (1, 2, 3)], axis=1)
    out, offset, half = [], 0, max(1, 2 ** (level - 1))
    for j, fit in enumerate(fits):
        size = classes * half * len(fit.features) * BINS
        own = np.zeros((size, 3), np.int64)
        mine = (cell >= offset) & (cell < offset + size)
        own[cell[mine] - offset] = values[mine]
        own = own.reshape(classes, half, len(fit.features), BINS, 3)
        offset += size
        if level:
            inner = slice(2 ** (level - 1) - 1, 2**level - 1)
            split = (trees[j].feature[r][:, inner] >= 0)[:, :, None, None, None]
            both = np.stack([own, np.where(split, above[j] - own, 0)], axis=2)
            own = both.reshape(classes, 2 * half, len(fit.features), BINS, 3)
        out.append(own)
    return out


# --- models ---------------------------------------------------------------------------------


Leaf = tuple[float, list[tuple[int, float, float, float]]]


@dataclass
class Boosted:
    """A grown model."""

    classes: list[str]
    cuts: list[np.ndarray]
    start: np.ndarray
    trees: Trees

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.trees.margins(binned(x, self.cuts))

    def outputs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (margins := self.margins(x)), softmax(margins) if len(x) else margins

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds margins, probabilities, confidence (the largest) and predicted_category (first on ties)."""
        return scored(df, self.classes, len(self.cuts), {None: self})

    def importances(self) -> np.ndarray:
        """Mean gain of a feature's splits, as a share of all features'."""
        out = np.zeros(len(self.cuts))
        for f in range(len(self.cuts)):
            own = self.trees.gain[self.trees.feature == f]
            out[f] = own.mean() if len(own) else 0.0
        return out / out.sum() if out.sum() else out

    def leaves(self) -> list[list[Leaf]]:
        """Per class the leaves of its trees as (value, [(feature, low, high, share)]), and the start as a leaf without a path.

        A row follows a leaf's path if low < x <= high for each of its features; `share` is the
        part of the training cover at the path's splits on the feature that does.
        """
        out: list[list[Leaf]] = []
        t = self.trees
        inner = t.feature.shape[2]
        for k in range(len(self.classes)):
            own: list[Leaf] = [(float(self.start[k]), [])]
            for r in range(len(t.feature)):
                todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
                while todo:
                    node, limits = todo.pop()
                    f = int(t.feature[r, k, node]) if node < inner else -1
                    if f < 0:
                        own.append((float(t.value[r, k, node]), [(g, lo, hi, share) for g, (lo, hi, share) in limits.items()]))
                        continue
                    at = float(self.cuts[f][t.cut[r, k, node]])
                    lo, hi, share = limits.get(f, (-np.inf, np.inf, 1.0))
                    covers = t.cover[r, k, 2 * node + 1], t.cover[r, k, 2 * node + 2]
                    for child, low, high, cover in ((2 * node + 1, lo, min(hi, at), covers[0]), (2 * node + 2, max(lo, at), hi, covers[1])):
                        todo.append((child, {**limits, f: (low, high, share * float(cover / sum(covers)))}))
            out.append(own)
        return out


def tree_nodes(model: Boosted, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """round, class, node, feature, cut, gain, value, cover of every node of the trees; leaves have no feature."""
    t, rows = model.trees, []
    inner = t.feature.shape[2]
    for r in range(len(t.feature)):
        for k, name in enumerate(model.classes):
            todo = [0]
            while todo:
                node = todo.pop()
                f = int(t.feature[r, k, node]) if node < inner else -1
                split = (features[f], float(model.cuts[f][t.cut[r, k, node]]), float(t.gain[r, k, node])) if f >= 0 else (None, None, None)
                rows.append((r, name, node, *split, float(t.value[r, k, node]), float(t.cover[r, k, node])))
                todo += [2 * node + 1, 2 * node + 2] if f >= 0 else []
    return spark.createDataFrame(rows, "round bigint, class string, node bigint, feature string, cut double, gain double, value double, cover double")


def scored(df: DataFrame, classes: Sequence[str], width: int, models: Mapping, by: Column | None = None) -> DataFrame:
    """Adds margins, probabilities, confidence and predicted_category by the model that `by` names for each row.

    A model's `outputs` turns feature rows into margins and probabilities. Rows of no model are left out.
    """
    keep = [c for c in df.columns if c not in ("features", "margins", "probabilities")]
    rows = df.select(*keep, vector_to_array("features").alias("_x"), (by if by is not None else F.lit(None)).cast("int").alias("_by"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    shared = df.sparkSession.sparkContext.broadcast(dict(models))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, by_row = matrix_of(batch.column(len(keep)), width), np.array(batch.column(len(keep) + 1).to_pylist(), object)
            both, chosen = np.zeros((2, len(x), len(classes))), np.zeros(len(x), bool)
            for name, model in shared.value.items():
                own = np.array([b == name for b in by_row], bool)
                both[:, own] = model.outputs(x[own])
                chosen |= own
            lists = [pa.array(list(m), pa.list_(pa.float64())) for m in both]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *lists], names=[*keep, "margins", "probabilities"]).filter(pa.array(chosen))

    return with_best(rows.mapInArrow(score, f"{kept}, margins array<double>, probabilities array<double>"), classes)


@dataclass
class Boosting:
    """A boosted classifier to fit: any number of models of it grow together."""

    name: str
    rule: Rule
    rounds: int = V.BOOSTING["rounds"]
    note: str = ""

    def fit_all(self, table: DataFrame, fits: Sequence[Fit], n_features: int, classes: Sequence[str]) -> list[Boosted]:
        cuts, start, trees = grow(table, fits, n_features, len(classes), self.rule, self.rounds)
        return [Boosted(list(classes), cuts, s, t) for s, t in zip(start, trees, strict=True)]

    def fit(self, train: DataFrame, n_features: int, classes: Sequence[str]) -> Boosted:
        return self.fit_all(train, [Fit(tuple(range(n_features)))], n_features, classes)[0]

    def out_of_fold(self, table: DataFrame, folds: Sequence[int], n_features: int, classes: Sequence[str]) -> DataFrame:
        """Predictions of every row by the model grown on the other folds."""
        models = self.fit_all(table, [Fit(tuple(range(n_features)), k) for k in folds], n_features, classes)
        return scored(table, classes, n_features, dict(zip(folds, models, strict=True)), F.col("fold"))

    def blocks_out_of_fold(self, table: DataFrame, blocks: Mapping[str, Sequence[int]], folds: Sequence[int], n_features: int, classes: Sequence[str]) -> DataFrame:
        """The same for several feature blocks (by feature number) at once, tagged with `block`."""
        fits = [Fit(tuple(columns), k) for columns in blocks.values() for k in folds]
        models = self.fit_all(table, fits, n_features, classes)
        parts = []
        for b, name in enumerate(blocks):
            own = dict(zip(folds, models[b * len(folds) : (b + 1) * len(folds)], strict=True))
            parts.append(scored(table, classes, n_features, own, F.col("fold")).withColumn("block", F.lit(name)))
        return reduce(DataFrame.unionByName, parts)
