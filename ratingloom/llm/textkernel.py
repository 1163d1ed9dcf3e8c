"""Words, word hashes and shingle hashes of many texts at once, as numpy arrays.

Texts come as the UTF-8 buffer of an Arrow column. A slice of texts is worked
on together, so that the cost per text is small; a slice holds about
`SLICE_BYTES`, or one longer text. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: list[np.ndarray] = []

#: Bytes between words: space and \t \n \v \f \r.
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


_VALUES = _byte_values()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWERED_VALUES = _VALUES[_LOWER]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = []
        for base in (_BASE, inverse):
            out = np.ones(size, dtype=np.uint64)
            done = 1
            while done < size:  # doubling: the next block is this one times base ** done
                more = min(done, size - done)
                out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
                done += more
            _POWERS.append(out)
    return _POWERS[0], _POWERS[1]


@dataclass
class Slice:
    """Some texts of a batch: their bytes, where each begins, and the row of the first."""

    data: np.ndarray
    bounds: np.ndarray
    first: int

    @property
    def count(self) -> int:
        return len(self.bounds) - 1

    def text(self, k: int) -> bytes:
        return self.data[self.bounds[k] : self.bounds[k + 1]].tobytes()


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 bounds of its texts; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, bounds


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column in slices of about `size` bytes."""
    data, bounds = column_bytes(column)
    start, n = 0, len(bounds) - 1
    while start < n:
        end = int(np.searchsorted(bounds, bounds[start] + size, side="right")) - 1
        end = min(n, max(start + 1, end))
        yield Slice(data[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start], start)
        start = end


def classes(members: bytes) -> np.ndarray:
    """A table of 256 flags."""
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


WORD_BYTES = ~classes(SPACES)
#: ASCII letters and every byte of a longer UTF-8 character.
LETTER_BYTES = classes(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))


@dataclass
class Words:
    """The words of a slice: begin, end (exclusive), text they are in, hash."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of set flags that lie within one text each."""
    n = len(inside)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]  # a run never goes on into the next text
    begins[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = _LOWERED_VALUES) -> np.ndarray:
    """A hash of the bytes of each span; A-Z hash as a-z."""
    n = len(data)
    up, down = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[data] * up[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def beginnings(data: np.ndarray, start: np.ndarray, end: np.ndarray, sizes: tuple[int, ...], values: np.ndarray = _LOWERED_VALUES) -> Iterator[np.ndarray]:
    """For each size a hash of the first bytes of every span; a shorter span hashes whole."""
    n = len(data)
    up, down = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[data] * up[:n], out=sums[1:])
    base, shift = sums[start], down[start]
    for size in sizes:
        stop = np.minimum(start + size, end)
        yield mix((sums[stop] - base) * shift + np.uint64(1000 + size))


def text_of(s: Slice, start: np.ndarray) -> np.ndarray:
    """The number of the text each position lies in."""
    return np.searchsorted(s.bounds, start, side="right") - 1


def words(s: Slice, members: np.ndarray = WORD_BYTES, values: np.ndarray = _LOWERED_VALUES) -> Words:
    """Maximal runs of the member bytes within each text; A-Z hash as a-z."""
    start, end = runs(members[s.data], s.bounds)
    return Words(start, end, text_of(s, start), span_hashes(s.data, start, end, values))


_ODD = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def windows(h: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of `width` words that lies within one group."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += h[k : k + n] * _ODD[k]
    at = np.flatnonzero(group[:n] == group[width - 1 : width - 1 + n])
    return at, mix(out[at])


def shingles(w: Words, width: int, count: int) -> Iterator[np.ndarray]:
    """For each of `count` texts its distinct shingle hashes in ascending order.

    A text with fewer words than `width` has one shingle, its whole sequence; a
    text without words has none.
    """
    at, h = windows(w.hash, w.text, width)
    of = w.text[at]
    cuts = np.searchsorted(of, np.arange(count + 1))
    word_cuts = np.searchsorted(w.text, np.arange(count + 1))
    for k in range(count):
        if cuts[k] < cuts[k + 1]:
            own = np.sort(h[cuts[k] : cuts[k + 1]])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own
        elif word_cuts[k] < word_cuts[k + 1]:
            own = w.hash[word_cuts[k] : word_cuts[k + 1]]
            yield mix((own * _ODD[: len(own)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(own)))
        else:
            yield np.zeros(0, np.uint64)
