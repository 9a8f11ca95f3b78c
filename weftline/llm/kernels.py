"""Vectorised numpy kernels shared by the text operators.

Everything here works on one Arrow string column at a time, in slices of a
bounded number of bytes, so a task's memory does not depend on the size of its
partition (one single text is never cut).  Spark does the partitioning, the
shuffles and the joins; these helpers only turn bytes into integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of text that a kernel works on at a time.
SLICE_BYTES = 2_000_000

U64 = np.uint64
_INDEX = U64((1 << 24) - 1)
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MASK64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_values(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
    if fold:
        values[65:91] = values[97:123]
    return values


_BYTE_VALUES = {fold: _byte_values(fold) for fold in (False, True)}
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64, or of its inverse."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = _BASE[which]
        if inverse:
            base = pow(base, -1, 1 << 64)
        size = max(n, 1 << 16)
        have = np.empty(size, dtype=U64)
        have[0] = 1
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            have[filled : filled + step] = have[:step] * U64(pow(base, filled, 1 << 64))
            filled += step
        _powers[which, inverse] = have
    return have[:n]


class Rolling:
    """Hashes of any ranges of a sequence of integers, from one prefix sum."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values)
        self.which = which
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(values * powers(n, which), dtype=U64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = powers(len(self.sums), self.which, True)
        return mix((self.sums[end] - self.sums[start]) * inverse[start] + (end - start).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        """The hashes of all windows of k values."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, dtype=U64)
        return mix((self.sums[k:] - self.sums[:n]) * powers(n, self.which, True) + U64(k))


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets of the texts) of pieces of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, everything[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """The words of the texts of one slice: byte ranges, hashes and the range of words of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False):
        inside = ~SPACE[data]
        filled = offsets[:-1] < offsets[1:]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        at = offsets[:-1][filled]
        begins[at] = inside[at]
        at = offsets[1:][filled] - 1
        ends[at] = inside[at]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.hashes = Rolling(_BYTE_VALUES[fold][data]).of(self.start, self.end)


def byte_rolling(data: np.ndarray) -> Rolling:
    return Rolling(_BYTE_VALUES[False][data])


def runs_by_minimizer(grams: np.ndarray, bounds: np.ndarray, k: int, length: int):
    """Cut the windows of `length` values of each text into maximal runs that share their minimizer.

    `grams` has the hashes of all windows of k values, `bounds` the range of values of each text.
    A window's minimizer is the smallest k-gram in it (the first one, at a tie), so equal windows
    have equal minimizers wherever they stand.  Returns text, first window, last window, position of
    the minimizer, for each run; windows never reach from one text into the next.
    """
    w = length - k + 1
    n = len(grams)
    empty = np.zeros(0, dtype=np.int64)
    if n < w:
        return empty, empty, empty, empty
    where = np.empty(n - w + 1, dtype=np.int64)
    block = 1 << 22  # an index within a block fits the low bits of the keys
    for at in range(0, n - w + 1, block):
        part = grams[at : at + block + w - 1]
        m = len(part) - w + 1
        low = (mix(part) & ~_INDEX) | np.arange(len(part), dtype=U64)
        span = 1
        while span * 2 <= w:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[:m], low[w - span : w - span + m])
        where[at : at + m] = (low & _INDEX).astype(np.int64) + at
    first, last = bounds[:-1], bounds[1:] - length
    has = last >= first
    texts = np.flatnonzero(has)
    first, last = first[has], last[has]
    if not len(texts):
        return empty, empty, empty, empty
    # valid windows, text by text
    sizes = last - first + 1
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    windows = np.arange(total) + np.repeat(first - (ends - sizes), sizes)
    anchors = where[windows]
    new = np.ones(total, dtype=bool)
    new[1:] = anchors[1:] != anchors[:-1]
    new[ends[:-1]] = True
    at = np.flatnonzero(new)
    stop = np.append(at[1:], total) - 1
    owner = texts[np.searchsorted(ends, at, side="right")]
    return owner, windows[at], windows[stop], anchors[at]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    where = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=where[1:])
    return pa.ListArray.from_arrays(pa.array(where), pa.array(values, type=kind))


def spans_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges [start, end) as maximal disjoint ranges in order; ranges that touch merge."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return starts[at], reach[np.append(at[1:], len(starts)) - 1]


def runs_of_equal(keys: np.ndarray, values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(key, its values) for each run of equal keys."""
    if not len(keys):
        return []
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [(int(keys[a]), part) for a, part in zip(new, np.split(values, new[1:]), strict=True)]


def grouped(keys: np.ndarray, values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(key, its values in ascending order) for each distinct key."""
    by = np.lexsort((values, keys))
    return runs_of_equal(keys[by], values[by])
