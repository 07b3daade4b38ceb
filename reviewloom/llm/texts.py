"""Texts of an Arrow column as byte arrays: words, their hashes, and slices of bounded size.

Everything here works on a few megabytes at a time with whole-array operations,
inside a task. Words are maximal runs of bytes that are not separators; a
separator is never part of a multi-byte character, so words are whole characters.
"""

import ctypes
import functools

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

LETTERS = np.ones(256, bool)
LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def released(step):
    """A step over batches that gives back freed memory at its end, as its worker process lives on."""
    @functools.wraps(step)
    def run(batches):
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def mix(values):
    """Scramble 64-bit values so that every bit depends on all of them."""
    values = values.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values ^= values >> np.uint64(shift)
        values *= np.uint64(factor)
    values ^= values >> np.uint64(31)
    return values


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(n):
    """BASE**0 .. BASE**(n-1) and their inverses modulo 2**64."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, min(2 * len(_POWERS), 1 << 20))
        factors = np.empty((2, size), np.uint64)
        factors[0], factors[1], factors[:, 0] = BASE, pow(BASE, -1, 1 << 64), 1
        _POWERS, _INVERSE = np.multiply.accumulate(factors, axis=1)
    return _POWERS[:n], _INVERSE[:n]


def prefix_hashes(data):
    """Sums whose differences hash any part of ``data``; see ``part_hashes``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data))[0], out=sums[1:])
    return sums


def part_hashes(sums, starts, ends):
    """64-bit hashes of the parts from ``starts`` to ``ends``, by content only."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def slices(column, most=SLICE_BYTES):
    """Cut a string column into (first row, bytes, offsets) of about ``most`` bytes; null reads as empty.

    A longer text is a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offset_buffer, data_buffer = column.buffers()
    if not n:
        return
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def words(data, offsets, separators=WHITE):
    """Starts, ends and text numbers of the words of a slice, in order."""
    inside = ~separators[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    before[borders] = False
    after[borders - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data, starts, ends, lower=False):
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        begin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + SLICE_BYTES, "right")))
        part = data[begin:ends[last - 1]]
        sums = prefix_hashes(LOWER[part] if lower else part)
        out[first:last] = part_hashes(sums, starts[first:last] - begin, ends[first:last] - begin)
        first = last
    return out


def runs_of(hashes, owners, n):
    """Hashes of ``n`` neighbouring words, and the index of the first word of each run.

    Runs never cross from one owner (text) to the next.
    """
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(hashes) - n + 1
    total = np.zeros(size, np.uint64)
    factor = 1
    for i in range(n):
        total += hashes[i:i + size] * np.uint64(factor)
        factor = factor * BASE % (1 << 64)
    whole = np.flatnonzero(owners[:size] == owners[n - 1:])
    return mix(total[whole]), whole


def group_bounds(owners, n):
    """Where the rows of each of ``n`` owners begin and end; owners are sorted."""
    edges = np.searchsorted(owners, np.arange(n + 1))
    return edges[:-1], edges[1:]
