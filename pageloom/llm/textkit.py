"""Vectorised text kernels shared by the operators: ragged UTF-8, words, hashes.

A block is a pair (data, offs): the concatenated UTF-8 bytes of some rows and
the n + 1 row offsets. Kernels run over whole blocks of a few MB, so their memory
is bounded by the block and the longest single text, not by an Arrow batch.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and a worker, about; with its last row it is still one block.
BATCH_BYTES = 7 << 17
_ODD = U(0x9E3779B97F4A7C15)


def releasing(batches_to_batches):
    """For functions of mapInArrow: what a task has freed goes back to the system at its end, as workers live on for other stages."""

    @functools.wraps(batches_to_batches)
    def run(batches):
        try:
            yield from batches_to_batches(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); a bijection."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * _ODD)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {}


def _pow(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.empty(size, dtype=U)
        have[0] = 1
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        _powers.clear() if len(_powers) > 8 else None
        _powers[int(base)] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.empty(0, dtype=U)
    sums = np.empty(len(data) + 1, dtype=U)
    sums[0] = 0
    np.cumsum(_BYTE_VALUE[data] * _pow(_ODD, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _pow(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(U))


#: A permutation of the bytes, so that the second half of a wide hash is of other values.
_SECOND = np.argsort(mix(np.arange(256, dtype=U))).astype(np.uint8)


def wide_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of byte spans, as two columns."""
    return span_hashes(data, starts, ends), span_hashes(_SECOND[data], starts, ends)


def string_block(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets); nulls count as empty."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("", column.type))
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Arrow batches cut into runs of rows with about ``limit`` bytes of text (always a row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = string_block(batch.column(batch.schema.get_field_index(text_col)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Everything but space and 0x09 to 0x0D.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True; a run never crosses a row."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def row_bounds(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Index into ``starts`` at which each row begins (n + 1 values)."""
    return np.searchsorted(starts, offs, side="left")


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-word shingles of every row, rows one after another, and their bounds.

    A row with 1 to n - 1 words gives one shingle of its whole sequence; one without words gives none.
    """
    counts = np.diff(bounds)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    rows = np.repeat(np.arange(len(counts)), made)
    first = bounds[:-1][rows] + (np.arange(out_bounds[-1]) - out_bounds[:-1][rows])
    have = np.minimum(counts, n)[rows]
    padded = np.concatenate([words, np.zeros(n, dtype=U)])
    value = have.astype(U)
    for j in range(n):
        factor = U((0xD6E8FEB86659FD93 * (2 * j + 1)) % (1 << 64) | 1)
        value = value * U(0xFF51AFD7ED558CCD) + np.where(j < have, mix(padded[first + j] * factor), U(0))
    return mix(value), out_bounds


def ragged_binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows values[bounds[i]:bounds[i+1]] as little-endian binary."""
    width = values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def binary_values(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """A binary column of packed numbers as (values, bounds); null is empty."""
    column = pc.fill_null(column, b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    width = np.dtype(dtype).itemsize
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return np.ascontiguousarray(raw).view(dtype), (bounds - bounds[0]) // width


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of some sorted sets, by blocked matrix products."""
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # what only one set has can't be common to two
    place = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column]
    row = np.repeat(np.arange(len(sets)), np.diff(bounds))
    row, place = row[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        a, b = np.searchsorted(place, [low, low + 4096])
        part = np.zeros((len(sets), min(4096, int(place[-1]) + 1 - low)), dtype=np.float32)
        part[row[a:b], place[a:b] - low] = 1
        common += part @ part.T
    np.fill_diagonal(common, np.diff(bounds))
    return common.astype(np.int64)
