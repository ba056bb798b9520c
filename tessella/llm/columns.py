"""Arrow text columns as byte arrays, and word hashes over them, for the Python operators.

Everything here works on bounded pieces of a batch (a few MB of text, or one document when that is
longer), so memory follows the longest document and not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 2 << 20
#: Strings of at most so many bytes are hashed all at once.
SHORT = 48
_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Byte classes. SPACE6 is x20 and x09-x0D. ALNUM8 is a-z, 0-9 and every byte from x80.
SPACE6 = np.zeros(256, bool)
SPACE6[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE6 = ~SPACE6
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM8 = np.zeros(256, bool)
ALNUM8[48:58] = ALNUM8[97:123] = ALNUM8[128:] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of at most `limit` bytes of text (or one row)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(np.asarray(lengths, np.int64))
        at, n = 0, batch.num_rows
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def trim() -> None:
    """Gives freed memory back to the system, as workers wait for other operators' tasks with what they have. Nothing where the C library can't."""
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free:
        free(0)


def chunks(data: np.ndarray) -> np.ndarray:
    """At each byte, and at the end, the eight bytes from there on as a number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings data[starts[i]:ends[i]], chained by `mix` through eight bytes at a time, those of SHORT bytes or more by XXH3.

    No sum or polynomial: texts built to cancel out (complementary doublings and the like) stay apart.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) + _SEED)
    view = chunks(data)
    live = np.flatnonzero(size <= SHORT)
    for k in range(0, SHORT, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        chunk = view[starts[live] + k] & _MASKS[np.minimum(size[live] - k, 8)]
        out[live] = mix((out[live] ^ chunk) + _STEP)
    long = np.flatnonzero(size > SHORT)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def window_hash(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the sequences values[starts[i]:starts[i] + sizes[i]] of 64-bit numbers, of a few each, chained alike."""
    out = mix(sizes.astype(np.uint64) + _SEED)
    live = np.arange(len(starts))
    for k in range(int(sizes.max(initial=0))):
        live = live if (sizes[live] > k).all() else live[sizes[live] > k]
        out[live] = mix((out[live] ^ values[starts[live] + k]) + _STEP)
    return out


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether the strings data[starts[i]:ends[i]] and other[other_starts[i]:other_ends[i]] are equal, byte for byte."""
    size = ends - starts
    same = size == other_ends - other_starts
    here, there = chunks(data), chunks(other)
    live = np.flatnonzero(same)
    for k in range(0, int(size.max(initial=0)), 8):
        live = live[size[live] > k]
        if not len(live):
            break
        if k >= SHORT:
            for i in live.tolist():
                same[i] = np.array_equal(data[starts[i] + k : ends[i]], other[other_starts[i] + k : other_ends[i]])
            break
        alike = ((here[starts[live] + k] ^ there[other_starts[live] + k]) & _MASKS[np.minimum(size[live] - k, 8)]) == 0
        same[live[~alike]] = False
        live = live[alike]
    return same


def tokens(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): maximal runs of the table's bytes inside each document; document d has runs first[d]:first[d+1]."""
    inside = table[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    head, tail = offsets[:-1][full], offsets[1:][full] - 1
    begins[head], stops[tail] = inside[head], inside[tail]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, rank within owner) for counts[i] rows of each i."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def per_owner(first: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Sums of flags over first[d]:first[d+1]."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
