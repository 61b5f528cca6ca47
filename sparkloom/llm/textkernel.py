"""Vectorised scanning of UTF-8 text held in Arrow string arrays.

A batch is walked in chunks of about ``CHUNK_BYTES`` so that the numpy temporaries stay
in cache and memory is bounded by the chunk (or by one longer text). Spans are hashed by
polynomial prefix sums modulo the prime 2**31 - 1 under two random bases, shifted back to the
span's start with the inverse powers, so equal spans have equal hashes wherever they stand, and
two given spans of n bytes or less collide for at most (n / 2**31)**2 of the pairs of bases,
whatever their structure. Sums start anew every ``SEGMENT`` bytes, which bounds the tables of powers.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
SEGMENT = 1 << 18
_U = np.uint64
_MASK = (1 << 64) - 1
_PRIME = (1 << 31) - 1
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BASES = np.random.Generator(np.random.PCG64(20240607)).integers(1 << 20, _PRIME - 1, 2).tolist()
_BYTES = np.arange(1, 257, dtype=np.uint64)
_BYTES_LOWER = _BYTES.copy()
_BYTES_LOWER[65:91] = _BYTES[97:123]


def _reduce(x: np.ndarray) -> np.ndarray:
    """Modulo the prime."""
    p, shift = _U(_PRIME), _U(31)
    x = (x & p) + (x >> shift)
    x = (x & p) + (x >> shift)
    return np.where(x >= p, x - p, x)


@functools.cache
def _powers(lane: int) -> tuple[np.ndarray, np.ndarray]:
    """The lane's base and its inverse to the powers up to SEGMENT."""
    out = []
    for base in (_BASES[lane], pow(_BASES[lane], -1, _PRIME)):
        table, size = np.ones(SEGMENT + 1, np.uint64), 1
        while size < len(table):
            some = table[: min(size, len(table) - size)]
            table[size : size + len(some)] = _reduce(some * _U(pow(base, size, _PRIME)))
            size *= 2
        out.append(table)
    return out[0], out[1]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & _MASK)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def strings(column: pa.Array) -> pa.Array:
    """The column as large strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets within them) of about ``size`` bytes each."""
    column = strings(column)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, len(column))
        yield first, last, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``inside`` holds, split at ``offsets``; and each text's range of runs."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray, lower: bool = False) -> list[np.ndarray]:
    """For both bases the sums of ``(byte + 1) * base**k`` before each byte; each SEGMENT has its own, one entry longer."""
    values = np.take(_BYTES_LOWER if lower else _BYTES, data)
    pieces = -(-len(data) // SEGMENT) or 1
    out = []
    for lane in range(2):
        up, _ = _powers(lane)
        sums = np.zeros(len(data) + pieces, np.uint64)
        for k in range(pieces):
            some = values[k * SEGMENT : (k + 1) * SEGMENT]
            np.cumsum(some * up[: len(some)], out=sums[k * (SEGMENT + 1) + 1 : k * (SEGMENT + 1) + 1 + len(some)])
        out.append(sums)
    return out


def _span(sums: list[np.ndarray], start: int, end: int) -> int:
    """The combined polynomials of one span, over as many segments as it has."""
    out = 0
    for lane, s in enumerate(sums):
        _, down = _powers(lane)
        value, at = 0, start
        while at < end:
            stop = min(end, (at // SEGMENT + 1) * SEGMENT)
            piece = at // SEGMENT
            part = int(s[stop + piece]) - int(s[at + piece])
            value += part * int(down[at % SEGMENT]) * pow(_BASES[lane], at - start, _PRIME)
            at = stop
        out = out << 31 | value % _PRIME
    return out


def hash_spans(sums: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    a, b, long = starts, ends, ()
    if len(sums[0]) > SEGMENT + 1:
        piece = starts // SEGMENT
        long = np.flatnonzero(ends > (piece + 1) * SEGMENT)
        a, b = starts + piece, np.minimum(ends, (piece + 1) * SEGMENT) + piece
        starts = starts % SEGMENT
    lanes = [_reduce(_reduce(s[b] - s[a]) * _powers(lane)[1][starts]) for lane, s in enumerate(sums)]
    out = (lanes[0] << _U(31)) | lanes[1]
    for k in long:
        out[k] = _span(sums, int(a[k] - piece[k]), int(ends[k]))
    return mix(out)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * _U(0xD6E8FEB86659FD93) + ((y << _U(32)) | (y >> _U(32))))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n consecutive hashes; entry i is that of hashes[i : i + n]. Runs of 1, 2, 4 ... are
    hashed in turn from two halves, and those that n is the sum of put together."""
    count = len(hashes) - n + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    whole, done, level, size = None, 0, hashes, 1
    while True:
        if n & size:
            some = level[done : done + count]
            whole, done = some if whole is None else _pair(whole, some), done + size
        if 2 * size > n:
            return mix(whole, n)
        level, size = _pair(level[:-size], level[size:]), 2 * size


def window_owner(ranges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts with these ranges of words: the windows of n words within one text, and each window's text."""
    counts = np.diff(ranges)
    owner = np.repeat(np.arange(len(counts)), counts)
    total = int(ranges[-1] - ranges[0])
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[: total - n + 1] == owner[n - 1 :])
    return at, owner[at]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text's range."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
