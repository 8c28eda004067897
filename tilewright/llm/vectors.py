"""Numpy helpers over Arrow text columns: byte classes, words and rolling hashes for a whole batch at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1


def chunks(column: pa.Array, most_bytes: int = 500_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most_bytes``; a longer row is a run of its own.

    Null counts as the empty text.
    """
    text = column.cast(pa.large_string()).fill_null("")
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most_bytes, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def byte_class(pairs: list[tuple[int, int]]) -> np.ndarray:
    """A table of the bytes that lie in one of the inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in pairs:
        out[a : b + 1] = True
    return out


#: Bytes of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in lower-cased UTF-8.
SPACED = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = byte_class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of bytes of a kind, none across rows."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = kind[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    starts = inside & ~before
    starts[edge] = inside[edge]
    ends = ~inside & before
    cut = edge[edge > 0]
    ends[cut] = before[cut]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    return s, e, np.searchsorted(offsets, s, "right") - 1


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal spans wherever they stand."""
    size = 1 << max(10, int(len(data)).bit_length())
    base = 0xD6E8FEB86659FD93
    up, down = _powers(size, base), _powers(size, pow(base, -1, 1 << 64))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * MULTIPLIER)


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in a sorted array of row numbers, and the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * MULTIPLIER + b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` neighbours, whatever rows they lie in: windows of powers of two, put together."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, size = None, 0, 1
    while True:
        if width & size:
            part = h[done : done + n]
            out = mix(part) if out is None else _pair(out, part)
            done += size
        if done == width:
            return out
        h = _pair(h[:-size], h[size:])
        size *= 2
