"""Words and shingles of Arrow text columns as 64-bit hashes, computed with numpy inside a task.

A word is a maximal run of bytes outside space and 0x09-0x0D; A-Z are lower-cased. Memory is bounded by
``SLICE`` bytes of text at a time, or by the longest text where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_CODE[ord("A"):ord("Z") + 1] = _CODE[ord("a"):ord("z") + 1]
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first row, row after the last, bytes, offsets`` of runs of rows with about ``limit`` bytes."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and for each row the number of words before it (one entry more than rows)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | breaks[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | breaks[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    power, inverse = power_tables(len(data))
    sums = np.cumsum(_CODE[data] * power[:len(data)])
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return mix((sums[ends] - before) * inverse[starts]), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingle hashes of each row, sorted, and their bounds by row.

    A row of fewer than ``k`` words gives its whole sequence as one shingle; without words, none.
    """
    windows = np.zeros(0, np.uint64)
    if len(words) >= k:
        windows = words[:len(words) - k + 1]
        for j in range(1, k):
            windows = windows * _ODD + words[j:len(words) - k + 1 + j]
        windows = mix(windows)
    rows, sizes = [], []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= k:
            own = np.sort(windows[lo:hi - k + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif hi > lo:
            own = np.uint64([hi - lo])
            for w in words[lo:hi]:
                own = mix(own * _ODD + w)
        else:
            own = windows[:0]
        rows.append(own)
        sizes.append(len(own))
    return np.concatenate(rows) if rows else windows[:0], np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
