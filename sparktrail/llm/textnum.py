"""Word and shingle hashes of whole Arrow batches, computed with numpy inside Spark tasks.

Texts are read as UTF-8 bytes. Every separator of the contracts is an ASCII byte,
so cutting bytes and cutting characters give the same words. A word's hash is a
polynomial over its bytes taken from one prefix sum per chunk, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text handled at once; one longer text is a chunk of its own.
CHUNK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_column(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column. A null row is an empty one."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about CHUNK bytes: first row, end row, their bytes, offsets from 0."""
    data, offsets = byte_column(column)
    rows, at = len(offsets) - 1, 0
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1
        end = min(max(end, at + 1), rows)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words(NamedTuple):
    row: np.ndarray  # row of each word within the chunk
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def edges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in ``inside``; runs end where a row ends."""
    n = len(inside)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = power_tables(len(data) + 1)  # an empty span may begin at the end
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=sums[1:], dtype=U64)
    if not len(start):
        return np.zeros(0, U64)
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64))


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Whitespace-separated words of a chunk, A-Z lower-cased for hashing."""
    data = LOWER[data]
    start, end = edges(~SPACE[data], offsets)
    row = np.searchsorted(offsets[1:], start, side="right")
    return Words(row, start, end, span_hashes(data, start, end))


_WEIGHTS = [U64(w) for w in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its 5-word shingles.

    One to four words make one shingle; no words make none.
    """
    row, _, _, h = words(data, offsets)
    rows = len(offsets) - 1
    first = np.searchsorted(row, np.arange(rows + 1))
    rolled = np.zeros(0, U64)
    if len(h) >= 5:
        rolled = sum((h[k : len(h) - 4 + k] * _WEIGHTS[k] for k in range(1, 5)), h[: len(h) - 4] * _WEIGHTS[0])
        rolled = mix(rolled)
    out = []
    for r in range(rows):
        a, b = int(first[r]), int(first[r + 1])
        if b - a >= 5:
            out.append(np.unique(rolled[a : b - 4]))
        elif b > a:
            short = sum((h[a + k : a + k + 1] * _WEIGHTS[k] for k in range(1, b - a)), h[a : a + 1] * _WEIGHTS[0])
            out.append(mix(short + U64((b - a) * 0x5851F42D4C957F2D & ((1 << 64) - 1))))
        else:
            out.append(rolled[:0])
    return out
