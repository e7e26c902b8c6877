"""Words of whole texts as NumPy arrays, many documents at a time.

Everything works on the UTF-8 bytes of an Arrow column in pieces of bounded size, so the memory
of a batch does not depend on how long its texts are (beyond 8 bytes for each word of one document).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Separators (True) of words ``[^\x20\x09-\x0D]+``, and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in lower case.
SPACES = byte_table((0x20, 0x20), (0x09, 0x0D))
NON_ALNUM = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_BASE = 0x9E3779B97F4A7C15 | 1
_LETTERS = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 4096)
        _POWERS[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, b % (1 << 64), dtype=np.uint64)))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of documents ``first`` to ``last - 1`` of a column, in order."""

    first: int
    last: int
    bounds: np.ndarray  # words bounds[i] to bounds[i + 1] are those of document first + i
    hashes: np.ndarray  # uint64
    starts: np.ndarray  # byte offsets from the beginning of document `first`
    ends: np.ndarray


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def _region(data: np.ndarray, marks: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of words in ``data``; words end at ``marks`` (offsets) too."""
    n = len(data)
    x = LOWER[data]
    word = ~separators[x]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    marks = marks[(marks > 0) & (marks < n)]
    begins[marks] = word[marks]
    stops[marks - 1] = word[marks - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LETTERS[x] * power[:n], out=sums[1:])
    return s, e, scramble((sums[e] - sums[s]) * inverse[s])


def words_of(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> Iterator[Words]:
    """Words of all documents, in groups of about ``PIECE`` bytes; a longer document is a group of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1)
        j = min(j, n)
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 2 * PIECE:
            s, e, h = _region(data[a:b], offsets[i:j] - a, separators)
        else:  # one document: cut at separators
            parts, at = [], a
            while at < b:
                to = min(at + PIECE, b)
                while to < b and not separators[LOWER[data[to - 1]]]:
                    step = data[to : to + PIECE]
                    hit = np.flatnonzero(separators[LOWER[step[: b - to]]])
                    to = to + int(hit[0]) + 1 if len(hit) else min(to + PIECE, b)
                s, e, h = _region(data[at:to], np.zeros(0, dtype=np.int64), separators)
                parts.append((s + (at - a), e + (at - a), h))
                at = to
            s, e, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        bounds = np.searchsorted(s, offsets[i : j + 1] - a)
        bounds[-1] = len(s)
        yield Words(i, j, bounds, h, s, e)
        i = j
