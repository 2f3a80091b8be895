"""Words, lines and word windows of many UTF-8 texts at once, as numpy arrays over their bytes.

A word is a run of bytes other than space and tab, line feed, vertical tab, form feed and carriage return. Hashes are
polynomials modulo 2^64 over a random value per byte (or per word), so that the hash of any stretch comes from two
running sums; `mixed` finishes them. Random values are drawn from a fixed seed: every task sees the same ones.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
BYTE_VALUE = np.random.default_rng(20240601).integers(1, 2**64, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NEWLINE = 10

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept and lengthened as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _powers[base] = have = np.cumprod(steps)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a hash over the whole word."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def running(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums of 64-bit values: sums[i] covers the first i."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    return sums


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values start..end-1 from running sums; equal stretches have equal hashes wherever they are."""
    return mixed((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column and the n + 1 offsets of its rows; null counts as empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: workers outlive their stage and would hold it while others run."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes (a longer text alone): first row, row after the last, bytes, offsets."""
    raw, offsets = column_bytes(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, raw[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last
    give_back()


def parts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of about 1 MB of a text column (a longer text alone), so that what is made of them stays small on both sides."""
    for batch in batches:
        for first, last, _, _ in slices(batch.column(column)):
            yield batch.slice(first, last - first)


class Words:
    """Words of several texts: byte bounds, and the number of each text's first word (`bounds`, one more than texts)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool):
        self.raw, self.offsets = (LOWER[raw] if lower else raw), offsets
        solid = ~SPACE[raw]
        begins, after = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        after[:-1] &= ~solid[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        begins[inner] = solid[inner]  # a text's first byte continues no word of the text before
        after[inner - 1] = solid[inner - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(after) + 1
        self.bounds = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return stretch(running(BYTE_VALUE[self.raw]), self.start, self.end)

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of `width` words that lies in one text, and the number of its first word."""
        n = len(self)
        if n < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        sums = running(hashes)
        at = np.arange(n - width + 1)
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        at = at[text[: n - width + 1] == text[width - 1:]]
        return stretch(sums, at, at + width), at


def per_text(offsets: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """How many marks each text has; marks: a number per byte."""
    sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]
