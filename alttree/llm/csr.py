"""Sparse matrices of counts in compressed rows, and their products row by row (Gustavson)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass
class Csr:
    """Row r holds columns `cols[starts[r]:starts[r + 1]]` with `values`; `width` columns in all."""

    starts: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.starts) - 1

    @staticmethod
    def ranges(ends: np.ndarray) -> Csr:
        """Incidence of neighbouring ranges that tile 0..n: row r holds the places of range r; ends: where each ends."""
        n = int(ends[-1]) if len(ends) else 0
        return Csr(np.concatenate([[0], ends]).astype(np.int64), np.arange(n), np.ones(n, np.int64), n)

    @staticmethod
    def one_each(cols: np.ndarray, width: int) -> Csr:
        """Incidence with a single column in each row."""
        return Csr(np.arange(len(cols) + 1), cols, np.ones(len(cols), np.int64), width)

    def transposed(self) -> Csr:
        order = np.argsort(self.cols, kind="stable")
        rows = np.repeat(np.arange(len(self)), np.diff(self.starts))
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.cols, minlength=self.width))])
        return Csr(starts, rows[order], self.values[order], len(self))

    def work(self, other: Csr) -> np.ndarray:
        """For each row of self, the entries of other's rows that it meets: the length of its product row before merging."""
        each = np.diff(other.starts)[self.cols]
        sums = np.concatenate([[0], np.cumsum(each)])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def product(self, other: Csr, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, column, value) of self · other, in order, for runs of rows that meet about `block` entries.

        Row r of the product is the sum of other's rows k, weighed by self[r, k], over the columns k of row r.
        """
        ahead = np.concatenate([[0], np.cumsum(self.work(other))])
        first = 0
        while first < len(self):
            last = max(first + 1, int(np.searchsorted(ahead, ahead[first] + block, "right")) - 1)
            met = slice(self.starts[first], self.starts[last])
            k = self.cols[met]
            sizes = other.starts[k + 1] - other.starts[k]
            row = np.repeat(np.repeat(np.arange(first, last), np.diff(self.starts[first:last + 1])), sizes)
            at = np.arange(len(row)) + np.repeat(other.starts[k] - (np.cumsum(sizes) - sizes), sizes)
            col, value = other.cols[at], np.repeat(self.values[met], sizes) * other.values[at]
            key = row * max(other.width, 1) + col
            if len(key) and (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, row, col, value = key[order], row[order], col[order], value[order]
            if len(key):
                heads = np.flatnonzero(np.diff(key, prepend=-1))
                yield row[heads], col[heads], np.add.reduceat(value, heads)
            first = last
