"""Bitmaps over 64-bit hashes: which hashes are counted often. Spark counts, tasks look up.

A bitmap has SPARE bits for each hash it marks, so that the share of hashes marked by a clash stays below 1 / SPARE however
large the data, up to a largest size that can still be broadcast. Beyond that it fills up and lets more hashes through.

Hashes travel sorted, cut to `count_bytes` bytes and as differences, packed by range of the hash, and are counted exactly; clashes of shorter hashes and of bits only make a hash look more frequent than it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alttree.llm.tables import forget, keep, partitions

HELD = 1_000_000  # hashes that a task holds before it packs them


def packed(numbers: np.ndarray) -> bytes:
    """Sorted numbers as the first and the differences, in as few bytes each as the largest needs."""
    steps = np.diff(numbers)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + numbers[:1].astype("<u8").tobytes() + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[0])
    full = np.zeros((len(raw) + 1, 8), np.uint8)
    full[0] = np.frombuffer(data, np.uint8, 8, 1)
    full[1:, :data[0]] = raw
    return np.cumsum(full.view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def _packed(hashes: Callable[[pa.Array], Iterator[np.ndarray]], parts_log2: int, count_bytes: int):
    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        t = np.sort(np.concatenate(held) >> np.uint64(64 - 8 * count_bytes))
        cut = np.searchsorted(t >> np.uint64(8 * count_bytes - parts_log2), np.arange(2**parts_log2 + 1))
        rows = [(k, packed(t[a:b])) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["part", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for h in hashes(batch.column("text")):
                held.append(h)
                size += len(h)
                if size > HELD:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return run


SPARE = 20  # bits for each marked hash


def _frequent(leasts: list[int]):
    """A part's hashes that are counted often enough for each bitmap."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        t, n = np.unique(np.concatenate([unpacked(b) for b in f["hashes"]]), return_counts=True)
        often = [t[n >= least] for least in leasts]
        return pd.DataFrame({"part": [f["part"].iloc[0]], "marks": [[packed(x) if len(x) else b"" for x in often]], "sizes": [[len(x) for x in often]]})

    return run


def _stretches(bits: list[int], parts_log2: int, count_bytes: int):
    """A part's stretch of each bitmap."""

    def stretch(data: bytes, size: int) -> bytes:
        marks = np.zeros(1 << size - parts_log2, bool)
        if data:
            marks[(unpacked(data) >> np.uint64(8 * count_bytes - size)).astype(np.int64) & (len(marks) - 1)] = True
        return np.packbits(marks, bitorder="little").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, marks in zip(f["part"], f["marks"], strict=True):
                yield pd.DataFrame({"part": [part], "maps": [[stretch(d, b) for d, b in zip(marks, bits, strict=True)]]})

    return run


def count_bitmaps(
    texts: DataFrame, hashes: Callable[[pa.Array], Iterator[np.ndarray]], leasts: list[int], largest: int = 30, count_bytes: int = 5
) -> list[np.ndarray]:
    """For each of `leasts` the bitmap, at most 2^largest bits, of hashes that occur so often. texts: one column, `text`.

    `hashes` gives the hashes of each text of a column. The driver gets the bitmaps alone, whose size is bounded.
    """
    log2 = min(largest - 3, max(4, (2 * partitions(texts.sparkSession) - 1).bit_length()))
    ranges = texts.mapInArrow(_packed(hashes, log2, count_bytes), "part int, hashes binary")
    often = keep(ranges.groupBy("part").applyInPandas(_frequent(leasts), "part int, marks array<binary>, sizes array<long>"), "frequent")
    marks = often.agg(*[F.sum(F.get("sizes", F.lit(k))).alias(str(k)) for k in range(len(leasts))]).first()
    bits = [max(log2 + 3, min(largest, 8 * count_bytes, (SPARE * (n or 0)).bit_length())) for n in marks]
    out = [np.zeros((1 << log2, 1 << b - log2 - 3), np.uint8) for b in bits]
    for r in often.select("part", "marks").mapInPandas(_stretches(bits, log2, count_bytes), "part int, maps array<binary>").collect():
        for stretches, data in zip(out, r.maps, strict=True):
            stretches[r.part] = np.frombuffer(bytes(data), np.uint8)
    forget(often)
    return [m.ravel() for m in out]


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = len(bitmap).bit_length() + 2
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
