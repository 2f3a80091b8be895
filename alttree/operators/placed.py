"""Rows numbered and drawn where they are read, without moving one.

The rows of a table of files have an order: file path, start of the input split, place in the split. A first pass
leaves a record per split (rows, class weights); running totals over these records tell where each split starts. A
second pass walks every split in order with its start and works out each row's number, or how often it is drawn. Only
narrow columns meet Python; the wide ones stay in the scan, and only drawn rows go on.

Splits are told apart by `_metadata`, so the results depend neither on how splits are dealt to tasks nor on retries.
The driver holds one record per split, of which it has planned the tasks anyway.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alttree.functions.exprs import is_pos
from alttree.sources.store import settle_files

FILE, BLOCK = "_file", "_block"
PLACE = [FILE, BLOCK]


def read_in_order(rows: DataFrame) -> bool:
    """Is the table nothing but columns and filters over files? Then every task sees whole splits in order."""
    node = rows._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and "HadoopFsRelation" in node.relation().getClass().getName()


def located(rows: DataFrame) -> DataFrame:
    """Rows with `_file` and `_block`, the split each is read from. A table that is not read straight from files is written once."""
    if set(PLACE) <= set(rows.columns):
        return rows
    files = rows if read_in_order(rows) else settle_files(rows)
    return files.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK))


class Split(NamedTuple):
    """A split's rows and class weights; as a start, what all splits before it hold."""

    n_pos: int
    n_neg: int
    w_pos: float
    w_neg: float


def runs(files: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[tuple, slice]]:
    """Stretches of a batch that are read from one split."""
    if not len(files):
        return
    cut = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    bounds = [0, *cut.tolist(), len(files)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield (int(files[a]), int(blocks[a])), slice(a, b)


def added(start: float, weights: np.ndarray) -> np.ndarray:
    """Running sum that goes on from `start`, in the order of the rows: the last one is the next batch's start, bit for bit."""
    return np.cumsum(np.concatenate([[start], weights]))


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple, list] = {}
    for batch in batches:
        pos, w = numbers(batch.column("pos")), numbers(batch.column("w"))
        for key, at in runs(numbers(batch.column("key")), numbers(batch.column(BLOCK))):
            s = found.get(key)
            if s is None:
                s = found[key] = [batch.column(FILE)[at.start].as_py(), 0, 0, 0.0, 0.0]
            hit = pos[at]
            s[1] += int(hit.sum())
            s[2] += int(len(hit) - hit.sum())
            s[3] = added(s[3], np.where(hit, w[at], 0.0))[-1]
            s[4] = added(s[4], np.where(hit, 0.0, w[at]))[-1]
    rows = [(*k, *v) for k, v in found.items()]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", BLOCK, FILE, *Split._fields])


class Starts(NamedTuple):
    """What lies before each split, by (hash of the file, start of the split), and in all."""

    before: dict[tuple, Split]
    total: Split


def starts(rows: DataFrame, weight: Column | None = None, pos: Column | None = None) -> Starts:
    """Running totals over the splits of `located` rows: in one narrow pass, class sizes and weights."""
    narrow = rows.select(
        F.xxhash64(FILE).alias("key"), BLOCK, FILE, (is_pos() if pos is None else pos).alias("pos"),
        (F.lit(1.0) if weight is None else weight).cast("double").alias("w"))
    found = narrow.mapInArrow(_measured, f"key long, {BLOCK} long, {FILE} string, n_pos long, n_neg long, w_pos double, w_neg double").collect()
    before, total = {}, Split(0, 0, 0.0, 0.0)
    for r in sorted(found, key=lambda r: (r[FILE], r[BLOCK])):
        if (r["key"], r[BLOCK]) in before:
            raise ValueError("a split was read by two tasks, or two file paths have one hash")
        before[r["key"], r[BLOCK]] = total
        total = Split(*(a + r[c] for a, c in zip(total, Split._fields, strict=True)))
    return Starts(before, total)


def _start(known: dict, key: tuple):
    if key not in known:
        raise ValueError("the files, or their splits, are not those that were counted")
    return known[key]


def _walk(known, columns: Iterator[tuple], fresh, step) -> Iterator[pa.Array]:
    """Go through the rows in order; `fresh(start)` makes a split's state, `step(state, values)` gives results and the next state."""
    key, state = None, None
    for files, blocks, *values in columns:
        values = [numbers(v) for v in values]
        out = []
        for here, at in runs(numbers(files), numbers(blocks)):
            if here != key:
                key, state = here, fresh(_start(known.value.before, here))
            got, state = step(state, [v[at] for v in values])
            out.append(got)
        yield pa.concat_arrays(out) if out else pa.array([], pa.int64())


def row_number(rows: DataFrame, name: str = "row_id") -> DataFrame:
    """Number `located` rows 0, 1, 2 ... in their order; the same whatever the splits and the tasks."""
    counted = rows.select(FILE, BLOCK).groupBy(FILE, BLOCK).agg(F.count("*").alias("n"), F.first(F.xxhash64(FILE)).alias("key"))
    before, total = {}, 0
    for r in sorted(counted.collect(), key=lambda r: (r[FILE], r[BLOCK])):
        before[r["key"], r[BLOCK]] = total
        total += r["n"]
    known = rows.sparkSession.sparkContext.broadcast(Starts(before, None))

    @F.arrow_udf("long")
    def number(columns: Iterator[Tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:  # noqa: UP006
        def step(n, values):
            return pa.array(np.arange(n, n + len(values[0]))), n + len(values[0])

        return _walk(known, ((f, b, b) for f, b in columns), int, step)

    return rows.withColumn(name, number.asNondeterministic()(F.xxhash64(FILE), F.col(BLOCK)))


def draws(rows: DataFrame, weight: Column, found: Starts, pos_scale: float, neg_scale: float, segment: float, offset: float) -> DataFrame:
    """Add `copies`: how many of the draws offset, offset + segment ... fall into the row's stretch of the running scaled weight.

    A row's stretch begins at exactly the number where the one before it ends, across splits too, so no draw is lost or doubled.
    """
    known = rows.sparkSession.sparkContext.broadcast(found)

    @F.arrow_udf("long")
    def copies(columns: Iterator[Tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:  # noqa: UP006
        def fresh(start: Split):
            return start, 0.0, 0.0

        def step(state, values):
            start, p, n = state
            pos, w = values
            upto_p, upto_n = added(p, np.where(pos, w, 0.0)), added(n, np.where(pos, 0.0, w))
            total = pos_scale * (start.w_pos + upto_p) + neg_scale * (start.w_neg + upto_n)
            drawn = np.diff(np.floor((total - offset) / segment)).astype(np.int64)
            return pa.array(drawn), (start, upto_p[-1], upto_n[-1])

        return _walk(known, columns, fresh, step)

    return rows.withColumn("copies", copies.asNondeterministic()(F.xxhash64(FILE), F.col(BLOCK), is_pos(), weight.cast("double")))


def picked(rows: DataFrame, found: Starts, picks: dict[bool, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Add `draws`: the draws whose number is the row's number within its class.

    picks: for positive and for other rows, sorted numbers and the draw of each; a broadcast whose size the caller has checked.
    """
    known = rows.sparkSession.sparkContext.broadcast(found)
    chosen = rows.sparkSession.sparkContext.broadcast(picks)

    @F.arrow_udf("array<long>")
    def hits(columns: Iterator[Tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:  # noqa: UP006
        def fresh(start: Split):
            return start.n_pos, start.n_neg

        def step(state, values):
            pos = values[0]
            row, draw = [], []
            for label, first in zip((True, False), state, strict=True):
                members = np.flatnonzero(pos == label)
                number, which = chosen.value[label]
                a, b = np.searchsorted(number, [first, first + len(members)])
                row.append(members[number[a:b] - first])
                draw.append(which[a:b])
            row, draw = np.concatenate(row), np.concatenate(draw)
            order = np.argsort(row, kind="stable")
            offsets = np.searchsorted(row[order], np.arange(len(pos) + 1)).astype(np.int32)
            n_pos = int(pos.sum())
            return pa.ListArray.from_arrays(offsets, pa.array(draw[order], pa.int64())), (state[0] + n_pos, state[1] + len(pos) - n_pos)

        return _walk(known, columns, fresh, step)

    return rows.withColumn("draws", hits.asNondeterministic()(F.xxhash64(FILE), F.col(BLOCK), is_pos()))
