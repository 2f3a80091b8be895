"""The sample as column blocks: laid out once, summed at every search without a record per row, node and feature.

Rows carry a dense `place` (`placed.row_number`). ROWS neighbouring places make a row block, `columns` features a column block.
A record of the layout holds the slots of one column block for rows of one row block, column by column; for one-hot
rows, the places and columns of the ones. What changes between searches, weights and memberships, is packed by
row block too, some 15 bytes a row, and joins the layout, which stays where it is (it is kept by row block). A
task holds the sums of the column blocks that it has met, up to `task_cells` of them, and hands them over added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alttree.operators.scoring import layout

ROWS = 4096
COLUMNS = 512
TASK_CELLS = 4_000_000

LAYOUT = "row_block long, column_block int, at binary, cells binary"
STATS = ["w_pos", "w_neg", "n_pos", "n_neg"]


def column_bounds(n_features: int, columns: int) -> np.ndarray:
    return np.array([*range(0, n_features, columns), n_features])


def pieces(places: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Stretches of rows of one row block."""
    block = places // ROWS
    cut = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b > a:
            yield int(block[a]), slice(a, b)


def lay_out(rows: DataFrame, n_features: int, columns: int = COLUMNS) -> DataFrame:
    """(row_block, column_block, at, cells) of binned or one-hot rows with `place`, kept by row block on the executors."""
    onehot = layout(rows) == "nz"
    bounds = column_bounds(n_features, columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, values = batch.column("place").to_numpy(), batch.column("values")
            flat = values.flatten().to_numpy().astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(np.diff(values.offsets.to_numpy()))])
            out: tuple[list, ...] = ([], [], [], [])
            for block, at in pieces(place):
                own = flat[starts[at.start]:starts[at.stop]]
                sizes = np.diff(starts[at.start:at.stop + 1])
                pos = (place[at] % ROWS).astype("<u2")
                if onehot:
                    if len(own) and (own.max() >= n_features or own.min() < 0):
                        raise ValueError(f"a feature id is outside 0..{n_features - 1}")
                    which = np.repeat(pos, sizes)
                    order = np.argsort(own, kind="stable")
                    ends = np.searchsorted(own[order], bounds)
                    parts = [(which[order[a:b]].tobytes(), (own[order[a:b]] - first).astype("<u2").tobytes())
                             for a, b, first in zip(ends[:-1], ends[1:], bounds, strict=False)]
                else:
                    if (sizes != n_features).any():
                        raise ValueError(f"a row does not have {n_features} slots")
                    grid = own.reshape(len(pos), n_features).T.astype("<u2")
                    parts = [(pos.tobytes(), np.ascontiguousarray(grid[a:b]).tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                for k, (where, cells) in enumerate(parts):
                    if cells:
                        for column, value in zip(out, (block, k, where, cells), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                ["row_block", "column_block", "at", "cells"])

    wanted = rows.select("place", F.col("nz" if onehot else "bins").alias("values"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = wanted.mapInArrow(cut, LAYOUT).repartition(parts, "row_block")
    return laid.persist(StorageLevel.MEMORY_AND_DISK)


def packed_state(state: DataFrame) -> DataFrame:
    """(row_block, parts): places, classes, weights and memberships of a row block's rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, hits = batch.column("place").to_numpy(), batch.column("hits")
            y, w, node = batch.column("y").to_numpy(), batch.column("w").to_numpy(), hits.flatten().to_numpy().astype("<i4")
            starts = np.concatenate([[0], np.cumsum(np.diff(hits.offsets.to_numpy()))])
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for block, at in pieces(place):
                own = slice(starts[at.start], starts[at.stop])
                record = (block, (place[at] % ROWS).astype("<u2").tobytes(), (y[at] <= 0).tobytes(), w[at].astype("<f8").tobytes(),
                          np.diff(starts[at.start:at.stop + 1]).astype("<i4").tobytes(), node[own].tobytes())
                for column, value in zip(out, record, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], ["row_block", "at", "neg", "w", "sizes", "nodes"])

    parts = state.select("place", "y", "w", "hits").mapInArrow(pack, "row_block long, at binary, neg binary, w binary, sizes binary, nodes binary")
    # the rows of a block come from the few tasks that read its places
    return parts.groupBy("row_block").agg(F.collect_list(F.struct("at", "neg", "w", "sizes", "nodes")).alias("parts"))


def _unpacked(parts: list[dict], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By place: is the class negative, the weight, and which of the nodes hold the row."""
    neg, w, member = np.zeros(ROWS, np.int64), np.zeros(ROWS), np.zeros((len(ids), ROWS), bool)
    for p in parts:
        at = np.frombuffer(p["at"], "<u2")
        neg[at], w[at] = np.frombuffer(p["neg"], bool), np.frombuffer(p["w"], "<f8")
        row, node = np.repeat(at, np.frombuffer(p["sizes"], "<i4")), np.frombuffer(p["nodes"], "<i4")
        k = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
        here = ids[k] == node
        member[k[here], row[here]] = True
    return neg, w, member


def histogram(blocks: DataFrame, state: DataFrame, node_ids: list[int], widths: list[int], columns: int = COLUMNS, task_cells: int = TASK_CELLS) -> DataFrame:
    """Class weights and counts per (node, feature, slot), as `learner.split_histogram` gives them.

    `widths` is the number of slots of every feature (two for one-hot rows, of which slot 1 is given).
    """
    onehot = layout(state) == "nz"
    ids, bounds = np.array(sorted(node_ids), np.int64), column_bounds(len(widths), columns)
    first = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)

    def out(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        found: list[list[np.ndarray]] = [[] for _ in range(3 + len(STATS))]
        for block, s in sums.items():
            node, cell = np.nonzero(s[1].sum(axis=2))
            feature = np.searchsorted(first, cell + first[bounds[block]], side="right") - 1
            values = [ids[node], feature, cell + first[bounds[block]] - first[feature], *(s[i][node, cell, c] for i in (0, 1) for c in (0, 1))]
            for column, v in zip(found, values, strict=True):
                column.append(v)
        kinds = [pa.int32()] * 3 + [pa.float64()] * 4
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(found, kinds, strict=True)], ["node_id", "feature", "slot", *STATS])

    def add(sums: np.ndarray, block: int, at: np.ndarray, cells: np.ndarray, neg: np.ndarray, w: np.ndarray, member: np.ndarray) -> None:
        lo, hi = bounds[block], bounds[block + 1]
        base = first[lo:hi] - first[lo]
        n = int(first[hi] - first[lo])
        if onehot:
            keys, rows = 2 * (base[cells] + 1) + neg[at], at
        else:
            grid = cells.reshape(hi - lo, len(at)).astype(np.int64)
            keys = 2 * (base[:, None] + grid) + neg[at]
        for k in range(len(ids)):
            inside = np.flatnonzero(member[k, at])
            if not len(inside):
                continue
            if onehot:
                mine, weights = keys[inside], w[rows[inside]]
            else:
                mine, weights = keys[:, inside].ravel(), np.tile(w[at[inside]], hi - lo)
            sums[0, k] += np.bincount(mine, weights, 2 * n).reshape(-1, 2)
            sums[1, k] += np.bincount(mine, minlength=2 * n).reshape(-1, 2)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        held, now, unpacked = 0, None, None
        for batch in batches:
            for k in range(len(batch)):
                block, column = batch.column("row_block")[k].as_py(), batch.column("column_block")[k].as_py()
                if block != now:
                    now, unpacked = block, _unpacked(batch.column("parts")[k].as_py(), ids)
                at = np.frombuffer(batch.column("at")[k].as_buffer(), "<u2")
                cells = np.frombuffer(batch.column("cells")[k].as_buffer(), "<u2")
                if column not in sums:
                    size = int(first[bounds[column + 1]] - first[bounds[column]])
                    if held and held + size * len(ids) > task_cells:
                        yield out(sums)
                        sums, held = {}, 0
                    sums[column] = np.zeros((2, len(ids), size, 2))
                    held += size * len(ids)
                add(sums[column], column, at, cells, *unpacked)
        if sums:
            yield out(sums)

    sums = blocks.join(packed_state(state), "row_block").mapInArrow(partial, "node_id int, feature int, slot int, " + ", ".join(f"{s} double" for s in STATS))
    return sums.groupBy("node_id", "feature", "slot").agg(
        F.sum("w_pos").alias("w_pos"), F.sum("w_neg").alias("w_neg"), F.sum("n_pos").cast("long").alias("n_pos"), F.sum("n_neg").cast("long").alias("n_neg"))
