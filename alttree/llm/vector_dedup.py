"""Near duplicates among embeddings, by passes of random cells, which stand in for sorted passes with bounded windows (README).

A pass hashes each vector to the signs of its projections on a few random directions; vectors with the same signs are a
cell, and all of a cell are compared with all, tile by tile inside tasks. Pairs with a cosine of `least` or more are
links, and those of all passes are united to components. Two vectors at an angle t share a cell of k signs with
probability (1 - t / pi)^k, whatever else is in the table. k is taken from the number of vectors, so that a cell holds
about `cell` unrelated ones, and the number of passes so that a pair at exactly `least` shares a cell in some pass with
probability `recall`. Both grow slowly: 14 passes for 20 thousand vectors, 35 for a million, 68 for ten million.

Within a component all vectors are then compared with all in the same way, which gives each vector's number of links. A
link can only be missed where no pass connects its two components (recall is measured in the tests).

Vectors that are null, zero, or hold a null or non-finite number link with nothing, as do vectors of another length.
Equal vectors are one point with a count. Rows are counted one by one, repeated ids too; labels and other columns are
not read. Cosines are computed in double precision from the numbers as stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alttree.llm.graph import components
from alttree.llm.jaccard import runs
from alttree.llm.tables import keep, partitions, read


@dataclass(frozen=True)
class Params:
    least: float = 0.9
    recall: float = 0.999
    cell: int = 512
    tile: int = 512
    cell_tile: int = 2048
    seed: int = 11

    def shape(self, n: int) -> tuple[int, int]:
        """(signs, passes) for n vectors."""
        signs = max(0, int(np.ceil(np.log2(max(n, 1) / self.cell))))
        share = (1 - np.arccos(self.least) / np.pi) ** signs
        return signs, 1 if signs == 0 else int(np.ceil(np.log(1 - self.recall) / np.log(1 - share)))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)  # first, so that squares neither overflow nor vanish
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def points(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(point, vector, times) of each different usable vector; point is its smallest row number. Written once."""
    v = F.col(vector)
    size = F.size(v)
    usable = v.isNotNull() & (size > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select("row_id", v.alias("vector")).where(usable).groupBy("vector").agg(F.min("row_id").alias("point"), F.count("*").alias("times"))


def _hashed(p: Params, signs: int, passes: int):
    """The cell of every vector in each pass; vectors of another length are in another lane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(signs, dtype=np.int64)
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                if size not in planes:
                    planes[size] = np.random.default_rng([p.seed, int(size)]).normal(size=(size, passes * signs))
                bits = _unit(_matrix(part.column("vector"), size)) @ planes[size] > 0
                cells = bits.reshape(len(part), passes, signs) @ weights
                for k in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), int(size) * passes + k, np.int64)), pa.array(cells[:, k]), part.column("point")],
                        ["lane", "cell", "point"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal values in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        marks = np.stack([batch.column(c).to_numpy() for c in by], 1).astype(np.int64)
        edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1), len(batch)]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if held and not (marks[s] == last).all():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = marks[s]
    if held:
        yield pa.Table.from_batches(held)


def _forest(unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (first row, other row) that connect the same rows as all links among them do."""
    n = len(unit)
    link = np.empty((n, n), bool)
    for s in range(0, n, 512):
        link[s:s + 512] = unit[s:s + 512] @ unit.T >= least
    np.fill_diagonal(link, False)
    todo = link.any(1)
    a, b = [], []
    for root in np.flatnonzero(todo):
        if not todo[root]:
            continue
        todo[root], front = False, np.array([root])
        while len(front):
            front = np.flatnonzero(link[front].any(0) & todo)
            todo[front] = False
            a.append(np.full(len(front), root))
            b.append(front)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _linked(p: Params):
    """Links of the cells, or pairs of tiles of large cells, as a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _runs(batches, ["lane", "cell", "i", "j"]):
            vectors = r.column("vector").combine_chunks()
            ids = r.column("point").to_numpy()
            a, b = _forest(_unit(_matrix(vectors, len(vectors[0]))), p.least)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], ["a", "b"])

    return run


def cell_links(found: DataFrame, p: Params) -> DataFrame:
    """(a, b) of links inside some pass's cells, as many as connect what all of them do. found: point, vector."""
    signs, passes = p.shape(found.count())
    placed = keep(found.select("point", "vector").mapInArrow(_hashed(p, signs, passes), "lane long, cell long, point long"), "cells")
    size = placed.groupBy("lane", "cell").agg(F.count("*").alias("c")).where("c > 1").select(
        "lane", "cell", F.ceil(F.col("c") / p.cell_tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("point", "lane"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    place = ["lane", "cell", "i", "j"]
    tiled = placed.join(size, ["lane", "cell"]).withColumn("own", own).withColumn("pair", F.explode(pairs)).select(
        "lane", "cell", "pair.i", "pair.j", "point").join(found.select("point", "vector"), "point")
    tiled = tiled.select(*place, "point", "vector").repartition(partitions(found.sparkSession), *place).sortWithinPartitions(*place)
    return tiled.mapInArrow(_linked(p), "a long, b long")


def _counts(p: Params):
    """Links that a vector of a pair of tiles has in the other tile, or in its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in runs(batches, ["component", "i", "j"]):
            unit = _unit(np.array(r["vector"], float))
            own, times = np.array(r["own"]), np.array(r["times"])
            link = unit @ unit.T >= p.least
            np.fill_diagonal(link, False)
            if r["i"][0] != r["j"][0]:
                link &= own[:, None] != own[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(r["point"], pa.int64()), pa.array(link @ times, pa.int64())], ["point", "n"])

    return run


def near_duplicates(rows: DataFrame, id_column: str, vector: str, p: Params = Params()) -> DataFrame:
    """(id, n_links, component_id, kept) of each row; component_id is the smallest id that links reach."""
    kept = keep(rows.select(F.monotonically_increasing_id().alias("row_id"), id_column, vector), "vectors")
    found = keep(points(kept, id_column, vector), "points")
    groups = components(cell_links(found, p))
    members = found.join(groups, F.col("point") == F.col("node")).select("component", "point", "times", "vector")
    size = members.groupBy("component").agg(F.ceil(F.count("*") / p.tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("point"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    place = ["component", "i", "j"]
    tiled = members.join(size, "component").withColumn("own", own).withColumn("pair", F.explode(pairs)).select(
        "component", "pair.i", "pair.j", "own", "point", "times", "vector")
    tiled = tiled.repartition(partitions(rows.sparkSession), *place).sortWithinPartitions(*place)
    counts = tiled.mapInArrow(_counts(p), "point long, n long").groupBy("point").agg(F.sum("n").alias("others"))

    labelled = found.join(groups, F.col("point") == F.col("node"), "left").select("vector", "point", "times", F.coalesce("component", "point").alias("group"))
    of_point = labelled.join(counts, "point", "left").select(
        F.col("vector").alias("_v"), "group", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("links"))
    each = keep(kept.select(id_column, F.col(vector).alias("_w")).join(of_point, F.col("_w") == F.col("_v"), "left").select(
        id_column, "group", "links"), "each")
    least = each.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(id_column).alias("least"))
    component = F.coalesce("least", F.col(id_column))
    return each.join(least, "group", "left").select(
        id_column, F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col(id_column), F.lit(True)).alias("kept"))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
