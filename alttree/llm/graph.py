"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alttree.llm.tables import forget, keep

FLUSH = 500_000


class Unions:
    """Union-find over numbers; the smallest of a set is its root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (p := self.parent.get(top, top)) != top:
            top = p
        while x != top:
            x, self.parent[x] = self.parent[x], top
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer links with the same connections: one to its root for each node of a partition (of FLUSH nodes at a time)."""
    unions = Unions()

    def out() -> pa.RecordBatch:
        nodes = list(unions.parent)
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([unions.root(x) for x in nodes], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            unions.join(a, b)
        if len(unions.parent) > FLUSH:
            yield out()
            unions = Unions()
    yield out()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b: long); component is the smallest node connected.

    Each round every node points at its smallest neighbour, pointers are followed once more, and the links between the
    resulting groups are the next round's table, which shrinks by half at least.
    """
    labels, rest = None, links.select("a", "b").where(F.col("a") != F.col("b"))
    while True:
        rest = keep(rest.mapInArrow(_forest, "a long, b long"), "links")
        if rest.isEmpty():
            break
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p")), "parent")
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        step = keep(parent.join(up, "p").select(F.col("a").alias("v"), F.col("pp").alias("to")), "step")
        old = labels
        if labels is None:
            labels = step.select(F.col("v").alias("node"), F.col("to").alias("component"))
        else:
            moved = labels.join(step, F.col("component") == F.col("v"), "left")
            labels = keep(moved.select("node", F.coalesce("to", "component").alias("component")), "labels")
        if old is not None and hasattr(old, "kept_at"):
            forget(old)
        near = rest.join(step, F.col("a") == F.col("v")).select(F.col("to").alias("x"), "b")
        rest = near.join(step, F.col("b") == F.col("v")).select(F.col("x").alias("a"), F.col("to").alias("b")).where("a != b").distinct()
    if labels is None:
        return links.sparkSession.createDataFrame([], "node long, component long")
    return labels


def by_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)
