"""Additive path scoring of an alternating decision tree.

A node fires on a row when its own test and the tests of all its ancestors hold; the
score is the sum of the predictions of the nodes that fire, siblings included.

`score` runs an Arrow function over column batches and suits any model size.
`score_expression` is a plain Column for small models, and `score_relational` works
on long-form values with joins and aggregation only.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alttree.functions.arrays import constant, value_of
from alttree.functions.exprs import EPS, check
from alttree.schema import Node

if TYPE_CHECKING:
    from collections.abc import Callable


def prefix_model(nodes: list[Node], n: int | None) -> list[Node]:
    """The first n nodes; the whole model when n is missing or negative."""
    return nodes if n is None or n < 0 else [t for t in nodes if t.node_id < n]


def layout(rows: DataFrame) -> str:
    return "nz" if "nz" in rows.columns else "features"


def feature_block(column: pa.Array, used: np.ndarray, onehot: bool) -> np.ndarray:
    """Values of the features in `used`, one matrix row per table row."""
    n = len(column)
    flat = column.flatten().fill_null(0).to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if onehot:
        block = np.zeros((n, len(used)))
        row = np.repeat(np.arange(n), sizes)
        place = np.searchsorted(used, flat)
        hit = (place < len(used)) & (used[np.minimum(place, len(used) - 1)] == flat) if len(used) else np.zeros(len(flat), bool)
        block[row[hit], place[hit]] = 1.0
        return block
    if n == 0 or not len(used):
        return np.zeros((n, len(used)))
    width = sizes[0]
    if (sizes == width).all() and used[-1] < width:
        return flat.reshape(n, width)[:, used]
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    block = np.zeros((n, len(used)))
    for k, f in enumerate(used):
        present = sizes > f
        block[present, k] = flat[start[present] + f]
    return block


def firing(block: np.ndarray, used: np.ndarray, nodes: list[Node]) -> list[np.ndarray]:
    """For every node, in id order, which rows it fires on."""
    fired: dict[int, np.ndarray] = {}
    for t in nodes:
        if t.feature < 0:
            passed = np.ones(len(block), bool)
        else:
            value = block[:, np.searchsorted(used, t.feature)]
            passed = ~(value - t.threshold > EPS) == t.split_eval
        fired[t.node_id] = passed & fired[t.parent_id] if t.parent_id >= 0 else passed
    return [fired[t.node_id] for t in nodes]


def used_features(nodes: list[Node]) -> np.ndarray:
    return np.array(sorted({t.feature for t in nodes if t.feature >= 0}), dtype=np.int64)


def _arrow_column(rows: DataFrame, nodes: list[Node], result: str, make: Callable) -> Column:
    """Column computed by `make(fired, nodes)` on every Arrow batch of the feature column."""
    name = layout(rows)
    onehot = name == "nz"
    used = used_features(nodes)

    @F.arrow_udf(result)
    def kernel(column: pa.Array) -> pa.Array:
        return make(firing(feature_block(column, used, onehot), used, nodes), nodes, len(column))

    return kernel(F.col(name))


def _sum_scores(fired, nodes, n, first=0) -> np.ndarray:
    total = np.zeros(n)
    for t, hit in zip(nodes, fired):
        if t.node_id >= first:
            total += hit * t.pred
    return total


def score_column(rows: DataFrame, nodes: list[Node]) -> Column:
    return _arrow_column(rows, nodes, "double", lambda fired, ns, n: pa.array(_sum_scores(fired, ns, n)))


def score(rows: DataFrame, nodes: list[Node], max_nodes: int | None = None, name: str = "score") -> DataFrame:
    """Add the score of the model, or of its first `max_nodes` nodes (0 nodes score 0)."""
    kept = prefix_model(nodes, max_nodes)
    if not kept:
        return rows.withColumn(name, F.lit(0.0))
    return rows.withColumn(name, score_column(rows, kept))


def score_delta(rows: DataFrame, nodes: list[Node], last_resample: int) -> DataFrame:
    """Add `score`, `prefix_score` (nodes before the last resample) and `delta`, in one pass."""

    def both(fired, ns, n):
        total = _sum_scores(fired, ns, n)
        since = _sum_scores(fired, ns, n, last_resample)
        return pa.StructArray.from_arrays([pa.array(total), pa.array(total - since), pa.array(since)],
                                          ["score", "prefix_score", "delta"])

    ddl = "struct<score: double, prefix_score: double, delta: double>"
    scored = rows.withColumn("_s", _arrow_column(rows, nodes, ddl, both))
    return scored.select(*rows.columns, "_s.score", "_s.prefix_score", "_s.delta")


def membership(rows: DataFrame, nodes: list[Node], keep: list[int], last_resample: int = 0, recent: bool = False) -> DataFrame:
    """Add `hits`, the ids in `keep` that fire on the row, `delta` and, if asked for, `recent`: all firing ids since the resample."""
    wanted = set(keep)

    def lists(fired, ns, n, ids):
        picked = [(t.node_id, hit) for t, hit in zip(ns, fired) if t.node_id in ids]
        matrix = np.array([hit for _, hit in picked]).T if picked else np.zeros((n, 0), bool)
        ids_of = np.array([i for i, _ in picked], dtype=np.int32)
        _, col = np.nonzero(matrix)
        offsets = np.concatenate([[0], np.cumsum(matrix.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids_of[col], type=pa.int32()))

    def make(fired, ns, n):
        found = [lists(fired, ns, n, wanted), pa.array(_sum_scores(fired, ns, n, last_resample))]
        if recent:
            found.append(lists(fired, ns, n, {t.node_id for t in ns if t.node_id >= last_resample}))
        return pa.StructArray.from_arrays(found, names)

    names = ["hits", "delta", "recent"][:3 if recent else 2]
    ddl = "struct<hits: array<int>, delta: double" + (", recent: array<int>>" if recent else ">")
    out = rows.withColumn("_m", _arrow_column(rows, nodes, ddl, make))
    return out.select(*rows.columns, *[f"_m.{c}" for c in names])


def staged_scores(rows: DataFrame, nodes: list[Node]) -> DataFrame:
    """Score after every node: one record per (row, node_id)."""

    def make(fired, ns, n):
        steps = np.array([hit * t.pred for t, hit in zip(ns, fired)]).T
        flat = np.cumsum(steps, axis=1).ravel()
        offsets = (np.arange(n + 1) * len(ns)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    ids = constant([t.node_id for t in nodes], "array<int>")
    kept = [c for c in rows.columns if c not in ("features", "nz")]
    staged = rows.withColumn("_s", _arrow_column(rows, nodes, "array<double>", make))
    # outer: a plain explode would evaluate the Arrow function again to look for empty lists
    return staged.select(*kept, F.posexplode_outer("_s").alias("_i", "score")).withColumn(
        "node_id", F.get(ids, F.col("_i"))).drop("_i")


def score_expression(rows: DataFrame, nodes: list[Node]) -> Column:
    """The score as one JVM expression; meant for models below about 50 nodes."""
    passed: dict[int, Column] = {}
    total = F.lit(0.0)
    for t in nodes:
        own = check(value_of(rows.columns, t.feature), t.feature, t.threshold, t.split_eval)
        passed[t.node_id] = own & passed[t.parent_id] if t.parent_id >= 0 else own
        total = total + F.when(passed[t.node_id], t.pred).otherwise(0.0)
    return total


def paths(nodes: list[Node]) -> list[tuple[int, int, float, bool]]:
    """(node_id, feature, threshold, split_eval) of every test on the way to every node."""
    by_id = {t.node_id: t for t in nodes}
    out = []
    for t in nodes:
        step = t
        while step is not None and step.feature >= 0:
            out.append((t.node_id, step.feature, step.threshold, step.split_eval))
            step = by_id.get(step.parent_id)
    return out


def score_relational(long: DataFrame, nodes: list[Node]) -> DataFrame:
    """Scores from long-form values holding every feature the model uses.

    A node is lost to a row when any test on its path fails; the score is the sum over
    the nodes that are not lost. Each value meets the tests of its own feature only.
    """
    spark = long.sparkSession
    tests: dict[int, list] = {}
    for node_id, feature, threshold, split_eval in paths(nodes):
        tests.setdefault(feature, []).append((node_id, threshold, split_eval))
    by_feature = spark.createDataFrame(
        sorted(tests.items()), "feature int, tests array<struct<node_id: int, threshold: double, split_eval: boolean>>")
    by_id = {t.node_id: t.pred for t in nodes}
    preds = constant([by_id.get(k, 0.0) for k in range(max(by_id) + 1)], "array<double>")
    everything = float(sum(t.pred for t in nodes))
    # one record per feature of the model: bounded by the model
    joined = long.join(F.broadcast(by_feature), "feature", "left")
    broken = F.filter("tests", lambda t: ~check(F.col("value"), F.col("feature"), t["threshold"], t["split_eval"]))
    lost = joined.select("row_id", F.explode_outer(F.transform(broken, lambda t: t["node_id"])).alias("node_id"))
    per_row = lost.groupBy("row_id").agg(F.collect_set("node_id").alias("lost"))
    missed = F.aggregate("lost", F.lit(0.0), lambda acc, i: acc + F.get(preds, i))
    return per_row.select("row_id", (F.lit(everything) - missed).alias("score"))
