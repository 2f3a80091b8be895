"""Schemas of the tables the engine reads and writes, and the in-memory node record."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

# Labelled rows come in two layouts: dense (`features`) and one-hot (`nz`, ids of the ones).
DENSE_ROWS = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("features", T.ArrayType(T.DoubleType())),
])
ONEHOT_ROWS = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("nz", T.ArrayType(T.IntegerType())),
])
NODES = T.StructType([
    T.StructField("node_id", T.IntegerType()),
    T.StructField("parent_id", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("split_eval", T.BooleanType()),
    T.StructField("pred", T.DoubleType()),
])
METRICS = [
    f"{part}_{name}"
    for part in ("train", "test", "ref")
    for name in ("auprc", "avg", "avg_pos", "avg_neg")
] + ["effective", "effective_pos", "effective_neg"]

HISTORY = T.StructType(
    [
        T.StructField("iteration", T.IntegerType()),
        T.StructField("batch", T.IntegerType()),
        T.StructField("n_nodes", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("event", T.StringType()),
        T.StructField("n_before", T.IntegerType()),
        T.StructField("n_after", T.IntegerType()),
        T.StructField("weight_change", T.DoubleType()),
    ]
    + [T.StructField(m, T.DoubleType()) for m in METRICS]
)
PR_POINTS = T.StructType([
    T.StructField("iteration", T.IntegerType()),
    T.StructField("n_nodes", T.IntegerType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
])


class Node(NamedTuple):
    """One rule of the tree. The root has feature -1 and parent -1."""

    node_id: int
    parent_id: int
    depth: int
    feature: int
    threshold: float
    split_eval: bool
    pred: float


class Candidate(NamedTuple):
    """A split that may be attached below `parent_id`."""

    parent_id: int
    feature: int
    threshold: float
    split_eval: bool


def nodes_from_rows(rows: list[Row]) -> list[Node]:
    return sorted(Node(*(r[c] for c in Node._fields)) for r in rows)


def collect_nodes(nodes: DataFrame) -> list[Node]:
    """Bring a trained model to the driver; a model has a few thousand rows at most."""
    return nodes_from_rows(nodes.select(*Node._fields).collect())


def nodes_df(spark: SparkSession, nodes: list[Node]) -> DataFrame:
    return spark.createDataFrame([tuple(n) for n in nodes], NODES)
