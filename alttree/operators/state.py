"""Training state: one record per sampled row with its weight and the nodes it belongs to.

Columns: the row itself, `hits` (ids of the nodes that may still get children and fire
on the row), `delta` (score since the last resample) and `w`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alttree.functions.arrays import constant, value_of
from alttree.functions.exprs import adaboost_weight, check, class_sums, logit_weight
from alttree.operators.scoring import membership
from alttree.schema import Node

WeightFn = Callable[[Column, Column, Column], Column]
WEIGHT_FNS: dict[str, WeightFn] = {"adaboost": adaboost_weight, "logit": logit_weight}


def weight_function(weight_fn: str | WeightFn) -> WeightFn:
    return WEIGHT_FNS[weight_fn] if isinstance(weight_fn, str) else weight_fn


def eligible(nodes: list[Node], max_depth: int) -> list[int]:
    """Nodes that may get children."""
    return [t.node_id for t in nodes if t.depth < max_depth]


def rebuild_state(
    rows: DataFrame,
    nodes: list[Node],
    last_resample: int = 0,
    max_depth: int | None = None,
    weight_fn: str | WeightFn = "adaboost",
) -> DataFrame:
    """State of a model from the rows alone, in one row-wise pass.

    Weights start at 1 and only nodes from `last_resample` on change them. Nothing is
    carried from an earlier state, so the lineage never grows.
    """
    keep = [t.node_id for t in nodes] if max_depth is None else eligible(nodes, max_depth)
    if weight_fn == "adaboost":
        return membership(rows, nodes, keep, last_resample).withColumn("w", F.exp(-F.col("y") * F.col("delta")))
    state = membership(rows, nodes, keep, last_resample, recent=True)
    step = weight_function(weight_fn)
    preds = constant([t.pred for t in nodes], "array<double>")
    first = F.lit(1.0)
    w = F.aggregate("recent", first, lambda acc, i: step(F.col("y"), acc, F.get(preds, i)))
    return state.withColumn("w", w).drop("recent")


def member_of(columns: list[str], parent_id: int, feature: int, threshold: float, split_eval: bool) -> Column:
    """Is the row in the parent's set, and does it pass the test?"""
    passed = check(value_of(columns, feature), feature, threshold, split_eval)
    return passed if parent_id < 0 else F.array_contains("hits", F.lit(parent_id)) & passed


def apply_node(state: DataFrame, node: Node, weight_fn: str | WeightFn = "adaboost", track: bool = True) -> DataFrame:
    """Admit a node: its members get the id in `hits` and a new weight."""
    step = weight_function(weight_fn)
    member = F.col("_member")
    out = state.withColumn("_member", member_of(state.columns, *node[1:2], *node[3:6]))
    new = {
        "w": F.when(member, step(F.col("y"), F.col("w"), F.lit(node.pred))).otherwise(F.col("w")),
        "delta": F.col("delta") + F.when(member, node.pred).otherwise(0.0),
    }
    if track:
        new["hits"] = F.when(member, F.concat("hits", F.array(F.lit(node.node_id)))).otherwise(F.col("hits"))
    return out.withColumns(new).drop("_member")


def normalise_weights(state: DataFrame) -> DataFrame:
    """Divide every weight by their sum; the sum is a one-row side."""
    total = state.agg(F.sum("w")).first()[0]
    return state.withColumn("w", F.col("w") / F.lit(total))


def assignments(state: DataFrame) -> DataFrame:
    """Membership as a long table of (row_id, node_id)."""
    return state.select("row_id", F.explode("hits").alias("node_id"))


def node_totals(state: DataFrame) -> DataFrame:
    """Class weights and counts of every node in `hits`, and of the rows outside it.

    The grand totals are one record, which the nodes are joined with; the result stays spread by node.
    """
    per_node = state.select("y", "w", F.explode("hits").alias("node_id")).groupBy("node_id").agg(*class_sums())
    one = F.lit(1).alias("_one")
    whole = state.agg(*class_sums()).select(
        one, (F.col("w_pos") + F.col("w_neg")).alias("_w"), (F.col("n_pos") + F.col("n_neg")).alias("_n"))
    return per_node.select("*", one).join(F.broadcast(whole), "_one").select(
        "node_id", "w_pos", "w_neg", (F.col("_w") - F.col("w_pos") - F.col("w_neg")).alias("w_rej"), "n_pos", "n_neg",
        (F.col("_n") - F.col("n_pos") - F.col("n_neg")).alias("n_rej"))
