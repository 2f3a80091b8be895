"""Precision-recall, loss averages, effective counts and staged error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alttree.functions.exprs import EPS, is_pos
from alttree.operators.scan import prefix_scan, ranges_for
from alttree.operators.scoring import feature_block, firing, layout, prefix_model, used_features
from alttree.schema import Node
from alttree.sources.store import settle


def score_groups(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows per distinct score: positives and total. Pre-aggregates before anything is ordered."""
    return scored.groupBy(*(by or []), "score").agg(
        F.count_if(is_pos()).alias("tp"), F.count("*").alias("n"))


def _cumulative(scored: DataFrame, by: list[str], buckets: int | None) -> DataFrame:
    """Cumulative counts by falling score. The rows are read once, for the groups."""
    groups = settle(score_groups(scored, by))
    buckets = buckets or ranges_for(groups)
    scans = {"cum_tp": ("sum", "tp"), "cum_n": ("sum", "n")}
    cum = prefix_scan(groups, "score", scans, by=by, descending=True, buckets=buckets)
    if by:
        return cum.join(groups.groupBy(*by).agg(F.sum("tp").alias("p")), by)
    return cum.withColumn("p", F.lit(groups.agg(F.sum("tp")).first()[0]).cast("long"))


def pr_curve(scored: DataFrame, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Recall and precision at every distinct score, best score first (input: score, y)."""
    by = by or []
    return _cumulative(scored, by, buckets).select(
        *by, "score",
        F.try_divide(F.col("cum_tp").cast("double"), F.col("p")).alias("recall"),
        (F.col("cum_tp") / F.col("cum_n")).alias("precision"),
    )


def auprc(scored: DataFrame, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Area under the precision-recall curve by trapezoids, starting at (0, first precision).

    The point before a score follows from the cumulative counts without the score's own
    rows, so no ordered pass over the points is needed.
    """
    by = by or []
    cum = _cumulative(scored, by, buckets)
    precision = F.col("cum_tp") / F.col("cum_n")
    before_n = F.col("cum_n") - F.col("n")
    before = F.when(before_n == 0, precision).otherwise(F.try_divide(F.col("cum_tp") - F.col("tp"), before_n))
    strip = F.try_divide(F.col("tp").cast("double"), F.col("p")) * (precision + before) / 2
    points = cum.withColumn("_strip", strip)
    summed = F.sum("_strip").alias("auprc")
    return points.groupBy(*by).agg(summed) if by else points.agg(summed)


def exp_loss(scored: DataFrame) -> DataFrame:
    """Mean exponential loss, overall and by class, and its sum (input: score, y)."""
    loss = F.exp(-F.col("y") * F.col("score"))
    pos = is_pos()
    return scored.agg(
        F.avg(loss).alias("avg_loss"), F.avg(F.when(pos, loss)).alias("avg_loss_pos"),
        F.avg(F.when(~pos, loss)).alias("avg_loss_neg"), F.sum(loss).alias("sum_loss"))


def _effective(cond: Column | None = None) -> Column:
    w = F.col("w") if cond is None else F.when(cond, F.col("w"))
    return F.try_divide(F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)), F.count(w))


def effective_count(weighted: DataFrame) -> DataFrame:
    """(sum w)^2 / sum w^2 as a share of the rows: overall, positives, negatives (input: w, y)."""
    pos = is_pos()
    return weighted.agg(
        _effective().alias("effective"), _effective(pos).alias("effective_pos"), _effective(~pos).alias("effective_neg"))


def class_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Size and class counts of every dataset in the table."""
    counts = [F.count("*").alias("n_rows"), F.count_if(F.col("y") > 0).alias("n_pos"), F.count_if(F.col("y") < 0).alias("n_neg")]
    return rows.groupBy(*by).agg(*counts) if by else rows.agg(*counts)


def margin_error(scored: DataFrame) -> DataFrame:
    """Share of rows whose margin is not above zero."""
    wrong = (F.col("score") * F.col("y") <= EPS).cast("int")
    return scored.agg(F.sum(wrong).alias("n_wrong"), F.avg(wrong).alias("error_rate"))


_STAGED = ["n_train", "wrong_train", "n_test", "wrong_test", "sum_w", "sum_sq"]


def staged_sums(rows: DataFrame, nodes: list[Node]) -> DataFrame:
    """What `staged_metrics` is made of, summed per task while the rows go by: six numbers per node, no record per row."""
    name = layout(rows)
    onehot, used = name == "nz", used_features(nodes)
    ids = pa.array([t.node_id for t in nodes], pa.int32())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((len(nodes), len(_STAGED))), False
        for batch in batches:
            # a label or a set that is not known counts nowhere
            batch = batch.filter(pc.and_(pc.is_valid(batch.column("y")), pc.is_valid(batch.column("is_train"))))
            seen = seen or batch.num_rows > 0
            y = batch.column("y").to_numpy(zero_copy_only=False)
            train = batch.column("is_train").to_numpy(zero_copy_only=False)
            fired = firing(feature_block(batch.column(name), used, onehot), used, nodes)
            score = np.zeros(len(y))
            for k, (t, hit) in enumerate(zip(nodes, fired)):
                score += hit * t.pred
                margin = score * y
                wrong = margin <= EPS
                w = np.exp(-margin[train])
                sums[k] += (train.sum(), wrong[train].sum(), (~train).sum(), wrong[~train].sum(), w.sum(), w @ w)
        if seen:
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c) for c in sums.T]], ["node_id", *_STAGED])

    ddl = "node_id int, " + ", ".join(f"{c} double" for c in _STAGED)
    parts = rows.select("y", "is_train", name).mapInArrow(partial, ddl)
    return parts.groupBy("node_id").agg(*[F.sum(c).alias(c) for c in _STAGED])


def staged_metrics(rows: DataFrame, nodes: list[Node], max_nodes: int | None = None) -> DataFrame:
    """Train and test error, effective count and weight sum after every node (input has `is_train`).

    Numbers of a set without rows are null; a table without rows gives none.
    """
    sums = staged_sums(rows, prefix_model(nodes, max_nodes))
    return sums.select(
        "node_id", F.try_divide("wrong_train", "n_train").alias("train_error"), F.try_divide("wrong_test", "n_test").alias("test_error"),
        F.try_divide(F.col("sum_w") * F.col("sum_w"), F.col("sum_sq")).alias("effective"),
        F.when(F.col("n_train") > 0, F.col("sum_w")).alias("sum_w"))
