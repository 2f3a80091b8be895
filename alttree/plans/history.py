"""Analysis of training histories: stop-rule flags, rollback spans, gap filling, PR snapshots.

A history table may hold many runs; `by` names the run columns. Ordered steps use the
range-wise scan, so one very long run is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alttree.functions.exprs import EPS, compare
from alttree.operators.scan import prefix_scan, range_boundaries
from alttree.sources.store import settle


def number_segments(history: DataFrame, by: list[str], buckets: int | None = None) -> DataFrame:
    """Add `segment`, which grows after every record with an event, and `position` in the run."""
    marked = history.withColumns({
        "_ended": F.when(F.col("event").isNotNull(), 1).otherwise(0).cast("long"), "_one": F.lit(1).cast("long")})
    scans = {"segment": ("sum", "_ended", True), "position": ("sum", "_one", True)}
    return prefix_scan(marked, "iteration", scans, by=by, buckets=buckets).drop("_ended", "_one")


def underfit_flags(segmented: DataFrame, window: int, target: float, by: list[str]) -> DataFrame:
    """Flag iterations whose last `window` train averages improved by too little.

    Input: a history with segments and positions. The record `window - 1` back is found by
    an equi-join on the position and only counts within the same segment.
    """
    oldest = segmented.select(
        *by, "segment", (F.col("position") + window - 1).alias("position"), F.col("train_avg").alias("oldest"))
    gain = F.try_divide(F.col("oldest") - F.col("train_avg"), F.col("oldest"))
    flat = (compare(F.lit(target)) == 0) & (compare(F.col("gain")) <= 0)
    slow = compare(F.col("gain"), F.lit(target)) < 0
    joined = segmented.join(oldest, [*by, "segment", "position"], "left").withColumn("gain", gain)
    return joined.withColumn("underfit", F.col("gain").isNotNull() & (flat | slow))


def overfit_flags(segmented: DataFrame, window: int, by: list[str], buckets: int | None = None) -> DataFrame:
    """Flag iterations that are `window` records into a stretch without a new best test average.

    Input: a history with segments and positions. `since_best` is 1 on a new best; a value
    within the tolerance of the best so far counts as one.
    """
    keys = [*by, "segment"]
    segmented = settle(segmented)
    if buckets is None:
        buckets = int(segmented.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = range_boundaries(segmented, "iteration", buckets)
    best = prefix_scan(segmented, "iteration", {"_best": ("min", "test_avg", True)}, by=keys, boundaries=cuts)
    fresh = F.col("_best").isNull() | (F.col("test_avg") - F.col("_best") <= EPS)
    marked = best.withColumn("_at", F.when(fresh, F.col("position")))
    last = prefix_scan(marked, "iteration", {"_last": ("max", "_at")}, by=keys, boundaries=cuts, once=True)
    return (
        last.withColumn("since_best", F.col("position") - F.col("_last") + 1)
        .withColumn("overfit", F.col("since_best") >= window)
        .drop("_best", "_at", "_last")
    )


def forward_fill(history: DataFrame, metric: str, by: list[str], buckets: int | None = None) -> DataFrame:
    """Replace NaN and missing values of a metric by the last known one.

    A leading gap stays open, as in the source: there is nothing to carry.
    """
    known = history.withColumn("_known", F.when(~F.isnan(metric), F.col(metric)))
    filled = prefix_scan(known, "iteration", {"_filled": ("last", "_known")}, by=by, buckets=buckets)
    return filled.withColumn(metric, F.col("_filled")).drop("_known", "_filled")


def rollback_spans(history: DataFrame) -> DataFrame:
    """From and to on the iteration axis of the nodes every rollback removed."""
    removed = F.col("n_before") - F.col("n_after")
    return history.where("event = 'rollback'").withColumns({
        "span_from": F.col("iteration") - removed, "span_to": F.col("iteration")})


def pr_snapshots(points: DataFrame, areas: DataFrame, every: int = 1000, width: int = 5, node: str = "n_nodes") -> DataFrame:
    """PR points of the models just past a multiple of `every` nodes, beside their area."""
    near = F.col(node) % every < width
    return points.where(near).join(areas.where(near), node)


def metric_schedule(history: DataFrame, ref_every: int = 100, pr_every: int = 1000) -> DataFrame:
    """When the reference set and the PR curve are due; unscheduled reference metrics become null."""
    due = F.col("iteration") % ref_every == 0
    return history.withColumns({
        "ref_due": due, "pr_due": F.col("iteration") % pr_every == 0,
        "ref_auprc": F.when(due, F.col("ref_auprc")),
    })
