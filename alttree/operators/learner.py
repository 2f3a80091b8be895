"""Split search: histograms, cumulative statistics, candidate splits and their exact re-scoring."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alttree.functions.arrays import constant
from alttree.functions.exprs import EPS, boost_loss, class_sums, safe_log_ratio
from alttree.operators.scoring import feature_block, layout
from alttree.operators.state import node_totals
from alttree.schema import Candidate, Node
from alttree.sources.store import settle

LossFn = Callable[[Column, Column, Column], Column]

# Order among equal losses: lower parent, feature, threshold; "at most" before "above".
TIE_ORDER = ["parent_id", "feature", "threshold", "side"]
SCORE_DIGITS = 8


def split_histogram(state: DataFrame) -> DataFrame:
    """Class weights and counts per (node, feature, slot).

    Dense rows give a record per occupied slot. One-hot rows give slot 1 only; what is
    not in it is in slot 0 and follows from the node totals.
    """
    per_node = state.withColumn("node_id", F.explode("hits"))
    if layout(state) == "nz":
        cells = per_node.select("y", "w", "node_id", F.explode("nz").alias("feature"), F.lit(1).alias("slot"))
    else:
        cells = per_node.select("y", "w", "node_id", F.posexplode("bins").alias("feature", "slot"))
        cells = cells.withColumn("slot", F.col("slot").cast("int"))
    return cells.groupBy("node_id", "feature", "slot").agg(*class_sums())


def split_histogram_arrow(state: DataFrame, node_ids: list[int], widths: list[int]) -> DataFrame:
    """The same histogram with a partial sum per task built from column batches.

    Worth it for wide rows: a task hands over its summed cells instead of rows x nodes x
    features records. `widths` is the number of slots of every feature.
    """
    onehot = layout(state) == "nz"
    cells_of = "nz" if onehot else "bins"
    first_cell = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
    n_cells, ids = int(first_cell[-1]), np.array(sorted(node_ids))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # per node and cell: weight and count, class by class; the last column takes padding
        weight, count = np.zeros((2, len(ids), n_cells + 1, 2))
        for batch in batches:
            col = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            w, neg = col["w"].to_numpy(), (col["y"].to_numpy() <= 0).astype(np.int64)
            n = len(w)
            flat = col[cells_of].flatten().to_numpy().astype(np.int64)
            sizes = np.diff(col[cells_of].offsets.to_numpy())
            row = np.repeat(np.arange(n), sizes)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keys = np.full((n, max(sizes, default=0)), n_cells, dtype=np.int64)
            keys[row, place] = first_cell[flat] + 1 if onehot else first_cell[place] + flat
            keys = 2 * keys + neg[:, None]
            hits = col["hits"].flatten().to_numpy()
            hit_row = np.repeat(np.arange(n), np.diff(col["hits"].offsets.to_numpy()))
            order = np.argsort(hits, kind="stable")
            ends = np.searchsorted(hits[order], ids, side="right")
            starts = np.searchsorted(hits[order], ids, side="left")
            for k, (lo, hi) in enumerate(zip(starts, ends)):
                rows = hit_row[order[lo:hi]]
                at, size = keys[rows].ravel(), 2 * (n_cells + 1)
                weight[k] += np.bincount(at, np.repeat(w[rows], keys.shape[1]), size).reshape(-1, 2)
                count[k] += np.bincount(at, minlength=size).reshape(-1, 2)
        sums = [a[:, :n_cells, c] for a in (weight, count) for c in (0, 1)]
        node, cell = np.nonzero(sums[2] + sums[3])
        feature = np.searchsorted(first_cell, cell, side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[node], pa.int32()), pa.array(feature, pa.int32()), pa.array(cell - first_cell[feature], pa.int32()),
             *[pa.array(sums[j][node, cell]) for j in range(4)]],
            ["node_id", "feature", "slot", "w_pos", "w_neg", "n_pos", "n_neg"])

    ddl = "node_id int, feature int, slot int, w_pos double, w_neg double, n_pos double, n_neg double"
    parts = state.select("y", "w", "hits", "nz" if onehot else "bins").mapInArrow(partial, ddl)
    return parts.groupBy("node_id", "feature", "slot").agg(
        F.sum("w_pos").alias("w_pos"), F.sum("w_neg").alias("w_neg"),
        F.sum("n_pos").cast("long").alias("n_pos"), F.sum("n_neg").cast("long").alias("n_neg"))


def split_grid(totals: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """Every threshold of every node, with the node's totals: rows = nodes x thresholds."""
    table = constant(
        [{"feature": f, "slot": s, "threshold": t} for f, ts in enumerate(cuts) for s, t in enumerate(ts)],
        "array<struct<feature: int, slot: int, threshold: double>>")
    totals = totals.withColumnsRenamed({c: f"t_{c}" for c in ("w_pos", "w_neg", "w_rej", "n_pos", "n_neg", "n_rej")})
    return totals.select("*", F.inline(table))


def cumulative_slots(hist: DataFrame, totals: DataFrame, cuts: list[list[float]], onehot: bool = False) -> DataFrame:
    """Class weights and counts at or below every threshold.

    A slot without rows still has its threshold, so the histogram joins the grid.
    """
    grid = split_grid(totals, cuts)
    stats = ["w_pos", "w_neg", "n_pos", "n_neg"]
    if onehot:
        # slot 0 = node total - slot 1; rounding dust must not turn negative
        ones = hist.where("slot = 1").select("node_id", "feature", *[F.col(s).alias(f"_{s}") for s in stats])
        joined = grid.join(ones, ["node_id", "feature"], "left")
        return joined.withColumns({
            s: F.greatest(F.col(f"t_{s}") - F.coalesce(f"_{s}", F.lit(0)), F.lit(0)) for s in stats
        }).drop(*[f"_{s}" for s in stats])
    joined = grid.join(hist, ["node_id", "feature", "slot"], "left")
    # at most 2 num_slices records per (node, feature)
    upto = Window.partitionBy("node_id", "feature").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumns({s: F.sum(F.coalesce(s, F.lit(0))).over(upto) for s in stats})


def split_scores(cumulative: DataFrame, loss: LossFn = boost_loss, compat_left_reject: bool = False) -> DataFrame:
    """Loss and prediction of both sides of every threshold.

    `compat_left_reject` counts a left split's own rows as rejected too, which only
    shifts the ranking; off by default.
    """
    c = F.col
    inside = c("t_w_pos") + c("t_w_neg")
    outside = c("t_w_rej") + inside
    left_rej = outside if compat_left_reject else outside - c("w_pos") - c("w_neg")

    def clean(x: Column) -> Column:
        return F.greatest(x, F.lit(0.0))

    sides = F.array(
        F.struct(F.lit(0).alias("side"), c("w_pos").alias("pos"), c("w_neg").alias("neg"), clean(left_rej).alias("rej"),
                 c("n_pos").alias("k_pos"), c("n_neg").alias("k_neg")),
        F.struct(F.lit(1).alias("side"), clean(c("t_w_pos") - c("w_pos")).alias("pos"),
                 clean(c("t_w_neg") - c("w_neg")).alias("neg"), clean(c("t_w_rej") + c("w_pos") + c("w_neg")).alias("rej"),
                 (c("t_n_pos") - c("n_pos")).alias("k_pos"), (c("t_n_neg") - c("n_neg")).alias("k_neg")),
    )
    both = cumulative.select(c("node_id").alias("parent_id"), "feature", "threshold", F.inline(sides))
    return both.withColumns({
        "z": loss(c("rej"), c("pos"), c("neg")),
        "pred": 0.5 * safe_log_ratio(c("pos"), c("neg")),
        "split_eval": c("side") == 0,
    }).where(c("z").isNotNull() & ~F.isnan("z"))


def best_per_feature(scored: DataFrame) -> DataFrame:
    """The best split of every (node, feature)."""
    key = F.struct(F.round("z", SCORE_DIGITS).alias("z8"), "threshold", "side", "z", "pred", "split_eval", "pos", "neg", "rej")
    best = scored.groupBy("parent_id", "feature").agg(F.min(key).alias("b"))
    return best.select("parent_id", "feature", "b.*")


def top_k(best: DataFrame, k: int) -> DataFrame:
    """The k best splits overall; k <= 0 takes the best tenth, rounded up."""
    if k <= 0:
        best = settle(best)  # counted and sorted: computed once
        k = math.ceil(0.1 * best.count())
    return best.orderBy(F.round("z", SCORE_DIGITS), *TIE_ORDER).limit(k)


def search(
    state: DataFrame,
    cuts: list[list[float]],
    k: int,
    loss: LossFn = boost_loss,
    compat_left_reject: bool = False,
    features: list[int] | None = None,
    histogram: DataFrame | None = None,
) -> DataFrame:
    """Candidate splits below the nodes in `hits`, searched over the active features."""
    if features is not None:
        wanted = set(features)
        cuts = [c if f in wanted else [] for f, c in enumerate(cuts)]
    hist = split_histogram(state) if histogram is None else histogram
    cumulative = cumulative_slots(hist, node_totals(state), cuts, onehot=layout(state) == "nz")
    return top_k(best_per_feature(split_scores(cumulative, loss, compat_left_reject)), k)


def admission_budget(n_candidates: int, candidate_size: int, admit_size: int) -> int:
    """How many of a batch's candidates to admit: three tenths of them when automatic."""
    return math.ceil(0.3 * n_candidates) if candidate_size <= 0 or admit_size <= 0 else admit_size


def collect_candidates(best: DataFrame) -> list[Candidate]:
    return [Candidate(*r) for r in best.select(*Candidate._fields).collect()]


def candidate_sums(state: DataFrame, candidates: list[Candidate]) -> DataFrame:
    """Class weights and counts of every candidate's members, with the current weights, whatever function made these.

    A task multiplies membership blocks of its rows and candidates by the weights and hands over one record per candidate.
    """
    values = layout(state)
    splits = Splits(candidates, values == "nz")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(candidates), 4))
        for batch in batches:
            col = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            splits.load(col[values], col["hits"])
            splits.add(sums, candidates, class_stats(col["y"].to_numpy(), col["w"].to_numpy()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(candidates)), pa.int32()), *[pa.array(c) for c in sums.T]], ["i", *_CLASS_SUMS])

    ddl = "i int, " + ", ".join(f"{s} double" for s in _CLASS_SUMS)
    parts = state.select("y", "w", "hits", values).mapInArrow(partial, ddl)
    return parts.groupBy("i").agg(
        F.sum("w_pos").alias("w_pos"), F.sum("w_neg").alias("w_neg"),
        F.sum("n_pos").cast("long").alias("n_pos"), F.sum("n_neg").cast("long").alias("n_neg"))


def reevaluate(state: DataFrame, candidates: list[Candidate], loss: LossFn = boost_loss) -> DataFrame:
    """Exact loss and prediction of every candidate under the current weights."""
    spark = state.sparkSession
    listed = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(candidates)],
        "i int, parent_id int, feature int, threshold double, split_eval boolean")
    total = state.agg(F.sum("w")).first()[0]
    sums = listed.join(candidate_sums(state, candidates), "i", "left").fillna(0, ["w_pos", "w_neg", "n_pos", "n_neg"])
    return sums.withColumns({
        "z": loss(F.greatest(F.lit(total) - F.col("w_pos") - F.col("w_neg"), F.lit(0.0)), F.col("w_pos"), F.col("w_neg")),
        "pred": 0.5 * safe_log_ratio(F.col("w_pos"), F.col("w_neg")),
        "side": F.when(F.col("split_eval"), 0).otherwise(1),
    })


def best_candidate(scored: DataFrame) -> DataFrame:
    return scored.where("z is not null").orderBy(F.round("z", SCORE_DIGITS), *TIE_ORDER).limit(1)


# Parts of an admission pass: what a record's `part` and `i` say.
LOSS_PART, CANDIDATE_PART = 0, 1
_CLASS_SUMS = ["w_pos", "w_neg", "n_pos", "n_neg"]
_STATS = [*_CLASS_SUMS, "sq_pos", "sq_neg"]
# Candidates whose memberships a task holds at a time, beside a column batch of rows.
CANDIDATE_BLOCK = 256


def class_stats(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weight and count of every row in the columns of its class."""
    pos = (y > 0).astype(float)
    return np.stack([w * pos, w * (1.0 - pos), pos, 1.0 - pos], axis=1)


class Splits:
    """Which rows of a column batch pass a list of splits below their parents."""

    def __init__(self, splits: list, onehot: bool):
        self.onehot = onehot
        self.used = np.array(sorted({t.feature for t in splits}), dtype=np.int64)
        self.parents = sorted({t.parent_id for t in splits})

    def load(self, values: pa.Array, hits: pa.Array) -> None:
        self.block = feature_block(values, self.used, self.onehot)
        ids = hits.flatten().to_numpy()
        row = np.repeat(np.arange(len(hits)), np.diff(hits.offsets.to_numpy()))
        self.member = {}
        for p in self.parents:
            self.member[p] = np.zeros(len(hits), bool)
            self.member[p][row[ids == p]] = True

    def passing(self, t) -> np.ndarray:
        value = self.block[:, np.searchsorted(self.used, t.feature)]
        return self.member[t.parent_id] & (~(value - t.threshold > EPS) == t.split_eval)

    def add(self, sums: np.ndarray, candidates: list[Candidate], stats: np.ndarray) -> None:
        """Add the statistics of every candidate's members to its row of `sums`, by blocks of candidates."""
        for at in range(0, len(candidates), CANDIDATE_BLOCK):
            members = np.stack([self.passing(c) for c in candidates[at:at + CANDIDATE_BLOCK]]).astype(float)
            sums[at:at + CANDIDATE_BLOCK] += members @ stats

    def gained(self, nodes: list[Node], n: int) -> np.ndarray:
        total = np.zeros(n)
        for t in nodes:
            total += self.passing(t) * t.pred
        return total


def admission_pass(state: DataFrame, new_nodes: list[Node], candidates: list[Candidate]) -> DataFrame:
    """Everything one admission needs, from a single pass over the state.

    The nodes admitted since the state was built are applied on the fly (AdaBoost
    weights), then the pass sums, per task and overall: the weights, squared weights and
    counts by class of training rows (part 0, i = 0) and held-out rows (part 0, i = 1),
    and the same sums over every candidate's training members (part 1, i = candidate).
    """
    onehot = layout(state) == "nz"
    values = "nz" if onehot else "features"
    splits = Splits([*new_nodes, *candidates], onehot)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        losses, sums = np.zeros((2, 6)), np.zeros((len(candidates), 6))
        for batch in batches:
            col = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            y, w = col["y"].to_numpy(), col["w"].to_numpy()
            train = col["is_train"].to_numpy(zero_copy_only=False)
            splits.load(col[values], col["hits"])
            w = w * np.exp(-y * splits.gained(new_nodes, len(y)))
            stats = class_stats(y, w)
            stats = np.concatenate([stats, stats[:, :2] ** 2], axis=1)
            losses[0] += stats[train].sum(axis=0)
            losses[1] += stats[~train].sum(axis=0)
            splits.add(sums, candidates, stats * train[:, None])
        rows = [(LOSS_PART, i, *losses[i]) for i in (0, 1)] + [(CANDIDATE_PART, i, *s) for i, s in enumerate(sums)]
        part, index, *stats = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(index, pa.int32()), *[pa.array(s, pa.float64()) for s in stats]],
            ["part", "i", *_STATS])

    ddl = "part int, i int, " + ", ".join(f"{s} double" for s in _STATS)
    parts = state.select("y", "w", "is_train", "hits", values).mapInArrow(partial, ddl)
    return parts.groupBy("part", "i").agg(*[F.sum(s).alias(s) for s in _STATS])


def current_scores(state: DataFrame, new_nodes: list[Node]) -> DataFrame:
    """is_train, y and the score since the last resample, with `new_nodes` applied on the fly."""
    score = F.col("delta")
    if new_nodes:
        onehot = layout(state) == "nz"
        splits = Splits(new_nodes, onehot)

        @F.arrow_udf("double")
        def gained(values: pa.Array, hits: pa.Array) -> pa.Array:
            splits.load(values, hits)
            return pa.array(splits.gained(new_nodes, len(hits)))

        score = score + gained(F.col("nz" if onehot else "features"), F.col("hits"))
    return state.select("is_train", "y", score.alias("score"))
