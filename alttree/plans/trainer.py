"""The training loop: search, admit, monitor, deepen, roll back and resample.

The driver holds the model, a short candidate list and two windows of averages. All
row-sized work is in DataFrames: one search per batch and one pass per admitted node,
which returns the metrics after the last admission and the sums for the next one.
"""

from __future__ import annotations

import itertools
import math
import os
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alttree.functions.arrays import constant
from alttree.functions.exprs import EPS, RATIO_MAX, RATIO_MIN, boost_loss
from alttree.operators import binning, blocks, learner, metrics, sampling
from alttree.operators.placed import PLACE, located, row_number
from alttree.operators.scoring import layout, score
from alttree.operators.state import WeightFn, apply_node, eligible, rebuild_state
from alttree.schema import Candidate, Node
from alttree.sources import store


@dataclass
class TrainParams:
    """Training options. Sizes <= 0 mean automatic; `max_iters` 0 means no limit.

    `histogram` is "sql", "arrow", "blocks" or "auto"; all give the same sums. Rows of more than WIDE features are laid
    out in column blocks by "auto".
    """

    sample_frac: float = 0.1
    num_slices: int = 2
    max_iters: int = 10
    candidate_size: int = 100
    admit_size: int = 30
    improve: float = 0.01
    improve_window: int = 100
    depth: int = 1
    algorithm: str | WeightFn = "adaboost"
    n_features: int | None = None
    features_subset: list[int] | None = None
    split_by: str = "row"
    seed: int = 0
    strict_max_iters: bool = True
    compat_left_reject: bool = False
    histogram: str = "auto"
    auprc_every: int = 1
    ref_every: int = 100
    pr_every: int = 1000
    snapshot_every: int = 100
    output: str | None = None


# Nodes replayed by a caller's updater in one plan before the state is settled.
REPLAY_CHAIN = 20

# Histogram cells a task may hold in memory (32 bytes each); more nodes are summed in several passes.
TASK_CELLS = 4_000_000
WIDE = 64

Sampler = Callable[[DataFrame, list[Node]], DataFrame]


class SearchContext(NamedTuple):
    """What a searcher knows of the run beside the state: the model, how deep parents may lie below it, and the loss."""

    nodes: list[Node]
    depth: int
    loss: learner.LossFn


Searcher = Callable[[DataFrame, list[list[float]], int, SearchContext], DataFrame]


@dataclass
class Result:
    nodes: list[Node]
    history: list[dict] = field(default_factory=list)
    depth: int = 1
    last_resample: int = 0


def log_ratio(pos: float, neg: float) -> float:
    """Driver twin of `safe_log_ratio` for the few sums an admission brings back."""
    if abs(pos) <= EPS and abs(neg) <= EPS:
        return 0.0
    ratio = pos / neg if neg else (RATIO_MAX if pos > 0 else RATIO_MIN)
    return math.log(min(RATIO_MAX, max(ratio, RATIO_MIN)))


def root_node(n_pos: int, n_neg: int) -> Node:
    """The root predicts half the log odds of the classes, without a clamp."""
    if not n_pos or not n_neg:
        raise ValueError("training needs rows of both classes")
    return Node(0, -1, 0, -1, 0.0, True, 0.5 * math.log(n_pos / n_neg))


def root_frame(rows: DataFrame) -> DataFrame:
    """The root as a one-row table, from the class counts."""
    n_pos, n_neg = F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)
    return rows.agg(
        F.lit(0).alias("node_id"), F.lit(-1).alias("parent_id"), F.lit(0).alias("depth"), F.lit(-1).alias("feature"),
        F.lit(0.0).alias("threshold"), F.lit(True).alias("split_eval"),
        (0.5 * F.ln(F.try_divide(n_pos.cast("double"), n_neg))).alias("pred"))


class Underfit:
    """Full window of train averages whose relative gain stays below the target."""

    def __init__(self, window: int, target: float):
        self.target, self.scores = target, deque(maxlen=window)

    def push(self, avg: float) -> bool:
        self.scores.append(avg)
        if len(self.scores) < self.scores.maxlen:
            return False
        gain = (self.scores[0] - avg) / self.scores[0] if self.scores[0] else 0.0
        return (abs(self.target) <= EPS and gain <= EPS) or gain - self.target < -EPS

    def clear(self) -> None:
        self.scores.clear()


class Overfit:
    """Test averages since the best one; full when the best is `window - 1` records old."""

    def __init__(self, window: int):
        self.window, self.scores = window, []

    def push(self, avg: float) -> bool:
        if self.scores and self.scores[0] - avg >= -EPS:
            self.scores.clear()
        self.scores.append(avg)
        return len(self.scores) >= self.window

    def clear(self) -> None:
        self.scores.clear()


def rollback(nodes: list[Node], since_best: int) -> list[Node]:
    """Drop the nodes admitted after the best one."""
    return nodes[: len(nodes) - since_best + 1]


class Trainer:
    """Trains a model from a pool of labelled rows (row_id, y, features or nz).

    Hooks: `sampler(pool, nodes)` returns rows with `is_train`; `binner(train)` returns
    thresholds per feature; `searcher(state, cuts, k, context)` returns candidate splits;
    `updater(state, node)` admits a node; `loss` and `params.algorithm` are Column
    functions for the search loss and the weight update.
    """

    def __init__(
        self,
        spark: SparkSession,
        params: TrainParams,
        loss=boost_loss,
        sampler: Sampler | None = None,
        binner: Callable[[DataFrame], list[list[float]]] | None = None,
        searcher: Searcher | None = None,
        updater: Callable[[DataFrame, Node], DataFrame] | None = None,
    ):
        self.spark, self.params, self.loss = spark, params, loss
        self.sampler = sampler or self._sample
        self.binner = binner or self._thresholds
        self.searcher = searcher or self._search
        self.updater = updater
        self.folder = params.output or os.path.join(store.shared_folder(spark), f"train-{uuid.uuid4().hex}")
        self.draws, self.blocks = itertools.count(), None

    # hooks' defaults

    def _sample(self, pool: DataFrame, nodes: list[Node]) -> DataFrame:
        p = self.params
        if self.placed is None:  # a pool that is not read from files is written once, not for every sample
            self.placed = located(pool)
        return sampling.resample(self.placed, nodes, p.sample_frac, p.seed + next(self.draws), p.algorithm, p.split_by)

    def _thresholds(self, train: DataFrame) -> list[list[float]]:
        p = self.params
        if layout(train) == "nz":
            if p.n_features is None:
                raise ValueError("one-hot rows need n_features")
            return binning.collect_thresholds(binning.onehot_thresholds(train, p.n_features, p.num_slices))
        return binning.collect_thresholds(binning.thresholds(binning.to_long(train), p.num_slices))

    def _search(self, state: DataFrame, cuts: list[list[float]], k: int, context: SearchContext) -> DataFrame:
        """Wide rows are summed from column blocks, other one-hot rows per task, by blocks of nodes whose sums fit; dense rows in SQL."""
        p, onehot, hist = self.params, layout(state) == "nz", None
        if self.blocks is not None and "place" in state.columns:
            widths = [2] * p.n_features if onehot else [len(c) + 1 for c in cuts]
            hist = blocks.histogram(self.blocks, state, eligible(context.nodes, context.depth), widths)
        elif p.histogram == "arrow" or (p.histogram == "auto" and onehot):
            widths = [2] * p.n_features if onehot else [len(c) + 1 for c in cuts]
            parents = eligible(context.nodes, context.depth)
            block = max(1, TASK_CELLS // max(1, sum(widths)))
            parts = [learner.split_histogram_arrow(state, parents[at:at + block], widths) for at in range(0, len(parents), block)]
            hist = reduce(DataFrame.unionByName, parts)
        return learner.search(state, cuts, k, context.loss, p.compat_left_reject, p.features_subset, hist)

    # data of one sampling period

    def _load(self, sample: DataFrame) -> None:
        """Write the sample (it must not change under retries), then bin it."""
        self.period = getattr(self, "period", -1) + 1
        store.save_sample(sample, self._sample_path(), required=True)
        self._open()

    def _sample_path(self) -> str:
        return os.path.join(self.folder, f"sample-{self.period:04d}")

    def _open(self) -> None:
        """Bin the period's saved sample."""
        path = self._sample_path()
        rows = store.load_sample(self.spark, path)
        in_blocks = self._in_blocks(rows)
        if in_blocks:
            rows = row_number(located(rows), "place").drop(*PLACE)
        train = rows.where("is_train")
        self.cuts = self.binner(train)
        if layout(rows) == "features":
            rows = binning.bin_rows(rows, self.cuts)
        self.rows = rows
        if self.blocks is not None:
            self.blocks.unpersist()
        self.blocks = blocks.lay_out(rows, self.params.n_features if layout(rows) == "nz" else len(self.cuts)) if in_blocks else None

    def _in_blocks(self, rows: DataFrame) -> bool:
        if self.params.histogram != "auto":
            return self.params.histogram == "blocks"
        if layout(rows) == "nz":
            return (self.params.n_features or 0) > WIDE
        first = rows.select(F.size("features").alias("n")).first()
        return first is not None and first["n"] > WIDE

    def _rebuild(self) -> DataFrame:
        """State of the current model, from the sample alone."""
        p = self.params
        if self.updater is None:
            state = rebuild_state(self.rows, self.nodes, self.last_resample, self.depth, p.algorithm)
        else:
            fresh = {"delta": F.lit(0.0), "w": F.lit(1.0)}
            state = self.rows.withColumns({"hits": F.array().cast("array<int>"), **fresh})
            for node in self.nodes:
                if node.node_id == self.last_resample:
                    state = state.withColumns(fresh)
                state = self.updater(state, node)
                if node.node_id % REPLAY_CHAIN == REPLAY_CHAIN - 1:
                    state = store.settle(state)
            if self.last_resample >= len(self.nodes):
                state = state.withColumns(fresh)
            parents = constant(eligible(self.nodes, self.depth), "array<int>")
            state = store.settle(state.withColumn("hits", F.array_intersect("hits", parents)))
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        if getattr(self, "state", None) is not None:
            self.state.unpersist()
        self.state = state
        return state

    # one admission

    def _pass(self, state: DataFrame, new: list[Node], candidates: list[Candidate]) -> tuple[dict, dict, DataFrame]:
        """Loss sums and candidate sums with the nodes in `new` applied."""
        if self.params.algorithm == "adaboost" and self.updater is None:
            current = state
            found = learner.admission_pass(state, new, candidates).collect()
        else:
            current = state
            for node in new:
                current = self.updater(current, node) if self.updater else apply_node(current, node, self.params.algorithm)
            found = self._pass_columns(current, candidates)
        losses = {r["i"]: r for r in found if r["part"] == learner.LOSS_PART}
        sums = {r["i"]: r for r in found if r["part"] == learner.CANDIDATE_PART}
        return losses, sums, current

    def _pass_columns(self, state: DataFrame, candidates: list[Candidate]) -> list:
        """The same sums by column expressions, for any weight function or updater."""
        squares = [F.sum(F.when(F.col("y") > 0, F.col("w") ** 2).otherwise(0.0)).alias("sq_pos"),
                   F.sum(F.when(F.col("y") > 0, 0.0).otherwise(F.col("w") ** 2)).alias("sq_neg")]
        part = F.when(F.col("is_train"), 0).otherwise(1).alias("i")
        losses = state.groupBy(part).agg(*learner.class_sums(), *squares).withColumn("part", F.lit(learner.LOSS_PART))
        if not candidates:
            return losses.collect()
        sums = learner.candidate_sums(state.where("is_train"), candidates).withColumn("part", F.lit(learner.CANDIDATE_PART))
        return losses.unionByName(sums, allowMissingColumns=True).collect()

    def _choose(self, candidates: list[Candidate], sums: dict, total: float) -> Node:
        """The candidate of least loss under the current weights, as the next node."""
        scored = self._score(candidates, sums, total)
        _, best, pred = min(scored)
        c = Candidate(*best[:3], split_eval=best[3] == 0)
        return Node(len(self.nodes), c.parent_id, self.nodes[c.parent_id].depth + 1, c.feature, c.threshold, c.split_eval, pred)

    def _score(self, candidates: list[Candidate], sums: dict, total: float) -> list[tuple]:
        zero = (0.0, 0.0)
        out = []
        weights = [(sums[i]["w_pos"], sums[i]["w_neg"]) if i in sums else zero for i in range(len(candidates))]
        for c, (pos, neg), z in zip(candidates, weights, self._losses(weights, total)):
            if z is None or math.isnan(z):
                continue
            key = (c.parent_id, c.feature, c.threshold, 0 if c.split_eval else 1)
            out.append((round(z, learner.SCORE_DIGITS), key, 0.5 * log_ratio(pos, neg)))
        return out

    def _losses(self, weights: list[tuple[float, float]], total: float) -> list[float]:
        if self.loss is boost_loss:
            out = []
            for pos, neg in weights:
                rej = max(total - pos - neg, 0.0)
                s = rej + pos + neg
                out.append(rej / s + 2 * math.sqrt(max(pos / s * neg / s, 0.0)) if s else math.nan)
            return out
        # a custom loss is a Column function: evaluate it on the candidate list
        rows = [(i, max(total - p - n, 0.0), p, n) for i, (p, n) in enumerate(weights)]
        listed = self.spark.createDataFrame(rows, "i int, rej double, pos double, neg double")
        scored = listed.select("i", self.loss(F.col("rej"), F.col("pos"), F.col("neg")).alias("z")).collect()
        return [r["z"] for r in sorted(scored)]

    # monitoring

    def _metrics(self, losses: dict, iteration: int, current: DataFrame, new: list[Node]) -> dict:
        p = self.params
        out: dict = {}
        for i, name in ((0, "train"), (1, "test")):
            r = losses.get(i)
            n = (r["n_pos"] + r["n_neg"]) if r else 0
            if not n:
                continue
            out[f"{name}_avg"] = (r["w_pos"] + r["w_neg"]) / n
            out[f"{name}_avg_pos"] = r["w_pos"] / r["n_pos"] if r["n_pos"] else None
            out[f"{name}_avg_neg"] = r["w_neg"] / r["n_neg"] if r["n_neg"] else None
        t = losses[0]

        def effective(w, sq, n):
            return w * w / sq / n if sq and n else None

        out["effective"] = effective(t["w_pos"] + t["w_neg"], t["sq_pos"] + t["sq_neg"], t["n_pos"] + t["n_neg"])
        out["effective_pos"] = effective(t["w_pos"], t["sq_pos"], t["n_pos"])
        out["effective_neg"] = effective(t["w_neg"], t["sq_neg"], t["n_neg"])
        if p.algorithm != "adaboost" or self.updater is not None:
            out.update(self._true_losses(current))
        curve_due = bool(p.pr_every) and iteration % p.pr_every == 0
        if curve_due or (p.auprc_every and iteration % p.auprc_every == 0):
            pending = new if current is self.state else []
            scored = learner.current_scores(current, pending)
            areas = metrics.auprc(scored, by=["is_train"]).collect()
            for r in areas:
                out["train_auprc" if r["is_train"] else "test_auprc"] = r["auprc"]
            if curve_due:
                self._save_curve(scored.where("is_train"), "train", iteration)
                self._save_curve(scored.where("not is_train"), "test", iteration)
        if self.reference is not None and iteration % p.ref_every == 0:
            ref = score(self.reference, self.nodes).select("y", "score").persist()
            r = metrics.exp_loss(ref).first()
            out |= {"ref_avg": r["avg_loss"], "ref_avg_pos": r["avg_loss_pos"], "ref_avg_neg": r["avg_loss_neg"]}
            out["ref_auprc"] = metrics.auprc(ref).first()["auprc"]
            if curve_due:
                self._save_curve(ref, "ref", iteration)
            ref.unpersist()
        return out

    def _true_losses(self, current: DataFrame) -> dict:
        """Exponential losses from scores where the weights are something else."""
        loss = F.exp(-F.col("y") * F.col("delta"))
        pos = F.col("y") > 0
        rows = current.groupBy("is_train").agg(
            F.avg(loss).alias("avg"), F.avg(F.when(pos, loss)).alias("avg_pos"), F.avg(F.when(~pos, loss)).alias("avg_neg")).collect()
        return {f"{'train' if r['is_train'] else 'test'}_{m}": r[m] for r in rows for m in ("avg", "avg_pos", "avg_neg")}

    def _save_curve(self, scored: DataFrame, dataset: str, iteration: int) -> None:
        points = metrics.pr_curve(scored).withColumns(
            {"iteration": F.lit(iteration), "n_nodes": F.lit(len(self.nodes)), "dataset": F.lit(dataset)})
        store.save_pr_points(points, os.path.join(self.folder, "pr_curve"), self.batch)

    def _record(self, iteration: int, batch: int, values: dict, event: str | None = None, change: float | None = None) -> dict:
        record = {"iteration": iteration, "batch": batch, "n_nodes": len(self.nodes), "depth": self.depth,
                  "event": event, "weight_change": change, **values}
        self.history.append(record)
        return record

    def _write_history(self) -> None:
        """Records since the last call, so that a run that ends early leaves its history too."""
        new = self.history[self.written:]
        if self.params.output and new:
            store.save_history(self.spark, new, os.path.join(self.folder, "history"), first=not self.written)
            self.written = len(self.history)

    def _save_progress(self, iteration: int, under: Underfit, over: Overfit) -> None:
        """After the history of a batch, what is needed to go on from it."""
        if self.params.output:
            drawn = next(self.draws)
            self.draws = itertools.count(drawn)
            progress = {"batch": self.batch, "iteration": iteration, "nodes": self.nodes, "depth": self.depth, "last_resample": self.last_resample,
                        "period": self.period, "draws": drawn, "under": list(under.scores), "over": list(over.scores)}
            store.save_progress(self.spark, self.batch, progress, os.path.join(self.folder, "progress"), first=self.batch == 0)

    def _resume(self, saved: dict, under: Underfit, over: Overfit) -> dict:
        """Take up a run after its last whole batch: same sample, model, windows and draws to come."""
        self.nodes = [Node(*n) for n in saved["nodes"]]
        self.depth, self.last_resample, self.batch = saved["depth"], saved["last_resample"], saved["batch"]
        self.period, self.draws = saved["period"], itertools.count(saved["draws"])
        self.history = store.load_history(self.spark, os.path.join(self.folder, "history"), self.batch)
        self.written = len(self.history)
        under.scores.extend(saved["under"])
        over.scores.extend(saved["over"])
        self._open()
        self._rebuild()
        return self._pass(self.state, [], [])[0]

    # the loop

    def fit(
        self,
        pool: DataFrame | None = None,
        reference: DataFrame | None = None,
        init_nodes: list[Node] | None = None,
        last_resample: int = 0,
        sample: DataFrame | None = None,
        model_length: int = 0,
        resume: bool = False,
    ) -> Result:
        """Train from a pool, or from an existing sample with `is_train` flags.

        `init_nodes` (cut to `model_length`) and `last_resample` continue an earlier model. With `resume` a run that
        ended early goes on after its last whole batch in `params.output`, if there is one; options may be raised.
        """
        p = self.params
        nodes = list(init_nodes or [])
        self.nodes = nodes[:model_length] if model_length else nodes
        self.last_resample, self.depth, self.reference = last_resample, p.depth, reference
        self.history, self.written, self.batch = [], 0, 0
        self.pool, self.placed = pool, None
        under, over = Underfit(p.improve_window, p.improve), Overfit(p.improve_window)
        saved = store.load_progress(self.spark, os.path.join(self.folder, "progress")) if resume and p.output else None
        if saved is None:
            if p.output and p.pr_every:
                store.clear_pr_points(self.spark, os.path.join(self.folder, "pr_curve"))
            self._load(sample if sample is not None else self.sampler(pool, self.nodes))
            if not self.nodes:
                c = metrics.class_counts(self.rows.where("is_train")).first()
                self.nodes = [root_node(c["n_pos"], c["n_neg"])]

        def restart(batch: int) -> dict:
            self._rebuild()
            under.clear()
            over.clear()
            losses, _, _ = self._pass(self.state, [], [])
            values = self._metrics(losses, 0, self.state, [])
            under.push(values["train_avg"])
            if "test_avg" in values:
                over.push(values["test_avg"])
            self._record(0, batch, values)
            return losses

        if saved is None:
            losses, iteration = restart(0), 0
            self._write_history()
            self._save_progress(iteration, under, over)
        else:
            losses, iteration = self._resume(saved, under, over), saved["iteration"]
        while p.max_iters == 0 or iteration < p.max_iters:
            self.batch += 1
            batch = self.batch
            train = self.state.where("is_train")
            context = SearchContext(list(self.nodes), self.depth, self.loss)
            found = self.searcher(train, self.cuts, p.candidate_size, context)
            candidates = learner.collect_candidates(found)
            if not candidates:
                break
            budget = learner.admission_budget(len(candidates), p.candidate_size, p.admit_size)
            if p.strict_max_iters and p.max_iters:
                budget = min(budget, p.max_iters - iteration)
            _, sums, _ = self._pass(self.state, [], candidates)
            new: list[Node] = []
            while len(new) < budget:
                total = losses[0]["w_pos"] + losses[0]["w_neg"]
                node = self._choose(candidates, sums, total)
                self.nodes.append(node)
                new.append(node)
                iteration += 1
                losses, sums, current = self._pass(self.state, new, candidates)
                values = self._metrics(losses, iteration, current, new)
                change = losses[0]["w_pos"] + losses[0]["w_neg"] - total
                record = self._record(iteration, batch, values, change=change)
                if p.snapshot_every and iteration % p.snapshot_every == 0:
                    store.save_snapshot(self.spark, self.nodes, os.path.join(self.folder, "snapshots"), iteration)
                if under.push(values["train_avg"]):
                    record["event"] = "deepen"
                    self.depth += 1
                    under.clear()
                    over.clear()
                    break
                if "test_avg" in values and over.push(values["test_avg"]):
                    record |= {"event": "rollback", "n_before": len(self.nodes)}
                    self.nodes = rollback(self.nodes, len(over.scores))
                    record["n_after"] = len(self.nodes)
                    self.last_resample = len(self.nodes)
                    self.depth = 1
                    if self.pool is None:
                        return self._finish()
                    self._load(self.sampler(self.pool, self.nodes))
                    losses = restart(batch)
                    break
            else:
                record = {"event": None}
            if record["event"] != "rollback":
                self._rebuild()
            self._write_history()
            self._save_progress(iteration, under, over)
        return self._finish()

    def _finish(self) -> Result:
        if self.params.output:
            store.save_model(self.spark, self.nodes, os.path.join(self.folder, "model"))
            self._write_history()
        self.state.unpersist()
        if self.blocks is not None:
            self.blocks.unpersist()
        return Result(self.nodes, self.history, self.depth, self.last_resample)


def train(pool: DataFrame, params: TrainParams, reference: DataFrame | None = None, **fit_options) -> Result:
    return Trainer(pool.sparkSession, params).fit(pool, reference, **fit_options)
