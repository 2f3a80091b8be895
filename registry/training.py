"""The training loop, its hooks and the tables it keeps."""

from __future__ import annotations

import os
import random
import uuid

from pyspark.sql import functions as F

from alttree.operators import binning as b
from alttree.operators import encode
from alttree.operators import learner as ln
from alttree.operators import sampling as sp
from alttree.operators import state as st
from alttree.plans import history as hs
from alttree.plans.trainer import Trainer, TrainParams, root_frame
from alttree.schema import NODES, Node, nodes_df
from alttree.sources import store
from registry import query
from registry.boosting_sql import drawn_sample, hashed_sample, training_sql
from registry.fixtures import (
    EVT, FEATURES, FIRED, HIST, LETTERS, MODEL, R4, SINGLE, STATE, TREE, R, documents_letters, evt, evt_state, hash_sql, history, r4, r6,
    score_sql, train_sql, tree_nodes)
from registry.learning import _IN, _NEW, BASE, CUMULATIVE, HIST as SPLIT_HIST, ROUND, SEARCH, SLICES, SPLITS, TOP, TOTALS, binned_state, loss_sql
from registry.tree_sql import MEASURES, TreeSql, auprc_sql


def _folder(spark) -> str:
    return os.path.join(store.shared_folder(spark), f"query-{uuid.uuid4().hex}")


_SEED = 1
_PARAMS = dict(sample_frac=0.5, num_slices=4, max_iters=6, candidate_size=4, admit_size=3, auprc_every=0, pr_every=0, seed=_SEED)
_DRAWN = drawn_sample(0.5, random.Random(_SEED).random(), _SEED)


def _iterations(spark, nodes, history):
    """Every iteration's node beside its metrics."""
    numbers = ["train_avg", "train_avg_pos", "test_avg", "effective"]
    metrics = history.select("iteration", *[r6(m).alias(m) for m in numbers], r4("weight_change").alias("weight_change"))
    tests = nodes_df(spark, nodes).select(
        F.col("node_id").alias("iteration"), "feature", r6("threshold").alias("threshold"), "split_eval", r6("pred").alias("pred"))
    return tests.join(metrics, "iteration")


@query(training_sql(_DRAWN, 4, 4, 3, 2))
def train_small(spark, sf):
    """Resample the events pool, then two batches of three admissions below the root."""
    rows = evt(spark, sf)
    result = Trainer(spark, TrainParams(**_PARAMS)).fit(rows, reference=rows)
    return _iterations(spark, result.nodes, store.history_df(spark, result.history))


@query(f"""WITH {ROUND}
SELECT 0 AS node_id, -1 AS parent_id, 0 AS depth, -1 AS feature, CAST(0 AS DOUBLE) AS threshold, TRUE AS split_eval, {R('pred')} AS pred FROM rootp
UNION ALL SELECT 1, 0, 1, feature, {R('threshold')}, side = 0, {R('pred')} FROM child""")
def admit_node(spark, sf):
    """The node table after the root and one admitted child."""
    rows = evt(spark, sf)
    cuts = b.collect_thresholds(b.thresholds(b.to_long(rows), SLICES))
    root = root_frame(rows)
    state = st.rebuild_state(b.bin_rows(rows, cuts), [Node(*root.first())])
    best = ln.best_candidate(ln.reevaluate(state, ln.collect_candidates(ln.search(state, cuts, 5))))
    child = best.select(F.lit(1).alias("node_id"), "parent_id", F.lit(1).alias("depth"), "feature", "threshold", "split_eval", "pred")
    return root.unionByName(child).withColumns({"threshold": r6("threshold"), "pred": r6("pred")})


@query(f"""WITH {STATE} SELECT {R4('sum(w)')} AS before, {R4(f'sum(CASE WHEN {_IN} THEN w * exp(-y * 0.35) ELSE w END)')} AS after,
  {R4(f'sum(CASE WHEN {_IN} THEN w * exp(-y * 0.35) ELSE w END) - sum(w)')} AS change FROM state""")
def weight_change(spark, sf):
    state = evt_state(spark, sf).withColumn("w_old", F.col("w"))
    out = st.apply_node(state, _NEW).agg(F.sum("w_old").alias("before"), F.sum("w").alias("after"))
    return out.select(r4("before").alias("before"), r4("after").alias("after"), r4(F.col("after") - F.col("before")).alias("change"))


@query(f"""WITH {SEARCH}, {TOP} SELECT CAST(count(*) AS BIGINT) AS n_candidates, CAST(ceil(0.3 * count(*)) AS BIGINT) AS automatic,
  CAST(3 AS BIGINT) AS fixed FROM top""")
def admission_budget(spark, sf):
    state, cuts = binned_state(spark, sf)
    n = ln.search(state, cuts, 0).count()
    rows = [(n, ln.admission_budget(n, 0, 0), ln.admission_budget(n, 10, 3))]
    return spark.createDataFrame(rows, "n_candidates long, automatic long, fixed long")


@query(f"""WITH {HIST} SELECT run, iteration, iteration % 100 = 0 AS ref_due, iteration % 1000 = 0 AS pr_due,
  CASE WHEN iteration % 100 = 0 THEN train_avg END AS ref_avg FROM hist""")
def metric_schedule(spark, sf):
    """When the reference metrics and the PR curve are due; other reference values are null."""
    h = history(spark, sf).withColumn("ref_auprc", F.col("train_avg"))
    return hs.metric_schedule(h).select("run", "iteration", "ref_due", "pr_due", F.col("ref_auprc").alias("ref_avg"))


@query(f"""WITH {EVT}, {FIRED} SELECT row_id, {R(f'exp(-y * {score_sql(4, 2)})')} AS w,
  CASE WHEN m0 THEN '0' ELSE '' END || CASE WHEN m1 THEN '1' ELSE '' END || CASE WHEN m2 THEN '2' ELSE '' END AS members FROM fired""")
def warm_start(spark, sf):
    """State of a model cut to four nodes and resampled at node 2, at depth 2."""
    kept = [n for n in MODEL if n.node_id < 4]
    state = st.rebuild_state(evt(spark, sf), kept, last_resample=2, max_depth=2)
    return state.select("row_id", r6("w").alias("w"), F.array_join("hits", "").alias("members"))


_BALANCED = loss_sql("rej", "pos", "neg")
_GINI = "(rej / nullif(rej + pos + neg, 0) + 4 * pos * neg / nullif((pos + neg) * (rej + pos + neg), 0))"


@query(f"""WITH {BASE}, {TOTALS}, {SPLIT_HIST}, {CUMULATIVE}, {SPLITS.replace(_BALANCED, _GINI)}
SELECT parent_id, feature, {R('threshold')} AS threshold, side = 0 AS split_eval, {R('z')} AS z FROM best""")
def custom_loss(spark, sf):
    """Split search under another loss, given as a Column function."""

    def gini(rej, pos, neg):
        total = rej + pos + neg
        return F.try_divide(rej, total) + F.try_divide(4 * pos * neg, (pos + neg) * total)

    state, cuts = binned_state(spark, sf)
    cum = ln.cumulative_slots(ln.split_histogram(state), st.node_totals(state), cuts)
    best = ln.best_per_feature(ln.split_scores(cum, gini))
    return best.select("parent_id", "feature", r6("threshold").alias("threshold"), "split_eval", r6("z").alias("z"))


@query(training_sql(hashed_sample(0.5, 3), 3, 2, 3, 1, features=[0, 3]))
def custom_hooks(spark, sf):
    """A run whose sampler, thresholds, search and update are all supplied by the caller."""

    def sampler(pool, nodes):
        return sp.hash_sample(pool, 0.5).withColumn("is_train", sp.train_flag(seed=3))

    def binner(train):
        return b.collect_thresholds(b.thresholds(b.to_long(train), 3))

    def searcher(state, cuts, k, context):
        return ln.search(state, cuts, k, context.loss, features=[0, 3])

    def updater(state, node):
        return st.apply_node(state, node)

    params = TrainParams(max_iters=3, candidate_size=2, admit_size=3, auprc_every=0, pr_every=0)
    trainer = Trainer(spark, params, sampler=sampler, binner=binner, searcher=searcher, updater=updater)
    result = trainer.fit(evt(spark, sf))
    return _iterations(spark, result.nodes, store.history_df(spark, result.history))


_NODE_COLUMNS = ", ".join(NODES.names)


@query(f"WITH {TREE} SELECT {_NODE_COLUMNS} FROM nodes")
def model_roundtrip(spark, sf):
    path = os.path.join(_folder(spark), "model")
    store.save_nodes(tree_nodes(spark, sf), path)
    return store.load_nodes(spark, path)


@query(f"WITH {TREE} SELECT {_NODE_COLUMNS} FROM nodes WHERE node_id < 500")
def snapshot_roundtrip(spark, sf):
    """A numbered snapshot, loaded at a given length."""
    path = store.snapshot_path(_folder(spark), 100)
    store.save_nodes(tree_nodes(spark, sf), path)
    return store.load_nodes(spark, path, length=500)


@query(f"""WITH {EVT} SELECT row_id, y, {train_sql()} AS is_train,
  CAST(f0 AS VARCHAR) || '|' || CAST(f3 AS VARCHAR) AS packed FROM evt""")
def sample_roundtrip(spark, sf):
    path = os.path.join(_folder(spark), "sample")
    store.save_sample(evt(spark, sf).withColumn("is_train", sp.train_flag()), path)
    packed = F.concat_ws("|", F.get("features", F.lit(0)).cast("string"), F.get("features", F.lit(3)).cast("string"))
    return store.load_sample(spark, path).select("row_id", "y", "is_train", packed.alias("packed"))


@query(training_sql(_DRAWN, 4, 4, 3, 1))
def history_sink(spark, sf):
    """The model and history a run writes, read back from its tables."""
    path = _folder(spark)
    Trainer(spark, TrainParams(**{**_PARAMS, "max_iters": 3}, output=path)).fit(evt(spark, sf))
    nodes = store.load_model(spark, os.path.join(path, "model"))
    return _iterations(spark, nodes, spark.read.parquet(os.path.join(path, "history")))


@query(training_sql(_DRAWN, 4, 4, 3, 2))
def resumed_run(spark, sf):
    """The run of `train_small`, ended after its first batch and taken up by another trainer."""
    path = _folder(spark)
    Trainer(spark, TrainParams(**{**_PARAMS, "max_iters": 3}, output=path)).fit(evt(spark, sf))
    result = Trainer(spark, TrainParams(**_PARAMS, output=path)).fit(evt(spark, sf), resume=True)
    return _iterations(spark, result.nodes, spark.read.parquet(os.path.join(path, "history")))


@query(training_sql(_DRAWN, 4, 4, 3, 1))
def rerun_into_one_folder(spark, sf):
    """A run repeated into the folder of an equal one: its tables hold each record once."""
    path = _folder(spark)
    for _ in range(2):
        Trainer(spark, TrainParams(**{**_PARAMS, "max_iters": 3}, output=path)).fit(evt(spark, sf))
    nodes = store.load_model(spark, os.path.join(path, "model"))
    return _iterations(spark, nodes, spark.read.parquet(os.path.join(path, "history")))


_FLAGGED = f"SELECT row_id, 1 AS copy, y, {train_sql()} AS is_train, {', '.join(f'f{k}' for k in range(FEATURES))} FROM evt"
_JOINED = """SELECT h.*, n.parent_id, n.depth AS node_depth, n.feature, n.threshold, n.split_eval, n.pred
FROM history h JOIN nodes n ON n.node_id = h.n_nodes - 1"""
_RUN = dict(num_slices=4, candidate_size=4, admit_size=3, auprc_every=0, pr_every=0)


def _flagged(spark, sf):
    return evt(spark, sf).withColumn("is_train", sp.train_flag())


def _records(history, *more):
    return history.select("iteration", "n_nodes", r4("weight_change").alias("weight_change"),
                          *[r6(m).alias(m) for m in MEASURES], *more)


def _with_nodes(history, nodes):
    """Every record beside the last node it has seen."""
    tests = nodes.select((F.col("node_id") + 1).alias("n_nodes"), "parent_id", F.col("depth").alias("node_depth"), "feature",
                         r6("threshold").alias("threshold"), "split_eval", r6("pred").alias("pred"))
    return history.join(tests, "n_nodes")


def _deepening() -> TreeSql:
    due = dict(train_auprc=auprc_sql("{w}", "is_train"), test_auprc=auprc_sql("{w}", "NOT is_train"),
               ref_auprc=auprc_sql("{w}", "TRUE"), ref_avg=f"(SELECT {R('avg(exp(-y * delta))')} FROM {{w}})")
    run = TreeSql(EVT).sample(_FLAGGED, 4).root()

    def record(i, event="NULL"):
        values = {c: v.format(w=f"w{run.step}") if i % 2 == 0 else "CAST(NULL AS DOUBLE)" for c, v in due.items()}
        run.record(i, change=i > 0, event=f"CAST({event} AS VARCHAR)", **values)

    record(0)
    run.search(4, 1)
    for i in (1, 2):
        run.admit(known_depth=1)
        record(i, "'deepen'" if i == 2 else "NULL")
    run.search(4, 2)
    for i in (3, 4):
        run.admit()
        record(i)
    return run


_DEEPENED = _deepening()


def _deepened(spark, sf, folder):
    """A gain of nine tenths in two admissions is never reached, so the tree deepens after them."""
    rows = _flagged(spark, sf)
    params = TrainParams(**{**_RUN, "auprc_every": 2}, max_iters=4, improve=0.9, improve_window=3, ref_every=2, snapshot_every=2, output=folder)
    return Trainer(spark, params).fit(sample=rows, reference=rows)


@query(_DEEPENED.statement(_JOINED))
def deepening_run(spark, sf):
    """A run that goes one level deeper, with the areas and reference metrics that are due every other admission."""
    folder = _folder(spark)
    result = _deepened(spark, sf, folder)
    areas = ["train_auprc", "test_auprc", "ref_auprc", "ref_avg"]
    history = _records(spark.read.parquet(os.path.join(folder, "history")), "event", *[r6(a).alias(a) for a in areas])
    return _with_nodes(history, nodes_df(spark, result.nodes))


@query(_DEEPENED.statement("SELECT * FROM nodes WHERE node_id < 3"))
def periodic_snapshot(spark, sf):
    """The model that the loop wrote after two admissions."""
    folder = _folder(spark)
    _deepened(spark, sf, folder)
    nodes = store.load_nodes(spark, store.snapshot_path(os.path.join(folder, "snapshots"), 2))
    return nodes.withColumns({"threshold": r6("threshold"), "pred": r6("pred")})


def _flipped(seed: int) -> str:
    return f"""SELECT row_id, 1 AS copy, CASE WHEN is_train THEN y ELSE -y END AS y, is_train, {', '.join(f'f{k}' for k in range(FEATURES))}
      FROM (SELECT *, {train_sql()} AS is_train FROM evt WHERE {hash_sql('row_id', seed=seed)} < {round(0.5 * 2**31)})"""


_ROLLED = TreeSql(EVT).sample(_flipped(1), 4).root().record(0, change=False, event="CAST(NULL AS VARCHAR)", n_after="CAST(NULL AS INTEGER)")
_ROLLED.search(4, 1).admit().record(1, event="CAST(NULL AS VARCHAR)", n_after="CAST(NULL AS INTEGER)")
_ROLLED.admit().record(2, event="'rollback'", n_after="1")
_ROLLED.sample(_flipped(2), 4).restart().record(0, change=False, event="CAST(NULL AS VARCHAR)", n_after="CAST(NULL AS INTEGER)")
_ROLLED.search(4, 1).admit().record(3, event="CAST(NULL AS VARCHAR)", n_after="CAST(NULL AS INTEGER)")


@query(_ROLLED.statement("""SELECT h.*, (SELECT max(feature) FROM nodes WHERE node_id = 1) AS last_feature,
  (SELECT max(threshold) FROM nodes WHERE node_id = 1) AS last_threshold FROM history h"""))
def rollback_run(spark, sf):
    """Held-out rows with the opposite labels: two admissions are taken back and a new sample is drawn, with weights from 1."""
    drawn = iter((1, 2, 3))

    def sampler(pool, nodes):
        kept = sp.hash_sample(pool, 0.5, seed=next(drawn)).withColumn("is_train", sp.train_flag())
        return kept.withColumn("y", F.when(F.col("is_train"), F.col("y")).otherwise(-F.col("y")))

    params = TrainParams(**_RUN, max_iters=3, improve=-1.0, improve_window=3)
    result = Trainer(spark, params, sampler=sampler).fit(evt(spark, sf))
    last = result.nodes[-1]
    return _records(store.history_df(spark, result.history), "event", "n_after").withColumns(
        {"last_feature": F.lit(last.feature), "last_threshold": r6(F.lit(last.threshold))})


_CONTINUED = TreeSql(EVT, FIRED).sample(_FLAGGED, 4).given([n for n in MODEL if n.node_id < 4], 2, "fired").record(0, change=False)
_CONTINUED.search(4, 2)
for _i in (1, 2, 3):
    _CONTINUED.admit().record(_i)


@query(_CONTINUED.statement(_JOINED))
def warm_start_training(spark, sf):
    """Training goes on from a given model cut to four nodes, resampled at its third."""
    params = TrainParams(**_RUN, max_iters=3, depth=2)
    result = Trainer(spark, params).fit(sample=_flagged(spark, sf), init_nodes=MODEL, model_length=4, last_resample=2)
    return _with_nodes(_records(store.history_df(spark, result.history)), nodes_df(spark, result.nodes))


_DAMPED = TreeSql(EVT, update="w * (0.25 + 0.75 * exp(-y * pred))").sample(_FLAGGED, 4).root().record(0, change=False)
for _i in range(1, 5):
    if _i % 2:
        _DAMPED.search(4, 1)
    _DAMPED.admit().record(_i)


@query(_DAMPED.statement(_JOINED))
def custom_weights(spark, sf):
    """Two batches under the caller's own weight function."""

    def damped(y, w, pred):
        return w * (0.25 + 0.75 * F.exp(-y * pred))

    params = TrainParams(**{**_RUN, "admit_size": 2}, max_iters=4, algorithm=damped)
    result = Trainer(spark, params).fit(sample=_flagged(spark, sf))
    return _with_nodes(_records(store.history_df(spark, result.history)), nodes_df(spark, result.nodes))


_ONEHOT = TreeSql(LETTERS, SINGLE).onehot_sample(f"SELECT row_id, y, {train_sql()} AS is_train FROM letters", "single").root().record(0, change=False)
_ONEHOT.search(6, 1)
for _i in (1, 2):
    _ONEHOT.admit(known_depth=1).record(_i)
_ONEHOT.search(6, 2)
for _i in (3, 4):
    _ONEHOT.admit().record(_i)


@query(_ONEHOT.statement(_JOINED))
def onehot_training(spark, sf):
    """Letters to one-hot rows to a tree two levels deep: search, admission and scoring without a dense column."""
    rows = encode.encode(documents_letters(spark, sf)).withColumn("is_train", sp.train_flag())
    params = TrainParams(max_iters=4, candidate_size=6, admit_size=2, auprc_every=0, pr_every=0, improve=0.9, improve_window=3,
                         n_features=encode.n_features())
    result = Trainer(spark, params).fit(sample=rows)
    return _with_nodes(_records(store.history_df(spark, result.history)), nodes_df(spark, result.nodes))
