"""The training loop against its plain definition, and its stop rules, hooks and tables."""

import os

import pytest
from pyspark.sql import functions as F

from alttree.operators import binning, learner, sampling, scoring, state
from alttree.plans.trainer import Trainer, TrainParams
from alttree.schema import Candidate
from alttree.sources import store
from helpers import MODEL, dense, fires, onehot, random_onehot, random_rows, train_plainly


def _same(found, expected):
    assert [n[:6] for n in found] == [n[:6] for n in expected]
    assert [n.pred for n in found] == pytest.approx([n.pred for n in expected], abs=1e-9)


def _quiet(**options):
    return TrainParams(**{"auprc_every": 0, "pr_every": 0, "snapshot_every": 0, **options})


@pytest.mark.parametrize("histogram", ["sql", "arrow"])
def test_dense_training(spark, histogram):
    data = random_rows(120)
    sample = dense(spark, data).withColumn("is_train", F.lit(True))
    params = _quiet(num_slices=4, max_iters=6, candidate_size=6, admit_size=3, depth=2, histogram=histogram)
    result = Trainer(spark, params).fit(sample=sample)
    _same(result.nodes, train_plainly(data, 4, 2, 6, 3, 2))
    averages = [h["train_avg"] for h in result.history]
    assert averages == sorted(averages, reverse=True) and len(averages) == 7
    scored = scoring.score(sample, result.nodes)
    assert averages[-1] == pytest.approx(scored.agg(F.avg(F.exp(-F.col("y") * F.col("score")))).first()[0])


def test_onehot_training(spark):
    data = random_onehot(120, 12)
    sample = onehot(spark, data).withColumn("is_train", F.lit(True))
    params = _quiet(num_slices=2, max_iters=4, candidate_size=5, admit_size=2, depth=2, n_features=12)
    result = Trainer(spark, params).fit(sample=sample)
    wide = [(i, y, [float(f in nz) for f in range(12)]) for i, y, nz in data]
    _same(result.nodes, train_plainly(wide, 2, 2, 5, 2, 2))


def test_column_path_equals_kernel_path(spark):
    sample = dense(spark, random_rows(120)).withColumn("is_train", F.col("row_id") % 4 != 0)
    params = _quiet(num_slices=4, max_iters=4, candidate_size=6, admit_size=2)
    plain = Trainer(spark, params).fit(sample=sample)
    hooked = Trainer(spark, params, updater=state.apply_node).fit(sample=sample)
    _same(hooked.nodes, plain.nodes)
    for a, b in zip(hooked.history, plain.history):
        for m in ("train_avg", "test_avg", "effective", "train_avg_pos"):
            assert a[m] == pytest.approx(b[m])


def test_metrics_and_tables(spark, tmp_path):
    pool = dense(spark, random_rows(400))
    out = str(tmp_path / "run")
    params = TrainParams(sample_frac=0.5, num_slices=4, max_iters=4, candidate_size=6, admit_size=2, ref_every=2,
                         pr_every=2, snapshot_every=2, output=out)
    result = Trainer(spark, params).fit(pool, reference=pool)
    assert len(result.nodes) == 5
    history = spark.read.parquet(os.path.join(out, "history")).orderBy("iteration").collect()
    assert [r.iteration for r in history] == [0, 1, 2, 3, 4]
    assert [r.ref_avg is None for r in history] == [False, True, False, True, False]
    assert all(0 < r.train_auprc <= 1 and 0 < r.test_auprc <= 1 for r in history)
    assert history[0].weight_change is None and all(r.weight_change < 0 for r in history[1:])
    points = spark.read.parquet(os.path.join(out, "pr_curve"))
    assert {(r.dataset, r.iteration) for r in points.select("dataset", "iteration").distinct().collect()} == {
        (d, i) for d in ("train", "test", "ref") for i in (0, 2, 4)}
    assert store.load_model(spark, os.path.join(out, "model")) == result.nodes
    assert store.load_model(spark, store.snapshot_path(os.path.join(out, "snapshots"), 2)) == result.nodes[:3]
    # the recorded held-out area is that of the saved sample under the final model
    sample = store.load_sample(spark, os.path.join(out, "sample-0000"))
    from alttree.operators import metrics

    scored = scoring.score(sample.where("not is_train"), result.nodes)
    assert history[-1].test_auprc == pytest.approx(metrics.auprc(scored).first()[0])


def test_warm_start_continues(spark):
    data = random_rows(120)
    sample = dense(spark, data).withColumn("is_train", F.lit(True))
    whole = Trainer(spark, _quiet(num_slices=4, max_iters=4, candidate_size=6, admit_size=2)).fit(sample=sample)
    half = Trainer(spark, _quiet(num_slices=4, max_iters=2, candidate_size=6, admit_size=2)).fit(sample=sample)
    # two surplus nodes are cut off again by model_length
    longer = [*half.nodes, *whole.nodes[3:4]]
    rest = Trainer(spark, _quiet(num_slices=4, max_iters=2, candidate_size=6, admit_size=2)).fit(
        sample=sample, init_nodes=longer, model_length=3)
    _same(rest.nodes, whole.nodes)


def test_underfit_deepens(spark):
    sample = dense(spark, random_rows(120)).withColumn("is_train", F.lit(True))
    result = Trainer(spark, _quiet(num_slices=4, max_iters=8, candidate_size=6, admit_size=4, improve=0.9, improve_window=3)).fit(sample=sample)
    events = [h["event"] for h in result.history]
    assert events.count("deepen") >= 2 and result.depth >= 3
    assert max(n.depth for n in result.nodes) > 1
    assert all(n.depth <= h["depth"] for h, n in zip(result.history[1:], result.nodes[1:]))


def test_overfit_rolls_back_and_resamples(spark):
    rows = random_rows(300)
    pool = dense(spark, rows)
    samples = []

    def sampler(pool, nodes):
        """Held-out rows carry the opposite labels, so that every admission overfits."""
        samples.append(len(nodes))
        kept = sampling.hash_sample(pool, 0.6, seed=len(samples)).withColumn("is_train", sampling.train_flag(seed=1))
        return kept.withColumn("y", F.when(F.col("is_train"), F.col("y")).otherwise(-F.col("y")))

    params = _quiet(num_slices=4, max_iters=5, candidate_size=6, admit_size=5, improve=-1.0, improve_window=3)
    result = Trainer(spark, params, sampler=sampler).fit(pool)
    rolled = [h for h in result.history if h["event"] == "rollback"]
    assert rolled and len(samples) == 1 + len(rolled)
    for h in rolled:
        assert h["n_before"] - h["n_after"] == 2
    assert samples[1] == rolled[0]["n_after"] == 1
    assert result.last_resample == rolled[-1]["n_after"]
    # after a resample the weights restart at 1
    restart = [h for h in result.history if h["iteration"] == 0][1]
    assert restart["train_avg"] == pytest.approx(1.0) and restart["effective"] == pytest.approx(1.0)


def test_logit_and_custom_loss(spark):
    sample = dense(spark, random_rows(120)).withColumn("is_train", F.col("row_id") % 5 != 0)
    logit = Trainer(spark, _quiet(num_slices=4, max_iters=3, candidate_size=5, admit_size=3, algorithm="logit")).fit(sample=sample)
    assert len(logit.nodes) == 4

    def gini(rej, pos, neg):
        return F.try_divide(rej, rej + pos + neg) + F.try_divide(4 * pos * neg, (pos + neg) * (rej + pos + neg))

    custom = Trainer(spark, _quiet(num_slices=4, max_iters=2, candidate_size=5, admit_size=2), loss=gini).fit(sample=sample)
    assert len(custom.nodes) == 3


def test_budgets():
    assert learner.admission_budget(35, 0, 5) == 11
    assert learner.admission_budget(35, 100, 30) == 30


def test_feature_subset_and_automatic_sizes(spark):
    sample = dense(spark, random_rows(120)).withColumn("is_train", F.lit(True))
    params = _quiet(num_slices=4, max_iters=3, candidate_size=0, features_subset=[1, 2])
    result = Trainer(spark, params).fit(sample=sample)
    assert {n.feature for n in result.nodes[1:]} <= {1, 2}


def test_one_class_is_refused(spark):
    sample = dense(spark, [(0, 1, [1.0]), (1, 1, [2.0])]).withColumn("is_train", F.lit(True))
    with pytest.raises(ValueError):
        Trainer(spark, _quiet(num_slices=2)).fit(sample=sample)


def test_constant_features_give_no_threshold(spark):
    rows = dense(spark, [(i, 1 if i % 2 else -1, [3.0, float(i)]) for i in range(6)])
    assert binning.collect_thresholds(binning.thresholds(binning.to_long(rows), 3))[0] == []


@pytest.mark.parametrize("stop", [1, 3, 5])
def test_a_resumed_run_equals_an_unbroken_one(spark, tmp_path, stop):
    """Ended after some batches, with windows half full, a deepening and resamples before or after the break."""
    pool = dense(spark, random_rows(300))
    options = dict(sample_frac=0.7, num_slices=4, candidate_size=6, admit_size=2, improve=0.02, improve_window=3, seed=5)
    whole = Trainer(spark, _quiet(max_iters=8, output=str(tmp_path / "whole"), **options)).fit(pool)
    Trainer(spark, _quiet(max_iters=stop, output=str(tmp_path / "broken"), strict_max_iters=False, **options)).fit(pool)
    rest = Trainer(spark, _quiet(max_iters=8, output=str(tmp_path / "broken"), **options)).fit(pool, resume=True)
    _same(rest.nodes, whole.nodes)
    assert (rest.depth, rest.last_resample) == (whole.depth, whole.last_resample)
    assert [(h["batch"], h["iteration"], h["event"], h["n_nodes"]) for h in rest.history] == [
        (h["batch"], h["iteration"], h["event"], h["n_nodes"]) for h in whole.history]
    tables = [store.load_history(spark, str(tmp_path / name / "history")) for name in ("whole", "broken")]
    assert len(tables[0]) == len(tables[1]) == len(whole.history)
    assert all(a["train_avg"] == pytest.approx(b["train_avg"]) for a, b in zip(*tables, strict=True))


def test_nothing_to_resume_and_stale_tables(spark, tmp_path):
    pool, folder = dense(spark, random_rows(200)), str(tmp_path / "run")
    params = _quiet(sample_frac=0.7, num_slices=4, max_iters=4, candidate_size=6, admit_size=2, pr_every=2, output=folder)
    first = Trainer(spark, params).fit(pool, resume=True)
    curves = spark.read.parquet(os.path.join(folder, "pr_curve")).count()
    params.max_iters = 2
    again = Trainer(spark, params).fit(pool)
    assert again.nodes == first.nodes[:3]
    history = spark.read.parquet(os.path.join(folder, "history"))
    assert history.count() == 3 and history.agg({"batch": "max"}).first()[0] == 1
    assert 0 < spark.read.parquet(os.path.join(folder, "pr_curve")).count() < curves
    assert store.load_progress(spark, os.path.join(folder, "progress"))["iteration"] == 2


def test_candidate_sums_by_blocks(spark):
    """More candidates than a block holds, under weights that no function of this package made."""
    data = random_rows(80)
    rows = dense(spark, data).withColumn("is_train", F.lit(True))
    built = state.rebuild_state(rows, MODEL).withColumn("w", 1.0 / (1 + F.col("row_id")))
    candidates = [Candidate(p, f, cut + 0.5, side) for p in (0, 1, 3) for f in range(4) for cut in range(13) for side in (True, False)]
    assert len(candidates) > learner.CANDIDATE_BLOCK
    found = {r["i"]: r for r in learner.candidate_sums(built, candidates).collect()}
    for i, c in enumerate(candidates):
        members = [(k, y) for k, y, x in data if fires(MODEL, x)[c.parent_id] and (x[c.feature] <= c.threshold) == c.split_eval]
        assert found[i]["n_pos"] == sum(y > 0 for _, y in members) and found[i]["n_neg"] == sum(y < 0 for _, y in members)
        assert found[i]["w_pos"] == pytest.approx(sum(1 / (1 + k) for k, y in members if y > 0))
        assert found[i]["w_neg"] == pytest.approx(sum(1 / (1 + k) for k, y in members if y < 0))
    assert learner.candidate_sums(built, []).collect() == []


def test_searcher_knows_the_run(spark):
    """A searcher that looks one feature at a time by depth, under the loss it is handed."""
    seen = []

    def searcher(rows, cuts, k, context):
        seen.append((len(context.nodes), context.depth, context.loss))
        return learner.search(rows, cuts, k, context.loss, features=[context.depth - 1])

    def gini(rej, pos, neg):
        return F.try_divide(rej, rej + pos + neg) + F.try_divide(4 * pos * neg, (pos + neg) * (rej + pos + neg))

    sample = dense(spark, random_rows(120)).withColumn("is_train", F.lit(True))
    params = _quiet(num_slices=4, max_iters=4, candidate_size=6, admit_size=2, improve=0.9, improve_window=3)
    result = Trainer(spark, params, loss=gini, searcher=searcher).fit(sample=sample)
    assert seen == [(1, 1, gini), (3, 2, gini)]
    assert [n.feature for n in result.nodes] == [-1, 0, 0, 1, 1]
