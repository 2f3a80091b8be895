"""Scores, state and metrics as properties."""

import math

import pytest
from pyspark.sql import functions as F

from alttree.operators import binning, learner, metrics, scoring, state
from alttree.schema import Candidate, Node
from helpers import MODEL, dense, fires, onehot, random_onehot, random_rows, score_of

ONEHOT_MODEL = [
    Node(0, -1, 0, -1, 0.0, True, 0.1), Node(1, 0, 1, 3, 0.5, False, 0.5), Node(2, 0, 1, 7, 0.5, True, -0.4),
    Node(3, 1, 2, 9, 0.5, True, 0.2), Node(4, 2, 2, 19, 0.5, False, 0.3),
]


def test_three_forms_agree(spark):
    data = random_rows()
    rows = dense(spark, data)
    expected = {i: score_of(MODEL, x) for i, _, x in data}
    forms = [
        scoring.score(rows, MODEL).select("row_id", "score"),
        rows.select("row_id", scoring.score_expression(rows, MODEL).alias("score")),
        scoring.score_relational(binning.to_long(rows), MODEL),
        scoring.score(rows.repartition(7), MODEL).select("row_id", "score"),
    ]
    for form in forms:
        got = {r.row_id: r.score for r in form.collect()}
        assert got == pytest.approx(expected, abs=1e-12)


def test_onehot_scores(spark):
    data = random_onehot()
    rows = onehot(spark, data)
    expected = {i: score_of(ONEHOT_MODEL, [float(f in nz) for f in range(20)]) for i, _, nz in data}
    got = {r.row_id: r.score for r in scoring.score(rows, ONEHOT_MODEL).collect()}
    assert got == pytest.approx(expected)
    plain = rows.select("row_id", scoring.score_expression(rows, ONEHOT_MODEL).alias("score"))
    assert {r.row_id: r.score for r in plain.collect()} == pytest.approx(expected)


def test_ragged_rows_read_zero_for_absent_features(spark):
    rows = dense(spark, [(0, 1, [1.0, 9.0, 1.0, 1.0]), (1, 1, [1.0]), (2, -1, [7.0, 1.0])])
    padded = [[1.0, 9.0, 1.0, 1.0], [1.0, 0, 0, 0], [7.0, 1.0, 0, 0]]
    got = [r.score for r in scoring.score(rows, MODEL).orderBy("row_id").collect()]
    assert got == pytest.approx([score_of(MODEL, x) for x in padded])


def test_prefix_scores_telescope(spark):
    data = random_rows()
    rows = dense(spark, data)
    out = scoring.score_delta(rows, MODEL, 3).collect()
    for r in out:
        assert r.score == pytest.approx(r.prefix_score + r.delta)
        assert r.prefix_score == pytest.approx(score_of(MODEL[:3], data[r.row_id][2]))
    staged = {(r.row_id, r.node_id): r.score for r in scoring.staged_scores(rows, MODEL).collect()}
    for i, _, x in data:
        for n in range(len(MODEL)):
            assert staged[i, n] == pytest.approx(score_of(MODEL[: n + 1], x))
    assert {r.score for r in scoring.score(rows, MODEL, 0).collect()} == {0.0}


def test_streaming_rows_are_scored(spark, tmp_path):
    data = random_rows(60)
    rows = dense(spark, data)
    rows.write.parquet(str(tmp_path / "in"))
    stream = scoring.score(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), MODEL)
    q = (stream.select("row_id", "score").writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start())
    q.awaitTermination(60)
    got = {r.row_id: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == pytest.approx({i: score_of(MODEL, x) for i, _, x in data})


@pytest.mark.parametrize("make", ["dense", "onehot"])
def test_state_equals_replay(spark, make):
    if make == "dense":
        rows, nodes = dense(spark, random_rows()), MODEL
    else:
        rows, nodes = onehot(spark, random_onehot()), ONEHOT_MODEL
    for weight_fn in ("adaboost", "logit"):
        built = state.rebuild_state(rows, nodes, last_resample=2, weight_fn=weight_fn)
        step = rows.withColumns({"hits": F.array().cast("array<int>"), "delta": F.lit(0.0), "w": F.lit(1.0)})
        for t in nodes:
            before = step
            step = state.apply_node(before, t, weight_fn)
            if t.node_id < 2:
                step = step.withColumns({"w": F.lit(1.0), "delta": F.lit(0.0)})
        a = {r.row_id: (sorted(r.hits), r.w, r.delta) for r in built.collect()}
        b = {r.row_id: (sorted(r.hits), r.w, r.delta) for r in step.collect()}
        assert a.keys() == b.keys()
        for i in a:
            assert a[i][0] == b[i][0]
            assert a[i][1:] == pytest.approx(b[i][1:])


def test_node_totals_sum_to_the_whole(spark):
    data = random_rows()
    st = state.rebuild_state(dense(spark, data), MODEL)
    total = st.agg(F.sum("w")).first()[0]
    for r in state.node_totals(st).collect():
        assert r.w_pos + r.w_neg + r.w_rej == pytest.approx(total)
        assert r.n_pos + r.n_neg + r.n_rej == len(data)
        assert r.n_pos + r.n_neg == sum(fires(MODEL, x)[r.node_id] for _, _, x in data)
    for r in st.collect():
        for t in MODEL:
            assert t.node_id not in r.hits or t.parent_id < 0 or t.parent_id in r.hits


@pytest.mark.parametrize("make", ["dense", "onehot"])
def test_histogram_forms_agree(spark, make):
    if make == "dense":
        rows, nodes = dense(spark, random_rows()), MODEL
        cuts = binning.collect_thresholds(binning.thresholds(binning.to_long(rows), 5))
        rows, widths = binning.bin_rows(rows, cuts), [len(c) + 1 for c in cuts]
    else:
        rows, nodes = onehot(spark, random_onehot()), ONEHOT_MODEL
        cuts, widths = binning.collect_thresholds(binning.onehot_thresholds(rows, 20, 2)), [2] * 20
    st = state.rebuild_state(rows, nodes, max_depth=2)

    def cells(h):
        return {(r.node_id, r.feature, r.slot): (r.w_pos, r.w_neg, r.n_pos, r.n_neg) for r in h.collect()}

    ids = state.eligible(nodes, 2)
    sql, arrow = cells(learner.split_histogram(st)), cells(learner.split_histogram_arrow(st, ids, widths))
    assert sql.keys() == arrow.keys()
    for k in sql:
        assert sql[k] == pytest.approx(arrow[k])

    # the search's statistics are those of the exact re-scoring
    found = learner.search(st, cuts, 12).collect()
    exact = learner.reevaluate(st, [Candidate(r.parent_id, r.feature, r.threshold, r.split_eval) for r in found])
    for a, b in zip(found, exact.orderBy("i").collect()):
        assert (a.z, a.pred) == pytest.approx((b.z, b.pred))


def test_admission_pass_equals_columns(spark):
    rows = dense(spark, random_rows()).withColumn("is_train", F.col("row_id") % 4 != 0)
    st = state.rebuild_state(rows, MODEL, max_depth=2)
    new = [Node(6, 1, 2, 3, 4.5, True, 0.3), Node(7, 0, 1, 2, 6.5, False, -0.2)]
    cands = [Candidate(0, 0, 5.5, True), Candidate(1, 1, 3.5, False), Candidate(2, 3, 8.5, True)]
    current = st
    for t in new:
        current = state.apply_node(current, t, track=False)
    got = {(r.part, r.i): r for r in learner.admission_pass(st, new, cands).collect()}
    for r in learner.candidate_sums(current.where("is_train"), cands).collect():
        g = got[1, r.i]
        assert (g.w_pos, g.w_neg, g.n_pos, g.n_neg) == pytest.approx((r.w_pos, r.w_neg, r.n_pos, r.n_neg))
    for i, cond in ((0, "is_train"), (1, "not is_train")):
        r = current.where(cond).agg(F.sum("w").alias("w"), F.sum(F.col("w") ** 2).alias("sq"), F.count("*").alias("n")).first()
        g = got[0, i]
        assert (g.w_pos + g.w_neg, g.sq_pos + g.sq_neg, g.n_pos + g.n_neg) == pytest.approx((r.w, r.sq, r.n))
    scores = learner.current_scores(st, new).agg(F.sum("score")).first()[0]
    assert scores == pytest.approx(current.agg(F.sum("delta")).first()[0])


def test_metrics_without_a_class_are_null(spark):
    scored = spark.createDataFrame([(0.5, -1), (0.2, -1)], "score double, y int")
    r = metrics.exp_loss(scored).first()
    assert r.avg_loss_pos is None and r.avg_loss == pytest.approx((math.exp(0.5) + math.exp(0.2)) / 2)
    assert metrics.auprc(scored).first()[0] is None
    eff = metrics.effective_count(scored.withColumn("w", F.lit(1.0))).first()
    assert eff.effective == 1.0 and eff.effective_pos is None


@pytest.mark.parametrize("n_cuts", [4, 90])
def test_absent_null_and_nan_values_have_one_meaning(spark, n_cuts):
    """Absent and null are 0, NaN passes every "at most" test; whatever the number of cuts."""
    rows = spark.createDataFrame(
        [(0, 1, [None, 3.0]), (1, 1, [-2.0]), (2, -1, []), (3, -1, [float("nan"), 1.0])], "row_id long, y int, features array<double>")
    cuts = [[-1.0 + k for k in range(n_cuts)], [0.5]]
    bins = {r.row_id: r.bins for r in binning.bin_rows(rows, cuts).collect()}
    assert bins == {0: [1, 1], 1: [0, 0], 2: [1, 0], 3: [0, 1]}
    nodes = [Node(0, -1, 0, -1, 0.0, True, 0.0), Node(1, 0, 1, 0, -1.0, True, 1.0), Node(2, 0, 1, 1, 0.5, False, 10.0)]
    kernel = {r.row_id: r.score for r in scoring.score(rows, nodes).collect()}
    plain = {r.row_id: r.s for r in rows.select("row_id", scoring.score_expression(rows, nodes).alias("s")).collect()}
    assert kernel == plain == {0: 10.0, 1: 1.0, 2: 0.0, 3: 11.0}


def test_nan_makes_no_threshold(spark):
    long = spark.createDataFrame([(k, 0, v) for k, v in enumerate([0.5, 1.5, 2.5, 3.5, float("nan"), None])], "row_id long, feature int, value double")
    found = binning.collect_thresholds(binning.thresholds(long, 5))
    assert found == [[0.25, 1.0, 2.0, 3.0]]


@pytest.mark.parametrize("kind", ["dense", "onehot"])
def test_staged_sums_equal_the_staged_scores(spark, kind):
    """Rows without a label or a set count nowhere; more nodes than rows in a batch change nothing."""
    made = dense(spark, random_rows(90)) if kind == "dense" else onehot(spark, random_onehot(90, 12))
    model = MODEL if kind == "dense" else [MODEL[0], MODEL[1]._replace(feature=3, threshold=0.5), MODEL[2]._replace(feature=7, threshold=0.5)]
    rows = made.withColumns({
        "is_train": F.when(F.col("row_id") % 10 == 4, None).otherwise(F.col("row_id") % 3 != 0),
        "y": F.when(F.col("row_id") % 10 != 7, F.col("y"))})
    staged = scoring.staged_scores(rows.where("y is not null and is_train is not null"), model).collect()
    found = {r["node_id"]: r for r in metrics.staged_metrics(rows, model).collect()}
    assert sorted(found) == [t.node_id for t in model]
    for node_id, r in found.items():
        train = [s for s in staged if s["node_id"] == node_id and s["is_train"]]
        test = [s for s in staged if s["node_id"] == node_id and not s["is_train"]]
        w = [math.exp(-s["y"] * s["score"]) for s in train]
        assert r["train_error"] == pytest.approx(sum(s["y"] * s["score"] <= 1e-8 for s in train) / len(train))
        assert r["test_error"] == pytest.approx(sum(s["y"] * s["score"] <= 1e-8 for s in test) / len(test))
        assert r["sum_w"] == pytest.approx(sum(w)) and r["effective"] == pytest.approx(sum(w) ** 2 / sum(x * x for x in w))
    only_train = metrics.staged_metrics(rows.where("is_train"), model, max_nodes=2).collect()
    assert len(only_train) == 2 and all(r["test_error"] is None for r in only_train)
    assert metrics.staged_metrics(rows.limit(0), model).collect() == []


def test_staged_metrics_keep_no_record_per_row_and_node(spark):
    plan = metrics.staged_metrics(dense(spark, random_rows(20)).withColumn("is_train", F.lit(True)), MODEL)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and "MapInArrow" in text
