"""Hand-checkable examples."""

import math

import pytest
from pyspark.sql import functions as F

from alttree.functions import exprs
from alttree.operators import binning, learner, metrics, sampling, state
from alttree.plans import history
from alttree.plans.trainer import Overfit, Underfit, rollback, root_node
from alttree.schema import Candidate, Node
from helpers import GOLDEN, golden_rows


def _cuts(spark, slices):
    return binning.collect_thresholds(binning.thresholds(binning.to_long(golden_rows(spark)), slices))


@pytest.mark.parametrize("buckets", [1, 3])
def test_thresholds(spark, buckets):
    long = binning.to_long(golden_rows(spark))

    def cuts(slices):
        return binning.collect_thresholds(binning.thresholds(long, slices, buckets))

    assert cuts(4) == [[0.5], [1.5, 2.5, 3.5, 4.5]]
    assert cuts(2) == [[0.5], [1.5, 3.5]]
    assert cuts(1) == []


TABLE = [
    # feature, threshold, at most, pos, neg, loss, loss with the left side's rows rejected too, pred
    (0, 0.5, True, 2.449490, 1.632993, 0.991582, 0.994058, 0.202733),
    (0, 0.5, False, 2.449490, 3.265986, 0.994017, 0.994017, -0.143841),
    (1, 1.5, True, 2.449490, 0, 0.750000, 0.800000, 1.151293),
    (1, 1.5, False, 2.449490, 4.898979, 0.957107, 0.957107, -0.346574),
    (1, 2.5, True, 4.898979, 0, 0.500000, 0.666667, 1.151293),
    (1, 2.5, False, 0, 4.898979, 0.500000, 0.500000, -1.151293),
    (1, 3.5, True, 4.898979, 1.632993, 0.910684, 0.946410, 0.549306),
    (1, 3.5, False, 0, 3.265986, 0.666667, 0.666667, -1.151293),
    (1, 4.5, True, 4.898979, 3.265986, 0.983163, 0.990816, 0.202733),
    (1, 4.5, False, 0, 1.632993, 0.833333, 0.833333, -1.151293),
]


def test_one_round(spark):
    root = root_node(4, 6)
    assert root.pred == pytest.approx(-0.202733, abs=1e-6)
    cuts = _cuts(spark, 4)
    st = state.rebuild_state(binning.bin_rows(golden_rows(spark), cuts), [root]).persist()
    total = st.agg(F.sum("w")).first()[0]
    assert total == pytest.approx(9.797959, abs=1e-6)
    cum = learner.cumulative_slots(learner.split_histogram(st), state.node_totals(st), cuts)
    for compat, column in ((False, 5), (True, 6)):
        found = {(r.feature, r.threshold, r.split_eval): r for r in learner.split_scores(cum, compat_left_reject=compat).collect()}
        assert len(found) == len(TABLE)
        for f, thr, ev, pos, neg, *losses, pred in TABLE:
            r = found[f, thr, ev]
            assert (r.pos, r.neg, r.pred) == pytest.approx((pos, neg, pred), abs=1e-6)
            assert r.z == pytest.approx(losses[column - 5], abs=1e-6)
    best = learner.search(st, cuts, 1).first()
    assert (best.feature, best.threshold, best.split_eval) == (1, 2.5, True)

    rescored = learner.reevaluate(st, [Candidate(0, f, t, e) for f, t, e, *_ in TABLE]).orderBy("i").collect()
    for r, row in zip(rescored, TABLE):
        assert (r.w_pos, r.w_neg, r.z, r.pred) == pytest.approx((*row[3:6], row[7]), abs=1e-6)

    child = Node(1, 0, 1, 1, 2.5, True, best.pred)
    after = state.apply_node(st, child)
    w = {r.y: r.w for r in after.select("y", "w").distinct().collect()}
    assert w[1] == pytest.approx(0.387298, abs=1e-6) and w[-1] == pytest.approx(0.816497, abs=1e-6)
    loss = metrics.exp_loss(after.select("y", F.col("delta").alias("score"))).first().sum_loss
    assert after.agg(F.sum("w")).first()[0] == pytest.approx(loss) == pytest.approx(6.448173, abs=1e-6)
    eff = metrics.effective_count(after).first()
    assert tuple(eff) == pytest.approx((0.903890, 1.0, 1.0), abs=1e-6)
    st.unpersist()


def test_systematic_copies(spark):
    scaled = spark.createDataFrame([(i, float(i)) for i in (1, 2, 3, 4)], "row_id long, ws double")
    plan = sampling.SamplePlan(5, 2.0, 0.5)
    for buckets in (1, 2, 4):
        copies = sampling.systematic_copies(scaled, plan, buckets).orderBy("row_id").collect()
        assert [r.copies for r in copies] == [1, 1, 1, 2]


def test_overfit_rule():
    rule = Overfit(3)
    assert [rule.push(a) for a in (0.90, 0.80, 0.85, 0.83)] == [False, False, False, True]
    nodes = list(range(10))
    assert rollback(nodes, len(rule.scores)) == list(range(8))


def test_underfit_rule():
    rule = Underfit(3, 0.01)
    assert [rule.push(a) for a in (0.900, 0.890, 0.888, 0.887)] == [False, False, False, True]
    flat = Underfit(2, 0.0)
    assert [flat.push(a) for a in (0.9, 0.89, 0.89)] == [False, False, True]


@pytest.mark.parametrize("buckets", [1, 3])
def test_history_rules_match(spark, buckets):
    averages = [(0.900, 0.90), (0.890, 0.80), (0.888, 0.85), (0.887, 0.83), (0.5, 0.7), (0.5, 0.7)]
    rows = [(1, i, a, b, "deepen" if i == 3 else None) for i, (a, b) in enumerate(averages)]
    h = spark.createDataFrame(rows, "run int, iteration long, train_avg double, test_avg double, event string")
    seg = history.number_segments(h, ["run"], buckets)
    under = [r.underfit for r in history.underfit_flags(seg, 3, 0.01, ["run"]).orderBy("iteration").collect()]
    assert under == [False, False, False, True, False, False]
    over = [(r.since_best, r.overfit) for r in history.overfit_flags(seg, 3, ["run"], buckets).orderBy("iteration").collect()]
    assert over == [(1, False), (1, False), (2, False), (3, True), (1, False), (1, False)]


@pytest.mark.parametrize("buckets", [1, 2, 5])
def test_auprc(spark, buckets):
    pairs = [(0.9, 1), (0.9, -1), (0.7, 1), (0.6, -1), (0.5, 1), (0.1, -1)]
    scored = spark.createDataFrame(pairs, "score double, y int")
    assert metrics.auprc(scored, buckets=buckets).first()[0] == pytest.approx(0.544444, abs=1e-6)
    points = metrics.pr_curve(scored, buckets=buckets).orderBy(F.desc("score")).collect()
    assert [round(p.recall, 4) for p in points] == [0.3333, 0.6667, 0.6667, 1.0, 1.0]
    grouped = scored.withColumn("g", F.lit(1)).unionByName(scored.withColumn("g", F.lit(2)))
    assert {round(r.auprc, 6) for r in metrics.auprc(grouped, ["g"], buckets).collect()} == {0.544444}


def test_auprc_equals_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rows = [((i * 37 % 101) / 10, 1 if i % 3 == 0 or i % 7 == 1 else -1) for i in range(400)]
    scored = spark.createDataFrame(rows, "score double, y int")
    ml = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderPR", numBins=0)
    expected = ml.evaluate(scored.withColumn("label", ((F.col("y") + 1) / 2)))
    assert metrics.auprc(scored).first()[0] == pytest.approx(expected, abs=1e-9)


def test_tolerant_check(spark):
    df = spark.createDataFrame([(1.0 + 5e-9,), (1.0 + 2e-8,), (float("nan"),)], "x double")
    got = df.select(exprs.check(F.col("x"), 0, 1.0, True).alias("ok"), exprs.compare(F.col("x"), 1.0).alias("c")).collect()
    assert [r.ok for r in got] == [True, False, True]
    assert [r.c for r in got] == [0, 1, 0]


def test_safe_log_ratio_edges(spark):
    cases = [((0.0, 0.0), 0.0), ((1.0, 0.0), math.log(10)), ((0.0, 1.0), math.log(0.1)), ((3.0, 2.0), math.log(1.5)), ((1.0, 1e-9), math.log(10))]
    df = spark.createDataFrame([c[0] for c in cases], "a double, b double")
    got = [r[0] for r in df.select(exprs.safe_log_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([c[1] for c in cases])
    zero = df.select(exprs.boost_loss(F.lit(0.0), F.lit(0.0), F.lit(0.0))).first()[0]
    assert zero is None


def test_golden_fixture_is_complete():
    assert sum(y > 0 for _, y, _ in GOLDEN) == 4
