"""Histograms from column blocks against the row-wise ones, and training with them."""

import pytest
from pyspark.sql import functions as F

from alttree.operators import binning, blocks, learner, placed, state
from alttree.plans.trainer import Trainer, TrainParams
from helpers import MODEL, dense, onehot, random_onehot, random_rows
from alttree.schema import Node

ONEHOT_MODEL = [Node(0, -1, 0, -1, 0.0, True, -0.3), Node(1, 0, 1, 3, 0.5, False, 0.4), Node(2, 1, 2, 7, 0.5, True, 0.2)]


def placed_rows(rows):
    return placed.row_number(placed.located(rows.repartition(3)), "place").drop(*placed.PLACE)


@pytest.mark.parametrize("make", ["dense", "onehot"])
@pytest.mark.parametrize(("columns", "cells", "rows_per_block"), [(512, 4_000_000, 4096), (3, 4_000_000, 50), (1, 1, 64)])
def test_blocks_give_the_same_sums(spark, monkeypatch, make, columns, cells, rows_per_block):
    monkeypatch.setattr(blocks, "ROWS", rows_per_block)
    if make == "dense":
        rows, nodes, n = placed_rows(dense(spark, random_rows())), MODEL, 4
        cuts = binning.collect_thresholds(binning.thresholds(binning.to_long(rows), 5))
        rows, widths = binning.bin_rows(rows, cuts), [len(c) + 1 for c in cuts]
    else:
        rows, nodes, n, widths = placed_rows(onehot(spark, random_onehot())), ONEHOT_MODEL, 20, [2] * 20
    laid = blocks.lay_out(rows, n, columns)
    st = state.rebuild_state(rows, nodes, max_depth=2).withColumn("is_train", F.col("row_id") % 5 != 0)
    ids = [t.node_id for t in nodes if t.depth < 2]

    def sums(df):
        return {(r.node_id, r.feature, r.slot): (pytest.approx(r.w_pos), pytest.approx(r.w_neg), r.n_pos, r.n_neg) for r in df.collect()}

    for some in (st, st.where("is_train"), st.where("row_id < 7")):
        got = {(r.node_id, r.feature, r.slot): (r.w_pos, r.w_neg, r.n_pos, r.n_neg) for r in blocks.histogram(laid, some, ids, widths, columns, cells).collect()}
        assert got == sums(learner.split_histogram(some))
    assert blocks.histogram(laid, st.where("false"), ids, widths, columns).count() == 0
    laid.unpersist()


@pytest.mark.parametrize("make", ["dense", "onehot"])
def test_training_from_blocks(spark, make):
    pool = dense(spark, random_rows()) if make == "dense" else onehot(spark, random_onehot())
    n_features = None if make == "dense" else 20

    def nodes(histogram):
        p = TrainParams(sample_frac=0.8, num_slices=4, max_iters=4, candidate_size=5, admit_size=2, depth=2, n_features=n_features,
                        histogram=histogram, auprc_every=0, pr_every=0, seed=3)
        return [(*t[:6], round(t.pred, 9)) for t in Trainer(spark, p).fit(pool).nodes]

    assert nodes("blocks") == nodes("arrow")


def test_features_outside_the_layout_are_refused(spark):
    rows = placed_rows(onehot(spark, [(0, 1, [3]), (1, -1, [1])]))
    with pytest.raises(Exception, match="outside"):
        blocks.lay_out(rows, 3).count()
