"""Values at ranks against sorting, for few and many ranges and groups."""

import random

import pytest

from alttree.operators import binning, ranks
from helpers import thresholds_of


def numbers(seed, groups):
    rnd = random.Random(seed)
    return {g: sorted({rnd.choice([rnd.gauss(0, 1) ** 5, float(rnd.randrange(50)), -1e300 * rnd.random()]) for _ in range(rnd.choice([1, 3, 400, 900]))})
            for g in range(groups)}


@pytest.mark.parametrize(("groups", "ranges", "small"), [(1, 4, 10), (6, 7, 50), (6, 64, 50_000), (60, 20, 30), (3, 1, 5)])
def test_values_at_ranks(spark, groups, ranges, small):
    data = numbers(groups, groups)
    values = spark.createDataFrame([(g, v) for g, vs in data.items() for v in random.Random(1).sample(vs, len(vs))], "group int, value double").repartition(3)
    rnd = random.Random(2)
    wanted = {g: sorted(rnd.sample(range(1, len(vs) + 1), min(len(vs), rnd.randrange(0, 9)))) for g, vs in data.items()}
    found = ranks.sizes_and_cuts(values, "group", ranges)
    got = ranks.values_at(values, found, wanted, ranges, small)
    assert got == {(g, r): data[g][r - 1] for g, rs in wanted.items() for r in rs}


@pytest.mark.parametrize("slices", [1, 2, 7, 100, 10_000])
def test_thresholds_equal_sorting(spark, slices):
    data = numbers(9, 5)
    long = spark.createDataFrame([(i, g, v) for g, vs in data.items() for i, v in enumerate(vs + vs[:5])], "row_id long, feature int, value double")
    got = {}
    for r in binning.thresholds(long, slices, 8).collect():
        got.setdefault(r.feature, []).append((r.slot, r.threshold))
    expected = {g: list(enumerate(thresholds_of(vs, slices))) for g, vs in data.items()}
    assert {g: sorted(c) for g, c in got.items()} == {g: c for g, c in expected.items() if c}


def test_sketch_is_near(spark):
    data = sorted({random.Random(k).gauss(0, 10) for k in range(5000)})
    long = spark.createDataFrame([(i, 0, v) for i, v in enumerate(data)], "row_id long, feature int, value double")
    for slices in (2, 5, 50):
        found = [r.threshold for r in binning.thresholds_sketch(long, slices, 500).orderBy("slot").collect()]
        exact = binning.cut_ranks(5000, slices)
        assert len(found) == len(exact)
        assert all(abs(sum(v <= t for v in data) - r) <= 5000 / 500 + 1 for t, r in zip(found, exact, strict=True))


def test_no_values(spark):
    assert binning.thresholds(spark.createDataFrame([], "row_id long, feature int, value double"), 3).count() == 0


def test_feature_ids_outside_the_layout_are_refused(spark):
    rows = spark.createDataFrame([(0, [1, 5]), (1, [2])], "row_id long, nz array<int>")
    assert {r.feature for r in binning.onehot_thresholds(rows, 6, 2).collect()} == {1, 2, 5}
    with pytest.raises(Exception, match="outside 0..4"):
        binning.onehot_thresholds(rows, 5, 2).collect()
