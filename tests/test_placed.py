"""Rows numbered and drawn where they are read: against plain running totals, for any splits, and without moving the pool."""

import math
import random

import pytest
from pyspark.sql import functions as F

from alttree.operators import placed, sampling
from alttree.operators.scoring import score
from tests.helpers import MODEL, random_rows, score_of

OPTION = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get(OPTION)
    spark.conf.set(OPTION, "2k")
    yield
    spark.conf.set(OPTION, before)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """A pool over several files of several row groups each; ids follow the files' order."""
    path = str(tmp_path_factory.mktemp("pool") / "rows")
    rows = [(i, y, x, "w" * 50) for i, y, x in random_rows(3000)]
    df = spark.createDataFrame(rows, "row_id long, y int, features array<double>, wide string")
    df.repartitionByRange(3, "row_id").sortWithinPartitions("row_id").write.option("parquet.block.size", 4096).option(
        "parquet.page.row.count.limit", 100).parquet(path)
    return path


def plainly(rows, frac, share):
    """Copies of each row by one running total over all rows in order."""
    w = [(i, y, math.exp(-y * score_of(MODEL, x))) for i, y, x in rows]
    pos, neg = sum(v for _, y, v in w if y > 0), sum(v for _, y, v in w if y <= 0)
    segment = 2 * pos * neg / (pos + neg) / math.ceil(len(w) * frac)
    out, total = {}, 0.0
    for i, y, v in w:
        after = total + (neg if y > 0 else pos) / (pos + neg) * v
        n = math.floor((after - share * segment) / segment) - math.floor((total - share * segment) / segment)
        if n:
            out[i] = n
        total = after
    return out


def counts(df):
    return {r.row_id: r["count"] for r in df.groupBy("row_id").count().collect()}


def test_draws_equal_one_running_total(spark, files, small_splits):
    pool = spark.read.parquet(files)
    assert len(placed.starts(placed.located(pool)).before) > 3
    for frac, share in ((0.1, 0.5), (2.5, 0.013)):
        out = sampling.resample(pool, MODEL, frac, seed=1, offset_share=share)
        assert out.columns == [*pool.columns, "copy", "is_train"]
        assert counts(out) == plainly(random_rows(3000), frac, share)


def test_draws_do_not_depend_on_the_splits(spark, files, small_splits):
    small = counts(sampling.resample(spark.read.parquet(files), MODEL, 0.3, seed=4))
    spark.conf.set(OPTION, "128m")
    assert counts(sampling.resample(spark.read.parquet(files), MODEL, 0.3, seed=4)) == small


def test_changed_splits_are_noticed(spark, files, small_splits):
    out = sampling.resample(spark.read.parquet(files), MODEL, 0.3, seed=4)
    spark.conf.set(OPTION, "3k")
    with pytest.raises(Exception, match="not those that were counted"):
        out.count()


def shuffles_above_scan(df):
    """Exchanges of the physical plan that lie above a scan without a filter on drawn rows between."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    found, scans = 0, 0
    for k, line in enumerate(lines):
        if "FileScan" in line:
            scans += 1
            above = [x for x in lines[:k] if "Exchange" in x or "Filter" in x]
            found += bool(above) and "Exchange" in above[-1]
    assert scans
    return found


def test_only_drawn_rows_are_moved(spark, files):
    pool = spark.read.parquet(files)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        assert shuffles_above_scan(sampling.resample(pool, MODEL, 0.1, seed=1)) == 0
        assert shuffles_above_scan(sampling.stratified_draw(pool, 50)) == 0
    finally:
        spark.conf.set(threshold, before)


def test_stratified_draws_in_place_and_joined_are_the_same(spark, files, small_splits, monkeypatch):
    pool = spark.read.parquet(files).select("row_id", "y", "wide")
    here = sorted(map(tuple, sampling.stratified_draw(pool, 400, seed=5).collect()))
    monkeypatch.setattr(sampling, "MAX_PICKS", 0)
    assert sorted(map(tuple, sampling.stratified_draw(pool, 400, seed=5).select("row_id", "y", "wide", "draw").collect())) == here
    assert len(here) == 800
    one_class = sampling.stratified_draw(pool.where("y > 0"), 10)
    assert {r.y for r in one_class.collect()} == {1}


def test_numbers_are_dense_and_in_order(spark, files, small_splits):
    numbered = placed.row_number(placed.located(spark.read.parquet(files)), "place")
    assert all(r.row_id == r.place for r in numbered.collect()) and numbered.count() == 3000
    kept = placed.row_number(placed.located(spark.read.parquet(files).where("row_id % 3 = 1")), "place")
    assert sorted((r.place, r.row_id) for r in kept.collect()) == [(k, 3 * k + 1) for k in range(1000)]


def test_pools_that_are_not_files_are_written_once(spark, files):
    pool = spark.read.parquet(files)
    assert placed.read_in_order(score(pool.where("y > 0"), MODEL).withColumn("z", F.lit(1)))
    for other in (pool.repartition(4), pool.orderBy("y"), pool.join(pool.select("row_id"), "row_id"), spark.range(3), pool.limit(5)):
        assert not placed.read_in_order(other)
    rnd = random.Random(1)
    mixed = spark.createDataFrame(rnd.sample(random_rows(200), 200), "row_id long, y int, features array<double>").repartition(5)
    out = sampling.resample(mixed, MODEL, 0.5, seed=2)
    assert abs(out.count() - 100) <= 1 and counts(out) == counts(out)


def test_empty_and_one_class_pools(spark, files):
    pool = spark.read.parquet(files)
    with pytest.raises(ValueError, match="one class"):
        sampling.resample(pool.where("y > 0"), MODEL, 0.1)
    assert sampling.stratified_draw(pool.where("y > 5"), 10).count() == 0
