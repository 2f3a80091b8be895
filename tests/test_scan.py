"""Range-wise scans against the plain definition."""

import random

import pytest
from pyspark.sql import functions as F

from alttree.functions.arrays import constant, cut_index, lower_bound
from alttree.operators import sampling, scan


def _table(n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        group = 0 if rnd.random() < 0.5 else rnd.randrange(5)
        v = None if rnd.random() < 0.2 else float(rnd.randrange(-50, 50))
        rows.append((group, i * 3 + (i % 2), v))
    rnd.shuffle(rows)
    return rows


def _expected(rows, by, descending):
    out = {}
    groups = {}
    for g, k, v in rows:
        groups.setdefault(g if by else None, []).append((k, v))
    for g, items in groups.items():
        total, low, last, n = 0.0, None, None, 0
        for k, v in sorted(items, reverse=descending):
            before = n
            n += 1
            if v is not None:
                total += v
                low = v if low is None else min(low, v)
                last = v
            out[k] = (total, low, last, before)
    return out


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("buckets,once", [(1, False), (7, False), (7, True), (90, False)])
def test_prefix_scan(spark, by, descending, buckets, once):
    rows = _table()
    df = spark.createDataFrame(rows, "g int, k long, v double").withColumn("one", F.lit(1).cast("long"))
    scans = {"total": ("sum", "v"), "low": ("min", "v"), "last": ("last", "v"), "before": ("sum", "one", True)}
    out = scan.prefix_scan(df.repartition(5), "k", scans, by=by, descending=descending, buckets=buckets, once=once)
    expected = _expected(rows, by, descending)
    got = {r.k: (r.total or 0.0, r.low, r.last, r.before) for r in out.collect()}
    assert got == expected


def test_dense_row_id(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "k").repartition(6)
    out = scan.dense_row_id(df, "k", buckets=9).orderBy("k").collect()
    assert [r.row_id for r in out] == list(range(len(out)))


@pytest.mark.parametrize("n", [0, 1, 5, 64, 65, 200])
def test_cut_index(spark, n):
    cuts = [i * 1.5 for i in range(n)]
    xs = [-1.0, 0.0, 0.1, 1.5, 7.5, 7.6, 150.0, 1e9]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    expected = [sum(c < x for c in cuts) for x in xs]
    assert [r[0] for r in df.select(cut_index(cuts, F.col("x"))).collect()] == expected
    searched = lower_bound(constant(cuts, "array<double>"), F.col("x"), n)
    assert [r[0] for r in df.select(searched).collect()] == expected


def test_sample_size_and_balance(spark):
    rnd = random.Random(3)
    rows = [(i, 1 if rnd.random() < 0.1 else -1, rnd.random() * 3) for i in range(2000)]
    weighted = spark.createDataFrame(rows, "row_id long, y int, w double")
    balance = sampling.balance_of(weighted)
    plan = sampling.sample_plan(balance, 0.3, seed=4)
    assert 0 <= plan.offset < plan.segment
    out = sampling.systematic_sample(weighted, weighted, plan, balance, buckets=5)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert abs(sum(counts.values()) - plan.size) <= 1
    # interleaved rows: either class holds half the scaled weight
    assert abs(counts[1] - counts[-1]) < 0.1 * plan.size
    again = sampling.systematic_sample(weighted.repartition(7), weighted.repartition(3), plan, balance, buckets=5)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_hot_row_is_copied_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(sampling, "COPY_CHUNK", 7)
    rows = [(0, 1, 1000.0), (1, 1, 1.0), (2, -1, 5.0), (3, -1, 5.0)]
    weighted = spark.createDataFrame(rows, "row_id long, y int, w double")
    balance = sampling.balance_of(weighted)
    plan = sampling.SamplePlan(100, balance.scaled_total / 100, 0.0)
    out = sampling.systematic_sample(weighted, weighted, plan, balance)
    hot = sorted(r.copy for r in out.where("row_id = 0").collect())
    assert hot == list(range(1, len(hot) + 1)) and len(hot) in (49, 50)


def test_one_class_pool_is_refused(spark):
    with pytest.raises(ValueError):
        sampling.balance_of(spark.createDataFrame([(1, 1, 1.0)], "row_id long, y int, w double"))


def test_split_by_row_keeps_copies_together(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("copy"))
    train, test = sampling.hash_split(df, "row")
    assert not set(r.row_id for r in train.collect()) & set(r.row_id for r in test.collect())
    train, test = sampling.hash_split(df, "copy", seed=2)
    assert train.count() + test.count() == 2000 and 1300 < train.count() < 1700


def test_stratified_draw(spark):
    rows = spark.range(100).select(F.col("id").alias("row_id"), F.when(F.col("id") % 4 == 0, 1).otherwise(-1).alias("y"))
    out = sampling.stratified_draw(rows, 60, seed=1)
    assert {r.y: r["count"] for r in out.groupBy("y").count().collect()} == {1: 60, -1: 60}


def test_neighbouring_seeds_give_unrelated_splits(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "row_id")
    flags = rows.select(*[sampling.train_flag(seed=s).alias(f"s{s}") for s in (0, 1, 2)], (sampling.row_hash("row_id", seed=0) < 2**30).alias("half"))
    shares = flags.agg(*[F.avg(c.cast("double")) for c in (
        F.col("s0"), F.col("s0") == F.col("s1"), F.col("s1") == F.col("s2"), F.col("s0") == F.col("half"))]).first()
    assert shares[0] == pytest.approx(0.75, abs=0.02)
    assert shares[1] == pytest.approx(0.625, abs=0.03) and shares[2] == pytest.approx(0.625, abs=0.03)  # p^2 + (1 - p)^2
    assert shares[3] == pytest.approx(0.5, abs=0.03)


def test_held_out_share_is_not_rounded(spark):
    rows = spark.range(100_000).withColumnRenamed("id", "row_id")
    _, test = sampling.hash_split(rows, portion=0.995)
    assert 350 < test.count() < 650
