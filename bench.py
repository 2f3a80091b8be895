"""Headline timings on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import random
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from alttree.operators import binning, blocks, encode, learner, metrics, placed, sampling, scoring  # noqa: E402
from alttree.operators.state import rebuild_state  # noqa: E402
from alttree.plans.trainer import Trainer, TrainParams  # noqa: E402
from alttree.schema import Candidate, Node  # noqa: E402
from registry.fixtures import documents_letters, table  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def lineitem_rows(spark: SparkSession) -> DataFrame:
    """Positive = returned; five numeric features."""
    li = table(spark, SF_DIR, "lineitem")
    numbers = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    return li.select(
        F.xxhash64(*li.columns).alias("row_id"), F.when(F.col("l_returnflag") == "R", 1).otherwise(-1).alias("y"),
        F.array(*[F.col(c).cast("double") for c in numbers]).alias("features"))


def random_model(n: int, cuts: list[list[float]], seed: int = 1) -> list[Node]:
    """A tree of n nodes over the features that have thresholds."""
    rnd = random.Random(seed)
    usable = [f for f, c in enumerate(cuts) if c]
    nodes = [Node(0, -1, 0, -1, 0.0, True, -0.2)]
    for i in range(1, n):
        parent = nodes[rnd.randrange(max(1, i // 4))]
        f = rnd.choice(usable)
        nodes.append(Node(i, parent.node_id, parent.depth + 1, f, rnd.choice(cuts[f]), rnd.random() < 0.5, rnd.uniform(-0.3, 0.3)))
    return nodes


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    only = set(sys.argv[1:])

    def timed(name, action, needed=False, repeat=2):
        """Best of two runs, so that JVM warm-up is not what is measured."""
        if only and name not in only:
            return action() if needed else None
        for _ in range(repeat):
            start = time.perf_counter()
            out = action()
            took = round(time.perf_counter() - start, 3)
            times[name] = min(took, times.get(name, took))
        return out

    rows = lineitem_rows(spark).repartition(int(CPUS)).persist()
    rows.count()
    long = binning.to_long(rows)
    cuts = timed("thresholds", lambda: binning.collect_thresholds(binning.thresholds(long, 8)), needed=True)
    timed("bin_rows", lambda: run(binning.bin_rows(rows, cuts)))
    binned = binning.bin_rows(rows, cuts).persist()

    model = random_model(20, cuts)
    state = rebuild_state(binned, model, max_depth=3).withColumn("is_train", F.col("row_id") % 4 != 0)
    timed("rebuild_state", lambda: run(state))
    state = state.persist()
    state.count()
    train = state.where("is_train")
    timed("search_round", lambda: learner.search(train, cuts, 100).collect())
    eligible = [t.node_id for t in model if t.depth < 3]
    widths = [len(c) + 1 for c in cuts]
    timed("search_round_arrow", lambda: learner.search(
        train, cuts, 100, histogram=learner.split_histogram_arrow(train, eligible, widths)).collect())
    rnd = random.Random(2)
    candidates = []
    for _ in range(100):
        f = rnd.randrange(len(cuts))
        candidates.append(Candidate(rnd.choice(eligible), f, rnd.choice(cuts[f]), rnd.random() < 0.5))
    timed("reevaluate", lambda: learner.reevaluate(state, candidates).collect())
    timed("admission_pass", lambda: learner.admission_pass(state, [], candidates).collect())

    timed("score_100", lambda: run(scoring.score(rows, random_model(100, cuts))))
    timed("score_1000", lambda: run(scoring.score(rows, random_model(1000, cuts))))
    timed("resample", lambda: run(sampling.resample(lineitem_rows(spark), model, 0.1, seed=3)))
    scored = scoring.score(rows, random_model(100, cuts)).select("y", "score")
    timed("auprc", lambda: metrics.auprc(scored).collect())

    letters = documents_letters(spark, SF_DIR).repartition(int(CPUS)).persist()
    letters.count()
    timed("encode", lambda: run(encode.encode(letters)))
    coded = encode.encode(letters).persist()
    hot_cuts = binning.collect_thresholds(binning.onehot_thresholds(coded, encode.n_features(), 2))
    hot_model = random_model(10, hot_cuts)
    hot_state = rebuild_state(coded, hot_model, max_depth=2).persist()
    hot_state.count()
    hot_ids = [t.node_id for t in hot_model if t.depth < 2]
    timed("onehot_search", lambda: learner.search(hot_state, hot_cuts, 100).collect())
    timed("onehot_search_arrow", lambda: learner.search(hot_state, hot_cuts, 100, histogram=learner.split_histogram_arrow(
        hot_state, hot_ids, [2] * encode.n_features())).collect())

    # a wide dense table: 500 features of 16 values each, from a tenth of the lines
    wide = lineitem_rows(spark).where(F.col("row_id") % 10 == 0).select(
        "row_id", "y", F.transform(F.sequence(F.lit(0), F.lit(499)), lambda k: F.pmod(F.xxhash64("row_id", k), F.lit(16)).cast("double")).alias("features"))
    wide_cuts = [[i + 0.5 for i in range(0, 15, 2)] for _ in range(500)]
    placed_rows = placed.row_number(placed.located(wide), "place").drop(*placed.PLACE)
    wide_rows = binning.bin_rows(placed_rows, wide_cuts).persist()
    wide_model = random_model(10, wide_cuts)
    wide_state = rebuild_state(wide_rows, wide_model, max_depth=2).persist()
    wide_state.count()
    wide_ids, wide_widths = [t.node_id for t in wide_model if t.depth < 2], [9] * 500
    laid = blocks.lay_out(wide_rows, 500)
    laid.count()
    timed("wide_search_blocks", lambda: run(blocks.histogram(laid, wide_state, wide_ids, wide_widths)))
    timed("wide_search_arrow", lambda: run(learner.split_histogram_arrow(wide_state, wide_ids, wide_widths)))

    params = TrainParams(sample_frac=0.2, num_slices=8, max_iters=20, candidate_size=50, admit_size=10, auprc_every=10, pr_every=0)
    timed("train_20", lambda: Trainer(spark, params).fit(lineitem_rows(spark)), repeat=1)
    print(json.dumps({
        "metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
