"""Class-balanced importance resampling of a large pool, and train/test splits."""

from __future__ import annotations

import math
import random
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alttree.functions.exprs import is_pos
from alttree.operators import placed
from alttree.operators.scan import dense_row_id, prefix_scan, ranges_of
from alttree.operators.scoring import score
from alttree.operators.state import WeightFn, weight_function
from alttree.schema import Node

TRAIN_PORTION = 0.75

# Factors of key, copy and seed, the two mixing factors and the modulus of the arithmetic row hash.
HASH_MUL, HASH_ADD, HASH_SEED, HASH_MOD = 1103515245, 12345, 1540483477, 2147483648
# Keeps a split apart from a sample drawn with the same seed.
SPLIT_SEED = 1000003
HASH_MIX = ((15, 739982445), (12, 695872825))


def importance_weights(pool: DataFrame, nodes: list[Node], weight_fn: str | WeightFn = "adaboost") -> DataFrame:
    """Add `w`, the weight the model leaves on every row of the pool."""
    step = weight_function(weight_fn)
    scored = score(pool, nodes, name="_score")
    return scored.withColumn("w", step(F.col("y"), F.lit(1.0), F.col("_score"))).drop("_score")


class Balance(NamedTuple):
    """Pool totals behind a resample."""

    n_rows: int
    w_pos: float
    w_neg: float

    @property
    def pos_scale(self) -> float:
        return self.w_neg / (self.w_pos + self.w_neg)

    @property
    def neg_scale(self) -> float:
        return self.w_pos / (self.w_pos + self.w_neg)

    @property
    def scaled_total(self) -> float:
        return 2 * self.w_pos * self.w_neg / (self.w_pos + self.w_neg)


def class_balance(weighted: DataFrame) -> DataFrame:
    """Row count, class weight sums and the factors that give both classes equal weight."""
    pos = is_pos()
    sums = weighted.agg(
        F.count("*").alias("n_rows"), F.sum(F.when(pos, F.col("w")).otherwise(0.0)).alias("w_pos"),
        F.sum(F.when(pos, 0.0).otherwise(F.col("w"))).alias("w_neg"))
    total = F.col("w_pos") + F.col("w_neg")
    return sums.withColumns({
        "pos_scale": F.try_divide(F.col("w_neg"), total), "neg_scale": F.try_divide(F.col("w_pos"), total),
        "scaled_total": F.try_divide(2 * F.col("w_pos") * F.col("w_neg"), total),
    })


def balance_of(weighted: DataFrame) -> Balance:
    r = class_balance(weighted).first()
    if not r["w_pos"] or not r["w_neg"]:
        raise ValueError("the pool has rows of one class only")
    return Balance(r["n_rows"], r["w_pos"], r["w_neg"])


def scaled_weight(balance: Balance) -> Column:
    return F.when(is_pos(), balance.pos_scale).otherwise(balance.neg_scale) * F.col("w")


class SamplePlan(NamedTuple):
    size: int
    segment: float
    offset: float


def sample_plan(balance: Balance, frac: float, seed: int | None = None, offset_share: float | None = None) -> SamplePlan:
    """Sample size, weight per draw and the single random start within the first draw."""
    size = math.ceil(balance.n_rows * frac)
    segment = balance.scaled_total / size
    share = random.Random(seed).random() if offset_share is None else offset_share
    return SamplePlan(size, segment, share * segment)


def systematic_copies(scaled: DataFrame, plan: SamplePlan, buckets: int | None = None) -> DataFrame:
    """How often every row is drawn: the draws that fall into its stretch of the running weight.

    Input: row_id (unique) and `ws`; only these two columns go through the ordered scan.
    A row's stretch starts at exactly the number the previous row's ended with.
    """
    scans = {"upto": ("sum", "ws"), "before": ("sum", "ws", True)}
    ordered = prefix_scan(scaled.select("row_id", "ws"), "row_id", scans, buckets=buckets)

    def draw(total: str) -> Column:
        return F.floor((F.col(total) - F.lit(plan.offset)) / F.lit(plan.segment))

    return ordered.select("row_id", "ws", (draw("upto") - draw("before")).alias("copies"))


# Copies of one row are made in chunks of this size, so that a row holding a large share
# of the weight is copied by many tasks.
COPY_CHUNK = 10_000


def one_record_per_copy(drawn: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with `copies`, as one record per copy (`copy` counts from 1); a heavy row is copied by many tasks."""
    chunks = drawn.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPY_CHUNK))))
    first = F.col("_chunk") * COPY_CHUNK + 1
    last = F.least(F.col("copies"), F.col("_chunk") * COPY_CHUNK + COPY_CHUNK)
    spread = chunks.repartition("row_id", "_chunk")
    return spread.select(*columns, F.explode(F.sequence(first, last)).alias("copy"))


def systematic_sample(pool: DataFrame, weighted: DataFrame, plan: SamplePlan, balance: Balance, buckets: int | None = None) -> DataFrame:
    """Rows of the pool drawn with replacement in the order of `row_id`, one record per copy.

    The wide pool is joined with the ids that were drawn, which moves it; `draw_in_place` draws in the order of the files.
    """
    buckets = buckets or ranges_of(balance.n_rows)
    scaled = weighted.select("row_id", scaled_weight(balance).alias("ws"))
    drawn = systematic_copies(scaled, plan, buckets).where("copies > 0").select("row_id", "copies")
    return one_record_per_copy(pool.join(drawn, "row_id"), pool.columns)


class PoolWeights(NamedTuple):
    """A pool with its weights `w`, the totals before each of its splits, and their balance."""

    rows: DataFrame
    starts: placed.Starts
    balance: Balance


def pool_weights(pool: DataFrame, nodes: list[Node], weight_fn: str | WeightFn = "adaboost") -> PoolWeights:
    """Score the pool where it is read and add the weights up; only a record per input split is kept."""
    rows = importance_weights(placed.located(pool), nodes, weight_fn)
    found = placed.starts(rows, F.col("w"))
    t = found.total
    if not t.w_pos or not t.w_neg:
        raise ValueError("the pool has rows of one class only")
    return PoolWeights(rows, found, Balance(t.n_pos + t.n_neg, t.w_pos, t.w_neg))


def draw_in_place(weighted: PoolWeights, plan: SamplePlan) -> DataFrame:
    """Rows drawn with replacement by the tasks that read them, one record per copy; the others are moved nowhere."""
    b = weighted.balance
    drawn = placed.draws(weighted.rows, F.col("w"), weighted.starts, b.pos_scale, b.neg_scale, plan.segment, plan.offset)
    columns = [c for c in weighted.rows.columns if c not in (*placed.PLACE, "w")]
    return one_record_per_copy(drawn.where("copies > 0").select(*columns, "copies"), columns)


def row_hash(key: Column | str, copy: Column | int = 1, seed: int = 0) -> Column:
    """Arithmetic hash of (key, copy, seed) in [0, 2^31).

    Two rounds of shift and multiplication follow the sum, so that neighbouring seeds give unrelated hashes.
    """
    key = F.col(key) if isinstance(key, str) else key
    copy = copy if isinstance(copy, Column) else F.lit(copy)
    start = F.pmod(key, F.lit(HASH_MOD)) * HASH_MUL + F.pmod(copy, F.lit(HASH_MOD)) * HASH_ADD
    mixed = F.pmod(start.cast("long") + seed % HASH_MOD * HASH_SEED % HASH_MOD, F.lit(HASH_MOD))
    for shift, factor in HASH_MIX:
        mixed = F.pmod(mixed.bitwiseXOR(F.shiftright(mixed, shift)) * factor, F.lit(HASH_MOD))
    return mixed


def hash_sample(rows: DataFrame, frac: float, seed: int = 0, key: str = "row_id") -> DataFrame:
    """Bernoulli sample without replacement; the same rows on every run and retry."""
    return rows.where(row_hash(key, seed=seed) < round(frac * HASH_MOD))


def train_flag(split_by: str = "row", seed: int = 0, portion: float = TRAIN_PORTION) -> Column:
    """True for the training share. "row" keeps all copies of a row together, "copy" splits copies."""
    if split_by not in ("row", "copy"):
        raise ValueError(f"split_by={split_by!r}")
    copy = F.col("copy") if split_by == "copy" else F.lit(1)
    return row_hash("row_id", copy, seed + SPLIT_SEED) < round(portion * HASH_MOD)


def hash_split(rows: DataFrame, split_by: str = "row", seed: int = 0, portion: float = TRAIN_PORTION) -> tuple[DataFrame, DataFrame]:
    flagged = rows.withColumn("is_train", train_flag(split_by, seed, portion))
    return flagged.where("is_train").drop("is_train"), flagged.where("not is_train").drop("is_train")


def resample(
    pool: DataFrame,
    nodes: list[Node],
    frac: float,
    seed: int | None = None,
    weight_fn: str | WeightFn = "adaboost",
    split_by: str = "row",
    offset_share: float | None = None,
) -> DataFrame:
    """Draw a class-balanced sample where the model is weak; adds `copy` and `is_train`."""
    weighted = pool_weights(pool, nodes, weight_fn)
    plan = sample_plan(weighted.balance, frac, seed, offset_share)
    return draw_in_place(weighted, plan).withColumn("is_train", train_flag(split_by, seed or 0))


# Draws that are broadcast to the tasks that read the rows (16 bytes each); more are joined.
MAX_PICKS = 1 << 21


def stratified_draw(rows: DataFrame, per_class: int, seed: int = 0, buckets: int | None = None) -> DataFrame:
    """Draw `per_class` rows of either class with replacement; adds `draw`.

    Rows are numbered within their class in the order of the files; every draw picks a number by two chained hashes,
    which reach all numbers of classes beyond 2^31 rows too. Up to MAX_PICKS draws go to the tasks that read the rows,
    which emit those that were drawn; more are joined with the rows' numbers.
    """
    spark = rows.sparkSession
    rows = placed.located(rows)
    columns = [c for c in rows.columns if c not in placed.PLACE]
    found = placed.starts(rows)
    sizes = {1: found.total.n_pos, -1: found.total.n_neg}
    draws = spark.range(per_class).select((F.col("id") + 1).alias("draw"), F.explode(F.array(*[F.lit(y) for y, n in sizes.items() if n]).cast("array<int>")).alias("y"))
    high = row_hash("draw", F.col("y") + 2, seed)
    number = high * HASH_MOD + row_hash(high, F.col("y") + 2, seed + 1)
    size = F.when(F.col("y") > 0, sizes[1]).otherwise(sizes[-1])
    picks = draws.select("draw", "y", F.pmod(number, size).alias("_idx"))
    if per_class * 2 <= MAX_PICKS:
        table = picks.orderBy("_idx", "draw").toArrow()
        of = {y: table.filter(pa.compute.equal(table.column("y"), y)) for y in sizes}
        by_class = {y > 0: (t.column("_idx").to_numpy(), t.column("draw").to_numpy()) for y, t in of.items()}
        drawn = placed.picked(rows, found, by_class).where(F.size("draws") > 0)
        return drawn.select(*columns, F.explode("draws").alias("draw"))
    numbered = placed.row_number(rows, "_place")
    ranked = dense_row_id(numbered.select("row_id", F.when(is_pos(), 1).otherwise(-1).alias("_y"), "_place"), "_place", "_idx", by=["_y"], buckets=buckets)
    drawn = ranked.join(picks.withColumnRenamed("y", "_y"), ["_y", "_idx"]).select("row_id", "draw")
    return rows.select(*columns).join(drawn, "row_id")
