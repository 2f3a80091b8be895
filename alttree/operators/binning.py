"""Long form, split thresholds and slots of feature values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alttree.functions.arrays import SPELLED_OUT, constant, cut_index, let, lower_bound
from alttree.operators.ranks import RANGES, sizes_and_cuts, values_at
from alttree.operators.scan import prefix_scan, ranges_for
from alttree.sources.store import settle, settle_files


def to_long(rows: DataFrame) -> DataFrame:
    """One record per (row, feature) of a dense table."""
    return rows.select("row_id", F.posexplode("features").alias("feature", "value"))


def with_batch(rows: DataFrame, n_rows: int, batches: int = 1) -> DataFrame:
    """Batch number of densely numbered rows; one batch unless asked otherwise."""
    return rows.withColumn("batch_id", F.floor(F.col("row_id") * batches / F.lit(n_rows)).cast("int"))


def distinct_values(long: DataFrame) -> DataFrame:
    return long.select("feature", "value").distinct()


def ranked_values(values: DataFrame, buckets: int | None = None) -> DataFrame:
    """Distinct (feature, value) pairs with their 1-based rank in the feature, smallest first."""
    ones = values.withColumn("_one", F.lit(1).cast("long"))
    return prefix_scan(ones, "value", {"rank": ("sum", "_one")}, by=["feature"], buckets=buckets).drop("_one")


def searchable(long: DataFrame) -> DataFrame:
    """The different values of each feature that cuts can lie between: null is 0, and NaN lies on no side of a cut."""
    return distinct_values(long.withColumn("value", F.coalesce("value", F.lit(0.0))).where(~F.isnan("value")))


def cut_ranks(n: int, num_slices: int) -> list[int]:
    """Ranks, smallest first, below the cuts of n values: every `size`-th from the top, size = max(1, floor(n / num_slices))."""
    size = max(1, n // num_slices)
    return sorted(n - k for k in range(size, n, size))


THRESHOLDS = "feature int, slot int, threshold double"


def thresholds(long: DataFrame, num_slices: int, buckets: int | None = None) -> DataFrame:
    """Midpoints between neighbouring distinct values at every `size`-th rank from the top,

    where size = max(1, floor(distinct / num_slices)). Values are counted by range and ordered only where a cut lies
    (`ranks`); the driver holds the cuts, at most 2 num_slices for a feature.
    """
    if num_slices < 1:
        raise ValueError("num_slices must be positive")
    values = settle_files(searchable(long).select(F.col("feature").alias("group"), "value"), "values")
    found = sizes_and_cuts(values, "group", buckets or RANGES)
    lower = {f: cut_ranks(n, num_slices) for f, (n, _) in found.items()}
    wanted = {f: sorted({w for r in ranks for w in (r, r + 1)}) for f, ranks in lower.items()}
    at = values_at(values, found, wanted, buckets or RANGES)
    rows = [(f, k, 0.5 * (at[f, r] + at[f, r + 1])) for f, ranks in lower.items() for k, r in enumerate(ranks)]
    return long.sparkSession.createDataFrame(rows, THRESHOLDS)


def thresholds_sketch(long: DataFrame, num_slices: int, accuracy: int = 1_000) -> DataFrame:
    """Approximate thresholds from a mergeable quantile sketch per feature; nothing is ordered.

    The sketch answers `accuracy` even shares. A cut is the value of such a share; its rank among the n distinct
    values is off by at most n / accuracy + 1 from the rank below the cut of `thresholds`.
    """
    shares = [k / accuracy for k in range(1, accuracy)]
    # the sketch itself is twice as fine, so that rounding to a share and the sketch's error stay within the bound together
    sketches = searchable(long).groupBy("feature").agg(F.count("*").alias("n"), F.percentile_approx("value", shares, 2 * accuracy).alias("at"))
    rows = []
    for r in sketches.collect():
        ranks = cut_ranks(r["n"], num_slices)
        found = [r["at"][min(max(round(k / r["n"] * accuracy), 1), accuracy - 1) - 1] for k in ranks]
        rows += [(r["feature"], k, v) for k, v in enumerate(sorted(set(found)))]
    return long.sparkSession.createDataFrame(rows, THRESHOLDS)


def onehot_thresholds(rows: DataFrame, n_features: int, num_slices: int) -> DataFrame:
    """A 0/1 feature has the single threshold 0.5 unless it is constant (or one slice is asked)."""
    n_rows = rows.count()
    ones = rows.select(F.explode_outer("nz").alias("feature")).where("feature is not null").groupBy("feature").agg(F.count("*").alias("ones"))
    outside = F.raise_error(F.concat(F.lit(f"a feature id is outside 0..{n_features - 1}: "), F.col("feature").cast("string"))).cast("boolean")
    known = F.when((F.col("feature") >= 0) & (F.col("feature") < n_features), True).otherwise(outside)
    return ones.where(known & (F.col("ones") < n_rows) & F.lit(num_slices >= 2)).select("feature", F.lit(0).alias("slot"), F.lit(0.5).alias("threshold"))


def collect_thresholds(th: DataFrame) -> list[list[float]]:
    """Sorted thresholds per feature id; bounded by features x 2 num_slices."""
    found: dict[int, list[float]] = {}
    for r in th.orderBy("feature", "slot").collect():
        found.setdefault(r["feature"], []).append(r["threshold"])
    return [found.get(f, []) for f in range(max(found, default=-1) + 1)]


def binned_value(x: Column) -> Column:
    """What a value counts as in slots: null is 0, and NaN, which passes every "at most" test, is below all cuts."""
    return F.when(F.isnan(x), float("-inf")).otherwise(F.coalesce(x, F.lit(0.0)))


def slot_of(x: Column, cuts: Column, max_size: int) -> Column:
    """Slot of a value: how many thresholds lie strictly below it."""
    return lower_bound(cuts, x, max_size)


def bin_rows(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """Add `bins`, the slot of every feature that `cuts` lists; an absent or null value is 0.

    Few cuts are spelled out as compiled conditions, more are walked; both give the same slots.
    """
    def value(f: Column) -> Column:
        return binned_value(F.get("features", f))

    if sum(len(c) for c in cuts) <= SPELLED_OUT:
        # a column of its own for each value, so that it is worked out once and not at every comparison
        named = rows.withColumns({f"_v{f}": value(F.lit(f)) for f, c in enumerate(cuts) if c})
        bins = F.array(*[cut_index(c, F.col(f"_v{f}")).cast("smallint") if c else F.lit(0).cast("smallint") for f, c in enumerate(cuts)])
        return named.withColumn("bins", bins).select(*rows.columns, "bins")
    table = constant(cuts, "array<array<double>>")
    widest = max(len(c) for c in cuts)
    bins = F.transform(table, lambda c, f: let(value(f), lambda x: slot_of(x, c, widest)).cast("smallint"))
    return rows.withColumn("bins", bins)


def bin_long(long: DataFrame, th: DataFrame, num_slices: int) -> DataFrame:
    """Add `slot` to long-form values by looking up their feature's thresholds."""
    cuts = th.groupBy("feature").agg(F.array_sort(F.collect_list("threshold")).alias("cuts"))
    empty = F.array().cast("array<double>")
    # one bounded array per feature
    joined = long.join(F.broadcast(cuts), "feature", "left")
    slot = slot_of(binned_value(F.col("value")), F.coalesce("cuts", empty), 2 * num_slices)
    return joined.withColumn("slot", slot).drop("cuts")


def sorted_positions(long: DataFrame, buckets: int | None = None) -> DataFrame:
    """Position of every (value, row) pair in its feature's sorted column.

    The order is value, then row id. Positions are the number of rows with a smaller
    value plus the rank among equal values, both found by range-wise scans.
    """
    per_value = settle(long.groupBy("feature", "value").agg(F.count("*").alias("n_equal")))
    before = prefix_scan(
        per_value, "value", {"_before": ("sum", "n_equal", True)}, by=["feature"], buckets=buckets or ranges_for(per_value))
    ones = long.withColumn("_one", F.lit(1).cast("long"))
    within = prefix_scan(ones, "row_id", {"_within": ("sum", "_one")}, by=["feature", "value"], buckets=buckets)
    joined = within.join(before.select("feature", "value", "_before"), ["feature", "value"])
    return joined.select("feature", "row_id", "value", (F.col("_before") + F.col("_within") - 1).alias("position"))


def active_features(long: DataFrame, features: DataFrame) -> DataFrame:
    """Keep the columns that are searched: those listed in `features`."""
    return long.join(features.select("feature"), "feature", "left_semi")
