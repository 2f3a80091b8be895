"""Ordered scans (running sum, running minimum, carry-forward) without a one-task window.

Rows are cut into key ranges. Each range is scanned on its own, range totals are
scanned in a second small pass, and every row then adds what lies before its range.
A hot group is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alttree.functions.arrays import cut_index
from alttree.sources.store import settle

_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)


# A range this long is scanned in one task without strain. Very large tables get longer
# ranges instead of more: their sort spills, while cut points and offsets stay few.
ROWS_PER_RANGE = 500_000
MAX_RANGES = 5_000


def ranges_of(n_rows: int) -> int:
    return min(MAX_RANGES, max(1, -(-n_rows // ROWS_PER_RANGE)))


def ranges_for(settled: DataFrame) -> int:
    """Ranges to cut a settled table into; counting one is cheap."""
    return ranges_of(settled.count())


def range_boundaries(df: DataFrame, key: str, buckets: int) -> list[float]:
    """At most `buckets - 1` cut points that spread the rows evenly over the key's range."""
    if buckets <= 1:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    quantiles = F.percentile_approx(F.col(key).cast("double"), shares, max(10_000, 20 * buckets))
    cuts = df.agg(quantiles.alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))


def with_bucket(df: DataFrame, key: str, boundaries: list[float], name: str = "_bucket") -> DataFrame:
    return df.withColumn(name, cut_index(boundaries, F.col(key).cast("double")))


def _running(op: str, value: Column, window) -> Column:
    if op == "sum":
        return F.sum(value).over(window)
    if op == "min":
        return F.min(value).over(window)
    if op == "max":
        return F.max(value).over(window)
    if op == "last":
        return F.last(value, ignorenulls=True).over(window)
    raise ValueError(f"unknown scan {op!r}")


def _total(op: str, value: Column, running: Column, exact: bool, order: Column) -> Column:
    if op == "min":
        return F.min(value)
    if op == "max":
        return F.max(value)
    if op == "sum" and exact:
        return F.sum(value)
    # Floating sums: take the range's own last running value, so that the next range
    # starts from bit for bit the same number whatever order rows arrive in.
    return F.max_by(running, order)


def _combine(op: str, before: Column, running: Column) -> Column:
    if op == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(running, F.lit(0))
    if op == "min":
        return F.least(before, running)
    if op == "max":
        return F.greatest(before, running)
    return F.coalesce(running, before)


def prefix_scan(
    df: DataFrame,
    key: str,
    scans: dict[str, tuple],
    by: list[str] | None = None,
    descending: bool = False,
    buckets: int | None = None,
    boundaries: list[float] | None = None,
    once: bool = False,
) -> DataFrame:
    """Add running values in `key` order, per group of `by` if given.

    `scans` maps a new column to (sum | min | max | last, value column); a third member
    True leaves the row itself out. Nulls are skipped; the sum of nothing is 0, the other
    scans of nothing are null. `key` must be numeric and unique within a group.

    There are `buckets` ranges (default: as many as shuffle partitions); give 1 only for
    inputs of bounded size. Known `boundaries` spare the pass that finds them. The input
    is read twice, for the rows and for the range totals; with `once` the scanned ranges
    are settled instead, which pays off for inputs that are dear to compute.
    """
    by = by or []
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = df.columns
    if boundaries is None:
        boundaries = range_boundaries(df, key, buckets)
    df = with_bucket(df, key, boundaries)
    order = F.col(key).desc() if descending else F.col(key).asc()
    forward = -F.col(key) if descending else F.col(key)
    inside = Window.partitionBy(*by, "_bucket").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)

    # Scans over the same value share their running column and their range total.
    sources = {(op, value): f"{op}_{value}" for op, value, *_ in scans.values()}
    out = df.withColumns({f"_in_{s}": _running(op, F.col(v), upto) for (op, v), s in sources.items()})
    for name, (op, value, *exclusive) in scans.items():
        if exclusive and exclusive[0]:
            out = out.withColumn(f"_ex_{name}", _running(op, F.col(value), prior))
    if not boundaries:
        found = {name: F.col(f"_ex_{name}" if exclusive and exclusive[0] else f"_in_{op}_{value}")
                 for name, (op, value, *exclusive) in scans.items()}
        starts = {name: F.coalesce(found[name], F.lit(0).cast(types[v])) if op == "sum" else found[name]
                  for name, (op, v, *_) in scans.items()}
        return out.select(*columns, *[c.alias(name) for name, c in starts.items()])
    if once:
        out = settle(out)
    totals = out.groupBy(*by, "_bucket").agg(*[
        _total(op, F.col(v), F.col(f"_in_{s}"), isinstance(types[v], _EXACT), forward).alias(f"_t_{s}")
        for (op, v), s in sources.items()
    ])
    # One row per range (and group): its ordered scan is small by construction.
    ranges = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    earlier = Window.partitionBy(*by).orderBy(ranges).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_bucket", *[_running(op, F.col(f"_t_{s}"), earlier).alias(f"_o_{s}") for (op, _), s in sources.items()])

    results = {}
    for name, (op, value, *exclusive) in scans.items():
        s = sources[op, value]
        if exclusive and exclusive[0]:
            running = F.col(f"_ex_{name}")
        else:
            running = F.col(f"_in_{s}")
        results[name] = _combine(op, F.col(f"_o_{s}"), running).alias(name)
    # Without groups there are at most `buckets` offsets, so that side is bounded.
    joined = out.join(offsets if by else F.broadcast(offsets), [*by, "_bucket"])
    return joined.select(*columns, *results.values())


def prefix_sum(df: DataFrame, key: str, value: str, name: str = "prefix", **options) -> DataFrame:
    return prefix_scan(df, key, {name: ("sum", value)}, **options)


def dense_row_id(df: DataFrame, key: str, name: str = "row_id", by: list[str] | None = None, **options) -> DataFrame:
    """Number rows 0, 1, 2 ... in the order of a unique numeric key, per group if given."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    return prefix_scan(ones, key, {name: ("sum", "_one", True)}, by=by, **options).drop("_one")
