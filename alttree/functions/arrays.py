"""Array helpers: sorted-array search, feature access and constant tables inside a plan."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(value, ddl: str) -> Column:
    """A constant array or struct. Spark folds it to one literal while planning.

    For driver-sized data only: thresholds, candidate lists, bucket boundaries.
    """
    return F.from_json(F.lit(json.dumps(value)), ddl)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a costly value once, however often `body` uses it and wherever the optimizer copies it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_bound(sorted_array: Column, x: Column, max_size: int) -> Column:
    """Number of elements below `x`, by halving steps; `max_size` bounds the array's size."""
    if max_size <= 0:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(max_size.bit_length()))]
    size = F.size(sorted_array)

    def advance(pos: Column, step: Column) -> Column:
        fits = (pos + step <= size) & (F.get(sorted_array, pos + step - 1) < x)
        return F.when(fits, pos + step).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


# Up to this many cut points the search is spelled out as nested conditions, which Spark compiles.
SPELLED_OUT = 64


def cut_index(cuts: list[float], x: Column) -> Column:
    """Number of sorted constants below `x`."""
    if len(cuts) > SPELLED_OUT:
        return lower_bound(constant(cuts, "array<double>"), x, len(cuts))

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x > cuts[mid], between(mid + 1, hi)).otherwise(between(lo, mid))

    return between(0, len(cuts))


def dense_value(feature, features="features") -> Column:
    """Feature value of a dense row; 0 when absent. The root's feature -1 reads position 0."""
    index = feature if isinstance(feature, Column) else F.lit(feature)
    return F.coalesce(F.get(F.col(features), F.greatest(index, F.lit(0))), F.lit(0.0))


def onehot_value(feature, nz="nz") -> Column:
    """Feature value of a one-hot row: 1 for the listed ids, 0 for all others."""
    index = feature if isinstance(feature, Column) else F.lit(feature)
    return F.array_contains(F.col(nz), index).cast("double")


def value_of(columns: list[str], feature) -> Column:
    """Pick the right accessor for the layout of the rows."""
    return onehot_value(feature) if "nz" in columns else dense_value(feature)
