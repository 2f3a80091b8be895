"""Values at given ranks, per group, without ordering what lies between them.

Values are counted per range, the ranges that hold a wanted rank become groups of their own, and so on until every
group is small; only then are values ordered, those of the groups that are left. The driver keeps the wanted ranks and
the counts per range of the groups that hold them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alttree.functions.arrays import cut_index, lower_bound

SMALL = 50_000
RANGES = 64
COMPILED = 256  # cuts in one plan that are spelled out as compiled conditions


class Part(NamedTuple):
    """A stretch of a group's values: the group, how many values lie below, and the ranks wanted in it."""

    group: int
    below: int
    wanted: list[int]


def sizes_and_cuts(values: DataFrame, key: str, ranges: int) -> dict[int, tuple[int, list[float]]]:
    """Count and approximate quantiles of each group's values, from mergeable sketches."""
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    sketch = F.percentile_approx("value", shares, 20 * ranges)
    rows = values.groupBy(key).agg(F.count("*").alias("n"), sketch.alias("cuts")).collect()
    return {r[key]: (r["n"], sorted(set(r["cuts"]))) for r in rows}


def _refine(values: DataFrame, parts: list[Part], cuts: list[list[float]]) -> tuple[DataFrame, list[Part], list[int]]:
    """Cut the parts into ranges and keep the ranges that hold a wanted rank, as new parts with their sizes."""
    spark = values.sparkSession
    if sum(map(len, cuts)) <= COMPILED:
        place = F.lit(0)
        for k, c in enumerate(cuts):
            if c:
                place = F.when(F.col("part") == k, cut_index(c, F.col("value"))).otherwise(place)
        ranged = values.withColumn("range", place)
    else:
        # a record per part, at most one for each wanted rank
        edges = spark.createDataFrame(list(enumerate(cuts)), "part int, cuts array<double>")
        most = max(map(len, cuts))
        ranged = values.join(F.broadcast(edges), "part").withColumn("range", lower_bound(F.col("cuts"), F.col("value"), most)).drop("cuts")
    counts = {(r["part"], r["range"]): r["n"] for r in ranged.groupBy("part", "range").agg(F.count("*").alias("n")).collect()}
    kept, sizes, renamed = [], [], []
    for k, p in enumerate(parts):
        below, wanted = p.below, list(p.wanted)
        for i in range(len(cuts[k]) + 1):
            n = counts.get((k, i), 0)
            here = [w for w in wanted if below < w <= below + n]
            if here:
                renamed.append((k, i, len(kept)))
                kept.append(Part(p.group, below, here))
                sizes.append(n)
            below += n
    names = spark.createDataFrame(renamed, "part int, range int, next int")
    return ranged.join(F.broadcast(names), ["part", "range"]).select(F.col("next").alias("part"), "value"), kept, sizes


def values_at(values: DataFrame, found: dict[int, tuple[int, list[float]]], wanted: dict[int, list[int]], ranges: int = RANGES, small: int = SMALL) -> dict[tuple[int, int], float]:
    """{(group, rank): value} for the wanted 1-based ranks, smallest first. `values`: (group, value) without repeats, settled.

    found: what `sizes_and_cuts` says about each group.
    """
    spark = values.sparkSession
    groups = sorted(g for g, w in wanted.items() if w)
    if not groups:
        return {}
    parts, sizes = [Part(g, 0, wanted[g]) for g in groups], [found[g][0] for g in groups]
    named = spark.createDataFrame(list(zip(groups, range(len(groups)), strict=True)), "group int, part int")
    current = values.join(F.broadcast(named), "group").select("part", "value")
    cuts = [found[g][1] for g in groups]
    while max(sizes) > small and ranges > 1:
        before = sum(sizes)
        current, parts, sizes = _refine(current, parts, [c if n > small else [] for c, n in zip(cuts, sizes, strict=True)])
        if max(sizes) <= small or sum(sizes) == before:
            break
        again = sizes_and_cuts(current, "part", ranges)
        cuts = [again[k][1] for k in range(len(parts))]
    rank = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    asked = spark.createDataFrame([(k, w - p.below) for k, p in enumerate(parts) for w in p.wanted], "part int, rank int")
    rows = current.withColumn("rank", rank).join(F.broadcast(asked), ["part", "rank"]).collect()
    return {(parts[r["part"]].group, parts[r["part"]].below + r["rank"]): r["value"] for r in rows}
