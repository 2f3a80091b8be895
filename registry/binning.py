"""Long form, thresholds, slots and ordered scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from alttree.operators import binning as b
from alttree.operators import scan
from registry import query
from registry.fixtures import EVT, LONG, R, evt, r6, table

SLICES = 8

THRESHOLDS = f"""d AS (SELECT DISTINCT feature, value FROM long),
r AS (SELECT *, row_number() OVER w AS rn, lead(value) OVER w AS nx, count(*) OVER (PARTITION BY feature) AS n
      FROM d WINDOW w AS (PARTITION BY feature ORDER BY value DESC)),
s AS (SELECT *, greatest(1, CAST(floor(n / {SLICES}) AS INTEGER)) AS sz FROM r),
th AS (SELECT feature, 0.5 * (value + nx) AS threshold,
              CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS INTEGER) AS slot
       FROM s WHERE rn % sz = 0 AND rn < n)"""
SLOTS = """slots AS (
  SELECT l.row_id, l.feature, l.value, CAST(count(t.threshold) AS INTEGER) AS slot
  FROM long l LEFT JOIN th t ON t.feature = l.feature AND t.threshold < l.value
  GROUP BY l.row_id, l.feature, l.value)"""


@query(f"WITH {EVT}, {LONG} SELECT row_id, feature, value FROM long")
def row_to_long(spark, sf):
    return b.to_long(evt(spark, sf))


@query(f"""WITH {EVT}, n AS (SELECT count(*) AS n FROM evt)
SELECT row_id, CAST(floor((row_number() OVER (ORDER BY row_id) - 1) * 4 / n) AS INTEGER) AS batch_id FROM evt, n""")
def batch_assign(spark, sf):
    rows = scan.dense_row_id(evt(spark, sf).withColumnRenamed("row_id", "key"), "key")
    return b.with_batch(rows, rows.count(), 4).select(F.col("key").alias("row_id"), "batch_id")


@query(f"""WITH {EVT}, {LONG}
SELECT feature, row_id, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY value, row_id) - 1 AS BIGINT) AS position
FROM long""")
def feature_sorted_lists(spark, sf):
    return b.sorted_positions(b.to_long(evt(spark, sf)))


@query(f"WITH {EVT}, {LONG} SELECT DISTINCT feature, value FROM long")
def distinct_values(spark, sf):
    return b.distinct_values(b.to_long(evt(spark, sf)))


@query(f"WITH {EVT}, {LONG}, {THRESHOLDS} SELECT feature, slot, {R('threshold')} AS threshold FROM th")
def thresholds(spark, sf):
    th = b.thresholds(b.to_long(evt(spark, sf)), SLICES)
    return th.select("feature", "slot", r6("threshold").alias("threshold"))


@query(f"WITH {EVT}, {LONG}, {THRESHOLDS} SELECT feature, slot, TRUE AS close FROM th")
def thresholds_sketch(spark, sf):
    """Cuts from sketches: is each as far up among the distinct values as the exact one, but for a thousandth of them and one?"""
    long = b.to_long(evt(spark, sf))
    values, exact, sketch = b.searchable(long), b.thresholds(long, SLICES), b.thresholds_sketch(long, SLICES)
    both = exact.join(sketch.withColumnRenamed("threshold", "near"), ["feature", "slot"])
    # a record per cut
    below = values.join(F.broadcast(both), "feature").groupBy("feature", "slot").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") < F.col("threshold")).alias("exact"), F.count_if(F.col("value") <= F.col("near")).alias("near"))
    return below.select("feature", "slot", (F.abs(F.col("exact") - F.col("near")) <= F.col("n") / 1000 + 1).alias("close"))


@query(f"WITH {EVT}, {LONG}, {THRESHOLDS}, {SLOTS} SELECT row_id, feature, slot FROM slots")
def slot_lookup(spark, sf):
    """Slots by the row-wise form; `slot_lookup_long` takes the long form."""
    rows = evt(spark, sf)
    cuts = b.collect_thresholds(b.thresholds(b.to_long(rows), SLICES))
    return b.bin_rows(rows, cuts).select("row_id", F.posexplode("bins").alias("feature", "slot")).withColumn(
        "slot", F.col("slot").cast("int"))


@query(f"WITH {EVT}, {LONG}, {THRESHOLDS}, {SLOTS} SELECT row_id, feature, slot FROM slots")
def slot_lookup_long(spark, sf):
    long = b.to_long(evt(spark, sf))
    return b.bin_long(long, b.thresholds(long, SLICES), SLICES).select("row_id", "feature", "slot")


@query(f"""WITH {EVT}, {LONG}, active AS (SELECT feature FROM long GROUP BY feature HAVING count(DISTINCT value) > 50)
SELECT feature, CAST(count(*) AS BIGINT) AS n_rows, {R('sum(value)')} AS sum_value
FROM long WHERE feature IN (SELECT feature FROM active) GROUP BY feature""")
def active_features(spark, sf):
    long = b.to_long(evt(spark, sf))
    wide = b.distinct_values(long).groupBy("feature").agg(F.count("*").alias("n")).where("n > 50")
    return b.active_features(long, wide).groupBy("feature").agg(
        F.count("*").alias("n_rows"), r6(F.sum("value")).alias("sum_value"))


@query(f"""SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS row_id,
  {R('sum(value) OVER (ORDER BY event_id)')} AS running, max(value) OVER (ORDER BY event_id) AS highest
FROM events""")
def prefix_sum(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value").withColumn("one", F.lit(1).cast("long"))
    scans = {"row_id": ("sum", "one", True), "running": ("sum", "value"), "highest": ("max", "value")}
    out = scan.prefix_scan(e, "event_id", scans)
    return out.select("event_id", "row_id", r6("running").alias("running"), "highest")


@query(f"""SELECT o_custkey % 3 = 0 AS hot, o_orderkey,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey % 3 = 0 ORDER BY o_orderkey DESC), 2) AS running
FROM orders""")
def prefix_sum_grouped(spark, sf):
    """Running sums of few large groups, from the largest key down."""
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 3 == 0).alias("hot"), "o_orderkey", "o_totalprice")
    out = scan.prefix_sum(o, "o_orderkey", "o_totalprice", "running", by=["hot"], descending=True)
    return out.select("hot", "o_orderkey", F.round("running", 2).alias("running"))
