"""Importance resampling and splits of the events pool."""

from __future__ import annotations

from pyspark.sql import functions as F

from alttree.operators import metrics
from alttree.operators import sampling as sp
from alttree.operators.state import rebuild_state
from alttree.sources.store import settle
from registry import query
from registry.fixtures import EVT, MODEL, R4, STATE, R, evt, hash_sql, r4, r6, table, train_sql

FRAC, SHARE = 0.1, 0.5

BALANCE = """bal AS (SELECT count(*) AS n, sum(CASE WHEN y > 0 THEN w ELSE 0 END) AS wp,
                   sum(CASE WHEN y > 0 THEN 0 ELSE w END) AS wn FROM state),
plan AS (SELECT *, wn / (wp + wn) AS ps, wp / (wp + wn) AS ns, 2 * wp * wn / (wp + wn) AS total,
                CAST(ceil(n * 0.1) AS BIGINT) AS size FROM bal),
seg AS (SELECT *, total / size AS segment, total / size * 0.5 AS off FROM plan)"""
COPIES = """ordered AS (SELECT row_id, y, sum(CASE WHEN y > 0 THEN ps ELSE ns END * w) OVER (ORDER BY row_id) AS c, segment, off
            FROM state, seg),
copies AS (SELECT row_id, y, CAST(floor((c - off) / segment) - floor((lag(c, 1, 0) OVER (ORDER BY row_id) - off) / segment) AS BIGINT) AS copies
           FROM ordered),
sample AS (SELECT row_id, y, unnest(range(1, copies + 1)) AS copy FROM copies WHERE copies > 0)"""


def _weighted(spark, sf):
    return sp.importance_weights(evt(spark, sf), MODEL).select("row_id", "y", "w")


@query(f"WITH {STATE} SELECT row_id, y, {R('w')} AS w FROM state")
def importance_weights(spark, sf):
    return _weighted(spark, sf).withColumn("w", r6("w"))


@query(f"""WITH {STATE}, {BALANCE}
SELECT CAST(n AS BIGINT) AS n_rows, {R4('wp')} AS w_pos, {R4('wn')} AS w_neg, {R('ps')} AS pos_scale, {R('ns')} AS neg_scale,
       {R4('total')} AS scaled_total FROM plan""")
def class_balance(spark, sf):
    out = sp.class_balance(_weighted(spark, sf))
    return out.withColumns({c: r6(c) if c.endswith("scale") else r4(c) for c in out.columns if c != "n_rows"})


@query(f"WITH {STATE}, {BALANCE} SELECT size, {R('segment')} AS segment, {R('off')} AS start FROM seg")
def sample_plan(spark, sf):
    plan = sp.sample_plan(sp.balance_of(_weighted(spark, sf)), FRAC, offset_share=SHARE)
    return spark.createDataFrame([(plan.size, round(plan.segment, 6), round(plan.offset, 6))], "size long, segment double, start double")


@query(f"WITH {STATE}, {BALANCE}, {COPIES} SELECT row_id, y, CAST(copy AS BIGINT) AS copy FROM sample")
def systematic_sample(spark, sf):
    """Drawn where the pool is read."""
    weighted = sp.pool_weights(evt(spark, sf), MODEL)
    return sp.draw_in_place(weighted, sp.sample_plan(weighted.balance, FRAC, offset_share=SHARE)).select("row_id", "y", "copy")


@query(f"WITH {STATE}, {BALANCE}, {COPIES} SELECT row_id, y, CAST(copy AS BIGINT) AS copy FROM sample")
def systematic_sample_by_key(spark, sf):
    """Drawn in the order of the row ids, whatever the files' order."""
    pool = evt(spark, sf)
    weighted = settle(_weighted(spark, sf))
    balance = sp.balance_of(weighted)
    return sp.systematic_sample(pool, weighted, sp.sample_plan(balance, FRAC, offset_share=SHARE), balance).select("row_id", "y", "copy")


_COPIED = "three AS (SELECT row_id, unnest([1, 2, 3]) AS copy FROM evt)"


@query(f"""WITH {EVT}, {_COPIED}
SELECT row_id, CAST(copy AS INTEGER) AS copy, {train_sql()} AS by_row, {train_sql(copy='copy')} AS by_copy FROM three""")
def hash_split(spark, sf):
    copies = evt(spark, sf).select("row_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("copy"))
    return copies.withColumns({"by_row": sp.train_flag("row"), "by_copy": sp.train_flag("copy")})


@query(f"SELECT event_id AS row_id, value FROM events WHERE {hash_sql('event_id', seed=7)} < 214748365")
def hash_sample(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "value")
    return sp.hash_sample(rows, 0.1, seed=7)


DRAWS = f"""numbered AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY row_id) - 1 AS idx, count(*) OVER (PARTITION BY y) AS n FROM evt),
sizes AS (SELECT DISTINCT y, n FROM numbered),
high AS (SELECT range + 1 AS draw, y, n, {hash_sql('range + 1', 'y + 2')} AS h FROM range(300), sizes),
draws AS (SELECT draw, y, (h * 2147483648 + {hash_sql('h', 'y + 2', 1)}) % n AS idx FROM high),
drawn AS (SELECT d.draw, d.y, row_id FROM draws d JOIN numbered r ON r.y = d.y AND r.idx = d.idx)"""


@query(f"WITH {EVT}, {DRAWS} SELECT draw, y, row_id FROM drawn")
def stratified_draw(spark, sf):
    return sp.stratified_draw(evt(spark, sf), 300).select("draw", "y", "row_id")


@query(f"""WITH {STATE}, {BALANCE}, {COPIES}
SELECT {train_sql()} AS is_train, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (y > 0) AS BIGINT) AS n_pos,
       CAST(count(*) FILTER (y < 0) AS BIGINT) AS n_neg, CAST(count(*) AS DOUBLE) AS sum_w
FROM sample GROUP BY 1""")
def resample_step(spark, sf):
    """A resample for a grown model: new rows, memberships replayed, weights back at 1."""
    sample = sp.resample(evt(spark, sf), MODEL, FRAC, seed=0, offset_share=SHARE)
    state = rebuild_state(sample, MODEL, last_resample=len(MODEL), max_depth=1)
    sums = state.groupBy("is_train").agg(F.sum("w").alias("sum_w"))
    return metrics.class_counts(state, ["is_train"]).join(sums, "is_train")
