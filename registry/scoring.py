"""Scores, precision-recall, losses and effective counts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from alttree.operators import metrics as m
from alttree.operators import scoring as s
from alttree.operators.binning import to_long
from alttree.operators.sampling import stratified_draw, train_flag
from alttree.operators.state import apply_node, rebuild_state
from alttree.sources import store
from registry import query
from registry.fixtures import EVT, FIRED, MODEL, R4, STATE, R, evt, r4, r6, score_sql, train_sql
from registry.sampling import DRAWS

_SCORED = f"scored AS (SELECT row_id, y, {score_sql()} AS score FROM fired)"
_SCORE = f"WITH {EVT}, {FIRED}, {_SCORED} SELECT row_id, y, {R('score')} AS score FROM scored"
# rounded scores give both engines the same groups of equal scores
_ROUNDED = f"scored AS (SELECT row_id, y, {R(score_sql())} AS score FROM fired)"
_GROUPS = """g AS (SELECT score, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS tp, count(*) AS n FROM scored GROUP BY score),
c AS (SELECT score, tp, n, sum(tp) OVER (ORDER BY score DESC) AS ctp, sum(n) OVER (ORDER BY score DESC) AS cn,
             sum(tp) OVER () AS p FROM g)"""
_TRAIN = train_sql()


def _rounded(spark, sf):
    return s.score(evt(spark, sf), MODEL).withColumn("score", r6("score")).select("row_id", "y", "score")


@query(_SCORE)
def score_rows(spark, sf):
    return s.score(evt(spark, sf), MODEL).select("row_id", "y", r6("score").alias("score"))


@query(_SCORE)
def score_expression(spark, sf):
    rows = evt(spark, sf)
    return rows.select("row_id", "y", r6(s.score_expression(rows, MODEL)).alias("score"))


@query(f"WITH {EVT}, {FIRED}, {_SCORED} SELECT row_id, {R('score')} AS score FROM scored")
def score_relational(spark, sf):
    return s.score_relational(to_long(evt(spark, sf)), MODEL).select("row_id", r6("score").alias("score"))


@query(f"WITH {EVT}, {FIRED} SELECT row_id, {R(score_sql(4))} AS score_4, CAST(0 AS DOUBLE) AS score_0 FROM fired")
def score_prefix(spark, sf):
    rows = s.score(s.score(evt(spark, sf), MODEL, 4, "score_4"), MODEL, 0, "score_0")
    return rows.select("row_id", r6("score_4").alias("score_4"), "score_0")


@query(f"""WITH {EVT}, {FIRED} SELECT row_id, {R(score_sql())} AS score, {R(score_sql(3))} AS prefix_score,
  {R(score_sql(first=3))} AS delta FROM fired""")
def score_delta(spark, sf):
    out = s.score_delta(evt(spark, sf), MODEL, 3)
    return out.select("row_id", *[r6(c).alias(c) for c in ("score", "prefix_score", "delta")])


_STAGED = " UNION ALL ".join(
    f"SELECT row_id, y, {n.node_id} AS node_id, {score_sql(n.node_id + 1)} AS score FROM fired" for n in MODEL)


@query(f"WITH {EVT}, {FIRED}, staged AS ({_STAGED}) SELECT row_id, y, node_id, {R('score')} AS score FROM staged")
def staged_scores(spark, sf):
    return s.staged_scores(evt(spark, sf), MODEL).withColumn("score", r6("score"))


@query(f"""WITH {EVT}, {FIRED}, {_SCORED}, l AS (SELECT y, exp(-y * score) AS l FROM scored)
SELECT {R('avg(l)')} AS avg_loss, {R('avg(l) FILTER (y > 0)')} AS avg_loss_pos,
       {R('avg(l) FILTER (y <= 0)')} AS avg_loss_neg, {R4('sum(l)')} AS sum_loss FROM l""")
def exp_loss(spark, sf):
    out = m.exp_loss(s.score(evt(spark, sf), MODEL))
    return out.withColumns({c: r4(c) if c == "sum_loss" else r6(c) for c in out.columns})


@query(f"""WITH {EVT}, {FIRED}, {_ROUNDED}, {_GROUPS}
SELECT score, {R('ctp / p')} AS recall, {R('ctp / cn')} AS precision FROM c""")
def pr_curve(spark, sf):
    return m.pr_curve(_rounded(spark, sf)).select("score", r6("recall").alias("recall"), r6("precision").alias("precision"))


@query(f"""WITH {EVT}, {FIRED}, {_ROUNDED}, {_GROUPS}
SELECT 'train' AS dataset, 100 AS iteration, score, {R('ctp / p')} AS recall, {R('ctp / cn')} AS precision FROM c
UNION ALL SELECT 'train', 200, score, {R('ctp / p')}, {R('ctp / cn')} FROM c""")
def pr_curve_sink(spark, sf):
    """Curves of two iterations, one of them written twice, read back from the table that a run keeps."""
    path = os.path.join(store.shared_folder(spark), f"curves-{uuid.uuid4().hex}")
    points = m.pr_curve(_rounded(spark, sf)).withColumns({"n_nodes": F.lit(7), "dataset": F.lit("train")})
    for iteration in (100, 200, 100):
        store.save_pr_points(points.withColumn("iteration", F.lit(iteration)), path)
    kept = spark.read.parquet(path)
    return kept.select("dataset", "iteration", "score", r6("recall").alias("recall"), r6("precision").alias("precision"))


@query(f"""WITH {EVT}, {FIRED}, {_ROUNDED}, {_GROUPS},
q AS (SELECT score, ctp / p AS r, ctp / cn AS pr FROM c),
l AS (SELECT *, lag(r, 1, 0) OVER (ORDER BY score DESC) AS r0, coalesce(lag(pr) OVER (ORDER BY score DESC), pr) AS pr0 FROM q)
SELECT {R('sum((r - r0) * (pr + pr0) / 2)')} AS auprc FROM l""")
def auprc(spark, sf):
    return m.auprc(_rounded(spark, sf)).select(r6("auprc").alias("auprc"))


@query(f"""WITH {STATE} SELECT
  {R('sum(w) * sum(w) / sum(w * w) / count(*)')} AS effective,
  {R('(sum(w) FILTER (y > 0)) ** 2 / (sum(w * w) FILTER (y > 0)) / (count(*) FILTER (y > 0))')} AS effective_pos,
  {R('(sum(w) FILTER (y <= 0)) ** 2 / (sum(w * w) FILTER (y <= 0)) / (count(*) FILTER (y <= 0))')} AS effective_neg
FROM state""")
def effective_count(spark, sf):
    out = m.effective_count(rebuild_state(evt(spark, sf), MODEL))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(f"""WITH {EVT}, {FIRED}, {_SCORED} SELECT CAST(sum(CASE WHEN score * y <= 1e-8 THEN 1 ELSE 0 END) AS BIGINT) AS n_wrong,
  {R('avg(CASE WHEN score * y <= 1e-8 THEN 1.0 ELSE 0.0 END)')} AS error_rate FROM scored""")
def margin_error(spark, sf):
    return m.margin_error(s.score(evt(spark, sf), MODEL)).withColumn("error_rate", r6("error_rate"))


@query(f"""WITH {EVT}, {FIRED}, staged AS ({_STAGED}),
t AS (SELECT node_id, {_TRAIN} AS tr, CASE WHEN score * y <= 1e-8 THEN 1.0 ELSE 0.0 END AS bad, exp(-y * score) AS w FROM staged)
SELECT node_id, {R('avg(bad) FILTER (tr)')} AS train_error, {R('avg(bad) FILTER (NOT tr)')} AS test_error,
  {R4('(sum(w) FILTER (tr)) ** 2 / (sum(w * w) FILTER (tr))')} AS effective, {R4('sum(w) FILTER (tr)')} AS sum_w
FROM t GROUP BY node_id""")
def staged_metrics(spark, sf):
    """Errors, effective count and weight after every node, through their table."""
    path = os.path.join(store.shared_folder(spark), f"staged-{uuid.uuid4().hex}")
    store.save_staged(m.staged_metrics(evt(spark, sf).withColumn("is_train", train_flag()), MODEL), path)
    out = spark.read.parquet(path)
    return out.select("node_id", r6("train_error").alias("train_error"), r6("test_error").alias("test_error"),
                      r4("effective").alias("effective"), r4("sum_w").alias("sum_w"))


@query(f"""WITH {EVT}, {FIRED}, staged AS ({_STAGED}), {DRAWS}
SELECT d.draw, d.y, d.row_id, node_id, {R('score')} AS score FROM drawn d JOIN staged s ON s.row_id = d.row_id""")
def staged_export(spark, sf):
    """Scores after every node for a fixed number of rows of either class, drawn with replacement."""
    out = s.staged_scores(stratified_draw(evt(spark, sf), 300), MODEL)
    return out.select("draw", "y", "row_id", "node_id", r6("score").alias("score"))


@query(f"""WITH {STATE} SELECT {R4('sum(exp(-y * score))')} AS sum_loss, {R4('sum(w)')} AS sum_w, TRUE AS same FROM state""")
def loss_weight_identity(spark, sf):
    """Weights built step by step must sum to the exponential loss of the scores."""
    rows = s.score(evt(spark, sf), MODEL, name="score")
    state = rows.withColumns({"hits": F.array().cast("array<int>"), "delta": F.lit(0.0), "w": F.lit(1.0)})
    for node in MODEL:
        state = apply_node(state, node)
    out = state.agg(F.sum(F.exp(-F.col("y") * F.col("score"))).alias("sum_loss"), F.sum("w").alias("sum_w"))
    same = F.abs(F.col("sum_loss") - F.col("sum_w")) <= 1e-9 * F.col("sum_w")
    return out.select(r4("sum_loss").alias("sum_loss"), r4("sum_w").alias("sum_w"), same.alias("same"))
