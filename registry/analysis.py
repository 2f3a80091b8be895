"""Model descriptions and training histories."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from alttree.operators import encode, metrics
from alttree.plans import describe as d
from alttree.plans import history as h
from alttree.sources import store
from registry import query
from registry.fixtures import HIST, NAMES, TREE, R, history, r6, table, tree_nodes


def _names(spark):
    return encode.feature_dictionary(spark)


@query(f"WITH {TREE} SELECT node_id, parent_id, depth, feature, threshold, split_eval, pred FROM nodes WHERE node_id < 777")
def model_slice(spark, sf):
    return d.model_slice(tree_nodes(spark, sf), 777)


@query(f"""WITH {TREE}, kids AS (SELECT parent_id, count(*) AS n FROM nodes GROUP BY parent_id)
SELECT n.node_id, n.parent_id, p.depth AS parent_depth, p.feature AS parent_feature, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children
FROM nodes n LEFT JOIN nodes p ON p.node_id = n.parent_id LEFT JOIN kids k ON k.parent_id = n.node_id""")
def parent_and_children(spark, sf):
    out = d.with_parent(d.child_counts(tree_nodes(spark, sf)))
    return out.select("node_id", "parent_id", "parent_depth", "parent_feature", "n_children")


TERMS = f"""{TREE.replace('ev AS', 'RECURSIVE ev AS', 1)}, {NAMES},
terms AS (SELECT node_id, parent_id, depth, pred, feature,
                 CASE WHEN (1.0 <= threshold) = split_eval THEN 'is ' ELSE 'isnot ' END || name AS term
          FROM nodes JOIN names USING (feature)),
rules AS (SELECT node_id, '' AS rule, -1 AS first FROM nodes WHERE feature < 0
          UNION ALL
          SELECT t.node_id, CASE WHEN r.rule = '' THEN t.term ELSE r.rule || ' and ' || t.term END,
                 CASE WHEN r.first < 0 THEN t.node_id ELSE r.first END
          FROM terms t JOIN rules r ON r.node_id = t.parent_id)"""
_DESCRIBED = f"WITH {TERMS} SELECT node_id, depth, {R('pred')} AS pred, rule FROM nodes JOIN rules USING (node_id)"


@query(_DESCRIBED)
def rule_description(spark, sf):
    return d.describe(tree_nodes(spark, sf), _names(spark)).withColumn("pred", r6("pred"))


@query(f"{_DESCRIBED} ORDER BY abs(nodes.pred) DESC, node_id")
def rules_by_abs_pred(spark, sf):
    """All rules, strongest first."""
    out = d.by_abs_pred(d.describe(tree_nodes(spark, sf), _names(spark)))
    return out.withColumn("pred", r6("pred"))


@query(_DESCRIBED)
def description_file(spark, sf):
    """The written description of a model, read back line by line."""
    path = os.path.join(store.shared_folder(spark), f"rules-{uuid.uuid4().hex}")
    d.write_description(d.describe(tree_nodes(spark, sf), _names(spark)), path)
    part = F.split("value", ", ", 4)
    return spark.read.text(path).select(
        part[0].cast("int").alias("node_id"), part[1].cast("int").alias("depth"), r6(part[2].cast("double")).alias("pred"), part[3].alias("rule"))


@query(f"""WITH {TREE}, kids AS (SELECT parent_id AS node_id, count(*) AS n FROM nodes GROUP BY parent_id)
SELECT node_id, '#' || node_id || CASE WHEN parent_id >= 0 THEN ' below ' || parent_id ELSE '' END || ': '
  || CASE WHEN feature < 0 THEN 'every row'
          ELSE 'feature ' || feature || CASE WHEN split_eval THEN ' at most ' ELSE ' above ' END || printf('%.6f', threshold) END
  || ' adds ' || printf('%.6f', pred) || '; splits further: ' || coalesce(n, 0) AS text
FROM nodes LEFT JOIN kids USING (node_id)""")
def node_render(spark, sf):
    return d.render(tree_nodes(spark, sf))


CONTRIBUTION = f"""{TERMS},
parts AS (SELECT CASE WHEN n.pred < 0 THEN 'neg' ELSE 'pos' END AS sign, nm.pos, nm.token,
                 CASE WHEN (1.0 <= f.threshold) = f.split_eval THEN 'is' ELSE 'isnot' END AS kind, abs(n.pred) AS part
          FROM nodes n JOIN rules r ON r.node_id = n.node_id JOIN nodes f ON f.node_id = r.first JOIN names nm ON nm.feature = f.feature),
sums AS (SELECT sign, pos, token, kind, sum(part) AS part FROM parts GROUP BY ALL),
tops AS (SELECT sign, max(total) AS top, max(pos) AS last_pos FROM (SELECT sign, pos, sum(part) AS total FROM sums GROUP BY sign, pos) GROUP BY sign),
grid AS (SELECT sign, top, CAST(p.range AS INTEGER) AS pos, token, kind
         FROM tops, range(200) p, (VALUES ('A'), ('C'), ('G'), ('T')) t(token), (VALUES ('is'), ('isnot')) k(kind) WHERE p.range <= last_pos),
contribution AS (SELECT sign, pos, token, kind, coalesce(part, 0) / top AS score FROM grid LEFT JOIN sums USING (sign, pos, token, kind))"""


@query(f"WITH {CONTRIBUTION} SELECT sign, pos, token, kind, {R('score')} AS score FROM contribution")
def position_contribution(spark, sf):
    return d.position_contribution(tree_nodes(spark, sf), _names(spark)).withColumn("score", r6("score"))


@query(f"""WITH {CONTRIBUTION} SELECT pos, token, kind, {R("CASE WHEN sign = 'pos' THEN score ELSE -score END")} AS score FROM contribution""")
def signed_contribution(spark, sf):
    return d.signed_contribution(d.position_contribution(tree_nodes(spark, sf), _names(spark))).withColumn("score", r6("score"))


@query(f"""WITH {HIST},
o AS (SELECT run, segment, iteration, train_avg, lag(train_avg, 4) OVER (PARTITION BY run, segment ORDER BY iteration) AS oldest FROM seg)
SELECT run, CAST(segment AS BIGINT) AS segment, iteration, {R('(oldest - train_avg) / oldest')} AS gain,
       coalesce((oldest - train_avg) / oldest - 0.01 < -1e-8, FALSE) AS underfit FROM o""")
def underfit_flags(spark, sf):
    segments = h.number_segments(history(spark, sf), ["run"])
    out = h.underfit_flags(segments, 5, 0.01, ["run"])
    return out.select("run", "segment", "iteration", r6("gain").alias("gain"), "underfit")


@query(f"""WITH {HIST},
b AS (SELECT *, row_number() OVER p AS i, min(test_avg) OVER (PARTITION BY run, segment ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
      FROM seg WINDOW p AS (PARTITION BY run, segment ORDER BY iteration)),
l AS (SELECT *, max(CASE WHEN best IS NULL OR test_avg - best <= 1e-8 THEN i END) OVER (PARTITION BY run, segment ORDER BY iteration) AS last_best FROM b)
SELECT run, CAST(segment AS BIGINT) AS segment, iteration, CAST(i - last_best + 1 AS BIGINT) AS since_best, i - last_best + 1 >= 10 AS overfit FROM l""")
def overfit_flags(spark, sf):
    segments = h.number_segments(history(spark, sf), ["run"])
    return h.overfit_flags(segments, 10, ["run"]).select("run", "segment", "iteration", "since_best", "overfit")


@query(f"""WITH {HIST}
SELECT run, iteration, last_value(CASE WHEN isnan(ref_auprc) THEN NULL ELSE ref_auprc END IGNORE NULLS)
  OVER (PARTITION BY run ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ref_auprc FROM hist""")
def metric_ffill(spark, sf):
    return h.forward_fill(history(spark, sf), "ref_auprc", ["run"]).select("run", "iteration", "ref_auprc")


@query(f"""WITH {HIST} SELECT run, iteration - (n_before - n_after) AS span_from, iteration AS span_to FROM hist WHERE event = 'rollback'""")
def rollback_spans(spark, sf):
    return h.rollback_spans(history(spark, sf)).select("run", "span_from", "span_to")


@query(f"""WITH g AS (
  SELECT user_id * 100 + user_id % 7 AS n_nodes, floor(value) AS score, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS tp, count(*) AS n
  FROM events GROUP BY 1, 2),
c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY n_nodes) AS p
      FROM g WINDOW w AS (PARTITION BY n_nodes ORDER BY score DESC)),
q AS (SELECT n_nodes, score, ctp / nullif(p, 0) AS recall, ctp / cn AS prec FROM c),
l AS (SELECT *, lag(recall, 1, 0) OVER w AS r0, coalesce(lag(prec) OVER w, prec) AS p0 FROM q WINDOW w AS (PARTITION BY n_nodes ORDER BY score DESC)),
a AS (SELECT n_nodes, sum((recall - r0) * (prec + p0) / 2) AS auprc FROM l GROUP BY n_nodes)
SELECT n_nodes, score, {R('recall')} AS recall, {R('prec')} AS precision, {R('auprc')} AS auprc
FROM q JOIN a USING (n_nodes) WHERE n_nodes % 1000 < 5""")
def pr_snapshots(spark, sf):
    """PR curves of the snapshots just past every thousandth node; a user's events stand for one snapshot."""
    scored = table(spark, sf, "events").select(
        (F.col("user_id") * 100 + F.col("user_id") % 7).alias("n_nodes"), F.floor("value").cast("double").alias("score"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("y"))
    out = h.pr_snapshots(metrics.pr_curve(scored, ["n_nodes"]), metrics.auprc(scored, ["n_nodes"]))
    return out.select("n_nodes", "score", *[r6(c).alias(c) for c in ("recall", "precision", "auprc")])
