"""Training state, split search and weight updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from alttree.operators import binning as b
from alttree.operators import blocks
from alttree.operators import learner as ln
from alttree.operators import placed
from alttree.operators import state as st
from alttree.plans.trainer import root_frame
from alttree.schema import Candidate, Node
from registry import query
from registry.binning import SLICES, SLOTS, THRESHOLDS
from registry.fixtures import EVT, FIRED, LONG, MEMBER, MODEL, R4, STATE, R, evt, evt_state, r4, r6, score_sql

BASE = f"{STATE}, {LONG}, {MEMBER}, {THRESHOLDS}, {SLOTS}"
_CLASS = """sum(CASE WHEN y > 0 THEN w ELSE 0 END) AS w_pos, sum(CASE WHEN y > 0 THEN 0 ELSE w END) AS w_neg,
  CAST(count(*) FILTER (y > 0) AS BIGINT) AS n_pos, CAST(count(*) FILTER (y <= 0) AS BIGINT) AS n_neg"""
TOTALS = f"""grand AS (SELECT sum(w) AS gw, count(*) AS gn FROM state),
totals AS (SELECT t.*, gw - w_pos - w_neg AS w_rej, CAST(gn - n_pos - n_neg AS BIGINT) AS n_rej
           FROM (SELECT node_id, {_CLASS} FROM member GROUP BY node_id) t, grand)"""
HIST = f"""hist AS (SELECT m.node_id, s.feature, s.slot, {_CLASS} FROM member m JOIN slots s ON s.row_id = m.row_id
         GROUP BY m.node_id, s.feature, s.slot)"""
CUMULATIVE = """cum AS (
  SELECT t.node_id, th.feature, th.slot, th.threshold, t.w_pos AS tp, t.w_neg AS tn, t.w_rej AS tr,
         sum(coalesce(h.w_pos, 0)) OVER w AS w_pos, sum(coalesce(h.w_neg, 0)) OVER w AS w_neg,
         CAST(sum(coalesce(h.n_pos, 0)) OVER w AS BIGINT) AS n_pos, CAST(sum(coalesce(h.n_neg, 0)) OVER w AS BIGINT) AS n_neg
  FROM totals t CROSS JOIN th LEFT JOIN hist h ON h.node_id = t.node_id AND h.feature = th.feature AND h.slot = th.slot
  WINDOW w AS (PARTITION BY t.node_id, th.feature ORDER BY th.slot))"""


def loss_sql(rej: str, pos: str, neg: str) -> str:
    s = f"nullif({rej} + {pos} + {neg}, 0)"
    return f"({rej} / {s} + 2 * sqrt(greatest({pos} / {s} * ({neg} / {s}), 0)))"


def ratio_sql(pos: str, neg: str) -> str:
    return (f"(0.5 * CASE WHEN abs({pos}) <= 1e-8 AND abs({neg}) <= 1e-8 THEN 0 WHEN {neg} = 0 THEN ln(10) "
            f"ELSE ln(least(10, greatest({pos} / nullif({neg}, 0), 0.1))) END)")


SPLITS = f"""sides AS (
  SELECT node_id AS parent_id, feature, threshold, 0 AS side, w_pos AS pos, w_neg AS neg, greatest(tr + tp + tn - w_pos - w_neg, 0) AS rej FROM cum
  UNION ALL
  SELECT node_id, feature, threshold, 1, greatest(tp - w_pos, 0), greatest(tn - w_neg, 0), greatest(tr + w_pos + w_neg, 0) FROM cum),
scored AS (SELECT *, {loss_sql('rej', 'pos', 'neg')} AS z, {ratio_sql('pos', 'neg')} AS pred FROM sides),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, feature ORDER BY round(z, 8), threshold, side) AS rk
                        FROM scored WHERE z IS NOT NULL) WHERE rk = 1)"""
TOP = """top AS (SELECT * FROM best ORDER BY round(z, 8), parent_id, feature, threshold, side
        LIMIT (SELECT CAST(ceil(0.1 * count(*)) AS BIGINT) FROM best))"""
SEARCH = f"{BASE}, {TOTALS}, {HIST}, {CUMULATIVE}, {SPLITS}"


def binned_state(spark, sf):
    rows = evt(spark, sf)
    cuts = b.collect_thresholds(b.thresholds(b.to_long(rows), SLICES))
    return st.rebuild_state(b.bin_rows(rows, cuts), MODEL), cuts


def _rounded(df, *names):
    return df.withColumns({n: r4(n) if n.startswith(("w_", "right_")) else r6(n) for n in names})


@query(f"""WITH {EVT} SELECT 0 AS node_id, -1 AS parent_id, 0 AS depth, -1 AS feature, CAST(0 AS DOUBLE) AS threshold, TRUE AS split_eval,
  {R('0.5 * ln(count(*) FILTER (y > 0) / count(*) FILTER (y <= 0))')} AS pred FROM evt""")
def root_node(spark, sf):
    return _rounded(root_frame(evt(spark, sf)), "pred")


@query(f"""WITH {STATE}, {MEMBER}, {TOTALS}
SELECT node_id, {R4('w_pos')} AS w_pos, {R4('w_neg')} AS w_neg, {R4('w_rej')} AS w_rej, n_pos, n_neg, n_rej FROM totals""")
def node_totals(spark, sf):
    return _rounded(st.node_totals(evt_state(spark, sf)), "w_pos", "w_neg", "w_rej")


@query(f"""WITH {BASE}, {HIST}
SELECT node_id, feature, slot, {R4('w_pos')} AS w_pos, {R4('w_neg')} AS w_neg, n_pos, n_neg FROM hist""")
def split_histogram(spark, sf):
    state, _ = binned_state(spark, sf)
    return _rounded(ln.split_histogram(state), "w_pos", "w_neg")


@query(f"""WITH {BASE}, {HIST}
SELECT node_id, feature, slot, {R4('w_pos')} AS w_pos, {R4('w_neg')} AS w_neg, n_pos, n_neg FROM hist""")
def split_histogram_arrow(spark, sf):
    state, cuts = binned_state(spark, sf)
    widths = [len(c) + 1 for c in cuts]
    return _rounded(ln.split_histogram_arrow(state, [n.node_id for n in MODEL], widths), "w_pos", "w_neg")


@query(f"""WITH {BASE}, {HIST}
SELECT node_id, feature, slot, {R4('w_pos')} AS w_pos, {R4('w_neg')} AS w_neg, n_pos, n_neg FROM hist""")
def split_histogram_blocks(spark, sf):
    """The same sums from column blocks of two features."""
    rows = evt(spark, sf)
    cuts = b.collect_thresholds(b.thresholds(b.to_long(rows), SLICES))
    binned = b.bin_rows(placed.row_number(placed.located(rows), "place").drop(*placed.PLACE), cuts)
    state = st.rebuild_state(binned, MODEL)
    laid = blocks.lay_out(binned, len(cuts), columns=2)
    return _rounded(blocks.histogram(laid, state, [n.node_id for n in MODEL], [len(c) + 1 for c in cuts], columns=2), "w_pos", "w_neg")


@query(f"""WITH {BASE}, {TOTALS}, {HIST}, {CUMULATIVE}
SELECT node_id, feature, slot, {R4('w_pos')} AS w_pos, {R4('w_neg')} AS w_neg, n_pos, n_neg,
       {R4('greatest(tp - w_pos, 0)')} AS right_pos, {R4('greatest(tn - w_neg, 0)')} AS right_neg FROM cum""")
def cumulative_slots(spark, sf):
    state, cuts = binned_state(spark, sf)
    cum = ln.cumulative_slots(ln.split_histogram(state), st.node_totals(state), cuts)
    right = {f"right_{s}": F.greatest(F.col(f"t_w_{s}") - F.col(f"w_{s}"), F.lit(0.0)) for s in ("pos", "neg")}
    out = cum.withColumns(right).select(
        "node_id", "feature", "slot", "w_pos", "w_neg", "n_pos", "n_neg", "right_pos", "right_neg")
    return _rounded(out, "w_pos", "w_neg", "right_pos", "right_neg")


_BEST = f"parent_id, feature, {R('threshold')} AS threshold, side = 0 AS split_eval, {R('z')} AS z, {R('pred')} AS pred"


def _best(df):
    return _rounded(df.select("parent_id", "feature", "threshold", "split_eval", "z", "pred"), "threshold", "z", "pred")


@query(f"WITH {SEARCH} SELECT {_BEST} FROM best")
def best_split_per_feature(spark, sf):
    state, cuts = binned_state(spark, sf)
    cum = ln.cumulative_slots(ln.split_histogram(state), st.node_totals(state), cuts)
    return _best(ln.best_per_feature(ln.split_scores(cum)))


@query(f"WITH {SEARCH}, {TOP} SELECT {_BEST} FROM top")
def topk_candidates(spark, sf):
    """The best tenth of all (node, feature) splits."""
    state, cuts = binned_state(spark, sf)
    return _best(ln.search(state, cuts, 0))


_CANDIDATES = [
    Candidate(0, 0, 35.5, True), Candidate(0, 3, 24.5, False), Candidate(1, 2, 29.5, True), Candidate(2, 1, 6.5, False),
    Candidate(4, 4, 7.5, True), Candidate(5, 0, 10.25, False), Candidate(6, 3, 90.5, True), Candidate(3, 2, 44.5, False),
]
_CAND_TABLE = "cand(i, parent_id, feature, threshold, split_eval) AS (VALUES " + ", ".join(
    f"({i}, {c.parent_id}, {c.feature}, {c.threshold}::DOUBLE, {str(c.split_eval).upper()})" for i, c in enumerate(_CANDIDATES)) + ")"
REEVALUATED = f"""{_CAND_TABLE},
sums AS (SELECT c.i, {_CLASS.replace('count(*) FILTER', 'count(m.row_id) FILTER')}
         FROM cand c JOIN member m ON m.node_id = c.parent_id JOIN long l ON l.row_id = m.row_id AND l.feature = c.feature
         WHERE (l.value - c.threshold <= 1e-8) = c.split_eval GROUP BY c.i),
rescored AS (SELECT c.*, w_pos, w_neg, n_pos, n_neg,
                    {loss_sql('greatest(gw - w_pos - w_neg, 0)', 'w_pos', 'w_neg')} AS z, {ratio_sql('w_pos', 'w_neg')} AS pred
             FROM cand c JOIN sums USING (i), (SELECT sum(w) AS gw FROM state))"""
# `member` and `long` both carry y
_RE = REEVALUATED.replace("CASE WHEN y >", "CASE WHEN m.y >").replace("FILTER (y ", "FILTER (m.y ")


@query(f"""WITH {STATE}, {LONG}, {MEMBER}, {_RE}
SELECT i, parent_id, feature, threshold, split_eval, n_pos, n_neg, {R4('w_pos')} AS w_pos, {R4('w_neg')} AS w_neg,
       {R('z')} AS z, {R('pred')} AS pred FROM rescored""")
def reevaluate_candidates(spark, sf):
    out = ln.reevaluate(evt_state(spark, sf), _CANDIDATES)
    return _rounded(out.drop("side"), "w_pos", "w_neg", "z", "pred")


@query(f"""WITH {STATE}, {LONG}, {MEMBER}, {_RE}
SELECT i, parent_id, feature, threshold, split_eval, {R('z')} AS z, {R('pred')} AS pred FROM rescored
ORDER BY round(z, 8), parent_id, feature, threshold LIMIT 1""")
def best_candidate(spark, sf):
    best = ln.best_candidate(ln.reevaluate(evt_state(spark, sf), _CANDIDATES))
    return _rounded(best.select("i", "parent_id", "feature", "threshold", "split_eval", "z", "pred"), "z", "pred")


@query(f"""WITH {STATE}, {LONG}, {MEMBER}, {_RE}
SELECT part, i, {R4('w_pos')} AS w_pos, {R4('w_neg')} AS w_neg, n_pos, n_neg FROM (
  SELECT 1 AS part, i, w_pos, w_neg, n_pos, n_neg FROM rescored
  UNION ALL SELECT 0, 0, sum(CASE WHEN y > 0 THEN w ELSE 0 END), sum(CASE WHEN y > 0 THEN 0 ELSE w END),
    count(*) FILTER (y > 0), count(*) FILTER (y <= 0) FROM state)""")
def admission_pass(spark, sf):
    """Loss sums and candidate sums of one admission, from one pass over the state."""
    state = evt_state(spark, sf).withColumn("is_train", F.lit(True))
    out = ln.admission_pass(state, [], _CANDIDATES).where("part = 1 or i = 0")
    return out.select("part", "i", r4("w_pos").alias("w_pos"), r4("w_neg").alias("w_neg"),
                      F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"))


_NEW = Node(7, 4, 3, 2, 30.5, True, 0.35)
_IN = "(m4 AND f2 - 30.5 <= 1e-8)"


@query(f"""WITH {STATE}, {MEMBER} SELECT row_id, node_id FROM member
UNION ALL SELECT row_id, 7 FROM state WHERE {_IN}""")
def assign_update(spark, sf):
    return st.assignments(st.apply_node(evt_state(spark, sf), _NEW))


@query(f"WITH {STATE} SELECT row_id, {R(f'CASE WHEN {_IN} THEN w * exp(-y * 0.35) ELSE w END')} AS w FROM state")
def adaboost_update(spark, sf):
    return st.apply_node(evt_state(spark, sf), _NEW).select("row_id", r6("w").alias("w"))


@query(f"""WITH {STATE}, u AS (SELECT row_id, CASE WHEN {_IN} THEN w / (1 + exp(y * 0.35)) ELSE w END AS w FROM state)
SELECT row_id, {R('w')} AS w, {R('w / (SELECT sum(w) FROM u) * 1000')} AS w_norm FROM u""")
def logit_update(spark, sf):
    state = st.apply_node(evt_state(spark, sf), _NEW, "logit").select("row_id", "w")
    norm = st.normalise_weights(state.withColumn("raw", F.col("w")))
    return norm.select("row_id", r6("raw").alias("w"), r6(F.col("w") * 1000).alias("w_norm"))


@query(f"""WITH {EVT}, {FIRED} SELECT row_id, {R(f'exp(-y * {score_sql(first=3)})')} AS w,
  {' || '.join(f"CASE WHEN m{n.node_id} THEN '{n.node_id}' ELSE '' END" for n in MODEL)} AS members FROM fired""")
def rebuild_state(spark, sf):
    """Memberships of all nodes, and weights from the nodes after a resample at 3."""
    state = st.rebuild_state(evt(spark, sf), MODEL, last_resample=3)
    return state.select("row_id", r6("w").alias("w"), F.array_join("hits", "").alias("members"))


ROUND = f"""{EVT}, {LONG}, {THRESHOLDS}, {SLOTS},
rootp AS (SELECT 0.5 * ln(count(*) FILTER (y > 0) / count(*) FILTER (y <= 0)) AS pred FROM evt),
state AS (SELECT evt.*, exp(-y * pred) AS w, pred AS root FROM evt, rootp),
member AS (SELECT *, 0 AS node_id FROM state),
{TOTALS}, {HIST}, {CUMULATIVE}, {SPLITS},
child AS (SELECT * FROM best ORDER BY round(z, 8), parent_id, feature, threshold, side LIMIT 1),
scored2 AS (SELECT s.y, s.root + CASE WHEN (l.value - c.threshold <= 1e-8) = (c.side = 0) THEN c.pred ELSE 0 END AS score
            FROM child c JOIN long l ON l.feature = c.feature JOIN state s ON s.row_id = l.row_id)"""


@query(f"""WITH {ROUND}
SELECT CAST(y AS INTEGER) AS y, CAST(count(*) AS BIGINT) AS n_rows, {R('avg(exp(-y * score))')} AS avg_loss, {R('min(score)')} AS low, {R('max(score)')} AS high
FROM scored2 GROUP BY y""")
def one_round_boost(spark, sf):
    """One boosting round from the root: bins, histogram, best split, exact weights, new scores."""
    rows = evt(spark, sf)
    cuts = b.collect_thresholds(b.thresholds(b.to_long(rows), SLICES))
    binned = b.bin_rows(rows, cuts)
    root = [Node(*root_frame(rows).first())]
    state = st.rebuild_state(binned, root)
    candidates = ln.collect_candidates(ln.search(state, cuts, 5))
    best = ln.best_candidate(ln.reevaluate(state, candidates)).first()
    child = Node(1, best["parent_id"], 1, best["feature"], best["threshold"], best["split_eval"], best["pred"])
    after = st.rebuild_state(rows, [*root, child])
    return after.groupBy("y").agg(
        F.count("*").alias("n_rows"), r6(F.avg("w")).alias("avg_loss"),
        r6(F.min("delta")).alias("low"), r6(F.max("delta")).alias("high"))
