"""SQL that trains a depth-one tree step by step, to compare whole training runs with."""

from __future__ import annotations

from registry.fixtures import EVT, FEATURES, R4, R, hash_sql, train_sql
from registry.sampling import BALANCE, COPIES

_FS = ", ".join(f"f{k}" for k in range(FEATURES))


def drawn_sample(frac: float, share: float, seed: int) -> str:
    """Rows of a first resample: all weights 1, split by row."""
    balance = BALANCE.replace("n * 0.1", f"n * {frac}").replace("size * 0.5", f"size * {share!r}")
    return f"""state AS (SELECT *, CAST(1 AS DOUBLE) AS w FROM evt), {balance}, {COPIES},
drawn AS (SELECT s.row_id, s.copy, s.y, {train_sql('s.row_id', seed=seed)} AS is_train, {_FS}
          FROM sample s JOIN evt e USING (row_id))"""


def hashed_sample(frac: float, seed: int) -> str:
    return f"""drawn AS (SELECT row_id, 1 AS copy, y, {train_sql(seed=seed)} AS is_train, {_FS}
          FROM evt WHERE {hash_sql('row_id')} < {round(frac * 2**31)})"""


def _loss(rej: str, pos: str, neg: str) -> str:
    s = f"nullif({rej} + {pos} + {neg}, 0)"
    return f"({rej} / {s} + 2 * sqrt(greatest({pos} / {s} * ({neg} / {s}), 0)))"


def _pred(pos: str, neg: str) -> str:
    return (f"(0.5 * CASE WHEN abs({pos}) <= 1e-8 AND abs({neg}) <= 1e-8 THEN 0 WHEN {neg} = 0 THEN ln(10) "
            f"ELSE ln(least(10, greatest({pos} / nullif({neg}, 0), 0.1))) END)")


_CLASS = "sum(CASE WHEN y > 0 THEN w ELSE 0 END) AS {p}, sum(CASE WHEN y > 0 THEN 0 ELSE w END) AS {n}"


def training_sql(sample: str, slices: int, k: int, admit: int, batches: int, features=range(FEATURES)) -> str:
    """Node and metrics of every iteration."""
    long = " UNION ALL ".join(f"SELECT rid, is_train, {f} AS feature, f{f} AS value FROM numbered" for f in features)
    ctes = [
        EVT, sample,
        "numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY row_id, copy) AS rid, * FROM drawn)",
        f"lng AS MATERIALIZED ({long})",
        "d AS (SELECT DISTINCT feature, value FROM lng WHERE is_train)",
        """r AS (SELECT *, row_number() OVER w AS rn, lead(value) OVER w AS nx, count(*) OVER (PARTITION BY feature) AS n
              FROM d WINDOW w AS (PARTITION BY feature ORDER BY value DESC))""",
        f"s AS (SELECT *, greatest(1, CAST(floor(n / {slices}) AS INTEGER)) AS sz FROM r)",
        "th AS MATERIALIZED (SELECT feature, 0.5 * (value + nx) AS threshold FROM s WHERE rn % sz = 0 AND rn < n)",
        "cells AS MATERIALIZED (SELECT rid, feature, threshold, value - threshold <= 1e-8 AS le FROM lng JOIN th USING (feature))",
        "node0 AS (SELECT 0.5 * ln(count(*) FILTER (y > 0) / count(*) FILTER (y <= 0)) AS pred FROM numbered WHERE is_train)",
        "w0 AS MATERIALIZED (SELECT rid, y, is_train, exp(-y * pred) AS w FROM numbered, node0)",
    ]
    step = 0
    for b in range(batches):
        ctes += [
            f"""lft{b} AS (SELECT feature, threshold, {_CLASS.format(p='lp', n='ln')}
                FROM cells JOIN w{step} USING (rid) WHERE is_train AND le GROUP BY 1, 2)""",
            f"tot{b} AS (SELECT {_CLASS.format(p='tp', n='tn')} FROM w{step} WHERE is_train)",
            f"""sides{b} AS (SELECT feature, threshold, 0 AS side, lp AS pos, ln AS neg, tp + tn - lp - ln AS rej FROM lft{b}, tot{b}
                UNION ALL SELECT feature, threshold, 1, tp - lp, tn - ln, lp + ln FROM lft{b}, tot{b})""",
            f"z{b} AS (SELECT *, {_loss('rej', 'pos', 'neg')} AS z FROM sides{b})",
            f"""cand{b} AS MATERIALIZED (SELECT feature, threshold, side FROM (
                  SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(z, 8), threshold, side) AS rk FROM z{b})
                WHERE rk = 1 ORDER BY round(z, 8), feature, threshold, side LIMIT {k})""",
        ]
        for _ in range(admit):
            ctes += [
                f"""sums{step} AS (SELECT feature, threshold, side, {_CLASS.format(p='pos', n='neg')}
                    FROM cand{b} JOIN cells USING (feature, threshold) JOIN w{step} USING (rid)
                    WHERE is_train AND le = (side = 0) GROUP BY 1, 2, 3)""",
                f"all{step} AS (SELECT sum(w) AS total FROM w{step} WHERE is_train)",
                f"""node{step + 1} AS MATERIALIZED (
                    SELECT feature, threshold, side, {_pred('pos', 'neg')} AS pred FROM sums{step}, all{step}
                    ORDER BY round({_loss('greatest(total - pos - neg, 0)', 'pos', 'neg')}, 8), feature, threshold, side LIMIT 1)""",
                f"""w{step + 1} AS MATERIALIZED (
                    SELECT w.rid, y, is_train, w * CASE WHEN le = (side = 0) THEN exp(-y * pred) ELSE 1 END AS w
                    FROM w{step} w JOIN cells c ON c.rid = w.rid JOIN node{step + 1} n ON n.feature = c.feature AND n.threshold = c.threshold)""",
            ]
            step += 1
    train = "w FILTER (is_train)"
    out = []
    for i in range(step + 1):
        node = "-1 AS feature, CAST(0 AS DOUBLE) AS threshold, TRUE AS split_eval" if i == 0 else f"feature, {R('threshold')} AS threshold, side = 0 AS split_eval"
        change = "CAST(NULL AS DOUBLE)" if i == 0 else R4(f"(SELECT sum(w) FROM w{i} WHERE is_train) - (SELECT sum(w) FROM w{i - 1} WHERE is_train)")
        out.append(f"""SELECT {i} AS iteration, {node}, {R('pred')} AS pred, m.*, {change} AS weight_change FROM node{i}, (
          SELECT {R('avg(w) FILTER (is_train)')} AS train_avg, {R('avg(w) FILTER (is_train AND y > 0)')} AS train_avg_pos,
                 {R('avg(w) FILTER (NOT is_train)')} AS test_avg,
                 {R('(sum(w) FILTER (is_train)) ** 2 / (sum(w * w) FILTER (is_train)) / (count(*) FILTER (is_train))')} AS effective
          FROM w{i}) m""")
    return "WITH " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(out)
