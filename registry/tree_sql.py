"""SQL that trains a tree of any depth step by step: deepening, roll back, warm start, other weights, one-hot rows."""

from __future__ import annotations

from registry.boosting_sql import _CLASS as CLASS
from registry.boosting_sql import _loss as loss_sql
from registry.boosting_sql import _pred as pred_sql
from registry.fixtures import FEATURES, R4, R

MEASURES = ["train_avg", "train_avg_pos", "test_avg", "effective"]
_RATIO = "(sum(w) FILTER (is_train)) ** 2 / (sum(w * w) FILTER (is_train)) / (count(*) FILTER (is_train))"


def auprc_sql(source: str, kept: str) -> str:
    """Area under the precision-recall curve of the rows of a weight table, as a scalar."""
    return f"""(SELECT {R('sum((r - r0) * (p + p0) / 2)')} FROM (
      SELECT *, lag(r, 1, 0) OVER (ORDER BY s DESC) AS r0, coalesce(lag(p) OVER (ORDER BY s DESC), p) AS p0 FROM (
        SELECT s, sum(tp) OVER (ORDER BY s DESC) / sum(tp) OVER () AS r, sum(tp) OVER (ORDER BY s DESC) / sum(n) OVER (ORDER BY s DESC) AS p FROM (
          SELECT round(delta, 9) AS s, count(*) FILTER (y > 0) AS tp, count(*) AS n FROM {source} WHERE {kept} GROUP BY 1))))"""


class TreeSql:
    """Builds one statement; the caller states the course of the run, the SQL finds nodes, sums and weights.

    `update` is the weight after a node fires, from w, y and pred.
    """

    def __init__(self, *ctes: str, update: str = "w * exp(-y * pred)"):
        self.ctes, self.update = list(ctes), update
        self.period, self.step, self.batch = -1, -1, -1
        self.depths: dict[int, int] = {}  # of the nodes whose depth is known beforehand
        self.n_nodes, self.since = 0, 0
        self.records: list[str] = []

    def sample(self, drawn: str, slices: int) -> TreeSql:
        """Rows (row_id, copy, y, is_train, f0 ...) of a sampling period and which thresholds they lie below."""
        self.period += 1
        k = self.period
        long = " UNION ALL ".join(f"SELECT rid, is_train, {f} AS feature, f{f} AS value FROM rows{k}" for f in range(FEATURES))
        self.ctes += [
            f"rows{k} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY row_id, copy) AS rid, * FROM ({drawn}))",
            f"lng{k} AS MATERIALIZED ({long})",
            f"""ranked{k} AS (SELECT *, row_number() OVER v AS rn, lead(value) OVER v AS nx, count(*) OVER (PARTITION BY feature) AS n
                FROM (SELECT DISTINCT feature, value FROM lng{k} WHERE is_train) WINDOW v AS (PARTITION BY feature ORDER BY value DESC))""",
            f"""th{k} AS MATERIALIZED (SELECT feature, 0.5 * (value + nx) AS threshold FROM ranked{k}
                WHERE rn % greatest(1, CAST(floor(n / {slices}) AS INTEGER)) = 0 AND rn < n)""",
            f"cells{k} AS MATERIALIZED (SELECT rid, feature, threshold, value - threshold <= 1e-8 AS le FROM lng{k} JOIN th{k} USING (feature))",
        ]
        return self

    def onehot_sample(self, drawn: str, ones: str) -> TreeSql:
        """Rows (row_id, y, is_train) and the table of their ones (row_id, feature)."""
        self.period += 1
        k = self.period
        self.ctes += [
            f"rows{k} AS MATERIALIZED (SELECT row_id AS rid, y, is_train FROM ({drawn}))",
            f"""th{k} AS MATERIALIZED (SELECT feature, 0.5::DOUBLE AS threshold FROM {ones} JOIN rows{k} ON rid = row_id WHERE is_train
                GROUP BY feature HAVING count(*) < (SELECT count(*) FROM rows{k} WHERE is_train))""",
            f"""cells{k} AS MATERIALIZED (SELECT r.rid, t.feature, t.threshold, o.row_id IS NULL AS le
                FROM rows{k} r CROSS JOIN th{k} t LEFT JOIN {ones} o ON o.row_id = r.rid AND o.feature = t.feature)""",
        ]
        return self

    def root(self) -> TreeSql:
        k = self.period
        self.ctes.append(
            f"""node0 AS MATERIALIZED (SELECT -1 AS parent, -1 AS feature, 0::DOUBLE AS threshold, 0 AS side, 0 AS depth,
                0.5 * ln(count(*) FILTER (y > 0) / count(*) FILTER (y <= 0)) AS pred FROM rows{k} WHERE is_train)""")
        self.depths, self.n_nodes = {0: 0}, 1
        return self._weights(f"SELECT rid, y, is_train, pred AS delta, {self.update} AS w FROM (SELECT *, CAST(1 AS DOUBLE) AS w FROM rows{k}), node0")

    def given(self, nodes: list, since: int, fired: str) -> TreeSql:
        """Continue a given model: `fired` has m0, m1 ... by row_id; only nodes from `since` on change the weights."""
        k = self.period
        for n in nodes:
            self.ctes += [f"""node{n.node_id} AS (SELECT {n.parent_id} AS parent, {n.feature} AS feature, {n.threshold}::DOUBLE AS threshold,
                              {0 if n.split_eval else 1} AS side, {n.depth} AS depth, {n.pred}::DOUBLE AS pred)""",
                          f"in{k}_{n.node_id} AS (SELECT rid FROM rows{k} JOIN {fired} USING (row_id) WHERE m{n.node_id})"]
        self.depths, self.n_nodes, self.since = {n.node_id: n.depth for n in nodes}, len(nodes), since
        delta = " + ".join(["0.0::DOUBLE", *[f"CASE WHEN m{n.node_id} THEN {n.pred} ELSE 0 END" for n in nodes if n.node_id >= since]])
        return self._weights(f"""SELECT rid, y, is_train, delta, exp(-y * delta) AS w
            FROM (SELECT r.rid, r.y, r.is_train, CAST({delta} AS DOUBLE) AS delta FROM rows{k} r JOIN {fired} f ON f.row_id = r.row_id)""")

    def restart(self) -> TreeSql:
        """Roll back to the root on a new sample, whose weights are 1."""
        self.n_nodes, self.since = 1, 1
        self.depths = {0: 0}
        return self._weights(f"SELECT rid, y, is_train, 0::DOUBLE AS delta, 1::DOUBLE AS w FROM rows{self.period}")

    def _weights(self, select: str) -> TreeSql:
        self.step += 1
        self.ctes.append(f"w{self.step} AS MATERIALIZED ({select})")
        return self

    def search(self, k: int, depth: int) -> TreeSql:
        """The k best splits below the nodes of less than `depth`."""
        self.batch += 1
        p, b, w = self.period, self.batch, f"w{self.step}"
        parents = [n for n, d in self.depths.items() if d < depth]
        members = " UNION ALL ".join(
            f"SELECT rid, 0 AS parent FROM rows{p}" if n == 0 else f"SELECT rid, {n} FROM in{p}_{n}" for n in parents)
        self.ctes += [
            f"mem{b} AS MATERIALIZED ({members})",
            f"below{b} AS (SELECT parent, feature, threshold, {CLASS.format(p='lp', n='ln')} FROM mem{b} JOIN cells{p} USING (rid) JOIN {w} USING (rid) WHERE is_train AND le GROUP BY 1, 2, 3)",
            f"inner{b} AS (SELECT parent, {CLASS.format(p='tp', n='tn')} FROM mem{b} JOIN {w} USING (rid) WHERE is_train GROUP BY 1)",
            f"whole{b} AS (SELECT sum(w) AS total FROM {w} WHERE is_train)",
            f"""grid{b} AS (SELECT i.parent, t.feature, t.threshold, tp, tn, total, coalesce(lp, 0) AS lp, coalesce(ln, 0) AS ln
                FROM inner{b} i CROSS JOIN th{p} t CROSS JOIN whole{b}
                LEFT JOIN below{b} l ON l.parent = i.parent AND l.feature = t.feature AND l.threshold = t.threshold)""",
            f"""sides{b} AS (SELECT parent, feature, threshold, 0 AS side, lp AS pos, ln AS neg, greatest(total - lp - ln, 0) AS rej FROM grid{b}
                UNION ALL SELECT parent, feature, threshold, 1, greatest(tp - lp, 0), greatest(tn - ln, 0), greatest(total - tp - tn + lp + ln, 0) FROM grid{b})""",
            f"""cand{b} AS MATERIALIZED (SELECT parent, feature, threshold, side FROM (
                  SELECT *, row_number() OVER (PARTITION BY parent, feature ORDER BY round(z, 8), threshold, side) AS rk
                  FROM (SELECT *, {loss_sql('rej', 'pos', 'neg')} AS z FROM sides{b}) WHERE z IS NOT NULL)
                WHERE rk = 1 ORDER BY round(z, 8), parent, feature, threshold, side LIMIT {k})""",
        ]
        return self

    def admit(self, known_depth: int | None = None) -> TreeSql:
        """The candidate of least loss becomes the next node; its depth is needed where it is to be a parent later."""
        p, b, w, j = self.period, self.batch, f"w{self.step}", self.n_nodes
        name = f"node{j}" if p == 0 else f"node{p}_{j}"
        depth = "CASE parent " + " ".join(f"WHEN {n} THEN {d + 1}" for n, d in self.depths.items()) + " END"
        self.ctes += [
            f"""sums{p}_{j} AS (SELECT parent, feature, threshold, side, {CLASS.format(p='pos', n='neg')}
                FROM cand{b} JOIN mem{b} USING (parent) JOIN cells{p} USING (rid, feature, threshold) JOIN {w} USING (rid)
                WHERE is_train AND le = (side = 0) GROUP BY 1, 2, 3, 4)""",
            f"""{name} AS MATERIALIZED (SELECT parent, feature, threshold, side, {depth} AS depth, {pred_sql('pos', 'neg')} AS pred
                FROM sums{p}_{j}, (SELECT sum(w) AS total FROM {w} WHERE is_train)
                ORDER BY round({loss_sql('greatest(total - pos - neg, 0)', 'pos', 'neg')}, 8), parent, feature, threshold, side LIMIT 1)""",
            f"""in{p}_{j} AS MATERIALIZED (SELECT m.rid FROM {name} n JOIN mem{b} m ON m.parent = n.parent
                JOIN cells{p} c ON c.rid = m.rid AND c.feature = n.feature AND c.threshold = n.threshold WHERE le = (side = 0))""",
        ]
        if known_depth is not None:
            self.depths[j] = known_depth
        self.n_nodes += 1
        return self._weights(f"""SELECT s.rid, y, is_train, CASE WHEN i.rid IS NULL THEN delta ELSE delta + pred END AS delta,
            CASE WHEN i.rid IS NULL THEN w ELSE {self.update} END AS w FROM {w} s LEFT JOIN in{p}_{j} i ON i.rid = s.rid, {name}""")

    def record(self, iteration: int, change: bool = True, **more: str) -> TreeSql:
        """What the history says after the last step; `more` are further columns."""
        w, j = f"w{self.step}", self.n_nodes - 1
        loss = "exp(-y * delta)"
        measured = {
            "train_avg": f"avg({loss}) FILTER (is_train)", "train_avg_pos": f"avg({loss}) FILTER (is_train AND y > 0)",
            "test_avg": f"avg({loss}) FILTER (NOT is_train)", "effective": _RATIO}
        before = f"w{self.step - 1}"
        moved = R4(f"(SELECT sum(w) FROM {w} WHERE is_train) - (SELECT sum(w) FROM {before} WHERE is_train)") if change else "CAST(NULL AS DOUBLE)"
        extra = "".join(f", {v} AS {c}" for c, v in more.items())
        self.records.append(f"""SELECT {iteration} AS iteration, {self.n_nodes} AS n_nodes, {moved} AS weight_change,
            {', '.join(f'{R(v)} AS {c}' for c, v in measured.items())}{extra} FROM {w}""")
        return self

    def node_rows(self) -> str:
        name = [f"node{j}" if self.period == 0 or j < self.since else f"node{self.period}_{j}" for j in range(self.n_nodes)]
        return " UNION ALL ".join(
            f"""SELECT {j} AS node_id, parent AS parent_id, depth, feature, {R('threshold')} AS threshold, side = 0 AS split_eval, {R('pred')} AS pred
            FROM {n}""" for j, n in enumerate(name))

    def statement(self, select: str) -> str:
        """`select` reads `nodes` and `history`."""
        return ("WITH " + ",\n".join([*self.ctes, f"nodes AS ({self.node_rows()})", f"history AS ({' UNION ALL '.join(self.records)})"])
                + "\n" + select)
