"""Column builders for comparisons, split tests, losses and weight updates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Comparison tolerance, and the range a weight ratio is clamped to.
EPS = 1e-8
RATIO_MIN, RATIO_MAX = 0.1, 10.0


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def compare(a, b=0.0, eps: float = EPS) -> Column:
    """-1, 0 or 1; values within `eps` count as equal, and so does NaN."""
    d = _col(a) - _col(b)
    return F.when(F.isnan(d), 0).when(d < -eps, -1).when(d > eps, 1).otherwise(0)


def check(value, feature, threshold, split_eval) -> Column:
    """Does a row pass a node's test? The root (feature < 0) lets every row through."""
    at_most = compare(value, threshold) <= 0
    return (_col(feature) < 0) | (at_most == _col(split_eval))


def node_prediction(value, feature, threshold, split_eval, pred) -> Column:
    return F.when(check(value, feature, threshold, split_eval), _col(pred)).otherwise(0.0)


def safe_log_ratio(a, b) -> Column:
    """ln(a/b) with the ratio kept in [0.1, 10]; 0 when both weights vanish."""
    a, b = _col(a), _col(b)
    ratio = F.when(b == 0, F.when(a > 0, RATIO_MAX).otherwise(RATIO_MIN)).otherwise(F.try_divide(a, b))
    clamped = F.least(F.lit(RATIO_MAX), F.greatest(ratio, F.lit(RATIO_MIN)))
    return F.when((F.abs(a) <= EPS) & (F.abs(b) <= EPS), 0.0).otherwise(F.ln(clamped))


def boost_loss(rej, pos, neg) -> Column:
    """Share of rejected weight plus twice the geometric mean of the class shares."""
    rej, pos, neg = _col(rej), _col(pos), _col(neg)
    total = rej + pos + neg
    product = F.try_divide(pos, total) * F.try_divide(neg, total)
    return F.try_divide(rej, total) + 2 * F.sqrt(F.greatest(product, F.lit(0.0)))


def adaboost_weight(y, w, pred) -> Column:
    return _col(w) * F.exp(-_col(y) * _col(pred))


def logit_weight(y, w, pred) -> Column:
    return _col(w) / (1.0 + F.exp(_col(y) * _col(pred)))


def is_pos(y="y") -> Column:
    return F.col(y) > 0


def class_sums(weight="w", y="y") -> list[Column]:
    """The four aggregates every split statistic is made of."""
    pos = is_pos(y)
    w = F.col(weight) if isinstance(weight, str) else weight
    return [
        F.sum(F.when(pos, w).otherwise(0.0)).alias("w_pos"),
        F.sum(F.when(pos, 0.0).otherwise(w)).alias("w_neg"),
        F.count_if(pos).alias("n_pos"),
        F.count_if(~pos).alias("n_neg"),
    ]
