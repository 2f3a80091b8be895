"""Small fixtures and a plain single-process twin of the training loop to compare with."""

import math
import random

from alttree.schema import DENSE_ROWS, ONEHOT_ROWS, Node

GOLDEN = [
    (0, 1, [0.0, 1.0]), (1, 1, [0.0, 2.0]), (2, 1, [1.0, 2.0]), (3, -1, [1.0, 3.0]), (4, -1, [1.0, 4.0]),
    (5, -1, [0.0, 4.0]), (6, -1, [1.0, 5.0]), (7, 1, [1.0, 1.0]), (8, -1, [1.0, 3.0]), (9, -1, [0.0, 5.0]),
]


def golden_rows(spark):
    return spark.createDataFrame(GOLDEN, DENSE_ROWS)


def random_rows(n=300, features=4, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x = [float(rnd.randrange(12)) for _ in range(features)]
        hidden = (x[0] > 5) + (x[1] < 4) + rnd.random()
        out.append((i, 1 if hidden > 1.2 else -1, x))
    return out


def dense(spark, rows):
    return spark.createDataFrame(rows, DENSE_ROWS)


def random_onehot(n=300, features=20, seed=6):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        nz = sorted(rnd.sample(range(features), 6))
        out.append((i, 1 if (3 in nz) + (7 in nz) + rnd.random() > 0.9 else -1, nz))
    return out


def onehot(spark, rows):
    return spark.createDataFrame(rows, ONEHOT_ROWS)


MODEL = [
    Node(0, -1, 0, -1, 0.0, True, -0.3), Node(1, 0, 1, 0, 5.5, True, 0.4), Node(2, 0, 1, 1, 3.5, False, -0.25),
    Node(3, 1, 2, 2, 7.5, True, 0.2), Node(4, 2, 2, 3, 2.5, False, 0.15), Node(5, 3, 3, 1, 8.5, True, -0.1),
]


def fires(nodes, x):
    hit = {}
    for t in nodes:
        passed = t.feature < 0 or ((x[t.feature] - t.threshold <= 1e-8) == t.split_eval)
        hit[t.node_id] = passed and (t.parent_id < 0 or hit[t.parent_id])
    return hit


def score_of(nodes, x):
    hit = fires(nodes, x)
    return sum(t.pred for t in nodes if hit[t.node_id])


def thresholds_of(values, num_slices):
    d = sorted(set(values), reverse=True)
    size = max(1, len(d) // num_slices)
    return sorted(0.5 * (d[i - 1] + d[i]) for i in range(size, len(d), size))


def loss_of(rej, pos, neg):
    s = rej + pos + neg
    return rej / s + 2 * math.sqrt(max(pos / s * neg / s, 0.0))


def ratio_of(pos, neg):
    if abs(pos) <= 1e-8 and abs(neg) <= 1e-8:
        return 0.0
    r = pos / neg if neg else math.inf
    return math.log(min(10.0, max(r, 0.1)))


def train_plainly(rows, num_slices, batches, k, admit, depth):
    """Boost a tree over lists of (id, y, x): the definition, without Spark."""
    n_pos = sum(y > 0 for _, y, _ in rows)
    nodes = [Node(0, -1, 0, -1, 0.0, True, 0.5 * math.log(n_pos / (len(rows) - n_pos)))]
    width = len(rows[0][2])
    cuts = [thresholds_of([x[f] for _, _, x in rows], num_slices) for f in range(width)]

    def weights():
        return [math.exp(-y * score_of(nodes, x)) for _, y, x in rows]

    def sums(w, c):
        pos = neg = 0.0
        for (_, y, x), wi in zip(rows, w):
            if fires(nodes, x)[c[0]] and (x[c[1]] - c[2] <= 1e-8) == (c[3] == 0):
                pos, neg = (pos + wi, neg) if y > 0 else (pos, neg + wi)
        return pos, neg

    for _ in range(batches):
        w = weights()
        best = []
        for t in [t for t in nodes if t.depth < depth]:
            for f in range(width):
                options = []
                for thr in cuts[f]:
                    for side in (0, 1):
                        pos, neg = sums(w, (t.node_id, f, thr, side))
                        options.append((round(loss_of(sum(w) - pos - neg, pos, neg), 8), thr, side))
                if options:
                    z, thr, side = min(options)
                    best.append((z, t.node_id, f, thr, side))
        candidates = [b[1:] for b in sorted(best)[:k]]
        for _ in range(admit):
            w = weights()
            scored = []
            for c in candidates:
                pos, neg = sums(w, c)
                scored.append((round(loss_of(sum(w) - pos - neg, pos, neg), 8), c, 0.5 * ratio_of(pos, neg)))
            _, c, pred = min(scored)
            nodes.append(Node(len(nodes), c[0], nodes[c[0]].depth + 1, c[1], c[2], c[3] == 0, pred))
    return nodes
