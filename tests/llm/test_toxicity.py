"""The string kernel against all subsequences, the collapsed machine against the kernel one, odd texts and held-out accuracy."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from alttree.llm import toxicity as tox
from alttree.llm import queries as llm

P = tox.Params()


def explicit(word, p):
    """Weight of each three-character subsequence, by trying all places."""
    marked, out = [tox.FIRST, *map(ord, word), tox.LAST], {}
    for i, j, k in itertools.combinations(range(len(marked)), 3):
        if k - i < p.span:
            key = (marked[i], marked[j], marked[k])
            out[key] = out.get(key, 0) + p.decay ** (k - i - 2)
    return out


def strings(words):
    ends = np.cumsum([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    return tox.Strings(points, ends - np.array([len(w) for w in words]), ends, np.zeros(len(words), np.int64), np.zeros(1))


def test_kernel_equals_brute_force():
    words = ["idiot", "id1ot", "a", "xx", "aaaa", "pathetic", "réeux", "🙂🙂b", "i-d-i-o-t", "unbelievable"]
    s, every = strings(words), np.arange(10)
    got = tox.kernel(s, every, tox.landmark_table(s, every, P), P)
    plain = [sum(P.decay ** (2 * (k - i - 2)) for i, _, k in itertools.combinations(range(len(w) + 2), 3) if k - i < P.span) for w in words]
    for a, b in itertools.product(range(10), repeat=2):
        u, v = explicit(words[a], P), explicit(words[b], P)
        assert got[a, b] == pytest.approx(sum(x * v.get(k, 0) for k, x in u.items()) / np.sqrt(plain[a] * plain[b]))
    assert got[0, 1] > 0.2 and got[0, 8] > 0.15 > got[0, 9]


def test_strings_of_texts():
    s = tox.strings_of(["", "Hi, you I D i o t! (Yes)\nNo.yes 3.5", "...", "x" * 150])
    words = [(s.text(k), int(np.searchsorted(s.bounds, s.sentence[k], "right")) - 1) for k in range(len(s.start))]
    assert sorted(words) == sorted([
        *((w, 1) for w in ("hi", "you", "i", "d", "i", "o", "t", "idiot", "yes", "no.yes", "3.5")), *(("x" * n, 3) for n in (64, 64, 64, 54))])


def labelled(spark, n=400):
    rng = np.random.default_rng(2)
    syllables = ["the", "and", "ing", "ver", "lo", "mi", "ta", "re", "sol", "na"]
    rows = []
    for k in range(n):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(60)]
        if k % 4 == 0:
            for at in rng.integers(0, 60, 3):
                words[at] = str(rng.choice(["idiot", "moron", "scumbag"]))
        rows.append((k, " ".join(words[:30]) + ". " + " ".join(words[30:]), k % 4 == 0))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], int(r[2])) for r in rows], "doc_id long, label int")


def test_gapped_insults_and_odd_texts(spark):
    docs, labels = labelled(spark)
    p = tox.Params(landmarks=40, sample=250, calibrate=150)
    model = tox.train(docs, labels.unionByName(spark.createDataFrame([(1, None), (None, 1)], "doc_id long, label int")), p)
    rest = "the verlo solna and mita. reing nalo " * 3
    texts = ["an id.iot and a mo-ron and a scumbbag", "I D I O T m o r o n s c u m b a g", "idio-t morron s.cumbag", "", None, " \n", "verlo mita", "x" * 100_000, "the " * 100_000]
    rows = [(k, f"{t} {rest}" if k < 3 else t, "0", 1.0) for k, t in enumerate(texts)] + [(6, "verlo mita", "0", 1.0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, label string, score double")
    got = [(r.doc_id, r.score) for r in tox.score(odd, model, p).collect()]
    scores = dict(got)
    assert len(got) == 10 and all(scores[k] > 0.3 for k in range(3)) and all(scores[k] < 0.3 for k in range(3, 9))
    assert scores[3] == scores[4] == scores[5]
    assert tox.train(docs.orderBy(F.rand(3)).repartition(7), labels, p).dump() == tox.train(docs, labels, p).dump()
    assert tox.score(odd.where("false"), model, p).count() == 0


def test_collapsed_weights_score_as_the_kernel_does():
    s = strings(["idiot", "moron", "lovely", "the", "idi0t"])
    every = np.arange(5)
    table = tox.landmark_table(s, every[:4], P)
    w = np.array([1.0, 0.5, -1.0, -0.3])
    assert tox.kernel(s, every, tox.Table(table.keys, table.values @ w), P) == pytest.approx(tox.kernel(s, every, table, P) @ w)


def test_one_kind_of_label_or_none(spark):
    docs, labels = labelled(spark, 12)
    assert {r.score for r in tox.score(docs, tox.train(docs, labels.where("label = 0"))).collect()} == {0.0}
    assert {r.score for r in tox.score(docs, tox.train(docs, labels.where("false"))).collect()} == {0.5}
    assert {r.score for r in tox.score(docs, tox.train(docs.where("false"), labels)).collect()} == {0.5}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = llm.QUERIES["op13_toxicity"](spark, sf).collect()
    assert len(rows) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [p for y, p in held if y], [p for y, p in held if not y]
    # a sixteenth of the toxic rows are junk in which nothing is left of the insults
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.01
