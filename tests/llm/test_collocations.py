"""Phrase mining against counting every phrase, with searches of many small rounds, and exact scores."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alttree.llm import collocations
from alttree.llm.collocations import Params

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_force(rows, p):
    """(lang, rank, phrase, a, l, r, n, score) from all phrases."""
    counts = {}
    for text, lang in rows:
        f = counts.setdefault(lang or "und" if lang != "" else "", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            f.update(tuple(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        scored = {}
        for g, a in f.items():
            if len(g) > 1 and a >= p.least:
                cuts = [(p.scale * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
                s, k = min(cuts)
                scored[g] = (a, f[g[:k]], f[g[k:]], n, s)
        dropped = {g[i:i + 2] for g, (a, *_) in scored.items() if len(g) == 3 for i in (0, 1) if 100 * a >= p.inside_pct * f[g[i:i + 2]]}
        left = sorted((-s, -a, " ".join(g).encode(), g) for g, (a, _, _, _, s) in scored.items() if g not in dropped)
        out |= {(lang, rank, " ".join(g), *scored[g]) for rank, (_, _, _, g) in enumerate(left[:p.top], 1)}
    return out


def texts(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(25)] + ["Ä", "ä", "New", "york", "é-é", "a b"]
    out = []
    for _ in range(60):
        parts = [words[min(int(rng.pareto(0.7)), len(words) - 1)] + (rng.choice([" ", "\t", ", ", ".", "\n", "  "], p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05])) for _ in range(40)]
        out.append("".join(parts))
    return out + ["new york city hall"] * 7 + ["the end of the road."] * 5 + [None, "", " \t ", ".,;", "one", "x " * 300]


@pytest.mark.parametrize(("seed", "p"), [
    (1, Params(least=2, top=5, word_batch=14, pair_batch=12)), (4, Params(least=2)), (5, Params(least=1, top=12, inside_pct=80, word_batch=30, pair_batch=40)),
])
def test_search_finds_what_counting_finds(spark, seed, p):
    rows = [(t, [None, "en", "und", "de", ""][k % 5 if seed == 4 else k % 3 % 2]) for k, t in enumerate(texts(seed))]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("word", F.lit("x")).withColumn("k", F.lit(1))
    got = collocations.mine(docs, p).collect()
    assert {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == brute_force(rows, p)


def test_bounds_leave_nodes_unexpanded(spark):
    rows = [("rare pair, " * 12 + " ".join(f"common {k % 7} x{k}" for k in range(400)), "en")]
    search = collocations.Search(spark.createDataFrame(rows, "text string, lang string"), Params(least=2, top=1, word_batch=1, pair_batch=1))
    rows = search.run().collect()
    assert [(r.phrase, r.score) for r in rows] == [("rare pair", 1_000_000)]
    assert search.expanded.count() < search.words.count()


def test_scores_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(10**14 - 1, 10**14, 10**14 + 3), (1, 1, 1), (10, 10**14, 10**14)]
    rows += [tuple(sorted(int(x) for x in 10 ** rng.uniform(0, 14.9, 3))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = df.select("a", "l", "r", collocations.exact_score("a", "l", "r", 10**6).alias("s")).collect()
    assert all(x.s == 10**6 * x.a**2 // (x.l * x.r) for x in got)


def test_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_grown_phrases_leave_in_small_batches():
    """A batch of phrases is held outside Spark's heap; none may grow with what a task has seen."""
    words = [f"w{k}" for k in range(200_000)]
    batch = pa.RecordBatch.from_pydict({"lang_key": pa.array([1], pa.int64()), "text": pa.array([" ".join(words).encode()], pa.binary())})
    keys = np.sort(np.concatenate([o.key for _, o in collocations._slices(iter([batch]))]))
    got = list(collocations._grown(2)[0](iter([batch]), keys))
    assert sum(b.num_rows for b in got) == len(words) - 1
    assert max(b.num_rows for b in got) <= 1 << 16
