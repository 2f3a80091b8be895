"""Readers, encodings, stores and descriptions."""

import random

import pytest
from pyspark.sql import functions as F

from alttree.operators import encode
from alttree.plans import describe
from alttree.schema import Node, nodes_df
from alttree.sources import rows, store
from helpers import MODEL, dense, random_rows


def _seq(n, seed):
    rnd = random.Random(seed)
    return "".join(rnd.choice("ACGT") for _ in range(n))


def test_sequence_text_roundtrip(spark, tmp_path):
    data = [(1, _seq(150, 1)), (-1, _seq(141, 2))]
    path = str(tmp_path / "seq")
    rows.write_sequences(spark.createDataFrame(data, "y int, seq string"), path)
    found = rows.read_sequences(spark, path).collect()
    assert sorted((r.y, r.seq) for r in found) == sorted(data) and len({r.row_id for r in found}) == 2
    assert encode.encode(rows.read_sequences(spark, path)).count() == 2
    spark.createDataFrame([("garbage",)], "value string").write.mode("append").text(path)
    with pytest.raises(Exception, match="malformed line: garbage"):
        rows.read_sequences(spark, path).collect()
    kept = rows.read_sequences(spark, path, on_malformed="null").collect()
    assert sorted(r.y for r in kept if r.y is not None) == [-1, 1] and len(kept) == 3


def test_dense_csv(spark, tmp_path):
    path = str(tmp_path / "csv")
    spark.createDataFrame([("1.0, 2.5 ,3",), ("0, -1,4e2",)], "value string").write.text(path)
    got = sorted((r.y, r.features) for r in rows.read_dense_csv(spark, path).collect())
    assert got == [(-1, [-1.0, 400.0]), (1, [2.5, 3.0])]


def test_encoding_by_hand(spark):
    seq = _seq(141, 3)
    df = spark.createDataFrame([(0, 1, seq), (1, 1, seq[:100])], "row_id long, y int, seq string")
    win = seq[:59] + seq[61:141]
    single = [i * 4 + "ACGT".index(c) for i, c in enumerate(win)]
    pair = [556 + i * 16 + 4 * "ACGT".index(a) + "ACGT".index(b) for i, (a, b) in enumerate(zip(win, win[1:]))]
    short = seq[:59] + seq[61:100]
    some = [f for f in single if f < 4 * len(short)]
    assert [r.nz for r in encode.encode(df).collect()] == [single, some]
    some_pairs = [f for f in pair if f < 556 + 16 * (len(short) - 1)]
    assert [r.nz for r in encode.encode(df, pairs=True).collect()] == [sorted(single + pair), sorted(some + some_pairs)]
    with pytest.raises(Exception, match="shorter than 141"):
        encode.encode(df, on_short="error").collect()
    assert (encode.n_features(), encode.n_features(True)) == (556, 2764)


def test_unknown_letters(spark):
    seq = _seq(141, 4)
    bad = "N" + seq[1:]
    df = spark.createDataFrame([(0, 1, seq), (1, -1, bad)], "row_id long, y int, seq string")
    with pytest.raises(Exception, match="letter outside the alphabet in row 1"):
        encode.encode(df).collect()
    assert [r.row_id for r in encode.encode(df, on_unknown="skip").collect()] == [0]
    sizes = {r.row_id: len(r.nz) for r in encode.encode(df, pairs=True, on_unknown="null").collect()}
    assert sizes == {0: 139 + 138, 1: 138 + 137}
    with pytest.raises(ValueError):
        encode.encode(df, on_unknown="maybe")


def test_dictionary(spark):
    found = {r.feature: (r.name, r.pos, r.token) for r in encode.feature_dictionary(spark, pairs=True).collect()}
    assert len(found) == 2764
    assert found[0] == ("0A", 0, "A") and found[555] == ("138T", 138, "T")
    assert found[556] == ("0AA", 0, "AA") and found[2763] == ("137TT", 137, "TT")


def test_model_roundtrip(spark, tmp_path):
    path = str(tmp_path / "model")
    store.save_model(spark, MODEL, path)
    store.save_model(spark, MODEL, path)
    assert store.load_model(spark, path) == MODEL
    assert store.load_model(spark, path, 3) == MODEL[:3]


def test_sample_roundtrip(spark, tmp_path):
    sample = dense(spark, random_rows(50)).withColumn("is_train", F.col("row_id") < 30)
    path = str(tmp_path / "sample")
    assert store.save_sample(sample, path)
    back = store.load_sample(spark, path).select(*sample.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sample.collect()))
    assert not store.save_sample(sample, "nosuchscheme://x/y")
    with pytest.raises(Exception):
        store.save_sample(sample, "nosuchscheme://x/y", required=True)


def test_shared_folder_follows_the_session(spark):
    assert store.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_descriptions(spark, tmp_path):
    nodes = [
        Node(0, -1, 0, -1, 0.0, True, 0.2), Node(1, 0, 1, 4, 0.5, False, 0.5), Node(2, 1, 2, 9, 0.5, True, -0.7),
        Node(3, 2, 3, 2, 1.5, True, 0.1),
    ]
    names = encode.feature_dictionary(spark)
    described = describe.describe(nodes_df(spark, nodes), names)
    rules = {r.node_id: r.rule for r in described.collect()}
    assert rules == {0: "", 1: "is 1A", 2: "is 1A and isnot 2C", 3: "is 1A and isnot 2C and is 0G"}
    assert [r.node_id for r in describe.by_abs_pred(described).collect()] == [2, 1, 0, 3]
    describe.write_description(described, str(tmp_path / "desc"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "desc")).collect()]
    assert "2, 2, -0.7, is 1A and isnot 2C" in lines
    texts = {r.node_id: r.text for r in describe.render(nodes_df(spark, nodes)).collect()}
    assert texts[1] == "#1 below 0: feature 4 above 0.500000 adds 0.500000; splits further: 1"
    contribution = {(r.sign, r.pos, r.token, r.kind): r.score
                    for r in describe.position_contribution(nodes_df(spark, nodes), names).collect()}
    # both positive rules start with "is 1A", and so does the negative one
    assert contribution["pos", 1, "A", "is"] == pytest.approx(1.0) and contribution["neg", 1, "A", "is"] == pytest.approx(1.0)
    assert contribution["pos", 0, "G", "is"] == 0.0 and len(contribution) == 2 * 2 * 4 * 2
    bounded = describe.position_contribution(nodes_df(spark, nodes), names, 1, 3)
    assert {r.pos for r in bounded.select("pos").distinct().collect()} == {1, 2, 3}
    signed = describe.signed_contribution(describe.position_contribution(nodes_df(spark, nodes), names))
    assert {r.score for r in signed.where("pos = 1 and token = 'A' and kind = 'is'").collect()} == {1.0, -1.0}


def test_long_path(spark):
    nodes = [Node(0, -1, 0, -1, 0.0, True, 0.0)] + [Node(i, i - 1, i, i, 0.5, True, 0.1) for i in range(1, 8)]
    paths = describe.ancestors(nodes_df(spark, nodes)).where("node_id = 7").orderBy("step").collect()
    assert [r.ancestor for r in paths] == list(range(7, -1, -1))


def test_paths_of_deep_and_bushy_trees(spark):
    rnd = random.Random(8)
    nodes = [Node(0, -1, 0, -1, 0.0, True, 0.1)]
    for k in range(1, 400):
        parent = nodes[-1] if k < 45 else nodes[rnd.randrange(len(nodes))]
        nodes.append(Node(k, parent.node_id, parent.depth + 1, 0, 0.5, True, 0.1))
    expected = {}
    for t in nodes:
        expected[t.node_id] = [t.node_id, *expected.get(t.parent_id, [])]
    found = {}
    for r in describe.ancestors(nodes_df(spark, nodes)).collect():
        found.setdefault(r.node_id, {})[r.step] = r.ancestor
    assert {k: [v[i] for i in range(len(v))] for k, v in found.items()} == expected
    assert describe.ancestors(nodes_df(spark, nodes[:1])).count() == 1 and describe.ancestors(nodes_df(spark, nodes[:2])).count() == 3


def test_first_terms_of_odd_trees(spark):
    """The highest named test of each path, without a record per node and ancestor: such records met in one task at the root."""
    rnd = random.Random(9)
    nodes = [Node(0, -1, 0, -1, 0.0, True, 0.1)]
    for k in range(1, 300):
        parent = nodes[-1] if k < 25 else nodes[rnd.randrange(len(nodes))]
        nodes.append(Node(k, parent.node_id, parent.depth + 1, rnd.choice([4, 9, 9999, -1]), rnd.choice([0.5, 1.5]), rnd.random() < 0.5, rnd.uniform(-1, 1)))
    gone = 30
    stay = [n for n in nodes if n.node_id != gone]
    expected, parts = {0: None, gone: "gone"}, {}
    for n in stay[1:]:
        above = expected[n.parent_id]
        own = (n.feature, "is" if (1.0 <= n.threshold) == n.split_eval else "isnot") if n.feature in (4, 9) else None
        expected[n.node_id] = above or own
    twice = [*stay, *stay[40:60]]
    for n in twice:
        if expected[n.node_id] not in (None, "gone"):
            key = ("neg" if n.pred < 0 else "pos", *expected[n.node_id])
            parts[key] = parts.get(key, 0) + abs(n.pred)
    names, table = encode.feature_dictionary(spark), nodes_df(spark, twice)
    found = {r.node_id: (r.code // 2, "is" if r.code % 2 else "isnot") for r in describe.first_terms(table, names).collect()}
    assert found == {k: v for k, v in expected.items() if v not in (None, "gone")}
    out = describe.position_contribution(table, names)
    assert "posexplode" not in out._jdf.queryExecution().toString()
    top = {s: max(sum(v for k, v in parts.items() if k[0] == s and k[1] == f) for f in (4, 9)) for s in ("pos", "neg")}
    scores = {(r.sign, r.pos, r.token, r.kind): r.score for r in out.where("score > 0").collect()}
    letter = {4: (1, "A"), 9: (2, "C")}
    assert scores == {(s, *letter[f], kind): pytest.approx(v / top[s]) for (s, f, kind), v in parts.items()}
