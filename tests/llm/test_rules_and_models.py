"""Formatting, filters, sharding, quality and the pipeline; odd rows and empty tables for every operator."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from alttree.llm import bpe, chat, graph, jaccard, packing, quality_classifier, quality_rules, sharding, suffix_dedup, url_filter, vector_dedup
from alttree.llm import queries as llm

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# Chat


def test_best_branch_of_a_reply_tree(spark):
    rows = [
        ("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", "a[1]~<", 1.0), ("t", 3, 1, "assistant", "b", 5.0),
        ("t", 4, 2, "user", "go on", 9.0), ("t", 5, 4, "assistant", None, None), ("t", 6, 3, None, "tie", 5.0),
        ("u", 1, 77, "user", "</s>[x]", 1.0), (None, 1, None, "user", "no tree id", 0.0), ("c", 1, 2, "user", "circle", 0.0), ("c", 2, 1, "user", "circle", 0.0),
    ]
    messages = spark.createDataFrame(rows, "tree_id string, node_id long, parent_id long, role string, text string, score double")
    out = chat.format_paths(messages, chat.best_paths(messages, 2)).withColumn("turns", chat.parse(F.col("formatted"))).withColumn(
        "loss", chat.masked_text(F.col("formatted"), F.col("mask"))).collect()
    got = {(r.tree_id, r["rank"]): ([(t.role, t.text) for t in r.turns], r.loss, r.score) for r in out}
    assert got == {
        ("t", 1): ([("user", "hi"), ("assistant", "b"), ("", "tie")], "b", 10.0),  # leaf 5 has 10.0 too, and the smaller id
        ("t", 2): ([("user", "hi"), ("assistant", "b"), ("", "tie")], "b", 10.0),
        ("u", 1): ([("user", "</s>[x]")], "", 1.0), (None, 1): ([("user", "no tree id")], "", 0.0),
    } | {("t", 1): ([("user", "hi"), ("assistant", "a[1]~<"), ("user", "go on"), ("assistant", "")], "a[1]~<", 10.0)}


def test_long_chain(spark):
    messages = spark.range(1, 301).select(
        F.lit(1).alias("tree_id"), F.col("id").alias("node_id"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"),
        F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"), F.lit(0.0).alias("score"))
    out = chat.format_paths(messages, chat.best_paths(messages)).select(chat.masked_text(F.col("formatted"), F.col("mask")).alias("x")).collect()
    assert [r.x for r in out] == ["".join(map(str, range(1, 301)))]


# URLs


def test_rules_and_reputation(spark):
    urls = [
        "http://a.net/x", "http://A.NET", "https://example.net/en/a", "https://x.example.net/en", "ftp://example.com/de/?q", "http://org/fr/x",
        "http://b.org/fr/x?y#z", "no scheme", None, "http://bad.site.info/p", "http://bad.site.info/q", "x://badexample.net?://", "http://good.info/",
    ]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(1000 + k, "http://bad.site.info/r", "h") for k in range(60)]
                                  + [(2000 + k, "http://good.info/r", "h") for k in range(60)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1000 + k, True) for k in range(60)] + [(2000 + k, False) for k in range(60)] + [(5, None)], "page_id long, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels, url_filter.RULES).collect() if r.page_id < 1000}
    assert got == {
        0: ("a.net", "/x", "net/", "block"), 1: ("a.net", "", None, "allow"), 2: ("example.net", "/en/a", "example.net/en/", "allow"),
        3: ("x.example.net", "/en", "net/", "block"), 4: ("example.com", "/de/", "example.com/de/", "block"), 5: ("org", "/fr/x", "org/fr/", "allow"),
        6: ("b.org", "/fr/x", "org/fr/", "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("bad.site.info", "/p", None, "block"),
        10: ("bad.site.info", "/q", None, "block"), 11: ("badexample.net", "", None, "allow"), 12: ("good.info", "/", None, "allow"),
    }


def test_few_labels_lean_on_the_domain(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 20}.spam.biz/") for k in range(200)] + [(999, "http://new.spam.biz/")]
                                  + [(2000 + k, f"http://h{k % 20}.fine.org/") for k in range(200)] + [(2999, "http://new.fine.org/")], "page_id long, url string")
    labels = spark.range(3000).select(F.col("id").alias("page_id"), (F.col("id") < 200).alias("bad")).where("id < 200 or (id >= 2000 and id < 2200)")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labels, []).collect()}
    assert got[999] == "block" and got[2999] == "allow"


# Sharding


def test_lookup_table_is_even_and_moves_little():
    names = [f"n{k}" for k in range(10)]
    table = sharding.lookup_table(names, 1009)
    sizes = np.bincount(table)
    assert sizes.max() - sizes.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.15 * 1009
    heavy = np.bincount(sharding.lookup_table(names, 1009, {"n3": 3}))
    assert heavy[3] == pytest.approx(3 * heavy[0], abs=3)
    for slots in (1000, 7):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, slots)


def test_placement(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("", 4)], "key string, slot int")
    got = [(r["key"], r.slot, r.shard) for r in sharding.place(rows, "key", ["x", "y"], 11).collect()]
    assert len(got) == 4 and len({g[1:] for g in got if not g[0]}) == 1 and len({g for g in got if g[0] == "a"}) == 1


# Quality


def test_quality_rules_on_odd_texts(spark):
    good = " ".join(f"w{k}" for k in range(60))
    texts = [None, "", " \n\t", good, good, "x " * 100, good.replace("w", "W") + "\nFooter  line", "footer line\n" + good.replace("w", "v") + "\nfooter line",
             "ä#é|<> " * 3, "word " * 30_000]
    rows = [(k, t, "en", "s", 1, "z") for k, t in enumerate(texts)] + [(3, good, "en", "s", 1, "z"), (50, good, "en", None, 1, "z")]
    docs = spark.createDataFrame(rows, f"{DOCS}, kept string").withColumn("row_id", F.lit(1))
    limits = quality_rules.Limits(min_docs=2, max_share=0.1)
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_removed_words, r.kept)
           for r in quality_rules.judge(docs, limits).collect()}
    chars = len(good.replace(" ", ""))
    assert got == {
        (0, 0, 0, 0, 0, 0, True, 0, False), (1, 0, 0, 0, 0, 0, True, 0, False), (2, 0, 0, 0, 0, 0, True, 0, False),
        (3, 60, chars, 0, 0, 0, False, 60, False), (4, 60, chars, 0, 0, 0, False, 60, False), (5, 100, 100, 0, 0, 100, True, 0, False),
        (6, 62, chars + 10, 0, 0, 0, False, 62, False), (7, 64, chars + 20, 0, 1, 0, False, 4, True),
        (8, 3, 18, 12, 0, 0, True, 0, False), (9, 30000, 120000, 0, 0, 30000, True, 0, False), (50, 60, chars, 0, 0, 0, False, 0, True)}
    left = quality_rules.apply(docs, limits)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(7, good.replace("w", "v")), (50, good)]


def test_classifier_learns_and_scores_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    scored = llm.QUERIES["op9_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right = scored.select(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.98


def test_interactions_equal_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    raw = np.frombuffer("Some words, some MORE words | and 12 words!\n\nmore".encode(), np.uint8)
    x = quality_classifier.features(raw, np.array([0, len(raw)]), np.array([np.nan]), 64)
    s = x.dense.shape[1]
    m = quality_classifier.Model(0.5, rng.normal(size=64), rng.normal(size=(64, 3)), rng.normal(size=s), rng.normal(size=(s, 3)))
    value, vector = np.concatenate([x.value, x.dense[0]]), np.concatenate([m.v[x.bucket], m.dense_v])
    pairs = sum(value[i] * value[j] * vector[i] @ vector[j] for i in range(len(value)) for j in range(i))
    linear = np.concatenate([m.w[x.bucket], m.dense_w]) @ value
    assert quality_classifier.raw_score(m, x)[0][0] == pytest.approx(linear + pairs)


def test_classifier_on_odd_rows(spark):
    rows = [(k, f"good text number {k} with words", "en", "s", None) for k in range(40)] + [(100 + k, "BAD!! " * 20, "en", "s", 5) for k in range(40)]
    rows += [(500, None, None, None, None), (501, "", None, None, 0), (501, "", None, None, 0), (None, "x" * 50_000, None, None, 1)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], f"{DOCS}, label int")
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(100 + k, 0) for k in range(40)] + [(3, None), (None, 1), (5, 1)], "doc_id long, label int")
    p = quality_classifier.Params(buckets=256, epochs=40)
    scores = quality_classifier.score(docs, quality_classifier.train(docs, labels, p), p).collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
    by_id = {r.doc_id: r.score for r in scores}
    assert min(by_id[k] for k in range(40)) > 0.7 > 0.3 > max(by_id[100 + k] for k in range(40))
    kept = quality_classifier.select_good(docs, labels, p)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(40))
    one_kind = quality_classifier.train(docs, labels.where("label = 1"), p)
    assert {r.score for r in quality_classifier.score(docs, one_kind, p).collect()} == {1.0}


# Every operator


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    pages = spark.createDataFrame([], "page_id long, url string")
    bad = spark.createDataFrame([], "page_id long, bad boolean")
    talk = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    messages = chat.reply_chains(talk)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, label int")
    for out in (
        bpe.encode(docs), chat.format_paths(messages, chat.best_paths(messages)), suffix_dedup.removal(docs), suffix_dedup.without_repeats(docs),
        vector_dedup.near_duplicates(vectors, "vec_id", "embedding"), url_filter.judge(pages, bad, url_filter.RULES), sharding.place(docs, "doc_id", ["a"], 7),
        quality_rules.judge(docs), quality_rules.apply(docs), packing.pack_documents(docs), quality_classifier.select_good(docs, labels),
        jaccard.link(docs), jaccard.one_each(docs), graph.components(spark.createDataFrame([], "a long, b long")),
    ):
        assert out.collect() == []


def test_components_of_paths_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(100)] + [(500, k) for k in range(501, 560)] + [(700, 701), (701, 702), (702, 700), (9, 9), (101 + 300, 700)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert got == {k: 0 for k in range(101)} | {k: 500 for k in range(500, 560)} | {401: 401, 700: 401, 701: 401, 702: 401}


# Pipeline


def test_pipeline_stages(spark):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in "bcdfghklmnprstvw" for b in ("an", "el", "ir", "on", "ut", "es", "ad", "om")]

    def prose(n):
        return " ".join(rng.choice(words, n))

    copy, passage = prose(200), prose(60)
    near = copy.split()
    near[100] = "changed"
    clean = [prose(int(n)) for n in rng.integers(80, 300, 60)]
    rows = [(k, t) for k, t in enumerate(clean)] + [(100, copy), (101, copy), (102, " ".join(near)), (103, copy.upper())]
    rows += [(200, prose(100) + " " + passage), (201, passage + " " + prose(100)), (300, "too short"), (301, None), (302, "again " * 80)]
    rows += [(400 + k, " ".join(f"{w}###" for w in prose(120).split())) for k in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    kept = corpus_pipeline.rules(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {300, 301, 302}
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(400 + k, 0) for k in range(20)], "doc_id long, label int")
    good = quality_classifier.select_good(kept, labels, quality_classifier.Params(buckets=1024, epochs=40))
    ids = {r.doc_id for r in good.collect()}
    assert set(range(60)) <= ids and not ids & set(range(400, 430))
    one = corpus_pipeline.near_duplicates(spark, kept, SF)
    assert {r.doc_id for r in one.collect()} == {i for i, _ in rows} - {300, 301, 302, 101, 102, 103}
    cut = corpus_pipeline.repeated_passages(spark, one, SF)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert passage not in texts[200] and passage not in texts[201] and texts[5] == clean[5] and texts[100] == copy
    packed = corpus_pipeline.pack(spark, cut, SF)
    assert {r.doc_id for r in packed.collect()} == set(texts)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_runs(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert len(rows) and (rows.groupby("sequence_id")["length"].sum() <= 2048).all()
