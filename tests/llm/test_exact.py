"""Operators against brute force or the library they must equal, on small frames with odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from alttree.llm import bitmaps, bpe, jaccard, packing, quality_rules, suffix_dedup, vector_dedup
from alttree.llm import wordbytes as wb

LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


ODD_TEXTS = [
    None, "", " \t\n", "one", "One two  three\nfour", "a" * 6000, "ab" * 3000 + " x " + "it's" * 900, "İßΣ" * 1500, "🙂" * 900,
    "x<|endoftext|>y <|startoftext|> Z" + "q" * 5000 + "<|endoftext|>", "\x1c\x00a　b\u0085c é l'été 12345", "word " * 5000,
]


@pytest.mark.parametrize("long", [60, 4096])
def test_bpe_equals_the_library(spark, tokenizer, long):
    rng = np.random.default_rng(0)
    texts = [*ODD_TEXTS, "".join(rng.choice(list("thnande'5é."), 7000)), "one", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe.encode(docs, long=long).collect()
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in rows}
    expected = {k: tokenizer.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    assert got == expected and len(rows) == len(texts)
    enc = bpe.encoder(bpe.vocabulary(), long)
    n, ids_sha, text_sha = (a.to_pylist() for a in bpe.digests(enc, [bpe.ids_bytes(i) for i in expected.values()]))
    for k, ids in expected.items():
        assert n[k] == len(ids)
        assert ids_sha[k] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert text_sha[k] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_latin_texts_are_cut_and_encoded_together(tokenizer, monkeypatch):
    """Equal to the library; words that differ in capitals or in the signs round them are no words of their own."""
    rng = np.random.default_rng(7)
    odd = ["", " ", "'s", "'S's 're'vex 'll''ll !'s x'd9'm", "'", "a'", "'r e", "Étéİ", "KK'Ve x­", "<|endoftext|>'s", "z" * 3000, "z" * 5000]
    texts = odd + ["".join(rng.choice(list("'''srevelltmd aA.é9\n\t&ǅ"), rng.integers(1, 60))) for _ in range(800)]
    cut = [f" {t}" for t in (x.lower() for x in texts) if bpe.LATIN_TEXT.fullmatch(t)]
    start, end = bpe.latin_pieces(np.frombuffer("".join(cut).encode("utf-16-le"), "<u2"))
    assert len(cut) > 600 and ["".join(cut)[a:b] for a, b in zip(start, end, strict=True)] == [p for t in cut for p in bpe.LATIN_PIECES.findall(t)]
    expected = [bpe.ids_bytes(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    column, long = pa.array([t.encode() for t in texts], pa.binary()), texts.index("z" * 5000)

    def ids(enc):
        return [b"" if k == long and isinstance(i, list) else i for k, i in enumerate(bpe.word_ids(column, enc))]

    expected[long] = b""
    assert ids(bpe.Encoder(bpe.vocabulary())) == expected
    monkeypatch.setattr(bpe, "TOGETHER", 100)
    monkeypatch.setattr(bpe, "stretch", lambda sums, start, end: end - start)  # hashes that clash
    assert ids(bpe.Encoder(bpe.vocabulary())) == expected
    enc = bpe.Encoder(bpe.vocabulary())
    list(bpe.word_ids(pa.array([b"word Word WORD, 'word' (word) word; *word"], pa.binary()), enc))
    assert len(enc.words) == len({"word", ",", "'", "(", ")", ";", "*"})


def test_join_of_halves_equals_the_whole():
    enc, rng = bpe.encoder(bpe.vocabulary()), np.random.default_rng(5)
    for _ in range(300):
        word = "".join(rng.choice(list("thenandio"), rng.integers(2, 60)))
        cut = int(rng.integers(1, len(word)))
        left, right = enc.merge(list(word[:cut])), enc.merge([*word[cut:-1], word[-1] + enc.suffix])
        assert bpe.ids_bytes([enc.vocab[t] for t in enc.join(left, right)]) == enc.pieces.all([word])[0]


def test_packing_places_every_token_once(spark, tokenizer):
    rng = np.random.default_rng(1)
    texts = [*ODD_TEXTS, *(" ".join(["the"] * int(n)) for n in rng.integers(1, 3000, 120)), "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p = packing.Params(group=40)
    rows = packing.pack_documents(docs, p).toPandas()
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    assert rows.groupby("doc_id")["length"].sum().to_dict() == {k: len(v) for k, v in ids.items()}
    for r in rows.itertuples():
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.start == r.piece * p.size and r.length == min(p.size, len(ids[r.doc_id]) - r.start)
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == list(np.cumsum(s["length"]) - s["length"]) and s["length"].sum() <= p.size
    assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // p.size) + 5  # one underfull bin a group at most


def test_local_search_empties_bins():
    lengths = np.array([6, 5, 4, 3, 3, 3])  # two bins of 12 hold all
    bins = packing.improve([[0, 2], [1, 3], [4, 5]], lengths, 12, 100)
    assert len(bins) == 2 and sorted(k for b in bins for k in b) == list(range(6))
    assert all(lengths[b].sum() <= 12 for b in bins)
    rng = np.random.default_rng(2)
    for _ in range(50):
        lengths = rng.integers(1, 60, 80)
        start = packing.best_fit(lengths, 64)
        before = len(start)
        bins = packing.improve(start, lengths, 64, 200)
        assert len(bins) <= before and all(lengths[b].sum() <= 64 for b in bins)
        assert sorted(k for b in bins for k in b) == list(range(80))


def test_local_search_covers_all_underfull_bins():
    rng = np.random.default_rng(4)
    lengths = rng.integers(400, 701, 6000)
    start = packing.best_fit(lengths, 2048)
    assert sum(lengths[b].sum() < 2048 for b in start) > 1000
    bins = packing.improve([list(b) for b in start], lengths, 2048)
    assert len(bins) <= len(start) - 50 and sorted(k for b in bins for k in b) == list(range(6000))
    assert all(lengths[b].sum() <= 2048 for b in bins)
    lengths = rng.integers(12, 40, 300)
    bins = packing.improve(packing.best_fit(lengths, 64), lengths, 64)
    sets = [{n for k in range(len(b)) for n in (lengths[b[k]], *(lengths[b[k]] + lengths[j] for j in b[:k]))} for b in bins]
    for donor, n_of in zip(bins, sets, strict=True):
        for target in bins:
            room = 64 - lengths[target].sum()
            if donor is not target and lengths[target].sum() >= lengths[donor].sum():
                assert not any(0 < n - m <= room for n in n_of for m in (0, *lengths[target]))


def brute_repeats(rows, threshold):
    seen = Counter(b[p:p + threshold] for _, b in rows for p in range(len(b) - threshold + 1))
    out = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - threshold + 1):
            if seen[b[p:p + threshold]] > 1:
                gone[p:p + threshold] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("threshold, first, bits", [(200, 136, 30), (40, 20, 30), (40, 20, 8)])
def test_repeats_equal_brute_force(spark, threshold, first, bits):
    """With 8 bits nearly all anchors are marked: more is listed and the rows stay the same."""
    rng = np.random.default_rng(threshold)

    def noise(n):
        return "".join(rng.choice(list("abcdefgh é"), n))

    base, texts = noise(2000), []
    for _ in range(30):
        a, n = int(rng.integers(0, 1500)), int(rng.integers(20, 450))
        texts.append((len(texts), noise(int(rng.integers(0, 250))) + base[a:a + n] + noise(int(rng.integers(0, 250)))))
    texts += [(100, "a" * 1000), (101, "a" * threshold), (102, "a" * (threshold + 1)), (103, ""), (104, base), (105, "ab" * 400)]
    texts += [(105, "ab" * 400), (106, "ab" * 400), (107, base[:threshold - 1]), (108, ("xyz" * 100 + "q") * 3), (200, None), (None, base[100:900])]
    docs = spark.createDataFrame([(*t, "k1") for t in texts], "doc_id long, text string, k1 string")
    p = suffix_dedup.Params(threshold=threshold, first=first, bitmap_bits=bits)
    got = [tuple(r) for r in suffix_dedup.removal(docs, p).collect()]
    expected = brute_repeats([(i, (t or "").encode()) for i, t in texts], threshold)
    assert sorted(map(str, got)) == sorted(map(str, expected))
    if first == 20:
        whole = suffix_dedup.without_repeats(docs, p)
        assert whole.columns == docs.columns and whole.count() == len(texts)


def test_bitmaps_grow_with_what_they_mark(spark):
    """The share of hashes marked by a clash stays below a twentieth when the input grows 16-fold; none that is counted is missed."""

    def hashes(column):
        yield wb.mixed(np.array([int(x) for x in column.to_pylist()], np.uint64))

    for n in (5_000, 80_000):
        rows = spark.range(n).selectExpr("explode(array(id, id, id + 1000000)) as v").unionByName(spark.range(40).selectExpr("id as v"))
        twice, thrice, none = bitmaps.count_bitmaps(rows.selectExpr("cast(v as string) as text"), hashes, [2, 3, 9])
        known, others = (wb.mixed(np.arange(a, b, dtype=np.uint64)) for a, b in ((0, n), (1_000_000, 1_000_000 + n)))
        assert bitmaps.marked(twice, known).all() and bitmaps.marked(twice, others).mean() < 0.05
        assert bitmaps.marked(thrice, known[:40]).all() and bitmaps.marked(thrice, known[40:]).mean() < 0.05
        assert not none.any() and len(thrice) < len(twice) == 1 << (20 * n).bit_length() - 3
    empty = bitmaps.count_bitmaps(spark.createDataFrame([], "text string"), hashes, [1])
    assert not empty[0].any()


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_classes(texts, p):
    sets = [shingles(t, p.width) for _, t in texts]
    group = list(range(len(texts)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= p.percent * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    members = {}
    for k in range(len(texts)):
        members.setdefault(root(k), []).append(texts[k][0])
    return sorted((i, len(s), min(members[root(k)])) for k, ((i, _), s) in enumerate(zip(texts, sets, strict=True)))


@pytest.mark.parametrize("percent, frequent, tile, bits", [(85, 32, 256, 30), (80, 3, 8, 30), (85, 32, 256, 12)])
def test_jaccard_equals_brute_force(spark, percent, frequent, tile, bits):
    """With `frequent` 3 the groups below consist of frequent tokens, whose pairs are the keys, and blocks have many tiles.
    Bitmaps of 12 bits are full."""
    rng = np.random.default_rng(percent)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts = []
    for size in (12, 40, 90, 300, 700):
        base = list(rng.choice(vocabulary, size))
        for _ in range(24):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(2, size // 40)))):
                copy[int(rng.integers(0, size))] = "x" + str(rng.integers(0, 99))
            texts.append(" ".join(copy))
        texts.append(" ".join(base).upper())
    passage = " ".join(rng.choice(vocabulary, 50))
    texts += [passage + " " + " ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(0, 60, 40)]
    texts += [None, None, "", "  ", "one", "one", "ONE", "one two three", "one two three", "a b c d", "A b C d"]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    rows.append(rows[-1])
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, keys string")
    p = jaccard.Params(percent=percent, frequent=frequent, tile=tile, bitmap_bits=bits)
    got = sorted(tuple(r) for r in jaccard.link(docs, p).collect())
    expected = brute_classes(rows, p)
    assert got == expected
    if frequent == 3:
        left = jaccard.one_each(docs, p)
        groups = {c for _, n, c in expected if n}
        empty = {i for i, n, _ in expected if not n}
        assert left.columns == docs.columns
        assert sorted(r.doc_id for r in left.collect()) == sorted(groups | empty)


def test_sizes_of_the_largest_ratio_are_one_level_apart(spark):
    sizes = spark.createDataFrame([(1_991_336,), (2_489_170,)], "n long")
    low, high = (r.x for r in sizes.orderBy("n").select(jaccard.level("n", jaccard.Params(percent=80)).alias("x")).collect())
    assert high - low <= 1


def brute_links(vectors, least):
    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.abs(v).max() if u else None for v, u in zip(vectors, usable, strict=True)]
    unit = [None if v is None else v / np.linalg.norm(v) for v in unit]
    near = [[j for j in range(len(vectors)) if j != i and unit[i] is not None and unit[j] is not None
             and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(len(vectors))]
    label = list(range(len(vectors)))
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(near):
            low = min([label[i], *(label[j] for j in js)])
            if low < label[i]:
                label[i], changed = low, True
    return [(i, len(js), label[i], label[i] == i) for i, js in enumerate(near)]


def test_vector_links_equal_brute_force(spark):
    """All links of clusters larger than the window are found: recall is 1 here, 0.9 is asked."""
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(40):
        x = rng.normal(size=16)
        vectors += [(x + rng.normal(size=16) * 0.06).tolist() for _ in range(int(rng.integers(1, 60)))]
    vectors += [vectors[0]] * 5 + [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] + [1.0] * 15, []]
    vectors += [[1e300] * 16, [1e-300] * 16, [1.0] * 16, [2.0] * 3]
    rows = spark.createDataFrame([(k, v, 1, 2) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, point int, links int")
    got = sorted(tuple(r) for r in vector_dedup.near_duplicates(rows, "vec_id", "embedding").collect())
    expected = brute_links(vectors, 0.9)
    assert sum(e[1] for e in expected) > 10_000
    assert sum(g[1] for g in got) >= 0.9 * sum(e[1] for e in expected)
    assert got == expected


def test_vector_passes_follow_the_row_count():
    for n in (1, 600, 20_000, 1_000_000, 1_000_000_000):
        signs, passes = vector_dedup.Params().shape(n)
        assert n / 2**signs <= 512 and 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** signs) ** passes >= 0.999


def test_vector_recall_among_unrelated_and_similar_vectors(spark):
    """Pairs at cosine 0.9 to 0.92: some alone, some in a crowd whose vectors are all moderately similar."""
    rng, size = np.random.default_rng(8), 256

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    centre = unit(rng.normal(size=size))
    crowd = unit(np.sqrt(0.8) * centre + np.sqrt(0.2) * unit(rng.normal(size=(3000, size))))
    base = np.concatenate([crowd, unit(rng.normal(size=(5000, size)))])
    chosen = np.r_[:200, 3000:3200]
    cosine = rng.uniform(0.9001, 0.92, (len(chosen), 1))
    aside = rng.normal(size=(len(chosen), size))
    aside = unit(aside - (aside * base[chosen]).sum(1, keepdims=True) * base[chosen])
    vectors = np.concatenate([base, cosine * base[chosen] + np.sqrt(1 - cosine**2) * aside])
    rows = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>")
    component = {r.vec_id: r.component_id for r in vector_dedup.near_duplicates(rows, "vec_id", "embedding").collect()}
    found = np.array([component[8000 + k] == component[int(c)] for k, c in enumerate(chosen)])
    assert found[:200].mean() >= 0.99 and found[200:].mean() >= 0.99


def test_few_vectors_are_one_cell(spark):
    vectors = [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [1.0, 0.0, 0.0], [1.0, 0.1, 0.0]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in vector_dedup.near_duplicates(rows, "vec_id", "embedding").collect()) == brute_links(vectors, 0.9)


def test_one_of_each_group_moves_the_texts_once(spark):
    """Repeated rows, null ids and empty texts included; the texts are dealt for the join and lie where repeated rows meet."""
    long = "one two three four five six seven eight nine ten eleven"
    rows = [(3, long), (1, long + " twelve"), (1, long + " twelve"), (None, "other words that stand alone here"), (None, "other words that stand alone here"),
            (7, None), (7, None), (8, ""), (2, "x"), (2, "y"), (9, "x")]
    docs = spark.createDataFrame([(*r, "l") for r in rows], "doc_id long, text string, lang string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jaccard.one_each(docs, jaccard.Params(width=3, percent=80))
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(__llm_own") == 1
        got = Counter(tuple(r) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == Counter([(1, long + " twelve", "l"), (None, "other words that stand alone here", "l"), (7, None, "l"), (8, "", "l"), (2, "x", "l"), (2, "y", "l")])


# Memory of workers


def test_cleaned_texts_leave_in_small_batches():
    """What a stage of the pipeline makes of a large batch is handed over about a megabyte at a time, with the same rows."""
    texts = [None, "a b\n" * 200_000, "", *("c d e\n" * 100 for _ in range(4000)), None]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string()),
                                        "__llm_removed": pa.array([None] * len(texts), pa.list_(pa.int64()))})
    got = list(quality_rules._without(iter([batch])))
    assert [t for b in got for t in b.column("text").to_pylist()] == texts
    assert [k for b in got for k in b.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert max(b.nbytes for b in got) < 1 << 21


def test_merges_are_read_for_long_pieces_alone(tokenizer):
    enc = bpe.Encoder(bpe.vocabulary())
    assert enc.words.all([b"word"]) == [bpe.ids_bytes(tokenizer.encode("word", add_special_tokens=False).ids)]
    assert not {"spec", "ranks", "vocab", "suffix"} & set(vars(enc))
