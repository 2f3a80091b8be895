"""Cross-tokenizer alignment against a byte-by-byte version, and sparse products against dense ones."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from alttree.llm import alignment
from alttree.llm import queries as llm
from alttree.llm.bpe import vocabulary
from alttree.llm.csr import Csr

TEXTS = [
    None, "", " ", "one", "One two  three\nfour", "tokenization of unbelievable words", "café naïve Ünïcödé", "🙂🙂 x", "a▁b", "x▁",
    "<|endoftext|> <s> </s>", "tab\tand\r\nline", "漢字かな交じり文", "ﬁ½\xa0x", "\x00a", "a" * 3000, "The word " * 9000, "one", "1234567890 " * 50, "  lead", "trail  ",
    "don't can't", "é" * 500, " ​　",
]


def by_bytes(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest, n_group_links) of each text."""
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    done, counts = [], Counter()
    for text in texts:
        if not text:
            done.append(None)
            continue
        want = (" " + text).encode()
        a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
        bytes_a = [bytes(letters[c] for c in ta.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            done.append(None)
            continue
        of_byte_a = [k for k, x in enumerate(bytes_a) for _ in x]
        of_byte_b = [k for k, x in enumerate(bytes_b) for _ in x]
        links = sorted(set(zip(of_byte_a, of_byte_b, strict=True)))
        ends = sorted(set(np.cumsum([len(x) for x in bytes_a]).tolist()) & set(np.cumsum([len(x) for x in bytes_b]).tolist()))
        groups, at = [], 0
        for e in ends:
            groups.append((sorted(set(of_byte_a[at:e])), sorted(set(of_byte_b[at:e]))))
            at = e
        counts.update((a[i], b[j]) for i, j in links)
        done.append((a, b, links, groups))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for x in done:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, "", 0))
            continue
        a, b, links, groups = x
        line = ";".join(",".join(str(a[i]) for i in g) + "|" + ",".join(str(b[j]) for j in h) for g, h in groups)
        ids = [(a[i], b[j]) for i, j in links]
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in ids), sum(counts[p] for p in ids),
                    hashlib.sha256(line.encode()).hexdigest(), sum(len(g) * len(h) for g, h in groups)))
    return out


TOKENIZERS = alignment.tokenizers(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), alignment.split_pattern())
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]


@pytest.mark.parametrize("block", [alignment.BLOCK, 200])
def test_alignment_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "CHUNK", 500)
    monkeypatch.setattr(alignment, "SLICE", 2000)
    docs = spark.createDataFrame([(k, t, 7, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, n int, pairs string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.alignment(docs, block=block).collect()}
    assert got == dict(enumerate(by_bytes(TEXTS)))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in llm.QUERIES["op11_alignment"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {d.doc_id: x for d, x in zip(docs, by_bytes([d.text for d in docs]), strict=True)}


def test_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (1, "another"), (None, "no id")], "doc_id long, text string")
    rows = alignment.alignment(docs).collect()
    assert sorted((r.doc_id or 0, r.n_a) for r in rows) == [(0, 2), (1, 1), (1, 2), (1, 2)]
    assert alignment.alignment(docs.where("false")).count() == 0


def dense(m):
    out = np.zeros((len(m), m.width), int)
    np.add.at(out, (np.repeat(np.arange(len(m)), np.diff(m.starts)), m.cols), m.values)
    return out


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_row_products(block):
    rng = np.random.default_rng(3)
    for _ in range(20):
        n, k, w = rng.integers(1, 9, 3)
        x, y = rng.integers(0, 3, (n, k)) * (rng.random((n, k)) < 0.5), rng.integers(0, 3, (k, w)) * (rng.random((k, w)) < 0.5)
        a, b = (Csr(np.concatenate([[0], np.cumsum((z > 0).sum(1))]), np.nonzero(z)[1], z[z > 0], z.shape[1]) for z in (x, y))
        got = np.zeros((n, w), int)
        for r, c, v in a.product(b, block):
            got[r, c] += v
        assert (got == x @ y).all() and (dense(a.transposed()) == x.T).all()
        assert (a.work(b) == ((x > 0).astype(int) @ (y > 0).sum(1))).all()


def test_links_and_groups_of_a_text(spark):
    x = alignment.align(["unbelievable tokenization"], TOKENIZERS)
    overlaps = {(i, j): v for r in x.links() for i, j, v in zip(*r, strict=True)}
    assert sum(overlaps.values()) == len(" unbelievable tokenization")
    together = {(i, j) for r in x.group_links() for i, j, _ in zip(*r, strict=True)}
    assert set(overlaps) <= together and all(x.group_a[i] == x.group_b[j] for i, j in together)


def test_plain_text_is_encoded_as_by_the_library():
    rng = np.random.default_rng(5)
    letters = [chr(c) for c in range(256)] + list(" \n\t'sdm") * 8
    texts = ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(20_000)]
    texts += ["a" * 500, " " * 500, "x" + "\n" * 300 + "y", "\u3000x"]
    assert sum(map(alignment.plain, texts)) == 20_000 and TOKENIZERS.ranked is not None
    assert TOKENIZERS.encode_a(texts) == [e.ids for e in TOKENIZERS.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
