"""Cross-tokenizer alignment: which tokens of two tokenizers overlap in the bytes of a text, and which form a group.

A text's tokens tile its bytes, so each tokenizer gives a token-byte incidence matrix, in compressed rows (`csr`). Row
products A · Bᵀ list the links: pairs of tokens with a byte in common, and how many. Byte offsets where tokens of both
end cut the tokens into groups; products of the token-group incidences list the pairs that share a group.

A (byte-level BPE, `byte_bpe_50k.json`) encodes a space and the text, B (`piece_bpe_32k.model`) the text, to which it
adds the space itself. Strings of special tokens in a text are plain text. Null and empty texts have no tokens, nor have
texts whose joined token bytes differ from the space and the text (such as those that hold U+2581): all their counts
are 0 and their digest is empty. Texts of one doc_id are aligned one by one, repeated rows too, and each counts in the
corpus; ties for a B token's most frequent partner are all best. An empty table gives no rows; only doc_id and text are
read.

No token of either reaches over a space between two other characters, so texts are cut before such spaces (where these
are below U+0250 and surely not white space). The matrices are then block diagonal, a block for each segment; different
segments are aligned together, and those seen lately are looked up. Very long texts are worked on in parts.

The corpus-wide count of a pair of ids is the number of links that hold it. Counts are added up by Spark and looked up
by the texts' own pairs in blocks of at most `block` pairs of ids, one broadcast and one pass over the kept pairs for
each block, so what a task holds does not grow with the number of pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alttree.llm.bpe import BYTE_LETTERS, vocabulary
from alttree.llm.csr import Csr
from alttree.llm.tables import keep, read, utf8

CHUNK = 1 << 16  # characters of a text after which it is cut where it can be
SLICE = 1 << 20  # characters aligned at once
BLOCK = 1 << 22  # pairs of ids broadcast at once
STRETCH = 200
LATELY = 100_000
LINE = 1000  # characters of segments encoded together
EDGE = re.compile("[!-~¡-ɏ]")
CUT = re.compile("(?<=[!-~¡-ɏ]) (?=[!-~¡-ɏ])")


@dataclass
class Vocabulary:
    """The bytes of each id, one after the other."""

    raw: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(tokens: list[bytes]) -> Vocabulary:
        return Vocabulary(np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64))

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.starts[ids + 1] - self.starts[ids]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes(ids)
        return self.raw[np.arange(sizes.sum()) + np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes)]


class Tokenizers:
    """Both libraries with their vocabularies' bytes, and the decimals of ids with what follows them in a digest."""

    def __init__(self, path_a: str, path_b: str, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {chr(c): b for b, c in BYTE_LETTERS.items()}
        names = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())]
        tokens = [bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in names]
        self.bytes_a, self.ranked = Vocabulary.of(tokens), self._ranked(path_a, tokens, pattern)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = Vocabulary.of([bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)])
        #: No piece reaches over the start of a word, so texts may be cut there.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        size = max(len(names), len(pieces))
        self.decimal = {end: np.array([f"{k}{end}" for k in range(size)], object) for end in (",", "|", ";")}

    def _ranked(self, path: str, tokens: list[bytes], pattern: str | None):
        """A's vocabulary as ranks for tiktoken, where its ids follow the order of its merges."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        first = len({t for t in tokens if len(t) == 1})
        if pattern is None or [self.a.token_to_id(x + y) for x, y in pairs] != list(range(first, first + len(pairs))):
            return None
        special = self.a.get_added_tokens_decoder()
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(tokens) if k not in special}, special_tokens={})

    def encode_a(self, chunks: list[str]) -> list[list[int]]:
        """A's ids of each chunk and the space before it.

        tiktoken, some times faster, does Latin-1 text without long stretches, where both libraries split alike whatever
        their Unicode version; the rest is left to the tokenizers library.
        """
        out: list = [None] * len(chunks)
        rest = []
        for k, c in enumerate(chunks):
            if self.ranked is not None and plain(c):
                out[k] = self.ranked.encode_ordinary(f" {c}")
            else:
                rest.append(k)
        for k, e in zip(rest, self.a.encode_batch_fast([f" {chunks[k]}" for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def chunks(self, text: str) -> Iterator[str]:
        """A text in parts, each without the space it starts with."""
        at = 0
        while self.cuts and len(text) - at > CHUNK and (m := CUT.search(text, at + CHUNK)):
            yield text[at:m.start()]
            at = m.end()
        yield text[at:]


def plain(text: str) -> bool:
    """Latin-1 throughout, and no stretch of white space or of anything else longer than STRETCH."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    if len(text) <= STRETCH:
        return True
    sizes = list(map(len, text.split()))
    return max(sizes, default=0) <= STRETCH and len(text) - sum(sizes) - len(sizes) <= STRETCH


_tokenizers: dict[tuple[str, str, str | None], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str, pattern: str | None) -> Tokenizers:
    """One per worker."""
    if (path_a, path_b, pattern) not in _tokenizers:
        _tokenizers[path_a, path_b, pattern] = Tokenizers(path_a, path_b, pattern)
    return _tokenizers[path_a, path_b, pattern]


def split_pattern() -> str | None:
    """The pattern by which byte-level BPE splits text, where the vocabularies' package states it."""
    import public_tokenizers

    return getattr(public_tokenizers, "PATTERN", None)


def flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ids one after the other, and their bounds."""
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return np.concatenate([np.zeros(0, np.int64), *(np.asarray(r, np.int64) for r in rows)]), bounds


@dataclass
class Aligned:
    """Chunks aligned together: which are valid; of these the ids and byte ends of A and B, the ends of groups, and the group of each token."""

    valid: np.ndarray
    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    ends_g: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, bytes in common) of all overlapping pairs: A · Bᵀ over bytes."""
        return Csr.ranges(self.ends_a).product(Csr.ranges(self.ends_b).transposed())

    def groups(self) -> tuple[Csr, Csr]:
        """Token-group incidence of A, and group-token incidence of B."""
        n = len(self.ends_g)
        return Csr.one_each(self.group_a, n), Csr.one_each(self.group_b, n).transposed()

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, 1) of all pairs that share a group, a run of rows at a time."""
        a, b = self.groups()
        return a.product(b)

    def group_text(self, decimal: dict[str, np.ndarray], bounds: np.ndarray) -> list[str]:
        """The groups as `a1,a2|b1;`, one after the other, between bounds that count tokens of A and B."""
        n = len(self.ends_g)
        per_a, per_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        upto_a, upto_b = np.cumsum(per_a), np.cumsum(per_b)
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[upto_a - 1], last_b[upto_b - 1] = True, True
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + (upto_b - per_b)[self.group_a]] = np.where(last_a, decimal["|"][self.a], decimal[","][self.a])
        out[np.arange(len(self.b)) + upto_a[self.group_b]] = np.where(last_b, decimal[";"][self.b], decimal[","][self.b])
        cut, pieces = bounds.tolist(), out.tolist()
        return ["".join(pieces[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def align(chunks: list[str], t: Tokenizers) -> Aligned:
    """Chunks (not empty) with the space before each."""
    a, bounds_a = flat(t.encode_a(chunks))
    b, bounds_b = flat(t.b.encode(chunks, num_threads=1))
    given = [f" {c}".encode() for c in chunks]
    got_a, got_b, want = t.bytes_a.joined(a), t.bytes_b.joined(b), np.frombuffer(b"".join(given), np.uint8)
    valid = np.ones(len(chunks), bool)
    ends_a, ends_b = np.cumsum(t.bytes_a.sizes(a)), np.cumsum(t.bytes_b.sizes(b))
    if not (np.array_equal(got_a, want) and np.array_equal(got_b, want)):
        cut_a, cut_b = np.concatenate([[0], ends_a])[bounds_a], np.concatenate([[0], ends_b])[bounds_b]
        for k, g in enumerate(given):
            valid[k] = got_a[cut_a[k]:cut_a[k + 1]].tobytes() == g and got_b[cut_b[k]:cut_b[k + 1]].tobytes() == g
        a, b = a[np.repeat(valid, np.diff(bounds_a))], b[np.repeat(valid, np.diff(bounds_b))]
        ends_a, ends_b = np.cumsum(t.bytes_a.sizes(a)), np.cumsum(t.bytes_b.sizes(b))
    ends_g = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return Aligned(valid, a, b, ends_a, ends_b, ends_g, np.searchsorted(ends_g, ends_a), np.searchsorted(ends_g, ends_b))


def add_up(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each one's times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[heads], np.add.reduceat(times, heads) if len(heads) else times


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, all first bytes before all second ones, so that the file's compression finds the small ones."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


#: What a segment adds to its text: five counts (n_a is -1 if its bytes differ), its groups, its links' pairs of ids.
Part = tuple[bytes, str, bytes]


def lines(segments: list[str]) -> Iterator[list[str]]:
    """Segments that may stand in one line, where each is cut off exactly; the others alone."""
    line, size = [], 0
    for s in segments:
        if not (EDGE.match(s) and EDGE.match(s, len(s) - 1)):
            yield [s]
            continue
        line.append(s)
        size += len(s)
        if size > LINE:
            yield line
            line, size = [], 0
    if line:
        yield line


def measure(segments: list[str], t: Tokenizers) -> Iterator[tuple[str, Part]]:
    """Segments, in any order, with their parts; the byte matrices are those of many lines of segments."""
    held, size = [], 0
    for line in lines(segments):
        held.append(line)
        size += sum(map(len, line))
        if size >= SLICE:
            yield from _measured(held, t)
            held, size = [], 0
    if held:
        yield from _measured(held, t)


def _measured(rows: list[list[str]], t: Tokenizers) -> Iterator[tuple[str, Part]]:
    x = align([" ".join(r) for r in rows], t)
    failed = [s for r, ok in zip(rows, x.valid, strict=True) if not ok for s in r]
    if failed and len(rows) < sum(map(len, rows)):  # a segment spoils its line, not the others
        yield from _measured([[s] for s in failed], t)
        failed = []
    for s in failed:
        yield s, (np.array([-1, 0, 0, 0, 0], np.int64).tobytes(), "", b"")
    segments = [s for r, ok in zip(rows, x.valid, strict=True) if ok for s in r]
    ends = np.cumsum([0, *(1 + len(s.encode()) for s in segments)])
    bounds_a, bounds_b, bounds_g = (np.searchsorted(e, ends, "right") for e in (x.ends_a, x.ends_b, x.ends_g))
    a, b = x.groups()
    in_groups = np.concatenate([[0], np.cumsum(a.work(b))])
    links = [(i, x.b[j] << 16 | x.a[i]) for i, j, _ in x.links()]
    row, pair = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*links, strict=True) if links else ((), ())))
    at = np.searchsorted(row, bounds_a)
    counts = np.stack([np.diff(c) for c in (bounds_a, bounds_b, bounds_g, at, in_groups[bounds_a])], axis=1).astype(np.int64).tobytes()
    text, pairs, cut = x.group_text(t.decimal, bounds_a + bounds_b), pair.astype("<u4").tobytes(), (at * 4).tolist()
    for k, s in enumerate(segments):
        yield s, (counts[40 * k:40 * k + 40], text[k], pairs[cut[k]:cut[k + 1]])


class Segments:
    """Parts of segments: those seen lately are looked up, two generations of at most LATELY at a time."""

    def __init__(self, t: Tokenizers):
        self.t, self.new, self.old = t, {}, {}

    def parts(self, segments: list[str]) -> list[Part]:
        got = list(map(self.new.get, segments))
        missing = {s for s, g in zip(segments, got, strict=True) if g is None}
        if not missing:
            return got
        found = {s: self.old[s] for s in missing if s in self.old}
        unseen = [s for s in missing if s not in found]
        found.update(measure(unseen, self.t))
        if len(self.new) > LATELY:
            self.old, self.new = self.new, {}
        self.new.update((s, x) for s, x in found.items() if len(s) <= STRETCH)
        return [found[s] if g is None else g for s, g in zip(segments, got, strict=True)]


class Totals:
    """Counts of one text while its segments come in."""

    def __init__(self):
        self.valid, self.n, self.digest, self.held, self.parts = True, np.zeros(5, np.int64), hashlib.sha256(), "", []

    def add(self, parts: list[Part]) -> None:
        counts, texts, pairs = zip(*parts, strict=True)
        n = np.frombuffer(b"".join(counts), np.int64).reshape(-1, 5)
        self.valid &= bool((n[:, 0] >= 0).all())
        self.n += n.sum(0)
        text = "".join(texts)
        self.digest.update((self.held + text[:-1]).encode())
        self.held = text[-1:]
        keys = np.frombuffer(b"".join(pairs), "<u4").astype(np.int64)
        self.parts.append(add_up(keys, np.ones(len(keys), np.int64)))

    def row(self) -> tuple:
        if not self.valid or not self.n[0]:
            return 0, 0, 0, 0, 0, "", b"", b""
        keys, times = self.parts[0] if len(self.parts) == 1 else add_up(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        return *self.n.tolist(), self.digest.hexdigest(), packed(np.diff(keys, prepend=0)), packed(times)


PAIRS = "row_id long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, pairs binary, times binary"
COUNTED = ["n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256", "pairs", "times"]


def _add_slice(held: list[tuple[int, list[str]]], totals: dict[int, Totals], known: Segments) -> None:
    parts = known.parts([s for _, segments in held for s in segments])
    at = 0
    for row, segments in held:
        totals[row].add(parts[at:at + len(segments)])
        at += len(segments)


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row per text: its counts, the digest of its groups, and its different pairs of ids with how often each is linked."""
    path_a, path_b = path_a or vocabulary("byte_bpe_50k.json"), path_b or vocabulary("piece_bpe_32k.model")
    pattern = split_pattern()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = PAIRS.format(kind=kind)
    names = ["row_id", "doc_id", *COUNTED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b, pattern)
        known = Segments(t)
        for batch in batches:
            texts = batch.column("text")
            for first in range(0, len(batch), 512):
                rows = batch.slice(first, 512)
                totals: dict[int, Totals] = {k: Totals() for k in range(len(rows))}
                held, size = [], 0
                for k in range(len(rows)):
                    text = texts[first + k].as_py().decode("utf-8", "replace")
                    for c in t.chunks(text) if text else ():
                        held.append((k, CUT.split(c) if t.cuts else [c]))
                        size += len(c)
                        if size >= SLICE:
                            _add_slice(held, totals, known)
                            held, size = [], 0
                if held:
                    _add_slice(held, totals, known)
                done = list(zip(*(totals[k].row() for k in range(len(rows))), strict=True))
                kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]
                columns = [rows.column("row_id"), rows.column("doc_id"), *(pa.array(c, k) for c, k in zip(done, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", utf8().alias("text"))
    return keep(rows.mapInArrow(run, schema), "pairs", compression="zstd")


def _row_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches with the number of the row, the pair and the times of each entry."""
    for batch in batches:
        for first in range(0, len(batch), 512):
            rows = batch.slice(first, 512)
            got = [np.cumsum(unpacked(p)) for p in rows.column("pairs").to_pylist()]
            times = [unpacked(p) for p in rows.column("times").to_pylist()]
            row = np.repeat(np.arange(len(got)), [len(g) for g in got])
            yield rows, row, np.concatenate([np.zeros(0, np.int64), *got]), np.concatenate([np.zeros(0, np.int64), *times])


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        keys, times = add_up(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["pair", "n"])

    for _, _, keys, times in _row_pairs(batches):
        held.append(add_up(keys, times))
        size += len(held[-1][0])
        if size > BLOCK:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def pair_counts(texts: DataFrame) -> DataFrame:
    """(b, pair, n, best): corpus-wide links of each pair of ids, and whether it is its B id's most frequent."""
    counts = keep(texts.select("pairs", "times").mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(
        F.sum("n").alias("n")).withColumn("b", F.shiftright("pair", 16)), "counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row per id of a fixed vocabulary
    return counts.join(F.broadcast(most), "b").select("b", "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """(row_id, n_best, count_sum) over the pairs in `counts`, a block that fits into a broadcast."""
    table = counts.orderBy("pair").toArrow()
    keys, n, best = (table.column(c).to_numpy().astype(k) for c, k in (("pair", np.int64), ("n", np.int64), ("best", bool)))
    shared = texts.sparkSession.sparkContext.broadcast((keys.astype(np.uint32), n, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for rows, row, keys, times in _row_pairs(batches):
            at = np.minimum(np.searchsorted(known, keys.astype(np.uint32)), max(len(known) - 1, 0))
            here = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            row, at, times = row[here], at[here], times[here]
            sums = [np.zeros(len(rows), np.int64) for _ in range(2)]
            np.add.at(sums[0], row, times * best[at])
            np.add.at(sums[1], row, times * n[at])
            yield pa.RecordBatch.from_arrays([rows.column("row_id"), *map(pa.array, sums)], ["row_id", "n_best", "count_sum"])

    return texts.select("row_id", "pairs", "times").mapInArrow(run, "row_id long, n_best long, count_sum long")


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per text: counts of tokens, groups and links, how many links are best, and the links' counts added up."""
    texts = aligned(docs, path_a, path_b)
    counts = pair_counts(texts)
    blocks = max(1, -(-counts.count() // block))
    if blocks == 1:
        sums = _looked_up(texts, counts)
    else:
        counts = keep(counts.withColumn("block", F.pmod(F.xxhash64("pair"), F.lit(2 * blocks))), "blocks")
        sums = None
        for k in range(2 * blocks):  # twice as many as needed, so that none is over the limit
            part = keep(_looked_up(texts, counts.where(F.col("block") == k).drop("block")), "sums")
            sums = part if sums is None else sums.union(part)
        sums = sums.groupBy("row_id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return texts.drop("pairs", "times").join(sums, "row_id").drop("row_id")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")
