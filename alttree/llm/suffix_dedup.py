"""Removal of byte strings that occur more than once, by hashes grouped at positions that the text chooses.

This stands in for distributed prefix doubling: ranking every byte would sort eight rows for each byte of the corpus, and
rounds of doubling over chains of runs went over the disk allowance (README). Ranks are 64-bit hashes, kept for positions that the text
itself chooses: each stretch of `threshold` bytes (a window) has the `first`-byte string in it with the smallest hash
as its anchor, and windows in a row with the same anchor make a run. Equal windows have equal anchors, so a run whose
anchor string occurs once holds no repeat and drops out (ranks of the first `first` bytes, unique ones dropped).

Of the rest, Spark groups and counts pairs of ranks at growing offsets: the anchor with the `first` bytes from the run's
start, and both with the `first` bytes up to its end, which together are past the threshold and span all bytes of the
run's windows. Runs that are equal there repeat as a whole. Runs that are unique may repeat in part, at the edge of a
common passage: for these and one run of each equal group with the same anchor, the last doubling is done for each
window: Spark sorts the pairs of ranks of its first and last `first` bytes. What travels for a text is its unique
runs and the windows found there; all other runs of repeated anchors repeat, and are found again from the text.

Null texts count as empty. Texts under the threshold keep everything and take nothing from others. Rows are judged as
they are, and rows that repeat a document are copies of it. Runs of a text that are equal, as in one repeated phrase,
are one row with many places. Offsets are in bytes of UTF-8; where a kept text is wanted, characters cut apart are left
out. Other columns are carried along by `without_repeats` and not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alttree.llm import wordbytes as wb
from alttree.llm.bitmaps import count_bitmaps, marked
from alttree.llm.tables import keep, read, utf8

KEY = ["k1", "k2"]
HELD = 1_000_000
NO_MARKS = {"skips": None, "hits": None}


@dataclass(frozen=True)
class Params:
    """`first` is at least half the threshold. A larger one makes more and shorter runs, and fewer windows at their edges.
    `bitmap_bits` is log2 of the bits of the largest bitmap; each has as many as its hashes ask for."""

    threshold: int = 200
    first: int = 136
    bitmap_bits: int = 30


def text_key() -> list[Column]:
    """96 bits that tell texts apart."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]


def _sums(raw: np.ndarray) -> np.ndarray:
    return wb.running(wb.BYTE_VALUE[raw])


@dataclass
class Runs:
    """Windows first..last of each run, the hash of its anchor, and the running sums of the text's bytes."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    name: np.ndarray
    sums: np.ndarray


def runs(raw: np.ndarray, p: Params) -> Runs | None:
    """Runs of a text, None if it has no window."""
    windows = len(raw) - p.threshold + 1
    if windows < 1:
        return None
    sums = _sums(raw)
    at = np.arange(len(raw) - p.first + 1)
    names = wb.stretch(sums, at, at + p.first)
    # smallest hash of each window: minima over spans that double. Of equal hashes the first, as the place is part of the value.
    place = np.uint64(max(1, int(len(names)).bit_length()))
    value = (names >> place << place) | at.astype(np.uint64)
    span, width = 1, p.threshold - p.first + 1
    while 2 * span <= width:
        value, span = np.minimum(value[:-span], value[span:]), 2 * span
    if span < width:
        value = np.minimum(value[:span - width], value[width - span:])
    anchor = (value & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    # anchors are smallest hashes and so crowd at the low end; mixed again they spread over bitmaps and partitions
    return Runs(first, np.append(first[1:], windows) - 1, anchor[first], wb.mixed(names[anchor[first]] + np.uint64(1)), sums)


def _names(p: Params):
    def of(column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, raw, offsets in wb.slices(column):
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                r = runs(raw[a:b], p)
                if r is not None:
                    yield r.name

    return of


def contexts(r: Runs, at: np.ndarray, p: Params) -> np.ndarray:
    """Hash of the pairs of ranks that span all windows of the runs `at`, and of how the windows lie round the anchor."""
    first, last, end = r.first[at], r.last[at], r.last[at] + p.threshold
    left, right = wb.stretch(r.sums, first, first + p.first), wb.stretch(r.sums, end - p.first, end)
    half = wb.mixed(r.name[at] + wb.mixed(left + (r.anchor[at] - first).astype(np.uint64)))
    return wb.mixed(half + wb.mixed(right + (last - first).astype(np.uint64)))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    raw, offsets = wb.column_bytes(batch.column("text"))
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        yield k, raw[a:b]


def _candidates(p: Params, repeated, wanted=None):
    """(name, context) of the runs whose anchor occurs twice and how often a task saw them (of up to HELD runs at a time);
    with `wanted`, a bitmap of anchors, only theirs, with one place of each."""

    def merged(parts: list[tuple], keys: list[pa.Table]) -> pa.RecordBatch:
        name, context, row, lo, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((context, name))
        name, context = name[order], context[order]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (context[1:] != context[:-1])
        one = np.flatnonzero(new)
        columns = {"name": pa.array(name[one].view(np.int64)), "context": pa.array(context[one].view(np.int64)),
                   "n": pa.array(np.diff(np.append(one, len(name))))}
        if wanted is not None:
            places = pa.concat_tables(keys).combine_chunks().take(pa.array(row[order[one]]))
            columns |= {c: places.column(c).combine_chunks() for c in (*KEY, "doc_id")}
            columns |= {"lo": pa.array(lo[order[one]]), "w": pa.array(w[order[one]].astype(np.int32))}
        return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns.values()], list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, keys, rows, held = [], [], 0, 0
        for batch in wb.parts(batches):
            for k, text in _texts(batch):
                r = runs(text, p)
                if r is None:
                    continue
                stay = marked(repeated.value, r.name)
                if wanted is not None:
                    stay &= marked(wanted.value, r.name)
                at = np.flatnonzero(stay)
                if len(at):
                    parts.append((r.name[at], contexts(r, at, p), np.full(len(at), rows + k), r.first[at], r.last[at] - r.first[at] + 1))
                    held += len(at)
            rows += len(batch)
            if wanted is not None:
                own = batch.select([*KEY, "doc_id"]).take(pa.array(np.arange(len(batch))))  # a slice would hold the texts as well
                keys.append(pa.Table.from_batches([own]))
            if held > HELD:
                yield merged(parts, keys)
                parts, keys, rows, held = [], [], 0, 0
        if parts:
            yield merged(parts, keys)

    return run


def _of_documents(shared):
    """Rows whose text is marked in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(shared.value, key_bits(batch.column("k1")))))

    return run


def key_bits(column: pa.Array) -> np.ndarray:
    return wb.mixed(column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _edge_windows(p: Params):
    """For every window of the listed runs of a text: hashes of its first and last bytes, the run and the place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wb.parts(batches):
            raw, offsets = wb.column_bytes(batch.column("text"))
            for k, parts in enumerate(batch.column("parts").to_pylist()):
                sums = _sums(raw[offsets[k]:offsets[k + 1]])
                sizes = np.array([x["w"] for x in parts])
                ends = np.cumsum(sizes)
                off = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
                at = np.repeat([x["lo"] for x in parts], sizes) + off
                a, b = (wb.stretch(sums, s, s + p.first).view(np.int64) for s in (at, at + p.threshold - p.first))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.array(np.repeat([x["run"] for x in parts], sizes)), pa.array(off.astype(np.int32))],
                    ["a", "b", "run", "off"])

    return run


def _same_text(left: str, right: str) -> Column:
    c = lambda side, name: F.col(f"{side}.{name}")
    return (c(left, "k1") == c(right, "k1")) & (c(left, "k2") == c(right, "k2")) & c(left, "doc_id").eqNullSafe(c(right, "doc_id"))


@dataclass
class Found:
    """`repeated`: bitmap of the anchors that occur twice. `marks`: (k1, k2, doc_id, skips, hits) of texts whose runs of
    such anchors are not all repeats: first windows of unique runs, and lists of windows that repeat."""

    repeated: Broadcast
    marks: DataFrame


def repeats(docs: DataFrame, p: Params = Params()) -> Found:
    context = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(*text_key(), "doc_id", utf8().alias("text"))

    def shared(column: DataFrame, hashes, least: int) -> Broadcast:
        return context.broadcast(count_bitmaps(column, hashes, [least], p.bitmap_bits)[0])  # of bounded size

    repeated = shared(texts.select("text"), _names(p), 2)
    seen = texts.select("text").mapInArrow(_candidates(p, repeated), "name long, context long, n long")
    unique = seen.groupBy("name", "context").agg(F.sum("n").alias("n")).where("n = 1").select(F.col("name").alias("text"))
    wanted = shared(unique, lambda c: [c.to_numpy(zero_copy_only=False).view(np.uint64)], 1)

    listed = texts.mapInArrow(_candidates(p, repeated, wanted), f"name long, context long, n long, k1 long, k2 int, doc_id {kind}, lo long, w int")
    place = F.struct(*KEY, "doc_id", "lo", "w")
    groups = keep(listed.groupBy("name", "context").agg(F.sum("n").alias("n"), F.min(place).alias("r")).select("name", "n", "r.*"), "groups")
    edges = groups.groupBy("name").agg(F.count("*").alias("groups"), F.min("n").alias("least")).where("groups > 1 and least = 1").select("name")
    edge = keep(groups.join(edges, "name").select(F.monotonically_increasing_id().alias("run"), *KEY, "doc_id", "lo", "w"), "edge")
    per_text = edge.groupBy(*KEY, "doc_id").agg(F.collect_list(F.struct("run", "lo", "w")).alias("parts"))
    some = shared(edge.select(F.col("k1").alias("text")), lambda c: [key_bits(c)], 1)
    asked = texts.mapInArrow(_of_documents(some), f"k1 long, k2 int, doc_id {kind}, text binary").alias("t").join(
        per_text.alias("e"), _same_text("t", "e")).select("t.text", "e.parts")
    windows = asked.mapInArrow(_edge_windows(p), "a long, b long, run long, off int")
    again = windows.withColumn("n", F.count("*").over(Window.partitionBy("a", "b"))).where("n > 1")
    hits = again.groupBy("run").agg(F.collect_set(F.col("off").cast("long")).alias("offs")).join(edge, "run").select(
        *KEY, "doc_id", F.lit(None).cast("long").alias("skip"), F.transform("offs", lambda o: o + F.col("lo")).alias("hit"))
    skips = groups.where("n = 1").select(*KEY, "doc_id", F.col("lo").alias("skip"), F.lit(None).cast("array<long>").alias("hit"))
    marks = skips.unionByName(hits).groupBy(*KEY, "doc_id").agg(F.collect_list("skip").alias("skips"), F.collect_list("hit").alias("hits"))
    return Found(repeated, keep(marks, "marks"))


def kept_bytes(raw: np.ndarray, found: np.ndarray, skips: list[int] | None, hits: list[list[int]] | None, p: Params) -> tuple[np.ndarray, int]:
    """What is left of a text, and the number of stretches taken out."""
    r = runs(raw, p)
    if r is None:
        return raw, 0
    stay = marked(found, r.name)
    if skips:
        stay &= ~np.isin(r.first, skips)
    lo = np.concatenate([r.first[stay], *(np.array(h, np.int64) for h in hits or [])])
    last = np.concatenate([r.last[stay], lo[np.count_nonzero(stay):]])
    if not len(lo):
        return raw, 0
    n = len(raw)
    edge = np.bincount(lo, minlength=n + 1) - np.bincount(last + p.threshold, minlength=n + 1)
    gone = np.cumsum(edge)[:n] > 0
    return raw[~gone], int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))


def _applied(docs: DataFrame, marks: DataFrame) -> DataFrame:
    keyed = docs.withColumns({f"__llm_{c}": k for c, k in zip(KEY, text_key(), strict=True)})
    found = marks.select(*(F.col(c).alias(f"__llm_r{c}") for c in (*KEY, "doc_id")), F.struct("skips", "hits").alias("__llm_marks"))
    same = (F.col("__llm_k1") == F.col("__llm_rk1")) & (F.col("__llm_k2") == F.col("__llm_rk2")) & F.col("doc_id").eqNullSafe(F.col("__llm_rdoc_id"))
    return keyed.join(found, same, "left")


def removal(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    found = repeats(docs, p)
    repeated = found.repeated
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wb.parts(batches, "_text"):
            raw, offsets = wb.column_bytes(batch.column("_text"))
            out = []
            for k, marks in enumerate(batch.column("__llm_marks").to_pylist()):
                text = raw[offsets[k]:offsets[k + 1]]
                left, count = kept_bytes(text, repeated.value, *(marks or NO_MARKS).values(), p)
                out.append((len(text), len(text) - len(left), count, hashlib.sha256(left.tobytes()).hexdigest()))
            n, gone, spans, digest = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _applied(docs.select("doc_id", "text"), found.marks).select("doc_id", utf8().alias("_text"), "__llm_marks")
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """All rows and columns, texts without their repeats."""
    found = repeats(docs, p)
    repeated = found.repeated

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wb.parts(batches):
            raw, offsets = wb.column_bytes(batch.column("text"))
            at = batch.schema.get_field_index("text")
            texts = []
            for k, marks in enumerate(batch.column("__llm_marks").to_pylist()):
                left, count = kept_bytes(raw[offsets[k]:offsets[k + 1]], repeated.value, *(marks or NO_MARKS).values(), p)
                texts.append(left.tobytes().decode("utf-8", "ignore") if count else batch.column(at)[k].as_py())
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return _applied(docs, found.marks).select(*docs.columns, "__llm_marks").mapInArrow(run, docs.schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(read(spark, sf_dir, "documents"))
