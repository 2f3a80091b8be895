"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's score is a sigmoid of linear weights plus all pairwise interactions of its features, each pair weighed by the
product of two low-rank vectors. The pairs are never listed: their sum is half the square of the summed vectors less
the sum of the squares, so scoring is linear in the number of words.

The model is fitted on at most `sample` labelled rows (those with the smallest hash of their id, then of id and text),
whose features come together in one task; its size is fixed by `buckets` and `rank`. Everything else covers every row. Labels, language, source and ids are never
features. Rows of the held-out fold (crc32 of the id, modulo 4, is 2) are never learned from.

Null texts count as empty and get a score from the structure statistics alone. Labels that are null are left out;
repeated labels and rows each count, in the order of the hash of id and text, ties being equal rows; an empty table gives no
rows; very long texts are scored in whole. Without labels of both kinds every score is the share of label 1 (0.5 without
any). Other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alttree.llm import wordbytes as wb
from alttree.llm.tables import read, utf8


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 15
    rank: int = 8
    sample: int = 8000
    epochs: int = 12
    batch: int = 256
    rate: float = 0.1
    decay: float = 1e-3
    good: float = 0.7


STRUCTURE = ["log_words", "word_len", "upper", "symbols", "bars", "bangs", "digits", "wide", "lines", "distinct", "log_n_chars", "bias"]


@dataclass
class Features:
    """Hashed words as (bounds, bucket, value) per text, and the dense structure statistics."""

    bounds: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    dense: np.ndarray


def features(raw: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray, buckets: int) -> Features:
    """n_chars: the metadata column; NaN where it is missing."""
    words = wb.Words(raw, offsets, lower=True)
    counts = words.counts
    text = np.repeat(np.arange(len(counts)), counts)
    hashed = (words.hashes() >> np.uint64(20)) % np.uint64(buckets)
    key, times = np.unique(text.astype(np.uint64) * np.uint64(buckets) + hashed, return_counts=True)
    owner = (key // np.uint64(buckets)).astype(np.int64)
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(owner, value * value, len(counts)))
    bounds = np.searchsorted(owner, np.arange(len(counts) + 1))

    def share(marks: np.ndarray, of: np.ndarray) -> np.ndarray:
        return wb.per_text(offsets, marks) / np.maximum(of, 1)

    size, n = np.diff(offsets), np.maximum(counts, 1)
    chars = wb.per_text(offsets, (raw & 0xC0) != 0x80)
    stated = np.where(np.isnan(n_chars), chars, n_chars)
    dense = np.stack([
        np.log1p(counts) / 10, wb.per_text(offsets, ~wb.SPACE[raw]) / n / 10, share((raw >= 65) & (raw <= 90), size) * 2,
        np.minimum(share(np.isin(raw, np.frombuffer(b"#*$%&<>", np.uint8)), n), 2), np.minimum(share(raw == ord("|"), n), 2),
        np.minimum(share(raw == ord("!"), n), 2), share((raw >= 48) & (raw <= 57), size) * 2, share(raw >= 128, size) * 2,
        np.minimum(share(raw == wb.NEWLINE, n) * 5, 2), np.diff(bounds) / n, np.log1p(np.maximum(stated, 0)) / 10, np.ones(len(counts)),
    ], axis=1)
    return Features(bounds, (key % np.uint64(buckets)).astype(np.int64), value / norm[owner], dense)


@dataclass
class Model:
    """Weights and vectors of buckets and structure statistics; without them (`w` empty) the score is `base`."""

    base: float
    w: np.ndarray
    v: np.ndarray
    dense_w: np.ndarray
    dense_v: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, base=self.base, w=self.w, v=self.v, dense_w=self.dense_w, dense_v=self.dense_v)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Model:
        z = np.load(io.BytesIO(data))
        return Model(float(z["base"]), z["w"], z["v"], z["dense_w"], z["dense_v"])


def _sums(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values between bounds; zero where there are none."""
    if not len(values):
        return np.zeros((len(bounds) - 1, *values.shape[1:]))
    out = np.add.reduceat(values, np.minimum(bounds[:-1], len(values) - 1), axis=0)
    out[np.diff(bounds) == 0] = 0
    return out


def raw_score(m: Model, x: Features) -> tuple[np.ndarray, np.ndarray]:
    """The sum inside the sigmoid, and the summed vectors of each text."""
    part = m.v[x.bucket] * x.value[:, None]
    total = _sums(x.bounds, part) + x.dense @ m.dense_v
    squares = _sums(x.bounds, part * part) + (x.dense**2) @ (m.dense_v**2)
    linear = _sums(x.bounds, m.w[x.bucket] * x.value) + x.dense @ m.dense_w
    return linear + 0.5 * (total * total - squares).sum(1), total


def scores(m: Model, x: Features) -> np.ndarray:
    if not len(m.w):
        return np.full(len(x.dense), m.base)
    return 1 / (1 + np.exp(-np.clip(raw_score(m, x)[0], -30, 30)))


def rows_of(x: Features, rows: np.ndarray) -> Features:
    sizes = np.diff(x.bounds)[rows]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(x.bounds[rows] - bounds[:-1], sizes) + np.arange(bounds[-1])
    return Features(bounds, x.bucket[at], x.value[at], x.dense[rows])


def fit(x: Features, y: np.ndarray, p: Params) -> Model:
    """Adaptive-step gradient descent on the log loss, over a bounded sample."""
    base = float(y.mean()) if len(y) else 0.5
    if not len(y) or base in (0.0, 1.0):
        return Model(base, *(np.zeros(0) for _ in range(4)))
    rng = np.random.default_rng(7)
    s = x.dense.shape[1]
    m = Model(base, np.zeros(p.buckets), rng.normal(0, 0.02, (p.buckets, p.rank)), np.zeros(s), rng.normal(0, 0.05, (s, p.rank)))
    seen = [np.full_like(a, 1e-6) for a in (m.w, m.v, m.dense_w, m.dense_v)]
    for _ in range(p.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), p.batch):
            rows = order[at:at + p.batch]
            b = rows_of(x, rows)
            z, total = raw_score(m, b)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            owner = np.repeat(np.arange(len(rows)), np.diff(b.bounds))
            gv = (g[owner] * b.value)[:, None] * (total[owner] - m.v[b.bucket] * b.value[:, None])
            used, at_used = np.unique(b.bucket, return_inverse=True)
            grad_v = np.zeros((len(used), p.rank))
            np.add.at(grad_v, at_used, gv)
            grad_w = np.bincount(at_used, g[owner] * b.value, len(used))
            dense_g = g[:, None] * b.dense
            grads = [(m.w, used, grad_w), (m.v, used, grad_v), (m.dense_w, slice(None), dense_g.sum(0)),
                     (m.dense_v, slice(None), dense_g.T @ total - (g[:, None] * b.dense**2).sum(0)[:, None] * m.dense_v)]
            for (weights, where, grad), past in zip(grads, seen, strict=True):
                grad = grad + p.decay * weights[where] / len(rows)
                past[where] += grad * grad
                weights[where] -= p.rate * grad / np.sqrt(past[where])
    return m


def _n_chars(column: pa.Array) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in column.to_pylist()], float)


def _batch_features(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[pa.RecordBatch, Features]]:
    for batch in batches:
        for first, last, raw, offsets in wb.slices(batch.column("text")):
            rows = batch.slice(first, last - first)
            yield rows, features(raw, offsets, _n_chars(rows.column("n_chars")), buckets)


def _inputs(docs: DataFrame, *more: Column) -> DataFrame:
    stated = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", utf8().alias("text"), stated.alias("n_chars"), *more)


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """labels: doc_id and label (0 or 1). At most p.sample labelled rows are learned from, in the order of the hash of id and text.

    Features are computed where the texts are read; only those of the chosen rows come together in one task.
    """
    chosen = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "label").orderBy(
        F.xxhash64("doc_id"), "doc_id", "label").limit(p.sample)
    known = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    rows = docs.select(*known).join(F.broadcast(chosen), "doc_id")
    columns = ["place", "label", "bucket", "value", "dense"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, f in _batch_features(batches, p.buckets):
            bounds = pa.array(f.bounds, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [r.column("place"), r.column("label"), pa.ListArray.from_arrays(bounds, pa.array(f.bucket, pa.int32())),
                 pa.ListArray.from_arrays(bounds, pa.array(f.value)), pa.array(list(f.dense), pa.list_(pa.float64()))], columns)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        got = pa.Table.from_batches(held).sort_by([("place", "ascending"), ("label", "ascending")]).combine_chunks()
        bucket, value, dense = (got.column(c).combine_chunks() for c in columns[2:])
        sizes = pa.compute.list_value_length(bucket).to_numpy()
        x = Features(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), bucket.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy(),
                     dense.flatten().to_numpy().reshape(len(got), len(STRUCTURE)))
        yield pa.RecordBatch.from_arrays([pa.array([fit(x, got.column("label").to_numpy(), p).dump()])], ["model"])

    place = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("place")
    features_of = _inputs(rows, F.col("label").cast("double"), place).mapInArrow(
        measure, "place long, label double, bucket array<int>, value array<double>, dense array<double>")
    # a doc_id may be repeated, so the rows are bounded again
    bounded = features_of.orderBy("place", "label").limit(p.sample).repartition(1)
    one = bounded.mapInArrow(learn, "model binary").collect()
    return Model.load(bytes(one[0].model)) if one else Model(0.5, *(np.zeros(0) for _ in range(4)))


def score(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """doc_id, content (hash of the text) and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.dump())  # its size is fixed by the parameters

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.load(shared.value)
        for rows, x in _batch_features(batches, p.buckets):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("content"), pa.array(scores(m, x))], ["doc_id", "content", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    content = F.xxhash64(F.coalesce("text", F.lit(""))).alias("content")
    return _inputs(docs, content).mapInArrow(apply, f"doc_id {kind}, content long, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels to learn from, without the held-out fold."""
    return read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))


def select_good(docs: DataFrame, labels: DataFrame, p: Params = Params(), learn_from: DataFrame | None = None) -> DataFrame:
    """The documents scored at least p.good, with all their columns; each is judged where it is read."""
    model = train(docs if learn_from is None else learn_from, labels, p)
    shared = docs.sparkSession.sparkContext.broadcast(model.dump())
    stated = "n_chars" in docs.columns

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.load(shared.value)
        for batch in batches:
            for first, last, raw, offsets in wb.slices(batch.column("text")):
                rows = batch.slice(first, last - first)
                n_chars = _n_chars(rows.column("n_chars")) if stated else np.full(len(rows), np.nan)
                yield rows.filter(pa.array(scores(m, features(raw, offsets, n_chars, p.buckets)) >= p.good))

    return docs.mapInArrow(good, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Params()
    docs = read(spark, sf_dir, "documents")
    model = train(docs, quality_labels(spark, sf_dir), p)
    return score(docs, model, p).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= p.good).cast("int").alias("predicted"))
