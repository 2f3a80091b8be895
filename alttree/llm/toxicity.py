"""Toxicity: a support vector machine over a subsequence string kernel, on Nyström landmarks.

Texts are split into sentences, and these into strings: words without the signs at their ends, and runs of three or
more spaced single letters written together. The kernel of two strings adds up, over all subsequences of three
characters that both hold (their first and last places marked), the products of the subsequences' weights; a weight is
`decay` to the number of characters skipped, of which `span` - 3 at most. So `idiot`, `idi0t`, `i.diot` and `i d i o t` are
near each other. Values are divided by the norms that strings of these lengths have where no subsequence repeats.

The machine is linear over the kernel values with a few hundred landmark strings, mapped by the inverse root of the
landmarks' own kernel matrix. Its weights collapse into one weight for each subsequence of a landmark, so a string is scored in
time linear in its length, exactly as by the kernel. A sentence scores as its worst string. Labels are known for whole
texts only: in each round a toxic text's sentences are represented by their worst strings, all strings of clean
texts count against them, and the machine is fitted anew. A text's score is a logistic function of its sentences' scores,
fitted on labelled texts that the machine has not seen.

The machine learns from `sample` labelled rows at most (the smallest hashes of id and text) and up to `sentences` sentences of
each, the logistic function from `calibrate` further rows. All rows are scored in whole. Labels, language, source and ids
are never inputs; the held-out fold (crc32 of the id, modulo 4, is 2) is never learned from.

Null and empty texts have no strings and get the score of such texts. Null labels are left out, repeated rows and labels
each count, ties go to the smaller hash, only doc_id and text are read, and an empty table gives no rows. Strings longer than
PIECE are scored in overlapping pieces. Without labels of both kinds every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alttree.llm import wordbytes as wb
from alttree.llm.quality_classifier import held_out
from alttree.llm.tables import read, utf8


@dataclass(frozen=True)
class Params:
    landmarks: int = 512
    span: int = 6
    decay: float = 0.75
    sample: int = 6000
    sentences: int = 40
    calibrate: int = 4000
    rounds: int = 5
    cost: float = 200.0
    toxic: float = 0.3


PIECE = 64
FIRST, LAST = 1, 2  # marks of a string's ends; as characters they are not letters
BITS = 20


def _classes() -> tuple[np.ndarray, np.ndarray]:
    letter, space = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for c in [*range(0xD800), *range(0xE000, 0x110000)]:
        letter[c], space[c] = chr(c).isalnum(), chr(c).isspace()
    return letter, space


_known: list[np.ndarray] = []


def classes() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters or digits, and which are white space."""
    if not _known:
        _known.extend(_classes())
    return _known[0], _known[1]


@dataclass
class Strings:
    """Strings of several texts: ranges of `points`, the sentence of each, and the number of each text's first sentence."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sentence: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        return wb.stretch(wb.running(wb.mixed(self.points.astype(np.uint64) + np.uint64(0x51ED))), self.start, self.end)

    def text(self, k: int) -> str:
        return self.points[self.start[k]:self.end[k]].astype("<u4").tobytes().decode("utf-32-le")


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the runs of marks, and the places after."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def strings_of(texts: list[str]) -> Strings:
    letter, space = classes()
    low = [f"{t.lower()}\n" for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    ends = np.cumsum([len(t) for t in low]).astype(np.int64)
    blank = space[points]
    stop = np.isin(points, [ord(c) for c in ".!?"])
    stop[:-1] &= blank[1:]
    stop |= points == ord("\n")
    sentence_at = np.concatenate([[0], np.cumsum(stop)])  # the number of the sentence that each place is in
    bounds = np.concatenate([[0], sentence_at[ends]])
    first, after = runs(~blank)
    letters = np.flatnonzero(letter[points])
    a, b = np.searchsorted(letters, first), np.searchsorted(letters, after)
    has = b > a
    start, end = letters[a[has]], letters[b[has] - 1] + 1
    sentence = sentence_at[start]

    # Spaced letters written together, as further strings behind the texts' points
    one = end - start == 1
    group = np.cumsum(np.concatenate([[True], ~(one[1:] & one[:-1] & (sentence[1:] == sentence[:-1]))])) if len(one) else np.zeros(0, np.int64)
    sizes = np.bincount(group, minlength=1)
    joined = one & (sizes[group] >= 3) if len(one) else one
    which = np.flatnonzero(joined)
    if len(which):
        heads = np.flatnonzero(np.diff(group[which], prepend=-1))
        cut = np.append(heads, len(which)) + len(points)
        points = np.concatenate([points, points[start[which]]])
        start, end = np.concatenate([start, cut[:-1]]), np.concatenate([end, cut[1:]])
        sentence = np.concatenate([sentence, sentence[which[heads]]])

    long = end - start > PIECE
    if long.any():
        n = np.where(long, -(-(end - start - PIECE // 2) // (PIECE // 2)), 1)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin, stop_at, is_long = np.repeat(start, n), np.repeat(end, n), np.repeat(long, n)
        start = begin + nth * (PIECE // 2)
        end = np.where(is_long, np.minimum(start + PIECE, stop_at), stop_at)
        sentence = np.repeat(sentence, n)
    return Strings(points, start, end, sentence, bounds)


def subsequences(s: Strings, which: np.ndarray, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(string, key, weight) of all subsequences of the chosen strings, a pattern of gaps at a time."""
    size = s.end[which] - s.start[which] + 2
    after = np.cumsum(size)
    owner = np.repeat(np.arange(len(which)), size)
    place = np.arange(after[-1] if len(after) else 0) - (after - size)[owner]
    room = size[owner] - place  # places from here to the string's end
    at = np.minimum(np.maximum((s.start[which])[owner] + place - 1, 0), max(len(s.points) - 1, 0))
    c = np.where(place == 0, FIRST, np.where(room == 1, LAST, s.points[at] if len(s.points) else 0))
    for j in range(2, p.span):
        fits = np.flatnonzero(room > j)
        for i in range(1, j):
            yield owner[fits], c[fits] << 42 | c[fits + i] << 21 | c[fits + j], p.decay ** (j - 2)


def norms(sizes: np.ndarray, p: Params) -> np.ndarray:
    """Root of the sum of squared weights of the subsequences that strings of these sizes have."""
    total = np.zeros(len(sizes))
    for j in range(2, p.span):
        total += np.maximum(sizes + 2 - j, 0) * (j - 1) * p.decay ** (2 * (j - 2))
    return np.sqrt(np.maximum(total, 1e-12))


@dataclass
class Table:
    """Values for subsequences: one or a row for each key."""

    keys: np.ndarray
    values: np.ndarray
    marks: np.ndarray = field(init=False)

    def __post_init__(self):
        self.marks = np.zeros(1 << BITS, bool)
        self.marks[self.slot(self.keys)] = True

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (wb.mixed(keys.view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are known, and where."""
        maybe = np.flatnonzero(self.marks[self.slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), max(len(self.keys) - 1, 0))
        sure = self.keys[at] == keys[maybe] if len(self.keys) else np.zeros(len(maybe), bool)
        return maybe[sure], at[sure]


def landmark_table(s: Strings, which: np.ndarray, p: Params) -> Table:
    """The landmarks' own weights: a row per subsequence, a column per landmark, divided by their norms."""
    found = [(o, k, np.full(len(o), w)) for o, k, w in subsequences(s, which, p)]
    owner, key, weight = (np.concatenate(c) for c in zip(*found, strict=True))
    keys, row = np.unique(key, return_inverse=True)
    values = np.zeros((len(keys), len(which)))
    np.add.at(values, (row, owner), weight)
    return Table(keys, values / norms(s.end[which] - s.start[which], p))


def kernel(s: Strings, which: np.ndarray, table: Table, p: Params) -> np.ndarray:
    """Kernel values of the chosen strings with the table's landmarks, or their scores where it holds one weight a key."""
    out = np.zeros((len(which), *table.values.shape[1:]))
    for first in range(0, len(which), 4096):
        part = which[first:first + 4096]
        for owner, key, weight in subsequences(s, part, p):
            here, at = table.find(key)
            if out.ndim == 1:
                out[first:first + len(part)] += weight * np.bincount(owner[here], table.values[at], len(part))
            elif len(here):
                rows, values = owner[here], weight * table.values[at]
                heads = np.flatnonzero(np.diff(rows, prepend=-1))
                out[first + rows[heads]] += np.add.reduceat(values, heads, axis=0)
    size = norms(s.end[which] - s.start[which], p)
    return out / (size if out.ndim == 1 else size[:, None])


def machine(z: np.ndarray, weight_1: np.ndarray, weight_0: np.ndarray, cost: float) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; rows may count as toxic, as clean, or as both."""
    x = np.hstack([z, np.ones((len(z), 1))])
    x, y, c = np.vstack([x, x]), np.repeat([1.0, -1.0], len(x)), cost * np.concatenate([weight_1, weight_0])
    used = c > 0
    x, y, c = x[used], y[used], c[used]
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3

    def loss(v: np.ndarray) -> float:
        return 0.5 * v @ ridge @ v + 0.5 * (c * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()

    for _ in range(30):
        inside = y * (x @ w) < 1
        xi, ci = x[inside], c[inside]
        step = np.linalg.solve(ridge + (xi * ci[:, None]).T @ xi, (xi * ci[:, None]).T @ y[inside]) - w
        rate, now = 1.0, loss(w)
        while loss(w + rate * step) > now and rate > 1e-6:
            rate /= 2
        w = w + rate * step
        if now - loss(w) < 1e-8 * now:
            break
    return w


@dataclass
class Model:
    """A weight for each subsequence, the machine's constant, and the logistic weights; `base` alone without a machine."""

    base: float
    table: Table | None = None
    constant: float = 0.0
    logistic: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def dump(self) -> bytes:
        out = io.BytesIO()
        keys, values = (self.table.keys, self.table.values) if self.table else (np.zeros(0, np.int64), np.zeros(0))
        np.savez(out, base=self.base, keys=keys, values=values, constant=self.constant, logistic=self.logistic)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Model:
        z = np.load(io.BytesIO(data))
        table = Table(z["keys"], z["values"]) if len(z["keys"]) else None
        return Model(float(z["base"]), table, float(z["constant"]), z["logistic"])


def learn(docs: list[list[list[str]]], y: np.ndarray, p: Params) -> Model:
    """The machine from labelled texts, given as lists of sentences, these as lists of strings."""
    base = float(y.mean()) if len(y) else 0.5
    if not len(y) or base in (0.0, 1.0):
        return Model(base)
    names = sorted({s for d in docs for sentence in d for s in sentence})
    number = {s: k for k, s in enumerate(names)}
    bags = [[np.array([number[s] for s in sentence]) for sentence in d if sentence] for d in docs]
    in_docs = np.zeros((2, len(names)))
    for bag, label in zip(bags, y, strict=True):
        if bag:
            in_docs[int(label), np.unique(np.concatenate(bag))] += 1
    if not len(names):
        return Model(base)
    n0, n1 = in_docs
    total = np.bincount(y.astype(int), minlength=2)
    odds = np.log((n1 + 0.5) / (total[1] - n1 + 0.5)) - np.log((n0 + 0.5) / (total[0] - n0 + 0.5))
    telling = odds / np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))

    ends = np.cumsum([len(s) for s in names])
    all_points = np.frombuffer("".join(names).encode("utf-32-le"), "<u4").astype(np.int64)
    s = Strings(all_points, ends - np.array([len(x) for x in names]), ends, np.zeros(len(names), np.int64), np.zeros(1))

    def apart(order: np.ndarray, n: int) -> np.ndarray:
        """The first n strings of an order that are not near ones taken before."""
        order = order[:8 * n]
        near = kernel(s, order, landmark_table(s, order, p), p)
        taken: list[int] = []
        for k in range(len(order)):
            if len(taken) < n and (not taken or near[k, taken].max() < 0.8):
                taken.append(k)
        return order[taken]

    toxic = apart(np.argsort(-telling, kind="stable"), p.landmarks // 2)
    clean = apart(np.argsort(-n0 * (telling < 1), kind="stable"), p.landmarks // 2)
    marks = np.unique(np.concatenate([toxic, clean]))
    table = landmark_table(s, marks, p)
    values, vectors = np.linalg.eigh(kernel(s, marks, table, p))
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])

    rng = np.random.default_rng(11)
    chosen = np.unique(np.concatenate([marks, np.argsort(-n0, kind="stable")[:4000], rng.permutation(len(names))[:8000]]))
    scores = telling / max(telling.max(), 1e-9) - 0.3
    for _ in range(p.rounds):
        weight = np.zeros((2, len(names)))
        weight[0] = n0 * total[1] / total[0]
        for bag, label in zip(bags, y, strict=True):
            if label and bag:
                worst = np.array([b[np.argmax(scores[b])] for b in bag])
                witnesses = np.unique(worst[scores[worst] > 0])
                weight[1, witnesses if len(witnesses) else worst[np.argmax(scores[worst])]] += 1
        wrong = np.flatnonzero((n0 > 0) & (scores > -0.5) & (weight[1] < weight[0]))
        chosen = np.unique(np.concatenate([chosen, np.flatnonzero(weight[1] > 0), wrong[np.argsort(-scores[wrong], kind="stable")[:4000]]]))
        w = machine(kernel(s, chosen, table, p) @ root, weight[1, chosen], weight[0, chosen], p.cost)
        one = Table(table.keys, table.values @ (root @ w[:-1]))
        scores = kernel(s, np.arange(len(names)), one, p) + w[-1]
    return Model(base, one, float(w[-1]))


TRAITS = ["worst", "log_bad_sentences", "bad_sentences", "bad_strings", "sum", "one"]


def traits(texts: list[str], m: Model, p: Params) -> np.ndarray:
    """What the sentences' scores say about each text."""
    s = strings_of(texts)
    out = np.zeros((len(texts), len(TRAITS)))
    out[:, 0], out[:, -1] = -1, 1
    if not len(s.start) or m.table is None:
        return out
    _, first, same = np.unique(s.hashes(), return_index=True, return_inverse=True)
    score = (kernel(s, first, m.table, p) + m.constant)[same]
    worst = np.full(int(s.bounds[-1]) + 1, -np.inf)
    np.maximum.at(worst, s.sentence, score)
    filled = np.flatnonzero(worst > -np.inf)
    text = np.searchsorted(s.bounds, filled, "right") - 1
    text_of_string = np.searchsorted(s.bounds, s.sentence, "right") - 1
    n = np.maximum(np.bincount(text, minlength=len(texts)), 1)
    bad = np.bincount(text, worst[filled] > 0, len(texts))
    top = np.full(len(texts), -1.0)
    np.maximum.at(top, text, np.clip(worst[filled], -1, 1.5))
    out[:, 0], out[:, 1], out[:, 2] = top, np.log1p(bad), bad / n
    strings = np.maximum(np.bincount(text_of_string, minlength=len(texts)), 1)
    out[:, 3] = np.minimum(50 * np.bincount(text_of_string, score > 0, len(texts)) / strings, 3)
    out[:, 4] = np.minimum(50 * np.bincount(text_of_string, np.clip(score, 0, 1.5), len(texts)) / strings, 3)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge; `y` holds both labels."""
    w, ridge = np.zeros(x.shape[1]), 0.3 * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge, x.T @ (y - q) - ridge @ w)
        w = w + step * min(1, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for first, last, raw, offsets in wb.slices(batch.column("text")):
            data = raw.tobytes()
            yield batch.slice(first, last - first), [data[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _sentences(limit: int):
    """Up to `limit` sentences of each text, those with the smallest hash, as lists of strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _texts(batches):
            s = strings_of(texts)
            order = np.argsort(s.sentence, kind="stable")
            hashes = s.hashes()[order]
            number = s.sentence[order]
            heads = np.flatnonzero(np.diff(number, prepend=-1))
            tails = np.append(heads[1:], len(number))
            mark = wb.mixed(np.add.reduceat(hashes, heads)) if len(heads) else hashes
            text = np.searchsorted(s.bounds, number[heads], "right") - 1
            out: list[list[list[str]]] = [[] for _ in texts]
            for k in np.lexsort((mark, text)).tolist():
                if len(out[text[k]]) < limit:
                    least = np.argsort(hashes[heads[k]:tails[k]], kind="stable")[:limit] + heads[k]
                    out[text[k]].append([s.text(order[i]) for i in least])
            yield pa.RecordBatch.from_arrays([rows.column("place"), rows.column("label"), pa.array(out, pa.list_(pa.list_(pa.string())))],
                                             ["place", "label", "sentences"])

    return run


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """labels: doc_id and label (0 or 1)."""
    spark = docs.sparkSession
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label")]
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("double").alias("label"))
    ids = known.orderBy(*order).limit(p.sample + p.calibrate).select("doc_id", "label").toArrow().to_pylist()

    def rows(chosen: list[dict]) -> DataFrame:
        """The chosen texts; their labels are a broadcast of bounded size."""
        few = spark.createDataFrame([(r["doc_id"], r["label"]) for r in chosen], known.schema)
        return docs.select("doc_id", utf8().alias("text")).join(F.broadcast(few), "doc_id").select(
            F.xxhash64("doc_id", "text").alias("place"), "label", "text")

    part = p.sample * len(ids) // max(p.sample + p.calibrate, 1)
    sentences = rows(ids[:part]).mapInArrow(_sentences(p.sentences), "place long, label double, sentences array<array<string>>")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r["place"], r["label"], r["sentences"]) for b in batches for r in b.to_pylist())
        model = learn([s for _, _, s in got], np.array([y for _, y, _ in got]), p)
        yield pa.RecordBatch.from_arrays([pa.array([model.dump()])], ["model"])

    one = sentences.orderBy("place", "label", "sentences").limit(p.sample).repartition(1).mapInArrow(fit, "model binary").collect()
    model = Model.load(bytes(one[0].model)) if one else Model(0.5)
    if model.table is None:
        return model
    shared = spark.sparkContext.broadcast(model.dump())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.load(shared.value)
        for r, texts in _texts(batches):
            yield pa.RecordBatch.from_arrays([r.column("place"), r.column("label"), pa.array(list(traits(texts, m, p)))], ["place", "label", "traits"])

    seen = rows(ids[part:]).mapInArrow(measure, "place long, label double, traits array<double>")
    held = seen.orderBy("place", "label", "traits").limit(p.calibrate).collect()
    y = np.array([r.label for r in held])
    if len(set(y.tolist())) < 2:
        model.logistic = np.array([3.0, 0, 0, 0, 0, 0])
    else:
        model.logistic = fit_logistic(np.array([r.traits for r in held]), y)
    return model


def score(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.dump())  # its size is bounded by the landmarks

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.load(shared.value)
        for rows, texts in _texts(batches):
            if m.table is None:
                scores = np.full(len(texts), m.base)
            else:
                scores = 1 / (1 + np.exp(-np.clip(traits(texts, m, p) @ m.logistic, -30, 30)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8().alias("text")).mapInArrow(apply, f"doc_id {kind}, score double")


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels to learn from, without the held-out fold."""
    return read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Params()
    docs = read(spark, sf_dir, "documents")
    model = train(docs, toxic_labels(spark, sf_dir), p)
    return score(docs, model, p).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= p.toxic).cast("int").alias("predicted"))
