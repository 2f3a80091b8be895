"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the hashes of its different word windows. Tokens have one global order: rare ones first, by
hash, then frequent ones (more than `frequent` documents), by hash. Two sets within the threshold lose at most tau
tokens of each to the other, so the start of a set, taken until it survives the loss of any tau tokens, leaves both
with a common key. A rare token is a key by itself and one loss takes it away. Frequent tokens are dealt to classes by
hash, and all pairs of a class in the prefix are keys: a class of c tokens survives c - 1 losses. The prefix is thus
extended while it has frequent tokens, and no key is as frequent as a token is. The number of classes goes up with the
size of the set; a set whose partners may have another number gives the keys of both. Small sets use single tokens.

The documents of a key are candidates of each other. Keys are grouped by their smallest document, the hub, so that the
many keys of a group of near copies are one block, and blocks are split by size. Their documents are compared all
against all, tile by tile, inside tasks: first by sketches, a fixed eighth of each set, which rule out most for
certain, then by whole sets. Tasks give a forest of the links, never pairs. No candidate is left out.

The frequencies are counted exactly, on a prefix of `count_bytes` bytes of the token's hash. What tasks need to know of
them, whether a token is frequent and whether it has a second document at all, is kept in two bitmaps, sized by
the tokens they mark up to 2^bitmap_bits bits; clashes there make a token look more frequent, which costs keys but loses nothing.
Beyond some 50 million shared tokens the largest bitmap fills up, and the count of each key's documents, which follows
in any case, sorts out more of the keys; a set never gives more of them than its prefix has.

Texts are told apart by a 64-bit hash and copies of a text are one node. Null and empty texts and texts without words
have empty sets and link with nothing, not even each other. Rows are judged one by one; rows that repeat a doc_id each
get a row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alttree.llm import wordbytes as wb
from alttree.llm.bitmaps import count_bitmaps, marked
from alttree.llm.graph import Unions, components
from alttree.llm.tables import keep, partitions, read, utf8


@dataclass(frozen=True)
class Params:
    width: int = 4
    percent: int = 85
    frequent: int = 32
    count_bytes: int = 5
    #: log2 of the bits of the largest bitmap; each has as many as its tokens ask for.
    bitmap_bits: int = 30
    tile: int = 256
    #: (smallest size, classes of frequent tokens); a class number of 0 means single tokens.
    bands: tuple[tuple[int, int], ...] = ((0, 0), (64, 32), (512, 256), (4096, 2048), (32768, 16384))

    def least(self, n: int) -> int:
        """The smallest intersection of a set of n with a partner."""
        return -(-n * self.percent // 100)


def sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted hashes of the different windows of each text; a text with fewer words has one window of all."""
    words = wb.Words(raw, offsets, lower=True)
    hashes, bounds = words.hashes(), words.bounds
    windows, at = words.windows(hashes, width)
    cut = np.searchsorted(at, bounds)
    out = [np.unique(windows[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        whole = wb.stretch(wb.running(hashes), bounds[short], bounds[short + 1])
        for k, h in zip(short, whole, strict=True):
            out[k] = np.array([h])
    return out


def frequency_bitmaps(docs: DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of tokens in two documents or more and in more than p.frequent."""

    def tokens(column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, raw, offsets in wb.slices(column):
            yield from sets(raw, offsets, p.width)

    twice, frequent = count_bitmaps(docs.select(utf8().alias("text")), tokens, [2, p.frequent + 1], p.bitmap_bits, p.count_bytes)
    return twice, frequent


# Keys


def keys(tokens: np.ndarray, frequent: np.ndarray, p: Params) -> np.ndarray:
    """All keys of one set. tokens sorted by hash."""
    n = len(tokens)
    tau = n - p.least(n)
    out = []
    for k, (least, classes) in enumerate(p.bands):
        above = p.bands[k + 1][0] if k + 1 < len(p.bands) else 1 << 62
        if n < least or p.least(n) >= above:
            continue
        if not classes:
            ordered = np.concatenate([tokens[~frequent], tokens[frequent]])
            out.append(ordered[:tau + 1])
            continue
        rare, common = tokens[~frequent], tokens[frequent]
        out.append(rare[:tau + 1])
        need = tau + 1 - len(rare)
        if need <= 0:
            continue
        kind = (wb.mixed(common ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(classes)).astype(np.int64)
        first = np.zeros(len(common), bool)
        first[np.unique(kind, return_index=True)[1]] = True
        survives = np.cumsum(~first)  # losses that the first tokens stand, less one
        end = int(np.searchsorted(survives, need)) + 1
        order = np.argsort(kind[:end], kind="stable")
        t, c = common[:end][order], kind[:end][order]
        for gap in range(1, end):
            same = c[gap:] == c[:-gap]
            if not same.any():
                break
            out.append(wb.mixed(t[:-gap][same] * np.uint64(3) + wb.mixed(t[gap:][same])) ^ np.uint64(least + 1))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


SKETCH = 8  # a sketch holds the tokens whose hash is 0 modulo this, cut to 32 bits


def sketch(tokens: np.ndarray) -> bytes:
    """A fixed part of a set: what two sketches lack of each other, the sets lack too."""
    low = tokens[tokens % np.uint64(SKETCH) == 0]
    return (low >> np.uint64(32)).astype("<u4").tobytes()


def index(docs: DataFrame, twice: np.ndarray, frequent: np.ndarray, p: Params) -> DataFrame:
    """(row_id, doc_id, node, n_shingles, keys, sketch) of each row. Written once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((twice, frequent))  # two bitmaps of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, many = shared.value
        for batch in batches:
            for first, last, raw, offsets in wb.slices(batch.column("text")):
                rows = batch.slice(first, last - first)
                got = sets(raw, offsets, p.width)
                every = np.concatenate([np.zeros(0, np.uint64), *got])
                often = marked(many, every)
                alone = ~marked(two, every)
                lists, at = [], 0
                for t in got:
                    k = keys(t, often[at:at + len(t)], p)
                    lone = t[alone[at:at + len(t)]]
                    lists.append(k[~np.isin(k, lone)].view(np.int64))  # a token of one document is a key of one
                    at += len(t)
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                flat = np.concatenate([np.zeros(0, np.int64), *lists])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("row_id"), rows.column("doc_id"), rows.column("node"), pa.array([len(t) for t in got], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)), pa.array(map(sketch, got), pa.binary())],
                    ["row_id", "doc_id", "node", "n_shingles", "keys", "sketch"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", node_of().alias("node"), utf8().alias("text"))
    return keep(rows.mapInArrow(run, f"row_id long, doc_id {kind}, node long, n_shingles long, keys array<long>, sketch binary"), "index")


def node_of():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def level(n: str, p: Params):
    """Sizes of linked sets are at most one level apart: a level is slightly wider than the largest ratio of sizes."""
    return F.floor(F.log(F.col(n).cast("double")) / F.lit(-np.log(p.percent / 100) * 1.000001))


def blocks(indexed: DataFrame, p: Params) -> DataFrame:
    """(hub, band, node, n, level, tiles): the documents of each key, keys with the same smallest document together, split by size.

    A band holds the sizes of its level, within p.percent of each other, and of the level below, so partners share one.
    Written once.
    """
    rows = indexed.select("node", F.col("n_shingles").alias("n"), F.explode("keys").alias("key")).distinct()
    least = F.min(F.struct(F.xxhash64("node").alias("h"), "node")).getField("node")
    hubs = rows.groupBy("key").agg(least.alias("hub"), F.count("*").alias("c")).where("c > 1").select("key", "hub")
    members = rows.join(hubs, "key").select("hub", "node", "n").distinct().withColumn("level", level("n", p))
    banded = keep(members.withColumn("band", F.explode(F.array(F.col("level"), F.col("level") + 1))), "bands")
    full = banded.groupBy("hub", "band").agg(F.count("*").alias("c"), F.max(F.col("level") == F.col("band")).alias("has"))
    full = full.where("c > 1 and has").select("hub", "band", F.ceil(F.col("c") / p.tile).cast("int").alias("tiles"))
    return keep(banded.join(full, ["hub", "band"]).select("hub", "band", "node", "n", "level", "tiles"), "blocks")


def tiled(members: DataFrame) -> DataFrame:
    """Members of a block dealt to tiles, once for each pair of tiles to compare; sorted so that each pair comes in one run."""
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    each = members.withColumn("own", own).withColumn("pair", F.explode(pairs)).select("*", "pair.i", "pair.j").drop("pair", "tiles")
    place = ["hub", "band", "i", "j"]
    return each.repartition(partitions(members.sparkSession), *place).sortWithinPartitions(*place)


def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[dict[str, list]]:
    """Columns of each run of equal values in sorted batches."""
    held, last = None, None
    for batch in (b.slice(at, 256) for b in batches for at in range(0, len(b), 256)):
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        marks = list(zip(*(columns[c] for c in by), strict=True))
        start = 0
        for k in range(1, len(marks) + 1):
            if k < len(marks) and marks[k] == marks[start]:
                continue
            part = {c: v[start:k] for c, v in columns.items()}
            if held is not None and last == marks[start]:
                for c in held:
                    held[c] += part[c]
            else:
                if held is not None:
                    yield held
                held, last = part, marks[start]
            start = k
    if held is not None:
        yield held


def overlaps(members: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    tokens = np.concatenate(members)
    order = np.argsort(tokens, kind="stable")
    t, o = tokens[order], owner[order]
    new = np.ones(len(t), bool)
    new[1:] = t[1:] != t[:-1]
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    number, o = np.unique(number[shared], return_inverse=True)[1], o[shared]
    out = np.zeros((len(members), len(members)), np.float32)
    for at in range(0, int(number.max()) + 1 if len(number) else 0, 4096):
        a, b = np.searchsorted(number, [at, at + 4096])
        grid = np.zeros((len(members), 4096), np.float32)
        grid[o[a:b], number[a:b] - at] = 1
        out += grid @ grid.T
    return out.astype(np.int64)


def _compared(run: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, and which pairs of a run are to be compared: different documents, of different tiles if there are two, and
    not both of the level below, which have a band of their own."""
    node, own, below = np.array(run["node"]), np.array(run["own"]), np.array(run["level"]) < run["band"][0]
    ask = (node[:, None] != node[None, :]) & ~(below[:, None] & below[None, :])
    if run["i"][0] != run["j"][0]:
        ask &= own[:, None] != own[None, :]
    return np.array(run["n"]), ask


PLACE = ["hub", "band", "i", "j"]


def _hopeful(p: Params):
    """Members of a tile pair that some other member's sketch does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in runs(batches, PLACE):
            n, ask = _compared(r)
            parts = [np.frombuffer(s, "<u4") for s in r["sketch"]]
            common, size = overlaps(parts), np.array([len(x) for x in parts])
            total = n[:, None] + n[None, :]
            need = -(-total * p.percent // (100 + p.percent))  # the smallest intersection of linked sets of these sizes
            lacks = size[:, None] - common <= n[:, None] - need
            ok = (ask & lacks & lacks.T & (need <= np.minimum(n[:, None], n[None, :]))).any(1)
            if ok.any():
                yield pa.RecordBatch.from_pydict({c: [v for v, k in zip(r[c], ok, strict=True) if k] for c in (*PLACE, "node", "n", "own", "level")}, HOPEFUL)

    return run


HOPEFUL = pa.schema([("hub", pa.int64()), ("band", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("own", pa.int32()), ("level", pa.int64())])


def _linked(p: Params):
    """A forest of the links among the members of tile pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in runs(batches, PLACE):
            n, ask = _compared(r)
            common = overlaps([np.frombuffer(s, "<u8") for s in r["tokens"]])
            link = ask & (100 * common >= p.percent * (n[:, None] + n[None, :] - common))
            unions = Unions()
            for a, b in zip(*np.nonzero(np.triu(link)), strict=True):
                unions.join(r["node"][a], r["node"][b])
            nodes = list(unions.parent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([unions.root(x) for x in nodes], pa.int64())], ["a", "b"])

    return run


def _sets_of(p: Params, shared):
    """Whole sets of the rows that are marked in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("mark").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(marked(shared.value, wb.mixed(marks.view(np.uint64)))))
            for first, last, raw, offsets in wb.slices(batch.column("text")):
                got = [t.astype("<u8").tobytes() for t in sets(raw, offsets, p.width)]
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("mark"), rows.column("node"), rows.column("doc_id"), pa.array(got, pa.binary())], ["mark", "node", "doc_id", "tokens"])

    return run


def classes(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, node, n_shingles, class) of each row: class is the same for documents that links connect, null for empty sets."""
    indexed = index(docs, *frequency_bitmaps(docs, p), p)
    first = indexed.groupBy("node").agg(F.min("row_id").alias("row_id"))  # one row of each text
    sketches = indexed.join(first, ["node", "row_id"]).select("node", "doc_id", "sketch")
    kind = "hub long, band long, i int, j int, node long, n long, own int, level long"
    near = tiled(blocks(indexed, p).join(sketches.drop("doc_id"), "node")).mapInArrow(_hopeful(p), kind)
    near = keep(near, "hopeful")
    mark = F.xxhash64("node", "doc_id").alias("mark")
    wanted = keep(near.select("node").distinct().join(sketches.select("node", "doc_id"), "node").select(mark, "node"), "wanted")
    bitmap = count_bitmaps(wanted.select(F.col("mark").alias("text")), lambda c: [wb.mixed(c.to_numpy(zero_copy_only=False).view(np.uint64))], [1], p.bitmap_bits)[0]
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # so that only the texts of blocks are shuffled
    id_kind, parts = docs.schema["doc_id"].dataType.simpleString(), partitions(docs.sparkSession)
    texts = docs.select("doc_id", node_of().alias("node"), utf8().alias("text")).select(mark, "*")
    some = texts.mapInArrow(_sets_of(p, shared), f"mark long, node long, doc_id {id_kind}, tokens binary")
    # dealt as the join below asks for, so that the sets are moved once
    one = some.repartition(parts, "mark", "node").dropDuplicates(["mark", "node", "doc_id"]).withColumnRenamed("node", "node_")
    members = near.join(wanted, "node")
    ready = members.join(one, (members["mark"] == one["mark"]) & (members["node"] == one["node_"])).select(*near.columns, "tokens")
    ready = ready.repartition(parts, *PLACE).sortWithinPartitions(*PLACE)
    groups = components(ready.mapInArrow(_linked(p), "a long, b long")).withColumnRenamed("node", "member")
    return indexed.join(groups, F.col("node") == F.col("member"), "left").select(
        "doc_id", "node", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("class"))


def link(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each row."""
    rows = keep(classes(docs, p).drop("node"), "classes")
    least = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_each(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents with one left of each group of linked ones, the one with the smallest doc_id."""
    rows = keep(classes(docs, p), "classes")
    out = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    stay = out.select("first.doc_id", "first.node").unionByName(rows.where(F.col("class").isNull()).select("doc_id", "node"))
    stay = stay.groupBy(F.xxhash64("doc_id", "node").alias("__llm_key")).agg(F.collect_set(F.struct("doc_id", "node")).alias("__llm_stay"))
    keyed = docs.withColumn("__llm_node", node_of()).withColumn("__llm_own", F.xxhash64("doc_id", "__llm_node"))
    same = F.exists("__llm_stay", lambda s: s["doc_id"].eqNullSafe(F.col("doc_id")) & (s["node"] == F.col("__llm_node")))
    found = keyed.join(stay, F.col("__llm_own") == F.col("__llm_key")).where(same)  # by one column, so that repeated rows lie where the join put them
    one = found.dropDuplicates(["__llm_own", "doc_id", "__llm_node"])
    return one.select(*docs.columns)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents"))
