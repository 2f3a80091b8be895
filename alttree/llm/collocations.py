"""Phrase collocation mining by best-first branch and bound.

A phrase of 2 or 3 words that occurs a times scores, over its cuts into a first part (l times) and a rest (r times),
the least floor(scale · a² / (l · r)). Each language's best `top` phrases are wanted, without phrases that a longer
candidate contains and that are seldom seen outside it.

Phrases grow from their first words. A node of the search is a prefix with its count and the count of its occurrences
that go on in the same piece; since a is at most the latter and r at least a, every phrase grown from a word x scores
at most scale · on(x) / f(x), and one grown from a pair xy at most scale · on(xy) / f(x). Nodes are expanded best first, `batch`
at a time: one pass over the corpus counts what their occurrences go on with. Growing a pair counts the triples that
start with it and those that end with it, so that it is known whether a longer candidate drops it. The cut of a
language is its `top`-th best phrase among those settled, by score and count; nodes whose bound is below it are never
expanded, and the search ends when no node is left at or above it. Equal scores and counts are all expanded, ties being
settled by the phrase's bytes.

Only a batch of nodes is broadcast, 8 bytes each; everything else is counted, joined and ranked by Spark. Scores are
exact decimals. Words are told apart by 64-bit hashes of language and word: at ten million different words the chance
that any two clash is about three in a million.

Null texts count as empty, a null language as `und`, repeated rows and copies count each; ties are broken as above;
very long texts are read in whole, a slice of words at a time; an empty table gives no rows. Only text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from alttree.llm import wordbytes as wb
from alttree.llm.tables import forget, keep, partitions, read, utf8


@dataclass(frozen=True)
class Params:
    least: int = 10
    top: int = 2000
    scale: int = 1_000_000
    inside_pct: int = 50
    word_batch: int = 1 << 20
    pair_batch: int = 1 << 17


HELD = 750_000  # occurrences that a task holds before it adds them up
SLICE = 1 << 18  # bytes of text read at a time while phrases grow, whose words take some 90 bytes a byte meanwhile
BLOCK = 1 << 16  # rows handed over at a time: Spark holds a batch outside its heap
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
SOLID = ~BREAK
SOLID[[0x20, 0x09]] = False
LANG_STEP, PAIR_STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5CB9243F2CE6A2B)


@dataclass
class Occurrences:
    """Words of a slice of texts in order: key, byte bounds, lowered bytes, text, and whether the next word is in the same piece."""

    key: np.ndarray
    start: np.ndarray
    end: np.ndarray
    raw: np.ndarray
    text: np.ndarray
    on: np.ndarray


def occurrences(raw: np.ndarray, offsets: np.ndarray, lang_key: np.ndarray) -> Occurrences:
    solid, low = SOLID[raw], wb.LOWER[raw]
    begins, after = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    after[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[inner] = solid[inner]
    after[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(after) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    breaks = np.concatenate([[0], np.cumsum(BREAK[raw])])
    on = np.zeros(len(start), bool)
    on[:-1] = (text[1:] == text[:-1]) & (breaks[start[1:]] == breaks[end[:-1]])
    key = wb.mixed(wb.stretch(wb.running(wb.BYTE_VALUE[low]), start, end) + lang_key[text] * LANG_STEP)
    return Occurrences(key, start, end, low, text, on)


def pair_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return wb.mixed(x * PAIR_STEP + y)


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in `known`, which is sorted."""
    if not len(known):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys


def counted(mark: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of one occurrence of each different mark, how many it has, and how many go on."""
    order = np.argsort(mark, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], mark[order][1:] != mark[order][:-1]])) if len(mark) else np.zeros(0, np.int64)
    n = np.diff(np.append(heads, len(mark)))
    return order[heads], n, np.add.reduceat(on[order].astype(np.int64), heads) if len(heads) else n


def _slices(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, Occurrences]]:
    for batch in batches:
        lang_key = batch.column("lang_key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for first, last, raw, offsets in wb.slices(batch.column("text"), limit):
            yield batch.slice(first, last - first), occurrences(raw, offsets, lang_key[first:last])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, o in _slices(batches):
        place, n, on = counted(o.key, o.on)
        raw = o.raw.tobytes()
        words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(o.start[place].tolist(), o.end[place].tolist(), strict=True)]
        langs = rows.column("lang").take(pa.array(o.text[place]))
        yield pa.RecordBatch.from_arrays([langs, pa.array(words, pa.string()), pa.array(o.key[place].view(np.int64)), pa.array(n), pa.array(on)],
                                         ["lang", "word", "k", "f", "f_on"])


def _grown(width: int):
    """Phrases of `width` words grown from known nodes: from words to pairs, or from pairs to triples on either side."""
    names = ["x", "y", "z"][:width]

    def out(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        *keys, on = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        mark = pair_key(*keys[:2])
        place, n, going = counted(mark if width == 2 else pair_key(mark, keys[2]), on)
        for at in range(0, len(place), BLOCK):
            some = slice(at, at + BLOCK)
            columns = [*(k[place[some]].view(np.int64) for k in keys), n[some], going[some]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*names, "a", "a_on"])

    def run(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, o in _slices(batches, SLICE):
            if width == 2:
                at = np.flatnonzero(o.on)
                at = at[among(o.key[at], known)]
            else:
                at = np.flatnonzero(o.on)
                here = np.zeros(len(o.key) + 1, bool)
                here[at] = among(pair_key(o.key[at], o.key[at + 1]), known)
                at = np.flatnonzero(o.on[:-1] & o.on[1:]) if len(o.on) else at
                at = at[here[at] | here[at + 1]]
            held.append((*(o.key[at + k] for k in range(width)), o.on[at + width - 1]))
            size += len(at)
            if size > HELD:
                yield from out(held)
                size = 0
        if size:
            yield from out(held)

    return run, ", ".join(f"{c} long" for c in names) + ", a long, a_on long"


def grow(texts: DataFrame, nodes: list[np.ndarray], width: int, least: int) -> DataFrame:
    """(x, y[, z], a, a_on) of the phrases grown from a batch of nodes that occur `least` times or more.

    nodes: the keys of words, or those of both words of pairs; a batch is of bounded size.
    """
    mark = nodes[0] if len(nodes) == 1 else pair_key(*nodes)
    run, schema = _grown(width)
    shared = texts.sparkSession.sparkContext.broadcast(np.unique(mark))
    names = ["x", "y", "z"][:width]
    counts = texts.mapInArrow(lambda batches: run(batches, shared.value), schema).groupBy(*names)
    return counts.agg(F.sum("a").alias("a"), F.sum("a_on").alias("a_on")).where(F.col("a") >= least)


def exact_score(a: str, left: str, right: str, scale: int) -> Column:
    """floor(scale · a² / (l · r)) for counts below 10^15."""
    count = "cast({} as decimal(15,0))".format
    return F.expr(f"(cast({scale} as decimal(7,0)) * {count(a)} * {count(a)}) div ({count(left)} * {count(right)})")


def best(rows: DataFrame, order: list[Column], top: int) -> DataFrame:
    """Each language's first `top` rows with their rank; no task gets more than `top` rows of a language per partition."""
    salt = F.pmod(F.xxhash64("x", "y"), F.lit(partitions(rows.sparkSession)))
    some = rows.withColumn("__salt", salt)
    some = some.withColumn("__n", F.row_number().over(W.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("__n") <= top)
    return some.drop("__salt", "__n").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


class Search:
    """The state of a search: nodes and counts so far, as tables in the shared folder."""

    def __init__(self, docs: DataFrame, p: Params):
        self.p, self.spark = p, docs.sparkSession
        lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
        self.texts = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), utf8().alias("text"))
        found = self.texts.mapInArrow(_words, "lang string, word string, k long, f long, f_on long")
        counts = keep(found.groupBy("lang", "word", "k").agg(F.sum("f").alias("f"), F.sum("f_on").alias("f_on")), "words")
        self.totals = keep(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        self.words = keep(counts.where(F.col("f") >= p.least).withColumn("bound", self.bound("f_on", "f")), "frequent")
        forget(counts)
        self.expanded = self.empty("x long")  # words whose pairs are counted
        self.pairs = self.empty("x long, y long, a long, a_on long, lang string, f_x long, l long, r long, score long, bound long")
        self.grown = self.empty("x long, y long")  # pairs whose triples are counted
        self.triples = self.empty("x long, y long, z long, a long")
        self.cut = self.empty("lang string, cut_score long, cut_a long")

    def empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def bound(self, on: str, f: str) -> Column:
        return F.expr(f"(cast({self.p.scale} as decimal(7,0)) * {on}) div {f}")

    def open(self, score: str, count: str) -> Column:
        return F.col("cut_score").isNull() | (F.col(score) > F.col("cut_score")) | ((F.col(score) == F.col("cut_score")) & (F.col(count) >= F.col("cut_a")))

    def with_cut(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.cut, "lang", "left")

    def batch(self, nodes: DataFrame, keys: list[str], order: list[Column], limit: int) -> list[np.ndarray]:
        """The keys of the first nodes; their number is bounded."""
        rows = nodes.orderBy(*order, *keys).limit(limit).select(*keys).toArrow()
        return [rows.column(k).to_numpy().astype(np.int64).view(np.uint64) for k in keys]

    def table(self, nodes: list[np.ndarray], names: list[str]) -> DataFrame:
        return self.spark.createDataFrame(pa.table([n.view(np.int64) for n in nodes], names))

    def add(self, old: DataFrame, new: DataFrame, name: str) -> DataFrame:
        """Both together, written once."""
        both = keep(old.unionByName(new), name)
        if hasattr(old, "kept_at"):
            forget(old)
        return both

    def forced(self) -> DataFrame:
        """Middle words of triples that may be among the best, but whose second pair is not counted yet."""
        first = self.pairs.select("x", "y", F.col("a").alias("f_xy"), "lang", "f_x")
        z = self.words.select(F.col("k").alias("z"), F.col("f").alias("f_z"))
        t = self.triples.join(first, ["x", "y"]).join(z, "z").join(self.expanded.withColumnRenamed("x", "y"), "y", "left_anti")
        t = t.withColumn("at_most", F.least(self.bound("a", "f_x"), exact_score("a", "f_xy", "f_z", self.p.scale)))
        return self.with_cut(t).where(self.open("at_most", "a")).select(F.col("y").alias("k")).distinct()

    def expand_words(self) -> bool:
        """Count the pairs that start with the best words left; False if none is left."""
        left = self.words.join(self.expanded.withColumnRenamed("x", "k"), "k", "left_anti")
        at_or_above = self.with_cut(left.where(F.col("f_on") >= self.p.least)).where(self.open("bound", "f_on"))
        must = left.join(self.forced(), "k").withColumn("bound", F.lit(self.p.scale + 1))
        order = [F.desc("bound"), F.desc("f_on")]
        nodes = self.batch(at_or_above.select("k", "bound", "f_on").unionByName(must.select("k", "bound", "f_on")).groupBy("k").agg(
            F.max("bound").alias("bound"), F.max("f_on").alias("f_on")), ["k"], order, self.p.word_batch)
        if not len(nodes[0]):
            return False
        counts = grow(self.texts, nodes, 2, self.p.least)
        first = self.words.select(F.col("k").alias("x"), "lang", F.col("f").alias("f_x"))
        second = self.words.select(F.col("k").alias("y"), F.col("f").alias("r"))
        new = counts.join(first, "x").join(second, "y").withColumn("l", F.col("f_x")).withColumn(
            "score", exact_score("a", "l", "r", self.p.scale)).withColumn("bound", self.bound("a_on", "f_x"))
        self.pairs = self.add(self.pairs, new.select(*self.pairs.columns), "pairs")
        self.expanded = self.add(self.expanded, self.table(nodes, ["x"]), "expanded")
        return True

    def grow_pairs(self) -> bool:
        """Count the triples round the best pairs left; False if none is left."""
        left = self.with_cut(self.pairs.join(self.grown, ["x", "y"], "left_anti"))
        wanted = self.open("score", "a") | ((F.col("a_on") >= self.p.least) & self.open("bound", "a_on"))
        order = [F.desc(F.greatest("score", "bound")), F.desc("a")]
        nodes = self.batch(left.where(wanted), ["x", "y"], order, self.p.pair_batch)
        if not len(nodes[0]):
            return False
        new = grow(self.texts, nodes, 3, self.p.least).select(*self.triples.columns)
        new = new.join(self.triples, ["x", "y", "z"], "left_anti")  # a triple round pairs of two batches is found twice
        self.triples = self.add(self.triples, new.select(*self.triples.columns), "triples")
        self.grown = self.add(self.grown, self.table(nodes, ["x", "y"]), "grown")
        return True

    def settled(self) -> DataFrame:
        """Phrases whose score is known and that no longer candidate drops: x, y, z, lang, a, l, r, score."""
        pct = self.p.inside_pct
        inside = self.triples.select("x", "y", "a").unionByName(self.triples.select(F.col("y").alias("x"), F.col("z").alias("y"), "a"))
        longest = inside.groupBy("x", "y").agg(F.max("a").alias("longer"))
        two = self.pairs.join(self.grown, ["x", "y"], "left_semi").join(longest, ["x", "y"], "left")
        two = two.where(F.coalesce(100 * F.col("longer") < pct * F.col("a"), F.lit(True))).withColumn("z", F.lit(None).cast("long"))
        first = self.pairs.select("x", "y", F.col("a").alias("f_xy"), "lang", "f_x")
        second = self.pairs.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("f_yz"))
        third = self.words.select(F.col("k").alias("z"), F.col("f").alias("f_z"))
        three = self.triples.join(first, ["x", "y"]).join(second, ["y", "z"]).join(third, "z")
        one, two_ = exact_score("a", "f_x", "f_yz", self.p.scale), exact_score("a", "f_xy", "f_z", self.p.scale)
        three = three.withColumn("one", one).withColumn("two", two_).withColumn("early", F.col("one") <= F.col("two")).select(
            "x", "y", "z", "lang", "a", F.when(F.col("early"), F.col("f_x")).otherwise(F.col("f_xy")).alias("l"),
            F.when(F.col("early"), F.col("f_yz")).otherwise(F.col("f_z")).alias("r"), F.least("one", "two").alias("score"))
        return two.select(*three.columns).unionByName(three)

    def raise_cut(self) -> None:
        last = best(self.settled().select("lang", "x", "y", "score", "a"), [F.desc("score"), F.desc("a")], self.p.top).where(F.col("rank") == self.p.top)
        self.cut = self.add(self.empty(self.cut.schema), last.select("lang", F.col("score").alias("cut_score"), F.col("a").alias("cut_a")), "cut")

    def run(self) -> DataFrame:
        while self.expand_words():
            while self.grow_pairs():
                self.raise_cut()
        return self.result()

    def result(self) -> DataFrame:
        rows = self.with_cut(self.settled())
        rows = rows.where(self.open("score", "a"))
        for c in ("x", "y", "z"):
            rows = rows.join(self.words.select(F.col("k").alias(c), F.col("word").alias(f"word_{c}")), c, "left")
        rows = rows.withColumn("phrase", F.concat_ws(" ", "word_x", "word_y", "word_z"))
        top = best(rows, [F.desc("score"), F.desc("a"), F.asc("phrase")], self.p.top)
        return top.join(self.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, p: Params = Params()) -> DataFrame:
    return Search(docs, p).run()


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
u AS (SELECT lang, unnest(w) AS x FROM w),
f1 AS (SELECT lang, x, count(*) AS f FROM u GROUP BY ALL),
tot AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
b AS (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1),
f2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS a FROM b GROUP BY ALL HAVING count(*) >= 10),
t AS (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2),
f3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS a FROM t GROUP BY ALL HAVING count(*) >= 10),
longer AS (
  SELECT lang, x, y, max(a) AS a FROM (SELECT lang, x, y, a FROM f3 UNION ALL SELECT lang, y, z, a FROM f3) GROUP BY lang, x, y),
two AS (
  SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.a, p.f AS l, q.f AS r, 1000000::HUGEINT * f2.a * f2.a // (p.f::HUGEINT * q.f) AS score
  FROM f2 JOIN f1 p ON p.lang = f2.lang AND p.x = f2.x JOIN f1 q ON q.lang = f2.lang AND q.x = f2.y
  LEFT JOIN longer g ON g.lang = f2.lang AND g.x = f2.x AND g.y = f2.y WHERE g.a IS NULL OR 100 * g.a < 50 * f2.a),
cuts AS (
  SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, f3.a, p.f AS l1, q.a AS r1, s.a AS l2, v.f AS r2,
    1000000::HUGEINT * f3.a * f3.a // (p.f::HUGEINT * q.a) AS s1, 1000000::HUGEINT * f3.a * f3.a // (s.a::HUGEINT * v.f) AS s2
  FROM f3 JOIN f1 p ON p.lang = f3.lang AND p.x = f3.x JOIN f2 q ON q.lang = f3.lang AND q.x = f3.y AND q.y = f3.z
  JOIN f2 s ON s.lang = f3.lang AND s.x = f3.x AND s.y = f3.y JOIN f1 v ON v.lang = f3.lang AND v.x = f3.z),
al AS (
  SELECT * FROM two UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM al)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN tot USING (lang) WHERE rank <= 2000"""
