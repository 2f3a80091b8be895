"""Quality rules: statistics of each text, and lines that too many documents of a host share.

Lines are normalised (A-Z lowered, words joined by one space) and hashed. A line is above its host's limits when at
least `min_docs` different texts of the host hold it and these are more than `max_share` of the host's texts; exact
copies of a text count once, so that a document is not rejected for having copies. Such lines are removed, and a
document is rejected when they hold more than `1 - min_left` of its words, or when it fails the base rule (under
`min_words` words, or over half of its words in repeated three-word windows).

Null and empty texts have no words and fail the base rule; a null host is a host of its own; rows of one doc_id are
judged one by one, each by its own text; other columns are carried along untouched; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alttree.llm import wordbytes as wb
from alttree.llm.tables import keep, read, utf8


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_pct: int = 50
    min_docs: int = 10
    max_share: float = 0.05
    min_left: float = 0.3


PROFILE = """row_id long, host string, content long, doc_id {kind}, n_words long, word_chars long, n_symbols long,
 n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<long>"""

SYMBOL = np.zeros(256, np.int8)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def in_text(bounds: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Sum of marks between consecutive bounds."""
    sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def repeats(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal hashes of a text together, and which entries equal the one before them there."""
    order = np.argsort(hashes, kind="stable")
    h, t = hashes[order], text[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
    return order, same


def profile_slice(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base statistics of several texts, and their different lines as (text bounds, hash, words)."""
    words = wb.Words(raw, offsets, lower=False)
    n_words = words.counts
    text_of_word = np.repeat(np.arange(len(n_words)), n_words)
    solid = (~wb.SPACE[raw]) & ((raw & 0xC0) != 0x80)

    windows, at = words.windows(words.hashes(), 3)
    order, same = repeats(windows, text_of_word[at])
    again = same.copy()
    again[:-1] |= same[1:]
    covered = np.zeros(len(words) + 2, bool)
    for k in range(3):
        covered[at[order[again]] + k] = True

    newlines = np.flatnonzero(raw == wb.NEWLINE)
    line_of_word = np.searchsorted(newlines, words.start) + text_of_word
    first = np.flatnonzero(np.diff(line_of_word, prepend=-1))  # first word of each line that has one
    after = np.append(first[1:], len(words))
    text_of_line = text_of_word[first]
    edge = np.concatenate([[-1], newlines, [len(raw)]])
    nth = np.searchsorted(newlines, words.start[first])
    begin = np.maximum(edge[nth] + 1, offsets[text_of_line])
    end = np.minimum(edge[nth + 1], offsets[text_of_line + 1])
    exact = wb.stretch(wb.running(wb.BYTE_VALUE[raw]), begin, end)
    order, same = repeats(exact, text_of_line)
    dup = np.zeros(len(first), bool)
    dup[order] = same

    low = wb.stretch(wb.running(wb.BYTE_VALUE[wb.LOWER[raw]]), words.start, words.end)
    normal = wb.stretch(wb.running(low), first, after)
    order = np.lexsort((normal, text_of_line))
    n, t = normal[order], text_of_line[order]
    new = np.ones(len(n), bool)
    new[1:] = (n[1:] != n[:-1]) | (t[1:] != t[:-1])
    group = np.flatnonzero(new)
    sizes = np.add.reduceat((after - first)[order], group) if len(group) else np.zeros(0, np.int64)
    return {
        "n_words": n_words, "word_chars": wb.per_text(offsets, solid), "n_symbols": wb.per_text(offsets, SYMBOL[raw]),
        "n_dup_lines": np.bincount(text_of_line[dup], minlength=len(n_words)),
        "n_repeat_words": in_text(words.bounds, covered[: len(words)]),
        "line_bounds": np.searchsorted(t[group], np.arange(len(n_words) + 1)), "lines": n[group], "line_words": sizes,
    }


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, raw, offsets in wb.slices(batch.column("text")):
            got = profile_slice(raw, offsets)
            rows = batch.slice(first, last - first)
            bounds = pa.array(got.pop("line_bounds"), pa.int32())
            lists = {c: pa.ListArray.from_arrays(bounds, pa.array(got.pop(c).view(np.int64))) for c in ("lines", "line_words")}
            columns = {c: rows.column(c) for c in ("row_id", "host", "content", "doc_id")}
            columns |= {c: pa.array(v.astype(np.int64)) for c, v in got.items()} | lists
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def profile(docs: DataFrame) -> DataFrame:
    """One row per document: statistics and the hashes and sizes of its different lines. Written once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"), "doc_id", utf8().alias("text"))
    return keep(rows.mapInArrow(_profile, PROFILE.format(kind=kind)), "profile")


def frequent_lines(profiles: DataFrame, limits: Limits) -> DataFrame:
    """(host, line) above the limits. Copies of a text are merged before counting, rows before every shuffle."""
    hosts = profiles.groupBy("host").agg(F.countDistinct("content").alias("host_docs"))
    lines = profiles.select("host", "content", F.explode("lines").alias("line"))
    counts = lines.groupBy("host", "line").agg(F.countDistinct("content").alias("docs")).where(F.col("docs") >= limits.min_docs)
    return counts.join(hosts, "host").where(F.col("docs") > limits.max_share * F.col("host_docs")).select("host", "line")


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, content (hash of the text), the base statistics, base_failed, n_removed_words, removed_lines, kept."""
    profiles = profile(docs)
    lines = profiles.select("row_id", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    hits = lines.select("row_id", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words")).join(
        frequent_lines(profiles, limits), ["host", "line"])
    removed = hits.groupBy("row_id").agg(F.sum("words").alias("n_removed_words"), F.collect_list("line").alias("removed_lines"))
    base = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_pct * F.col("n_words"))
    gone = F.coalesce("n_removed_words", F.lit(0))
    return profiles.drop("lines", "line_words").join(removed, "row_id", "left").select(
        "doc_id", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        gone.alias("n_removed_words"), "removed_lines",
        (~base & (F.col("n_words") - gone >= limits.min_left * F.col("n_words"))).alias("kept"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose normalised hash is in the row's list."""
    for batch in wb.parts(batches):
        at = batch.schema.get_field_index("text")
        texts, lists = batch.column(at).to_pylist(), batch.column("__llm_removed").to_pylist()
        for i, drop in enumerate(lists):
            if drop:
                lines, gone = texts[i].split("\n"), set(drop)
                texts[i] = "\n".join(x for x in lines if _line_hash(x) not in gone)
        columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:-1])]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])


def _line_hash(line: str) -> int | None:
    raw = np.frombuffer(line.encode(), np.uint8)
    words = wb.Words(raw, np.array([0, len(raw)]), lower=True)
    if not len(words):
        return None
    sums = wb.running(words.hashes())
    return int(wb.stretch(sums, np.array([0]), np.array([len(words)])).view(np.int64)[0])


def apply(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The kept documents with all their columns, texts without the lines above the limits."""
    verdict = judge(docs, limits).where("kept").select(
        F.col("doc_id").alias("__llm_id"), F.col("content").alias("__llm_content"), F.col("removed_lines").alias("__llm_removed")
    ).dropDuplicates(["__llm_id", "__llm_content"])
    content = F.xxhash64(F.coalesce("text", F.lit("")))
    kept = docs.join(verdict, F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (content == F.col("__llm_content")))
    return kept.select(*docs.columns, "__llm_removed").mapInArrow(_without, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).drop("content", "removed_lines")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
stat AS (
  SELECT doc_id, host, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
ln AS (
  SELECT doc_id, host, text, line, array_to_string(regexp_extract_all(
           translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, host, text, unnest(ls) AS line FROM d)),
lines AS (SELECT * FROM ln WHERE words > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
win AS (
  SELECT doc_id, i, [word, lead(word, 1) OVER x, lead(word, 2) OVER x] AS g, lead(word, 2) OVER x AS third
  FROM word WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win WHERE third IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT text) AS host_docs FROM d GROUP BY host),
freq AS (
  SELECT l.host, l.norm FROM (SELECT host, norm, count(DISTINCT text) AS docs FROM lines GROUP BY host, norm) l
  JOIN hosts USING (host) WHERE docs >= 10 AND docs > 0.05::DOUBLE * host_docs),
gone AS (SELECT doc_id, sum(words) AS n FROM lines JOIN freq USING (host, norm) GROUP BY doc_id),
al AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM stat LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND n_words - n_removed_words >= 0.3::DOUBLE * n_words AS kept
FROM al"""
