"""Positional encodings of letter sequences into one-hot feature ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alttree.functions.arrays import let

# Alphabet, and the letters kept left and right of the skipped centre pair.
ALPHABET = "ACGT"
CENTER = 60
LEFT_WINDOW = 59
RIGHT_WINDOW = 80

WINDOW_SIZE = LEFT_WINDOW + RIGHT_WINDOW
MIN_LENGTH = CENTER + 1 + RIGHT_WINDOW
N_SINGLE = WINDOW_SIZE * len(ALPHABET)
N_PAIR = (WINDOW_SIZE - 1) * len(ALPHABET) ** 2


def n_features(pairs: bool = False) -> int:
    return N_SINGLE + (N_PAIR if pairs else 0)


def window_extract(seq: Column) -> Column:
    """Letters left of the centre followed by the letters right of it, the centre pair left out."""
    left = F.substring(seq, CENTER - LEFT_WINDOW, LEFT_WINDOW)
    right = F.substring(seq, CENTER + 2, RIGHT_WINDOW)
    return F.concat(left, right)


def letters_of(win: Column) -> Column:
    """The window as an array of letters, so that it is computed once and not per position."""
    return F.split(win, "")


def letter_index(letter: Column) -> Column:
    """0-based place in the alphabet; -1 for any other letter."""
    return F.when(F.length(letter) == 1, F.instr(F.lit(ALPHABET), letter) - 1).otherwise(-1)


def single_ids(letters: Column) -> Column:
    """Feature id of every position's letter; null for a letter outside the alphabet."""

    def one(letter: Column, pos: Column) -> Column:
        index = letter_index(letter)
        return F.when(index >= 0, pos * 4 + index)

    return F.transform(letters, one)


def pair_ids(letters: Column) -> Column:
    """Feature id of every pair of neighbouring letters."""
    pairs = F.arrays_zip(F.slice(letters, 1, WINDOW_SIZE - 1).alias("a"), F.slice(letters, 2, WINDOW_SIZE - 1).alias("b"))

    def one(pair: Column, pos: Column) -> Column:
        a, b = letter_index(pair["a"]), letter_index(pair["b"])
        return F.when((a >= 0) & (b >= 0), F.lit(N_SINGLE) + pos * 16 + a * 4 + b)

    return F.transform(pairs, one)


def has_unknown(win: Column) -> Column:
    return F.length(F.translate(win, ALPHABET, "")) > 0


def encode(
    rows: DataFrame,
    seq: str = "seq",
    pairs: bool = False,
    on_unknown: str = "error",
    on_short: str = "keep",
) -> DataFrame:
    """One-hot rows (sorted ids in `nz`) from sequences.

    A sequence shorter than MIN_LENGTH keeps the features of the positions it has ("keep")
    or fails the job ("error"); a null one has none. A letter outside the alphabet fails the
    job ("error"), drops the row ("skip") or gives no feature ("null").
    """
    if on_unknown not in ("error", "skip", "null") or on_short not in ("keep", "error"):
        raise ValueError(f"on_unknown={on_unknown!r}, on_short={on_short!r}")
    letters = F.coalesce(seq, F.lit(""))
    if on_short == "error":
        letters = F.when(F.length(letters) < MIN_LENGTH, F.raise_error(F.lit(f"sequence shorter than {MIN_LENGTH}")).cast("string")).otherwise(letters)
    win = let(letters, window_extract)
    if on_unknown == "skip":
        rows = rows.where(~has_unknown(win))
    if on_unknown == "error":
        place = F.col("row_id").cast("string") if "row_id" in rows.columns else F.col(seq)
        message = F.concat(F.lit("letter outside the alphabet in row "), place)
        win = let(win, lambda w: F.when(has_unknown(w), F.raise_error(message).cast("string")).otherwise(w))
    ids = let(letters_of(win), lambda ls: F.concat(single_ids(ls), pair_ids(ls)) if pairs else single_ids(ls))
    return rows.withColumn("nz", F.array_sort(F.array_compact(ids))).drop(seq)


def onehot_long(rows: DataFrame) -> DataFrame:
    """Long form of the ones; every feature not listed is 0.

    The outer form keeps Spark from computing the ids again to look for empty lists.
    """
    kept = [c for c in rows.columns if c != "nz"]
    ones = rows.select(*kept, F.explode_outer("nz").alias("feature")).where("feature is not null")
    return ones.withColumn("value", F.lit(1.0))


def feature_dictionary(spark: SparkSession, pairs: bool = False) -> DataFrame:
    """feature id, name (position and letters), position and letters of every feature."""
    letters = F.split(F.lit(ALPHABET), "")

    def place(idx: Column, k: int) -> Column:
        return F.get(letters, F.pmod(F.floor(idx / F.lit(4**k)), F.lit(4)).cast("int"))

    single = spark.range(N_SINGLE).select(
        F.col("id").cast("int").alias("feature"),
        F.floor(F.col("id") / 4).cast("int").alias("pos"),
        place(F.col("id"), 0).alias("token"),
    )
    out = single
    if pairs:
        double = spark.range(N_PAIR).select(
            (F.col("id") + N_SINGLE).cast("int").alias("feature"),
            F.floor(F.col("id") / 16).cast("int").alias("pos"),
            F.concat(place(F.col("id"), 1), place(F.col("id"), 0)).alias("token"),
        )
        out = single.unionByName(double)
    return out.select("feature", F.concat(F.col("pos").cast("string"), "token").alias("name"), "pos", "token")
