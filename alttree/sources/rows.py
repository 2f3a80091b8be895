"""Readers for labelled rows: sequence text and dense CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alttree.operators.placed import PLACE, located, row_number

# Fixed value: a line is "(<label>, u'<letters>')".
SEQUENCE_LINE = r"^\((-?\d+), u'(.*)'\)$"


def parse_sequences(lines: DataFrame, line: str = "value") -> DataFrame:
    """Add `y` and `seq` to labelled-sequence lines; a malformed label gives null."""
    parts = {
        "y": F.regexp_extract(line, SEQUENCE_LINE, 1).try_cast("int"),
        "seq": F.regexp_extract(line, SEQUENCE_LINE, 2),
    }
    return lines.withColumns(parts)


def with_row_id(rows: DataFrame) -> DataFrame:
    """Number rows without a key 0, 1, 2 ... in the order of their files and lines.

    The files are read twice, once to count the rows of each split; no row is moved, and the numbers do not depend on
    how the files are split or dealt to tasks.
    """
    return row_number(located(rows)).drop(*PLACE)


def _checked(parsed: DataFrame, line: str, on_malformed: str) -> DataFrame:
    """Fail the job at a line without a label, or keep it with null fields."""
    if on_malformed not in ("error", "null"):
        raise ValueError(f"on_malformed={on_malformed!r}")
    if on_malformed == "null":
        return parsed
    message = F.concat(F.lit("malformed line: "), F.substring(F.col(line), 1, 80))
    return parsed.withColumn("y", F.when(F.col("y").isNull(), F.raise_error(message).cast("int")).otherwise(F.col("y")))


def read_sequences(spark: SparkSession, path: str, pathGlobFilter: str | None = None, on_malformed: str = "error") -> DataFrame:
    """Labelled sequences of a text folder: row_id, y, seq."""
    options = {"pathGlobFilter": pathGlobFilter} if pathGlobFilter else {}
    lines = with_row_id(spark.read.options(**options).text(path))
    return _checked(parse_sequences(lines), "value", on_malformed).select("row_id", "y", "seq")


def remap_label(label):
    """0/1 labels to -1/+1."""
    return (2 * label - 1).cast("int")


def parse_dense(lines: DataFrame, line: str = "value") -> DataFrame:
    """Add `y` and `features` to comma-separated lines: a 0/1 label, then numbers."""
    values = F.transform(F.split(line, ","), lambda s: F.trim(s).cast("double"))
    parsed = lines.withColumn("_v", values)
    return parsed.withColumns({
        "y": remap_label(F.get("_v", F.lit(0))),
        "features": F.slice("_v", F.lit(2), F.size("_v") - 1),
    }).drop("_v")


def read_dense_csv(spark: SparkSession, path: str, on_malformed: str = "error") -> DataFrame:
    """Header-less CSV: row_id, y, features."""
    lines = with_row_id(spark.read.text(path))
    return _checked(parse_dense(lines), "value", on_malformed).select("row_id", "y", "features")


def write_sequences(rows: DataFrame, path: str) -> None:
    """The text form `read_sequences` reads."""
    rows.select(F.format_string("(%d, u'%s')", "y", "seq").alias("value")).write.mode("overwrite").text(path)
