"""Reading the corpus tables and keeping intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alttree.sources.store import shared_folder


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table once below the shared folder and read it back.

    Several later steps then read the same rows, lineage starts anew, and a lost executor costs a read, not a
    recomputation. Unlike checkpoint() it computes its input only once.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path, compression=compression)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def forget(df: DataFrame) -> None:
    """Delete a table that keep() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(text: str | Column = "text") -> Column:
    """A text as bytes; null is empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")
