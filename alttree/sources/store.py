"""Tables the engine keeps: samples, models, snapshots, training history."""

from __future__ import annotations

import json
import logging
import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alttree.schema import HISTORY, NODES, PR_POINTS, Node, collect_nodes, nodes_df

log = logging.getLogger(__name__)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares for checkpoints; a local one only where none is set and everything runs here."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or context.getCheckpointDir()
    here = context.master == "local" or context.master.startswith("local[")
    if not folder and not here:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = folder or tempfile.mkdtemp(prefix="alttree-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Compute a table once and keep it in the shared folder, for use by several later steps.

    Lost executors do not cost a recomputation, and the lineage starts anew.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def settle_files(df: DataFrame, name: str = "rows") -> DataFrame:
    """Write a table once into the shared folder and read the files, which keep their rows and order."""
    path = os.path.join(shared_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_nodes(nodes: DataFrame, path: str) -> None:
    """Write a table of nodes; an earlier model at the path is replaced."""
    nodes.select(*NODES.names).write.mode("overwrite").parquet(path)


def load_nodes(spark: SparkSession, path: str, length: int = 0) -> DataFrame:
    """A saved table of nodes, cut to its first `length` nodes if given."""
    saved = spark.read.schema(NODES).parquet(path)
    return saved.where(F.col("node_id") < length) if length > 0 else saved


def save_model(spark: SparkSession, nodes: list[Node], path: str) -> None:
    save_nodes(nodes_df(spark, nodes).coalesce(1), path)


def load_model(spark: SparkSession, path: str, length: int = 0) -> list[Node]:
    return collect_nodes(load_nodes(spark, path, length))


def snapshot_path(folder: str, iteration: int) -> str:
    return os.path.join(folder, f"model-{iteration:08d}")


def save_snapshot(spark: SparkSession, nodes: list[Node], folder: str, iteration: int) -> str:
    path = snapshot_path(folder, iteration)
    save_model(spark, nodes, path)
    return path


def save_sample(sample: DataFrame, path: str, required: bool = False) -> bool:
    """Write a drawn sample partitioned into train and test; a failure is logged unless required."""
    try:
        sample.write.mode("overwrite").partitionBy("is_train").parquet(path)
    except Exception:
        if required:
            raise
        log.exception("could not save the sample to %s", path)
        return False
    return True


def load_sample(spark: SparkSession, path: str) -> DataFrame:
    saved = spark.read.parquet(path)
    return saved.withColumn("is_train", F.col("is_train").cast("boolean"))


def save_staged(staged: DataFrame, path: str) -> None:
    """Keep scores or metrics of every model prefix, as `staged_scores` and `staged_metrics` give them."""
    staged.write.mode("overwrite").parquet(path)


def history_df(spark: SparkSession, records: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(f) for f in HISTORY.names) for r in records], HISTORY)


def replace_parts(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write a table partitioned by `keys`; partitions that the rows belong to are replaced, others stay."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*keys).parquet(path)


def save_history(spark: SparkSession, records: list[dict], path: str, first: bool = True) -> None:
    """Write a run's records, or those of its next batches; the first ones replace what an earlier run left at the path.

    A batch that is written again is replaced.
    """
    rows = history_df(spark, records).coalesce(1)
    if first:
        rows.write.mode("overwrite").partitionBy("batch").parquet(path)
    else:
        replace_parts(rows, path, ["batch"])


def load_history(spark: SparkSession, path: str, last_batch: int | None = None) -> list[dict]:
    """A run's records in order, up to a batch if given."""
    rows = spark.read.schema(HISTORY).parquet(path)
    rows = rows if last_batch is None else rows.where(F.col("batch") <= last_batch)
    found = [r.asDict() for r in rows.collect()]
    # a restart writes iteration 0 behind the admissions of its batch
    return sorted(found, key=lambda r: (r["batch"], r["iteration"] == 0, r["iteration"]))


PR_KEYS = ["dataset", "batch", "iteration"]


def save_pr_points(points: DataFrame, path: str, batch: int = 0) -> None:
    """Keep the points of curves; the same curve written again replaces its points."""
    replace_parts(points.select(*PR_POINTS.names).withColumn("batch", F.lit(batch)), path, PR_KEYS)


def clear_pr_points(spark: SparkSession, path: str) -> None:
    """Leave no curve of an earlier run at the path."""
    none = spark.createDataFrame([], PR_POINTS).withColumn("batch", F.lit(0))
    none.write.mode("overwrite").partitionBy(*PR_KEYS).parquet(path)


PROGRESS = "batch int, progress string"


def save_progress(spark: SparkSession, batch: int, progress: dict, path: str, first: bool = False) -> None:
    """What a run needs to go on after a batch. The job's commit makes the record appear as a whole or not at all."""
    row = spark.createDataFrame([(batch, json.dumps(progress))], PROGRESS).coalesce(1)
    if first:
        row.write.mode("overwrite").partitionBy("batch").parquet(path)
    else:
        replace_parts(row, path, ["batch"])


def load_progress(spark: SparkSession, path: str) -> dict | None:
    """The last batch's record, or None if no run has left one."""
    try:
        found = spark.read.schema(PROGRESS).parquet(path).orderBy(F.desc("batch")).first()
    except AnalysisException:
        return None
    return json.loads(found["progress"]) if found else None
