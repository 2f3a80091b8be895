"""Labelled rows, models and histories derived from the given tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alttree.operators.encode import ALPHABET
from alttree.operators.sampling import HASH_ADD, HASH_MIX, HASH_MOD, HASH_MUL, HASH_SEED, SPLIT_SEED, TRAIN_PORTION
from alttree.operators.state import rebuild_state
from alttree.schema import Node


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def R(x: str) -> str:
    """Rounding in SQL; adding 0.0 turns -0.0 into 0.0."""
    return f"(round({x}, 6) + 0.0)"


def r4(c: Column | str) -> Column:
    """For sums over many rows, whose last digits depend on the order of addition."""
    return F.round(c, 4)


def R4(x: str) -> str:
    return f"(round({x}, 4) + 0.0)"


def hash_sql(key: str, copy: str | int = 1, seed: int = 0) -> str:
    """The row hash of sampling and splits."""
    h = f"(({key}) % {HASH_MOD} * {HASH_MUL} + CAST({copy} AS BIGINT) % {HASH_MOD} * {HASH_ADD} + {seed % HASH_MOD * HASH_SEED % HASH_MOD}) % {HASH_MOD}"
    for shift, factor in HASH_MIX:
        h = f"(xor({h}, ({h}) >> {shift}) * {factor}) % {HASH_MOD}"
    return f"({h})"


def train_sql(key: str = "row_id", copy: str | int = 1, seed: int = 0) -> str:
    return f"({hash_sql(key, copy, seed + SPLIT_SEED)} < {round(TRAIN_PORTION * HASH_MOD)})"


# Rows from events: positive = purchase

FEATURES = 5


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    values = [
        F.col("value"), F.hour("ts"), F.minute("ts"), F.get_json_object("props", "$.k"), F.col("user_id") % 10,
    ]
    return e.select(
        F.col("event_id").alias("row_id"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("y"),
        F.array(*[v.cast("double") for v in values]).alias("features"),
    )


EVT = """evt AS (
  SELECT event_id AS row_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS y,
         value AS f0, CAST(hour(ts) AS DOUBLE) AS f1, CAST(minute(ts) AS DOUBLE) AS f2,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS f3, CAST(user_id % 10 AS DOUBLE) AS f4
  FROM events)"""

LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT row_id, y, {k} AS feature, f{k} AS value FROM evt" for k in range(FEATURES)) + ")"


# A fixed small model over these rows

MODEL = [
    Node(0, -1, 0, -1, 0.0, True, -0.69),
    Node(1, 0, 1, 0, 20.0, True, 0.25),
    Node(2, 0, 1, 3, 49.5, False, -0.4),
    Node(3, 1, 2, 1, 11.5, True, 0.3),
    Node(4, 1, 2, 4, 4.5, False, -0.2),
    Node(5, 3, 3, 3, 80.5, True, 0.15),
    Node(6, 2, 2, 0, 60.0, False, 0.1),
]

MODEL_TABLE = "model(node_id, parent_id, depth, feature, threshold, split_eval, pred) AS (VALUES " + ", ".join(
    f"({n.node_id}, {n.parent_id}, {n.depth}, {n.feature}, CAST({n.threshold} AS DOUBLE), {str(n.split_eval).upper()}, CAST({n.pred} AS DOUBLE))"
    for n in MODEL) + ")"


def _fires(n: Node) -> str:
    if n.parent_id < 0:
        return "TRUE"
    test = f"(f{n.feature} - {n.threshold} <= 1e-8)"
    return f"(m{n.parent_id} AND {test if n.split_eval else 'NOT ' + test})"


def _fired(source: str) -> str:
    """Nested selects, because a node's column needs its parent's."""
    sql = source
    for n in MODEL:
        sql = f"(SELECT *, {_fires(n)} AS m{n.node_id} FROM {sql})"
    return sql


def score_sql(upto: int = len(MODEL), first: int = 0) -> str:
    terms = [f"CASE WHEN m{n.node_id} THEN {n.pred} ELSE 0 END" for n in MODEL if first <= n.node_id < upto]
    return "CAST(" + (" + ".join(terms) or "0") + " AS DOUBLE)"


FIRED = f"fired AS (SELECT * FROM {_fired('evt')})"
STATE = f"""{EVT}, {FIRED},
state AS (SELECT *, {score_sql()} AS score, exp(-y * {score_sql()}) AS w FROM fired)"""
MEMBER = "member AS (" + " UNION ALL ".join(
    f"SELECT row_id, y, w, f0, f1, f2, f3, f4, {n.node_id} AS node_id FROM state WHERE m{n.node_id}" for n in MODEL) + ")"


def evt_state(spark: SparkSession, sf_dir: str, max_depth: int | None = None) -> DataFrame:
    return rebuild_state(evt(spark, sf_dir), MODEL, max_depth=max_depth)


# Letter sequences from documents: positive = English


def documents_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("row_id"), F.when(F.col("lang") == "en", 1).otherwise(-1).alias("y"),
        F.regexp_replace(F.upper("text"), f"[^{ALPHABET}]", "").alias("seq"))


LETTERS = """letters AS (
  SELECT doc_id AS row_id, CASE WHEN lang = 'en' THEN 1 ELSE -1 END AS y,
         regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents),
seqs AS (SELECT *, substr(seq, 1, 59) || substr(seq, 62, 80) AS win FROM letters)"""

SINGLE = """single AS (
  SELECT row_id, y, CAST(i * 4 + instr('ACGT', substr(win, i + 1, 1)) - 1 AS INTEGER) AS feature
  FROM seqs, (SELECT CAST(range AS INTEGER) AS i FROM range(139)) WHERE i < length(win))"""
PAIR = """pair AS (
  SELECT row_id, y, CAST(556 + i * 16 + 4 * (instr('ACGT', substr(win, i + 1, 1)) - 1)
                         + instr('ACGT', substr(win, i + 2, 1)) - 1 AS INTEGER) AS feature
  FROM seqs, (SELECT CAST(range AS INTEGER) AS i FROM range(138)) WHERE i + 1 < length(win))"""


# A large tree from events: node = event, eight children each

LEVEL_STARTS = [(8**k - 1) // 7 for k in range(1, 16)]


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    node = F.col("event_id")
    root = node == 0
    depth = sum((F.when(node >= s, 1).otherwise(0) for s in LEVEL_STARTS), F.lit(0))
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        node.cast("int").alias("node_id"),
        F.when(root, -1).otherwise(F.floor((node - 1) / 8)).cast("int").alias("parent_id"),
        depth.cast("int").alias("depth"),
        F.when(root, -1).otherwise((F.col("user_id") * 7 + F.hour("ts")) % 556).cast("int").alias("feature"),
        F.when(root, 0.0).when(k % 5 == 0, 1.5).otherwise(0.5).alias("threshold"),
        (root | (F.floor("value") % 2 == 0)).alias("split_eval"),
        ((k - 49.5) / 100).cast("double").alias("pred"),
    )


TREE = f"""ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
nodes AS (
  SELECT CAST(event_id AS INTEGER) AS node_id,
         CAST(CASE WHEN event_id = 0 THEN -1 ELSE (event_id - 1) // 8 END AS INTEGER) AS parent_id,
         CAST({' + '.join(f'CASE WHEN event_id >= {s} THEN 1 ELSE 0 END' for s in LEVEL_STARTS)} AS INTEGER) AS depth,
         CAST(CASE WHEN event_id = 0 THEN -1 ELSE (user_id * 7 + hour(ts)) % 556 END AS INTEGER) AS feature,
         CAST(CASE WHEN event_id = 0 THEN 0.0 WHEN k % 5 = 0 THEN 1.5 ELSE 0.5 END AS DOUBLE) AS threshold,
         (event_id = 0 OR CAST(floor(value) AS BIGINT) % 2 = 0) AS split_eval,
         CAST((k - 49.5) / 100 AS DOUBLE) AS pred
  FROM ev)"""
NAMES = """names AS (
  SELECT CAST(range AS INTEGER) AS feature, CAST(range // 4 AS INTEGER) AS pos,
         substr('ACGT', CAST(range % 4 AS INTEGER) + 1, 1) AS token,
         CAST(range // 4 AS VARCHAR) || substr('ACGT', CAST(range % 4 AS INTEGER) + 1, 1) AS name
  FROM range(556))"""


# Training histories from events: a few long runs


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    event = F.when(F.col("k") == 7, "deepen").when(F.col("k") == 77, "rollback")
    return e.select(
        F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id") % 7).cast("int").alias("run"),
        F.col("event_id").alias("iteration"),
        (F.col("value") + 1).alias("train_avg"), (F.col("value") + F.minute("ts")).alias("test_avg"),
        F.when(F.col("k") >= 50, float("nan")).otherwise(F.col("k") / 100).alias("ref_auprc"),
        event.alias("event"), F.col("event_id").alias("n_before"), (F.col("event_id") - F.hour("ts")).alias("n_after"))


HIST = """ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
hist AS (
  SELECT CAST(CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 7 END AS INTEGER) AS run, event_id AS iteration,
         value + 1 AS train_avg, value + minute(ts) AS test_avg,
         CASE WHEN k >= 50 THEN CAST('NaN' AS DOUBLE) ELSE CAST(k AS DOUBLE) / 100 END AS ref_auprc,
         CASE WHEN k = 7 THEN 'deepen' WHEN k = 77 THEN 'rollback' END AS event,
         event_id AS n_before, event_id - hour(ts) AS n_after
  FROM ev),
seg AS (SELECT *, coalesce(sum(CASE WHEN event IS NOT NULL THEN 1 ELSE 0 END)
               OVER (PARTITION BY run ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment
        FROM hist)"""

