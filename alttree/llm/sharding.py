"""Sharding by a permutation-filled lookup table: constant-time placement that moves few keys when shards change.

Each shard prefers the slots of a prime-sized table in an order of its own (an offset and a step from its name). The
shards take turns; each turn claims the first slot in the shard's order that is still free, until none is. The table
is as large as its prime says, whatever the data, and is broadcast; a key's slot is its hash modulo the prime.

A null key is placed like the empty string. Repeated keys land together, which is the point; rows are never moved
apart, lost or doubled. Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alttree.llm.tables import read

SLOTS = 16381
MAX_SLOTS = 655373  # the broadcast table's bound


def lookup_table(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """Number of the shard that owns each slot. A shard of weight w takes w turns a round (1 if not given)."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not len(shards) <= slots <= MAX_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    at, step = [], []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        at.append(int.from_bytes(digest[:8], "big") % slots)
        step.append(int.from_bytes(digest[8:], "big") % (slots - 1) + 1)
    turns = [k for k, name in enumerate(shards) for _ in range((weights or {}).get(name, 1))]
    owner, free = [-1] * slots, slots
    while free:
        for k in turns[:]:
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def table_df(spark: SparkSession, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """(slot, shard): `slots` rows."""
    owners = ",".join(map(str, lookup_table(shards, slots, weights)))
    names = F.array(*map(F.lit, shards))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    return rows.select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """(key, slot, shard) of every row."""
    keyed = rows.select(key, slot_of(F.col(key), slots).alias("slot"))
    return keyed.join(F.broadcast(table_df(rows.sparkSession, shards, slots, weights)), "slot").select(key, "slot", "shard")


SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(read(spark, sf_dir, "documents"), "doc_id", SHARDS)


SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS} AS INT) AS slot FROM documents),
owners AS (SELECT string_split('{",".join(map(str, lookup_table(SHARDS)))}', ',') AS o)
SELECT doc_id, slot, 'shard-' || lpad(o[slot + 1], 3, '0') AS shard FROM d, owners"""
