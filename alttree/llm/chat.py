"""Chat formatting: reply trees to root-to-leaf conversations, one string and loss mask each, with DataFrame functions only.

A message names its parent. Self-joins double the reach of every message upwards, so that a path of n replies takes
log n rounds: first to sum the scores from root to leaf, then, for the `paths_per_tree` best branches of a tree (ties:
the smaller leaf id), to list the messages of the path. Each chosen path is formatted as one conversation.

A turn is written `[role]text</s>`. Inside roles and texts `~ [ ] <` become `~0 ~1 ~3 ~2`, so that control strings in a
text neither open nor close a turn and every string can be read back. The loss mask covers the escaped texts of the
assistant's turns, not their marks.

Null roles, texts and scores count as empty, empty and 0. A message whose parent is null or not in its tree is a root.
Messages that refer to one another in a circle, and replies to these, have no root and belong to no path. Ids must be unique in a tree;
the query numbers repeated turns one after the other. An empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alttree.llm.tables import keep, read

END = "</s>"
#: Escapes, in the order in which they are made.
ESCAPES = [("~", "~0"), ("[", "~1"), ("<", "~2"), ("]", "~3")]


def escape(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def jumps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables r = 0, 1, ... of (tree_id, node, up, score), the message 2^r replies above of those that have one and the
    score summed on the way; and (tree_id, node, score) of all messages under a root, scores summed from the root."""
    nodes = messages.select("tree_id", F.col("node_id").alias("node"), "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree_id").alias("t"), F.col("node").alias("up"))
    held = F.col("t").eqNullSafe(F.col("tree_id")) & (F.col("up") == F.col("parent_id"))
    step = keep(nodes.join(known, held, "left").select("tree_id", "node", "up", "score"), "jump")
    tables, rooted = [], None
    for _ in range(max(1, messages.count()).bit_length() + 1):
        ended, rest = step.where(F.col("up").isNull()), step.where(F.col("up").isNotNull())
        rooted = ended if rooted is None else rooted.unionByName(ended)
        if rest.isEmpty():
            break
        tables.append(rest)  # only messages that have not met their root yet go on
        above = rooted.unionByName(rest).select(F.col("tree_id").alias("t"), F.col("node").alias("n"), F.col("up").alias("next"), F.col("score").alias("more"))
        met = F.col("t").eqNullSafe(F.col("tree_id")) & (F.col("n") == F.col("up"))
        step = keep(rest.join(above, met).select("tree_id", "node", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score")), "jump")
    return tables, rooted.drop("up")


def best_paths(messages: DataFrame, paths_per_tree: int = 1) -> DataFrame:
    """(tree_id, rank, score, node, back) of each message of the best branches; back: replies from the path's end."""
    tables, rooted = jumps(messages)
    asked = messages.select(F.col("tree_id").alias("t"), F.col("parent_id").alias("p")).where(F.col("p").isNotNull())
    leaves = rooted.join(asked, F.col("t").eqNullSafe(F.col("tree_id")) & (F.col("p") == F.col("node")), "left_anti")
    order = Window.partitionBy("tree_id").orderBy(F.desc("score"), "node")
    best = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= paths_per_tree)
    reached = keep(best.select("tree_id", "rank", "score", "node", F.lit(0).cast("long").alias("back")), "reached")
    for r, table in enumerate(tables):  # each round doubles the known end of every path
        up = table.select(F.col("tree_id").alias("t"), F.col("node").alias("n"), "up").where(F.col("up").isNotNull())
        met = F.col("t").eqNullSafe(F.col("tree_id")) & (F.col("n") == F.col("node"))
        more = reached.join(up, met).select("tree_id", "rank", "score", F.col("up").alias("node"), (F.col("back") + 2**r).alias("back"))
        reached = keep(reached.unionByName(more), "reached")
    return reached


def format_paths(messages: DataFrame, chosen: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(tree_id, rank, score, formatted, mask): mask lists the start and length, in code points, of text to learn."""
    texts = messages.select(
        F.col("tree_id").alias("t"), F.col("node_id").alias("n"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    steps = chosen.withColumn("pos", -F.col("back"))
    turn = F.struct("pos", "role", F.concat(F.lit("["), escape(F.col("role")), F.lit("]")).alias("head"), escape(F.col("text")).alias("body"))
    told = steps.join(texts, F.col("t").eqNullSafe(F.col("tree_id")) & (F.col("n") == F.col("node"))).groupBy("tree_id", "rank").agg(
        F.first("score").alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    formatted = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(END))))
    none = F.array().cast("array<struct<start:int,length:int>>")

    def add(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t.head)
        span = F.array(F.struct(start.alias("start"), F.length(t.body).alias("length")))
        return F.struct(
            (start + F.length(t.body) + len(END)).alias("at"),
            F.when(t.role == trained_role, F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    mask = F.aggregate("turns", F.struct(F.lit(0).alias("at"), none.alias("mask")), add)["mask"]
    return told.select("tree_id", "rank", "score", formatted.alias("formatted"), mask.alias("mask"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.split(formatted, END)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.struct(
        unescape(F.substring_index(F.substr(x, F.lit(2)), "]", 1)).alias("role"),
        unescape(F.substr(x, F.locate("]", x) + 1)).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.concat_ws("", F.transform(mask, lambda s: unescape(F.substr(formatted, s.start + 1, s.length))))


def reply_chains(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as trees without branches; repeated turns follow one another."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order)
    rows = conversations.select("conv_id", "turn", "role", "text", node.alias("node_id"))
    return rows.select(
        F.col("conv_id").alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"),
        "role", "text", F.lit(0.0).alias("score"))


TRICK = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICK).alias("text"))
    messages = keep(reply_chains(table.unionByName(extra)), "messages")
    out = keep(format_paths(messages, best_paths(messages)), "formatted")  # written: else it is made anew for each mark
    loss = masked_text(F.col("formatted"), F.col("mask"))
    read_back = out.select("tree_id", "formatted", loss.alias("loss"), parse(F.col("formatted")).alias("turns"))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    return read_back.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def _escaped(column: str) -> str:
    for raw, code in ESCAPES:
        column = f"replace({column}, '{raw}', '{code}')"
    return column


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICK}' UNION ALL SELECT -7, 1, 'assistant', '{TRICK}'),
c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         CAST(sum(length({_escaped('role')}) + length({_escaped('text')}) + 2 + {len(END)}) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c"""
