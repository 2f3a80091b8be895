"""Scalar helpers, sources and encodings."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from alttree.functions import exprs
from alttree.functions.arrays import constant
from alttree.operators import encode as enc
from alttree.operators.metrics import class_counts as count_classes
from alttree.operators.sampling import train_flag
from alttree.sources import rows as src
from alttree.sources.store import settle, shared_folder
from registry import query
from registry.fixtures import EVT, LETTERS, LONG, MODEL, MODEL_TABLE, PAIR, SINGLE, R, documents_letters, evt, r6, table, train_sql


@query("""SELECT l_linenumber, cmp, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT l_linenumber, CASE WHEN a - b < -1e-8 THEN -1 WHEN a - b > 1e-8 THEN 1 ELSE 0 END AS cmp
  FROM (SELECT l_linenumber, l_discount AS a, l_tax + (l_linenumber - 4) * 4e-9 AS b FROM lineitem))
GROUP BY 1, 2""")
def tolerant_compare(spark, sf):
    li = table(spark, sf, "lineitem")
    b = F.col("l_tax") + (F.col("l_linenumber") - 4) * 4e-9
    return li.groupBy("l_linenumber", exprs.compare(F.col("l_discount"), b).alias("cmp")).agg(F.count("*").alias("n"))


@query(f"""WITH {EVT}, {LONG}, {MODEL_TABLE}
SELECT node_id, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_pass,
       {R('sum(CASE WHEN ok THEN pred ELSE 0 END)')} AS sum_pred
FROM (SELECT m.node_id, m.pred, (m.feature < 0 OR (value - threshold <= 1e-8) = split_eval) AS ok
      FROM long JOIN model m ON long.feature = greatest(m.feature, 0))
GROUP BY node_id""")
def split_check(spark, sf):
    model = constant([n._asdict() for n in MODEL],
                     "array<struct<node_id: int, feature: int, threshold: double, split_eval: boolean, pred: double>>")
    rows = evt(spark, sf).select("features", F.inline(model))
    value = F.get("features", F.greatest("feature", F.lit(0)))
    ok = exprs.check(value, F.col("feature"), F.col("threshold"), F.col("split_eval"))
    pred = exprs.node_prediction(value, F.col("feature"), F.col("threshold"), F.col("split_eval"), F.col("pred"))
    return rows.groupBy("node_id").agg(F.count_if(ok).alias("n_pass"), r6(F.sum(pred)).alias("sum_pred"))


_SUMS = """g AS (SELECT user_id, hour(ts) AS h,
  sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS a,
  sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS b,
  sum(CASE WHEN event_type IN ('purchase', 'error') THEN 0 ELSE value END) AS c
FROM events GROUP BY 1, 2)"""


def _sums(spark, sf):
    def part(cond):
        return F.sum(F.when(cond, F.col("value")).otherwise(0.0))

    kind = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id", F.hour("ts").cast("long").alias("h")).agg(
        part(kind == "purchase").alias("a"), part(kind == "error").alias("b"),
        part(~kind.isin("purchase", "error")).alias("c"))


@query(f"""WITH {_SUMS}
SELECT user_id, h, {R('''CASE WHEN abs(a) <= 1e-8 AND abs(b) <= 1e-8 THEN 0
  WHEN b = 0 THEN ln(10) ELSE ln(least(10, greatest(a / b, 0.1))) END''')} AS log_ratio FROM g""")
def safe_log_ratio(spark, sf):
    return _sums(spark, sf).select("user_id", "h", r6(exprs.safe_log_ratio(F.col("a"), F.col("b"))).alias("log_ratio"))


@query(f"""WITH {_SUMS}
SELECT user_id, h, {R('c / s + 2 * sqrt(greatest(a / s * (b / s), 0))')} AS z
FROM (SELECT *, nullif(a + b + c, 0) AS s FROM g)""")
def boost_loss(spark, sf):
    return _sums(spark, sf).select("user_id", "h", r6(exprs.boost_loss(F.col("c"), F.col("a"), F.col("b"))).alias("z"))


@query(f"""WITH {EVT}
SELECT CASE WHEN {train_sql()} THEN 'train' ELSE 'test' END AS dataset,
       CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (y > 0) AS BIGINT) AS n_pos,
       CAST(count(*) FILTER (y < 0) AS BIGINT) AS n_neg
FROM evt GROUP BY 1""")
def class_counts(spark, sf):
    part = F.when(train_flag(), "train").otherwise("test")
    return count_classes(evt(spark, sf).withColumn("dataset", part), ["dataset"])


@query(f"""WITH {LETTERS}, {SINGLE},
ones AS (SELECT row_id, count(*) AS n FROM single GROUP BY row_id)
SELECT y, md5(seq) AS seq_md5, CAST(coalesce(n, 0) AS INTEGER) AS n_ones, CAST(count(*) AS BIGINT) AS n_rows
FROM seqs LEFT JOIN ones USING (row_id) GROUP BY 1, 2, 3""")
def file_to_features(spark, sf):
    """Labelled lines written to a text folder, read back with ids of their own and encoded."""
    path = os.path.join(shared_folder(spark), f"lines-{uuid.uuid4().hex}")
    src.write_sequences(documents_letters(spark, sf), path)
    rows = src.read_sequences(spark, path)
    coded = enc.encode(rows.withColumn("seq_md5", F.md5("seq"))).dropDuplicates(["row_id"])
    return coded.groupBy("y", "seq_md5", F.size("nz").alias("n_ones")).agg(F.count("*").alias("n_rows"))


@query("""WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS id FROM events)
SELECT event_id, id AS text_small_splits, id AS text_large_splits, id AS csv_small_splits, id AS csv_large_splits FROM n""")
def file_row_ids(spark, sf):
    """Ids of keyless lines, text and CSV, read in splits of 32 kB and of 128 MB."""
    events = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label")).orderBy("event_id")
    folder = os.path.join(shared_folder(spark), f"keyless-{uuid.uuid4().hex}")
    events.select(F.format_string("(%d, u'%d')", "label", "event_id").alias("value")).write.text(f"{folder}/text")
    events.select(F.concat_ws(",", "label", "event_id").alias("value")).write.text(f"{folder}/csv")
    option, ids = "spark.sql.files.maxPartitionBytes", None
    before = spark.conf.get(option)
    for size, bytes_ in (("small", "32k"), ("large", "128m")):
        spark.conf.set(option, bytes_)
        try:
            text = src.read_sequences(spark, f"{folder}/text").select(F.col("seq").cast("long").alias("event_id"), F.col("row_id").alias(f"text_{size}_splits"))
            csv = src.read_dense_csv(spark, f"{folder}/csv").select(
                F.get("features", F.lit(0)).cast("long").alias("event_id"), F.col("row_id").alias(f"csv_{size}_splits"))
            # read while the option holds
            found = settle(text).join(settle(csv), "event_id")
        finally:
            spark.conf.set(option, before)
        ids = found if ids is None else ids.join(found, "event_id")
    return ids


@query("SELECT o_orderkey AS row_id, 2 * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END - 1 AS y FROM orders")
def label_remap(spark, sf):
    label = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), src.remap_label(label).alias("y"))


_LABEL = "CASE WHEN lang = 'en' THEN '1' WHEN lang = 'de' THEN 'x' ELSE '-1' END"


@query(f"""WITH lines AS (
  SELECT doc_id AS row_id, '(' || {_LABEL} || ', u''' || regexp_replace(upper(text), '[^ACGT]', '', 'g') || ''')' AS value
  FROM documents)
SELECT row_id, TRY_CAST(regexp_extract(value, '^\\((-?\\d+), u''(.*)''\\)$', 1) AS INTEGER) AS y,
       md5(regexp_extract(value, '^\\((-?\\d+), u''(.*)''\\)$', 2)) AS seq_md5
FROM lines""")
def parse_labelled_sequence(spark, sf):
    d = table(spark, sf, "documents")
    label = F.when(F.col("lang") == "en", "1").when(F.col("lang") == "de", "x").otherwise("-1")
    letters = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    lines = d.select(F.col("doc_id").alias("row_id"), F.format_string("(%s, u'%s')", label, letters).alias("value"))
    return src.parse_sequences(lines).select("row_id", "y", F.md5("seq").alias("seq_md5"))


@query("""SELECT o_orderkey AS row_id, 2 * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END - 1 AS y,
  o_totalprice AS f0, CAST(o_custkey AS DOUBLE) AS f1, CAST(2 AS INTEGER) AS n_features FROM orders""")
def csv_dense_rows(spark, sf):
    label = F.when(F.col("o_orderstatus") == "F", "1.0").otherwise("0.0")
    line = F.concat_ws(" , ", label, F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("string"))
    lines = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), line.alias("value"))
    return src.parse_dense(lines).select(
        "row_id", "y", F.get("features", F.lit(0)).alias("f0"), F.get("features", F.lit(1)).alias("f1"),
        F.size("features").alias("n_features"))


@query(f"WITH {LETTERS} SELECT row_id, y, win FROM seqs")
def window_extract(spark, sf):
    rows = documents_letters(spark, sf)
    return rows.select("row_id", "y", enc.window_extract(F.col("seq")).alias("win"))


@query("""WITH raw AS (SELECT doc_id AS row_id, translate(text, 'acgt', 'ACGT') AS seq FROM documents),
win AS (SELECT row_id, substr(seq, 1, 59) || substr(seq, 62, 80) AS win FROM raw)
SELECT row_id, length(translate(win, 'ACGT', '')) > 0 AS has_unknown,
       CAST(length(win) - length(translate(win, 'ACGT', '')) AS INTEGER) AS n_known
FROM win""")
def unknown_letters(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.translate("text", "acgt", "ACGT").alias("seq"))
    coded = enc.encode(rows.withColumn("raw", F.col("seq")), on_unknown="null")
    return coded.select(
        "row_id", enc.has_unknown(enc.window_extract(F.col("raw"))).alias("has_unknown"), F.size("nz").alias("n_known"))


@query(f"WITH {LETTERS}, {SINGLE} SELECT row_id, feature, CAST(1.0 AS DOUBLE) AS value FROM single")
def encode_p1(spark, sf):
    return enc.onehot_long(enc.encode(documents_letters(spark, sf))).drop("y")


@query(f"""WITH {LETTERS}, {SINGLE}, {PAIR}
SELECT row_id, feature, CAST(1.0 AS DOUBLE) AS value FROM single UNION ALL SELECT row_id, feature, 1.0 FROM pair""")
def encode_p2(spark, sf):
    return enc.onehot_long(enc.encode(documents_letters(spark, sf), pairs=True)).drop("y")


@query(f"""WITH {LETTERS}, {SINGLE}, {PAIR},
used AS (SELECT feature, count(*) AS n, sum(y) AS sy FROM (SELECT * FROM single UNION ALL SELECT * FROM pair) GROUP BY feature),
dict AS (
  SELECT CAST(range AS INTEGER) AS feature, CAST(range // 4 AS INTEGER) AS pos,
         substr('ACGT', CAST(range % 4 AS INTEGER) + 1, 1) AS token FROM range(556)
  UNION ALL
  SELECT CAST(556 + range AS INTEGER), CAST(range // 16 AS INTEGER),
         substr('ACGT', CAST(range // 4 % 4 AS INTEGER) + 1, 1) || substr('ACGT', CAST(range % 4 AS INTEGER) + 1, 1) FROM range(2208))
SELECT d.feature, CAST(pos AS VARCHAR) || token AS name, pos, token,
       CAST(coalesce(n, 0) AS BIGINT) AS n_rows, CAST(coalesce(sy, 0) AS BIGINT) AS sum_y
FROM dict d LEFT JOIN used USING (feature)""")
def feature_dictionary(spark, sf):
    """Every feature of the dictionary with how many rows have it."""
    coded = enc.encode(documents_letters(spark, sf), pairs=True)
    used = enc.onehot_long(coded).groupBy("feature").agg(
        F.count("*").alias("n_rows"), F.sum("y").alias("sum_y"))
    return enc.feature_dictionary(spark, pairs=True).join(used, "feature", "left").fillna(0, ["n_rows", "sum_y"])
