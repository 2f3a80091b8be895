"""Model analysis: slices, rule texts, node texts and per-position contributions.

Everything here works on a `nodes` DataFrame, so a table of many or large models is
handled the same way as one small model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alttree.sources.store import settle


def model_slice(nodes: DataFrame, n: int) -> DataFrame:
    """The first n nodes. Children are derived from parents, so none can dangle."""
    return nodes.where(F.col("node_id") < n)


def child_counts(nodes: DataFrame) -> DataFrame:
    """Nodes with their number of children."""
    counts = nodes.groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_children"))
    return nodes.join(counts, "node_id", "left").fillna(0, ["n_children"])


def with_parent(nodes: DataFrame) -> DataFrame:
    """Every node beside its parent's test and depth."""
    parent = nodes.select(
        F.col("node_id").alias("parent_id"), F.col("depth").alias("parent_depth"), F.col("feature").alias("parent_feature"))
    return nodes.join(parent, "parent_id", "left")


def ancestors(nodes: DataFrame, root: bool = True) -> DataFrame:
    """(node_id, ancestor, step) for every node: itself at step 0, then up to the root, or without `root` to the node below it.

    Pointer doubling: each round, a path that lacks more than the root is continued by the path of the node above its
    end, so paths of depth d take log d joins. The other paths are left out of the joins, and the root alone is put
    on without one, so it is no join key.
    """
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    paths = nodes.select("node_id", F.array("node_id").alias("path"), F.col("parent_id").alias("above"), F.col("depth").alias("left"))
    for _ in range(max(depth - 1, 0).bit_length()):
        upper = paths.select(F.col("node_id").alias("above"), F.col("path").alias("more"), F.col("above").alias("next"))
        longer = paths.where("left > 1").join(upper, "above").select(
            "node_id", F.concat("path", "more").alias("path"), F.col("next").alias("above"), (F.col("left") - F.size("more")).alias("left"))
        paths = settle(longer.unionByName(paths.where("left <= 1")))
    whole = F.when(F.col("left") == 1, F.concat("path", F.array("above"))).otherwise(F.col("path")) if root else F.col("path")
    return paths.select("node_id", F.posexplode(whole).alias("step", "ancestor"))


def is_term() -> Column:
    """"is" when the test holds for a feature that is present, else "isnot"."""
    return F.when((F.lit(1.0) <= F.col("threshold")) == F.col("split_eval"), "is").otherwise("isnot")


def rule_terms(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """One record per test on a node's path: node_id, step (0 = own test), term, feature.

    The root has no test, so it is left out of the join, where every path would meet in its key.
    """
    named = nodes.where("feature >= 0").join(names.select("feature", "name"), "feature")
    terms = named.select(F.col("node_id").alias("ancestor"), "feature", F.concat_ws(" ", is_term(), "name").alias("term"))
    return ancestors(nodes, root=False).join(terms, "ancestor").select("node_id", "step", "term", "feature")


def first_terms(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """node_id and the code of its rule's first term: twice the feature, and one more for "is".

    This is the highest named test on the path. Pointer doubling as in `ancestors`, but a path carries this term alone:
    a row has a fixed size, there is one per node, and no join has a key that the paths of many levels share.
    """
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    known = names.select("feature").distinct().withColumn("known", F.lit(True))
    code = F.when(F.col("known") & (F.col("feature") >= 0), 2 * F.col("feature") + F.when(is_term() == "is", 1).otherwise(0))
    paths = nodes.join(known, "feature", "left").select(
        "node_id", F.col("parent_id").alias("above"), F.col("depth").alias("left"), code.alias("code")).distinct()
    paths = paths.withColumn("size", F.lit(1)).withColumn("step", F.when(F.col("code").isNotNull(), 0))
    for _ in range(max(depth - 1, 0).bit_length()):
        upper = paths.select(
            F.col("node_id").alias("above"), F.col("above").alias("next"), F.col("size").alias("more"), F.col("step").alias("high"), F.col("code").alias("top"))
        longer = paths.where("left > 1").join(upper, "above").select(
            "node_id", F.col("next").alias("above"), (F.col("left") - F.col("more")).alias("left"), F.coalesce("top", "code").alias("code"),
            (F.col("size") + F.col("more")).alias("size"), F.coalesce(F.col("size") + F.col("high"), "step").alias("step"))
        paths = settle(longer.unionByName(paths.where("left <= 1")))
    # one number, so that Spark needs no sort to find the largest; a node_id may be repeated
    best = F.max(F.col("step").cast("long") * 2**32 + F.col("code"))
    return paths.where("code is not null").groupBy("node_id").agg(F.pmod(best, F.lit(2**32)).cast("int").alias("code"))


def describe(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Every node with its rule from the root down; the root's rule is empty.

    A path has at most as many terms as the tree is deep, so the list per node is short.
    """
    terms = rule_terms(nodes, names).groupBy("node_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("step")).alias("k"), "term"))).alias("terms"))
    rules = terms.select("node_id", F.array_join(F.transform("terms", lambda t: t["term"]), " and ").alias("rule"))
    return nodes.join(rules, "node_id", "left").select(
        "node_id", "depth", "pred", F.coalesce("rule", F.lit("")).alias("rule"))


def by_abs_pred(described: DataFrame) -> DataFrame:
    return described.orderBy(F.abs("pred").desc(), "node_id")


def write_description(described: DataFrame, path: str) -> None:
    """Comma-separated index, depth, prediction and rule, strongest first."""
    line = F.concat_ws(", ", F.col("node_id").cast("string"), F.col("depth").cast("string"), F.col("pred").cast("string"), "rule")
    by_abs_pred(described).select(line.alias("value")).write.mode("overwrite").text(path)


def render(nodes: DataFrame, digits: int = 6) -> DataFrame:
    """One line of text per node."""
    counted = child_counts(nodes)

    def number(c: str) -> Column:
        return F.format_string(f"%.{digits}f", c)

    side = F.when(F.col("split_eval"), " at most ").otherwise(" above ")
    test = F.when(F.col("feature") < 0, "every row").otherwise(F.concat(
        F.lit("feature "), F.col("feature").cast("string"), side, number("threshold")))
    under = F.when(F.col("parent_id") >= 0, F.concat(F.lit(" below "), F.col("parent_id").cast("string"))).otherwise("")
    text = F.concat(
        F.lit("#"), F.col("node_id").cast("string"), under, F.lit(": "), test, F.lit(" adds "), number("pred"),
        F.lit("; splits further: "), F.col("n_children").cast("string"))
    return counted.select("node_id", text.alias("text"))


def position_contribution(nodes: DataFrame, names: DataFrame, left: int | None = None, right: int | None = None) -> DataFrame:
    """Summed |prediction| by sign, position, token and is/isnot of each rule's first term.

    Values are divided by the largest position total of their sign. Every position from 0
    (or `left`) to the last one used (or `right`) is present for single-letter tokens,
    with 0 where nothing fell. Rules without a term (the root) are left out.
    """
    sign = F.when(F.col("pred") < 0, "neg").otherwise("pos")
    each = nodes.select("node_id", "pred").join(first_terms(nodes, names), "node_id").groupBy(sign.alias("sign"), "code").agg(F.sum(F.abs("pred")).alias("part"))
    kind = F.when(F.col("code") % 2 == 1, "is").otherwise("isnot")
    parts = each.select("sign", F.floor(F.col("code") / 2).cast("int").alias("feature"), kind.alias("kind"), "part").join(
        names.select("feature", "pos", F.substring("token", -1, 1).alias("token")), "feature")
    if left is not None and right is not None:
        parts = parts.where(F.col("pos").between(left, right))
    sums = parts.groupBy("sign", "pos", "token", "kind").agg(F.sum("part").alias("part"))
    totals = sums.groupBy("sign", "pos").agg(F.sum("part").alias("total")).groupBy("sign").agg(
        F.max("total").alias("top"), F.max("pos").alias("last_pos"))
    bounds = totals.select("sign", "top", F.explode(F.sequence(
        F.lit(0 if left is None else left), F.col("last_pos") if right is None else F.lit(right))).alias("pos"))
    tokens = F.array(*[F.lit(c) for c in "ACGT"])
    grid = bounds.select("sign", "top", "pos", F.explode(tokens).alias("token")).select(
        "sign", "top", "pos", "token", F.explode(F.array(F.lit("is"), F.lit("isnot"))).alias("kind"))
    return grid.join(sums, ["sign", "pos", "token", "kind"], "left").select(
        "sign", "pos", "token", "kind", (F.coalesce("part", F.lit(0.0)) / F.col("top")).alias("score"))


def signed_contribution(contribution: DataFrame) -> DataFrame:
    """Positive and negated negative contributions in one table."""
    pos = contribution.where("sign = 'pos'").select("pos", "token", "kind", "score")
    neg = contribution.where("sign = 'neg'").select("pos", "token", "kind", (-F.col("score")).alias("score"))
    return pos.unionByName(neg)
