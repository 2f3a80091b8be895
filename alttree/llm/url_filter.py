"""URL filter: host rules, and for urls that no rule fits the reputation of their host.

The reputation is an empirical-Bayes estimate of the share of bad pages. Labelled outcomes are summed per host,
registered domain and public suffix; each level's beta prior is the posterior mean of the level above with a strength
fitted by moments over the whole table, so a host with few labels is judged by its domain and a domain with few by its
suffix. A host is blocked when the lower posterior bound of its bad share exceeds `max_bad`.

A null url or one without `://` has an empty host and path and is judged as the host ''. Labels that are null don't
count; repeated labels of a page each count; pages stay as they are, repeated rows too. Without any label everything
that no rule blocks is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alttree.llm.tables import read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Reputation:
    """`bound` standard deviations below the posterior mean must exceed `max_bad` to block. `rho`: limits of the fitted
    correlation of pages that share a parent; a prior weighs 1 / rho - 1 labels."""

    max_bad: float = 0.5
    bound: float = 1.645
    rho: tuple[float, float] = (0.01, 0.5)
    long_suffixes: tuple[str, ...] = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    name, _, rest = rule.partition("/")
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")


def domains(host: Column, p: Reputation) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host without user and port."""
    name = F.regexp_extract(host, "^(?:.*@)?([^:]*)", 1)
    last2, last3 = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    long = last2.isin(*p.long_suffixes)
    return F.when(long, last3).otherwise(last2), F.when(long, last2).otherwise(F.substring_index(name, ".", -1))


def _strength(level: DataFrame, p: Reputation) -> DataFrame:
    """One row: how many labels the parent's mean weighs, from the spread of a level's groups (n, k, mean) round it."""
    var = F.col("mean") * (1 - F.col("mean"))
    off = F.col("k") - F.col("n") * F.col("mean")
    sums = level.where((F.col("n") > 0) & (var > 0)).agg(
        F.sum(off * off / (F.col("n") * var)).alias("chi"), F.count("*").alias("groups"), F.sum("n").alias("labels"))
    rho = F.when(F.col("labels") > F.col("groups"), (F.col("chi") - F.col("groups")) / (F.col("labels") - F.col("groups")))
    rho = F.greatest(F.lit(p.rho[0]), F.least(F.lit(p.rho[1]), F.coalesce(rho, F.lit(p.rho[0]))))
    return sums.select((1 / rho - 1).alias("strength"))


def reputations(pages: DataFrame, labels: DataFrame, p: Reputation = Reputation()) -> DataFrame:
    """(host, labelled, bad_share, bad_low) of every host. pages: page_id, host; labels: page_id, bad."""
    hosts = pages.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"))
    seen = pages.join(labels.where(F.col("bad").isNotNull()), "page_id").groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    domain, suffix = domains(F.col("host"), p)
    host = hosts.unionByName(seen).groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select(
        "host", domain.alias("domain"), suffix.alias("suffix"), "n", "k")
    by_domain = host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = by_suffix.agg(F.coalesce(F.sum("k") / F.sum("n"), F.lit(0.0)).alias("mean"))

    def shrunk(level: DataFrame, name: str, *more: str) -> DataFrame:
        """The level's posterior means, as its children's prior. The joined strength is one row."""
        post = (F.col("k") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
        return level.crossJoin(F.broadcast(_strength(level, p))).select(name, *more, post.alias("mean"))

    suffixes = shrunk(by_suffix.crossJoin(F.broadcast(overall)), "suffix")
    of_domain = shrunk(by_domain.join(suffixes, "suffix"), "domain", "suffix")
    level = host.join(of_domain, ["domain", "suffix"])
    a = F.col("k") + F.col("mean") * F.col("strength")
    total = F.col("n") + F.col("strength")
    share = a / total
    low = share - p.bound * F.sqrt(share * (1 - share) / (total + 1))
    return level.crossJoin(F.broadcast(_strength(level, p))).select(
        "host", F.col("n").alias("labelled"), share.alias("bad_share"), low.alias("bad_low"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], p: Reputation = Reputation()) -> DataFrame:
    """page_id, host, path, rule, verdict, labelled, bad_share of every page."""
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        fits = rule_fits(text, F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    method = F.when(F.col("bad_low") > p.max_bad, "block").otherwise("allow")
    return parsed.join(reputations(parsed, labels, p), "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "labelled",
        F.round("bad_share", 9).alias("bad_share"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the quality label with the page's number; 0 is bad."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return judge(read(spark, sf_dir, "pages"), labels, RULES)


def _fits(rule: str) -> str:
    name, _, rest = rule.partition("/")
    return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')"


def _case(pick: int) -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    return "CASE " + " ".join(f"WHEN {_fits(r[1])} THEN '{r[pick]}'" for r in ordered) + " END"


def _sql(p: Reputation = Reputation()) -> str:
    strength = f"""SELECT 1.0::DOUBLE / greatest({p.rho[0]}::DOUBLE, least({p.rho[1]}::DOUBLE, coalesce(
        CASE WHEN sum(n) > count(*) THEN (sum((k - n * mean) * (k - n * mean) / (n * mean * (1 - mean))) - count(*)) / (sum(n) - count(*)) END,
        {p.rho[0]}::DOUBLE))) - 1 AS strength"""
    longs = ", ".join(f"'{x}'" for x in p.long_suffixes)
    used = "WHERE n > 0 AND mean * (1 - mean) > 0"
    return f"""
WITH page AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
seen AS (SELECT host, count(*) AS n, sum(CAST(quality = 0 AS INT)) AS k FROM page JOIN labels ON doc_id = page_id
         WHERE quality IS NOT NULL GROUP BY host),
named AS (SELECT host, string_split(regexp_extract(host, '^(?:.*@)?([^:]*)', 1), '.') AS parts FROM (SELECT DISTINCT host FROM page)),
tail AS (SELECT host, parts[-1] AS last1, array_to_string(parts[-2:], '.') AS last2, array_to_string(parts[-3:], '.') AS last3 FROM named),
h AS (SELECT host, CASE WHEN last2 IN ({longs}) THEN last3 ELSE last2 END AS domain,
             CASE WHEN last2 IN ({longs}) THEN last2 ELSE last1 END AS suffix,
             coalesce(n, 0)::DOUBLE AS n, coalesce(k, 0)::DOUBLE AS k FROM tail LEFT JOIN seen USING (host)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
s1 AS (SELECT *, (SELECT coalesce(sum(k) / nullif(sum(n), 0), 0) FROM s0) AS mean FROM s0),
s2 AS (SELECT suffix, (k + mean * strength) / (n + strength) AS mean FROM s1, ({strength} FROM s1 {used})),
d1 AS (SELECT d.*, mean FROM d JOIN s2 USING (suffix)),
d2 AS (SELECT domain, suffix, (k + mean * strength) / (n + strength) AS mean FROM d1, ({strength} FROM d1 {used})),
h1 AS (SELECT h.*, mean FROM h JOIN d2 USING (domain, suffix)),
h2 AS (SELECT host, n, n + strength AS total, (k + mean * strength) / (n + strength) AS share FROM h1, ({strength} FROM h1 {used})),
r AS (SELECT host, n, share, share - {p.bound}::DOUBLE * sqrt(share * (1 - share) / (total + 1)) AS low FROM h2)
SELECT page_id, host, path, {_case(1)} AS rule,
       coalesce({_case(0)}, CASE WHEN low > {p.max_bad}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(n AS BIGINT) AS labelled, round(share, 9) AS bad_share
FROM page JOIN r USING (host)"""


SQL = _sql()
