"""URL verdicts from suffix rules, and for what no rule fits from trust and distrust on the host graph.

A rule is a host suffix and a path prefix; of the rules that fit a url the longest wins (by the rule's text, then by the
text itself).  A host is a trusted seed where rules allow more than half of its pages, a blocked seed where they block more
than half.  Trust is a personalised PageRank from trusted seeds along links, distrust one from blocked seeds against them
(who links to blocked hosts is suspect).  Both are scaled by the number of seeds, so that a seed alone has 1 - damping.
A host is blocked where distrust exceeds trust by more than the threshold.

Links are counted once for each pair of different hosts.  What a host without out-links holds isn't passed on.  Rows
with a null or relative url have an empty host and path, fit no rule, and are allowed; null html has no links.  Repeated
rows each give a row.  All of it is DataFrame code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaloom.llm import common

#: (verdict, host suffix, path prefix)
Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?[a-z][a-z0-9+.-]*://([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_text(rule: Rule) -> str:
    return rule[1] + rule[2]


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; the rules are a short, given list."""
    found = F.lit(None)
    for verdict, suffix, prefix in sorted(rules, key=lambda r: (len(rule_text(r)), rule_text(r))):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix or "")
        found = F.when(fits, F.struct(F.lit(rule_text((verdict, suffix, prefix))).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """src, dst: one row for each pair of different hosts of which one links to the other."""
    links = pages.select(F.col(host).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), 1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return links.where((F.col("src") != F.col("dst")) & (F.col("src") != "")).distinct()


def pagerank(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """host, score from seeds (host) along edges (src, dst); the written table of each round bounds the lineage."""
    start = seeds.select("host", F.lit(1.0 - damping).alias("score"))
    degrees = edges.groupBy("src").agg(F.count("*").alias("degree"))
    shares = common.materialize(edges.join(degrees, "src").select("src", "dst", (F.lit(damping) / F.col("degree")).alias("share")))
    scores = start
    for _ in range(rounds if shares.limit(1).count() else 0):
        passed = shares.join(scores, shares["src"] == scores["host"]).select(F.col("dst").alias("host"), (F.col("share") * F.col("score")).alias("score"))
        scores = common.materialize(start.unionByName(passed).groupBy("host").agg(F.sum("score").alias("score")))
    return scores


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str = "html", page_id: str = "page_id",
          threshold: float = 0.05, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    read = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    parts = read.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = parts.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))
    by_host = ruled.groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("_fit.verdict") == "allow").alias("allowed"),
        F.count_if(F.col("_fit.verdict") == "block").alias("blocked"))
    hosts = common.materialize(by_host.where("host <> ''"))
    edges = common.materialize(host_edges(parts, "host", "html"))
    trust = pagerank(hosts.where("2 * allowed > n").select("host"), edges, damping, rounds)
    backward = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = pagerank(hosts.where("2 * blocked > n").select("host"), backward, damping, rounds)
    scored = hosts.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(
        distrust.withColumnRenamed("score", "distrust"), "host", "left").na.fill(0.0)
    scored = scored.withColumn("_bad", F.col("distrust") > F.col("trust") + threshold)
    out = ruled.drop("html").join(scored, "host", "left")
    by_graph = F.when(F.coalesce(F.col("_bad"), F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.verdict"), by_graph).alias("verdict"), "trust", "distrust")
