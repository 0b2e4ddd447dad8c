"""Dedupe, duplicate audits, data flow tables and connected components."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaloom.functions.numeric import safe_rate
from quotaloom.operators.scan import first_rows
from quotaloom.session import materialize


def dedupe_exact(df: DataFrame, keys: Sequence[str], case_id: str) -> DataFrame:
    """First record (by case id) of every key combination; missing key parts match each other."""
    return first_rows(df, list(keys), [F.col(case_id)])


def duplicate_audit(df: DataFrame, checks: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per key set: rows, duplicate groups, rows in them and rows beyond the first record."""
    parts = []
    for label, keys in checks.items():
        sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
        parts.append(sizes.agg(
            F.lit(label).alias("check"), F.lit("; ".join(keys)).alias("key_fields"), F.sum("n").alias("total_rows"),
            F.count_if(F.col("n") > 1).alias("duplicate_groups"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_duplicate_groups")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("rows_beyond_first_record", F.col("rows_in_duplicate_groups") - F.col("duplicate_groups"))


def data_flow(df: DataFrame, entity: str, subsets: Mapping[str, Column], total: str) -> DataFrame:
    """Mutually exclusive, exhaustive subsets with row and entity counts; anything else fails the job."""
    hits = F.lit(0)
    for cond in subsets.values():
        hits = hits + F.coalesce(cond, F.lit(False)).cast("int")
    name = F.when(hits != 1, F.raise_error(F.lit("data-flow subsets are not a partition of the table")))
    for label, cond in subsets.items():
        name = name.when(cond, label)
    rows = df.select(name.cast("string").alias("subset"), F.col(entity))
    pairs = rows.groupBy("subset", entity).agg(F.count("*").alias("n"))
    # subset and grand totals from the same (subset, entity) counts
    per = pairs.groupBy("subset").agg(F.sum("n").alias("n_rows"), F.count(entity).alias("n_entities"))
    whole = pairs.agg(F.lit(total).alias("subset"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                      F.count_distinct(entity).alias("n_entities"))
    return per.unionByName(whole)


def trigger_counts(df: DataFrame, entity: str, triggers: Sequence[str], total: str) -> DataFrame:
    """Overlapping trigger counts and the unique total."""
    hit = F.array(*[F.when(F.col(t), F.lit(t)) for t in triggers], F.lit(total))
    rows = df.select(F.col(entity), F.explode(F.array_compact(hit)).alias("trigger"))
    return rows.groupBy("trigger").agg(F.count("*").alias("n_rows"), F.count_distinct(entity).alias("n_entities"))


def common_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def only_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).subtract(right.select(key))


def latest_per_key(cache: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert without a table format: union and keep the newest version per key."""
    both = cache.unionByName(updates, allowMissingColumns=True)
    return first_rows(both, [key], [-F.col(version)])


def feature_manifest(df: DataFrame) -> DataFrame:
    """dtype, distinct values and missing fraction per column, in one pass.

    Distinct counts come from (column, value) pairs grouped across all columns, which
    is a single shuffle instead of one expansion per column.
    """
    entries = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(c).cast("string").alias("value"))
               for c, t in df.dtypes]
    long = df.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")
    counts = long.groupBy("column", "dtype", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("column", "dtype").agg(
        F.count("value").alias("n_unique"),
        safe_rate(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)), F.sum("n"))
        .alias("missing_fraction"))


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components as (node, component = smallest member).

    Alternating large-star and small-star steps: both re-attach neighbours to the
    smallest known label, and the number of rounds grows with the logarithm of the
    component size rather than its diameter.  A hub's neighbourhood is never
    collected; minima combine map-side and the edge set is written once per round.
    """
    pairs = edges.select(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b"))
    pairs = pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "node")
    links = materialize(pairs.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, now = None, _edge_digest(links)
    while now != before:
        links = materialize(_small_star(_large_star(links)))
        before, now = now, _edge_digest(links)
    labels = links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _edge_digest(links: DataFrame) -> tuple[int, int, int]:
    """Number of edges and two order-free digests of them: equal tables agree in all three."""
    pair = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.bit_xor(pair), F.sum(F.xxhash64("b", "a", F.lit(1)).cast("decimal(20,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Attach every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    larger = both.where(F.col("b") > F.col("a"))
    return larger.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Attach every smaller neighbour of a node, and the node, to its smallest neighbour."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(low, "a")
    moved = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def reference_components(rows: DataFrame, case_id: str, references: str, separator: str = ";") -> DataFrame:
    """Rows sharing any reference fall into one component, named by its smallest reference.

    Each row contributes edges from its first reference to the others (a star, not all pairs).
    """
    refs = rows.select(case_id, F.split(F.col(references), separator).alias("_refs"))
    anchored = refs.select(case_id, F.element_at("_refs", 1).alias("_anchor"), F.explode("_refs").alias("_ref"))
    found = components(anchored, "_anchor", "_ref")
    first = refs.select(case_id, F.element_at("_refs", 1).alias("node"))
    return first.join(found, "node", "left").select(case_id, F.col("component").alias("reference_number"))

