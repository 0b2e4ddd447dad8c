"""Aggregations that build case panels, feature tables and catalogs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaloom.functions.numeric import safe_rate
from quotaloom.functions.text import blank_to_null
from quotaloom.operators.scan import first_rows, group_medians


def mode_per_group(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Smallest most frequent non-null value of every column per group.

    Counts per (group, column, value) combine map-side; only their maxima are then
    compared, so neither a hot group nor a long tail of values sits in one task.
    """
    keys = list(keys)
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_e"))
    counts = long.select(*keys, "_e.*").groupBy(*keys, "name", "value").agg(F.count("*").alias("n"))
    # a NULL value never wins but keeps an all-NULL group visible
    order = F.struct((-F.when(F.col("value").isNull(), F.lit(0)).otherwise(F.col("n"))).alias("n"),
                     F.coalesce(F.col("value"), F.lit("￿")).alias("v"), F.col("value").alias("value"))
    return counts.groupBy(*keys).agg(*[
        F.min(F.when(F.col("name") == c, order))["value"].alias(c) for c in columns])


def joined_unique(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], separator: str = "; ") -> DataFrame:
    """Sorted distinct trimmed non-empty values joined into one string per column.

    Distinct (group, column, value) triples come first: the collected list is exactly
    the output string, never the raw rows.
    """
    keys = list(keys)
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(out).alias("name"), blank_to_null(F.col(src)).alias("value")) for out, src in columns.items()
    ])).alias("_e")).select(*keys, "_e.*").distinct()
    return long.groupBy(*keys).agg(*[
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("name") == out, F.col("value")))), separator).alias(out)
        for out in columns])


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, cond, "left").drop(*[f"_r_{k}" for k in keys])


def case_panel(
    rows: DataFrame, keys: Sequence[str], value: str, medians: Mapping[str, str], modes: Sequence[str],
    joined: Mapping[str, str], document: str, flags: Sequence[str] = (),
) -> DataFrame:
    """One case per key: medians, extremes and spread of the value, modes, joined lists, any-flags."""
    keys = list(keys)
    base = group_medians(rows, keys, {value: value, **medians}, [
        F.count("*").alias("case_row_count"), F.min(value).alias(f"{value}_min"), F.max(value).alias(f"{value}_max"),
        *[F.bool_or(f).alias(f) for f in flags]])
    docs = rows.groupBy(*keys).agg(F.count_distinct(document).alias("document_count"))
    out = _null_safe_join(base, docs, keys)
    if modes:
        out = _null_safe_join(out, mode_per_group(rows, keys, modes), keys)
    if joined:
        out = _null_safe_join(out, joined_unique(rows, keys, joined), keys)
    return out.withColumn("case_spread", F.col(f"{value}_max") - F.col(f"{value}_min"))


def species_meta(df: DataFrame, keys: Sequence[str], modes: Sequence[str], medians: Sequence[str]) -> DataFrame:
    """Typical metadata per key: modes of the categories, medians of the conditions."""
    return _null_safe_join(group_medians(df, keys, {m: m for m in medians}), mode_per_group(df, keys, modes), keys)


def ordinal_pivot(df: DataFrame, key: str, mode: str, label: str, modes: Mapping[str, str],
                  scores: Mapping[str, float]) -> DataFrame:
    """Ordinal labels to scores, maximum per (id, mode), modes as columns."""
    def mapped(col: str, table: Mapping) -> Column:
        entries = [F.lit(v) for pair in table.items() for v in pair]
        return F.try_element_at(F.create_map(*entries), F.lower(F.trim(F.coalesce(F.col(col), F.lit("")))))
    rows = df.select(key, mapped(mode, modes).alias("_mode"), mapped(label, scores).alias("_score"))
    rows = rows.where(F.col(key).isNotNull() & F.col("_mode").isNotNull())
    return rows.groupBy(key).pivot("_mode", list(modes.values())).agg(F.max("_score"))


def ratio_table(df: DataFrame, key: str, numerator: str, denominator: str, ratio: str, order: Sequence[str]) -> DataFrame:
    """First row per id with a ratio whose zero denominator is missing."""
    return first_rows(df, [key], [F.col(c) for c in order]).withColumn(
        ratio, safe_rate(F.col(numerator), F.col(denominator)))


def signal_table(df: DataFrame, key: str, signals: Sequence[str], minimum: str, maximum: str, median: str,
                 active: float = 1.0) -> DataFrame:
    """Max-abs per signal, grand mean-abs, min / max / median companions, count of active signals."""
    total, count = F.lit(0.0), F.lit(0)
    for c in signals:
        total = total + F.coalesce(F.abs(F.col(c)), F.lit(0.0))
        count = count + F.col(c).isNotNull().cast("int")
    out = group_medians(df.where(F.col(key).isNotNull()), [key], {f"{median}_median": median}, [
        *[F.max(F.abs(F.col(c))).alias(f"{c}_max_abs") for c in signals],
        safe_rate(F.sum(total), F.sum(count)).alias("mean_abs"),
        F.min(minimum).alias(f"{minimum}_min"), F.max(maximum).alias(f"{maximum}_max")])
    hits = F.lit(0)
    for c in signals:
        hits = hits + F.coalesce(F.col(f"{c}_max_abs") >= active, F.lit(False)).cast("int")
    return out.withColumn("active_count", hits.cast("long"))


def reference_catalog(df: DataFrame, codes: str, keys: Sequence[str], name: str, year: str, fallback: str,
                      separator: str = "; ", examples: int = 8) -> DataFrame:
    """Explode reference codes, then per code: distinct names, year range, first sorted examples."""
    code = F.explode(F.split(F.coalesce(F.col(codes), F.lit("")), separator)).alias("reference_code")
    rows = df.select(code, *keys, F.col(name).alias("_name"), F.col(year).alias("_year"))
    groups = ["reference_code", *keys]
    # one row per (code, name) before anything is collected; the k smallest names by rank
    names = rows.groupBy(*groups, "_name").agg(F.min("_year").alias("_lo"), F.max("_year").alias("_hi"))
    from quotaloom.operators.scan import asc, ordered_scan
    ranked = ordered_scan(names, [asc("_name")], groups, rank="_r", total="_n")
    shown = F.array_sort(F.collect_list(F.when(F.col("_r") <= examples, F.col("_name"))))
    out = ranked.groupBy(*groups).agg(
        F.count("_name").alias("n_names"), F.min("_lo").alias("min_year"), F.max("_hi").alias("max_year"),
        F.array_join(shown, separator).alias("name_examples"))
    return out.withColumn("lookup_query", F.coalesce(blank_to_null(F.col("reference_code")), F.col(fallback)))


def extraction_queue(df: DataFrame, endpoints: Mapping[str, str], valid: str, overlap: str, independent: str,
                     endpoint_count: str) -> DataFrame:
    """Endpoints with a value as rows, each with a priority and a selection flag."""
    long = df.select(*[c for c in df.columns if c not in endpoints.values()], F.explode(F.array(*[
        F.struct(F.lit(e).alias("endpoint"), F.col(c).alias("value")) for e, c in endpoints.items()])).alias("_e"))
    rows = long.select(*[c for c in long.columns if c != "_e"], "_e.*").where(F.col("value").isNotNull())
    usable = F.col(valid) & ~F.col(overlap)
    priority = (F.when(~usable, "low").when(F.col(independent) & (F.col(endpoint_count) >= 2), "high")
                .when(F.col(independent), "medium").otherwise("low"))
    return rows.select("*", priority.alias("extraction_priority"), usable.alias("selected"))


def best_hit(df: DataFrame, query_key: str, exact: Column, order: Sequence[Column]) -> DataFrame:
    """Exact matches only, then the smallest by the sort keys, one row per query."""
    return first_rows(df.where(exact), [query_key], order)


def hash_sample(df: DataFrame, key: str, size: int, seed: str = "") -> DataFrame:
    """The ``size`` rows with the smallest sha-256 of their key: a repeatable sample."""
    digest = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    return df.withColumn("selection_key", digest).orderBy("selection_key", key).limit(size)


def present_in_all(df: DataFrame, key: str, category: str, required: int) -> DataFrame:
    """Keys observed in every category (relational division)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(category).alias("_n")).where(
        F.col("_n") == required).select(key)


def result_blocks(
    fields: DataFrame, doc: str, pos: str, label: str, value: str, start: str, members: Sequence[str],
    stops: Sequence[str], required: Sequence[str],
) -> DataFrame:
    """Sessionise an ordered label stream: a start label opens a block, a stop label closes it.

    Running counts of starts and stops name the island a row belongs to; an island is
    a block when it contains its start row.  The last value of a repeated label wins.
    """
    from quotaloom.operators.scan import asc, ordered_scan

    scan = ordered_scan(fields, [asc(pos), asc(label), asc(value)], [doc], {
        "start": (F.col(label) == start).cast("long"), "stop": F.col(label).isin(*stops).cast("long")})
    # a stop row itself belongs to the island it opens, which holds no start
    inside = scan.where((F.col("cum_start") > 0) & F.col(label).isin(start, *members))
    blocks = inside.groupBy(doc, F.col("cum_start").alias("block"), "cum_stop").agg(
        F.count_if(F.col(label) == start).alias("_opened"),
        *[F.max_by(F.when(F.col(label) == c, F.col(value)), F.when(F.col(label) == c, F.col(pos))).alias(c)
          for c in (start, *members)])
    ok = F.col("_opened") > 0
    for c in required:
        ok = ok & blank_to_null(F.col(f"`{c}`")).isNotNull()  # labels may contain dots
    return blocks.where(ok).drop("_opened", "cum_stop")


def first_nonempty(fields: DataFrame, doc: str, pos: str, label: str, value: str, labels: Mapping[str, Sequence[str]],
                   placeholders: Sequence[str] = ("[Empty]", "[Not publishable]")) -> DataFrame:
    """Per document and output column, the first value whose label is wanted and not a placeholder."""
    usable = (F.col(value) != "") & ~F.col(value).isin(*placeholders)
    return fields.groupBy(doc).agg(*[
        F.min_by(F.col(value), F.when(F.lower(F.col(label)).isin(*[w.lower() for w in wanted]) & usable, F.col(pos)))
        .alias(out) for out, wanted in labels.items()])
