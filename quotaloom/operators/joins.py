"""Joins of the curation and audit steps: star assembly, fill cascades, existence flags, reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaloom.functions.text import blank_to_null
from quotaloom.functions.units import to_molar
from quotaloom.operators.scan import first_rows


def membership_flag(df: DataFrame, known: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """True where the key tuple occurs in ``known``; the known keys are made distinct first."""
    keys = list(keys)
    seen = known.select(*keys).where(_all_present(keys)).distinct().withColumn("_seen", F.lit(True))
    return df.join(seen, keys, "left").select(
        *df.columns, F.coalesce(F.col("_seen"), F.lit(False)).alias(flag))


def _all_present(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def star(facts: DataFrame, dimensions: Sequence[tuple[DataFrame, str, str]], where: Column | None = None) -> DataFrame:
    """Left-join dimension tables (frame, fact key, dimension key), then filter.

    The filter is written last, as the analyst thinks of it; Catalyst moves its parts
    to the scans and turns a left join into an inner one where it rejects NULLs.
    """
    out = facts
    for frame, left, right in dimensions:
        out = out.join(frame, out[left] == frame[right], "left")
        if left != right:
            out = out.drop(frame[right])
    return out if where is None else out.where(where)


def coalesce_join(df: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join that fills blank cells of ``columns`` from the other side."""
    extra = other.select(*keys, *[F.col(c).alias(f"_other_{c}") for c in columns])
    joined = df.join(extra, list(keys), "left")
    return joined.select(*[
        F.coalesce(blank_to_null(F.col(c)), F.col(f"_other_{c}")).alias(c) if c in columns else F.col(c)
        for c in df.columns])


def fill_from_match(
    base: DataFrame, catalog: DataFrame, base_key: Column, catalog_key: Column, columns: Sequence[str],
    source: str, prefer: str, tie: Sequence[str],
) -> DataFrame:
    """Fill only the empty cells from the best catalog row per key and stamp the source.

    The best row has a non-empty ``prefer`` column; remaining ties go to the
    smallest ``tie`` columns.
    """
    keyed = catalog.select(catalog_key.alias("_key"), *dict.fromkeys([*columns, prefer, *tie])).where(
        blank_to_null(F.col("_key")).isNotNull())
    best = first_rows(keyed, ["_key"], [
        blank_to_null(F.col(prefer)).isNull().cast("int"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in tie]])
    best = best.select("_key", *[blank_to_null(F.col(c)).alias(f"_m_{c}") for c in columns])
    joined = base.withColumn("_key", base_key).join(best, "_key", "left")
    filled = F.lit(False)
    for c in columns:
        filled = filled | (blank_to_null(F.col(c)).isNull() & F.col(f"_m_{c}").isNotNull())
    stamps = {
        "resolved": F.when(filled, F.lit(True)).otherwise(F.col("resolved")),
        "resolution_source": F.when(filled, F.lit(source)).otherwise(F.col("resolution_source")),
    }
    return joined.select(*[
        F.when(blank_to_null(F.col(c)).isNull() & F.col(f"_m_{c}").isNotNull(), F.col(f"_m_{c}")).otherwise(F.col(c)).alias(c)
        if c in columns else (stamps[c].alias(c) if c in stamps else F.col(c)) for c in base.columns])


def resolve_index(
    index: DataFrame, catalog: DataFrame, columns: Sequence[str], steps: Sequence[tuple[str, Column, Column]],
    prefer: str, tie: Sequence[str],
) -> DataFrame:
    """Priority cascade of :func:`fill_from_match` (source, index key, catalog key) steps."""
    out = index.select(
        *[c for c in index.columns if c not in columns],
        *[F.lit("").alias(c) for c in columns],
        F.lit(False).alias("resolved"), F.lit("").alias("resolution_source"))
    for source, left, right in steps:
        out = fill_from_match(out, catalog, left, right, columns, source, prefer, tie)
    return out


def catalog_semi_join(catalog: DataFrame, targets: DataFrame, keys: Mapping[str, tuple[Column, Column]],
                      row_id: Sequence[str]) -> DataFrame:
    """Catalog rows matching any target key; an OR of semi-joins as a union of them, duplicates removed."""
    parts = []
    for left, right in keys.values():
        wanted = targets.select(right.alias("_key")).where(blank_to_null(F.col("_key")).isNotNull()).distinct()
        parts.append(catalog.withColumn("_key", left).join(wanted, "_key", "left_semi").drop("_key"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(list(row_id))


def attach_with_fallback(
    df: DataFrame, features: DataFrame, columns: Sequence[str], primary: tuple[Column, Column],
    fallback: tuple[Column, Column], tie: Sequence[str],
) -> DataFrame:
    """Left join by the primary key; rows where every feature is NULL retry by the fallback key."""
    def side(key: Column, prefix: str) -> DataFrame:
        keyed = features.select(key.alias("_key"), *dict.fromkeys([*columns, *tie])).where(
            blank_to_null(F.col("_key")).isNotNull())
        best = first_rows(keyed, ["_key"], [F.coalesce(F.col(t).cast("string"), F.lit("")) for t in tie])
        return best.select(F.col("_key").alias(f"_{prefix}_key"), *[F.col(c).alias(f"_{prefix}_{c}") for c in columns])
    a, b = side(primary[1], "a"), side(fallback[1], "b")
    keyed = df.withColumn("_a0", primary[0]).withColumn("_b0", fallback[0])
    joined = keyed.join(a, keyed["_a0"] == a["_a_key"], "left")
    joined = joined.join(b, joined["_b0"] == b["_b_key"], "left")
    empty = F.lit(True)
    for c in columns:
        empty = empty & F.col(f"_a_{c}").isNull()
    return joined.select(*df.columns, *[
        F.when(empty, F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")).alias(c) for c in columns])


def merge_feature_tables(tables: Sequence[DataFrame], keys: Sequence[str], prefix: str = "mech_") -> DataFrame:
    """Chained full outer joins where missing key parts match each other, plus the feature count."""
    out = tables[0]
    for t in tables[1:]:
        right = t.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in t.columns if c not in keys])
        cond = F.lit(True)
        for k in keys:
            cond = cond & out[k].eqNullSafe(right[f"_r_{k}"])
        joined = out.join(right, cond, "full_outer")
        out = joined.select(
            *[F.coalesce(F.col(k), F.col(f"_r_{k}")).alias(k) for k in keys],
            *[c for c in out.columns if c not in keys], *[c for c in t.columns if c not in keys])
    features = [c for c in out.columns if c.startswith(prefix)]
    count = F.lit(0)
    for c in features:
        count = count + F.col(c).isNotNull().cast("int")
    return out.withColumn("feature_count", count.cast("long"))


def unambiguous_lookup(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per key, the value of a column where it has exactly one, NULL where it has several."""
    # min equals max exactly when one distinct value exists; both combine map-side
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[
        F.when(F.min(c) == F.max(c), F.max(c)).alias(c) for c in columns])


def fill_from_lookup(df: DataFrame, lookup: DataFrame, key: str, columns: Sequence[str],
                     counter: str = "filled_from_reference") -> DataFrame:
    extra = lookup.select(key, *[F.col(c).alias(f"_l_{c}") for c in columns])
    joined = df.join(extra, key, "left")
    used = F.lit(0)
    for c in columns:
        used = used + (F.col(c).isNull() & F.col(f"_l_{c}").isNotNull()).cast("int")
    return joined.select(*[
        F.coalesce(F.col(c), F.col(f"_l_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns],
        used.cast("long").alias(counter))


def complete_categories(df: DataFrame, keys: Sequence[str], category: str, values: Sequence[str]) -> DataFrame:
    """Left join of a fixed category list per key, so absent categories stay visible."""
    frame = df.select(*keys).distinct().select(
        *keys, F.explode(F.array(*[F.lit(v) for v in values])).alias(category))
    return frame.join(df, [*keys, category], "left")


def identity_overlap(train: DataFrame, panel: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
    """Per identity key: distinct training values, panel values and their intersection."""
    def values(df: DataFrame, side: str) -> DataFrame:
        entries = F.explode(F.array(*[F.struct(F.lit(n).alias("key"), e.alias("value")) for n, e in keys.items()]))
        return df.select(entries.alias("_e")).select("_e.*").where(blank_to_null(F.col("value")).isNotNull()).select(
            "key", "value", F.lit(side == "train").alias("_t"), F.lit(side == "panel").alias("_p"))
    both = values(train, "train").unionByName(values(panel, "panel")).groupBy("key", "value").agg(
        F.bool_or("_t").alias("_t"), F.bool_or("_p").alias("_p"))
    return both.groupBy("key").agg(
        F.count_if("_t").alias("n_train"), F.count_if("_p").alias("n_panel"),
        F.count_if(F.col("_t") & F.col("_p")).alias("n_shared"))


def reconcile(left: DataFrame, right: DataFrame, key: str, exact: Sequence[str], close: Sequence[str],
              tolerance: float = 1e-12) -> DataFrame:
    """One row: rows on either side only and rows disagreeing on any compared column."""
    a = left.select(key, *[F.col(c).alias(f"_a_{c}") for c in [*exact, *close]], F.lit(True).alias("_a"))
    b = right.select(key, *[F.col(c).alias(f"_b_{c}") for c in [*exact, *close]], F.lit(True).alias("_b"))
    both = a.join(b, key, "full_outer")
    matched = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    differs = F.lit(False)
    for c in exact:
        differs = differs | ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    for c in close:
        gap = F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) > tolerance
        differs = differs | F.coalesce(gap, F.col(f"_a_{c}").isNull() != F.col(f"_b_{c}").isNull())
    return both.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("_b").isNull()).alias("left_only"),
        F.count_if(F.col("_a").isNull()).alias("right_only"), F.count_if(matched & differs).alias("n_different"))


def checked_many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join that fails the job when the right side repeats a key."""
    keys = list(keys)
    payload = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in payload])
    guard = F.when(F.col("_n") > 1, F.raise_error(F.lit("merge key is not unique on the right side")).cast("long"))
    one = one.where(F.coalesce(guard, F.lit(1)) == 1).drop("_n")
    return left.join(one, keys, how)


def recover_metadata(
    cases: DataFrame, metadata: DataFrame, keys: Sequence[str], case_id: str, collect: Sequence[str],
    separator: str = ";",
) -> DataFrame:
    """Many-to-many recovery by an exact multi-column key; matches collapse to sorted unique lists.

    Missing key parts are blanked so that they match each other.  The metadata collapse
    to one row per key before the join, so a case meets one row however many match.
    """
    def blanked(df: DataFrame, rest: Sequence[str]) -> DataFrame:
        return df.select(*[F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")).alias(k) for k in keys], *rest)
    values = blanked(metadata, list(collect)).select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), blank_to_null(F.col(c)).alias("value")) for c in collect])).alias("_e"))
    one = values.select(*keys, "_e.*").where("value is not null").distinct().groupBy(*keys).agg(*[
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("name") == c, F.col("value")))), separator).alias(c)
        for c in collect])
    return blanked(cases, [case_id]).join(one, list(keys), "left").select(
        case_id, *[F.coalesce(c, F.lit("")).alias(c) for c in collect])


def enrich_panel(
    panel_df: DataFrame, catalog: DataFrame, name: str, key: str, columns: Mapping[str, str], value: str, unit: str, weight: str,
    entity_id: str, catalog_key: str | None = None, tie: Sequence[str] = (), entity: str = "entity",
) -> DataFrame:
    """A panel with catalog columns (``output -> catalog column``), its molar values and log10 target, and an entity id.

    The distinct (name, key) pairs are resolved once, each by the first catalog row of its key in the order of ``tie``, and
    joined back; a key that many rows share is looked up once.  ``weight`` and ``entity_id`` are outputs; where the id is
    missing or blank the key is the entity.  No row is lost or repeated; rows without a key stay unresolved.
    """
    catalog_key = catalog_key or key
    index = panel_df.select(name, key).distinct()
    known = catalog.select(F.trim(F.col(catalog_key).cast("string")).alias("_key"), *[F.col(c).alias(o) for o, c in columns.items()],
                           *[F.col(t).cast("string").alias(f"_t{i}") for i, t in enumerate(tie)])
    order = [F.coalesce(F.col(f"_t{i}"), F.lit("")) for i in range(len(tie))] or [F.to_json(F.struct(*columns))]
    best = first_rows(known.where(F.col("_key") != ""), ["_key"], order).select("_key", *columns)
    resolved = index.join(best, F.trim(F.col(key).cast("string")) == F.col("_key"), "left").drop("_key")
    resolved = resolved.select(F.col(name).alias("_name"), F.col(key).alias("_panel_key"), *columns)
    joined = panel_df.join(resolved, F.col(name).eqNullSafe(F.col("_name")) & F.col(key).eqNullSafe(F.col("_panel_key")), "left")
    molar = to_molar(F.col(value), F.col(unit), F.col(weight))
    known_weight = F.col(weight).try_cast("double").isNotNull()
    return joined.select(
        *[F.col(c) for c in panel_df.columns], *columns, F.when(known_weight, molar).alias("value_molar"),
        F.when(known_weight, F.log10(molar)).alias("log_molar"),
        F.coalesce(F.nullif(F.trim(F.col(entity_id).cast("string")), F.lit("")), F.col(key).cast("string")).alias(entity))
