"""Case -> (entity, endpoint) -> entity rollups and the concern cutoffs they use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaloom.operators.scan import group_medians, quantiles
from quotaloom.schema import CaseSchema
from quotaloom.session import materialize

SCHEMA = CaseSchema()


def endpoint_medians(
    cases: DataFrame,
    columns: Mapping[str, str],
    by: Sequence[str] = (),
    schema: CaseSchema = SCHEMA,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Median of every column per (by, entity, endpoint); repeated tests weigh once."""
    return group_medians(
        cases.where(F.col(schema.entity).isNotNull()),
        [*by, schema.entity, schema.endpoint], columns,
        [F.count("*").alias("case_count"), *extra])


def concern_cutoffs(
    cases: DataFrame, level: float = 0.25, by: Sequence[str] = (), schema: CaseSchema = SCHEMA
) -> DataFrame:
    """Per endpoint (and ``by``) quantile of the per-entity medians of the measured value."""
    medians = group_medians(cases, [*by, schema.entity, schema.endpoint], {"_median": schema.y_true})
    return quantiles(medians, "_median", {"cutoff": level}, [*by, schema.endpoint])


def locked_cutoffs(
    cases: DataFrame, level: float = 0.25, by: Sequence[str] = (), schema: CaseSchema = SCHEMA
) -> DataFrame:
    """Cutoff table with the partition sizes that produced it, ready to be stored."""
    cut = concern_cutoffs(cases, level, by, schema)
    sizes = cases.groupBy(*by, schema.endpoint).agg(
        F.count("*").alias("case_count"), F.count_distinct(schema.entity).alias("entity_count"))
    return cut.join(sizes, [*by, schema.endpoint], "left")


def attach_cutoffs(endpoint: DataFrame, cutoffs: DataFrame, by: Sequence[str] = (),
                   schema: CaseSchema = SCHEMA) -> DataFrame:
    """Join the cutoffs; an endpoint without one fails the job instead of vanishing.

    The cutoffs are written down: of known size, a few are broadcast and rows of one endpoint don't meet in one task.
    """
    joined = endpoint.join(materialize(cutoffs.select(*by, schema.endpoint, "cutoff")), [*by, schema.endpoint], "left")
    guarded = F.when(F.col("cutoff").isNotNull(), F.col("cutoff")).otherwise(
        F.raise_error(F.concat(F.lit("endpoint without a concern cutoff: "),
                               F.coalesce(F.col(schema.endpoint), F.lit("NULL")))).cast("double"))
    return joined.withColumn("cutoff", guarded)


def interval_crossing(lower: Column, upper: Column, cutoff: Column) -> Column:
    """1 + depth below the cutoff when the interval crosses it, minus the gap otherwise."""
    return F.when((lower <= cutoff) & (upper >= cutoff), 1.0 + F.greatest(cutoff - lower, F.lit(0.0))
                  ).otherwise(-F.greatest(lower - cutoff, F.lit(0.0)))


def entity_panel(
    cases: DataFrame,
    cutoffs: DataFrame,
    scores: Sequence[str],
    by: Sequence[str] = (),
    schema: CaseSchema = SCHEMA,
    interval: tuple[str, str] | None = None,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """The core rollup: endpoint medians, concern flags against the cutoffs, entity maxima.

    A miss (``true_high AND NOT pred_high``) is judged on the entity; ``any_miss`` keeps
    the weaker reading "some endpoint was missed" for the analyses that use it.
    ``extra`` are aggregates over endpoint rows appended to the entity row.
    """
    columns = {"true_value": schema.y_true, "pred_value": schema.y_pred, **{s: s for s in scores}}
    if interval:
        columns |= {"interval_lower": interval[0], "interval_upper": interval[1]}
    return panel_of_medians(endpoint_medians(cases, columns, by, schema), cutoffs, scores, by, schema,
                            bool(interval), extra)


def panel_of_medians(
    medians: DataFrame, cutoffs: DataFrame, scores: Sequence[str], by: Sequence[str] = (),
    schema: CaseSchema = SCHEMA, interval: bool = False, extra: Sequence[Column] = (),
) -> DataFrame:
    """Second level of the rollup, from (entity, endpoint) medians to entities."""
    endpoint = attach_cutoffs(medians, cutoffs, by, schema)
    th, ph = F.col("true_value") <= F.col("cutoff"), F.col("pred_value") <= F.col("cutoff")
    flagged = endpoint.select(
        "*", F.coalesce(th, F.lit(False)).alias("true_high"), F.coalesce(ph, F.lit(False)).alias("pred_high"),
        (-F.abs(F.col("pred_value") - F.col("cutoff"))).alias("proximity"))
    gap = F.col("pred_value") - F.col("true_value")
    aggregates = [
        F.bool_or("true_high").alias("true_high"),
        F.bool_or("pred_high").alias("pred_high"),
        F.bool_or(F.col("true_high") & ~F.col("pred_high")).alias("any_miss"),
        F.min("true_value").alias("min_true"),
        F.min("pred_value").alias("min_pred"),
        F.max("proximity").alias("proximity"),
        F.max(F.when(~F.col("pred_high"), F.col("proximity"))).alias("low_proximity"),
        F.max(F.abs(gap)).alias("abs_error"),
        F.greatest(F.max(gap), F.lit(0.0)).alias("loss"),
        F.count(schema.endpoint).alias("endpoint_count"),
        F.sum("case_count").alias("case_count"),
        *[F.max(s).alias(s) for s in scores],
    ]
    if interval:
        crossing = interval_crossing(F.col("interval_lower"), F.col("interval_upper"), F.col("cutoff"))
        aggregates += [
            F.max(crossing).alias("interval_crossing"),
            F.max(F.when(~F.col("pred_high"), crossing)).alias("low_interval_crossing")]
    return flagged.groupBy(*by, schema.entity).agg(*aggregates, *extra)


def entity_extremes(
    cases: DataFrame,
    scores: Sequence[str],
    mode: str = "endpoint_median",
    by: Sequence[str] = (),
    schema: CaseSchema = SCHEMA,
) -> DataFrame:
    """Worst case per entity, straight from the rows (``extreme``) or from endpoint medians."""
    if mode not in ("extreme", "endpoint_median"):
        raise ValueError(f"Unknown aggregation mode: {mode}")
    rows = cases.where(F.col(schema.entity).isNotNull())
    if mode == "endpoint_median":
        rows = endpoint_medians(
            rows, {schema.y_true: schema.y_true, schema.y_pred: schema.y_pred, **{s: s for s in scores}},
            by, schema)
        count, breadth = F.sum("case_count"), F.count(schema.endpoint)
    else:
        count, breadth = F.count("*"), F.count_distinct(schema.endpoint)
    return rows.groupBy(*by, schema.entity).agg(
        F.min(schema.y_true).alias("min_true"), F.min(schema.y_pred).alias("min_pred"),
        *[F.max(s).alias(s) for s in scores],
        breadth.alias("endpoint_count"), count.alias("case_count"))


def endpoint_relative_panel(
    cases: DataFrame, level: float, scores: Sequence[str], by: Sequence[str] = (),
    schema: CaseSchema = SCHEMA,
) -> DataFrame:
    """Entity panel whose cutoffs come from the evaluated panel itself, per (by, endpoint).

    The case table is read once: cutoffs and flags both start from its medians.
    """
    columns = {"true_value": schema.y_true, "pred_value": schema.y_pred, **{s: s for s in scores}}
    medians = materialize(endpoint_medians(cases, columns, by, schema))
    cutoffs = quantiles(medians, "true_value", {"cutoff": level}, [*by, schema.endpoint], written=True)
    return panel_of_medians(medians, cutoffs, scores, by, schema)


def absolute_panel(
    cases: DataFrame, thresholds: Sequence[float], tolerance: float = 1e-12,
    mode: str = "endpoint_median", scores: Sequence[str] = (), schema: CaseSchema = SCHEMA,
) -> DataFrame:
    """Flags against fixed thresholds (inclusive, snapped at the boundary), one panel each."""
    worst = entity_extremes(cases, scores, mode, schema=schema)
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    grid = worst.select("*", levels)
    return grid.select(
        "*", (F.col("min_true") <= F.col("threshold") + tolerance).alias("true_high"),
        (F.col("min_pred") <= F.col("threshold") + tolerance).alias("pred_high"))


def review_rollup(
    cases: DataFrame, cutoff: float, scores: Sequence[str], schema: CaseSchema = SCHEMA,
    value: str = "prediction_log", name: str = "entity_name",
) -> tuple[DataFrame, DataFrame]:
    """Endpoint and entity tables of a review run: first metadata, any-flags, log margin."""
    if not cutoff > 0:
        raise ValueError("The concentration criterion must be positive and finite.")
    endpoints = endpoint_medians(cases, {value: value, **{s: s for s in scores}}, schema=schema)
    endpoints = endpoints.withColumn("prediction", F.pow(F.lit(10.0), F.col(value)))
    meta = cases.groupBy(schema.entity).agg(
        F.min_by(name, schema.case_id).alias(name),
        F.max("missing_input_count").alias("missing_input_count"),
        F.bool_or("unseen_species").alias("unseen_species"),
        F.bool_or("entity_in_training").alias("entity_in_training"))
    entities = endpoints.groupBy(schema.entity).agg(
        F.min(value).alias(value), F.count("*").alias("endpoint_count"),
        F.sum("case_count").alias("case_count"), *[F.max(s).alias(s) for s in scores])
    entities = entities.join(meta, schema.entity)
    limit = F.log10(F.lit(float(cutoff)))
    return endpoints, entities.select(
        "*", F.pow(F.lit(10.0), F.col(value)).alias("prediction"),
        (F.col(value) <= limit).alias("predicted_high"),
        (F.col(value) - limit).alias("margin_log10"))


def cutoff_sensitivity(
    cases: DataFrame, levels: Sequence[float], scores: Sequence[str], schema: CaseSchema = SCHEMA
) -> DataFrame:
    """Entity flags at several cutoff quantiles; medians and quantiles are computed once for all."""
    medians = materialize(endpoint_medians(
        cases, {"true_value": schema.y_true, "pred_value": schema.y_pred, **{s: s for s in scores}}, schema=schema))
    names = {f"q{i}": q for i, q in enumerate(levels)}
    cuts = quantiles(medians, "true_value", names, [schema.endpoint])
    entries = [F.struct(F.lit(float(q)).alias("level"), F.col(n).alias("cutoff")) for n, q in names.items()]
    cuts = cuts.select(schema.endpoint, F.explode(F.array(*entries)).alias("_e")).select(schema.endpoint, "_e.*")
    return medians.join(cuts, schema.endpoint).groupBy("level", schema.entity).agg(
        F.bool_or(F.col("true_value") <= F.col("cutoff")).alias("true_high"),
        F.bool_or(F.col("pred_value") <= F.col("cutoff")).alias("pred_high"),
        *[F.max(s).alias(s) for s in scores])
