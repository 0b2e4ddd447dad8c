"""What a score loses when one of its components is left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaloom.operators.metrics import mean_sd, omission_metrics
from quotaloom.operators.ranking import aurc, melt_scores, review_flags, risk_coverage
from quotaloom.operators.rollup import endpoint_relative_panel
from quotaloom.operators.scan import asc, attach_small, ordered_scan
from quotaloom.session import materialize

#: the score of all components
FULL = "full"


def left_out(components: Sequence[str]) -> dict[str, Column]:
    """The mean of all components, and for each component the mean of the others; unknown as soon as one of them is."""
    if len(components) < 2:
        raise ValueError("an ablation needs at least two components")
    def mean(names: Sequence[str]) -> Column:
        total = F.col(names[0])
        for c in names[1:]:
            total = total + F.col(c)
        return total / F.lit(float(len(names)))
    return {FULL: mean(list(components))} | {c: mean([x for x in components if x != c]) for c in components}


def ablation_deltas(
    cases: DataFrame, components: Sequence[str], panel: Sequence[str], fraction: float = 0.25, level: float = 0.25,
    y_true: str = "y_true", y_pred: str = "y_pred", case_id: str = "case_id", entity: str = "entity",
) -> DataFrame:
    """(panel, removed, metric, value, full_value, delta): the score without each component against the full one.

    ``aurc`` is the area under the risk-coverage curve of the cases, ``false_omission_rate`` that of the low queue after the
    entities of a panel were reviewed by the score.  All scores are ranked in one plan, and each is paired with the full score
    of its own panel.
    """
    panel = list(panel)
    columns = {name: f"_without_{name}" for name in left_out(components)}
    scored = cases.withColumns({columns[n]: score for n, score in left_out(components).items()})
    scored = scored.select(*panel, case_id, entity, "endpoint", y_true, y_pred, F.abs(F.col(y_true) - F.col(y_pred)).alias("_error"), *columns.values())
    # cases are ordered by id once: a number stands for the id in the rows of each score.  Read by the curves and by the entity table
    numbered = ordered_scan(scored, [asc(F.col(case_id).cast("string"))], rank="_case", total="_cases")
    scored = materialize(numbered.drop(case_id, "_cases"))
    keys = [*panel, "removed"]
    curves = risk_coverage(melt_scores(scored.select(*panel, "_case", "_error", *columns.values()), columns, "removed"), "_error", "score", "_case", keys, numbered=True)
    areas = aurc(curves, keys).select(*keys, F.lit("aurc").alias("metric"), F.col("aurc").alias("value"))
    entities = materialize(endpoint_relative_panel(scored, level, list(columns.values()), panel).select(
        *panel, entity, "true_high", "pred_high", *columns.values()))
    reviewed = review_flags(melt_scores(entities, columns, "removed"), "score", fraction, entity, keys, "low_concern_first")
    rates = omission_metrics(reviewed, keys).select(*keys, F.lit("false_omission_rate").alias("metric"),
                                                    F.col("lower_priority_false_omission_rate").alias("value"))
    values = materialize(areas.unionByName(rates))
    whole = values.where(F.col("removed") == FULL).select(*panel, "metric", F.col("value").alias("full_value"))
    return attach_small(values, whole, [*panel, "metric"]).select(
        *keys, "metric", "value", "full_value", (F.col("value") - F.col("full_value")).alias("delta"))


def ablation_summary(deltas: DataFrame, by: Sequence[str] = ("removed", "metric")) -> DataFrame:
    """Mean and SD of the deltas over the panels, without the full score itself."""
    return mean_sd(deltas.where(F.col("removed") != FULL), list(by), ["delta"])
