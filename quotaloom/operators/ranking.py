"""Queue order, review quotas, workload curves and areas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotaloom.functions.numeric import rate_of, review_count, safe_rate
from quotaloom.operators.scan import Key, asc, attach_small, desc, flag_first, ordered_scan, quantiles

POLICIES = ("all_queue", "low_concern_first")

#: fixed values: selection texts of the review ranking
SELECTION_BASIS = {
    "block_knn": "Greater distance from the fitted training reference",
    "similarity_ad": "Lower structural similarity to training chemicals",
    "ensemble_sd": "Greater disagreement among bootstrap predictions",
    "threshold_proximity": "Smaller predicted margin above the concentration criterion",
}
HIGH_CONCERN_BASIS = "Already predicted high concern; after the low-concern queue"
#: fixed values: ranking rules allowed per review task, default first
TASK_RULES = {
    "general_error": ("block_knn", "similarity_ad", "ensemble_sd"),
    "hazard_omission": ("threshold_proximity", "block_knn", "similarity_ad", "ensemble_sd"),
}


def melt_scores(
    df: DataFrame, scores: Mapping[str, str], method: str = "method", score: str = "score",
    order: str | None = None,
) -> DataFrame:
    """Wide score columns to one row per (row, method): one sort then serves every method."""
    used = set(scores.values())
    entries = [
        F.struct(F.lit(name).alias(method), F.col(col).cast("double").alias(score),
                 *([F.lit(i).alias(order)] if order else []))
        for i, (name, col) in enumerate(scores.items())]
    keep = [c for c in df.columns if c not in used]
    return df.select(*keep, F.explode(F.array(*entries)).alias("_m")).select(*keep, "_m.*")


def queue_order(
    score: str, entity: str, policy: str | Column = "all_queue", pred_high: str = "pred_high",
    ascending: bool = False,
) -> list[Key]:
    """[predicted-low rows first] score descending, missing last, entity as text.

    Under ``low_concern_first`` the predicted-high tail is what completes a quota
    larger than the predicted-low queue, so one order serves both cases.
    """
    if isinstance(policy, str):
        if policy not in POLICIES:
            raise ValueError(f"Unknown review policy: {policy}")
        lead = [Key(F.col(pred_high).cast("int"), discrete=True)] if policy == "low_concern_first" else []
    else:
        lead = [Key(F.when(policy, F.col(pred_high).cast("int")).otherwise(F.lit(0)), discrete=True)]
    value = F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double"))
    return [*lead, Key(value, not ascending), asc(F.col(entity).cast("string"))]


def review_queue(
    df: DataFrame, score: str, fraction: float, entity: str = "entity", panel: Sequence[str] = (),
    policy: str | Column = "all_queue", pred_high: str = "pred_high", min_one: bool = False,
) -> DataFrame:
    """Rank every row within its panel and flag the first ``rint(n * fraction)``."""
    ranked = ordered_scan(df, queue_order(score, entity, policy, pred_high), panel, rank="review_rank")
    quota = review_count(F.col("panel_rows"), fraction, min_one)
    return ranked.withColumn("reviewed", F.col("review_rank") <= quota)


def review_flags(
    df: DataFrame, score: str, fraction: float, entity: str = "entity", panel: Sequence[str] = (),
    policy: str | Column = "all_queue", pred_high: str = "pred_high", min_one: bool = False,
) -> DataFrame:
    """``reviewed`` as in :func:`review_queue`, without ranks: the cut-off of a panel is found from its order keys alone."""
    return flag_first(df, queue_order(score, entity, policy, pred_high), panel, {"reviewed": review_count(F.col("_n"), fraction, min_one)})


def rank_entities(
    entities: DataFrame, task: str, count: int, rule: str | None = None, entity: str = "entity",
    pred_high: str = "predicted_high",
) -> DataFrame:
    """Review ranking with a fixed count: rank, selected flag, rule and its plain-text basis."""
    if task not in TASK_RULES:
        raise ValueError(f"unknown task {task!r}; known: {sorted(TASK_RULES)}")
    rule = rule or TASK_RULES[task][0]
    if rule not in TASK_RULES[task]:
        raise ValueError(f"task {task!r} has no rule {rule!r}; it has {list(TASK_RULES[task])}")
    if isinstance(count, bool) or int(count) != count or count < 0:
        raise ValueError(f"count must be a whole number from 0 on, not {count!r}")
    proximity = rule == "threshold_proximity"
    policy = "low_concern_first" if task == "hazard_omission" else "all_queue"
    order = queue_order("margin_log10" if proximity else rule, entity, policy, pred_high, proximity)
    ranked = ordered_scan(entities, order, rank="rank")
    over = F.when(F.col("panel_rows") < count, F.raise_error(F.format_string(
        "count exceeds the %d ranked entities", F.col("panel_rows"))).cast("boolean"))
    basis = F.lit(SELECTION_BASIS[rule])
    if task == "hazard_omission":
        basis = F.when(F.col(pred_high), HIGH_CONCERN_BASIS).otherwise(basis)
    return ranked.select(
        *entities.columns, "rank",
        F.coalesce(over, F.col("rank") <= count).alias("selected_for_review"),
        F.lit(rule).alias("ranking_rule"), basis.alias("selection_basis"))


def workload_curve(
    df: DataFrame, score: str, entity: str = "entity", panel: Sequence[str] = (),
    policy: str | Column = "all_queue", true_high: str = "true_high", pred_high: str = "pred_high",
) -> DataFrame:
    """State after every review count k = 0..n: rescued misses, omissions, rates."""
    high, low = F.col(true_high), ~F.col(pred_high)
    scan = ordered_scan(
        df, queue_order(score, entity, policy, pred_high), panel,
        {"miss": (high & low).cast("long"), "low": low.cast("long"), "high": high.cast("long")},
        rank="k", total="n")
    point = scan.select(
        *panel, "k", "n", F.col("cum_miss").alias("rescued"), F.col("cum_low").alias("low_reviewed"),
        F.col("total_miss").alias("n_miss"), F.col("total_low").alias("n_low"),
        F.col("total_high").alias("n_high"))
    # the k = 0 state repeats the panel totals of its first row
    start = point.where(F.col("k") == 1).select(
        *panel, F.lit(0).cast("long").alias("k"), "n", F.lit(0).cast("long").alias("rescued"),
        F.lit(0).cast("long").alias("low_reviewed"), "n_miss", "n_low", "n_high")
    return omission_rates(start.unionByName(point))


def omission_rates(points: DataFrame) -> DataFrame:
    """Rates of a workload state; undefined ones stay NULL."""
    return points.select(
        "*",
        safe_rate(F.col("k"), F.col("n")).alias("workload"),
        safe_rate(F.col("rescued"), F.col("n_miss")).alias("capture"),
        safe_rate(F.col("n_miss") - F.col("rescued"), F.col("n_high")).alias("left_low_fraction"),
        safe_rate(F.col("n_miss") - F.col("rescued"), F.col("n_low") - F.col("low_reviewed"))
        .alias("false_omission_rate"),
        (F.col("n_low") >= F.col("k")).alias("low_queue_sufficient"))


def grid_points(
    curve: DataFrame, fractions: Sequence[float], panel: Sequence[str] = (), min_one: bool = False
) -> DataFrame:
    """Curve rows at nominal fractions: the curve is built once and sampled by equi-join on k."""
    panel = list(panel)
    targets = curve.where(F.col("k") == 0).select(
        *panel, "n", F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"))
    targets = targets.select(
        *panel, "fraction", review_count(F.col("n"), F.col("fraction"), min_one).alias("k"))
    return targets.join(curve, [*panel, "k"])


def curve_area(curve: DataFrame, value: str, panel: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area over k/n of a full curve; its steps are equal, so no ordering is needed."""
    y, n = F.col(value), F.col("n")
    edge = F.sum(F.when((F.col("k") == 0) | (F.col("k") == n), y))
    area = safe_rate(F.sum(y) - edge / 2, F.max("n"))
    # NULL anywhere (an undefined rate) makes the area undefined, as in a numeric trapezoid
    return curve.groupBy(*panel).agg(F.when(F.count_if(y.isNull()) == 0, area).alias("area"))


def grid_area(points: DataFrame, x: str, y: str, panel: Sequence[str]) -> DataFrame:
    """Trapezoid area of an irregular grid of a bounded number of points per panel."""
    w = Window.partitionBy(*panel).orderBy(x)
    steps = points.select(*panel, F.col(x), F.col(y), F.lag(x).over(w).alias("_x"), F.lag(y).over(w).alias("_y"))
    return steps.groupBy(*panel).agg(
        F.sum((F.col(x) - F.col("_x")) * (F.col(y) + F.col("_y")) / 2).alias("area"))


def loss_capture(
    df: DataFrame, score: str, loss: str, fraction: float, entity: str = "entity",
    panel: Sequence[str] = (), policy: str = "all_queue", pred_high: str = "pred_high",
) -> DataFrame:
    """Share of the directional loss met by the quota and the area under its capture curve."""
    scan = ordered_scan(df, queue_order(score, entity, policy, pred_high), panel,
                        {"loss": F.col(loss).cast("double")})
    share = safe_rate(F.col("cum_loss"), F.col("total_loss"))
    quota = review_count(F.col("panel_rows"), fraction)
    n = F.max("panel_rows")
    final = F.max(F.when(F.col("rank") == F.col("panel_rows"), share))
    return scan.groupBy(*panel).agg(
        safe_rate(F.sum(share) - final / 2, n).alias("capture_area"),
        F.when(F.max("total_loss") > 0, F.coalesce(F.max(F.when(F.col("rank") == quota, share)), F.lit(0.0)))
        .alias("capture"))


def risk_coverage(
    df: DataFrame, error: str, score: str, case_id: str = "case_id", panel: Sequence[str] = (), numbered: bool = False, ids: bool = True
) -> DataFrame:
    """Mean error of the i most trusted rows, for every i (ascending score).

    Equal scores are ordered by the case id as text, or as it is if it is ``numbered``.  Without ``ids`` case ids
    are there for the order only, and neither written nor returned.
    """
    rows = df.select(*dict.fromkeys([*panel, case_id, score, error]))
    tie = F.col(case_id) if numbered else F.col(case_id).cast("string")
    scan = ordered_scan(rows, [asc(F.col(score).cast("double")), asc(tie)], panel,
                        {"error": F.col(error).cast("double")}, keep=None if ids else [*panel, error])
    return scan.select(*panel, *([case_id] if ids else []), "rank", "panel_rows",
                       (F.col("rank") / F.col("panel_rows")).alias("coverage"),
                       (F.col("cum_error") / F.col("rank")).alias("risk"))


def aurc(curve: DataFrame, panel: Sequence[str] = ()) -> DataFrame:
    ends = F.col("rank").isin(1) | (F.col("rank") == F.col("panel_rows"))
    # a panel of one row has a single point and no area
    return curve.groupBy(*panel).agg(
        F.when(F.max("panel_rows") > 1, (F.sum("risk") - F.sum(F.when(ends, F.col("risk"))) / 2)
               / F.max("panel_rows")).otherwise(F.lit(0.0)).alias("aurc"))


def selective_risk(
    df: DataFrame, y_true: str, y_pred: str, score: str, abstain: Sequence[float],
    case_id: str = "case_id", panel: Sequence[str] = (),
) -> DataFrame:
    """Error of the rows kept after abstaining on the highest-scored fractions."""
    panel = list(panel)
    error = F.abs(F.col(y_true) - F.col(y_pred))
    rows = df.select(*panel, case_id, F.col(score).cast("double").alias("_score"), error.alias("_error"))
    limit = quantiles(rows, "_error", {"_limit": 0.9}, panel)
    scan = ordered_scan(rows, [asc("_score"), asc(F.col(case_id).cast("string"))], panel)
    grid = attach_small(scan, limit, panel).select(
        "*", F.explode(F.array(*[F.lit(float(a)) for a in abstain])).alias("abstain_fraction"))
    kept = F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("panel_rows") * (1 - F.col("abstain_fraction"))))
    held, large = F.when(kept, F.col("_error")), F.col("_error") >= F.col("_limit")
    out = grid.groupBy(*panel, "abstain_fraction").agg(
        safe_rate(F.count_if(kept), F.max("panel_rows")).alias("retained_fraction"),
        F.sqrt(F.avg(held * held)).alias("rmse"), F.avg(held).alias("mae"),
        rate_of(large, kept).alias("top_decile_error_rate"),
        F.avg("_error").alias("_all"), F.avg(large.cast("double")).alias("_base"))
    return out.select(
        *panel, "abstain_fraction", "retained_fraction", "rmse", "mae", "top_decile_error_rate",
        (F.col("_base") - F.col("top_decile_error_rate")).alias("top_decile_error_rate_reduction"),
        (F.col("_all") - F.col("mae")).alias("error_reduction"))


def top_fraction(
    df: DataFrame, score: str, fraction: float, case_id: str, panel: Sequence[str] = (),
    flag: str = "selected", rounding: str = "rint", min_one: bool = True,
) -> DataFrame:
    """Flag the top rows by score: ``rint`` or ``ceil`` of the fraction, at least one."""
    share = F.col("_n") * F.lit(float(fraction))
    size = F.ceil(share) if rounding == "ceil" else F.rint(share)
    if min_one:
        size = F.greatest(F.lit(1), size)
    order = [desc(F.col(score).cast("double")), asc(F.col(case_id).cast("string"))]
    return flag_first(df, order, panel, {flag: F.least(F.col("_n"), size)})
