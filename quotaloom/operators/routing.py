"""Signal choice on labelled development entities and routing of the queue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaloom.functions.numeric import check_fraction, finite, rate_of, review_count, safe_rate
from quotaloom.operators import rollup
from quotaloom.operators.metrics import (
    mean_sd, omission_metrics, random_reference, screening_action, workload_metrics)
from quotaloom.operators.ranking import (
    aurc, loss_capture, melt_scores, queue_order, review_flags, review_queue, risk_coverage)
from quotaloom.operators.scan import Key, asc, attach_small, cut_offs, first_rows, not_after, ordered_scan, quantiles
from quotaloom.session import materialize

#: fixed values: objectives and their ordering (column, descending), missing last
OBJECTIVES: dict[str, tuple[tuple[str, bool], ...]] = {
    "false_negative_capture": (
        ("false_negative_capture", True), ("high_concern_left_low_priority_fraction", False),
        ("lower_priority_false_omission_rate", False)),
    "largest_error_capture": (("largest_error_capture", True), ("aurc", False)),
    "overall_error_ranking": (("aurc", False), ("largest_error_capture", True)),
    "directional_underprediction_area": (
        ("directional_underprediction_capture_area", True), ("directional_underprediction_capture", True)),
}
#: fixed values: sources reported when the labels cannot decide
UNINFORMATIVE = {
    "false_negative_capture": "benchmark_default_no_false_negatives",
    "directional_underprediction_area": "benchmark_default_no_directional_loss",
}
#: fixed values: plain-text reasons per route
ROUTE_REASONS = {
    "lower_priority": "lower predicted concern and outside review subset",
    "screen_now": "higher predicted concern and outside review subset",
    "withhold_review": "lower predicted concern but selected for reliability review",
    "prioritize_testing": "higher predicted concern and selected for reliability review",
}
INELIGIBLE_REASON = "identity or molecular input did not pass eligibility checks"


def evaluate_signals(
    development: DataFrame, candidates: Mapping[str, str], objective: str = "false_negative_capture",
    fraction: float = 0.25, policy: str = "all_queue", panel: Sequence[str] = (),
    entity: str = "entity", error_level: float = 0.9, y_true: str = "y_true", y_pred: str = "y_pred",
    loss: str = "loss",
) -> DataFrame:
    """Metrics of every candidate signal at the review fraction, one row per (panel, signal)."""
    if objective not in OBJECTIVES:
        raise ValueError(f"Unsupported objective {objective!r}; choose from {sorted(OBJECTIVES)}.")
    fraction = check_fraction(fraction, "review_fraction", inclusive=True)
    error_level = check_fraction(error_level, "high_error_quantile")
    panel = list(panel)
    needs_error = objective in ("largest_error_capture", "overall_error_ranking")
    rows = development
    if objective != "directional_underprediction_area":
        used = [*panel, entity, "true_high", "pred_high", *([y_true, y_pred] if needs_error else []), *candidates.values()]
        rows = materialize(development.select(*dict.fromkeys(c for c in used if c in development.columns)))
    if needs_error:
        rows = rows.withColumn("_error", F.abs(F.col(y_true) - F.col(y_pred)))
        rows = attach_small(rows, quantiles(rows, "_error", {"_limit": error_level}, panel), panel)
    long = melt_scores(rows, candidates, "signal", "score", "candidate_order")
    keys = [*panel, "signal", "candidate_order"]
    if objective == "directional_underprediction_area":
        capture = loss_capture(long, "score", loss, fraction, entity, keys, policy)
        return capture.withColumnsRenamed({
            "capture_area": "directional_underprediction_capture_area",
            "capture": "directional_underprediction_capture"})
    reviewed = review_flags(long, "score", fraction, entity, keys, policy)
    if not needs_error:
        return omission_metrics(reviewed, keys)
    large = F.col("_error") >= F.col("_limit")
    captured = reviewed.groupBy(*keys).agg(
        F.count_if("reviewed").alias("review_n"), rate_of(F.col("reviewed"), large).alias("largest_error_capture"))
    return attach_small(captured, aurc(risk_coverage(long, "_error", "score", entity, keys), keys), keys)


def select_signal(
    metrics: DataFrame, objective: str, default: str, panel: Sequence[str] = ()
) -> DataFrame:
    """Lexicographic winner per panel; the default signal where labels decide nothing."""
    order = []
    for column, descending in OBJECTIVES[objective]:
        worst = F.lit(float("inf"))
        value = -F.col(column) if descending else F.col(column)
        order.append(F.coalesce(value, worst))
    best = first_rows(metrics, list(panel), [*order, F.col("candidate_order")]) if panel else (
        first_rows(metrics.withColumn("_all", F.lit(1)), ["_all"], [*order, F.col("candidate_order")]).drop("_all"))
    primary = F.col(OBJECTIVES[objective][0][0])
    if objective in UNINFORMATIVE:
        informed = primary.isNotNull()
        signal = F.when(informed, F.col("signal")).otherwise(F.lit(default))
        source = F.when(informed, "development_labels").otherwise(UNINFORMATIVE[objective])
    else:
        signal, source = F.col("signal"), F.lit("development_labels")
    return best.select(*panel, signal.alias("selected_signal"), source.alias("selection_source"))


def route_queue(
    queue: DataFrame, score: str | Column, fraction: float = 0.25, policy: str = "all_queue",
    entity: str = "entity", pred_high: str = "pred_high", eligible: str | None = "input_eligible",
    signal: str | None = None, panel: Sequence[str] = (),
) -> DataFrame:
    """Rank the eligible rows, review the quota of their number, give every row a route and reason.

    Ineligible rows sort behind all eligible ones in the same scan and are withheld;
    they take no rank and no quota.
    """
    fraction = check_fraction(fraction, "review_fraction", inclusive=True)
    ok = F.col(eligible) if eligible else F.lit(True)
    value = F.col(score) if isinstance(score, str) else score
    rows = queue.select("*", F.coalesce(ok, F.lit(False)).alias("_ok"), finite(value).alias("selected_score"))
    usable = F.when(F.col("_ok") & F.col("selected_score").isNull(),
                    F.raise_error(F.lit("nonfinite score for a scoreable entity")).cast("double")
                    ).otherwise(F.col("selected_score"))
    rows = rows.withColumn("selected_score", usable)
    order = [asc((~F.col("_ok")).cast("int")), *queue_order("selected_score", entity, policy, pred_high)]
    scan = ordered_scan(rows, order, panel, {"ok": F.col("_ok").cast("long")}, rank="_rank")
    quota = review_count(F.col("total_ok"), fraction)
    reviewed = F.col("_ok") & (F.col("_rank") <= quota)
    action = screening_action(F.col(pred_high), F.col("reviewed"), F.col("_ok"))
    reason = F.when(~F.col("_ok"), INELIGIBLE_REASON)
    for route, text in ROUTE_REASONS.items():
        reason = reason.when(F.col("route") == route, text)
    routed = scan.withColumn("reviewed", reviewed).withColumn("route", action)
    extra = [F.lit(signal).alias("selected_signal")] if signal else []
    return routed.select(
        *queue.columns, *extra, "selected_score",
        F.lit(fraction).alias("review_fraction"), F.lit(policy).alias("review_policy"),
        F.when(F.col("_ok"), F.col("_rank")).alias("review_rank"), "reviewed",
        F.col("route").alias("screening_action"), "route", reason.alias("route_reason"))


def two_stage_review(
    panel_df: DataFrame, first: str, scores: Mapping[str, str], fraction: float = 0.25,
    panel: Sequence[str] = (), entity: str = "entity", miss: str = "any_miss",
) -> DataFrame:
    """Threshold-first review, then an equally large second stage on what is left in the low queue.

    One row per (panel, method, entity of the residual low queue) with ``reviewed_second``;
    the first-stage count travels along.
    """
    panel = list(panel)
    ranked = review_queue(panel_df, first, fraction, entity, panel, "low_concern_first")
    ranked = ranked.withColumn("_first_n", review_count(F.col("panel_rows"), fraction))
    residual = ranked.where(~F.col("pred_high") & ~F.col("reviewed")).select(
        *panel, entity, "true_high", F.col(miss).alias("residual_miss"), "_first_n",
        *dict.fromkeys(scores.values()))
    long = melt_scores(residual, scores)
    scan = ordered_scan(long, queue_order("score", entity), [*panel, "method"],
                        rank="second_rank", total="residual_n")
    extra = F.least(F.col("_first_n"), F.col("residual_n"))
    return scan.withColumn("additional_n", extra).withColumn(
        "reviewed_second", F.col("second_rank") <= F.col("additional_n")).withColumnRenamed("_first_n", "initial_n")


def residual_triage(second: DataFrame, panel: Sequence[str] = ()) -> DataFrame:
    """Metrics of the second stage per method plus its closed-form random reference."""
    panel = list(panel)
    miss, rev = F.col("residual_miss"), F.col("reviewed_second")
    per = second.groupBy(*panel, "method").agg(
        F.max("initial_n").alias("initial_review_n"), F.max("residual_n").alias("n_residual"),
        F.max("additional_n").alias("additional_review_n"), F.count_if(miss).alias("residual_false_negative_n"),
        F.count_if(miss & rev).cast("double").alias("residual_rescued"),
        rate_of(rev, miss).alias("residual_capture"))
    one = per.groupBy(*panel).agg(*[F.max(c).alias(c) for c in (
        "initial_review_n", "n_residual", "additional_review_n", "residual_false_negative_n")])
    p = safe_rate(F.col("additional_review_n"), F.col("n_residual"))
    random = one.select(
        *panel, F.lit("random_second_stage").alias("method"), "initial_review_n", "n_residual",
        "additional_review_n", "residual_false_negative_n",
        (F.col("residual_false_negative_n") * p).alias("residual_rescued"),
        F.when(F.col("residual_false_negative_n") > 0, p).alias("residual_capture"))
    return per.unionByName(random)


def matched_queue(
    panel_df: DataFrame, first: str, scores: Mapping[str, str], fraction: float = 0.25,
    panel: Sequence[str] = (), entity: str = "entity",
) -> DataFrame:
    """Single, second and combined stages of every method at the same review count."""
    panel = list(panel)
    keep = materialize(panel_df.select(*panel, entity, "pred_high", (F.col("true_high") & ~F.col("pred_high")).alias("_miss"),
                                       *dict.fromkeys([first, *scores.values()])))
    base = materialize(review_flags(keep, first, fraction, entity, panel, "low_concern_first").withColumnRenamed("reviewed", "first"))
    long = melt_scores(base, scores)
    key = [*panel, "method"]
    residual = ~F.col("pred_high") & ~F.col("first")
    single = review_flags(long, "score", fraction, entity, key, "low_concern_first").withColumnRenamed("reviewed", "single")
    order = [Key((~residual).cast("int"), discrete=True), *queue_order("score", entity)]
    extra = F.least(review_count(F.col("_n"), fraction), F.col("_res"))
    cuts = cut_offs(long, order, key, {"_second": extra}, {"_res": residual.cast("long")})
    staged = attach_small(single, cuts, key).withColumn("second", residual & not_after(order, "_second"))
    miss, low = F.col("_miss"), ~F.col("pred_high")
    combined = F.col("first") | F.col("second")
    wide = staged.groupBy(*key).agg(
        rate_of(F.col("single"), miss).alias("single_capture"),
        rate_of(miss, low & ~F.col("single")).alias("single_for"),
        rate_of(F.col("second"), miss & residual).alias("second_capture"),
        rate_of(combined, miss).alias("combined_capture"),
        rate_of(miss, low & ~combined).alias("combined_for"))
    return wide


def matched_queue_random(panel_df: DataFrame, fraction: float = 0.25, panel: Sequence[str] = ()) -> DataFrame:
    """Random review of the predicted-low queue at the matched count, in closed form."""
    low, th = ~F.col("pred_high"), F.col("true_high")
    base = panel_df.groupBy(*panel).agg(
        F.count("*").alias("_n"), F.count_if(low).alias("_low"), F.count_if(th & low).alias("_fn"))
    k = review_count(F.col("_n"), fraction)
    return base.select(
        *panel, F.when(F.col("_fn") > 0, F.least(safe_rate(k, F.col("_low")), F.lit(1.0))).alias("capture"),
        F.when(F.col("_low") > k, safe_rate(F.col("_fn"), F.col("_low"))).alias("false_omission_rate"))


def disagreement(
    panel_df: DataFrame, first: tuple[str, str], second: tuple[str, str], fraction: float = 0.25,
    panel: Sequence[str] = (), entity: str = "entity", miss: str = "any_miss",
) -> DataFrame:
    """Which of two methods rescues each baseline miss under the low-first policy."""
    (a, a_col), (b, b_col) = first, second
    rows = materialize(panel_df)
    for name, col in ((a, a_col), (b, b_col)):
        rows = review_flags(rows, col, fraction, entity, panel, "low_concern_first").withColumnRenamed("reviewed", f"reviewed_{name}")
    ra, rb, m = F.col(f"reviewed_{a}"), F.col(f"reviewed_{b}"), F.col(miss)
    return rows.withColumn("disagreement_category", (
        F.when(~m, "not_baseline_false_negative").when(ra & rb, "both_rescued")
        .when(ra, f"{a}_only_rescued").when(rb, f"{b}_only_rescued").otherwise("both_omitted")))


def disagreement_rates(categories: DataFrame, first: str, second: str, miss: str = "any_miss",
                       panel: Sequence[str] = ()) -> DataFrame:
    """Share of the misses per category; categories without a miss stay visible as zero."""
    names = ["both_rescued", f"{first}_only_rescued", f"{second}_only_rescued", "both_omitted"]
    counts = categories.where(miss).groupBy(*panel).agg(
        F.count("*").alias("_all"),
        *[F.count_if(F.col("disagreement_category") == c).alias(c) for c in names])
    entries = [F.struct(F.lit(c).alias("disagreement_category"), F.col(c).alias("n_misses"),
                        safe_rate(F.col(c), F.col("_all")).alias("rate")) for c in names]
    return counts.select(*panel, F.explode(F.array(*entries)).alias("_e")).select(*panel, "_e.*")


def action_map(reviewed: DataFrame, error: str, panel: Sequence[str] = ()) -> DataFrame:
    """Rows, RMSE and share of high concern per screening action."""
    action = screening_action(F.col("pred_high"), F.col("reviewed"))
    e = F.col(error)
    return reviewed.groupBy(*panel, action.alias("screening_action")).agg(
        F.count("*").alias("n_entities"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.col("true_high").cast("double")).alias("high_fraction"))


def fixed_workload(
    panel_df: DataFrame, scores: Mapping[str, str], fractions: Sequence[float], panel: Sequence[str] = (),
    entity: str = "entity", policy: str = "all_queue", min_one: bool = False,
) -> DataFrame:
    """All methods at all burdens: one ordering per method, burdens are read off its ranks."""
    key = [*panel, "method"]
    long = melt_scores(panel_df.select(*panel, entity, "true_high", "pred_high", *dict.fromkeys(scores.values())), scores)
    scan = ordered_scan(long, queue_order("score", entity, policy), key, rank="_r", total="_n")
    grid = scan.select("*", F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"))
    grid = grid.withColumn("reviewed", F.col("_r") <= review_count(F.col("_n"), F.col("fraction"), min_one))
    return workload_metrics(grid, [*key, "fraction"])


def decision_baselines(
    panel_df: DataFrame, scores: Mapping[str, str], fraction: float, panel: Sequence[str] = (),
    entity: str = "entity",
) -> DataFrame:
    """Every method under both queue policies plus the closed-form random review."""
    policies = F.explode(F.array(F.lit("all_queue"), F.lit("low_concern_first"))).alias("policy")
    panel_df = materialize(panel_df.select(*panel, entity, "true_high", "pred_high", *dict.fromkeys(scores.values())))
    long = melt_scores(panel_df, scores).select("*", policies)
    key = [*panel, "policy", "method"]
    reviewed = review_flags(long, "score", fraction, entity, key, F.col("policy") == "low_concern_first")
    methods = omission_metrics(reviewed, key)
    methods = methods.withColumn("rescued_false_negative", F.col("rescued_false_negative").cast("double"))
    random = random_reference(panel_df, fraction, panel).drop("low_capture").select(
        "*", policies, F.lit("random_review").alias("method"),
        (F.col("n_predicted_low") >= F.col("review_n")).alias("low_queue_capacity_sufficient"))
    return methods.unionByName(random)


def frozen_evaluation(
    cases: DataFrame, cutoffs: DataFrame, score: str, panel: Sequence[str], dataset: str,
    fraction: float = 0.25,
) -> DataFrame:
    """Fixed cutoffs applied to every shift; rates per panel, then their mean and SD."""
    rows = rollup.endpoint_medians(
        cases, {"true_value": "y_true", "pred_value": "y_pred", score: score}, panel)
    rows = rollup.attach_cutoffs(rows, cutoffs)
    entities = rows.groupBy(*panel, "entity").agg(
        F.bool_or(F.col("true_value") <= F.col("cutoff")).alias("true_high"),
        F.bool_or(F.col("pred_value") <= F.col("cutoff")).alias("pred_high"), F.max(score).alias(score))
    per = omission_metrics(review_flags(materialize(entities), score, fraction, panel=panel, policy="low_concern_first"), panel)
    return mean_sd(per.withColumn("dataset", F.lit(dataset)), ["dataset"],
                   ["false_negative_capture", "lower_priority_false_omission_rate"])
