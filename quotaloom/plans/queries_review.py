"""Rollup, ranking, routing and omission queries on the case table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaloom.operators import metrics, ranking, rollup, routing
from quotaloom.plans.registry import query
from quotaloom.plans.testbed import CASES, CUTOFFS, PANEL, SCORES, cases, rounded
from quotaloom.session import materialize


def n(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def rate(part: str, whole: str) -> str:
    """Share of ``whole`` rows that satisfy ``part``, NULL when there are none."""
    return f"round({n(f'({part}) AND ({whole})')} / nullif({n(whole)}, 0)::DOUBLE, 6)"


def div(a: str, b: str) -> str:
    return f"round(({a}) / nullif(({b})::DOUBLE, 0), 6)"


MISS = "true_high AND NOT pred_high"
SIGNALS = {"first": "s1", "second": "s2", "proximity": "proximity"}


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.endpoint_relative_panel(cases(spark, sf), 0.25, SCORES)


#: rank in the low-first queue of score s1 and the quota of 25 %
QUEUE = PANEL + """,
queue AS (
  SELECT *, row_number() OVER (ORDER BY pred_high, s1 DESC NULLS LAST, entity) AS review_rank,
         count(*) OVER () AS n FROM panel),
reviewed AS (SELECT *, review_rank <= round_even(n * 0.25::DOUBLE, 0) AS reviewed FROM queue)
"""


@query("concern_cutoffs", f"WITH {CASES}, {CUTOFFS} SELECT endpoint, round(cutoff, 6) AS cutoff FROM cut")
def concern_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.concern_cutoffs(cases(spark, sf)))


@query("locked_cutoffs", f"""WITH {CASES},
med AS (SELECT split, entity, endpoint, median(y_true) m FROM cases GROUP BY ALL),
cut AS (SELECT split, endpoint, quantile_cont(m, 0.25) AS cutoff FROM med GROUP BY ALL),
sz AS (SELECT split, endpoint, count(*) AS case_count, count(DISTINCT entity) AS entity_count FROM cases GROUP BY ALL)
SELECT split, endpoint, round(cutoff, 6) AS cutoff, case_count, entity_count FROM cut JOIN sz USING (split, endpoint)""")
def locked_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.locked_cutoffs(cases(spark, sf), by=["split"]))


@query("entity_rollup", f"""WITH {CASES}, {PANEL}
SELECT entity, true_high, pred_high, any_miss, round(min_true, 6) AS min_true, round(min_pred, 6) AS min_pred,
       round(s1, 6) AS s1, round(s2, 6) AS s2, round(abs_error, 6) AS abs_error, round(loss, 6) AS loss,
       endpoint_count, case_count FROM panel""")
def entity_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(panel(spark, sf).drop("proximity", "low_proximity"))


@query("entity_rollup_extreme", f"""WITH {CASES}
SELECT entity, round(min(y_true), 6) AS min_true, round(min(y_pred), 6) AS min_pred, round(max(s1), 6) AS s1,
       round(max(s2), 6) AS s2, count(DISTINCT endpoint) AS endpoint_count, count(*) AS case_count
FROM cases GROUP BY entity""")
def entity_rollup_extreme(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.entity_extremes(cases(spark, sf), SCORES, "extreme"))


@query("entity_rollup_median", f"""WITH {CASES}, {CUTOFFS}
SELECT entity, round(min(y_true), 6) AS min_true, round(min(y_pred), 6) AS min_pred, round(max(s1), 6) AS s1,
       round(max(s2), 6) AS s2, count(*) AS endpoint_count, CAST(sum(case_count) AS BIGINT) AS case_count
FROM med GROUP BY entity""")
def entity_rollup_median(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.entity_extremes(cases(spark, sf), SCORES, "endpoint_median"))


RELATIVE = """
smed AS (SELECT split, entity, endpoint, median(y_true) AS y_true, median(y_pred) AS y_pred,
                median(s1) AS s1, median(s2) AS s2, count(*) AS case_count FROM cases GROUP BY ALL),
scut AS (SELECT split, endpoint, quantile_cont(y_true, 0.25) AS cutoff FROM smed GROUP BY ALL),
sflag AS (SELECT m.*, y_true <= cutoff AS th, y_pred <= cutoff AS ph FROM smed m JOIN scut USING (split, endpoint)),
spanel AS (SELECT split, entity, bool_or(th) AS true_high, bool_or(ph) AS pred_high,
                  bool_or(th AND NOT ph) AS any_miss, max(s1) AS s1, max(s2) AS s2,
                  count(*) AS endpoint_count FROM sflag GROUP BY ALL)
"""


@query("endpoint_relative_panel", f"""WITH {CASES}, {RELATIVE}
SELECT split, entity, true_high, pred_high, any_miss, round(s1, 6) AS s1, round(s2, 6) AS s2, endpoint_count FROM spanel""")
def endpoint_relative_panel(spark: SparkSession, sf: str) -> DataFrame:
    df = rollup.endpoint_relative_panel(cases(spark, sf), 0.25, SCORES, ["split"])
    return rounded(df.select("split", "entity", "true_high", "pred_high", "any_miss", *SCORES, "endpoint_count"))



OMISSION = f"""{n('true')} AS n_entities, {n('reviewed')} AS review_n, {n('NOT pred_high')} AS n_predicted_low,
  {n('true_high')} AS n_true_high, {n(MISS)} AS n_false_negative,
  {n(MISS + ' AND reviewed')} AS rescued_false_negative, {rate('reviewed', MISS)} AS false_negative_capture,
  {div(n(MISS + ' AND NOT reviewed'), n('true_high'))} AS high_concern_left_low_priority_fraction,
  {rate('true_high', 'NOT pred_high AND NOT reviewed')} AS lower_priority_false_omission_rate,
  {n('NOT pred_high')} >= {n('reviewed')} AS low_queue_capacity_sufficient"""


@query("omission_metrics", f"WITH {CASES}, {QUEUE} SELECT {OMISSION} FROM reviewed")
def omission_metrics(spark: SparkSession, sf: str) -> DataFrame:
    reviewed = ranking.review_flags(materialize(panel(spark, sf)), "s1", 0.25, policy="low_concern_first")
    return rounded(metrics.omission_metrics(reviewed))


@query("review_queue_low_first", f"WITH {CASES}, {QUEUE} SELECT entity, review_rank, reviewed FROM reviewed")
def review_queue_low_first(spark: SparkSession, sf: str) -> DataFrame:
    queue = ranking.review_queue(panel(spark, sf), "s1", 0.25, policy="low_concern_first")
    return queue.select("entity", "review_rank", "reviewed")


@query("review_queue_all", f"""WITH {CASES}, {PANEL},
q AS (SELECT entity, row_number() OVER (ORDER BY s2 DESC NULLS LAST, entity) AS review_rank, count(*) OVER () n FROM panel)
SELECT entity, review_rank, review_rank <= round_even(n * 0.1::DOUBLE, 0) AS reviewed FROM q""")
def review_queue_all(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.review_queue(panel(spark, sf), "s2", 0.1).select("entity", "review_rank", "reviewed")


@query("rank_entities", f"""WITH {CASES}, {PANEL},
q AS (SELECT entity, pred_high, row_number() OVER (ORDER BY pred_high, min_pred, entity) AS rank FROM panel)
SELECT entity, rank, rank <= 100 AS selected_for_review, 'threshold_proximity' AS ranking_rule,
  CASE WHEN pred_high THEN 'Already predicted high concern; after the low-concern queue'
       ELSE 'Smaller predicted margin above the concentration criterion' END AS selection_basis FROM q""")
def rank_entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel(spark, sf).select("entity", F.col("pred_high").alias("predicted_high"),
                                   F.col("min_pred").alias("margin_log10"))
    return ranking.rank_entities(rows, "hazard_omission", 100).drop("predicted_high", "margin_log10")


ENDPOINT_LABELS = {"A": "Accepted", "N": "New", "R": "Returned", "X": "Unseen"}


@query("queue_view", f"""WITH {CASES}, {PANEL},
q AS (SELECT entity, pred_high, row_number() OVER (ORDER BY pred_high, min_pred, entity) AS rank, count(*) OVER () AS n, min_pred FROM panel),
e AS (SELECT entity, list_sort(list(DISTINCT CASE endpoint WHEN 'A' THEN 'Accepted' WHEN 'N' THEN 'New' WHEN 'R' THEN 'Returned' ELSE endpoint END)) AS l FROM cases GROUP BY entity)
SELECT entity, round(min_pred, 6) AS review_score, array_to_string(l, '; ') AS represented_endpoints,
  array_to_string(list_filter(['Accepted', 'New', 'Returned', 'Unseen'], lambda x: NOT list_contains(l, x)), '; ') AS missing_endpoints,
  concat(rank, ' of ', n, ' with a quota of 100: ', CASE WHEN pred_high THEN 'Already predicted high concern; after the low-concern queue'
       ELSE 'Smaller predicted margin above the concentration criterion' END) AS review_reason,
  CASE WHEN pred_high THEN 'inside' ELSE 'outside' END AS criterion_position FROM q JOIN e USING (entity)""")
def queue_view(spark: SparkSession, sf: str) -> DataFrame:
    from quotaloom.plans import protocol

    rows = panel(spark, sf).select("entity", F.col("pred_high").alias("predicted_high"), F.col("min_pred").alias("margin_log10"),
                                   F.col("min_pred").alias("prediction"))
    ranked = ranking.rank_entities(rows, "hazard_omission", 100)
    view = protocol.queue_view(ranked, cases(spark, sf).select("entity", "endpoint"), ENDPOINT_LABELS, "hazard_omission", "threshold_proximity", 1.0, 100)
    return rounded(view.select("entity", "review_score", "represented_endpoints", "missing_endpoints", "review_reason", "criterion_position"))


@query("route_queue", f"""WITH {CASES}, {PANEL},
e AS (SELECT *, case_count >= 20 AS input_eligible FROM panel),
q AS (SELECT *, row_number() OVER (PARTITION BY input_eligible ORDER BY pred_high, s1 DESC NULLS LAST, entity) AS rn,
             count(*) OVER (PARTITION BY input_eligible) AS n FROM e),
r AS (SELECT *, input_eligible AND rn <= round_even(n * 0.25::DOUBLE, 0) AS reviewed FROM q)
SELECT entity, round(s1, 6) AS selected_score, CASE WHEN input_eligible THEN rn END AS review_rank, reviewed,
  CASE WHEN NOT input_eligible THEN 'withhold_review' WHEN pred_high AND reviewed THEN 'prioritize_testing'
       WHEN pred_high THEN 'screen_now' WHEN reviewed THEN 'withhold_review' ELSE 'lower_priority' END AS route,
  CASE WHEN NOT input_eligible THEN 'identity or molecular input did not pass eligibility checks'
       WHEN pred_high AND reviewed THEN 'higher predicted concern and selected for reliability review'
       WHEN pred_high THEN 'higher predicted concern and outside review subset'
       WHEN reviewed THEN 'lower predicted concern but selected for reliability review'
       ELSE 'lower predicted concern and outside review subset' END AS route_reason FROM r""")
def route_queue(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel(spark, sf).withColumn("input_eligible", F.col("case_count") >= 20)
    routed = routing.route_queue(rows, "s1", 0.25, "low_concern_first")
    return rounded(routed.select("entity", "selected_score", "review_rank", "reviewed", "route", "route_reason"))


CURVE = PANEL + """,
points AS (
  SELECT row_number() OVER w AS k, count(*) OVER () AS n,
         sum((true_high AND NOT pred_high)::INT) OVER w AS rescued, sum((NOT pred_high)::INT) OVER w AS low_reviewed,
         sum((true_high AND NOT pred_high)::INT) OVER () AS n_miss, sum((NOT pred_high)::INT) OVER () AS n_low,
         sum(true_high::INT) OVER () AS n_high
  FROM panel WINDOW w AS (ORDER BY pred_high, s1 DESC NULLS LAST, entity ROWS UNBOUNDED PRECEDING)),
curve0 AS (SELECT 0 AS k, n, 0 AS rescued, 0 AS low_reviewed, n_miss, n_low, n_high FROM points WHERE k = 1
           UNION ALL SELECT * FROM points),
curve AS (
  SELECT CAST(k AS BIGINT) AS k, n, CAST(rescued AS BIGINT) AS rescued, CAST(low_reviewed AS BIGINT) AS low_reviewed,
         k / n::DOUBLE AS workload, rescued / nullif(n_miss, 0)::DOUBLE AS capture,
         (n_miss - rescued) / nullif(n_high, 0)::DOUBLE AS left_low_fraction,
         (n_miss - rescued) / nullif(n_low - low_reviewed, 0)::DOUBLE AS false_omission_rate
  FROM curve0)
"""
CURVE_COLUMNS = ("k", "n", "rescued", "low_reviewed", "workload", "capture", "left_low_fraction", "false_omission_rate")
CURVE_SELECT = """k, n, rescued, low_reviewed, round(workload, 6) AS workload, round(capture, 6) AS capture,
  round(left_low_fraction, 6) AS left_low_fraction, round(false_omission_rate, 6) AS false_omission_rate"""


@query("workload_curve", f"WITH {CASES}, {CURVE} SELECT {CURVE_SELECT} FROM curve")
def workload_curve(spark: SparkSession, sf: str) -> DataFrame:
    curve = ranking.workload_curve(panel(spark, sf), "s1", policy="low_concern_first")
    return rounded(curve.select(*CURVE_COLUMNS))


@query("workload_grid", f"""WITH {CASES}, {CURVE},
g AS (SELECT i / 100.0::DOUBLE AS fraction FROM range(0, 101) t(i)),
t AS (SELECT fraction, CAST(round_even(n * fraction, 0) AS BIGINT) AS k FROM g, (SELECT max(n) AS n FROM curve))
SELECT round(fraction, 6) AS fraction, {CURVE_SELECT} FROM t JOIN curve USING (k)""")
def workload_grid(spark: SparkSession, sf: str) -> DataFrame:
    curve = ranking.workload_curve(panel(spark, sf), "s1", policy="low_concern_first")
    grid = ranking.grid_points(curve, [i / 100 for i in range(101)])
    return rounded(grid.select("fraction", *CURVE_COLUMNS))


@query("curve_area", f"""WITH {CASES}, {CURVE},
steps AS (SELECT workload - lag(workload) OVER (ORDER BY k) AS dx, capture + lag(capture) OVER (ORDER BY k) AS y FROM curve)
SELECT round(sum(dx * y / 2), 6) AS area FROM steps""")
def curve_area(spark: SparkSession, sf: str) -> DataFrame:
    curve = ranking.workload_curve(panel(spark, sf), "s1", policy="low_concern_first")
    return rounded(ranking.curve_area(curve, "capture"))


@query("grid_area", f"""WITH {CASES}, {CURVE},
g AS (SELECT i / 10.0::DOUBLE AS fraction FROM range(0, 11) t(i)),
t AS (SELECT fraction, CAST(round_even(n * fraction, 0) AS BIGINT) AS k FROM g, (SELECT max(n) AS n FROM curve)),
p AS (SELECT fraction, capture FROM t JOIN curve USING (k)),
s AS (SELECT fraction - lag(fraction) OVER w AS dx, capture + lag(capture) OVER w AS y FROM p WINDOW w AS (ORDER BY fraction))
SELECT 's1' AS method, round(sum(dx * y / 2), 6) AS area FROM s""")
def grid_area(spark: SparkSession, sf: str) -> DataFrame:
    curve = ranking.workload_curve(panel(spark, sf), "s1", policy="low_concern_first")
    grid = ranking.grid_points(curve, [i / 10 for i in range(11)]).withColumn("method", F.lit("s1"))
    return rounded(ranking.grid_area(grid, "fraction", "capture", ["method"]))


@query("random_reference", f"""WITH {CASES}, {PANEL},
b AS (SELECT count(*) AS n, {n('NOT pred_high')} AS lo, {n('true_high')} AS hi, {n(MISS)} AS fn FROM panel),
k AS (SELECT *, CAST(round_even(n * 0.25::DOUBLE, 0) AS BIGINT) AS k FROM b)
SELECT n AS n_entities, lo AS n_predicted_low, hi AS n_true_high, fn AS n_false_negative, k AS review_n,
  round(fn * (k / n::DOUBLE), 6) AS rescued_false_negative, CASE WHEN fn > 0 THEN round(k / n::DOUBLE, 6) END AS false_negative_capture,
  round(fn * (1 - k / n::DOUBLE) / nullif(hi, 0), 6) AS high_concern_left_low_priority_fraction,
  round(fn / nullif(lo, 0)::DOUBLE, 6) AS lower_priority_false_omission_rate,
  CASE WHEN fn > 0 THEN round(least(k / nullif(lo, 0)::DOUBLE, 1), 6) END AS low_capture FROM k""")
def random_reference(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.random_reference(panel(spark, sf), 0.25))


LONG = """
long AS (SELECT entity, true_high, pred_high, any_miss, 'first' AS method, s1 AS score FROM panel
         UNION ALL SELECT entity, true_high, pred_high, any_miss, 'second', s2 FROM panel)
"""
METHODS = {"first": "s1", "second": "s2"}
BURDENS = (0.05, 0.1, 0.25, 0.5)


@query("fixed_workload_grid", f"""WITH {CASES}, {PANEL}, {LONG},
q AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC NULLS LAST, entity) AS rn,
             count(*) OVER (PARTITION BY method) AS n FROM long),
b AS (SELECT unnest([0.05, 0.1, 0.25, 0.5])::DOUBLE AS fraction),
r AS (SELECT *, rn <= greatest(1, round_even(n * fraction, 0)) AS reviewed FROM q, b)
SELECT method, fraction, {n('reviewed')} AS review_count, {n('NOT pred_high AND NOT reviewed')} AS lower_priority_queue_size,
  {n(MISS + ' AND NOT reviewed')} AS high_concern_left_count, {n(MISS)} AS baseline_false_negatives,
  {n(MISS + ' AND reviewed')} AS rescued_false_negatives, {rate('reviewed', MISS)} AS rescued_fraction,
  {rate('true_high', 'NOT pred_high AND NOT reviewed')} AS lower_priority_false_omission_rate,
  {div(n(MISS + ' AND NOT reviewed'), n('true_high'))} AS high_concern_left_fraction,
  {div(n(MISS + ' AND reviewed') + ' * 100', n('reviewed'))} AS rescued_per_100_reviews,
  {n('pred_high AND reviewed')} AS prioritize_testing_count, {n('pred_high AND NOT reviewed')} AS screen_now_count,
  {n('NOT pred_high AND reviewed')} AS withhold_review_count
FROM r GROUP BY method, fraction""")
def fixed_workload_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(routing.fixed_workload(panel(spark, sf), METHODS, BURDENS, min_one=True))


@query("decision_baselines", f"""WITH {CASES}, {PANEL}, {LONG},
pol AS (SELECT unnest(['all_queue', 'low_concern_first']) AS policy),
q AS (SELECT *, row_number() OVER (PARTITION BY policy, method ORDER BY policy = 'low_concern_first' AND pred_high, score DESC NULLS LAST, entity) AS rn,
             count(*) OVER (PARTITION BY policy, method) AS n FROM long, pol),
r AS (SELECT *, rn <= round_even(n * 0.25::DOUBLE, 0) AS reviewed FROM q),
m AS (SELECT policy, method, {OMISSION} FROM r GROUP BY policy, method),
c AS (SELECT count(*) AS n, {n('NOT pred_high')} AS lo, {n('true_high')} AS hi, {n(MISS)} AS fn,
             CAST(round_even(count(*) * 0.25::DOUBLE, 0) AS BIGINT) AS k FROM panel)
SELECT policy, method, n_entities, review_n, n_predicted_low, n_true_high, n_false_negative,
  rescued_false_negative::DOUBLE AS rescued_false_negative, false_negative_capture,
  high_concern_left_low_priority_fraction, lower_priority_false_omission_rate, low_queue_capacity_sufficient FROM m
UNION ALL
SELECT policy, 'random_review', n, k, lo, hi, fn, round(fn * k / n::DOUBLE, 6), CASE WHEN fn > 0 THEN round(k / n::DOUBLE, 6) END,
  round(fn * (1 - k / n::DOUBLE) / nullif(hi, 0), 6), round(fn / nullif(lo, 0)::DOUBLE, 6), lo >= k FROM c, pol""")
def decision_baselines(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(routing.decision_baselines(panel(spark, sf), METHODS, 0.25))


@query("evaluate_signals", f"""WITH {CASES}, {PANEL}, {LONG},
q AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC NULLS LAST, entity) AS rn,
             count(*) OVER (PARTITION BY method) AS n FROM long),
reviewed AS (SELECT *, rn <= round_even(n * 0.25::DOUBLE, 0) AS reviewed FROM q)
SELECT method AS signal, {OMISSION} FROM reviewed GROUP BY method""")
def evaluate_signals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(routing.evaluate_signals(panel(spark, sf), METHODS, "false_negative_capture").drop("candidate_order"))


ERROR_LONG = """
elong AS (SELECT entity, abs_error, loss, pred_high, 'first' AS signal, s1 AS score, 0 AS o FROM panel
          UNION ALL SELECT entity, abs_error, loss, pred_high, 'second', s2, 1 FROM panel),
elim AS (SELECT quantile_cont(abs_error, 0.9) AS lim FROM panel),
erank AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY score DESC NULLS LAST, entity) AS rn,
                 count(*) OVER (PARTITION BY signal) AS n,
                 avg(abs_error) OVER (PARTITION BY signal ORDER BY score, entity ROWS UNBOUNDED PRECEDING) AS risk,
                 row_number() OVER (PARTITION BY signal ORDER BY score, entity) AS rr FROM elong),
emetric AS (SELECT signal, any_value(o) AS o,
   count(*) FILTER (WHERE rn <= round_even(n * 0.25::DOUBLE, 0)) AS review_n,
   count(*) FILTER (WHERE abs_error >= lim AND rn <= round_even(n * 0.25::DOUBLE, 0)) / count(*) FILTER (WHERE abs_error >= lim)::DOUBLE AS capture,
   (sum(risk) - sum(risk) FILTER (WHERE rr = 1 OR rr = n) / 2) / max(n) AS aurc
  FROM erank, elim GROUP BY signal)
"""


def error_panel(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).select("entity", "pred_high", "loss", "s1", "s2", F.lit(0.0).alias("y_true"),
                                   F.col("abs_error").alias("y_pred"))


@query("evaluate_error_signals", f"""WITH {CASES}, {PANEL}, {ERROR_LONG}
SELECT signal, review_n, round(capture, 6) AS largest_error_capture, round(aurc, 6) AS aurc FROM emetric""")
def evaluate_error_signals(spark: SparkSession, sf: str) -> DataFrame:
    df = routing.evaluate_signals(error_panel(spark, sf), METHODS, "overall_error_ranking")
    return rounded(df.drop("candidate_order"))


@query("evaluate_loss_signals", f"""WITH {CASES}, {PANEL}, {ERROR_LONG},
c AS (SELECT signal, rn, n, sum(loss) OVER (PARTITION BY signal ORDER BY rn) / nullif(sum(loss) OVER (PARTITION BY signal), 0) AS share FROM erank)
SELECT signal, round((sum(share) - max(share) FILTER (WHERE rn = n) / 2) / max(n), 6) AS directional_underprediction_capture_area,
       round(max(share) FILTER (WHERE rn = round_even(n * 0.25::DOUBLE, 0)), 6) AS directional_underprediction_capture
FROM c GROUP BY signal""")
def evaluate_loss_signals(spark: SparkSession, sf: str) -> DataFrame:
    df = routing.evaluate_signals(panel(spark, sf), METHODS, "directional_underprediction_area")
    return rounded(df.drop("candidate_order"))


@query("select_signal", f"""WITH {CASES}, {PANEL}, {ERROR_LONG}
SELECT signal AS selected_signal, 'development_labels' AS selection_source FROM emetric ORDER BY aurc, capture DESC, o LIMIT 1""")
def select_signal(spark: SparkSession, sf: str) -> DataFrame:
    df = routing.evaluate_signals(error_panel(spark, sf), METHODS, "overall_error_ranking")
    return routing.select_signal(df, "overall_error_ranking", "first")


TWO_STAGE = PANEL + f""",
st1 AS (SELECT *, row_number() OVER (ORDER BY pred_high, s1 DESC NULLS LAST, entity) AS rn, count(*) OVER () AS n FROM panel),
first AS (SELECT *, rn <= round_even(n * 0.25::DOUBLE, 0) AS first, CAST(round_even(n * 0.25::DOUBLE, 0) AS BIGINT) AS k FROM st1),
residual AS (SELECT * FROM first WHERE NOT pred_high AND NOT first)
"""


@query("residual_triage", f"""WITH {CASES}, {TWO_STAGE},
s2r AS (SELECT *, row_number() OVER (ORDER BY s2 DESC NULLS LAST, entity) AS r2, count(*) OVER () AS nr FROM residual),
ex AS (SELECT *, least(k, nr) AS extra FROM s2r),
agg AS (SELECT max(k) AS initial_review_n, max(nr) AS n_residual, max(extra) AS additional_review_n, {n('any_miss')} AS fn,
               {n('any_miss AND r2 <= extra')} AS saved FROM ex)
SELECT 'second' AS method, initial_review_n, n_residual, additional_review_n, fn AS residual_false_negative_n,
       saved::DOUBLE AS residual_rescued, round(saved / nullif(fn, 0)::DOUBLE, 6) AS residual_capture FROM agg
UNION ALL SELECT 'random_second_stage', initial_review_n, n_residual, additional_review_n, fn,
       round(fn * additional_review_n / n_residual::DOUBLE, 6),
       CASE WHEN fn > 0 THEN round(additional_review_n / n_residual::DOUBLE, 6) END FROM agg""")
def residual_triage(spark: SparkSession, sf: str) -> DataFrame:
    second = routing.two_stage_review(panel(spark, sf), "s1", {"second": "s2"})
    return rounded(routing.residual_triage(second))


@query("matched_queue", f"""WITH {CASES}, {TWO_STAGE},
single AS (SELECT *, row_number() OVER (ORDER BY pred_high, s2 DESC NULLS LAST, entity) <= k AS single FROM first),
sec AS (SELECT s.*, NOT pred_high AND NOT first AS residual,
          NOT pred_high AND NOT first AND row_number() OVER (ORDER BY pred_high OR first, s2 DESC NULLS LAST, entity)
          <= least(k, sum((NOT pred_high AND NOT first)::INT) OVER ()) AS second FROM single s),
f AS (SELECT *, true_high AND NOT pred_high AS miss, first OR second AS combined FROM sec)
SELECT 'second' AS method, {rate('single', 'miss')} AS single_capture, {rate('miss', 'NOT pred_high AND NOT single')} AS single_for,
  {rate('second', 'miss AND residual')} AS second_capture, {rate('combined', 'miss')} AS combined_capture,
  {rate('miss', 'NOT pred_high AND NOT combined')} AS combined_for FROM f""")
def matched_queue(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(routing.matched_queue(panel(spark, sf), "s1", {"second": "s2"}))


@query("matched_queue_random", f"""WITH {CASES}, {PANEL},
c AS (SELECT round_even(count(*) * 0.25::DOUBLE, 0) AS k, {n('NOT pred_high')} AS lo, {n(MISS)} AS fn FROM panel)
SELECT CASE WHEN fn > 0 THEN round(least(k / nullif(lo, 0)::DOUBLE, 1), 6) END AS capture,
       CASE WHEN lo > k THEN round(fn / lo::DOUBLE, 6) END AS false_omission_rate FROM c""")
def matched_queue_random(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(routing.matched_queue_random(panel(spark, sf)))


DISAGREE = PANEL + """,
pair AS (SELECT *, row_number() OVER (ORDER BY pred_high, s1 DESC NULLS LAST, entity) <= round_even(count(*) OVER () * 0.25::DOUBLE, 0) AS ra,
                   row_number() OVER (ORDER BY pred_high, s2 DESC NULLS LAST, entity) <= round_even(count(*) OVER () * 0.25::DOUBLE, 0) AS rb FROM panel),
cat AS (SELECT *, CASE WHEN NOT any_miss THEN 'not_baseline_false_negative' WHEN ra AND rb THEN 'both_rescued'
          WHEN ra THEN 'first_only_rescued' WHEN rb THEN 'second_only_rescued' ELSE 'both_omitted' END AS disagreement_category FROM pair)
"""


@query("disagreement_categories", f"""WITH {CASES}, {DISAGREE}
SELECT disagreement_category, count(*) AS n_entities, round(avg(endpoint_count), 6) AS mean_endpoints,
       round(avg(s1), 6) AS mean_s1, round(avg(s2), 6) AS mean_s2 FROM cat GROUP BY ALL""")
def disagreement_categories(spark: SparkSession, sf: str) -> DataFrame:
    cat = routing.disagreement(panel(spark, sf), ("first", "s1"), ("second", "s2"))
    return rounded(cat.groupBy("disagreement_category").agg(
        F.count("*").alias("n_entities"), F.avg("endpoint_count").alias("mean_endpoints"),
        F.avg("s1").alias("mean_s1"), F.avg("s2").alias("mean_s2")))


@query("disagreement_rates", f"""WITH {CASES}, {DISAGREE},
dims AS (SELECT unnest(['both_rescued', 'first_only_rescued', 'second_only_rescued', 'both_omitted']) AS disagreement_category),
c AS (SELECT disagreement_category, count(*) AS k FROM cat WHERE any_miss GROUP BY ALL)
SELECT disagreement_category, coalesce(k, 0) AS n_misses,
  round(coalesce(k, 0) / nullif((SELECT sum(k) FROM c), 0)::DOUBLE, 6) AS rate FROM dims LEFT JOIN c USING (disagreement_category)""")
def disagreement_rates(spark: SparkSession, sf: str) -> DataFrame:
    cat = routing.disagreement(panel(spark, sf), ("first", "s1"), ("second", "s2"))
    return rounded(routing.disagreement_rates(cat, "first", "second"))


@query("absolute_thresholds", f"""WITH {CASES}, {CUTOFFS},
w AS (SELECT entity, min(y_true) AS t, min(y_pred) AS p, max(s1) AS s1 FROM med GROUP BY entity),
g AS (SELECT *, t <= threshold + 1e-12 AS true_high, p <= threshold + 1e-12 AS pred_high
      FROM w, (SELECT unnest([3.5, 4.0, 4.3])::DOUBLE AS threshold)),
q AS (SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY pred_high, s1 DESC NULLS LAST, entity)
              <= round_even(count(*) OVER (PARTITION BY threshold) * 0.25::DOUBLE, 0) AS reviewed FROM g)
SELECT threshold, {OMISSION} FROM q GROUP BY threshold""")
def absolute_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    rows = rollup.absolute_panel(cases(spark, sf), [3.5, 4.0, 4.3], scores=["s1"])
    reviewed = ranking.review_flags(materialize(rows), "s1", 0.25, panel=["threshold"], policy="low_concern_first")
    return rounded(metrics.omission_metrics(reviewed, ["threshold"]))


@query("direct_rule", f"""WITH {CASES}, {CUTOFFS},
w AS (SELECT entity, min(y_true) AS t, min(y_pred) AS p, max(s2) AS s FROM med GROUP BY entity),
l AS (SELECT quantile_cont(t, 0.25) AS tc, quantile_cont(s, 0.75) AS sc FROM w),
c AS (SELECT *, t <= tc AS true_high, p <= tc AS pred_high, s >= sc AS reviewed FROM w, l)
SELECT 'all' AS run, count(*) AS n_cases, round(max(tc), 6) AS toxicity_cutoff, round(max(sc), 6) AS score_cutoff,
  {rate('true_high', 'NOT pred_high')} AS baseline_false_omission_rate,
  {rate('true_high', 'NOT pred_high AND NOT reviewed')} AS routed_false_omission_rate,
  {n('NOT pred_high')} AS baseline_queue_size, {n('NOT pred_high AND NOT reviewed')} AS routed_queue_size,
  {n(MISS)} AS baseline_false_negatives, {n(MISS + ' AND reviewed')} AS rescued_false_negatives,
  {rate('reviewed', MISS)} AS rescued_fraction, {n('pred_high AND NOT reviewed')} AS screen_now_count,
  {n('pred_high AND reviewed')} AS prioritize_testing_count, {n('NOT pred_high AND reviewed')} AS withhold_review_count,
  {n('NOT pred_high AND NOT reviewed')} AS lower_priority_count FROM c""")
def direct_rule(spark: SparkSession, sf: str) -> DataFrame:
    rows = rollup.entity_extremes(cases(spark, sf), SCORES).withColumn("run", F.lit("all"))
    return rounded(metrics.direct_rule_summary(metrics.direct_rule(rows, "s2", ["run"]), ["run"]))


@query("action_decision_map", f"""WITH {CASES}, {QUEUE}
SELECT CASE WHEN pred_high AND reviewed THEN 'prioritize_testing' WHEN pred_high THEN 'screen_now'
            WHEN reviewed THEN 'withhold_review' ELSE 'lower_priority' END AS screening_action,
       count(*) AS n_entities, round(sqrt(avg(abs_error * abs_error)), 6) AS rmse,
       round(avg(true_high::INT), 6) AS high_fraction FROM reviewed GROUP BY ALL""")
def action_decision_map(spark: SparkSession, sf: str) -> DataFrame:
    queue = ranking.review_flags(materialize(panel(spark, sf)), "s1", 0.25, policy="low_concern_first")
    return rounded(routing.action_map(queue, "abs_error"))


@query("concern_threshold_sensitivity", f"""WITH {CASES}, {CUTOFFS},
lv AS (SELECT unnest([0.1, 0.25, 0.5])::DOUBLE AS level),
c AS (SELECT level, endpoint, CASE level WHEN 0.1 THEN quantile_cont(y_true, 0.1) WHEN 0.25 THEN quantile_cont(y_true, 0.25) ELSE quantile_cont(y_true, 0.5) END AS cutoff
      FROM med, lv GROUP BY level, endpoint),
p AS (SELECT level, entity, bool_or(y_true <= c.cutoff) AS true_high, bool_or(y_pred <= c.cutoff) AS pred_high, max(s1) AS s1
      FROM med m JOIN c ON m.endpoint = c.endpoint GROUP BY level, entity),
r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY pred_high, s1 DESC NULLS LAST, entity)
       <= round_even(count(*) OVER (PARTITION BY level) * 0.25::DOUBLE, 0) AS reviewed FROM p)
SELECT level, {OMISSION} FROM r GROUP BY level""")
def concern_threshold_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    rows = rollup.cutoff_sensitivity(cases(spark, sf), (0.1, 0.25, 0.5), ["s1"])
    reviewed = ranking.review_flags(materialize(rows), "s1", 0.25, panel=["level"], policy="low_concern_first")
    return rounded(metrics.omission_metrics(reviewed, ["level"]))


@query("frozen_cutoff_macro", f"""WITH {CASES},
cm AS (SELECT entity, endpoint, median(y_true) AS m FROM cases WHERE study_year <= 1995 GROUP BY ALL),
fc AS (SELECT endpoint, quantile_cont(m, 0.25) AS cutoff FROM cm GROUP BY endpoint),
em AS (SELECT study_year, entity, endpoint, median(y_true) AS t, median(y_pred) AS p, median(s1) AS s1
       FROM cases WHERE study_year > 1995 GROUP BY ALL),
pp AS (SELECT study_year, entity, bool_or(t <= cutoff) AS true_high, bool_or(p <= cutoff) AS pred_high, max(s1) AS s1
       FROM em JOIN fc USING (endpoint) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY study_year ORDER BY pred_high, s1 DESC NULLS LAST, entity)
       <= round_even(count(*) OVER (PARTITION BY study_year) * 0.25::DOUBLE, 0) AS reviewed FROM pp),
m AS (SELECT study_year, {n(MISS + ' AND reviewed')} / nullif({n(MISS)}, 0)::DOUBLE AS c,
             {n(MISS + ' AND NOT reviewed')} / nullif({n('NOT pred_high AND NOT reviewed')}, 0)::DOUBLE AS f FROM r GROUP BY study_year)
SELECT 'later_years' AS dataset, round(avg(c), 6) AS false_negative_capture_mean, round(stddev_samp(c), 6) AS false_negative_capture_sd,
  round(avg(f), 6) AS lower_priority_false_omission_rate_mean, round(stddev_samp(f), 6) AS lower_priority_false_omission_rate_sd FROM m""")
def frozen_cutoff_macro(spark: SparkSession, sf: str) -> DataFrame:
    rows = cases(spark, sf)
    cut = rollup.concern_cutoffs(rows.where("study_year <= 1995"))
    return rounded(routing.frozen_evaluation(rows.where("study_year > 1995"), cut, "s1", ["study_year"], "later_years"))
