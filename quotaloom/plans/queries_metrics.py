"""Metric, calibration and correlation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaloom.operators import ablation, calibrate, metrics, ranking
from quotaloom.plans.queries_review import METHODS, n, panel, rate
from quotaloom.plans.registry import query
from quotaloom.plans.testbed import CASES, PANEL, cases, rounded, table


def ranked(col: str, by: str = "") -> str:
    """Tie-averaged rank."""
    part = f"PARTITION BY {by} " if by else ""
    also = f"{by}, " if by else ""
    return (f"(rank() OVER ({part}ORDER BY {col}) + (count(*) OVER (PARTITION BY {also}{col}) - 1) / 2.0::DOUBLE)")


@query("regression_metrics", f"""WITH {CASES},
r AS (SELECT *, {ranked('y_true', 'endpoint')} AS ra, {ranked('y_pred', 'endpoint')} AS rb FROM cases)
SELECT endpoint, count(*) AS n_rows, round(sqrt(avg((y_pred - y_true) ** 2)), 6) AS rmse,
  round(avg(abs(y_pred - y_true)), 6) AS mae, round(avg(y_pred - y_true), 6) AS bias,
  round(corr(ra, rb), 6) AS spearman FROM r GROUP BY endpoint""")
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.regression_metrics(cases(spark, sf), "y_true", "y_pred", ["endpoint"]))


@query("interval_metrics", f"""WITH {CASES},
i AS (SELECT *, y_pred - 0.3::DOUBLE - s1 AS lo, y_pred + 0.3::DOUBLE + s1 AS hi FROM cases),
e AS (SELECT *, abs(y_true - (lo + hi) / 2) AS err FROM i)
SELECT endpoint, round(avg((y_true BETWEEN lo AND hi)::INT), 6) AS coverage, round(avg(hi - lo), 6) AS mean_interval_width,
  round(corr(s1, err), 6) AS uncertainty_error_corr, round(corr(s1, s2), 6) AS uncertainty_novelty_corr
FROM e GROUP BY endpoint""")
def interval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = cases(spark, sf).select("*", (F.col("y_pred") - 0.3 - F.col("s1")).alias("lo"),
                                   (F.col("y_pred") + 0.3 + F.col("s1")).alias("hi"))
    return rounded(metrics.interval_metrics(rows, "y_true", "lo", "hi", "s1", "s2", ["endpoint"]))


@query("risk_coverage", f"""WITH {CASES}
SELECT case_id, row_number() OVER w AS rank, round(row_number() OVER w / count(*) OVER ()::DOUBLE, 6) AS coverage,
  round(avg(abs(y_pred - y_true)) OVER (ORDER BY s2, case_id ROWS UNBOUNDED PRECEDING), 6) AS risk
FROM cases WINDOW w AS (ORDER BY s2, case_id)""")
def risk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = cases(spark, sf).withColumn("error", F.abs(F.col("y_pred") - F.col("y_true")))
    return rounded(ranking.risk_coverage(rows, "error", "s2").drop("panel_rows"))


@query("selective_risk", f"""WITH {CASES},
r AS (SELECT *, abs(y_pred - y_true) AS e, row_number() OVER (PARTITION BY endpoint ORDER BY s2, case_id) AS rn,
             count(*) OVER (PARTITION BY endpoint) AS n FROM cases),
l AS (SELECT endpoint, quantile_cont(abs(y_pred - y_true), 0.9) AS lim FROM cases GROUP BY endpoint),
g AS (SELECT r.*, lim, a, rn <= greatest(1, floor(n * (1 - a))) AS kept FROM r JOIN l USING (endpoint), (SELECT unnest([0.0, 0.2, 0.4])::DOUBLE AS a))
SELECT endpoint, a AS abstain_fraction, round({n('kept')} / max(n)::DOUBLE, 6) AS retained_fraction,
  round(sqrt(avg(e * e) FILTER (WHERE kept)), 6) AS rmse, round(avg(e) FILTER (WHERE kept), 6) AS mae,
  round(avg((e >= lim)::INT) FILTER (WHERE kept), 6) AS top_decile_error_rate,
  round(avg((e >= lim)::INT) - avg((e >= lim)::INT) FILTER (WHERE kept), 6) + 0 AS top_decile_error_rate_reduction,
  round(avg(e) - avg(e) FILTER (WHERE kept), 6) + 0 AS error_reduction
FROM g GROUP BY endpoint, a""")
def selective_risk(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.selective_risk(cases(spark, sf), "y_true", "y_pred", "s2", [0.0, 0.2, 0.4], panel=["endpoint"]))


def separation(rows: str, by: str) -> str:
    """AUROC, AP and FPR95 of ``rows(by, score, pos)`` as CTEs ending in ``sep``."""
    return f"""
sc AS (SELECT {by}, score, {n('pos')} AS p, {n('NOT pos')} AS q FROM {rows} GROUP BY ALL),
cu AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY {by}) AS tot_p,
              sum(q) OVER (PARTITION BY {by}) AS tot_q FROM sc WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)),
sep AS (SELECT {by}, sum(p * ((tot_q - fp) + q / 2.0::DOUBLE)) / nullif((max(tot_p) * max(tot_q))::DOUBLE, 0) AS auroc,
   sum(p * tp / (tp + fp)::DOUBLE) / nullif(max(tot_p)::DOUBLE, 0) AS average_precision,
   min(fp / nullif(tot_q::DOUBLE, 0)) FILTER (WHERE tot_p > 0 AND tp >= tot_p * 0.95::DOUBLE) AS fpr95 FROM cu GROUP BY {by})"""


@query("auroc_ap_fpr95", f"""WITH d AS (
  SELECT lang, n_chars::DOUBLE AS score, toxic = 1 AS pos FROM documents JOIN labels USING (doc_id)), {separation('d', 'lang')}
SELECT lang, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision, round(fpr95, 6) AS fpr95 FROM sep""")
def auroc_ap_fpr95(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    rows = rows.withColumn("pos", F.col("toxic") == 1)
    return rounded(metrics.class_separation(rows, "pos", "n_chars", ["lang"]))


@query("score_summary", f"""WITH {CASES},
l AS (SELECT case_id, abs(y_pred - y_true) AS e, split = 'O' AS pos, 'first' AS method, s1 AS score FROM cases
      UNION ALL SELECT case_id, abs(y_pred - y_true), split = 'O', 'second', s2 FROM cases), {separation('l', 'method')},
rk AS (SELECT *, avg(e) OVER (PARTITION BY method ORDER BY score, case_id ROWS UNBOUNDED PRECEDING) AS risk,
              row_number() OVER (PARTITION BY method ORDER BY score, case_id) AS rn, count(*) OVER (PARTITION BY method) AS n FROM l),
au AS (SELECT method, (sum(risk) - sum(risk) FILTER (WHERE rn = 1 OR rn = n) / 2) / max(n) AS aurc FROM rk GROUP BY method),
q AS (SELECT method, quantile_cont(e, 0.9) AS el, quantile_cont(score, 0.8) AS sl FROM l GROUP BY method),
c AS (SELECT method, avg((score >= sl)::INT) FILTER (WHERE e >= el) AS cap FROM l JOIN q USING (method) GROUP BY method),
m AS (SELECT method, sum(score::DECIMAL(18, 6))::DOUBLE / count(score) AS a, stddev_pop(score) AS s FROM l GROUP BY method)
SELECT method, round(a, 6) AS score_mean, round(s, 6) AS score_std, round(aurc, 6) AS aurc, round(cap, 6) AS top_decile_error_capture,
  round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision, round(fpr95, 6) AS fpr95
FROM m JOIN au USING (method) JOIN c USING (method) JOIN sep USING (method)""")
def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = cases(spark, sf).withColumn("shifted", F.col("split") == "O")
    out = metrics.score_summary(rows, METHODS, "y_true", "y_pred", "shifted")
    return rounded(out)


@query("spearman_matrix", f"""WITH {CASES}, {PANEL},
r AS (SELECT {ranked('s1')} AS s1, {ranked('s2')} AS s2, {ranked('abs_error')} AS abs_error, {ranked('case_count')} AS case_count FROM panel),
v AS (SELECT corr(s1, s2) a, corr(s1, abs_error) b, corr(s1, case_count) c, corr(s2, abs_error) d, corr(s2, case_count) e, corr(abs_error, case_count) f FROM r)
SELECT k[1] AS "left", k[2] AS "right", round(x, 6) AS spearman FROM (
  SELECT unnest([['s1','s1'],['s2','s2'],['abs_error','abs_error'],['case_count','case_count'],['s1','s2'],['s1','abs_error'],['s1','case_count'],
                 ['s2','abs_error'],['s2','case_count'],['abs_error','case_count']]) AS k,
         unnest([1.0,1.0,1.0,1.0,a,b,c,d,e,f]::DOUBLE[]) AS x FROM v)""")
def spearman_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel(spark, sf).select("entity", "s1", "s2", "abs_error", F.col("case_count").cast("double"))
    return rounded(metrics.rank_correlation_matrix(rows, ["s1", "s2", "abs_error", "case_count"], "entity"))


@query("fixed_burden", f"""WITH {CASES}, {PANEL},
l AS (SELECT entity, abs_error, 'first' AS method, s1 AS score FROM panel UNION ALL SELECT entity, abs_error, 'second', s2 FROM panel),
q AS (SELECT quantile_cont(abs_error, 0.9) AS lim FROM panel),
r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, entity) <= greatest(1, round_even(count(*) OVER (PARTITION BY method) * 0.25::DOUBLE, 0)) AS sel FROM l, q)
SELECT method, {n('sel')} AS review_n, {n('abs_error >= lim')} AS n_high_error, {n('sel AND abs_error >= lim')} AS n_captured,
  {rate('sel', 'abs_error >= lim')} AS capture, {rate('abs_error >= lim', 'sel')} AS precision FROM r GROUP BY method""")
def fixed_burden(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.fixed_burden(panel(spark, sf), METHODS, "abs_error", "entity", 0.25))


@query("decile_overlap", f"""WITH {CASES}, {PANEL},
t AS (SELECT *, row_number() OVER (ORDER BY abs_error DESC, entity) <= greatest(1, ceil(count(*) OVER () * 0.1::DOUBLE)) AS hi FROM panel),
l AS (SELECT entity, hi, 'first' AS method, s1 AS score FROM t UNION ALL SELECT entity, hi, 'second', s2 FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, entity) <= greatest(1, round_even(count(*) OVER (PARTITION BY method) * 0.25::DOUBLE, 0)) AS sel FROM l)
SELECT method, {n('sel')} AS review_n, {n('hi')} AS n_high_error, {n('sel AND hi')} AS n_captured, {rate('sel', 'hi')} AS capture FROM r GROUP BY method""")
def decile_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.decile_overlap(panel(spark, sf), METHODS, "abs_error", "entity"))


@query("mean_sd", f"""WITH {CASES} SELECT endpoint, split, round(avg(y_true), 6) AS y_true_mean, round(stddev_samp(y_true), 6) AS y_true_sd,
  round(avg(s2), 6) AS s2_mean, round(stddev_samp(s2), 6) AS s2_sd FROM cases GROUP BY ALL""")
def mean_sd(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.mean_sd(cases(spark, sf), ["endpoint", "split"], ["y_true", "s2"]))


@query("macro_average", f"""WITH {CASES}, i AS (SELECT endpoint, study_year, avg(y_true) AS y_true, avg(s2) AS s2 FROM cases GROUP BY ALL)
SELECT endpoint, round(avg(y_true), 6) AS y_true_mean, round(stddev_samp(y_true), 6) AS y_true_sd, round(avg(s2), 6) AS s2_mean,
  round(stddev_samp(s2), 6) AS s2_sd FROM i GROUP BY endpoint""")
def macro_average(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.macro_average(cases(spark, sf), ["endpoint"], ["study_year"], ["y_true", "s2"]))


@query("pooled_and_endpoint", f"""WITH {CASES}
SELECT CASE WHEN grouping(endpoint) = 0 THEN endpoint ELSE 'pooled' END AS endpoint, count(*) AS n_rows,
  round(sqrt(avg((y_pred - y_true) ** 2)), 6) AS rmse, count(DISTINCT entity) AS n_entities
FROM cases GROUP BY GROUPING SETS ((endpoint), ())""")
def pooled_and_endpoint(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("y_pred") - F.col("y_true")
    return rounded(metrics.pooled_and_grouped(cases(spark, sf), "endpoint", [
        F.count("*").alias("n_rows"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.count_distinct("entity").alias("n_entities")]))


@query("seen_unseen_metrics", f"""WITH {CASES},
seen AS (SELECT DISTINCT entity FROM cases WHERE split = 'F'),
t AS (SELECT c.*, s.entity IS NOT NULL AS seen_entity FROM cases c LEFT JOIN seen s USING (entity) WHERE split = 'O')
SELECT CASE WHEN grouping(seen_entity) = 1 THEN 'pooled' WHEN seen_entity THEN 'seen' ELSE 'unseen' END AS subset,
  count(*) AS n_rows, round(avg(abs(y_pred - y_true)), 6) AS mae FROM t GROUP BY GROUPING SETS ((seen_entity), ())""")
def seen_unseen_metrics(spark: SparkSession, sf: str) -> DataFrame:
    from quotaloom.operators.joins import membership_flag

    rows = cases(spark, sf)
    test = membership_flag(rows.where("split = 'O'"), rows.where("split = 'F'"), ["entity"], "seen")
    test = test.withColumn("subset", F.when(F.col("seen"), "seen").otherwise("unseen"))
    return rounded(metrics.pooled_and_grouped(test, "subset", [
        F.count("*").alias("n_rows"), F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae")]))


@query("method_difference", f"""WITH {CASES}, {PANEL},
l AS (SELECT pred_high AS stratum, 'first' AS method, avg(s1) AS v FROM panel GROUP BY ALL UNION ALL SELECT pred_high, 'second', avg(s2) FROM panel GROUP BY ALL)
SELECT a.stratum, a.method, round(a.v, 6) AS v, round(a.v - b.v, 6) + 0 AS v_difference FROM l a JOIN l b ON a.stratum = b.stratum AND b.method = 'first'""")
def method_difference(spark: SparkSession, sf: str) -> DataFrame:
    long = ranking.melt_scores(panel(spark, sf).withColumnRenamed("pred_high", "stratum"), METHODS)
    per = long.groupBy("stratum", "method").agg(F.avg("score").alias("v"))
    return rounded(metrics.difference_from(per, ["stratum"], "method", "first", ["v"]))


@query("coefficient_stability", f"""WITH {CASES}, r AS (SELECT study_year, corr(s1, y_pred - y_true) AS c1, corr(s2, y_pred - y_true) AS c2 FROM cases GROUP BY ALL),
l AS (SELECT 'c1' AS name, c1 AS v FROM r UNION ALL SELECT 'c2', c2 FROM r)
SELECT name, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(avg((v > 0)::INT), 6) AS positive_fraction, count(*) AS n_values
FROM l WHERE v IS NOT NULL GROUP BY name""")
def coefficient_stability(spark: SparkSession, sf: str) -> DataFrame:
    gap = F.col("y_pred") - F.col("y_true")
    per = cases(spark, sf).groupBy("study_year").agg(F.corr("s1", gap).alias("c1"), F.corr("s2", gap).alias("c2"))
    long = per.unpivot(["study_year"], ["c1", "c2"], "name", "v")
    return rounded(metrics.signed_rate(long, ["name"], "v"))


CAL = """
cal AS (SELECT *, abs(y_true - y_pred) / greatest(s1, 1e-6) AS sc FROM cases WHERE split = 'F'),
tst AS (SELECT * FROM cases WHERE split = 'O')
"""


@query("conformal_intervals", f"""WITH {CASES}, {CAL},
o AS (SELECT sc, row_number() OVER (ORDER BY sc) AS rn, count(*) OVER () AS n FROM cal),
q AS (SELECT min(sc) AS qhat FROM o WHERE rn = least(greatest(ceil((n + 1) * (1 - 0.1::DOUBLE)), 1), n))
SELECT case_id, round(y_pred - qhat * greatest(s1, 1e-6), 6) + 0 AS lower, round(y_pred + qhat * greatest(s1, 1e-6), 6) + 0 AS upper,
  round(2 * qhat * greatest(s1, 1e-6), 6) AS width FROM tst, q""")
def conformal_intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows = cases(spark, sf)
    fitted = calibrate.conformal_quantile(rows.where("split = 'F'"), "y_true", "y_pred", "s1", [0.1])
    out = calibrate.conformal_intervals(rows.where("split = 'O'"), fitted, "y_pred", "s1")
    return rounded(out.select("case_id", "lower", "upper", "width"))


@query("group_conformal", f"""WITH {CASES},
cal AS (SELECT *, abs(y_true - y_pred) AS sc FROM cases WHERE split = 'F'),
o AS (SELECT source_id, sc, row_number() OVER (PARTITION BY source_id ORDER BY sc) AS rn, count(*) OVER (PARTITION BY source_id) AS n FROM cal),
q AS (SELECT source_id, min(sc) AS own FROM o WHERE n >= 280 AND rn = least(greatest(ceil((n + 1) * (1 - 0.1::DOUBLE)), 1), n) GROUP BY source_id),
po AS (SELECT sc, row_number() OVER (ORDER BY sc) AS rn, count(*) OVER () AS n FROM cal),
p AS (SELECT min(sc) AS pooled FROM po WHERE rn = least(greatest(ceil((n + 1) * (1 - 0.1::DOUBLE)), 1), n))
SELECT case_id, round(coalesce(own, pooled), 6) AS qhat, round(y_pred - coalesce(own, pooled), 6) + 0 AS lower,
  round(y_pred + coalesce(own, pooled), 6) + 0 AS upper, round(2 * coalesce(own, pooled), 6) AS width
FROM (SELECT * FROM cases WHERE split = 'O') t LEFT JOIN q USING (source_id), p""")
def group_conformal(spark: SparkSession, sf: str) -> DataFrame:
    rows = cases(spark, sf)
    out = calibrate.group_conformal(rows.where("split = 'F'"), rows.where("split = 'O'"), "y_true", "y_pred",
                                    "source_id", min_group=280)
    return rounded(out.select("case_id", "qhat", "lower", "upper", "width"))


@query("nominal_levels", f"""WITH {CASES}, {CAL},
o AS (SELECT endpoint, sc, row_number() OVER (PARTITION BY endpoint ORDER BY sc) AS rn, count(*) OVER (PARTITION BY endpoint) AS n FROM cal),
a AS (SELECT unnest([0.2, 0.1, 0.05])::DOUBLE AS alpha),
q AS (SELECT endpoint, alpha, min(sc) AS qhat FROM o, a WHERE rn = least(greatest(ceil((n + 1) * (1 - alpha)), 1), n) GROUP BY ALL),
w AS (SELECT t.endpoint, round(1 - alpha, 6) AS nominal, avg((y_true BETWEEN y_pred - qhat * greatest(s1, 1e-6) AND y_pred + qhat * greatest(s1, 1e-6))::INT) AS coverage,
             avg(2 * qhat * greatest(s1, 1e-6)) AS mean_width FROM tst t JOIN q ON t.endpoint = q.endpoint GROUP BY ALL)
SELECT endpoint, nominal, round(coverage, 6) AS coverage, round(mean_width, 6) AS mean_width, round(coverage - nominal, 6) + 0 AS coverage_gap,
  round(mean_width / max(mean_width) FILTER (WHERE nominal = 0.9) OVER (PARTITION BY endpoint), 6) AS mean_width_ratio FROM w""")
def nominal_levels(spark: SparkSession, sf: str) -> DataFrame:
    rows = cases(spark, sf)
    out = calibrate.nominal_levels(rows.where("split = 'F'"), rows.where("split = 'O'"), "y_true", "y_pred", "s1",
                                   panel=["endpoint"])
    # an endpoint without calibration rows has no interval to report
    return rounded(out.where(F.col("nominal").isNotNull()))


@query("high_error_labels", f"""WITH {CASES}, e AS (SELECT case_id, endpoint, abs(y_true - y_pred) AS error FROM cases),
q AS (SELECT endpoint, quantile_cont(error, 0.8) AS error_threshold FROM e GROUP BY endpoint)
SELECT case_id, round(error_threshold, 6) AS error_threshold, error >= error_threshold AS high_error FROM e JOIN q USING (endpoint)""")
def high_error_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = cases(spark, sf).select("case_id", "endpoint", F.abs(F.col("y_true") - F.col("y_pred")).alias("error"))
    return rounded(calibrate.high_error_labels(rows, "error", 0.8, "endpoint").drop("endpoint", "error"))


@query("balance_weights", f"""WITH {CASES}, s AS (SELECT endpoint, count(*) AS k FROM cases GROUP BY endpoint),
t AS (SELECT sum(k) AS n, count(*) AS g FROM s)
SELECT case_id, round(n / (g * k)::DOUBLE, 6) AS weight FROM cases JOIN s USING (endpoint), t""")
def balance_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(calibrate.balance_weights(cases(spark, sf).select("case_id", "endpoint"), "endpoint").drop("endpoint"))


@query("decision_labels", f"""WITH {CASES}, q AS (SELECT quantile_cont(s2, 0.5) AS w, quantile_cont(s2, 0.85) AS a FROM cases WHERE split = 'F')
SELECT case_id, CASE WHEN s2 >= a THEN 'abstain' WHEN s2 >= w THEN 'warn' ELSE 'predict' END AS decision FROM cases, q WHERE split = 'O'""")
def decision_labels(spark: SparkSession, sf: str) -> DataFrame:
    from quotaloom.operators.scan import attach_small

    rows = cases(spark, sf)
    limits = calibrate.score_thresholds(rows.where("split = 'F'"), "s2")
    scored = attach_small(rows.where("split = 'O'").select("case_id", "s2"), limits, ())
    return scored.select("case_id", calibrate.decision_labels(
        F.col("s2"), F.col("warn_threshold"), F.col("abstain_threshold")).alias("decision"))


@query("minmax_components", f"""WITH {CASES}, r AS (SELECT min(s1) AS l1, max(s1) AS h1, min(s2) AS l2, max(s2) AS h2 FROM cases WHERE split = 'F')
SELECT case_id, round((s1 - l1) / (h1 - l1), 6) AS s1_scaled, round((s2 - l2) / (h2 - l2), 6) AS s2_scaled,
  round(((s1 - l1) / (h1 - l1) + (s2 - l2) / (h2 - l2)) / 2, 6) AS axis_both FROM cases, r""")
def minmax_components(spark: SparkSession, sf: str) -> DataFrame:
    rows = cases(spark, sf)
    scaled = calibrate.minmax_scale(rows.select("case_id", "s1", "s2"), ["s1", "s2"], rows.where("split = 'F'"))
    out = calibrate.axis_means(scaled, {"both": ["s1_scaled", "s2_scaled"]})
    return rounded(out.select("case_id", "s1_scaled", "s2_scaled", "axis_both"))


@query("risk_scorer")
def risk_scorer(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic error-risk score of every later case; fitted on the earlier ones."""
    rows = cases(spark, sf).withColumn("error", F.abs(F.col("y_true") - F.col("y_pred")))
    labelled = calibrate.high_error_labels(rows.where("split = 'F'"), "error", 0.8)
    scorer = calibrate.RiskScorer(["s1", "s2"], "high_error").fit(labelled)
    return rounded(rows.where("split = 'O'").select("case_id", scorer.score().alias("risk_score")))


@query("comparator_suite")
def comparator_suite(spark: SparkSession, sf: str) -> DataFrame:
    rows = cases(spark, sf).select("case_id", "endpoint", "split", "s1", "s2", F.col("study_year").cast("double").alias("s3"),
                                   F.abs(F.col("y_true") - F.col("y_pred")).alias("error"),
                                   (F.col("y_pred") - F.col("y_true")).alias("gap"))
    out = calibrate.comparator_suite(
        rows.where("split = 'F'"), rows.where("split = 'O'"), ["s1", "s2", "s3"],
        {"support": ["s1", "s2"], "time": ["s3"]}, "error", (0.8, 0.9), "endpoint", "gap")
    return rounded(out.drop("endpoint", "split", "s1", "s2", "s3", "error", "gap"))


COMPONENTS = ("c1", "c2", "c3")
REMOVED = {"full": "(c1 + c2 + c3) / 3.0::DOUBLE", "c1": "(c2 + c3) / 2.0::DOUBLE", "c2": "(c1 + c3) / 2.0::DOUBLE", "c3": "(c1 + c2) / 2.0::DOUBLE"}


def _each(template: str) -> str:
    return ", ".join(template.format(v=v) for v in REMOVED)


ABLATION = f"""{CASES},
b AS (SELECT *, s1 * 10 AS c1, s2 / 50 AS c2, abs(study_year - 1995) / 4.0::DOUBLE AS c3 FROM cases),
v AS (SELECT case_id, split, entity, endpoint, y_true, y_pred, abs(y_true - y_pred) AS e, {', '.join(f'{x} AS v_{m}' for m, x in REMOVED.items())} FROM b),
lc AS ({' UNION ALL '.join(f"SELECT split, case_id, e, '{m}' AS removed, v_{m} AS score FROM v" for m in REMOVED)}),
rk AS (SELECT split, removed, row_number() OVER w AS rn, count(*) OVER (PARTITION BY split, removed) AS n, sum(e) OVER w / row_number() OVER w AS risk
  FROM lc WINDOW w AS (PARTITION BY split, removed ORDER BY score, case_id ROWS UNBOUNDED PRECEDING)),
au AS (SELECT split, removed, (sum(risk) - sum(risk) FILTER (WHERE rn = 1 OR rn = n) / 2) / max(n) AS value FROM rk GROUP BY ALL),
md AS (SELECT split, entity, endpoint, median(y_true) AS t, median(y_pred) AS p, {_each('median(v_{v}) AS v_{v}')} FROM v GROUP BY ALL),
ct AS (SELECT split, endpoint, quantile_cont(t, 0.25) AS cutoff FROM md GROUP BY ALL),
en AS (SELECT split, entity, bool_or(t <= cutoff) AS true_high, bool_or(p <= cutoff) AS pred_high, {_each('max(v_{v}) AS v_{v}')} FROM md JOIN ct USING (split, endpoint) GROUP BY ALL),
le AS ({' UNION ALL '.join(f"SELECT split, entity, true_high, pred_high, '{m}' AS removed, v_{m} AS score FROM en" for m in REMOVED)}),
rv AS (SELECT *, row_number() OVER (PARTITION BY split, removed ORDER BY pred_high, score DESC NULLS LAST, entity)
  <= round_even(count(*) OVER (PARTITION BY split, removed) * 0.25::DOUBLE, 0) AS reviewed FROM le),
om AS (SELECT split, removed, count(*) FILTER (WHERE true_high AND NOT pred_high AND NOT reviewed) / nullif(count(*) FILTER (WHERE NOT pred_high AND NOT reviewed), 0)::DOUBLE AS value
  FROM rv GROUP BY ALL),
al AS (SELECT split, removed, 'aurc' AS metric, value FROM au UNION ALL SELECT split, removed, 'false_omission_rate', value FROM om),
dl AS (SELECT a.split, a.removed, a.metric, a.value, f.value AS full_value, a.value - f.value AS delta FROM al a JOIN al f ON a.split = f.split AND a.metric = f.metric AND f.removed = 'full')"""


def _ablation(spark: SparkSession, sf: str) -> DataFrame:
    rows = cases(spark, sf).withColumns({"c1": F.col("s1") * 10, "c2": F.col("s2") / 50, "c3": F.abs(F.col("study_year") - 1995) / 4.0})
    return ablation.ablation_deltas(rows, COMPONENTS, ["split"])


@query("ablation_deltas", f"""WITH {ABLATION} SELECT split, removed, metric, round(value, 6) AS value, round(full_value, 6) AS full_value, round(delta, 6) + 0 AS delta FROM dl""")
def ablation_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_ablation(spark, sf))


@query("ablation_summary", f"""WITH {ABLATION} SELECT removed, metric, round(avg(delta), 6) + 0 AS delta_mean, round(stddev_samp(delta), 6) AS delta_sd FROM dl WHERE removed <> 'full' GROUP BY ALL""")
def ablation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ablation.ablation_summary(_ablation(spark, sf)))
