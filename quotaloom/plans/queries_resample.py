"""Bootstrap and repeated-selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaloom.operators import ranking, resample, rollup
from quotaloom.plans.queries_metrics import ranked
from quotaloom.plans.queries_review import METHODS, MISS, n, panel, rate
from quotaloom.plans.registry import query
from quotaloom.plans.testbed import CASES, PANEL, SCORES, cases, rounded
from quotaloom.session import materialize


#: replicates of the paired and of the cluster bootstrap, and of the macro bootstrap
REPLICATES, MACRO_REPLICATES = 2000, 1000


def u(*parts: str) -> str:
    return f"(CAST(concat('0x', substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def weights(source: str, reps: int, seed: int = 42) -> str:
    return f"""
idx AS (SELECT entity, row_number() OVER (ORDER BY entity) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT entity FROM {source})),
dr AS (SELECT CAST(r AS INTEGER) AS replicate, CAST(floor({u(f"'{seed}'", 'r', 'i')} * n) AS BIGINT) + 1 AS i FROM idx, range(0, {reps}) t(r)),
w AS (SELECT replicate, entity, count(*) AS w FROM dr JOIN idx USING (i) GROUP BY ALL)"""


@query("bootstrap_weights", f"WITH {CASES}, {weights('cases', 5)} SELECT replicate, entity, w FROM w")
def bootstrap_weights(spark: SparkSession, sf: str) -> DataFrame:
    return resample.multiplicities(cases(spark, sf).select("entity").distinct(), "entity", 5, 42)


@query("cluster_bootstrap", f"""WITH {CASES}, {weights('cases', 5)},
x AS (SELECT replicate, y_true, y_pred FROM (SELECT *, unnest(range(w)) FROM w) JOIN cases USING (entity)),
r AS (SELECT *, {ranked('y_true', 'replicate')} AS ra, {ranked('y_pred', 'replicate')} AS rb FROM x)
SELECT replicate, count(*) AS n_rows, round(sqrt(avg((y_pred - y_true) ** 2)), 6) AS rmse, round(avg(abs(y_pred - y_true)), 6) AS mae,
  round(avg(y_pred - y_true), 6) AS bias, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY replicate""")
def cluster_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(resample.cluster_bootstrap(cases(spark, sf), "entity", "y_true", "y_pred", 5))


RATES = f"""{rate('reviewed', MISS).replace('round(', '(').replace(', 6)', ')')} AS capture,
  {n(MISS + ' AND NOT reviewed')} / nullif({n('true_high')}, 0)::DOUBLE AS left_low,
  {n(MISS + ' AND NOT reviewed')} / nullif({n('NOT pred_high AND NOT reviewed')}, 0)::DOUBLE AS omission"""
UNPIVOT = """SELECT {k}, 'false_negative_capture' AS metric, capture AS v FROM {t} UNION ALL SELECT {k}, 'high_concern_left_low_priority_fraction', left_low FROM {t}
  UNION ALL SELECT {k}, 'lower_priority_false_omission_rate', omission FROM {t}"""
SUMMARY = """count(*) AS n_values, round(avg(difference), 6) + 0 AS mean, round(quantile_cont(difference, 0.025), 6) + 0 AS ci_lower,
  round(median(difference), 6) + 0 AS median, round(quantile_cont(difference, 0.975), 6) + 0 AS ci_upper,
  round(avg((difference > 0)::INT), 6) AS share_positive, round(avg((difference < 0)::INT), 6) AS share_negative"""


@query("cluster_bootstrap_errors", f"""WITH {CASES}, {weights('cases', REPLICATES)},
e AS (SELECT entity, count(*) AS n, sum((y_pred - y_true) ** 2) AS ss, sum(abs(y_pred - y_true)) AS sa, sum(y_pred - y_true) AS sd FROM cases GROUP BY entity)
SELECT replicate, CAST(sum(w * n) AS BIGINT) AS n_rows, round(sqrt(sum(w * ss) / sum(w * n)), 6) AS rmse, round(sum(w * sa) / sum(w * n), 6) AS mae,
  round(sum(w * sd) / sum(w * n), 6) AS bias FROM w JOIN e USING (entity) GROUP BY replicate""")
def cluster_bootstrap_errors(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(resample.cluster_bootstrap(cases(spark, sf), "entity", "y_true", "y_pred", REPLICATES, ranks=False))


def reviewed_rates(methods: dict[str, str], reps: int) -> str:
    """(replicate, method, metric, v) of all methods, each reviewing the first quarter of the copies."""
    long = " UNION ALL ".join(f"SELECT replicate, eid, true_high, pred_high, '{m}' AS method, {c} AS score FROM c" for m, c in methods.items())
    return f"""{CASES}, {PANEL}, {weights('panel', reps)},
c AS (SELECT p.*, -min_pred AS proximity, s1 + s2 AS both_scores, s1 * s2 AS product, replicate, concat_ws('#', p.entity, CAST(k + 1 AS VARCHAR)) AS eid
      FROM (SELECT *, unnest(range(w)) AS k FROM w) x JOIN panel p USING (entity)),
l AS ({long}),
q AS (SELECT *, row_number() OVER (PARTITION BY replicate, method ORDER BY pred_high, score DESC NULLS LAST, eid)
       <= round_even(count(*) OVER (PARTITION BY replicate, method) * 0.25::DOUBLE, 0) AS reviewed FROM l),
m AS (SELECT replicate, method, {RATES} FROM q GROUP BY ALL)"""


@query("paired_bootstrap", f"""WITH {reviewed_rates(METHODS, REPLICATES)},
rnd AS (SELECT replicate, 'random_review' AS method, CASE WHEN {n(MISS)} > 0 THEN round_even(count(*) * 0.25::DOUBLE, 0) / count(*) END AS capture,
   {n(MISS)} * (1 - round_even(count(*) * 0.25::DOUBLE, 0) / count(*)) / nullif({n('true_high')}, 0) AS left_low, {n(MISS)} / nullif({n('NOT pred_high')}, 0)::DOUBLE AS omission FROM c GROUP BY replicate),
a AS (SELECT * FROM m UNION ALL SELECT * FROM rnd), v AS ({UNPIVOT.format(k='replicate, method', t='a')}),
d AS (SELECT x.method, y.method AS reference, x.metric, x.v - y.v AS difference FROM v x JOIN v y ON x.replicate = y.replicate AND x.metric = y.metric AND y.method IN ('first', 'random_review') AND x.method <> y.method)
SELECT method, reference, metric, {SUMMARY} FROM d WHERE difference IS NOT NULL GROUP BY ALL""")
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(resample.paired_panel_bootstrap(materialize(panel(spark, sf)), METHODS, 0.25, REPLICATES, ["first", "random_review"]))


SUPPORT = {"first": "s1", "second": "s2", "sum": "both_scores", "product": "product", "threshold": "proximity"}
COMPARISONS = [("sum", "first"), ("sum", "second"), ("product", "first"), ("product", "second"), ("sum", "product"),
               ("first", "threshold"), ("second", "threshold"), ("sum", "threshold"), ("product", "threshold")]


@query("support_increment", f"""WITH {reviewed_rates(SUPPORT, REPLICATES)}, v AS ({UNPIVOT.format(k='replicate, method', t='m')}),
pairs AS (SELECT * FROM (VALUES {', '.join(map(str, COMPARISONS))}) t(method, reference)),
d AS (SELECT p.method, p.reference, x.metric, x.v - y.v AS difference FROM pairs p JOIN v x USING (method) JOIN v y ON x.replicate = y.replicate AND x.metric = y.metric AND y.method = p.reference),
s AS (SELECT method, reference, metric, {SUMMARY} FROM d WHERE difference IS NOT NULL GROUP BY ALL)
SELECT method, reference, metric, n_values, mean, median, ci_lower, ci_upper,
  CASE WHEN metric = 'false_negative_capture' THEN share_positive ELSE share_negative END AS share_better FROM s""")
def support_increment(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel(spark, sf).withColumns({"proximity": -F.col("min_pred"), "both_scores": F.col("s1") + F.col("s2"), "product": F.col("s1") * F.col("s2")})
    return rounded(resample.support_increment(materialize(rows), SUPPORT, COMPARISONS, 0.25, REPLICATES))


def split_panels(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.endpoint_relative_panel(cases(spark, sf), 0.25, SCORES, ["split"])


def split_reviews(spark: SparkSession, sf: str) -> DataFrame:
    long = ranking.melt_scores(materialize(split_panels(spark, sf)), METHODS)
    return ranking.review_flags(long, "score", 0.25, panel=["split", "method"], policy="low_concern_first")


@query("hierarchical_bootstrap")
def hierarchical_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Paired differences against the first method."""
    return rounded(resample.hierarchical_deltas(resample.hierarchical_bootstrap(split_reviews(spark, sf), "split", REPLICATES), "first"))


@query("hierarchical_intervals")
def hierarchical_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Each method's own interval, next to a random review that is chosen anew in every resample."""
    values = resample.hierarchical_bootstrap(split_reviews(spark, sf), "split", REPLICATES, random="random")
    return rounded(resample.intervals(values, ["method", "metric"], "value"))


MACRO = f"""{CASES},
med2 AS (SELECT split, entity, endpoint, median(y_true) AS y_true, median(y_pred) AS y_pred, median(s1) AS s1, median(s2) AS s2 FROM cases GROUP BY ALL),
cut2 AS (SELECT split, endpoint, quantile_cont(y_true, 0.25) AS cutoff FROM med2 GROUP BY ALL),
panel2 AS (SELECT split, entity, bool_or(m.y_true <= cutoff) AS true_high, bool_or(y_pred <= cutoff) AS pred_high, max(s1) AS s1, max(s2) AS s2
  FROM med2 m JOIN cut2 USING (split, endpoint) GROUP BY ALL),
{weights('panel2', MACRO_REPLICATES)},
c AS (SELECT p.*, replicate, concat_ws('#', p.entity, CAST(k + 1 AS VARCHAR)) AS eid FROM (SELECT *, unnest(range(w)) AS k FROM w) x JOIN panel2 p USING (entity)),
f AS (SELECT *, round_even(count(*) OVER (PARTITION BY replicate, split) * 0.25::DOUBLE, 0) AS quota,
  row_number() OVER (PARTITION BY replicate, split ORDER BY pred_high, s1 DESC NULLS LAST, eid) AS place FROM c),
l AS (SELECT f.*, place <= quota AS one, NOT pred_high AND place > quota AS residual, m.method, CASE m.method WHEN 'first' THEN s1 ELSE s2 END AS score
  FROM f, (VALUES ('first'), ('second')) m(method)),
q AS (SELECT *, row_number() OVER (PARTITION BY replicate, split, method ORDER BY pred_high, score DESC NULLS LAST, eid) <= quota AS alone,
  residual AND row_number() OVER (PARTITION BY replicate, split, method ORDER BY residual DESC, score DESC NULLS LAST, eid) <= quota AS two FROM l),
m AS (SELECT replicate, split, method, {n(MISS + ' AND alone')} / nullif({n(MISS)}, 0)::DOUBLE AS single_capture,
  {n(MISS + ' AND NOT alone')} / nullif({n('NOT pred_high AND NOT alone')}, 0)::DOUBLE AS single_for,
  {n(MISS + ' AND two')} / nullif({n(MISS + ' AND residual')}, 0)::DOUBLE AS second_capture,
  {n(MISS + ' AND (one OR two)')} / nullif({n(MISS)}, 0)::DOUBLE AS combined_capture,
  {n(MISS + ' AND NOT one AND NOT two')} / nullif({n('NOT pred_high AND NOT one AND NOT two')}, 0)::DOUBLE AS combined_for FROM q GROUP BY ALL),
v AS (SELECT replicate, method, metric, avg(v) AS v FROM (UNPIVOT m ON single_capture, single_for, second_capture, combined_capture, combined_for INTO NAME metric VALUE v) GROUP BY ALL)"""


@query("macro_bootstrap", f"""WITH {MACRO},
d AS (SELECT x.method, y.method AS reference, x.metric, x.v - y.v AS difference FROM v x JOIN v y USING (replicate, metric) WHERE y.method = 'first' AND x.method <> 'first')
SELECT method, reference, metric, {SUMMARY} FROM d WHERE difference IS NOT NULL GROUP BY ALL""")
def macro_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(resample.macro_bootstrap(materialize(split_panels(spark, sf)), ["split"], METHODS, "s1", MACRO_REPLICATES, "first"))


@query("meta_bootstrap")
def meta_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    rows = cases(spark, sf).where("split = 'F'").withColumn("residual", F.abs(F.col("y_true") - F.col("y_pred")))
    return rounded(resample.meta_bootstrap(rows, ["s1", "s2"], "residual", "entity", 5), 5)


@query("selection_study")
def selection_study(spark: SparkSession, sf: str) -> DataFrame:
    out = resample.selection_study(panel(spark, sf), METHODS, 100, 60, "second")
    return rounded(out)


@query("random_replicates", f"""WITH {CASES}, {PANEL},
r AS (SELECT p.*, CAST(i AS INTEGER) AS replicate FROM panel p, range(0, 10) t(i)),
q AS (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY sha256(concat_ws('|', concat('42-', replicate), entity)), entity)
       <= greatest(1, round_even(count(*) OVER (PARTITION BY replicate) * 0.25::DOUBLE, 0)) AS reviewed FROM r)
SELECT replicate, {n('reviewed')} AS review_n, {n(MISS + ' AND reviewed')} AS rescued_false_negative, {rate('reviewed', MISS)} AS false_negative_capture FROM q GROUP BY replicate""")
def random_replicates(spark: SparkSession, sf: str) -> DataFrame:
    out = resample.random_review_replicates(panel(spark, sf), 0.25, 10)
    return rounded(out.select("replicate", "review_n", "rescued_false_negative", "false_negative_capture"))
