"""Error, interval, ranking-quality and omission metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotaloom.functions.numeric import rate_of, safe_rate
from quotaloom.operators.ranking import aurc, melt_scores, risk_coverage
from quotaloom.operators.scan import asc, attach, attach_small, desc, ordered_scan, quantiles
from quotaloom.session import materialize


def _join_panels(parts: Sequence[DataFrame], panel: Sequence[str]) -> DataFrame:
    out = parts[0]
    for other in parts[1:]:
        out = attach_small(out, other, panel)
    return out


def average_ranks(df: DataFrame, value: str, panel: Sequence[str] = (), name: str = "avg_rank",
                  weight: str | None = None, base: DataFrame | None = None) -> DataFrame:
    """Ranks with ties averaged, from the distinct values and their (weighted) counts.

    ``base`` is a cheaper frame with the same values, for a ``df`` that already
    carries other joins.
    """
    panel = list(panel)
    source = df if base is None else base
    distinct = source.where(F.col(value).isNotNull()).groupBy(*panel, value).agg(
        (F.sum(weight) if weight else F.count("*")).alias("_w"))
    scan = ordered_scan(distinct, [asc(value)], panel, {"w": F.col("_w")})
    ranks = scan.select(*panel, value, (F.col("cum_w") - F.col("_w") + (F.col("_w") + 1) / 2).alias(name))
    return attach(df, ranks, [*panel, value])


def exact_mean(name: str, scale: int = 10) -> Column:
    """Mean whose sum doesn't depend on the order of rows, while every value fits DECIMAL(30, scale)."""
    fixed = F.col(name).try_cast(f"decimal(30,{scale})")
    return F.when(F.count(fixed) == F.count(name), F.avg(fixed).cast("double")).otherwise(F.avg(name))


def guarded_corr(a: Column, b: Column) -> Column:
    """Pearson correlation, NULL for fewer than three rows or a constant side."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    varied = (F.count_if(both) >= 3) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied, F.corr(x, y))


def spearman(df: DataFrame, a: str, b: str, panel: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        *panel, F.col(a).alias("_a"), F.col(b).alias("_b"), *([weight] if weight else []))
    ranked = average_ranks(rows, "_a", panel, "_ra", weight)
    ranked = average_ranks(ranked, "_b", panel, "_rb", weight, rows)
    if weight is None:
        return ranked.groupBy(*panel).agg(guarded_corr(F.col("_ra"), F.col("_rb")).alias("spearman"))
    # weighted Pearson of the ranks, with ranks taken relative to the panel size
    w, x, y = F.col(weight), F.col("_ra"), F.col("_rb")
    sums = ranked.groupBy(*panel).agg(
        F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"),
        F.sum(w * y * y).alias("yy"), F.sum(w * x * y).alias("xy"), ((F.min(x) < F.max(x)) & (F.min(y) < F.max(y))).alias("varied"))
    return sums.select(*panel, weighted_correlation({c: F.col(c) for c in sums.columns}).alias("spearman"))


def weighted_correlation(of: Mapping[str, Column]) -> Column:
    """Correlation from weighted sums, NULL for a weight below three or a constant side."""
    n = of["w"]
    cov = of["xy"] / n - of["x"] * of["y"] / (n * n)
    vx = of["xx"] / n - F.pow(of["x"] / n, F.lit(2.0))
    vy = of["yy"] / n - F.pow(of["y"] / n, F.lit(2.0))
    return F.when((n >= 3) & of["varied"] & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))


def regression_metrics(
    df: DataFrame, y_true: str, y_pred: str, panel: Sequence[str] = ()
) -> DataFrame:
    """Row count, RMSE, MAE, bias and Spearman per panel."""
    diff = F.col(y_pred) - F.col(y_true)
    errors = df.groupBy(*panel).agg(
        F.count("*").alias("n_rows"), F.sqrt(F.avg(diff * diff)).alias("rmse"),
        F.avg(F.abs(diff)).alias("mae"), F.avg(diff).alias("bias"))
    return _join_panels([errors, spearman(df, y_true, y_pred, panel)], panel)


def interval_metrics(
    df: DataFrame, y_true: str, lower: str, upper: str, uncertainty: str, novelty: str,
    panel: Sequence[str] = (),
) -> DataFrame:
    lo, hi, y = F.col(lower), F.col(upper), F.col(y_true)
    rows = df.select(*panel, F.coalesce((y >= lo) & (y <= hi), F.lit(False)).cast("double").alias("_in"),
                     (hi - lo).alias("_w"), F.abs(y - (lo + hi) / 2).alias("_e"),
                     F.col(uncertainty).cast("double").alias("_u"), F.col(novelty).cast("double").alias("_n"))
    return rows.groupBy(*panel).agg(
        F.avg("_in").alias("coverage"), F.avg("_w").alias("mean_interval_width"),
        guarded_corr(F.col("_u"), F.col("_e")).alias("uncertainty_error_corr"),
        guarded_corr(F.col("_u"), F.col("_n")).alias("uncertainty_novelty_corr"))


def class_separation(
    df: DataFrame, positive: str, score: str, panel: Sequence[str] = (), target_tpr: float = 0.95
) -> DataFrame:
    """AUROC, average precision and FPR at the first threshold reaching ``target_tpr``.

    Works on distinct scores with class counts, so ties are exact and the ordered
    part is as small as the number of distinct scores.
    """
    panel = list(panel)
    pos = F.col(positive).cast("boolean")
    counts = df.where(F.col(score).isNotNull() & pos.isNotNull()).groupBy(
        *panel, F.col(score).cast("double").alias("_score")).agg(
        F.count_if(pos).alias("_p"), F.count_if(~pos).alias("_n"))
    scan = ordered_scan(counts, [desc("_score")], panel, {"p": F.col("_p"), "n": F.col("_n")})
    tp, fp = F.col("cum_p"), F.col("cum_n")
    concordant = F.col("_p") * ((F.col("total_n") - fp) + F.col("_n") / 2)
    return scan.groupBy(*panel).agg(
        safe_rate(F.sum(concordant), F.max("total_p") * F.max("total_n")).alias("auroc"),
        safe_rate(F.sum(F.when(F.col("_p") > 0, F.col("_p") * tp / (tp + fp))), F.max("total_p"))
        .alias("average_precision"),
        F.when((F.max("total_p") > 0) & (F.max("total_n") > 0),
               F.min(F.when(tp >= F.col("total_p") * F.lit(target_tpr), fp / F.col("total_n"))))
        .alias("fpr95"))


def error_capture(
    df: DataFrame, y_true: str, y_pred: str, score: str, panel: Sequence[str] = (),
    error_level: float = 0.9, score_level: float = 0.8,
) -> DataFrame:
    """Share of the top-decile errors whose score reaches the 80 % score quantile."""
    rows = materialize(df.select(*panel, F.abs(F.col(y_true) - F.col(y_pred)).alias("_e"),
                                 F.col(score).cast("double").alias("_s")))
    limits = _join_panels([quantiles(rows, "_e", {"_el": error_level}, panel, written=True),
                           quantiles(rows, "_s", {"_sl": score_level}, panel, written=True)], panel)
    flagged = attach_small(rows, limits, panel)
    return flagged.groupBy(*panel).agg(
        rate_of(F.col("_s") >= F.col("_sl"), F.col("_e") >= F.col("_el")).alias("top_decile_error_capture"))


def score_summary(
    df: DataFrame, scores: Mapping[str, str], y_true: str, y_pred: str, shifted: str,
    case_id: str = "case_id",
) -> DataFrame:
    """One row per scoring method; the methods are unpivoted so each step runs once for all."""
    rows = df.select(*dict.fromkeys([case_id, y_true, y_pred, shifted, *scores.values()]), F.abs(F.col(y_true) - F.col(y_pred)).alias("_error"))
    long = melt_scores(materialize(rows), scores)  # read by every step
    panel = ["method"]
    base = long.groupBy("method").agg(
        exact_mean("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"))
    return _join_panels([
        base, aurc(risk_coverage(long, "_error", "score", case_id, panel, ids=False), panel),
        error_capture(long, y_true, y_pred, "score", panel),
        class_separation(long, shifted, "score", panel)], panel)


def omission_metrics(
    df: DataFrame, panel: Sequence[str] = (), true_high: str = "true_high",
    pred_high: str = "pred_high", reviewed: str = "reviewed",
) -> DataFrame:
    """What the review saved and what stays in the low-priority queue; undefined rates are NULL."""
    th, low, rev = F.col(true_high), ~F.col(pred_high), F.col(reviewed)
    miss = th & low
    return df.groupBy(*panel).agg(
        F.count("*").alias("n_entities"),
        F.count_if(rev).alias("review_n"),
        F.count_if(low).alias("n_predicted_low"),
        F.count_if(th).alias("n_true_high"),
        F.count_if(miss).alias("n_false_negative"),
        F.count_if(miss & rev).alias("rescued_false_negative"),
        rate_of(rev, miss).alias("false_negative_capture"),
        safe_rate(F.count_if(miss & ~rev), F.count_if(th)).alias("high_concern_left_low_priority_fraction"),
        rate_of(th, low & ~rev).alias("lower_priority_false_omission_rate"),
        (F.count_if(low) >= F.count_if(rev)).alias("low_queue_capacity_sufficient"))


def screening_action(pred_high: Column, reviewed: Column, eligible: Column | None = None) -> Column:
    """The four actions; an ineligible row is always withheld."""
    action = (F.when(pred_high & reviewed, "prioritize_testing").when(pred_high, "screen_now")
              .when(reviewed, "withhold_review").otherwise("lower_priority"))
    return action if eligible is None else F.when(~eligible, "withhold_review").otherwise(action)


def workload_metrics(
    df: DataFrame, panel: Sequence[str], true_high: str = "true_high", pred_high: str = "pred_high",
    reviewed: str = "reviewed",
) -> DataFrame:
    """Action counts, rescued misses per 100 reviews and the omission rates at a fixed workload."""
    th, low, rev = F.col(true_high), ~F.col(pred_high), F.col(reviewed)
    miss, left = th & low, low & ~rev
    return df.groupBy(*panel).agg(
        F.count_if(rev).alias("review_count"),
        F.count_if(left).alias("lower_priority_queue_size"),
        F.count_if(th & left).alias("high_concern_left_count"),
        F.count_if(miss).alias("baseline_false_negatives"),
        F.count_if(miss & rev).alias("rescued_false_negatives"),
        rate_of(rev, miss).alias("rescued_fraction"),
        rate_of(th, left).alias("lower_priority_false_omission_rate"),
        safe_rate(F.count_if(th & left), F.count_if(th)).alias("high_concern_left_fraction"),
        safe_rate(F.count_if(miss & rev) * 100, F.count_if(rev)).alias("rescued_per_100_reviews"),
        F.count_if(~low & rev).alias("prioritize_testing_count"),
        F.count_if(~low & ~rev).alias("screen_now_count"),
        F.count_if(low & rev).alias("withhold_review_count"))


def direct_rule(
    df: DataFrame, score: str, panel: Sequence[str], true_value: str = "min_true",
    pred_value: str = "min_pred", toxicity_level: float = 0.25, score_level: float = 0.75,
) -> DataFrame:
    """Rows classified by panel quantiles: low value is high concern, high score is reviewed."""
    limits = _join_panels([
        quantiles(df, true_value, {"toxicity_cutoff": toxicity_level}, panel),
        quantiles(df, score, {"score_cutoff": score_level}, panel)], panel)
    rows = attach_small(df.drop("true_high", "pred_high"), limits, panel)
    flags = rows.select(
        "*", (F.col(true_value) <= F.col("toxicity_cutoff")).alias("true_high"),
        (F.col(pred_value) <= F.col("toxicity_cutoff")).alias("pred_high"),
        (F.col(score) >= F.col("score_cutoff")).alias("reviewed"))
    return flags.withColumn("screening_action", screening_action(F.col("pred_high"), F.col("reviewed")))


def direct_rule_summary(classified: DataFrame, panel: Sequence[str]) -> DataFrame:
    th, low, rev = F.col("true_high"), ~F.col("pred_high"), F.col("reviewed")
    return classified.groupBy(*panel).agg(
        F.count("*").alias("n_cases"),
        F.max("toxicity_cutoff").alias("toxicity_cutoff"),
        F.max("score_cutoff").alias("score_cutoff"),
        rate_of(th, low).alias("baseline_false_omission_rate"),
        rate_of(th, low & ~rev).alias("routed_false_omission_rate"),
        F.count_if(low).alias("baseline_queue_size"),
        F.count_if(low & ~rev).alias("routed_queue_size"),
        F.count_if(th & low).alias("baseline_false_negatives"),
        F.count_if(th & low & rev).alias("rescued_false_negatives"),
        rate_of(rev, th & low).alias("rescued_fraction"),
        *[F.count_if(F.col("screening_action") == a).alias(f"{a}_count")
          for a in ("screen_now", "prioritize_testing", "withhold_review", "lower_priority")])


def random_reference(
    df: DataFrame, fraction: float, panel: Sequence[str] = (), true_high: str = "true_high",
    pred_high: str = "pred_high", min_one: bool = False,
) -> DataFrame:
    """Expected metrics of reviewing at random, in closed form instead of by simulation.

    ``low_capture`` is the version restricted to the predicted-low queue.
    """
    from quotaloom.functions.numeric import review_count

    th, low = F.col(true_high), ~F.col(pred_high)
    base = df.groupBy(*panel).agg(
        F.count("*").alias("n_entities"), F.count_if(low).alias("n_predicted_low"),
        F.count_if(th).alias("n_true_high"), F.count_if(th & low).alias("n_false_negative"))
    k = review_count(F.col("n_entities"), fraction, min_one)
    base = base.withColumn("review_n", k)
    p = safe_rate(F.col("review_n"), F.col("n_entities"))
    some = F.col("n_false_negative") > 0
    return base.select(
        "*", (F.col("n_false_negative") * p).alias("rescued_false_negative"),
        F.when(some, p).alias("false_negative_capture"),
        safe_rate(F.col("n_false_negative") * (1 - p), F.col("n_true_high"))
        .alias("high_concern_left_low_priority_fraction"),
        safe_rate(F.col("n_false_negative"), F.col("n_predicted_low"))
        .alias("lower_priority_false_omission_rate"),
        F.when(some, F.least(safe_rate(F.col("review_n"), F.col("n_predicted_low")), F.lit(1.0)))
        .alias("low_capture"))


def fixed_burden(
    df: DataFrame, scores: Mapping[str, str], error: str, case_id: str, fraction: float,
    error_level: float = 0.9, panel: Sequence[str] = (),
) -> DataFrame:
    """Share of the large errors (at or above the error quantile) met by the top fraction per method."""
    from quotaloom.operators.ranking import top_fraction

    rows = df.select(*panel, case_id, F.col(error).alias("_error"), *dict.fromkeys(scores.values()))
    limited = attach_small(rows, quantiles(rows, "_error", {"_limit": error_level}, panel), panel)
    long = melt_scores(limited, scores)
    flagged = top_fraction(long, "score", fraction, case_id, [*panel, "method"])
    large = F.col("_error") >= F.col("_limit")
    return flagged.groupBy(*panel, "method").agg(
        F.count_if("selected").alias("review_n"), F.count_if(large).alias("n_high_error"),
        F.count_if(large & F.col("selected")).alias("n_captured"),
        rate_of(F.col("selected"), large).alias("capture"),
        safe_rate(F.count_if(large & F.col("selected")), F.count_if("selected")).alias("precision"))


def decile_overlap(
    df: DataFrame, scores: Mapping[str, str], error: str, case_id: str, fraction: float = 0.25,
    error_fraction: float = 0.1, panel: Sequence[str] = (),
) -> DataFrame:
    """Fixed workload against the exact top decile of errors: both sets are counted, not thresholded."""
    from quotaloom.operators.ranking import top_fraction

    truth = top_fraction(df, error, error_fraction, case_id, panel, "high_error", "ceil")
    long = melt_scores(truth, scores)
    flagged = top_fraction(long, "score", fraction, case_id, [*panel, "method"])
    return flagged.groupBy(*panel, "method").agg(
        F.count_if("selected").alias("review_n"), F.count_if("high_error").alias("n_high_error"),
        F.count_if(F.col("selected") & F.col("high_error")).alias("n_captured"),
        rate_of(F.col("selected"), F.col("high_error")).alias("capture"))


def rank_correlation_matrix(
    df: DataFrame, columns: Sequence[str], case_id: str, panel: Sequence[str] = ()
) -> DataFrame:
    """Spearman matrix in long form; every column is ranked in the same scan."""
    columns = list(columns)
    long = melt_scores(df.select(*panel, case_id, *columns), {c: c for c in columns})
    ranked = average_ranks(long, "score", [*panel, "method"])
    wide = ranked.groupBy(*panel, case_id).agg(*[
        F.max(F.when(F.col("method") == c, F.col("avg_rank"))).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    flat = wide.groupBy(*panel).agg(*[
        guarded_corr(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"r{i}").alias("spearman"))
               for i, (a, b) in enumerate(pairs)]
    return flat.select(*panel, F.explode(F.array(*entries)).alias("_e")).select(*panel, "_e.*")


def mean_sd(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample SD with flattened names."""
    return df.groupBy(*keys).agg(*[
        f for v in values for f in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd"))])


def macro_average(
    df: DataFrame, outer: Sequence[str], inner: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Mean within the inner keys, then mean and SD over them: every split weighs once."""
    within = df.groupBy(*outer, *inner).agg(*[F.avg(v).alias(v) for v in values])
    return mean_sd(within, outer, values)


def pooled_and_grouped(df: DataFrame, key: str, aggregates: Sequence[Column], pooled: str = "pooled") -> DataFrame:
    """The aggregates per key and once over all rows, in one pass of grouping sets."""
    return (df.groupingSets([[F.col(key)], []], F.col(key))
            .agg(F.grouping_id().alias("_g"), *aggregates)
            .withColumn(key, F.when(F.col("_g") == 0, F.col(key)).otherwise(F.lit(pooled)))
            .drop("_g"))


def difference_from(
    df: DataFrame, keys: Sequence[str], method: str, reference: str, values: Sequence[str]
) -> DataFrame:
    """Value minus the reference method's value within the same keys.

    The reference rows are an aggregate over the same keys, so no self-join is needed.
    """
    w = Window.partitionBy(*keys)
    ref = {v: F.max(F.when(F.col(method) == reference, F.col(v))).over(w) for v in values}
    return df.select("*", *[(F.col(v) - ref[v]).alias(f"{v}_difference") for v in values])


def ratio_to(df: DataFrame, keys: Sequence[str], level: str, reference: float, value: str) -> DataFrame:
    """Value divided by the value of the reference level within the same keys."""
    w = Window.partitionBy(*keys)
    base = F.max(F.when(F.col(level) == F.lit(reference), F.col(value))).over(w)
    return df.withColumn(f"{value}_ratio", safe_rate(F.col(value), base))


def signed_rate(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, SD, share of positive values and count: coefficient stability over replicates."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
        F.avg((v > 0).cast("double")).alias("positive_fraction"), F.count("*").alias("n_values"))
