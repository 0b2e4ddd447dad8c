"""Queues, routes, workload curves, residual triage: fixtures X1-X12."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quotaloom.operators import metrics, ranking, rollup, routing
from quotaloom.plans import protocol

DEV = [("D%d" % i, p, t, y, q, l, d, u) for i, (p, t, y, q, l, d, u) in enumerate([
    (False, True, 1.0, 3.0, 2.0, 0.9, 0.1), (False, True, 1.2, 2.9, 1.7, 0.8, 0.2), (True, True, 1.0, 1.1, 0.1, 0.1, 0.9),
    (True, False, 3.0, 1.0, 0.0, 0.2, 0.8), (False, False, 3.0, 3.1, 0.1, 0.3, 0.7), (False, False, 3.2, 3.1, 0.0, 0.4, 0.6),
    (True, True, 1.1, 1.0, 0.0, 0.15, 0.5), (False, False, 2.9, 3.0, 0.1, 0.05, 0.3)])]
SCHEMA = "entity string, pred_high boolean, true_high boolean, y_true double, y_pred double, loss double, distance double, spread double"
CANDIDATES = {"distance": "distance", "spread": "spread"}


@pytest.fixture
def dev(spark):
    return spark.createDataFrame(DEV, SCHEMA)


@pytest.fixture
def queue(spark):
    data = [("Q%d" % i, p, e, d, u) for i, (p, e, d, u) in enumerate([
        (False, True, 0.95, 0.1), (True, True, 0.9, 0.2), (False, True, 0.2, 0.3), (True, True, 0.1, 0.4),
        (False, True, 0.3, 0.5), (False, True, 0.4, 0.6), (True, True, 0.15, 0.7), (False, False, None, None)])]
    return spark.createDataFrame(data, "entity string, pred_high boolean, input_eligible boolean, distance double, spread double")


def test_signal_choice_by_capture(dev):
    m = routing.evaluate_signals(dev, CANDIDATES)
    got = {r.signal: r.false_negative_capture for r in m.collect()}
    assert got == {"distance": 1.0, "spread": 0.0}
    assert routing.select_signal(m, "false_negative_capture", "spread").first().selected_signal == "distance"


@pytest.mark.parametrize("fraction,reviewed,capture,omission_null", [(0, 0, 0.0, False), (0.01, 0, 0.0, False), (1, 8, 1.0, True)])
def test_quota_edges(dev, fraction, reviewed, capture, omission_null):
    r = metrics.omission_metrics(ranking.review_queue(dev, "distance", fraction)).first()
    assert (r.review_n, r.false_negative_capture) == (reviewed, capture)
    assert (r.lower_priority_false_omission_rate is None) == omission_null


def test_directional_area(dev):
    m = routing.evaluate_signals(dev, CANDIDATES, "directional_underprediction_area")
    got = {r.signal: r.directional_underprediction_capture_area for r in m.collect()}
    assert got["distance"] > 0.5 > got["spread"]


def test_uninformative_labels_fall_back(dev):
    m = routing.evaluate_signals(dev.withColumn("true_high", F.lit(False)), CANDIDATES)
    got = routing.select_signal(m, "false_negative_capture", "spread").first()
    assert tuple(got) == ("spread", "benchmark_default_no_false_negatives")


def test_routes(queue):
    got = {r["entity"]: r for r in rows(routing.route_queue(queue, "distance", 0.25))}
    assert got["Q0"]["route"] == "withhold_review" and got["Q0"]["review_rank"] == 1
    assert got["Q1"]["route"] == "prioritize_testing" and got["Q3"]["route"] == "screen_now"
    assert got["Q7"]["route"] == "withhold_review" and not got["Q7"]["reviewed"] and got["Q7"]["review_rank"] is None
    assert sum(r["reviewed"] for r in got.values()) == 2


@pytest.mark.parametrize("fraction,expected", [(0, 0), (0.01, 0), (0.25, 2), (1, 7)])
def test_quota_counts_eligible_rows_only(queue, fraction, expected):
    assert routing.route_queue(queue, "distance", fraction).where("reviewed").count() == expected


def test_ties_do_not_depend_on_input_order(queue):
    tied = queue.withColumn("distance", F.lit(0.5))
    for df in (tied, tied.orderBy(F.desc("entity")).coalesce(1), tied.repartition(4)):
        got = routing.route_queue(df, "distance", 0.25, "low_concern_first").where("reviewed")
        assert sorted(r.entity for r in got.collect()) == ["Q0", "Q2"]


def test_missing_score_of_a_scoreable_row_fails(queue):
    bad = queue.withColumn("distance", F.when(F.col("entity") != "Q1", F.col("distance")))
    with pytest.raises(Exception, match="nonfinite"):
        routing.route_queue(bad, "distance", 0.25).collect()


def test_protocol_end_to_end(queue, dev):
    out = protocol.apply_protocol(queue, dev, CANDIDATES, "spread")
    assert (out.signal, out.source) == ("distance", "development_labels")
    assert protocol.apply_protocol(queue, None, CANDIDATES, "spread").source == "benchmark_default_no_local_labels"
    with pytest.raises(ValueError, match="disjoint"):
        protocol.apply_protocol(queue, dev.withColumn("entity", F.regexp_replace("entity", "D", "Q")), CANDIDATES, "spread")
    with pytest.raises(ValueError, match="one row per entity"):
        protocol.apply_protocol(queue.unionAll(queue), dev, CANDIDATES, "spread")


def test_entity_ranking_rules(spark):
    df = spark.createDataFrame([("a", 0.1, 0.1, 0.2, 0.3, False), ("b", 0.4, 0.2, 0.2, 0.3, False),
                                ("c", 0.9, 0.3, 0.2, 0.3, False), ("d", -0.5, 0.9, 0.2, 0.3, True)],
                               "entity string, margin_log10 double, block_knn double, similarity_ad double, ensemble_sd double, predicted_high boolean")
    def order(task): return [r.entity for r in ranking.rank_entities(df, task, 1).orderBy("rank").collect()]
    assert order("hazard_omission") == ["a", "b", "c", "d"]
    assert order("general_error") == ["d", "c", "b", "a"]
    with pytest.raises(Exception, match="exceeds the 4"):
        ranking.rank_entities(df, "general_error", 5).collect()
    with pytest.raises(ValueError):
        ranking.rank_entities(df, "general_error", 1, "threshold_proximity")
    assert ranking.review_queue(df.limit(2), "block_knn", 0.25).where("reviewed").count() == 0


def test_case_rollup(spark):
    data = [("c1", "A", "e1", 1.0, 1.0, 0.2), ("c2", "A", "e1", 1.0, 1.0, 0.4), ("c3", "A", "e2", 1.0, 2.5, 0.8), ("c4", "B", "e1", 3.0, 3.0, 0.1)]
    cases = spark.createDataFrame(data, "case_id string, entity string, endpoint string, y_true double, y_pred double, s double")
    cut = spark.createDataFrame([("e1", 1.5), ("e2", 1.5)], "endpoint string, cutoff double")
    got = {r["entity"]: r for r in rows(rollup.entity_panel(cases, cut, ["s"]))}
    a = got["A"]
    assert a["true_high"] and a["pred_high"] and (a["endpoint_count"], a["case_count"]) == (2, 3)
    assert a["s"] == pytest.approx(0.8) and a["loss"] == pytest.approx(1.5)
    assert not got["B"]["true_high"]
    # missed on one endpoint, but not a missed entity
    assert a["any_miss"]
    with pytest.raises(Exception, match="without a concern cutoff"):
        rollup.entity_panel(cases, cut.where("endpoint = 'e1'"), ["s"]).collect()


def test_workload_curve(spark):
    data = [("e%d" % i, i in (0, 3), i >= 6, float(8 - i)) for i in range(8)]
    df = spark.createDataFrame(data, "entity string, true_high boolean, pred_high boolean, score double")
    curve = ranking.workload_curve(df, "score", policy="low_concern_first").orderBy("k").collect()
    assert len(curve) == 9 and curve[0].capture == 0 and curve[-1].capture == 1
    assert curve[-1].false_omission_rate is None
    assert [c.capture for c in curve] == sorted(c.capture for c in curve)
    r = metrics.random_reference(df, 0.25).first()
    assert r.false_negative_capture == 0.25 and r.low_capture == pytest.approx(2 / 6)
    assert ranking.curve_area(ranking.workload_curve(df, "score"), "capture").first().area == pytest.approx(
        sum((curve[i].capture + curve[i + 1].capture) / 16 for i in range(8)))


def test_no_misses_is_null_not_zero(spark):
    df = spark.createDataFrame([("a", False, False, 1.0), ("b", False, True, 0.5)], "entity string, true_high boolean, pred_high boolean, s double")
    assert metrics.omission_metrics(ranking.review_queue(df, "s", 0.5)).first().false_negative_capture is None
    assert routing.matched_queue(df, "s", {"s": "s"}).first().single_capture is None


def test_residual_stage_reviews_as_many_again(spark):
    data = [("e%02d" % i, i % 3 == 0, i >= 12, i % 3 == 0 and i < 12, float(i), float(-i)) for i in range(16)]
    df = spark.createDataFrame(data, "entity string, true_high boolean, pred_high boolean, any_miss boolean, near double, far double")
    second = routing.two_stage_review(df, "near", {"far": "far"})
    r = {x.method: x for x in routing.residual_triage(second).collect()}
    assert (r["far"].initial_review_n, r["far"].n_residual, r["far"].additional_review_n) == (4, 8, 4)
    assert r["random_second_stage"].residual_capture == 0.5


def test_fixed_thresholds_are_inclusive_at_the_boundary(spark):
    df = spark.createDataFrame([("a", "A", "e", 1.0 + 1e-14, 0.9, 0.1), ("b", "B", "e", 1.1, 1.2, 0.2)],
                               "case_id string, entity string, endpoint string, y_true double, y_pred double, s double")
    got = {r["entity"]: r["true_high"] for r in rows(rollup.absolute_panel(df, [1.0], scores=["s"]))}
    assert got == {"A": True, "B": False}
