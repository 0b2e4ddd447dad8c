"""Metrics, conformal intervals, risk score, distances: fixtures X13-X23 and brute force."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from quotaloom.functions import text, units
from quotaloom.operators import calibrate, metrics, neighbors, ranking, resample, support


def test_conformal_rank_is_an_order_statistic(spark):
    df = spark.createDataFrame([(f"c{i}", float(i), 0.0) for i in range(1, 20)], "case_id string, y_true double, y_pred double")
    r = calibrate.conformal_quantile(df, "y_true", "y_pred", None, [0.1]).first()
    assert (r.quantile_rank, r.n_calibration, r.qhat) == (18, 19, 18.0)


def test_sparse_groups_use_the_pooled_quantile(spark):
    cal = spark.createDataFrame([("a", 1.0, 0.0, "fish"), ("b", 1.0, 0.0, "fish"), ("c", 10.0, 0.0, "algae"), ("d", 10.0, 0.0, "algae")],
                                "case_id string, y_true double, y_pred double, g string")
    new = spark.createDataFrame([("x", 0.0, "fish"), ("y", 0.0, "unseen"), ("z", 0.0, None)], "case_id string, y_pred double, g string")
    got = {r.case_id: r.width for r in calibrate.group_conformal(cal, new, "y_true", "y_pred", "g", alpha=0.5, min_group=2).collect()}
    assert got == {"x": 2.0, "y": 20.0, "z": 20.0}


def test_decision_thresholds(spark):
    df = spark.createDataFrame([(0.1,), (0.6,), (0.9,)], "s double")
    assert [r.d for r in df.select(calibrate.decision_labels(F.col("s"), 0.5, 0.85).alias("d")).collect()] == ["predict", "warn", "abstain"]


def test_risk_scorer(spark):
    df = spark.createDataFrame([(0.1, False), (0.2, False), (0.8, True), (0.9, True)], "distance double, label boolean")
    s = calibrate.RiskScorer(["distance"], "label").fit(df)
    got = [r.r for r in df.select(s.score().alias("r")).collect()]
    assert got == sorted(got) and got[0] < got[-1]
    one = calibrate.RiskScorer(["distance"], "label").fit(df.withColumn("label", F.lit(False)))
    assert df.select(one.score().alias("r")).first().r == 0.0


def test_batched_newton_agrees_with_the_scorer(spark):
    rng = np.random.default_rng(5)
    x = rng.random((200, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0.6)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    got = resample.replicate_logistic(df.select(F.lit(0).alias("replicate"), "a", "b", "y", F.lit(1).alias("w")), ["a", "b"], "y", "w").first()
    scaled = calibrate.RiskScorer(["a", "b"], "y").fit(df)
    spans = [hi - lo for lo, hi in scaled.ranges.values()]
    # the scorer works on min-max scaled columns, so compare a scaled fit
    s = df.select(F.lit(0).alias("replicate"), "y", F.lit(1).alias("w"), *[scaled._scaled(c).alias(c) for c in ("a", "b")])
    beta = resample.replicate_logistic(s, ["a", "b"], "y", "w").first()
    assert got.converged and beta.converged and len(spans) == 2
    assert beta._b[:2] == pytest.approx(scaled.coefficients, abs=1e-3)


def test_selective_risk(spark):
    df = spark.createDataFrame([(f"c{i}", float(i) ** 2, 0.0, float(i)) for i in range(5)], "case_id string, y_true double, y_pred double, score double")
    r = ranking.selective_risk(df, "y_true", "y_pred", "score", [0.0, 0.2, 0.4]).orderBy("abstain_fraction").collect()
    assert [x.retained_fraction for x in r] == [1.0, 0.8, 0.6]
    assert r[0].rmse > r[1].rmse > r[2].rmse


def test_separation_with_ties(spark):
    df = spark.createDataFrame([(True, 0.9), (True, 0.5), (False, 0.5), (False, 0.1)], "pos boolean, s double")
    r = metrics.class_separation(df, "pos", "s").first()
    assert r.auroc == pytest.approx(0.875) and r.average_precision == pytest.approx(0.5 + 0.5 * 2 / 3) and r.fpr95 == 0.5


def test_spearman_ranks_ties_by_average(spark):
    pdf = pd.DataFrame({"a": [1, 2, 2, 3, 5], "b": [2, 1, 4, 4, 4]}, dtype=float)
    assert metrics.spearman(spark.createDataFrame(pdf), "a", "b").first().spearman == pytest.approx(pdf.a.rank().corr(pdf.b.rank()))


def brute(q, t, k):
    d = np.sqrt(((q[:, None, :] - t[None, :, :]) ** 2).sum(-1))
    return np.sort(d, axis=1)[:, :k].mean(1)


@pytest.mark.parametrize("tiles", [(1000, 1000), (7, 5)])
def test_tiled_knn_equals_brute_force(spark, tiles):
    rng = np.random.default_rng(0)
    q, t = rng.normal(size=(30, 4)), rng.normal(size=(41, 4))
    groups = rng.integers(0, 6, 41)
    qd = spark.createDataFrame([(f"q{i:02d}", v.tolist()) for i, v in enumerate(q)], "case_id string, vector array<double>")
    td = spark.createDataFrame([(f"t{i:02d}", str(groups[i]), v.tolist()) for i, v in enumerate(t)], "case_id string, g string, vector array<double>")
    kw = {"query_tile": tiles[0], "train_tile": tiles[1]}
    found = neighbors.nearest(qd, td, 5, neighbors.euclidean, ["vector"], **kw)
    got = [r.d for r in neighbors.mean_distance(qd, found, "d").orderBy("case_id").collect()]
    assert got == pytest.approx(brute(q, t, 5))
    d = np.sqrt(((q[:, None, :] - t[None, :, :]) ** 2).sum(-1))
    per = np.stack([d[:, groups == g].min(1) for g in range(6)], 1)
    found = neighbors.nearest(qd, td, 3, neighbors.euclidean, ["vector"], group="g", **kw)
    got = [r.d for r in neighbors.mean_distance(qd, found, "d").orderBy("case_id").collect()]
    assert got == pytest.approx(np.sort(per, axis=1)[:, :3].mean(1))


def test_distinct_tanimoto(spark):
    def words(bits): return [sum(1 << i for i, b in enumerate(bits) if b)]
    train = spark.createDataFrame([("1", "A", words([1, 1, 0, 0])), ("2", "A", words([1, 1, 1, 0])), ("3", "B", words([1, 0, 1, 0])),
                                   ("4", "C", words([0, 0, 1, 1]))], "case_id string, g string, words array<bigint>")
    q = spark.createDataFrame([("q", words([1, 1, 0, 0]))], "case_id string, words array<bigint>")
    found = neighbors.nearest(q, neighbors.first_per_group(train, "g", "case_id"), 2, neighbors.tanimoto, ["words"])
    assert neighbors.mean_distance(q, found, "d").first().d == pytest.approx((0 + 2 / 3) / 2)
    assert neighbors.tanimoto_novelty(q, train).first().similarity_novelty == 0
    assert neighbors.tanimoto_novelty(q, train.limit(0)).first().similarity_novelty == 1


def test_gower_without_candidates_is_one(spark):
    s = "case_id string, endpoint string, x double, m string"
    t = spark.createDataFrame([("a", "e", 0.0, "w"), ("b", "e", 10.0, None)], s)
    q = spark.createDataFrame([("q", "e", 5.0, "w"), ("r", "other", 1.0, "w"), ("n", None, 1.0, "w")], s)
    got = {r.case_id: r.context_distance for r in neighbors.gower_knn(q, t, "endpoint", ["x"], ["m"], 5).collect()}
    assert got["q"] == pytest.approx((0.25 + 0.5) / 2) and got["r"] == 1.0 and got["n"] == 1.0


def test_lineage_novelty(spark):
    levels = ["phylum", "class_name", "order", "family", "genus", "species"]
    s = "case_id string, " + ", ".join(f"`{c}` string" for c in levels)
    t = spark.createDataFrame([("1", "P", "C", "O", "F", "G", "S")], s)
    q = spark.createDataFrame([("a", "p", "c", "o", "f", "g", "s2"), ("b", "P", "C", "O", "F", " ", "S"), ("c", "X", "C", "O", "F", "G", "S")], s)
    got = {r.case_id: r.taxonomy_novelty for r in support.taxonomy_novelty(q, t, levels).collect()}
    assert got["a"] == pytest.approx(1 / 6) and got["b"] == pytest.approx(2 / 6) and got["c"] == 1.0


def test_moments_leverage_and_shrinkage(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3)) @ np.diag([1, 2, 0.5])
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "case_id string, vector array<double>").repartition(5)
    m = support.moments(df, "vector")
    assert m.n == 60 and m.gram == pytest.approx(x.T @ x) and m.low == pytest.approx(x.min(0))
    full = np.hstack([np.ones((60, 1)), x])
    h = np.einsum("ij,jk,ik->i", full, np.linalg.pinv(full.T @ full + 1e-8 * np.eye(4)), full)
    got = {int(r.case_id): r.leverage for r in support.leverage(df, df).collect()}
    assert [got[i] for i in range(60)] == pytest.approx(h)
    mean, precision, shrinkage = support.ledoit_wolf(df)
    c = x - x.mean(0)
    cov = c.T @ c / 60
    mu = np.trace(cov) / 3
    delta = ((cov - mu * np.eye(3)) ** 2).sum() / 3
    beta = min(sum(((np.outer(r, r) - cov) ** 2).sum() for r in c) / 60 ** 2 / 3, delta)
    assert shrinkage == pytest.approx(beta / delta)
    assert precision == pytest.approx(np.linalg.pinv((1 - shrinkage) * cov + shrinkage * mu * np.eye(3)))


def test_outliers_score_higher(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 2))
    t = spark.createDataFrame([(f"t{i}", v.tolist()) for i, v in enumerate(x)], "case_id string, vector array<double>")
    q = spark.createDataFrame([("in", [0.0, 0.0]), ("out", [9.0, 9.0])], "case_id string, vector array<double>")
    forest = support.isolation_trees(t, "vector", "case_id", trees=40, sample=64)
    for df, name in ((support.isolation_score(q, forest), "isolation_forest"), (neighbors.local_outlier_factor(q, t, k=10), "lof"),
                     (support.mahalanobis(q, t), "mahalanobis"), (support.range_score(q, t), "range_score")):
        got = {r["case_id"]: r[name] for r in df.collect()}
        assert got["out"] > got["in"], name


def test_multiplicities_sum_to_the_panel(spark):
    e = spark.createDataFrame([(f"e{i}",) for i in range(40)], "entity string")
    w = resample.multiplicities(e, "entity", 5, 1)
    assert {r.n for r in w.groupBy("replicate").agg(F.sum("w").alias("n")).collect()} == {40}


def test_hierarchical_bootstrap_runs_the_references_replicates(spark):
    """2,000 draws, as in the reference, of differences and of each method's own interval."""
    from quotaloom.plans import catalog

    got = catalog.QUERIES["hierarchical_bootstrap"](spark, "/root/testdata/sf0.001").collect()
    assert got and max(r.n_values for r in got) == 2000 and all(r.ci_lower <= r.median <= r.ci_upper for r in got)
    own = {(r.method, r.metric): r for r in catalog.QUERIES["hierarchical_intervals"](spark, "/root/testdata/sf0.001").collect()}
    assert {m for m, _ in own} == {"first", "second", "random"}
    assert own["random", "false_negative_capture"].mean == pytest.approx(0.25, abs=0.02)


def fits_and_flags(spark, people=3, copies=1):
    """Two fits of a few entities with two methods; ``copies`` repeats every entity under other names."""
    base = [("F", 0, True, False, True, False), ("F", 1, True, False, False, True), ("F", 2, False, False, True, False),
            ("O", 0, True, True, True, False), ("O", 1, True, False, False, False), ("O", 2, False, False, False, True)]
    data = [(s, f"e{i}-{c}", m, th, ph, (a, b)[m == "b"]) for s, i, th, ph, a, b in base if i < people for c in range(copies) for m in "ab"]
    return base, spark.createDataFrame(data, "split string, entity string, method string, true_high boolean, pred_high boolean, reviewed boolean")


def test_hierarchical_bootstrap_has_the_means_of_all_possible_draws(spark):
    """Every draw of fits, entities and random reviews is listed by hand; replicates have their mean and their variance."""
    base, df = fits_and_flags(spark)
    def rates(rows):  # (true high, predicted high, reviewed) of one slot
        miss = [r for t, p, r in rows if t and not p]
        left = [t for t, p, r in rows if not p and not r]
        return (sum(miss) / len(miss) if miss else None, sum(left) / len(left) if left else None, 100 * sum(miss) / sum(r for *_, r in rows) if any(r for *_, r in rows) else None)
    def listed(flags_of):
        slots = [rates(rows) for s in "FO" for pick in itertools.product([x for x in base if x[0] == s], repeat=3) for rows in flags_of(pick)]
        pairs = itertools.product(slots, repeat=2)
        return [[[v for v in (x[i], y[i]) if v is not None] for i in range(3)] for x, y in pairs]
    expected = {"a": listed(lambda pick: [[(x[2], x[3], x[4]) for x in pick]]), "b": listed(lambda pick: [[(x[2], x[3], x[5]) for x in pick]]),
                "random": listed(lambda pick: [[(x[2], x[3], j == k) for j, x in enumerate(pick)] for k in range(3)])}
    got = {}
    values = resample.hierarchical_bootstrap(df, "split", 4000, random="random")
    for r in values.where("value IS NOT NULL").collect():
        got.setdefault((r.method, r.metric), []).append(r.value)
    for method, draws in expected.items():
        for i, metric in enumerate(("false_negative_capture", "lower_priority_false_omission_rate", "rescued_per_100_reviews")):
            want = np.array([np.mean(d[i]) for d in draws if d[i]])
            have = np.array(got.get((method, metric), []))
            assert abs(len(have) / 4000 - len(want) / len(draws)) < 0.03, (method, metric)
            assert abs(have.mean() - want.mean()) < 4.5 * want.std() / np.sqrt(len(have)) + 1e-9, (method, metric)
            assert have.std() == pytest.approx(want.std(), rel=0.08, abs=1e-9), (method, metric)


def test_hierarchical_draws_do_not_grow_with_entities(spark):
    """A hundred times the entities: as many rows are drawn, sums are those of the entities, blocks of patterns change no total, reruns agree."""
    rows = {}
    for copies in (1, 100):
        _, df = fits_and_flags(spark, copies=copies)
        draws = resample.pattern_draws(df, "split", 50, 42, "entity", ["method"])
        rows[copies] = draws.count()
        assert {r.n for r in draws.groupBy("replicate", "slot").agg(F.sum("w").alias("n")).collect()} == {3 * copies}
    assert rows[1] <= rows[100] <= 50 * 2 * 3
    cut = resample.pattern_draws(df, "split", 200, 42, "entity", ["method"], width=2)
    assert {r.n for r in cut.groupBy("replicate", "slot").agg(F.sum("w").alias("n")).collect()} == {300}
    mean = {r._k: r.m for r in cut.groupBy(F.to_json("pattern").alias("_k")).agg((F.sum("w") / 400).alias("m")).collect()}
    assert len(mean) == 6 and all(abs(m - 50) < 15 for m in mean.values())
    one, two = (sorted(map(tuple, resample.hierarchical_bootstrap(df.repartition(k), "split", 20, random="r").collect()), key=str) for k in (1, 7))
    assert one == two
    assert not resample.hierarchical_bootstrap(df.limit(0), "split", 5, random="r").count()


def test_draws_without_replacement_by_binomials():
    """Whole quota, no class over its size, the hypergeometric mean and variance, and sizes far over numpy's own limit."""
    rng, sizes = resample.seeded("x"), np.array([5, 3, 0, 12])
    for k in (0, 1, 19, 20):
        got = resample.take_without_replacement(rng, sizes, k)
        assert got.sum() == k and (got >= 0).all() and (got <= sizes).all()
    draws = np.array([resample.take_without_replacement(rng, sizes, 6) for _ in range(8000)])
    assert draws.mean(axis=0) == pytest.approx(6 * sizes / 20, abs=0.05)
    assert draws.var(axis=0) == pytest.approx(6 * sizes / 20 * (1 - sizes / 20) * 14 / 19, abs=0.06)
    huge = np.array([4 * 10 ** 12, 10 ** 10])
    got = resample.take_without_replacement(rng, huge, 10 ** 12)
    assert got.sum() == 10 ** 12 and got[1] == pytest.approx(10 ** 22 / huge.sum(), rel=1e-3)


def test_meta_bootstrap_resamples_whole_clusters(spark):
    data = [(f"c{i}", f"g{i % 4}", float(i), float((i * 7) % 12), float(i) / 12 + (i % 3) * 0.1) for i in range(12)]
    df = spark.createDataFrame(data, "case_id string, entity string, a double, b double, r double")
    got = resample.meta_bootstrap(df, ["a", "b"], "r", "entity", 5).collect()
    assert len(got) == 5 and all(x.sampled_case_n % 3 == 0 for x in got)


@pytest.mark.parametrize("value,unit,mw,expected", [("1", "nM", None, 1e-9), ("1", "AI mg/L", "100", 1e-5), ("1", "AE mg/L", "100", None),
                                                    ("-1", "M", None, None), ("x", "M", None, None), ("1", "mg/L", "0", None)])
def test_units(spark, value, unit, mw, expected):
    r = spark.createDataFrame([(value, unit, mw)], "v string, u string, w string").select(units.to_molar(F.col("v"), F.col("u"), F.col("w")).alias("m")).first()
    assert r.m == (pytest.approx(expected) if expected else None)


@pytest.mark.parametrize("raw,value,unit,censored", [
    ("12.5 mg/L", 12.5, "mg/L", False), ("1-2 mg/L", None, "mg/L", True), ("~ 3 mg/L", None, "mg/L", True), ("ca. 3 mg/L", None, "mg/L", True),
    ("> 3 mg/L", None, "mg/L", True), ("1,2 mg/L", None, "mg/L", True), ("0 mg/L", None, "mg/L", False), ("1,200e-3 ug/L", 1.2, "µg/L", False),
    ("5", 5.0, "", False), ("none", None, "", False)])
def test_effect_text(spark, raw, value, unit, censored):
    r = spark.createDataFrame([(raw,)], "t string").select(text.parse_effect_value(F.col("t")).alias("p")).first().p
    assert (r.value, r.unit, r.is_censored) == (value, unit, censored)


def test_duration_and_escape_text(spark):
    df = spark.createDataFrame([("4 d",), ("48 hours",), ("72 - 96 h",)], "t string")
    assert [r.h for r in df.select(text.parse_duration_hours(F.col("t")).alias("h")).collect()] == [96.0, 48.0, None]
    df = spark.createDataFrame([("=1+1", 1.0), (" @SUM(A1)", -2.0), ("plain", 3.0)], "name string, value double")
    assert [tuple(r) for r in text.escape_formulas(df).collect()] == [("'=1+1", 1.0), ("' @SUM(A1)", -2.0), ("plain", 3.0)]


def test_hashed_fingerprint_covers_the_whole_text(spark):
    long = "abc" * 4000
    df = spark.createDataFrame([("a", long), ("b", long + "xyz"), ("c", None), ("d", "ab")], "k string, t string")
    got = {r.k: r.bits for r in df.select("k", text.hashed_fingerprint(F.col("t")).alias("bits")).collect()}
    grams = {long[i:i + 3] for i in range(len(long) - 2)}
    assert len(got["a"]) == len(grams) and set(got["a"]) < set(got["b"]) and len(got["d"]) == 1
    assert rows(df.limit(0)) == []


@pytest.mark.parametrize("quota", [0, 1, 17, 40, 10 ** 6])
def test_quota_weights_take_the_first_copies(spark, quota):
    rng = np.random.default_rng(8)
    rows = [(r, p, int(w)) for r in range(4) for p, w in zip(rng.permutation(60) + 1, rng.integers(0, 4, 60))]
    df = spark.createDataFrame([(r, int(p), w) for r, p, w in rows], "replicate int, place int, w long")
    got = resample.quota_weights(df, ["replicate"], "place", 60, "w", F.least(F.lit(quota), F.col("_total"))).collect()
    assert len(got) == len(rows)
    for r in range(4):
        left = quota
        for x in sorted((x for x in got if x.replicate == r), key=lambda x: x.place):
            assert x.reviewed == min(left, x.w)
            left -= x.reviewed


def test_support_increment_compares_what_it_is_told_to(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(f"e{i}", bool(rng.random() < 0.4), bool(rng.random() < 0.3), float(rng.random()), float(rng.random())) for i in range(80)],
                               "entity string, true_high boolean, pred_high boolean, a double, b double")
    got = resample.support_increment(df, {"a": "a", "b": "b", "a again": "a"}, [("b", "a"), ("a again", "a")], reps=40).collect()
    assert {(r.method, r.reference) for r in got} == {("b", "a"), ("a again", "a")} and len(got) == 6
    assert all(r.n_values == 40 and r.ci_lower <= r.median <= r.ci_upper for r in got)
    assert all(r["mean"] == 0 and r.share_better == 0 for r in got if r.method == "a again")
    with pytest.raises(ValueError, match="without a score: c"):
        resample.support_increment(df, {"a": "a"}, [("a", "c")])


def test_a_million_categories_stay_in_their_table(spark):
    df = spark.range(1_000_000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    table = support.index_categories(df, ["a", "b"])
    assert table.count() == 1_000_003 and table.agg(F.min("slot"), F.max("slot"), F.countDistinct("slot")).first() == (0, 1_000_002, 1_000_003)
    some = spark.createDataFrame([("c5", "1"), ("nobody", "2"), ("c7", None), (None, "other")], "a string, b string")
    slots = {(r.a, r.b): r.slots for r in support.one_hot_slots(some, table, ["a", "b"], "slots").collect()}
    at = {(r["name"], r["value"]): r["slot"] for r in table.where("name = 'b' or value in ('c0', 'c5', 'c7')").collect()}
    assert slots == {("c5", "1"): [at["a", "c5"], at["b", "1"]], ("nobody", "2"): [at["b", "2"]], ("c7", None): [at["a", "c7"], at["b", "0"]],
                     (None, "other"): [at["a", "c0"]]}
    with pytest.raises(ValueError, match="sparsely"):
        support.one_hot_categories(df, ["a"])


def test_ablation_pairs_each_panel_with_its_full_score(spark):
    rng = np.random.default_rng(10)
    pdf = pd.DataFrame({"case_id": [f"c{i:03d}" for i in range(240)], "entity": [f"e{i % 60}" for i in range(240)], "endpoint": ["x", "y"] * 120,
                        "split": ["A"] * 120 + ["B"] * 120, "y_true": rng.normal(size=240), "y_pred": rng.normal(size=240),
                        "noise": rng.random(240), "twin": np.nan, "risk": np.nan})
    pdf["risk"] = (pdf.y_true - pdf.y_pred).abs() / 10
    pdf["twin"] = pdf.risk
    from quotaloom.operators import ablation
    deltas = ablation.ablation_deltas(spark.createDataFrame(pdf), ["risk", "twin", "noise"], ["split"])
    got = {(r.split, r.removed, r.metric): r for r in deltas.collect()}
    assert len(got) == 2 * 4 * 2 and all(r.delta == 0 for (_, removed, _), r in got.items() if removed == "full")
    for split, part in pdf.groupby("split"):
        def area(score):
            risk = part.assign(s=score, e=part.risk * 10).sort_values(["s", "case_id"]).e.expanding().mean().to_numpy()
            return (risk.sum() - (risk[0] + risk[-1]) / 2) / len(risk)
        full = area((part.risk + part.twin + part.noise) / 3)
        assert got[split, "noise", "aurc"].delta == pytest.approx(area((part.risk + part.twin) / 2) - full)
        assert got[split, "noise", "aurc"].delta < got[split, "risk", "aurc"].delta == pytest.approx(got[split, "twin", "aurc"].delta)
    with pytest.raises(ValueError):
        ablation.left_out(["risk"])


def scorer_rows(spark, n, seed, prefix):
    rng = np.random.default_rng(seed)
    data = [(f"{prefix}{i:03d}", None if i % 11 == 0 else f"e{i % 9}", ["p", "q", None][i % 3], [int(rng.integers(1, 2 ** 40))], rng.normal(size=2).tolist(),
             "phylum", f"genus{i % 4}" if i % 5 else None, float(i % 7) if i % 6 else None, ["m", "n", None][i % 3], float(rng.normal()) if i % 4 else None, float(rng.random()), float(rng.random()))
            for i in range(n)]
    return spark.createDataFrame(data, "case_id string, entity string, endpoint string, words array<long>, descriptor array<double>, phylum string, genus string, x double, "
                                       "medium string, g double, spread double, abs_error double")


def test_eight_components_weights_and_axes(spark):
    """Components of hand-checked rows, axes scaled by the calibration range, weights by sign, and the mean where labels are all equal."""
    from quotaloom.operators.scorer import AXES, COMPONENTS, ErrorRiskScorer

    train, cal = scorer_rows(spark, 60, 1, "t"), scorer_rows(spark, 80, 2, "c")
    fitted = ErrorRiskScorer("words", "descriptor", ["phylum", "genus"], ["x"], ["medium"], ["g"], k=3).fit(train)
    assert fitted.reps.count() == 10  # nine entities and the rows without one
    with pytest.raises(RuntimeError):
        fitted.scores(cal)
    parts = fitted.components(cal, "spread")
    got = {r.case_id: r for r in parts.collect()}
    assert len(got) == 80 and parts.columns == ["case_id", *COMPONENTS]
    src = {r.case_id: r for r in cal.collect()}
    reps = {r.case_id: r for r in fitted.reps.collect()}
    for cid, r in got.items():
        q = src[cid]
        sims = sorted(1 - bin(q.words[0] & t.words[0]).count("1") / bin(q.words[0] | t.words[0]).count("1") for t in reps.values())[:3]
        signal = [0.0] if q.g is None else sorted(abs(q.g - t.g) / np.std([x.g for x in reps.values() if x.g is not None]) for t in reps.values() if t.g is not None)[:3]
        assert r.d_chem_knn == pytest.approx(np.mean(sims)) and r.d_mech == pytest.approx(np.mean(signal)) and r.u_model == q.spread
        assert (r.bioactivity_missing_fraction, r.context_missing_fraction) == (float(q.g is None), float(q.x is None))
        assert r.d_species_tax == (0.0 if q.genus else 0.5) and (q.endpoint is not None or r.d_context == 1.0)
    # errors that follow the model's own uncertainty give it the largest weight
    known = parts.join(cal.select("case_id", "endpoint", F.col("spread").alias("abs_error")), "case_id")
    fitted.fit_meta(known, "abs_error", 0.8, group="endpoint", balance=True)
    d = fitted.diagnostics()
    assert d["coef_u_model"] == max(v for k, v in d.items() if k.startswith("coef_")) > 0 and d["calibration_n"] == 80
    scored = {r.case_id: r for r in fitted.scores(parts).collect()}
    low, high = min(r.u_model for r in got.values()), max(r.u_model for r in got.values())
    for cid, r in scored.items():
        assert 0 <= r.risk_score <= 1 and r.axis_uncertainty == pytest.approx((got[cid].u_model - low) / (high - low))
    # constant errors: every label is high, and the score is the mean of the scaled components
    flat = fitted.fit_meta(parts.withColumn("abs_error", F.lit(1.0)), "abs_error").scores(parts).collect()
    assert fitted.diagnostics()["high_error_n"] == 80
    for r in flat:
        sizes = {a: len(c) for a, c in AXES.items()}
        assert r.risk_score == pytest.approx(sum(r[f"axis_{a}"] * k for a, k in sizes.items()) / 8)
    assert not fitted.scores(fitted.components(cal.limit(0), "spread")).count()


def test_packed_draws_are_the_draws_of_the_weights_table(spark):
    """More entities than a block has and more replicates than a batch has; a draw is two bytes of a message and not a row."""
    n, reps = 70_000, 102
    entities = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("domain"), F.col("id").alias("_i"), F.lit(n).cast("long").alias("_n"))
    messages = resample.packed_draws(entities.select("domain", "_n").distinct(), reps, 42)
    blocks = resample.packed_blocks(entities.select("domain", "_i", F.col("_i").alias("value")), reps)

    def look(replicate, w, columns, message):
        yield replicate, int(w.sum()), int((w * columns["value"] ** 2).sum()), int((w * w).sum())
    found = resample.visit_blocks(messages, blocks, look, "replicate int, n long, v long, c long").groupBy("replicate").agg(F.sum("n"), F.sum("v"), F.sum("c"))
    few = entities.select("_i", "_n")
    weights = resample.weights_by_index(few, 2, 42).groupBy("replicate").agg(F.sum("w"), F.sum(F.col("w") * F.col("_i") ** 2).cast("long"), F.sum(F.col("w") * F.col("w")))
    got = {r[0]: tuple(r[1:]) for r in found.collect()}
    assert len(got) == reps and {v[0] for v in got.values()} == {n}
    assert {r[0]: tuple(r[1:]) for r in weights.collect()} == {k: got[k] for k in (0, 1)}
    assert messages.count() <= 3 * reps and messages.agg(F.sum(F.length("offsets"))).first()[0] == 2 * n * reps


def test_bootstraps_do_not_join_rows_of_draws(spark):
    """Every shuffle of the replicates is of messages: it was of entities x replicates rows."""
    df = spark.createDataFrame([(str(i), i % 3 == 0, i % 2 == 0, float(i % 7), p) for i in range(40) for p in ("x", "y", None)],
                               "entity string, true_high boolean, pred_high boolean, a double, part string")
    rates = resample.replicate_rates(df.where("part = 'x'"), {"a": "a"}, 0.25, 30)
    for out in (rates, resample.macro_bootstrap(df.withColumn("b", -F.col("a")), ["part"], {"a": "a", "b": "b"}, "a", 30, "a")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "sha2" not in plan
    assert rates.count() == 30 * 2 * 3


def test_quota_cuts_take_the_first_copies(spark):
    """Next to brute force: copies in order of place, for a quota that ends within a row's copies; unknown panels are panels."""
    n, reps = 50, 12
    df = spark.createDataFrame([(str(i), i % 3 == 0, i % 5 == 0, float(i * 7 % 11), i % 2) for i in range(n)], "entity string, true_high boolean, pred_high boolean, a double, part int")
    got = {(r["replicate"], r["metric"]): r["value"] for r in resample.replicate_rates(df, {"a": "a"}, 0.3, reps, random=None).collect()}
    order = sorted(range(n), key=lambda i: str(i))
    people = spark.createDataFrame([(k + 1, n, e) for k, e in enumerate(order)], "_i long, _n long, e int")
    drawn = {(r["replicate"], r["e"]): r["w"] for r in resample.weights_by_index(people.select("_i", "_n"), reps, 42).join(people, "_i").collect()}
    for r in range(reps):
        queue = [i for i in sorted(range(n), key=lambda i: (i % 5 == 0, -float(i * 7 % 11), str(i))) for _ in range(drawn.get((r, i), 0))]
        quota = round(len(queue) * 0.3)
        def misses(part): return sum(i % 3 == 0 and i % 5 != 0 for i in part)
        assert got[r, "false_negative_capture"] == pytest.approx(misses(queue[:quota]) / misses(queue))
        assert got[r, "lower_priority_false_omission_rate"] == pytest.approx(misses(queue[quota:]) / sum(i % 5 != 0 for i in queue[quota:]))


def test_numbered_cases_stand_in_the_order_of_their_numbers(spark):
    df = spark.createDataFrame([(10, 1.0, 4.0), (2, 1.0, 2.0), (1, 3.0, 6.0)], "n long, score double, error double")
    got = ranking.risk_coverage(df, "error", "score", "n", numbered=True).orderBy("rank").collect()
    assert [(r["n"], r["risk"]) for r in got] == [(2, 2.0), (10, 3.0), (1, 4.0)]
