"""What broke, or did less than its whole job, on the larger tables of round 4."""

import hashlib

import numpy as np
import pytest

from quotaloom.functions import draws
from quotaloom.operators import neighbors, resample, scan
from quotaloom.operators.ensemble import BootstrapEnsemble
from quotaloom.plans import queries_runs


def test_pivots_take_arrays_whose_elements_are_never_null(spark):
    """an array made of columns that are never null has another Arrow type than its schema as text."""
    rng = np.random.default_rng(4)
    data = [(f"{i:04d}", "e", float(x), None if i % 5 == 0 else str(i % 3)) for i, x in enumerate(rng.normal(size=90))]
    rows = spark.createDataFrame(data, "case_id string, endpoint string, x double, medium string")
    fields = neighbors.context_fields(rows, ["x"], ["medium"], {"x": 6.0})
    assert not fields.schema["codes"].dataType.containsNull
    q, t = fields.where("case_id < '0020'"), fields.where("case_id >= '0020'")

    def found(leaf):
        got = neighbors.search(q, t, 3, neighbors.gower, ["vector", "codes"], on="endpoint", leaf=leaf).found
        return {(r.case_id, r.neighbor_rank): (r.neighbor_id, pytest.approx(r.distance)) for r in got.collect()}
    assert found(8) == found(1000) and len(found(8)) == 60


def test_quantiles_of_ties_that_are_too_many_for_a_task(spark, monkeypatch):
    """A cell over HOT_GROUP_ROWS is put in order by a scan, whose own columns must not meet those of the quantiles."""
    monkeypatch.setattr(scan, "HOT_GROUP_ROWS", 20)
    rows = spark.createDataFrame([(p, float(v)) for p in "ab" for v in [1] * 40 + [2] * 30 + [9]], "p string, v double")
    got = {r.p: (r.m, r.h) for r in scan.quantiles(rows, "v", {"m": 0.5, "h": 0.985}, ["p"]).collect()}
    expected = tuple(np.quantile([1] * 40 + [2] * 30 + [9], [0.5, 0.985]))
    assert got == {"a": pytest.approx(expected), "b": pytest.approx(expected)}


def test_runs_fit_all_members_and_rounds(spark, monkeypatch):
    """Two members and eight rounds stood for the five and 400 of the reference."""
    class Fitted(Exception):
        pass

    def fit(self, train, features, target, case_id="case_id"):
        raise Fitted(self.learner, self.members, self.params)
    monkeypatch.setattr(BootstrapEnsemble, "fit", fit)
    data = [(str(i), str(i % 12), "ANR"[i % 3], float(i % 7), float(i % 5), float(i % 4), float(i % 3), float(i % 2), f"b{i % 2}", "F", "s", "n", "r", 1995, p)
            for i, p in zip(range(90), ["train"] * 40 + ["calibration", "test"] * 25)]
    rows = spark.createDataFrame(data, "case_id string, entity string, endpoint string, y_true double, quantity double, size double, discount double, tax double, "
                                       "brand string, medium string, species string, n_name string, r_name string, study_year int, partition string")
    monkeypatch.setattr(queries_runs, "featured", lambda *a: rows)
    monkeypatch.setattr(queries_runs.splits, "three_way_group_split", lambda df, *a: df)
    monkeypatch.setattr(queries_runs, "raw_cases", lambda *a: rows)
    monkeypatch.setattr(queries_runs.splits, "time_split", lambda df, *a, **k: df)
    monkeypatch.setattr(queries_runs.gates, "prepare_inputs", lambda df, rules: (df, df.limit(0)))
    for run in (queries_runs.experiment_scores, queries_runs.review_run):
        with pytest.raises(Fitted) as seen:
            run(spark, "")
        learner, members, params = seen.value.args
        assert (learner, members, params["maxIter"], params["stepSize"], params["maxDepth"]) == ("gbt", 5, 400, 0.05, 6)


def test_boosted_members_take_the_parameters_of_the_runs(spark):
    rows = spark.createDataFrame([(str(i), [float(i % 7), float(i % 3)], float(i % 7)) for i in range(60)], "case_id string, full array<double>, y double")
    model = BootstrapEnsemble("gbt", 2, 42, **{**queries_runs.TREES, "maxIter": 3}).fit(rows, "full", "y")
    assert [m.getNumTrees for m in model.models] == [3, 3] and model.predict(rows, "full").where("y_pred is null").count() == 0


@pytest.mark.parametrize(("prefix", "low", "high"), [("42|7|", 1, 12_000), ("42|1999|", 65_000, 140_000), ("a" * 47 + "|é|", 99_990, 105_000), ("x" * 60, 5, 9_000)])
def test_draws_of_a_run_are_digests(prefix, low, high):
    """draws are hashed side by side, over changes of length, one block of SHA-256 or two."""
    expected = [int(hashlib.sha256(f"{prefix}{i}".encode()).hexdigest()[:13], 16) / 2 ** 52 for i in range(low, high)]
    assert draws.unit_draws(prefix, low, high).tolist() == expected


def test_draws_and_codes_are_not_made_for_every_replicate(spark):
    """no row for each draw is handed to Python, and what a block is cut into is kept over its replicates."""
    sizes = spark.createDataFrame([(0, 50)], "domain long, _n long")
    assert "sha2" not in resample.packed_draws(sizes, 30, 42)._jdf.queryExecution().analyzed().toString()
    block = resample.Block(code=np.array([3, 1, 3]), q=np.array([1, 2, 5]), low=np.array([True, True, False]), true_high=np.array([True, False, True]))
    assert block.codes is block.codes and [(c, at.tolist()) for c, _, at in block.codes] == [(1, [1]), (3, [0, 2])]
    assert block.stretches("q", 2) is block.stretches("q", 2) and block.flags.sum(0).tolist() == [3, 2, 2, 1]
