"""Shapes that let queries grow: what is compared, moved and written."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quotaloom.functions import text
from quotaloom.operators import calibrate, gates, neighbors, resample, rollup, scan, splits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_lies_beyond_the_radius_does_not_leave_a_tile(spark):
    """a query that has k neighbours already gets only closer rows from the cells that it visits afterwards."""
    vectors = [[float(i)] for i in range(20)]
    q = spark.createDataFrame([("q", "", [0.0], 2.0, 0, [0])], "qid string, on string, vector array<double>, r0 double, pack long, cells array<long>")
    t = spark.createDataFrame([(f"g{i:02d}", f"t{i:02d}", "", v, 0 if i < 10 else 1) for i, v in enumerate(vectors)],
                              "tid string, rid string, on string, vector array<double>, cell long")
    cells = spark.createDataFrame([("", 0, 0, 10), ("", 1, 0, 10)], "on string, cell long, pack long, rows long")
    for grouped in (False, True):
        best, _ = neighbors._visit(q, t, cells, 5, neighbors.euclidean, ["vector"], grouped, False, 64, 64)
        assert sorted((r.neighbor_id, r.distance) for r in best.collect()) == [(f"g{i:02d}", float(i)) for i in range(3)]


def test_first_k_counts_a_group_once():
    at, code, d = np.array([0, 0, 0, 1, 1]), np.array([7, 7, 3, 2, 1]), np.array([1.0, 0.5, 0.5, 2.0, 2.0])
    got = neighbors._first_k(at, code, d, 2, True)
    assert [x.tolist() for x in got] == [[0, 0, 1, 1], [3, 7, 1, 2], [0.5, 0.5, 2.0, 2.0]]
    got = neighbors._first_k(at, code, d, 2, False)
    assert [x.tolist() for x in got] == [[0, 0, 1, 1], [3, 7, 1, 2], [0.5, 0.5, 2.0, 2.0]]
    got = neighbors._first_k(at[:2], code[:2], d[:2], 2, False)
    assert got[2].tolist() == [0.5, 1.0]


def test_rows_do_not_meet_by_panel(spark):
    """A few panels' numbers are sent to the rows; rows of one endpoint are not sent to one task."""
    rows = spark.range(1000).select(F.col("id").cast("string").alias("case_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("endpoint"), (F.col("id") % 11).cast("double").alias("error"))
    for out in (calibrate.high_error_labels(rows, "error", 0.8, "endpoint"), calibrate.balance_weights(rows, "endpoint"),
                rollup.attach_cutoffs(rows, rows.groupBy("endpoint").agg(F.max("error").alias("cutoff")))):
        text = plan(out)
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning" not in text
        assert out.where("endpoint is not null").count() == rows.where("endpoint is not null").count()


def test_draws_order_no_more_than_they_take(spark, monkeypatch):
    """F8: the copies of all entities are neither ordered nor written."""
    def never(*_, **__):
        raise AssertionError("all copies are put in order")
    monkeypatch.setattr(splits, "ordered_scan", never)
    names = [*(f"e{i}" for i in range(50)), None, "e7"]
    got = splits.repeated_draws(spark.createDataFrame([(n,) for n in names], "entity string"), "entity", 3, 10).collect()
    assert len(got) == 3 * len(names)
    for r in (1, 2, 3):
        order = sorted((hashlib.sha256((f"42-{r}|{n}" if n is not None else f"42-{r}").encode()).hexdigest(), str(n)) for n in set(names) - {"e7"})
        drawn = {g.entity for g in got if g.repeat == r and g.role == "development"} - {"e7"}
        assert len(drawn) in (9, 8, 10) and {str(n) for n in drawn} <= {n for _, n in order[:10]}


def test_an_effect_text_is_cut_once(spark):
    """tokens are cut and told apart once for a row, not once for every decision about every token."""
    rows = spark.createDataFrame([("approx. 3 mg/L",), ("1,000 ug/l",), ("5 to 7 ppm",), ("4",), (None,)], "t string")
    out = rows.repartition(2).select(text.parse_effect_value(F.col("t")).alias("v")).select("v.*")
    assert plan(out).count("regexp_extract_all(") == 1
    assert sorted(out.collect(), key=str) == sorted([(None, "mg/L", True), (1000.0, "µg/L", False), (None, "ppm", True), (4.0, "", False), (None, "", False)], key=str)


def written_by(monkeypatch, module):
    """The frames that a module writes."""
    frames, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: frames.append(write(df)) or frames[-1])
    return frames


def test_a_scan_writes_no_order_keys(spark, monkeypatch):
    """rows carry no copies of what orders them, and columns that only serve the order are left behind."""
    frames = written_by(monkeypatch, scan)
    df = spark.createDataFrame([(f"c{i}", float(i)) for i in range(40)], "id string, x double").repartition(3)
    got = scan.ordered_scan(df, [scan.asc(scan.hash_key(1, "id")), scan.asc("id")], rank="_r", keep=["x"]).collect()
    assert frames[0].columns == ["x", "_range", "_row_at"]
    order = sorted(range(40), key=lambda i: hashlib.sha256(f"1|c{i}".encode()).hexdigest())
    assert [r.x for r in sorted(got, key=lambda r: r._r)] == [float(i) for i in order]


def test_quantiles_order_only_the_cells_they_lie_in(spark, monkeypatch):
    """distinct values are not put in order as a whole."""
    def never(*_, **__):
        raise AssertionError("all distinct values are put in order")
    monkeypatch.setattr(scan, "ordered_scan", never)
    values = [-3.5, -3.5, 0.0, 1e-9, 7.0, 7.0, 1e6, 2.25, -1e-3, 8.5]
    df = spark.createDataFrame([(p, v, 1 + i % 3) for p in ("a", None) for i, v in enumerate(values)] + [("a", None, 5)], "p string, v double, w int")
    for weight, copies in ((None, values), ("w", np.repeat(values, [1 + i % 3 for i in range(10)]))):
        got = scan.quantiles(df, "v", {"low": 0.1, "mid": 0.5, "high": 0.93, "top": 1.0}, ["p"], weight).collect()
        assert {r.p for r in got} == {"a", None}
        for r in got:
            assert np.allclose([r.low, r.mid, r.high, r.top], np.quantile(copies, [0.1, 0.5, 0.93, 1.0]))


def test_medians_take_as_many_tasks_as_rows_need(spark, monkeypatch):
    """what one task orders doesn't grow with the table."""
    monkeypatch.setattr(scan, "MEDIAN_TASK_ROWS", 10)
    df = spark.createDataFrame([(f"g{i % 17}", float(i * 7 % 31)) for i in range(200)], "g string, x double")
    out = scan.group_medians(df, ["g"], {"m": "x"})
    assert "hashpartitioning(g" in plan(out) and ", 21)" in plan(out)
    assert {r.g: r.m for r in out.collect()} == {f"g{k}": float(np.median([i * 7 % 31 for i in range(k, 200, 17)])) for k in range(17)}


def test_cases_have_one_order_for_all_replicates(spark, monkeypatch):
    """no case is written for each replicate, and the correlations are those of the copies."""
    rng = np.random.default_rng(3)
    rows = [(f"e{i % 9}", float(rng.integers(0, 12)), float(rng.normal())) for i in range(60)] + [(None, 1.0, 2.0), ("e1", None, 1.0)]
    cases = spark.createDataFrame(rows, "entity string, a double, b double")
    w = {(r, f"e{i}"): int(rng.integers(0, 3)) for r in range(3) for i in range(9)}
    weights = spark.createDataFrame([(r, e, k) for (r, e), k in w.items() if k], "replicate int, entity string, w long")
    frames = written_by(monkeypatch, resample)
    got = {r.replicate: r.spearman for r in resample.replicate_spearman(cases, weights, "entity", "a", "b", range(3)).collect()}
    assert frames and not any("replicate" in f.columns for f in frames)
    for r in range(3):
        copies = pd.DataFrame([x[1:] for x in rows if x[0] and x[1] is not None for _ in range(w[r, x[0]])], columns=["a", "b"]).rank()
        assert np.isclose(got[r], copies.a.corr(copies.b))


def test_cases_meet_by_id_once(spark, monkeypatch):
    """nothing is written that holds a case id for each replicate."""
    rows = [(f"c{i}", f"e{i % 6}", float(i % 5), float(i * 7 % 11), abs((i * 13 % 17) - 8.0)) for i in range(40)]
    df = spark.createDataFrame(rows, "case_id string, entity string, a double, b double, r double")
    frames = written_by(monkeypatch, resample)
    assert resample.meta_bootstrap(df, ["a", "b"], "r", "entity", 2).count() == 2
    assert frames and not any({"replicate", "case_id"} <= set(f.columns) for f in frames)


def test_only_exceptions_are_joined_back_to_judged_rows(spark, monkeypatch):
    """what is joined to accepted rows are entities in conflict and structures of several entities."""
    rules = gates.GateRules(windows={"x": (0.0, 9.0)})
    rows = [(str(i), e, s, True, "sp", "x", 1.0, "true") for i, (e, s) in enumerate([("a", "S1"), ("b", "S1"), ("c", "S2"), ("d", "S3"), ("d", "S4"), ("a", "S1")])]
    df = spark.createDataFrame(rows, "case_id string, entity string, structure string, structure_ok boolean, species string, endpoint string, duration_h double, identity_verified string")
    frames = written_by(monkeypatch, gates)
    accepted, rejected = gates.prepare_inputs(df.withColumn("input_row", F.col("case_id")), rules)
    assert sorted((r.entity, r.ids_sharing_representation) for r in accepted.collect()) == [("a", 2), ("a", 2), ("b", 2), ("c", 1)]
    assert [r.entity for r in rejected.collect()] == ["d", "d"]
    assert sorted(f.count() for f in frames[1:]) == [1, 1, 1]
