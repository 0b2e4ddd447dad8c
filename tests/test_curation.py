"""Gates, joins, panels, splits, sources and runs."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quotaloom.functions import text
from quotaloom.operators import gates, joins, panels, setops, splits
from quotaloom.plans import review
from quotaloom.sources import sinks, tables
from quotaloom.streaming import gate


def test_gate_lists_every_reason_and_conflicts(spark):
    s = "input_row int, entity string, structure string, structure_ok boolean, species string, endpoint string, duration_h string, identity_verified string, medium string, ph string"
    df = spark.createDataFrame([
        (2, "A", "s1", True, "sp", "fish_96h_lc50", "96", "TRUE", "FW", "7"), (3, "B", "s2", True, "sp", "fish_96h_lc50", "24", "1", None, None),
        (4, "C", "s3", True, "", "nope", "96", "no", "SW", "15"), (5, "D", "s4", True, "sp", "daphnia_48h_ec50", "48", "1", None, None),
        (6, "D", "s5", True, "sp", "daphnia_48h_ec50", "48", "1", None, None), (7, "E", "s1", True, "sp", "daphnia_48h_ec50", "48", "1", None, None)], s)
    ok, bad = gates.prepare_inputs(df, gates.GateRules(numeric={"ph": (0.0, 14.0)}))
    reasons = {r.input_row: r.rejection_reason for r in bad.collect()}
    assert set(reasons) == {3, 4, 5, 6}
    assert reasons[3] == "Duration outside endpoint window"
    assert reasons[4] == "; ".join([gates.REASONS["missing"].format("species"), *[gates.REASONS[k] for k in ("identity", "endpoint", "medium")], "Invalid numeric value: ph"])
    assert reasons[5] == reasons[6] and "Inconsistent" in reasons[5]
    got = {r.entity: r for r in ok.collect()}
    assert got["A"].case_id == "row-2" and got["A"].ids_sharing_representation == 2 == got["E"].ids_sharing_representation
    assert got["A"].entity_name == "A"


def test_gate_of_training_rows_derives_targets_and_names_salts(spark):
    """Value, unit and weight give log10 mol/L; a given target wins; censored values, unknown units and generic salts are rejected."""
    s = ("input_row int, entity string, structure string, structure_ok boolean, species string, endpoint string, duration_h string, identity_verified string, "
         "entity_name string, inner_salt boolean, toxicity_value string, toxicity_unit string, molecular_weight double")
    def row(i, name="n", ok=True, inner=False, value="1", unit="mg/L", weight=100.0):
        return (i, f"E{i}", f"s{i}", ok, "sp", "fish_96h_lc50", "96", "1", name, inner, value, unit, weight)
    df = spark.createDataFrame([
        row(1), row(2, value=">1"), row(3, unit="drops"), row(4, weight=None), row(5, unit="mM", weight=None), row(6, value="-1"),
        row(7, "sodium salt"), row(8, "Inner SALT", inner=True), row(9, "salt", inner=True), row(10, "inner salt"), row(11, "salt", ok=False), row(12, value=None),
        (13, None, "s13", True, "sp", "fish_96h_lc50", "96", "1", "n", False, "1", "mM", 1.0), (14, " ", None, None, None, None, None, None, None, None, None, None, None)], s)
    rules = gates.GateRules(target="y_true")
    ok, bad = gates.prepare_inputs(df, rules)
    got = {r.input_row: r.y_true for r in ok.collect()}
    assert got == {1: pytest.approx(-5.0), 5: pytest.approx(-3.0), 8: pytest.approx(-5.0)}
    reasons = {r.input_row: r.rejection_reason for r in bad.collect()}
    assert {i for i, t in reasons.items() if t == gates.REASONS["target"]} == {2, 3, 4, 6, 12}
    assert {i for i, t in reasons.items() if t == gates.REASONS["salt"]} == {7, 9, 10}
    assert reasons[11] == gates.REASONS["structure"] and reasons[13] == "Missing entity" and reasons[14].startswith("Missing entity; Missing structure")
    given = df.where("input_row <= 3").withColumn("y_true", F.when(F.col("input_row") == 2, float("nan")).otherwise(7.0))
    ok, bad = gates.prepare_inputs(given, rules)
    assert {r.input_row: r.y_true for r in ok.collect()} == {1: 7.0, 3: 7.0} and [r.input_row for r in bad.collect()] == [2]
    with pytest.raises(ValueError, match="target columns"):
        gates.prepare_inputs(df.drop("toxicity_unit"), rules)
    none = gates.prepare_inputs(df.limit(0), rules)
    assert not none[0].count() and not none[1].count()
    with pytest.raises(ValueError, match="unique"):
        gates.prepare_inputs(df.where("input_row = 1").unionByName(df.where("input_row = 5")).withColumn("case_id", F.lit("same")), rules)


def test_gate_judges_rows_once_and_joins_no_blank_keys(spark):
    """Half of the rows have no entity: outputs read the written verdicts, and rows without a key are not in the join."""
    n = spark.range(4000).select(
        F.col("id").alias("input_row"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("E"), F.col("id") % 50)).alias("entity"), F.concat(F.lit("s"), F.col("id") % 25).alias("structure"),
        F.lit(True).alias("structure_ok"), F.lit("sp").alias("species"), F.lit("fish_96h_lc50").alias("endpoint"), F.lit(96.0).alias("duration_h"), F.lit("1").alias("identity_verified"))
    ok, bad = gates.prepare_inputs(n)
    assert ok.count() == 2000 and bad.count() == 2000 and {r.rejection_reason for r in bad.distinct().collect()} == {"Missing entity"}
    for out in (ok, bad):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Range (" not in plan
    assert "Filter (isnotnull(entity" in bad._jdf.queryExecution().optimizedPlan().toString()


def test_catalog_cascade(spark):
    index = spark.createDataFrame([("64-17-5", "ethanol", "id1"), ("50-00-0", "formal", ""), ("1-1-1", "none", None)], "key string, name string, id string")
    cat = spark.createDataFrame([("ID1", "", "C1", "46"), ("", "50000", "C2", "30"), ("ID1", "", "", "99")], "cid string, ckey string, structure string, weight string")
    out = joins.resolve_index(index, cat, ["structure", "weight"], [
        ("by_id", F.upper("id"), F.col("cid")), ("by_key", text.normalise_key(F.col("key")), text.normalise_key(F.col("ckey")))], "structure", ["weight"])
    got = {r.name: (r.structure, r.resolved, r.resolution_source) for r in out.collect()}
    assert got == {"ethanol": ("C1", True, "by_id"), "formal": ("C2", True, "by_key"), "none": ("", False, "")}


def test_feature_fallback_and_merge(spark):
    f = spark.createDataFrame([("i1", "111", 1.0), ("i2", "222", 2.0)], "fid string, fkey string, mech_x double")
    d = spark.createDataFrame([("a", "i1", "9"), ("b", "", "2-22"), ("c", None, None)], "name string, id string, key string")
    out = joins.attach_with_fallback(d, f, ["mech_x"], (F.col("id"), F.col("fid")), (text.strip_hyphens(F.col("key")), F.col("fkey")), ["fid"])
    assert {r.name: r.mech_x for r in out.collect()} == {"a": 1.0, "b": 2.0, "c": None}
    a = spark.createDataFrame([("k", None, 1.0)], "id string, k2 string, mech_a double")
    b = spark.createDataFrame([("k", None, 2.0), ("z", "y", 3.0)], "id string, k2 string, mech_b double")
    got = {r.id: (r.mech_a, r.mech_b, r.feature_count) for r in joins.merge_feature_tables([a, b], ["id", "k2"]).collect()}
    assert got == {"k": (1.0, 2.0, 2), "z": (None, 3.0, 1)}


def test_many_to_one_guard(spark):
    left = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(Exception, match="not unique"):
        joins.checked_many_to_one(left, spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), ["k"]).collect()


def test_ordinal_pivot_and_mode(spark):
    df = spark.createDataFrame([("d", "AR", "active"), ("d", "AR", "weak"), ("d", "ER", "inactive")], "id string, m string, s string")
    r = panels.ordinal_pivot(df, "id", "m", "s", {"ar": "ar", "er": "er"}, {"active": 1.0, "weak": 0.25, "inactive": 0.0}).first()
    assert (r.ar, r.er) == (1.0, 0.0)
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", None), ("k", None), ("k", None), ("n", None)], "k string, v string")
    assert {r.k: r.v for r in panels.mode_per_group(df, ["k"], ["v"]).collect()} == {"k": "a", "n": None}


def test_result_blocks_close_at_stop_labels(spark):
    f = [("d", i, l, v) for i, (l, v) in enumerate([
        ("Duration", "96 h"), ("Effect conc.", "1 mg/L"), ("Duration", "48 h"), ("Details on results", "x"), ("Effect conc.", "2 mg/L"),
        ("Duration", "24 h"), ("Effect conc.", "3 mg/L"), ("Effect conc.", "4 mg/L")])]
    df = spark.createDataFrame(f, "doc string, pos int, label string, value string")
    out = panels.result_blocks(df, "doc", "pos", "label", "value", "Duration", ["Effect conc."], ["Details on results"], ["Duration", "Effect conc."])
    assert sorted((r["Duration"], r["Effect conc."]) for r in out.collect()) == [("24 h", "4 mg/L"), ("96 h", "1 mg/L")]


def test_components_of_ambiguous_references(spark):
    df = spark.createDataFrame([("1", "A;B"), ("2", "B;C"), ("3", "D")], "row string, refs string")
    got = {r.row: r.reference_number for r in setops.reference_components(df, "row", "refs").collect()}
    assert got == {"1": "A", "2": "A", "3": "D"}
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y")], "a string, b string")
    out = setops.components(chain, "a", "b")
    assert {r.component for r in out.where("node LIKE 'n%'").collect()} == {"n000"}
    assert out.count() == 63


def test_data_flow_must_be_a_partition(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "e string, v int")
    with pytest.raises(Exception, match="not a partition"):
        setops.data_flow(df, "e", {"x": F.col("v") == 1}, "all").collect()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_group_splits_are_disjoint_and_cover(spark, seed):
    df = spark.createDataFrame([(str(i), f"g{i % 30}" if i % 40 else None) for i in range(120)], "case_id string, g string")
    out = splits.three_way_group_split(df, "g", seed)
    assert out.count() == 120
    assert out.select("partition").distinct().count() == 3
    assert out.groupBy("g").agg(F.count_distinct("partition").alias("n")).agg(F.max("n")).first()[0] == 1


def test_folds_deal_each_group_once_and_balance(spark):
    data = [(f"c{i}", "big") for i in range(45)] + [(f"d{g}-{i}", f"s{g}") for g in range(25) for i in range(3)]
    df = spark.createDataFrame(data, "case_id string, g string")
    folds = splits.balanced_folds(df, "g", 5)
    assert folds.count() == 26 and folds.select("g").distinct().count() == 26
    sizes = [r.n for r in folds.groupBy("fold").agg(F.sum("group_rows").alias("n")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 45
    one = splits.fold_split(df, "g", 0)
    assert one.select("partition").distinct().count() == 3


def test_class_holdout_and_adaptation(spark):
    df = spark.createDataFrame([("1", "A; B"), ("2", "B"), ("3", "C"), ("4", None)], "case_id string, c string")
    got = {r.case_id: r.partition for r in splits.class_holdout_split(df, "c", "B", "case_id").collect()}
    assert got["1"] == got["2"] == "test" and "test" not in (got["3"], got["4"])
    df = spark.createDataFrame([(str(i), f"g{i // 2}") for i in range(10)], "case_id string, g string")
    a = splits.adaptation_draw(df, "g", 4)
    assert a.where("role = 'adaptation'").count() >= 4 and a.groupBy("g").agg(F.count_distinct("role").alias("n")).where("n > 1").count() == 0
    assert splits.adaptation_draw(df, "g", 100).where("role = 'evaluation'").count() > 0
    with pytest.raises(Exception, match="at least three groups"):
        splits.three_way_group_split(df.where("g in ('g0', 'g1')"), "g").collect()


def test_strings_survive_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("id,name\n007,=x\n010,y\n")
    df = tables.read_strings(spark, str(path))
    assert [r.id for r in df.collect()] == ["007", "010"]
    with pytest.raises(ValueError, match="at most 1"):
        tables.read_strings(spark, str(path), max_records=1)
    bad = tmp_path / "bad.csv"
    bad.write_text("id,id\n1,2\n")
    with pytest.raises(ValueError, match="unique"):
        tables.read_strings(spark, str(bad))
    sinks.export_run({"t": df}, {"k": 1}, str(tmp_path / "run"))
    assert spark.read.option("header", True).csv(str(tmp_path / "run" / "t")).where("name = \"'=x\"").count() == 1
    assert sinks.read_json(spark, str(tmp_path / "run" / "manifest")) == {"k": 1}
    files = sinks.release_manifest(spark, str(tmp_path / "run"), "*.csv")
    assert files.count() >= 1 and all(len(r.sha256) == 64 for r in files.collect())


def test_catalog_headers_and_tree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DTX,SMI\n abc ,C\n,\n")
    (tmp_path / "b.csv").write_text("other\n1\n")
    out = tables.read_catalog(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], {"id": ("DTX",), "structure": ("SMI",), "name": ()}, "structure", ["id"], ["id"])
    assert [tuple(r) for r in out.collect()] == [("ABC", "C", "")]
    df = spark.createDataFrame([(40, "s", "m", 1.0), (41, "s", "m", 2.0)], "seed int, split string, model string, v double")
    sinks.save_predictions(df, str(tmp_path / "tree"))
    got = tables.read_results(spark, str(tmp_path / "tree"), seed=41)
    assert got.count() == 1 and "PartitionFilters: [isnotnull(seed" in got._jdf.queryExecution().executedPlan().toString()


def test_nested_html_fields(spark):
    html = ('<div class="das-field"><div class="das-field_label">Key <b>result</b></div><div class="das-field_value">yes<br>no</div></div>'
            '<div class="das-field"><div class="das-field_label">L</div></div>')
    df = spark.createDataFrame([("d", html), ("e", None)], "doc string, html string")
    assert [(r.label, r.value) for r in tables.field_pairs(df, "doc", "html").collect()] == [("Key result", "yes no")]
    a = spark.createDataFrame([("d", '<a class="x" href="/k_1">1 | <i>study</i></a>')], "doc string, html string")
    r = tables.anchors(a, "doc", "html").withColumn("icon", F.lit(None).cast("string")).withColumn("s", tables.study_record_flag("icon", "label")).first()
    assert (r.href, r.label, r.s) == ("/k_1", "1 | study", True)


def test_legacy_names_lose_to_current_ones(spark):
    df = spark.createDataFrame([(1, 2, "old", "old")], "old_a int, a int, method string, note string")
    r = sinks.rename_legacy(df, {"old_a": "a"}, {"old": "new"}, ["method"]).first().asDict()
    assert r == {"a": 2, "method": "new", "note": "old"}


def review_rows(spark, n=80):
    data = [(f"c{i:03d}", f"E{i % 16:02d}", "e1" if i % 2 else "e2", (i % 7) * 0.5 + (i % 2), float(i % 7), float(i % 5) if i % 3 else None,
             "w" if i % 4 else "x", f"sp{i % 6}", f"gen{i % 3}") for i in range(n)]
    return spark.createDataFrame(data, "case_id string, entity string, endpoint string, y_true double, a double, b double, m string, species string, genus string")


def test_review_run_ignores_measured_values_and_reloads(spark, tmp_path):
    rows_ = review_rows(spark)
    spec = review.FeatureSpec(("a",), ("m",), ("b",))
    ref = review.fit_reference(rows_, spec, members=2, learner="tree", lineage=["genus"], maxDepth=3)
    queue = review_rows(spark, 30).withColumn("entity", F.concat(F.lit("N"), "entity"))
    run = review.run_review(ref, queue, queue.limit(0), "hazard_omission", 0.25, cutoff=10.0)
    changed = review.run_review(ref, queue.withColumn("y_true", F.lit(99.0)), queue.limit(0), "hazard_omission", 0.25, cutoff=10.0)
    keep = ["entity", "rank", "selected_for_review", "block_knn", "ensemble_sd"]
    assert rows(run.entities.select(*keep), "entity") == rows(changed.entities.select(*keep), "entity")
    assert run.entities.where("selected_for_review").count() == round(0.25 * run.entities.count())
    assert "y_true" not in run.cases.columns and not run.entities.where("entity_in_training").count()
    review.save_reference(ref, str(tmp_path / "ref"))
    again = review.load_reference(spark, str(tmp_path / "ref"))
    redo = review.run_review(again, queue, queue.limit(0), "hazard_omission", 0.25, cutoff=10.0)
    assert rows(redo.entities.select(*keep), "entity") == rows(run.entities.select(*keep), "entity")
    stored = sinks.read_json(spark, str(tmp_path / "ref" / "reference"))
    stored["state"]["manifest"]["records"] = 1
    sinks.write_json(spark, stored, str(tmp_path / "ref" / "reference"))
    with pytest.raises(ValueError, match="checksum"):
        review.load_reference(spark, str(tmp_path / "ref"))
    with pytest.raises(ValueError, match="Protected"):
        review.fit_reference(rows_, review.FeatureSpec(("y_true",)))
    with pytest.raises(ValueError, match="too little to train on"):
        review.fit_reference(rows_.limit(20), spec)
    assert json.dumps(run.manifest)


def test_review_from_raw_rows(spark):
    """The run starts at the gate: rejected rows are counted by entity, targets are derived, and bad training rows stop the fit."""
    raw = review_rows(spark).select(
        F.substring("case_id", 2, 3).cast("int").alias("input_row"), "case_id", "entity", F.col("entity").alias("structure"), F.lit(True).alias("structure_ok"), "species",
        F.lit("fish_96h_lc50").alias("endpoint"), F.lit("96").alias("duration_h"), F.lit("1").alias("identity_verified"), F.col("entity").alias("entity_name"),
        F.lit(None).cast("string").alias("medium"), F.pow(F.lit(10.0), "y_true").cast("string").alias("toxicity_value"), F.lit("mol/l").alias("toxicity_unit"), "a", "b", "m", "genus")
    spec, rules = review.FeatureSpec(("a",), ("m",), ("b",)), gates.GateRules(numeric={"a": (0.0, 6.0)})
    ref = review.fit_submitted(raw, rules, spec, members=2, learner="tree", lineage=["genus"], maxDepth=3)
    assert ref.manifest["records"] == 80 and ref.manifest["entities"] == 16
    with pytest.raises(ValueError, match="2 training rows were rejected.*row 5: Missing, censored.*row 7: Missing, censored"):
        review.fit_submitted(raw.withColumn("toxicity_value", F.when(~F.col("input_row").isin(5, 7), F.col("toxicity_value"))), rules, spec)
    queue = raw.drop("toxicity_value").withColumn("identity_verified", F.when(F.col("input_row") % 16 == 3, "no").when(F.col("input_row") == 4, "no").otherwise("1"))
    run = review.review_submitted(ref, queue, rules, task="hazard_omission", fraction=0.25, cutoff=10.0)
    got = {r.entity: r for r in run.entities.collect()}
    assert len(got) == 15 and "E03" not in got  # every row of this one was rejected
    assert got["E04"].rejected_case_count == 1 and got["E05"].rejected_case_count == 0 and got["E04"].case_count == 4
    m = run.manifest
    assert (m["submitted_records"], m["eligible_records"], m["rejected_records"], m["review_count"]) == (80, 74, 6, 4)
    assert m["excluded_input_columns"] == ["toxicity_unit"] and sum(r.selected_for_review for r in got.values()) == 4


def test_stream_gate_and_batches(spark, tmp_path):
    df = spark.createDataFrame([("A", True, 0.9), ("B", False, 0.8), ("C", False, 0.1), ("D", False, 0.2)], "entity string, pred_high boolean, s double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = gate.route_batches(stream, "s", 0.5, lambda routed, i: seen.extend(routed.collect())).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.entity for r in seen if r.reviewed} == {"A", "B"}


def test_enrichment_keeps_every_row_and_resolves_each_key_once(spark):
    panel = spark.createDataFrame([(1, "a", " 7-1 ", 2.0, "mg/L"), (2, "a", " 7-1 ", 0.0, "mM"), (3, None, "8-2", 5.0, "mM"), (4, "c", None, 1.0, "mM"),
                                   (5, "c", "9-9", 1.0, "mM"), (6, None, "8-2", 5.0, "what")], "row int, name string, cas string, v double, u string")
    catalog = spark.createDataFrame([("7-1", "T2", "200"), ("7-1", "T1", "100"), ("8-2", " ", "50"), (" ", "T9", "1")], "key string, id string, mass string")
    got = {r.row: r for r in joins.enrich_panel(panel, catalog, "name", "cas", {"dtxsid": "id", "weight": "mass"}, "v", "u", "weight", "dtxsid", "key", ["id"]).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert got[1].dtxsid == "T1" and got[1].value_molar == pytest.approx(2e-5) and got[1].entity == "T1" and got[2].log_molar is None
    assert got[3].entity == "8-2" and got[3].log_molar == pytest.approx(-2.301, abs=1e-3) and got[6].value_molar is None
    assert got[4].entity is None and got[5].entity == "9-9" and got[5].log_molar is None


def test_catalog_jobs_do_not_grow_with_files(spark, tmp_path):
    for k in range(12):
        head, row = [("DTX,SMI", f" a{k} ,C"), ("name;x,id,SMILES", f"n,b{k},\"O,O\""), ("other", "1")][k % 3]
        (tmp_path / f"f {k}.csv").write_text(f"{head}\n{row}\n")
    (tmp_path / "empty.csv").write_text("")
    aliases = {"id": ("DTX",), "structure": ("SMI", "SMILES"), "name": ("name;x",)}
    tracker = spark.sparkContext.statusTracker()
    def jobs(pattern):
        spark.sparkContext.setJobGroup(pattern, pattern)
        out = tables.read_catalog(spark, [str(tmp_path / pattern)], aliases, "structure", ["id"], ["id"])
        n = len(tracker.getJobIdsForGroup(pattern))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n, sorted(map(tuple, out.collect()))
    few, _ = jobs("f [0-2].csv")
    many, got = jobs("*.csv")
    assert few == many and len(tables.headers_of(spark, [str(tmp_path)])) == 3
    assert got == sorted([(f"A{k}", "C", "") for k in (0, 3, 6, 9)] + [(f"B{k}", "O,O", "n") for k in (1, 4, 7, 10)])


def test_manifest_digests_block_by_block(spark, tmp_path, monkeypatch):
    import hashlib

    content = {"a.bin": b"", "b.bin": bytes(range(256)) * 9000, "c d.bin": b"x"}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in sinks.release_manifest(spark, str(tmp_path)).collect()}
    assert {k: (r.bytes, r.sha256) for k, r in got.items()} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in content.items() if v}
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "e string")
    sinks.assert_counts(df, "e", 3, 2)
    with pytest.raises(ValueError, match="expected 3 rows and 3 entities"):
        sinks.assert_counts(df, "e", 3, 3)
