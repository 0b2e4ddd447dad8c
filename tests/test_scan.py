"""The skew-safe order statistics against brute force, on both plans."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotaloom.operators import ranking, scan, splits
from quotaloom.operators.scan import Key
from quotaloom.session import materialize


def frame(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "id": [f"r{i:04d}" for i in rng.permutation(n)],
        # one panel holds most rows and one value a third of them
        "panel": np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", None], n)),
        "x": np.where(rng.random(n) < 0.33, 5.0, rng.normal(size=n).round(2)),
    })
    pdf.loc[rng.random(n) < 0.05, "x"] = np.nan
    schema = "id string, panel string, x double"
    df = spark.createDataFrame(pdf, schema).repartition(4)
    return pdf, df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def test_ranks_and_sums_match_pandas(spark):
    pdf, df = frame(spark)
    got = scan.ordered_scan(df, [scan.desc("x"), scan.asc("id")], ["panel"], {"one": F.lit(1), "x": F.coalesce("x", F.lit(0.0))}).toPandas()
    assert len(got) == len(pdf)
    for key, part in pdf.assign(panel=pdf.panel.fillna("-")).groupby("panel"):
        want = part.sort_values(["x", "id"], ascending=[False, True], na_position="last").reset_index(drop=True)
        mine = got[got.panel.fillna("-") == key].sort_values("rank").reset_index(drop=True)
        assert list(mine["id"]) == list(want["id"])
        assert list(mine["rank"]) == list(range(1, len(want) + 1)) == list(mine["cum_one"])
        assert (mine.panel_rows == len(want)).all()
        assert np.allclose(mine.cum_x, want.x.fillna(0).cumsum())
        assert np.allclose(mine.total_x, want.x.sum())


def test_quantiles_are_linear_interpolated(spark):
    pdf, df = frame(spark, seed=1)
    got = scan.quantiles(df, "x", {"q10": 0.1, "q50": 0.5, "q100": 1.0}, ["panel"]).toPandas().set_index("panel")
    for key, part in pdf.dropna(subset=["panel"]).groupby("panel"):
        for name, q in (("q10", 0.1), ("q50", 0.5), ("q100", 1.0)):
            assert got.loc[key, name] == pytest.approx(part.x.quantile(q))


def test_weighted_quantile_counts_copies(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 3), (10.0, 1)], "x double, w int")
    assert scan.quantiles(df, "x", {"q": 0.75}, (), "w").first()["q"] == pytest.approx(np.quantile([1, 2, 2, 2, 10], 0.75))


def test_hot_groups_take_the_split_path(spark):
    pdf, df = frame(spark, seed=2)
    spark.conf.set("spark.quotaloom.smallBytes", "0")
    try:
        assert scan.hot_groups(df, ["panel"], 100).count() == 1
        hot = scan.group_medians(df, ["panel"], {"m": "x"}, [F.count("*").alias("n")], hot_rows=100).toPandas()
    finally:
        spark.conf.unset("spark.quotaloom.smallBytes")
    want = pdf.assign(panel=pdf.panel.fillna("-")).groupby("panel").agg(m=("x", "median"), n=("id", "size"))
    got = hot.assign(panel=hot.panel.fillna("-")).set_index("panel")
    assert np.allclose(got.loc[want.index, "m"], want.m) and (got.loc[want.index, "n"] == want.n).all()


def test_hot_groups_are_counted_by_hash_first(spark, monkeypatch):
    """Many small groups: no task holds a sum for each group; hot ones are found exactly among groups of their hash, null keys too."""
    df = spark.range(3000).select((F.col("id") % 1000).alias("k"), F.lit("x").alias("j"))
    plans = []
    monkeypatch.setattr(scan, "materialize", lambda part: plans.append(part._jdf.queryExecution().optimizedPlan().toString()) or materialize(part))
    assert scan.rows_and_hot_groups(df, ["k", "j"], 100) == (3000, None)
    assert plans and not any("Aggregate [k#" in p for p in plans)
    monkeypatch.setattr(scan, "COUNT_BUCKETS", 2)
    more = spark.createDataFrame([(None, "x")] * 7 + [(5, None)] * 6 + [(5, "x")] * 2, "k long, j string")
    rows, hot = scan.rows_and_hot_groups(df.unionByName(more), ["k", "j"], 4)
    assert rows == 3015 and {tuple(r) for r in hot.collect()} == {(None, "x"), (5, None), (5, "x")}
    assert scan.rows_and_hot_groups(df, ["k", "j"], 3) == (3000, None)
    assert scan.rows_and_hot_groups(df.limit(0), ["k"], 3) == (0, None)


def test_first_rows_keeps_one_row_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z"), (None, 4, "w")], "k string, o int, v string")
    got = {(r.k, r.v) for r in scan.first_rows(df, ["k"], [F.col("o")]).collect()}
    assert got == {("a", "y"), (None, "z")}


def test_small_inputs_run_without_a_job_and_large_ones_are_range_partitioned(spark):
    _, df = frame(spark, seed=3)
    plain = scan.ordered_scan(df, [scan.asc("id")], ["panel"])
    assert "Window" in plain._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.quotaloom.smallBytes", "0")
    try:
        ranged = scan.ordered_scan(df, [scan.asc("id")], ["panel"])
        text = ranged._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.quotaloom.smallBytes")
    assert "_range" in text


@pytest.mark.parametrize("hot_rows", [0, 10 ** 6])
def test_cut_offs_are_the_rows_at_their_ranks(spark, hot_rows):
    rng = random.Random(4)
    values = [None, -3.5, 0.0, 1e-9, 1e300, float("nan"), 7.0, 7.0, 7.0, *[rng.uniform(-5, 5) for _ in range(60)]]
    rows = [(p, rng.random() < 0.3, v, f"{k:03d}") for p in (None, "a", "b") for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "p string, lead boolean, v double, id string")
    for descending in (False, True):
        order = [Key(F.col("lead").cast("int"), discrete=True), Key(F.col("v"), descending), Key(F.col("id"))]
        ranks = {"few": F.lit(3), "none": F.lit(0), "most": F.col("_n") - 2, "leading": F.col("_low")}
        cuts = scan.cut_offs(df, order, ["p"], ranks, {"_low": (~F.col("lead")).cast("long")}, hot_rows)
        ranked = scan.ordered_scan(df, order, ["p"]).select("p", "rank", "id", "lead").collect()
        at = {(r.p, r.rank): r.id for r in ranked}
        for r in cuts.collect():
            low = sum(x.p == r.p and not x.lead for x in ranked)
            assert r.none is None and r._n == len(values) and r.few._key2 == at[r.p, 3] and r.most._key2 == at[r.p, len(values) - 2]
            assert r.leading._key2 == at[r.p, low]
        flagged = scan.flag_first(df, order, ["p"], {"first": F.lit(5)})
        assert {(r.p, r.id) for r in flagged.where("first").collect()} == {(p, i) for (p, k), i in at.items() if k <= 5}
        assert flagged.columns == [*df.columns, "first"]


def test_a_cut_off_neither_writes_nor_sorts_wide_columns(spark, monkeypatch):
    written = []
    monkeypatch.setattr(scan, "materialize", lambda df: written.append(df.columns) or materialize(df))
    df = spark.createDataFrame([(str(k), "wide" * 50, float(k % 7)) for k in range(200)], "case_id string, wide string, study_year double")
    for split in (splits.random_split(df, "case_id"), splits.time_split(df, "study_year", "case_id"),
                  ranking.top_fraction(df, "study_year", 0.1, "case_id")):
        plan = split._jdf.queryExecution().optimizedPlan().toString()
        assert "Sort" not in plan and "RepartitionByExpression" not in plan and split.count() == 200
    assert written and not any("wide" in columns for columns in written)
