"""End-to-end runs: protocol, review run, experiment, sweep, streaming coverage."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaloom.operators import ensemble, gates, splits
from quotaloom.plans import experiment, protocol, review
from quotaloom.plans.queries_review import METHODS, panel
from quotaloom.plans.registry import query
from quotaloom.plans.testbed import case_id, rounded, table
from quotaloom.session import checkpoint_dir, materialize
from quotaloom.streaming import gate

SPEC = review.FeatureSpec(numeric=("quantity", "size", "discount"), categorical=("brand", "medium"), signals=("tax",))
#: the reference's boosted trees: 400 rounds at a rate of 0.05, up to 63 leaves (MLlib bounds the depth), nine tenths of the rows and four fifths of the fields
TREES = {"maxDepth": 6, "maxIter": 400, "stepSize": 0.05, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.8"}
MEMBERS = 5
LINEAGE = ("r_name", "n_name", "species")


def featured(spark: SparkSession, sf: str) -> DataFrame:
    """Cases with context: the price is predicted from part, supplier and order fields."""
    rows = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select("p_partkey", "p_size", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        case_id().alias("case_id"), F.col("l_partkey").cast("string").alias("entity"), F.col("l_returnflag").alias("endpoint"),
        F.log10("l_extendedprice").alias("y_true"), F.col("l_quantity").alias("quantity"), F.col("p_size").cast("double").alias("size"),
        F.col("l_discount").alias("discount"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"),
        F.col("p_brand").alias("brand"), F.col("l_linestatus").alias("medium"), F.col("s_name").alias("species"),
        "n_name", "r_name", F.year("l_shipdate").alias("study_year"))


#: gate of the raw cases: the quantity stands for the duration, a line status for the medium
RAW_RULES = gates.GateRules(
    windows={"A": (1.0, 50.0), "N": (1.0, 48.0), "R": (2.0, 50.0)}, media=("F", "O"), name_tokens=("green ring",),
    numeric={"discount": (0.0, 0.09)}, duration="quantity")


def raw_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as they might be submitted: no target, but a value as text with its unit and the weight that turns it into log10 mol/L."""
    rows = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    price, salt = F.col("l_extendedprice"), F.col("l_partkey") % 89 == 0
    amount = F.when(F.col("l_returnflag") == "A", price).when(F.col("l_returnflag") == "N", price * 1000).otherwise(price * F.col("p_size"))
    return rows.select(
        F.col("l_orderkey").alias("input_row"), case_id().alias("case_id"), F.col("l_partkey").cast("string").alias("entity"),
        F.concat(F.lit("S"), F.col("l_partkey").cast("string"), F.when((F.col("l_partkey") % 97 == 0) & (F.col("l_linenumber") == 7), "b").otherwise("")).alias("structure"),
        (F.col("p_size") > 1).alias("structure_ok"), (F.col("l_partkey") % 2 == 0).alias("inner_salt"),
        F.when(F.col("l_suppkey") % 41 == 0, "no").otherwise("TRUE").alias("identity_verified"),
        F.concat("p_name", F.when(salt, " inner salt").otherwise("")).alias("entity_name"),
        F.col("s_name").alias("species"), F.col("l_returnflag").alias("endpoint"), F.col("l_quantity").alias("quantity"), F.col("l_linestatus").alias("medium"),
        F.concat(F.when(F.col("l_orderkey") % 53 == 0, ">").otherwise(""), amount.cast("string")).alias("toxicity_value"),
        F.when(F.col("l_returnflag") == "A", "mol/L").when(F.col("l_returnflag") == "N", "mmol/L").otherwise("AI g/L").alias("toxicity_unit"),
        F.col("p_size").cast("double").alias("molecular_weight"), F.col("p_size").cast("double").alias("size"),
        F.col("l_discount").alias("discount"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"),
        F.col("p_brand").alias("brand"), "n_name", "r_name", F.year("l_shipdate").alias("study_year"))


RAW = """raw AS (SELECT l_orderkey AS input_row, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS case_id,
   CAST(l_partkey AS VARCHAR) AS entity, concat('S', l_partkey, CASE WHEN l_partkey % 97 = 0 AND l_linenumber = 7 THEN 'b' ELSE '' END) AS structure,
   concat(p_name, CASE WHEN l_partkey % 89 = 0 THEN ' inner salt' ELSE '' END) AS entity_name, s_name AS species, l_returnflag AS endpoint,
   log10(l_extendedprice) AS log_price, l_orderkey % 53 = 0 AS censored, l_discount, l_quantity, l_tax, l_suppkey, l_partkey, concat_ws('; ',
   CASE WHEN l_suppkey % 41 = 0 THEN 'Test-substance identity and structure not confirmed' END,
   CASE WHEN (l_returnflag = 'N' AND l_quantity > 48) OR (l_returnflag = 'R' AND l_quantity < 2) THEN 'Duration outside endpoint window' END,
   CASE WHEN p_size <= 1 THEN 'No fixed-composition, carbon-containing molecular representation' END,
   CASE WHEN p_name LIKE '%green ring%' THEN 'Unresolved or variable-composition test substance' END,
   CASE WHEN l_partkey % 89 = 0 AND l_partkey % 2 = 1 AND p_size > 1 THEN 'Generic salt name requires substance-specific identity review' END,
   CASE WHEN l_discount > 0.09 THEN 'Invalid numeric value: discount' END) AS r0
   FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
CONFLICT = "'Inconsistent identity mapping; merge aliases or correct the structure'"


@query("gate_training", f"""WITH {RAW},
t AS (SELECT *, concat_ws('; ', nullif(r0, ''), CASE WHEN censored THEN 'Missing, censored, unsupported, or invalid measured concentration' END) AS r1 FROM raw),
c AS (SELECT entity FROM t WHERE r1 = '' GROUP BY entity HAVING count(DISTINCT structure) > 1),
j AS (SELECT *, CASE WHEN entity IN (FROM c) THEN {CONFLICT} ELSE r1 END AS rejection_reason FROM t)
SELECT rejection_reason, count(*) AS n_rows, count(DISTINCT entity) AS n_entities, CASE WHEN rejection_reason = '' THEN round(avg(log_price), 6) END AS mean_target,
  CASE WHEN rejection_reason = '' THEN round(max(log_price), 6) END AS max_target FROM j GROUP BY rejection_reason""")
def gate_training(spark: SparkSession, sf: str) -> DataFrame:
    """Raw training rows: targets derived from value, unit and weight; censored values and generic salts are rejected."""
    accepted, rejected = gates.prepare_inputs(raw_cases(spark, sf), replace(RAW_RULES, target="y_true"))
    good = accepted.groupBy(F.lit("").alias("rejection_reason")).agg(
        F.count("*").alias("n_rows"), F.count_distinct("entity").alias("n_entities"), F.avg("y_true").alias("mean_target"), F.max("y_true").alias("max_target"))
    bad = rejected.groupBy("rejection_reason").agg(F.count("*").alias("n_rows"), F.count_distinct("entity").alias("n_entities"))
    return rounded(good.unionByName(bad, allowMissingColumns=True))


@query("review_ranking", f"""WITH {RAW},
c AS (SELECT entity FROM raw WHERE r0 = '' GROUP BY entity HAVING count(DISTINCT structure) > 1),
j AS (SELECT *, r0 = '' AND entity NOT IN (FROM c) AS ok, l_tax IS NULL OR l_tax <= 0 AS no_tax FROM raw),
e AS (SELECT entity, endpoint, median(log_price) AS v, median(l_discount) AS block_knn, median(l_quantity) AS similarity_ad, median(l_tax) AS ensemble_sd, count(*) AS n FROM j WHERE ok GROUP BY ALL),
m AS (SELECT entity, arg_min(entity_name, case_id) AS entity_name, max(no_tax::BIGINT) AS missing_input_count, bool_or(l_suppkey % 7 = 0) AS unseen_species,
  bool_or(l_partkey % 3 = 0) AS entity_in_training FROM j WHERE ok GROUP BY entity),
x AS (SELECT entity, min(v) AS v, count(*) AS endpoint_count, CAST(sum(n) AS BIGINT) AS case_count, max(block_knn) AS block_knn, max(similarity_ad) AS similarity_ad,
  max(ensemble_sd) AS ensemble_sd FROM e GROUP BY entity),
r AS (SELECT entity, count(*) AS rejected_case_count FROM j WHERE NOT ok GROUP BY entity),
q AS (SELECT x.*, m.* EXCLUDE (entity), v <= log10(30000::DOUBLE) AS predicted_high, v - log10(30000::DOUBLE) AS margin,
  row_number() OVER (ORDER BY v <= log10(30000::DOUBLE), v - log10(30000::DOUBLE), entity) AS rank, round_even(count(*) OVER () * 0.25::DOUBLE, 0) AS quota FROM x JOIN m USING (entity))
SELECT entity, entity_name, rank, rank <= quota AS selected_for_review, 'threshold_proximity' AS ranking_rule,
  CASE WHEN predicted_high THEN 'Already predicted high concern; after the low-concern queue' ELSE 'Smaller predicted margin above the concentration criterion' END AS selection_basis,
  predicted_high, round(margin, 6) + 0 AS margin_log10, endpoint_count, case_count, round(block_knn, 6) AS block_knn, round(similarity_ad, 6) AS similarity_ad,
  round(ensemble_sd, 6) AS ensemble_sd, missing_input_count, unseen_species, entity_in_training, coalesce(rejected_case_count, 0) AS rejected_case_count
FROM q LEFT JOIN r USING (entity)""")
def review_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The review run without its model: raw rows through the gate, stored scores, endpoint and entity tables, ranks, rejected counts."""
    accepted, rejected = gates.prepare_inputs(raw_cases(spark, sf), RAW_RULES)
    scored = materialize(accepted.select("case_id", "entity", "entity_name", "endpoint").join(scores_of(spark, sf), "case_id"))
    ranked = review.rank_cases(scored, rejected, "hazard_omission", 0.25, cutoff=30000.0, name="entity_name")[1]
    return rounded(ranked.select(
        "entity", "entity_name", "rank", "selected_for_review", "ranking_rule", "selection_basis", "predicted_high", "margin_log10", "endpoint_count", "case_count",
        "block_knn", "similarity_ad", "ensemble_sd", "missing_input_count", "unseen_species", "entity_in_training", "rejected_case_count"))


def scores_of(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by case, as another run may have stored them."""
    return table(spark, sf, "lineitem").select(
        case_id().alias("case_id"), F.log10("l_extendedprice").alias("prediction_log"), F.col("l_discount").alias("block_knn"), F.col("l_quantity").alias("similarity_ad"),
        F.col("l_tax").alias("ensemble_sd"), F.when(F.col("l_tax") > 0, 0).otherwise(1).cast("long").alias("missing_input_count"),
        (F.col("l_suppkey") % 7 == 0).alias("unseen_species"), (F.col("l_partkey") % 3 == 0).alias("entity_in_training"))


@query("protocol_routes")
def protocol_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Signal chosen on one half of the entities (hash order), routes of the other half."""
    rows = splits.group_calibration_split(panel(spark, sf), "entity", fraction=0.5)
    out = protocol.apply_protocol(rows.where("partition = 'train'").drop("true_high", "partition"),
                                  rows.where("partition = 'calibration'").drop("partition"), METHODS, "first")
    return out.routed.groupBy("selected_signal", "route", "route_reason").agg(F.count("*").alias("n_entities"))


@query("review_run")
def review_run(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rows all the way: a reference on the accepted earlier cases, then the later ones through gate, model and ranking."""
    rows = splits.time_split(materialize(raw_cases(spark, sf)), "study_year", "case_id", holdout=0.1)
    train, queue = rows.where("partition = 'train'").drop("partition"), rows.where("partition = 'test'").drop("partition")
    accepted = gates.prepare_inputs(train, replace(RAW_RULES, target="y_true"))[0]
    ref = review.fit_reference(accepted, SPEC, lineage=["n_name", "r_name"], members=MEMBERS, **TREES)
    run = review.review_submitted(ref, queue, RAW_RULES, task="hazard_omission", fraction=0.25, cutoff=10000.0)
    return rounded(run.entities.select("entity", "entity_name", "rank", "selected_for_review", "ranking_rule", "selection_basis",
                                       "endpoint_count", "case_count", "unseen_species", "entity_in_training", "rejected_case_count"))


def one_experiment(spark: SparkSession, sf: str, seed: int = 42, learner: str = "gbt", **params) -> experiment.ExperimentResult:
    rows = splits.three_way_group_split(featured(spark, sf), "entity", seed)
    return experiment.run_experiment(rows, SPEC, LINEAGE, seed=seed, members=MEMBERS, learner=learner, **params)


@query("experiment_scores")
def experiment_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(one_experiment(spark, sf, **TREES).scores)


@query("configuration_sweep")
def configuration_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Two learners on the same split: members' mean error per endpoint."""
    rows = materialize(splits.three_way_group_split(featured(spark, sf), "entity"))  # every fit and every member reads them
    builder = review.FeatureBuilder(SPEC).fit(rows.where("partition = 'train'"))
    train, test = (builder.transform(rows.where(f"partition = '{p}'")) for p in ("train", "test"))

    def run(learner: str, depth: int) -> DataFrame:
        model = ensemble.BootstrapEnsemble(learner, 2, 42, maxDepth=depth).fit(train, "full", "y_true")
        d = F.col("y_pred") - F.col("y_true")
        return model.predict(test, "full").groupBy("endpoint").agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.count("*").alias("n_rows"))
    return rounded(ensemble.sweep(run, [{"learner": "tree", "depth": 4}, {"learner": "forest", "depth": 4}]), 4)


@query("stream_coverage", """WITH e AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n_rows, round(avg((value BETWEEN 2 AND 20)::INT), 6) AS coverage FROM e GROUP BY ALL""")
def stream_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """The whole event table through the windowed stream, drained once and read back."""
    static = table(spark, sf, "events")
    source = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = source.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", F.lit(2.0).alias("lower"), F.lit(20.0).alias("upper"))
    out = gate.windowed_coverage(rows, "ts", "value", "lower", "upper", by=["event_type"])
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    # complete mode restates all windows, so overwriting the table is idempotent
    stream = (out.writeStream.outputMode("complete")
              .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/windows"))
              .option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start())
    stream.awaitTermination()
    done = spark.read.parquet(f"{folder}/windows")
    return rounded(done.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n_rows", "coverage"))
