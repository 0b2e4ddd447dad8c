"""Row rules, small joins and reshapes that the other query groups do not already cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaloom.functions import numeric, text
from quotaloom.operators import calibrate, gates, joins, metrics
from quotaloom.plans.queries_review import n, panel
from quotaloom.plans.registry import query
from quotaloom.plans.testbed import CASES, PANEL, cases, rounded, table
from quotaloom.sources import tables

#: order fields dressed as test records, in both dialects
RECORDS = """
rec AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'LC50' WHEN 'O' THEN 'EC50' ELSE 'NOEC' END AS endpoint,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Fish; Standard' WHEN '2-HIGH' THEN 'Algae' ELSE 'Crustaceans' END AS species_group,
  CASE WHEN o_custkey % 2 = 0 THEN 'Daphniidae' ELSE 'Other' END AS family, (day(o_orderdate) * 4)::DOUBLE AS duration_h,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '3-MEDIUM' THEN '>' ELSE '=' END AS operator,
  CASE WHEN month(o_orderdate) < 10 THEN 'FW' ELSE 'SW' END AS medium FROM orders),
grp AS (SELECT *, CASE WHEN endpoint = 'LC50' AND contains(lower(species_group), 'fish') AND duration_h BETWEEN 90 AND 102 THEN 'fish_96h_lc50'
  WHEN endpoint = 'EC50' AND family = 'Daphniidae' AND duration_h BETWEEN 42 AND 54 THEN 'daphnia_48h_ec50'
  WHEN endpoint = 'EC50' AND contains(lower(species_group), 'algae') AND duration_h BETWEEN 66 AND 102 THEN 'algae_72_96h_ec50' END AS endpoint_group FROM rec)
"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(status == "F", "LC50").when(status == "O", "EC50").otherwise("NOEC").alias("endpoint"),
        F.when(priority == "1-URGENT", "Fish; Standard").when(priority == "2-HIGH", "Algae").otherwise("Crustaceans").alias("species_group"),
        F.when(F.col("o_custkey") % 2 == 0, "Daphniidae").otherwise("Other").alias("family"),
        (F.dayofmonth("o_orderdate") * 4).cast("double").alias("duration_h"),
        F.when(priority == "5-LOW", None).when(priority == "3-MEDIUM", ">").otherwise("=").alias("operator"),
        F.when(F.month("o_orderdate") < 10, "FW").otherwise("SW").alias("medium"))


@query("endpoint_groups", f"WITH {RECORDS} SELECT o_orderkey, endpoint_group FROM grp")
def endpoint_groups(spark: SparkSession, sf: str) -> DataFrame:
    group = gates.endpoint_group(F.col("endpoint"), F.col("species_group"), F.col("family"), F.col("duration_h"))
    return records(spark, sf).select("o_orderkey", group.alias("endpoint_group"))


@query("quality_filter", f"WITH {RECORDS} SELECT o_orderkey FROM grp WHERE endpoint_group IS NOT NULL AND coalesce(operator, '') IN ('', '=', 'NR') AND medium = 'FW'")
def quality_filter(spark: SparkSession, sf: str) -> DataFrame:
    return gates.quality_filter(records(spark, sf)).select("o_orderkey")


@query("duration_windows", f"""WITH {RECORDS}, w AS (SELECT * FROM (VALUES ('LC50', 90.0, 102.0), ('EC50', 42.0, 54.0)) v(endpoint, lo, hi))
SELECT o_orderkey, coalesce(NOT (duration_h BETWEEN lo AND hi), false) AS outside FROM rec LEFT JOIN w USING (endpoint)""")
def duration_windows(spark: SparkSession, sf: str) -> DataFrame:
    outside = gates.outside_window(F.col("endpoint"), F.col("duration_h"), {"LC50": (90.0, 102.0), "EC50": (42.0, 54.0)})
    return records(spark, sf).select("o_orderkey", outside.alias("outside"))


@query("endpoint_match", f"""WITH {RECORDS} SELECT o_orderkey, coalesce((endpoint_group = 'fish_96h_lc50' AND duration_h = 96 AND species_group = 'Fish; Standard')
  OR (endpoint_group = 'daphnia_48h_ec50' AND duration_h = 48), false) OR coalesce(endpoint_group = 'algae_72_96h_ec50' AND duration_h IN (72, 96), false) AS matches FROM grp""")
def endpoint_match(spark: SparkSession, sf: str) -> DataFrame:
    group = gates.endpoint_group(F.col("endpoint"), F.col("species_group"), F.col("family"), F.col("duration_h"))
    effect = F.when(F.col("endpoint") == "LC50", "mor").otherwise("itx")
    measure = F.when(F.col("endpoint") == "LC50", "MORT/").when(F.col("species_group") == "Algae", "pgrt").otherwise("imbl")
    # an algae record in the daphnia group is measured by growth, so its measurement is stated per group
    measure = F.when(group == "daphnia_48h_ec50", "IMBL").otherwise(measure)
    match = gates.endpoint_match(group, F.col("duration_h"), effect, measure, F.lit(None).cast("string"))
    return records(spark, sf).select("o_orderkey", F.coalesce(match, F.lit(False)).alias("matches"))


@query("rejection_flag", """SELECT p_partkey, (p_brand = 'Brand#3' AND p_size % 2 = 1) OR contains(lower(p_type), 'promo') OR contains(lower(p_name), 'unknown') OR p_retailprice > 1500 OR contains(lower(p_name), 'large') AS rejected FROM part""")
def rejection_flag(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").withColumn("p_name", F.regexp_replace("p_name", "large", "salt"))
    flag = gates.rejection_flag(
        F.when(F.col("p_brand") == "Brand#3", "PubChem"), F.when(F.col("p_size") % 2 == 0, "True"), F.lit("https://x.example"),
        F.col("p_type"), F.col("p_name"), F.col("p_retailprice") <= 1500, ["promo"])
    return rows.select("p_partkey", flag.alias("rejected"))


@query("identity_rules", """SELECT c_custkey, c_acctbal > 0 AND c_mktsegment <> 'MACHINERY' AND NOT regexp_matches(c_name, '7$') AS resolved,
  c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AS acceptable FROM customer""")
def identity_rules(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).otherwise(" ")
    segment = F.col("c_mktsegment")
    label = (F.when(segment == "BUILDING", "001 | Experimental study, Key").when(segment == "AUTOMOBILE", "experimental study: weight of evidence")
             .when(segment == "FURNITURE", "Disregarded experimental study, supporting").otherwise("read-across, key"))
    return table(spark, sf, "customer").select(
        "c_custkey", gates.resolved_identity(key, F.col("c_acctbal") > 0, F.col("c_name"), "7$").alias("resolved"),
        text.acceptable_study(label).alias("acceptable"))


@query("species_names", """SELECT s_suppkey, concat('Genus ', s_suppkey) AS species, concat('genus ', s_suppkey) AS taxon, upper(s_name) AS descriptor FROM supplier""")
def species_names(spark: SparkSession, sf: str) -> DataFrame:
    spelled = F.concat(F.lit("Other aquatic: Genus "), F.col("s_suppkey").cast("string"), F.lit(" (old name)"))
    return table(spark, sf, "supplier").select(
        "s_suppkey", text.canonical_species(spelled).alias("species"),
        text.taxon_value(F.concat(F.lit("  Genus "), F.col("s_suppkey").cast("string"))).alias("taxon"),
        text.normalise_descriptor(F.concat(F.lit("other:"), F.col("s_name"))).alias("descriptor"))


@query("candidate_load", """SELECT DISTINCT p_brand AS brand, p_type AS kind, regexp_replace(p_brand, '[^0-9]', '', 'g') AS key_normalised FROM part""")
def candidate_load(spark: SparkSession, sf: str) -> DataFrame:
    return tables.load_candidates(table(spark, sf, "part"), {"brand": "p_brand", "kind": "p_type"}, "brand", text.normalise_key)


@query("aligned_union", """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_size AS size FROM part UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL FROM supplier""")
def aligned_union(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    other = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    return part.unionByName(gates.align_columns(other, part, ["id", "name"])[0])


@query("coalesced_ids", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN c_mktsegment ELSE o_orderstatus END AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def coalesced_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("key"),
                                             F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")).alias("label"))
    other = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("label"))
    return joins.coalesce_join(rows, other, ["key"], ["label"]).drop("key")


@query("many_to_one_merge", """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, p_size, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def many_to_one_merge(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_brand")
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return joins.checked_many_to_one(rows, parts, ["l_partkey"])


@query("threshold_snap", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity <= 25 AS high FROM lineitem""")
def threshold_snap(spark: SparkSession, sf: str) -> DataFrame:
    value = numeric.snap(F.col("l_quantity") + F.lit(1e-13), F.lit(25.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (value <= 25.0).alias("high"))


@query("class_panel", f"""WITH {CASES}, {PANEL},
q AS (SELECT quantile_cont(s2, 0.5) AS mid, quantile_cont(abs_error, 0.9) AS big FROM panel)
SELECT pred_high, s2 >= mid AS high_score, count(*) AS n_entities, round(avg((abs_error >= big)::INT), 6) AS top_decile_rate FROM panel, q GROUP BY ALL""")
def class_panel(spark: SparkSession, sf: str) -> DataFrame:
    from quotaloom.operators.scan import attach_small, quantiles

    rows = panel(spark, sf).select("entity", "pred_high", "s2", "abs_error")
    limits = metrics._join_panels([quantiles(rows, "s2", {"mid": 0.5}), quantiles(rows, "abs_error", {"big": 0.9})], ())
    joined = attach_small(rows, limits, ())
    return rounded(joined.groupBy("pred_high", (F.col("s2") >= F.col("mid")).alias("high_score")).agg(
        F.count("*").alias("n_entities"), F.avg((F.col("abs_error") >= F.col("big")).cast("double")).alias("top_decile_rate")))


@query("endpoint_pivot", f"""WITH {CASES} SELECT entity, round(avg(y_true) FILTER (WHERE endpoint = 'A'), 6) AS "A", round(avg(y_true) FILTER (WHERE endpoint = 'N'), 6) AS "N",
  round(avg(y_true) FILTER (WHERE endpoint = 'R'), 6) AS "R" FROM cases GROUP BY entity""")
def endpoint_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cases(spark, sf).groupBy("entity").pivot("endpoint", ["A", "N", "R"]).agg(F.avg("y_true")))


@query("stratum_descriptors", f"""WITH {CASES}, {PANEL} SELECT endpoint_count, count(*) AS n_entities, round(sum(s1::DECIMAL(12, 4))::DOUBLE / count(s1), 6) AS s1_mean, round(avg(true_high::INT), 6) AS true_high_fraction,
  {n('any_miss')} AS n_missed FROM panel GROUP BY endpoint_count""")
def stratum_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(panel(spark, sf).groupBy("endpoint_count").agg(
        F.count("*").alias("n_entities"), F.avg(F.col("s1").cast("decimal(12,4)")).cast("double").alias("s1_mean"), F.avg(F.col("true_high").cast("double")).alias("true_high_fraction"),
        F.count_if("any_miss").alias("n_missed")))


@query("fewshot_recalibration", f"""WITH {CASES}, tg AS (SELECT * FROM cases WHERE split = 'O'), sz AS (SELECT source_id, count(*) AS size FROM tg GROUP BY ALL),
d AS (SELECT source_id, size, CAST(r AS INTEGER) AS replicate FROM sz, range(0, 3) t(r)),
o AS (SELECT *, sum(size) OVER w AS cum, sum(size) OVER (PARTITION BY replicate) AS tot FROM d
  WINDOW w AS (PARTITION BY replicate ORDER BY sha256(concat_ws('|', concat('42-', replicate), source_id)), source_id ROWS UNBOUNDED PRECEDING)),
ro AS (SELECT source_id, replicate, shots, cum - size < shots AND cum < tot AS adapts FROM o, (SELECT unnest([100, 1000])::INTEGER AS shots)),
x AS (SELECT replicate, shots, adapts, abs(y_true - y_pred) AS e FROM tg JOIN ro USING (source_id)),
a AS (SELECT replicate, shots, e, row_number() OVER (PARTITION BY replicate, shots ORDER BY e) AS rn, count(*) OVER (PARTITION BY replicate, shots) AS n FROM x WHERE adapts),
loc AS (SELECT replicate, shots, min(e) AS q, max(n) AS n FROM a WHERE rn = least(ceil((n + 1) * (1 - 0.1::DOUBLE)), n) GROUP BY ALL),
s AS (SELECT abs(y_true - y_pred) AS e, row_number() OVER (ORDER BY abs(y_true - y_pred)) AS rn, count(*) OVER () AS n FROM cases WHERE split = 'F'),
src AS (SELECT min(e) AS q0 FROM s WHERE rn = least(ceil((n + 1) * (1 - 0.1::DOUBLE)), n))
SELECT replicate, shots, max(n) AS adaptation_n, count(*) AS evaluation_n, round(avg((e <= q0)::INT), 6) AS coverage_before, round(avg((e <= q)::INT), 6) AS coverage_after,
  round(avg(2 * q0), 6) AS width_before, round(avg(2 * q), 6) AS width_after FROM x JOIN loc USING (replicate, shots), src WHERE NOT adapts GROUP BY ALL""")
def fewshot_recalibration(spark: SparkSession, sf: str) -> DataFrame:
    rows = cases(spark, sf)
    return rounded(calibrate.fewshot_recalibration(rows.where("split = 'F'"), rows.where("split = 'O'"), "source_id", "y_true", "y_pred",
                                                   [100, 1000], 3))


@query("endpoint_cutoff_map", f"""WITH {CASES}, med AS (SELECT split, entity, endpoint, median(y_true) AS m FROM cases GROUP BY ALL),
cut AS (SELECT split, endpoint, quantile_cont(m, 0.25) AS cutoff FROM med GROUP BY ALL)
SELECT case_id, round(cutoff, 6) AS cutoff FROM cases JOIN cut USING (split, endpoint)""")
def endpoint_cutoff_map(spark: SparkSession, sf: str) -> DataFrame:
    from quotaloom.operators import rollup

    rows = cases(spark, sf)
    mapped = rollup.attach_cutoffs(rows, rollup.concern_cutoffs(rows, by=["split"]), ["split"])
    return rounded(mapped.select("case_id", "cutoff"))
