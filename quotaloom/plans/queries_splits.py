"""Partition queries: every row of the case table gets its partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaloom.operators import splits
from quotaloom.plans.registry import query
from quotaloom.plans.testbed import CASES, cases, table


def h(seed: str, key: str) -> str:
    return f"sha256(concat_ws('|', '{seed}', {key}))"


def calibrated(rest: str, seed: int) -> str:
    """Row-level calibration of the rows in ``rest``."""
    return f"""SELECT case_id, CASE WHEN row_number() OVER (ORDER BY {h(f'{seed}-calibration', 'case_id')}, case_id)
      <= greatest(1, round_even(count(*) OVER () * 0.125::DOUBLE, 0)) THEN 'calibration' ELSE 'train' END AS partition FROM {rest}"""


def grouped(group: str, seed: str = "42", source: str = "cases") -> str:
    return f"""
g AS (SELECT coalesce({group}, '__missing_group__') AS grp, count(*) AS size FROM {source} GROUP BY ALL),
o AS (SELECT grp, size, row_number() OVER w AS rk, count(*) OVER () AS groups, sum(size) OVER w AS cum,
             sum(size) OVER () AS total FROM g WINDOW w AS (ORDER BY {h(seed, 'grp')}, grp ROWS UNBOUNDED PRECEDING))"""


def ids(df: DataFrame) -> DataFrame:
    return df.select("case_id", "partition")


@query("split_random", f"""WITH {CASES},
r AS (SELECT case_id, row_number() OVER (ORDER BY {h('42', 'case_id')}, case_id) AS rn, count(*) OVER () AS n FROM cases),
c AS (SELECT *, greatest(1, round_even(n * 0.2::DOUBLE, 0)) AS nt FROM r)
SELECT case_id, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + greatest(1, round_even((n - nt) * 0.125::DOUBLE, 0)) THEN 'calibration' ELSE 'train' END AS partition FROM c""")
def split_random(spark: SparkSession, sf: str) -> DataFrame:
    return ids(splits.random_split(cases(spark, sf).select("case_id"), "case_id"))


@query("split_group_holdout", f"""WITH {CASES}, {grouped('source_id')},
held AS (SELECT grp FROM o WHERE cum - size < greatest(1, round_even(total * 0.2::DOUBLE, 0))),
rest AS (SELECT case_id FROM cases WHERE source_id NOT IN (SELECT grp FROM held))
SELECT case_id, 'test' AS partition FROM cases WHERE source_id IN (SELECT grp FROM held) UNION ALL {calibrated('rest', 42)}""")
def split_group_holdout(spark: SparkSession, sf: str) -> DataFrame:
    return ids(splits.group_holdout_split(cases(spark, sf).select("case_id", "source_id"), "source_id", "case_id"))


THREE_WAY = f"""{grouped('entity')},
t AS (SELECT *, cum - size < greatest(1, round_even(total * 0.2::DOUBLE, 0)) AND rk <= groups - 2 AS is_test FROM o),
tr AS (SELECT sum(size) AS rows FROM t WHERE is_test),
a AS (SELECT grp, size, CASE WHEN is_test THEN 'test'
        WHEN cum - size - rows < greatest(1, round_even((total - rows) * 0.125::DOUBLE, 0)) AND rk <= groups - 1 THEN 'calibration'
        ELSE 'train' END AS partition FROM t, tr)"""


@query("split_three_way", f"WITH {CASES}, {THREE_WAY} SELECT case_id, partition FROM cases JOIN a ON entity = grp")
def split_three_way(spark: SparkSession, sf: str) -> DataFrame:
    return ids(splits.three_way_group_split(cases(spark, sf).select("case_id", "entity"), "entity"))


@query("split_purity", f"""WITH {CASES}, {THREE_WAY}
SELECT partition, CAST(sum(size) AS BIGINT) AS n_rows, count(*) AS n_groups, CAST(0 AS BIGINT) AS n_straddling_groups FROM a GROUP BY partition""")
def split_purity(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.three_way_group_split(cases(spark, sf).select("case_id", "entity"), "entity")
    return splits.partition_purity(rows, "entity")


@query("split_group_calibration", f"""WITH {CASES}, {grouped('entity')}
SELECT case_id, CASE WHEN cum - size < greatest(1, round_even(total * 0.125::DOUBLE, 0)) AND rk < groups THEN 'calibration' ELSE 'train' END AS partition
FROM cases JOIN o ON entity = grp""")
def split_group_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return ids(splits.group_calibration_split(cases(spark, sf).select("case_id", "entity"), "entity"))


FOLDS = f"""
g AS (SELECT entity AS grp, count(*) AS size FROM cases GROUP BY ALL),
s AS (SELECT *, (row_number() OVER (ORDER BY size DESC, {h('42', 'grp')}, grp) - 1) % 10 AS pos FROM g),
f AS (SELECT grp, size, CAST(CASE WHEN pos < 5 THEN pos ELSE 9 - pos END AS BIGINT) AS fold FROM s)"""


@query("balanced_folds", f"WITH {CASES}, {FOLDS} SELECT grp AS entity, size AS group_rows, fold FROM f")
def balanced_folds(spark: SparkSession, sf: str) -> DataFrame:
    return splits.balanced_folds(cases(spark, sf), "entity", 5)


@query("split_fold", f"""WITH {CASES}, {FOLDS},
o AS (SELECT grp, size, row_number() OVER w AS rk, count(*) OVER () AS n, sum(size) OVER w AS cum, sum(size) OVER () AS total
      FROM f WHERE fold <> 2 WINDOW w AS (ORDER BY {h('42-calibration', 'grp')}, grp ROWS UNBOUNDED PRECEDING)),
a AS (SELECT grp, 'test' AS partition FROM f WHERE fold = 2 UNION ALL
      SELECT grp, CASE WHEN (rk = 1 OR cum <= greatest(1, round_even(total * 0.125::DOUBLE, 0))) AND rk < n THEN 'calibration' ELSE 'train' END FROM o)
SELECT case_id, partition FROM cases JOIN a ON entity = grp""")
def split_fold(spark: SparkSession, sf: str) -> DataFrame:
    return ids(splits.fold_split(cases(spark, sf).select("case_id", "entity"), "entity", 2))


@query("split_time", f"""WITH {CASES},
y AS (SELECT case_id, row_number() OVER (ORDER BY study_year NULLS LAST, case_id) AS rn, count(*) OVER () AS n FROM cases),
l AS (SELECT case_id, rn > n - greatest(1, round_even(n * 0.2::DOUBLE, 0)) AS late FROM y),
rest AS (SELECT case_id FROM l WHERE NOT late)
SELECT case_id, 'test' AS partition FROM l WHERE late UNION ALL {calibrated('rest', 42)}""")
def split_time(spark: SparkSession, sf: str) -> DataFrame:
    return ids(splits.time_split(cases(spark, sf).select("case_id", "study_year"), "study_year", "case_id"))


@query("split_temporal_block", f"""WITH {CASES}
SELECT partition, count(*) AS n_rows, min(study_year) AS first_year, max(study_year) AS last_year FROM (
  SELECT study_year, CASE WHEN study_year <= 1994 THEN 'train' WHEN study_year <= 1996 THEN 'calibration' ELSE 'test' END AS partition FROM cases)
GROUP BY partition""")
def split_temporal_block(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.temporal_block(cases(spark, sf), "study_year", 1994, 1996)
    return rows.groupBy("partition").agg(F.count("*").alias("n_rows"), F.min("study_year").alias("first_year"),
                                         F.max("study_year").alias("last_year"))


@query("split_class_holdout", f"""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS case_id, concat(p_type, ';', p_brand) AS c FROM part),
t AS (SELECT case_id, list_contains(list_transform(string_split(c, ';'), lambda x: trim(x)), 'Brand#12') AS held FROM p),
rest AS (SELECT case_id FROM t WHERE NOT held)
SELECT case_id, 'test' AS partition FROM t WHERE held UNION ALL {calibrated('rest', 42)}""")
def split_class_holdout(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("case_id"),
                                           F.concat_ws(";", "p_type", "p_brand").alias("classes"))
    return ids(splits.class_holdout_split(rows, "classes", "Brand#12", "case_id"))


@query("split_fallback_group", f"""WITH s AS (SELECT CAST(o_orderkey AS VARCHAR) AS case_id, CAST(o_custkey AS VARCHAR) AS entity,
   CASE WHEN nullif(o_orderpriority, '4-NOT SPECIFIED') IS NULL OR trim(o_orderpriority) = '' THEN concat('acyclic::', CAST(o_custkey AS VARCHAR)) ELSE trim(o_orderpriority) END AS grp0 FROM orders),
{grouped('grp0', source='s')},
held AS (SELECT grp FROM o WHERE cum - size < greatest(1, round_even(total * 0.2::DOUBLE, 0))),
rest AS (SELECT case_id FROM s WHERE grp0 NOT IN (SELECT grp FROM held))
SELECT case_id, 'test' AS partition FROM s WHERE grp0 IN (SELECT grp FROM held) UNION ALL {calibrated('rest', 42)}""")
def split_fallback_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("case_id"), F.col("o_custkey").cast("string").alias("entity"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("scaffold"))
    rows = rows.withColumn("grp", splits.fallback_group("scaffold", "entity"))
    return ids(splits.group_holdout_split(rows, "grp", "case_id"))


@query("adaptation_draw", f"""WITH {CASES}, {grouped('source_id')}
SELECT case_id, CASE WHEN cum - size < 500 AND cum < total THEN 'adaptation' ELSE 'evaluation' END AS role FROM cases JOIN o ON source_id = grp""")
def adaptation_draw(spark: SparkSession, sf: str) -> DataFrame:
    return splits.adaptation_draw(cases(spark, sf).select("case_id", "source_id"), "source_id", 500).select("case_id", "role")


@query("repeated_draws", f"""WITH {CASES}, e AS (SELECT DISTINCT entity FROM cases),
r AS (SELECT entity, CAST(i AS INTEGER) AS repeat FROM e, range(1, 6) t(i))
SELECT entity, repeat, CASE WHEN row_number() OVER (PARTITION BY repeat ORDER BY sha256(concat_ws('|', concat('42-', repeat), entity)), entity) <= 50
  THEN 'development' ELSE 'evaluation' END AS role FROM r""")
def repeated_draws(spark: SparkSession, sf: str) -> DataFrame:
    return splits.repeated_draws(cases(spark, sf).select("entity").distinct(), "entity", 5, 50)


@query("permuted_target", f"""WITH {CASES},
a AS (SELECT case_id, row_number() OVER (ORDER BY case_id) AS rn FROM cases),
b AS (SELECT y_true, row_number() OVER (ORDER BY {h('42', 'case_id')}, case_id) AS rn FROM cases)
SELECT case_id, round(y_true, 6) AS y_true FROM a JOIN b USING (rn)""")
def permuted_target(spark: SparkSession, sf: str) -> DataFrame:
    from quotaloom.plans.testbed import rounded

    return rounded(splits.permute_target(cases(spark, sf).select("case_id", "y_true"), "y_true", "case_id"))
