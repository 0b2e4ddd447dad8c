"""The driver tables seen as the package's data model.

``lineitem`` plays the prediction table: a part is the entity, the return flag the
endpoint, the price the measured value and a price distorted by tax and supplier the
predicted one.  The same definitions are given once as DataFrames and once as the SQL text
that the oracle queries start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCORES = ("s1", "s2")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """DOUBLE outputs at a fixed number of places, for comparison with the oracle."""
    types = dict(df.dtypes)
    # adding zero turns the -0.0 that rounding can leave into 0.0
    return df.select(*[
        (F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if types[c] == "double" else F.col(c)
        for c in df.columns])


def case_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       F.to_date("l_shipdate").cast("string"))


def cases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        case_id().alias("case_id"),
        F.col("l_partkey").cast("string").alias("entity"),
        F.col("l_returnflag").alias("endpoint"),
        F.log10("l_extendedprice").alias("y_true"),
        F.log10(F.col("l_extendedprice") * (F.lit(0.5) + F.lit(15.0) * F.col("l_tax"))
                + F.lit(10.0) * F.col("l_suppkey")).alias("y_pred"),
        F.col("l_discount").alias("s1"),
        F.col("l_quantity").alias("s2"),
        F.col("l_linestatus").alias("split"),
        F.year("l_shipdate").alias("study_year"),
        F.col("l_orderkey").cast("string").alias("reference_id"),
        F.col("l_suppkey").cast("string").alias("source_id"),
    )


CASES = """
cases AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS case_id,
         CAST(l_partkey AS VARCHAR) AS entity, l_returnflag AS endpoint,
         log10(l_extendedprice) AS y_true,
         log10(l_extendedprice * (0.5::DOUBLE + 15.0::DOUBLE * l_tax) + 10.0::DOUBLE * l_suppkey) AS y_pred,
         l_discount AS s1, l_quantity AS s2, l_linestatus AS split,
         CAST(year(l_shipdate) AS INTEGER) AS study_year,
         CAST(l_orderkey AS VARCHAR) AS reference_id, CAST(l_suppkey AS VARCHAR) AS source_id
  FROM lineitem)
"""

#: endpoint medians and the entity table with pooled 25 % cutoffs, as the flagship oracle builds them
CUTOFFS = """
med AS (
  SELECT entity, endpoint, median(y_true) AS y_true, median(y_pred) AS y_pred,
         median(s1) AS s1, median(s2) AS s2, count(*) AS case_count
  FROM cases GROUP BY entity, endpoint),
cut AS (SELECT endpoint, quantile_cont(y_true, 0.25) AS cutoff FROM med GROUP BY endpoint)
"""

PANEL = CUTOFFS + """,
flagged AS (
  SELECT m.*, c.cutoff, m.y_true <= c.cutoff AS th, m.y_pred <= c.cutoff AS ph
  FROM med m JOIN cut c USING (endpoint)),
panel AS (
  SELECT entity, bool_or(th) AS true_high, bool_or(ph) AS pred_high,
         bool_or(th AND NOT ph) AS any_miss,
         min(y_true) AS min_true, min(y_pred) AS min_pred, max(s1) AS s1, max(s2) AS s2,
         max(y_pred - y_true) AS gap, max(abs(y_pred - y_true)) AS abs_error,
         greatest(max(y_pred - y_true), 0) AS loss,
         count(*) AS endpoint_count, CAST(sum(case_count) AS BIGINT) AS case_count
  FROM flagged GROUP BY entity)
"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with a 70/10/20 hash-ordered partition into train, calibration and test."""
    from quotaloom.operators.splits import random_split

    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("case_id"),
        F.col("label").cast("string").alias("entity"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    return random_split(rows, "case_id", seed=7)


VECTORS = """
vec_ranked AS (
  SELECT CAST(vec_id AS VARCHAR) AS case_id, CAST(label AS VARCHAR) AS entity,
         CAST(embedding AS DOUBLE[]) AS vector,
         row_number() OVER (ORDER BY sha256(concat_ws('|', '7', CAST(vec_id AS VARCHAR))), CAST(vec_id AS VARCHAR)) AS rn,
         count(*) OVER () AS n
  FROM embeddings),
vec_counts AS (SELECT max(n) AS n, greatest(1, round_even(max(n) * 0.2::DOUBLE, 0)) AS n_test FROM vec_ranked),
vectors AS (
  SELECT case_id, entity, vector,
         CASE WHEN rn <= n_test THEN 'test'
              WHEN rn <= n_test + greatest(1, round_even((c.n - n_test) * 0.125::DOUBLE, 0)) THEN 'calibration'
              ELSE 'train' END AS partition
  FROM vec_ranked, vec_counts c)
"""
