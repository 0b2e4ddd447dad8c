"""Toxicity by a factorization machine over hashed terms: linear weights and learned pairwise interactions of terms.

Terms are runs of letters and digits in lower case, hashed to BUCKETS presence features; of these the FEATURES with the
highest chi-squared statistic against the label are kept, which leaves the machine too little to memorise texts by.

It is fitted on at most MAX_LABELLED labelled rows (those with the smallest hash of their id); scoring covers every whole
text.  Null and empty texts have no terms and get the score of the intercept.  Rows without a label, with a null id, or
with conflicting labels (the highest counts) need no care.  With labels of one kind only, or none, there is nothing to
tell apart, and every score is the share of toxic labels (0 without labels).  Repeated rows each give a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import HashingTF, UnivariateFeatureSelector
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaloom.llm import common

#: bound of the rows that the machine is fitted on
MAX_LABELLED = 20_000
BUCKETS = 1 << 18
FEATURES = 256
#: terms of fewer fitted documents take no part in the fit, since a machine can only learn single texts from them
MIN_DOCS = 3
TERMS = r"[^\p{L}\p{N}]+"


@dataclass
class Model:
    stages: PipelineModel | None
    share: float


def terms(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("_terms", F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), TERMS))


def fit(docs: DataFrame, labels: DataFrame, learn: F.Column, label: str = "toxic", text: str = "text", doc_id: str = "doc_id",
        max_labelled: int = MAX_LABELLED, features: int = FEATURES, min_docs: int = MIN_DOCS, factors: int = 4, rounds: int = 60, seed: int = 7) -> Model:
    """learn: which label rows may be learnt from, a condition on their id."""
    known = labels.where(learn & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.max(F.col(label).cast("double")).alias("_label"))
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(some), "_id")
    held = common.materialize(terms(rows, "_text").select("_id", "_label", F.array_distinct("_terms").alias("_terms")))
    each = held.select("_id", F.explode("_terms").alias("_term")).where("_term <> ''").distinct()
    usual = each.groupBy("_term").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_docs).select("_term")
    kept = each.join(usual, "_term").groupBy("_id").agg(F.collect_list("_term").alias("_terms"))
    kept = held.select("_id", "_label").distinct().join(kept, "_id", "left").withColumn("_terms", F.coalesce("_terms", F.array().cast("array<string>")))
    hashed = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="_terms", outputCol="_hashed")
    sample = common.materialize(hashed.transform(kept).select("_label", "_hashed"))
    counts = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}
    share = counts.get(1.0, 0) / max(1, sum(counts.values()))
    if not 0 < share < 1:
        return Model(None, share)
    chosen = UnivariateFeatureSelector(featuresCol="_hashed", labelCol="_label", outputCol="_chosen", selectionMode="numTopFeatures")
    chosen = chosen.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(features).fit(sample)
    machine = FMClassifier(featuresCol="_chosen", labelCol="_label", factorSize=factors, maxIter=rounds, stepSize=0.1, regParam=0.01,
                           initStd=0.01, seed=seed, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted")
    narrow = common.materialize(chosen.transform(sample).select("_label", "_chosen"))
    return Model(PipelineModel([hashed, chosen, machine.fit(narrow)]), share)


def score(docs: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """The columns of docs and the probability that the text is toxic; a column of that name is replaced."""
    if model.stages is None:
        return docs.withColumn(output, F.lit(model.share))
    # the given columns travel in one struct, so that none of them meets a column that the stages add
    names = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), F.col(text).alias("_text"))
    scored = model.stages.transform(terms(rows, "_text"))
    own = (F.col(f"row.{n}") for c, n in zip(docs.columns, names) if c != output)
    return scored.select(*own, vector_to_array("_probability")[1].alias(output))
