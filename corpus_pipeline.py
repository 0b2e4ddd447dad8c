"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

run(spark, sf_dir) reads documents, and labels and benchmark where a stage needs them, from sf_dir.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaloom.llm import bpe, common, decontaminate, line_dedup, ngram_join, toxicity

KEY = "pipeline_row"


#: columns that stages read or write; all others go through them under names of their own
READ = ("doc_id", "text", "n_chars")


def others_aside(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that gives the columns it was given: further ones, whatever they are called, meet no column that the stage adds."""
    @functools.wraps(stage)
    def run_aside(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(spark, docs.toDF(*(c if c in READ else f"further_{i}" for i, c in enumerate(docs.columns))), sf_dir).toDF(*docs.columns)
    return run_aside


def keyed(docs: DataFrame) -> DataFrame:
    """Rows under a key of their own, so that null and repeated ids are told apart by their texts."""
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


@others_aside
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't call toxic; it learns from the rows op4 may learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return toxicity.score(docs, model, output="toxic_score").where("toxic_score < 0.5").drop("toxic_score")


@others_aside
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that came earlier; a document goes if that leaves it without a word."""
    left = line_dedup.dedup_lines(docs).where("ld_words_left or ld_removed = 0")
    return left.withColumn("n_chars", F.when(F.col("ld_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@others_aside
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share five-word runs with similarity 0.8 or more."""
    rows = keyed(docs)
    groups = ngram_join.join(rows, n=5, similarity=(80, 100), doc_id=KEY).select(F.col("doc_id").alias(KEY), "component_id")
    keys = common.materialize(groups.groupBy(KEY).agg(F.min("component_id").alias("first"), F.count("*").alias("n")))
    # what goes is little beside what stays, so its keys move to the documents as long as they are small enough for that
    gone = common.materialize(keys.where(F.col(KEY) != F.col("first")).select(KEY))
    repeated = common.materialize(keys.where((F.col(KEY) == F.col("first")) & (F.col("n") > 1)).select(KEY))
    single = rows.join(gone.unionByName(repeated), KEY, "left_anti")
    once = rows.join(repeated, KEY, "left_semi").dropDuplicates([KEY])
    return single.unionByName(once).select(*docs.columns)


@others_aside
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    rows = keyed(docs)
    found = decontaminate.find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=KEY)
    leaked = common.materialize(found.select(F.col("doc_id").alias(KEY)).distinct())
    return rows.join(leaked, KEY, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), and the digest of the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("byte-level bpe", encode),
]

#: a trained classifier and the tokenizer can't be written in SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
