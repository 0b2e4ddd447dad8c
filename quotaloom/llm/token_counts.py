"""Token counts behind a digest cache.

A content's key is the SHA-256 of its text with runs of ASCII white space made one space, which no count depends on; a
tokenizer's version is the SHA-256 of its file.  Contents are made distinct before they are looked up, only those that the
cache lacks are encoded, and their counts are appended.  The cache is a Parquet table in a shared folder; Spark commits
an append as a whole, and a digest that two runs appended is read once.

Counts add up over white space: the tokenizer drops it before it cuts, and its normaliser composes nothing across it.  So
a task encodes each distinct word of its texts once.  A text with a special token's string, or with a control character
on which Python and the tokenizer disagree, is encoded as it is.

Null texts count as empty (0 bytes, 0 tokens).  Repeated rows each give a row.  A cache that is absent counts as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quotaloom.llm import common

CACHE = "content binary, n_tokens long, version string"
#: a task's word counts start anew beyond this many; they are only a shortcut
MEMO_WORDS = 500_000


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("version") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    plain = F.regexp_replace("text", "[\\x09-\\x0D ]+", " ")
    return rows.withColumn("content", F.unhex(F.sha2(F.encode(plain, "UTF-8"), 256)))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; what the cache lacks is encoded and appended to it."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as source:
        model = source.read()  # a vocabulary file: small and fixed
    version = hashlib.sha256(model).hexdigest()
    shared = spark.sparkContext.broadcast(model)
    rows = keyed(docs, doc_id, text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(shared.value)
        special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        special += [chr(x) for x in range(0x1C, 0x20)]
        known: dict[str, int] = {}
        for batch in batches:
            for part in common.gather([batch], 4 << 20):
                texts = part["text"].to_pylist()
                whole = [any(s in x for s in special) for x in texts]
                words = [[] if w else x.split() for w, x in zip(whole, texts)]
                if len(known) > MEMO_WORDS:
                    known = {}
                fresh = list(set().union(*words) - known.keys())
                for i in range(0, len(fresh), 5000):
                    some = fresh[i:i + 5000]
                    known.update(zip(some, map(len, tokenizer.encode_batch_fast(some, add_special_tokens=False))))
                counts = [len(tokenizer.encode(x, add_special_tokens=False)) if w else sum(map(known.__getitem__, ws))
                          for w, x, ws in zip(whole, texts, words)]
                yield pa.RecordBatch.from_arrays([part["content"].combine_chunks(), pa.array(np.array(counts, np.int64)),
                                                  pa.array([version] * len(counts))], names=["content", "n_tokens", "version"])

    distinct = rows.groupBy("content").agg(F.any_value("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache_path, version), "content", "left_anti")
    misses.select("content", "text").mapInArrow(encode, CACHE).write.mode("append").parquet(cache_path)
    sized = rows.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    return sized.join(read_cache(spark, cache_path, version), "content").select("doc_id", "n_bytes", "n_tokens")
