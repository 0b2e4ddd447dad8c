"""Quality signals of a text, failure rates by host with an empirical beta prior, and host verdicts joined back.

Signals read the whole text.  A host's failure rate is shrunk to (failed + a) / (documents + a + b); a and b come from the
mean and the variance of all hosts' rates (method of moments).  With fewer than two hosts, or rates that don't differ, the
prior weighs PRIOR_DOCUMENTS documents.  A host is bad where its shrunk rate is over the limit.

Null and empty texts have no words and fail.  A null host is a host of its own.  Repeated rows each count and each give a
row.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaloom.llm import common

PRIOR_DOCUMENTS = 10.0
SYMBOLS = b"#*$%&|<>"
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: class of a byte: 0 inside a character, 1 starts a character, 2 white space, 3 symbol
BYTE_CLASS = np.array([2 if x in b"\t\n\x0b\x0c\r " else 3 if x in SYMBOLS else 0 if 0x80 <= x < 0xC0 else 1 for x in range(256)], np.uint8)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """How many words stand in a window of that width that occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers = common.Numbering()
    codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    window = codes[:n]
    for k in range(1, width):
        _, window = np.unique(window * len(numbers) + codes[k:n + k], return_inverse=True)
    repeated = np.bincount(window)[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k:n + k] |= repeated
    return int(covered.sum())


def text_signals(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.bincount(BYTE_CLASS[np.frombuffer(raw, np.uint8)], minlength=4)
    words = raw.split()
    lines = Counter(x for x in raw.split(b"\n") if x and not x.isspace())
    return len(words), int(kinds[1] + kinds[3]), int(kinds[3]), sum(lines.values()) - len(lines), repeated_words(words)


def signals(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source") -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_signals(x) for x in batch["text"].to_pylist()], np.int64).reshape(-1, len(SIGNALS))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["host"], *(pa.array(found[:, k]) for k in range(len(SIGNALS)))],
                                             names=["doc_id", "host", *SIGNALS])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"),
                       F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(measure, "doc_id long, host string, " + ", ".join(f"{x} long" for x in SIGNALS))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def host_verdicts(rows: DataFrame, failed: str, host: str = "host", max_rate: float = 0.5) -> DataFrame:
    """host, host_docs, host_failed, host_rate (shrunk), host_ok."""
    hosts = rows.groupBy(host).agg(F.count("*").alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    mean, spread = hosts.agg(F.avg(rate), F.var_samp(rate)).first()
    weight = PRIOR_DOCUMENTS
    if spread and 0 < mean < 1:
        weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6)
    shrunk = (F.col("host_failed") + F.lit((mean or 0.0) * weight)) / (F.col("host_docs") + F.lit(weight))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_ok", F.col("host_rate") <= max_rate)


def judge(docs: DataFrame, max_rate: float = 0.5, **columns: str) -> DataFrame:
    """The signals of every document, base_failed, its host's figures, and kept."""
    rows = common.materialize(signals(docs, **columns).withColumn("base_failed", base_failed()))
    hosts = host_verdicts(rows, "base_failed", max_rate=max_rate).withColumnRenamed("host", "judged_host")
    joined = rows.join(hosts, rows["host"].eqNullSafe(hosts["judged_host"]), "left").drop("judged_host")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
