"""Structured Streaming forms of the row-wise steps.

Review quotas are shares of a whole queue, so ranking has no streaming form; what
streams is the gate, scoring against static references, windowed monitoring, and
routing of each micro-batch as a queue of its own, stated as such.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quotaloom.operators.gates import GateRules, input_rules, reason_list
from quotaloom.operators.routing import route_queue


def gate_stream(rows: DataFrame, rules: GateRules) -> DataFrame:
    """Row rules on a stream: ``rejection_reason`` is '' for an accepted row; stateless."""
    return rows.withColumn("rejection_reason", reason_list(input_rules(rules, rows.columns)))


def enrich_stream(rows: DataFrame, known: DataFrame, key: str, flag: str = "known_entity") -> DataFrame:
    """Stream-static existence join; the static side is read again for every micro-batch."""
    seen = known.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_seen", F.lit(True))
    return rows.join(seen, key, "left").withColumn(flag, F.coalesce(F.col("_seen"), F.lit(False))).drop("_seen")


def windowed_coverage(
    rows: DataFrame, ts: str, value: str, lower: str, upper: str, window: str = "1 hour", late: str = "10 minutes",
    by: Sequence[str] = (),
) -> DataFrame:
    """Interval coverage per tumbling window; rows later than the watermark are dropped by the engine."""
    inside = (F.col(value) >= F.col(lower)) & (F.col(value) <= F.col(upper))
    out = rows.withWatermark(ts, late).groupBy(F.window(ts, window), *by).agg(
        F.count("*").alias("n_rows"), F.avg(F.coalesce(inside, F.lit(False)).cast("double")).alias("coverage"),
        F.avg(F.col(upper) - F.col(lower)).alias("mean_width"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n_rows", "coverage", "mean_width")


def route_batches(
    rows: DataFrame, score: str, fraction: float, sink: Callable[[DataFrame, int], None], entity: str = "entity",
    pred_high: str = "pred_high", policy: str = "all_queue",
) -> DataStreamWriter:
    """Route every micro-batch with a quota of its own; ``sink`` gets (routed, batch id) and must be idempotent."""
    def each(batch: DataFrame, batch_id: int) -> None:
        routed = route_queue(batch, score, fraction, policy, entity, pred_high, None)
        sink(routed.withColumn("batch_id", F.lit(batch_id)), batch_id)
    return rows.writeStream.foreachBatch(each)
