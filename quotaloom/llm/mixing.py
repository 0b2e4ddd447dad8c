"""Mixing sources to target weights by capped water-filling.

A source's weight buys it a share of the mix, but never more than max_epochs times its own size: sources that reach that cap
are clamped and what they can't take is shared by weight among the others, until none is above its cap.  The shares this
ends with are those of one water level: target = min(cap, level * weight), where the level is found from the sources in the
order in which they reach their caps, by running sums and without a loop.

A source whose target is r times its size takes every document floor(r) times, and once more the documents that come first
in a seeded order until the missing words are there (the document across that mark goes by its middle).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaloom.operators.scan import asc, attach_small, ordered_scan
from quotaloom.session import materialize

#: a word is a run of other characters than space, tab, line feed, vertical tab, form feed and carriage return
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def water_level(sources: DataFrame, total: str, cap: str, weight: str) -> DataFrame:
    """One row: the level at which min(cap, level * weight) sums up to total; null without sources or above all caps.

    ``sources`` has one row a source, with the same ``total`` in each.
    """
    full_at = F.when(F.col(weight) > 0, F.col(cap) / F.col(weight))
    scan = ordered_scan(sources, [asc(full_at), asc("mix_rank")], (), {"cap": F.col(cap), "weight": F.col(weight)}, rank="_k", total="_n")
    left = F.col(total) - (F.col("cum_cap") - F.col(cap))
    level = left / (F.col("total_weight") - (F.col("cum_weight") - F.col(weight)))
    return scan.where(F.col(weight) > 0).where(level <= full_at).agg(F.min_by(level, "_k").alias("mix_level"))


def targets(sizes: DataFrame, source: str, size: str, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target): weights are dealt to the sources by code point, null last, over and over."""
    totals = materialize(sizes.groupBy(source).agg(F.sum(size).alias("source_size")))
    known = ordered_scan(totals, [asc(source)], (), {"size": F.col("source_size")}, rank="mix_rank", total="_sources")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    known = materialize(known.select(
        source, "source_size", "mix_rank", (F.lit(float(max_epochs)) * F.col("source_size")).alias("mix_cap"),
        F.element_at(turn, ((F.col("mix_rank") - 1) % len(weights) + 1).cast("int")).alias("mix_weight"),
        (F.lit(float(share)) * F.col("total_size")).alias("mix_total")))
    level = water_level(known, "mix_total", "mix_cap", "mix_weight")
    return attach_small(known, level, ()).select(
        source, "source_size",
        F.coalesce(F.least("mix_cap", F.col("mix_level") * F.col("mix_weight")), F.col("mix_cap")).alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2, seed: int = 11,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, taken) for every row: how often the mix takes a document.

    Weights have to be positive.  A null text has no words; a null source is a source, the last; null and repeated ids are rows
    like any other.  Equal rows are told apart only by chance, and which of them is repeated can't be seen.  Empty documents
    take part with no words.  Only ids, sources, sizes and keys are moved; other columns, whatever their names, aren't read.
    An empty table gives no rows.  Where share is above max_epochs all sources end at their cap.
    """
    if min(weights) <= 0 or share < 0 or max_epochs < 0:
        raise ValueError("weights have to be positive, share and epochs not negative")
    sizes = materialize(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
        F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(doc_id).cast("string"), text), 256).alias("mix_key")))
    goals = materialize(targets(sizes, "source", "size", weights, share, max_epochs))
    order = [asc("mix_key"), asc(F.monotonically_increasing_id())]
    scan = ordered_scan(sizes, order, ["source"], {"size": F.col("size")}, rank="_k", total="_n").drop("_k", "_n", "total_size")
    rate = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0))
    more = F.col("target") - F.floor(rate) * F.col("source_size")
    again = F.col("cum_size") - F.col("size") / 2 < more
    return attach_small(scan, goals, ["source"]).withColumn(
        "repeats", F.floor(rate) + F.when(again, 1).otherwise(0)).select(
        "doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of the mix itself: each document as often as it was taken.  Ids have to be unique and not null."""
    often = mixed.where("repeats > 0").select(F.col("doc_id").alias(doc_id), F.col("repeats").alias("mix_repeats"))
    return docs.join(often, doc_id).select(
        *[F.col(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("mix_repeats").cast("int"))).alias("mix_epoch"))
