"""Bootstrap by multiplicity tables: draws are rows, replicates are a key, nothing loops on the driver.

A replicate draws n row indices floor(n * u) with u from sha-256(seed|replicate|i), so
the draws are exact multinomials, repeatable anywhere and computed where the rows are.
Weights stand for copies: sums are weighted, and a quota, which counts copies, takes of each row the weight that still
fits before it (:func:`quota_weights`).  No copy is written out and no replicate is sorted.  Where replicates are many, draws
are not rows either: they move once, two bytes each, to blocks of entities (:func:`packed_draws`), and sums leave the blocks.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from quotaloom.functions.draws import unit_draws
from quotaloom.functions.numeric import review_count, safe_rate, unit_draw
from quotaloom.operators.metrics import _join_panels, omission_metrics, random_reference, spearman, weighted_correlation
from quotaloom.operators.ranking import melt_scores, queue_order
from quotaloom.operators.scan import asc, attach, attach_small, ordered_scan, quantiles
from quotaloom.session import materialize, ship_package, spread

#: draws that one task makes, and tasks at most
DRAWS_PER_TASK, MOST_TASKS = 2_000_000, 100_000
#: flag patterns that one draw covers; more are dealt to blocks, and what falls to each block is drawn first
PATTERNS_PER_DRAW = 4096
#: replicates whose weights stand side by side in a row when cases are ranked
SIDE_BY_SIDE = 16
INTERVAL = {"ci_lower": 0.025, "median": 0.5, "ci_upper": 0.975}


def replicates(df: DataFrame, reps: int, name: str = "replicate") -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias(name))


def multiplicities(
    entities: DataFrame, entity: str, reps: int, seed: int | str, panel: Sequence[str] = (),
    slots: DataFrame | None = None, slot_keys: Sequence[str] = (),
) -> DataFrame:
    """(replicate, panel, entity, w): how often each entity occurs in each replicate's resample.

    ``slots`` replaces the plain replicate numbers by rows of (replicate, slot keys,
    panel keys), each resampling the panel it names.
    """
    indexed = ordered_scan(entities.select(*panel, entity), [asc(F.col(entity).cast("string"))], panel, rank="_i", total="_n")
    hits = weights_by_index(indexed, reps, seed, panel, slots, slot_keys)
    return hits.join(indexed.drop("_n"), [*panel, "_i"]).select("replicate", *slot_keys, *panel, entity, "w")


def weights_by_index(
    indexed: DataFrame, reps: int, seed: int | str, panel: Sequence[str] = (), slots: DataFrame | None = None, slot_keys: Sequence[str] = (),
) -> DataFrame:
    """(replicate, panel, _i, w) of entities numbered from 1 (``_i`` of ``_n``): only numbers are drawn and shuffled."""
    keys = ["replicate", *slot_keys]
    if slots is None:
        # a short table makes many draws: dealt by how many, and not by its own size
        parts = indexed.count() * reps // DRAWS_PER_TASK + 1
        rows = replicates(indexed.repartition(min(parts, MOST_TASKS), *panel, "_i"), reps)
    else:
        rows = indexed.join(slots, list(panel))
    u = unit_draw(F.lit(str(seed)), *[F.col(k) for k in keys], F.col("_i"))
    return rows.select(*keys, *panel, (F.floor(u * F.col("_n")) + 1).alias("_i")).groupBy(*keys, *panel, "_i").agg(F.count("*").alias("w"))


def quota_weights(
    rows: DataFrame, keys: Sequence[str], place: str, size: int, weight: str, quota: Column, name: str = "reviewed",
) -> DataFrame:
    """``rows`` with the part of their weight that is within the first ``quota`` of their key, in the order of ``place``.

    ``place`` numbers the rows of a key from 1 in one order for all replicates, ``size`` is the largest number, and ``quota``
    is made of ``_total``, the key's weight.  Weights are added up over about sqrt(size) stretches of places; of each key
    only the stretch in which the quota ends is put in order, the others are wholly within or beyond.  ``rows`` are read
    three times, so they should be written or cheap.
    """
    keys = list(keys)
    stretch = F.floor((F.col(place) - 1) / F.lit(max(1, math.isqrt(max(1, size))))).cast("int")
    sums = rows.groupBy(*keys, stretch.alias("_stretch")).agg(F.sum(weight).alias("_w"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.select(*keys, "_stretch", "_w", F.sum("_w").over(upto).alias("_upto"), F.sum("_w").over(whole).alias("_total"))
    ends = ends.withColumn("_quota", quota.cast("long"))
    ends = materialize(ends.groupBy(*keys).agg(
        F.min(F.when(F.col("_upto") >= F.col("_quota"), F.col("_stretch"))).alias("_end"),
        F.max(F.when(F.col("_upto") < F.col("_quota"), F.col("_upto"))).alias("_before"), F.max("_quota").alias("_quota")))
    marked = attach_small(rows.withColumn("_stretch", stretch), ends, keys)
    inside = F.col("_stretch") == F.col("_end")
    ahead = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_quota") - F.coalesce("_before", F.lit(0)) - F.coalesce(F.sum(weight).over(ahead), F.lit(0))
    partly = marked.where(inside).withColumn(name, F.greatest(F.lit(0), F.least(F.col(weight), left)))
    rest = marked.where(~inside | F.col("_end").isNull()).withColumn(
        name, F.when(F.col("_end").isNull() | (F.col("_stretch") < F.col("_end")), F.col(weight)).otherwise(0))
    return partly.unionByName(rest).select(*rows.columns, F.col(name).cast("long").alias(name))


#: entities of a block, replicates that visit a block together, draws that are packed at a time and stretches of a queue
BLOCK, BATCH, PACKED, STRETCHES = 1 << 16, 100, 1 << 20, 1024
MESSAGE = "domain long, block long, batch long, replicate int, offsets binary"


def packed_draws(sizes: DataFrame, reps: int, seed: int | str) -> DataFrame:
    """The draws of :func:`weights_by_index` from domains of (domain, ``_n``) entities, two bytes each: a message holds where in a
    block of entities a replicate's draws fell.

    Draws are made by replicate and stretch of numbers where they are packed, and move once; nobody counts them in a shuffle.
    """
    ship_package(sizes.sparkSession)
    sizes = materialize(sizes.where("_n > 0").select(F.col("domain").cast("long"), F.col("_n").cast("long")))
    parts = (sizes.agg(F.sum("_n")).first()[0] or 0) * reps // DRAWS_PER_TASK + 1
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / PACKED))).alias("_s")
    units = replicates(sizes, reps).select("domain", "replicate", "_n", stretch).repartition(min(parts, MOST_TASKS))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for domain, replicate, n, s in zip(*(batch.column(i).to_pylist() for i in range(4))):
                at = np.floor(unit_draws(f"{seed}|{replicate}|", s * PACKED + 1, min(n, (s + 1) * PACKED) + 1) * float(n)).astype(np.int64)
                held.append((np.full(len(at), domain), np.full(len(at), replicate), at))
                rows += len(at)
                if rows >= PACKED:
                    yield _messages(held)
                    held, rows = [], 0
        if rows:
            yield _messages(held)
    return units.mapInArrow(draw, MESSAGE)


def _messages(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    domain, replicate, at = map(np.concatenate, zip(*held))
    # a replicate's draws arrive together: they are runs, ordered within
    starts = np.flatnonzero(np.r_[True, (domain[1:] != domain[:-1]) | (replicate[1:] != replicate[:-1])])
    for lo, hi in zip(starts, np.r_[starts[1:], len(at)]):
        at[lo:hi] = np.sort(at[lo:hi])
    block = at // BLOCK
    first = np.flatnonzero(np.r_[True, (domain[1:] != domain[:-1]) | (replicate[1:] != replicate[:-1]) | (block[1:] != block[:-1])])
    ends = np.r_[first, len(at)] * 2
    offsets = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer((at % BLOCK).astype("<u2"))])
    columns = [domain[first], block[first], replicate[first].astype(np.int64) // BATCH, replicate[first].astype(np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), offsets], ["domain", "block", "batch", "replicate", "offsets"])


def packed_blocks(rows: DataFrame, reps: int) -> DataFrame:
    """``rows`` of (domain, ``_i``, columns) as one row for each block and batch of replicates, all columns as arrays; ``at`` is the place in the block."""
    columns = [c for c in rows.columns if c not in ("domain", "_i")]
    kinds = dict(rows.dtypes)
    placed = rows.select(F.col("domain").cast("long").alias("domain"), F.floor((F.col("_i") - 1) / BLOCK).alias("block"),
                         ((F.col("_i") - 1) % BLOCK).alias("at"), *columns)
    names = ["at", *columns]

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        n = pa.array([0, t.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(n, t[c].combine_chunks()) for c in names]
        return pa.Table.from_arrays([pa.array([k.as_py()], pa.int64()) for k in key] + lists, ["domain", "block", *names])
    schema = ", ".join(["domain long, block long, at array<long>", *[f"{c} array<{kinds[c]}>" for c in columns]])
    blocks = materialize(placed.groupBy("domain", "block").applyInArrow(gather, schema))
    return blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((reps - 1) // BATCH).cast("long"))).alias("batch"))


def visit_blocks(messages: DataFrame, blocks: DataFrame, look: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``look(replicate, w, columns, message)`` finds, for every replicate that draws from a block, after the domain if
    ``schema`` asks for it; ``w`` are the copies of each of the block's rows, and ``message`` has what else was sent along."""
    names = [c for c in blocks.columns if c not in ("domain", "block", "batch")]
    fields = pa_schema(schema)
    extra = [c for c in messages.columns if c not in ("domain", "block", "batch", "replicate", "offsets")]

    def visit(key: tuple, sent: pa.Table, held: pa.Table) -> pa.Table:
        found, lead = [], [key[0].as_py()] if fields.names[0] == "domain" else []
        if sent.num_rows and held.num_rows:
            columns = Block({c: held[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in names})
            replicate, offsets = sent["replicate"].to_numpy(), sent["offsets"].combine_chunks()
            more = {c: sent[c].combine_chunks() for c in extra}
            order = np.argsort(replicate, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(replicate[order])) + 1):
                w = sum(np.bincount(np.frombuffer(offsets[int(i)].as_buffer(), "<u2"), minlength=BLOCK) for i in run)
                for row in look(int(replicate[run[0]]), w[columns["at"]], columns, {c: more[c][int(run[0])].as_py() for c in extra}):
                    found.append((*lead, *row))
        return pa.Table.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*found), fields)] if found else [pa.array([], f.type) for f in fields], schema=fields)
    return messages.groupBy("domain", "block", "batch").cogroup(blocks.groupBy("domain", "block", "batch")).applyInArrow(visit, schema)


def pa_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _taken(w: np.ndarray, place: np.ndarray, cut: tuple[int, int]) -> np.ndarray:
    """The copies of each row that stand before a cut: all up to its place, and so many of the row at it."""
    return np.where(place < cut[0], w, np.where(place == cut[0], cut[1], 0))


def _cuts(message: dict) -> dict[tuple[int, str], tuple[int, int]]:
    return {(c["code"], c["queue"]): (c["cut"], c["part"]) for c in message.get("cuts") or ()}


class Block(dict):
    """Columns of a block; what is the same for all replicates that visit it is made once."""

    @functools.cached_property
    def codes(self) -> list[tuple[int, Block, np.ndarray]]:
        """Of each code its number, its rows and where they stand."""
        found = [(int(code), np.flatnonzero(self["code"] == code)) for code in np.unique(self["code"])]
        return [(code, Block({c: v[at] for c, v in self.items()}), at) for code, at in found]

    @functools.cached_property
    def flags(self) -> np.ndarray:
        """Side by side: every row, high, low and missed ones."""
        return np.stack([np.ones(len(self["low"])), self["true_high"], self["low"], self["true_high"] & self["low"]], axis=1).astype(float)

    @functools.cached_property
    def _kept(self) -> dict:
        return {}

    def stretches(self, queue: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The stretch of each row, the rows in the order of their stretches, and where each stretch starts in it."""
        if (queue, width) not in self._kept:
            stretch = ((self[queue] - 1) // width).astype(np.intp)
            order = np.argsort(stretch, kind="stable")
            self._kept[queue, width] = stretch, order, np.searchsorted(stretch[order], np.arange(STRETCHES + 1))
        return self._kept[queue, width]

    def low_rows(self, queue: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The low rows in the order of their places, these places, and whether each is a miss."""
        if queue not in self._kept:
            low = np.flatnonzero(self["low"])
            low = low[np.argsort(self[queue][low], kind="stable")]
            self._kept[queue] = low, self[queue][low], self["true_high"][low]
        return self._kept[queue]


def with_cuts(messages: DataFrame, cuts: DataFrame, name: str = "cuts") -> DataFrame:
    """Messages with the cuts of their replicate as an array of structs."""
    held = [c for c in cuts.columns if c not in ("domain", "replicate")]
    listed = cuts.groupBy("domain", "replicate").agg(F.collect_list(F.struct(*held)).alias(name))
    return messages.join(listed, ["domain", "replicate"], "left")


def quota_cuts(
    messages: DataFrame, blocks: DataFrame, queues: Sequence[str], size: int, fraction: float, after: str | None = None,
) -> DataFrame:
    """(domain, code, queue, replicate, cut, part): where the review quota of a replicate ends in each queue, and how many copies of the row there are within.

    ``code`` tells panels apart.  A queue is a column of ``blocks`` with places that number the rows of a panel in one order for all replicates,
    up to ``size``.  Copies are added up by stretches of places, and of each replicate only the rows of the stretch in which
    the quota ends are put in order.  The quota is ``fraction`` of the panel's copies; ``after`` names a queue with cuts on ``messages``, and only what it
    left of the low rows stands in the queues then.
    """
    width = max(1, -(-size // STRETCHES))

    def standing(code: int, w: np.ndarray, columns: dict, cuts: dict) -> np.ndarray:
        return w if after is None else np.where(columns["high_pred"], 0, w - _taken(w, columns[after], cuts.get((code, after), (0, 0))))

    def count(replicate, w, columns, message):
        cuts = _cuts(message)
        for code, mine, at in columns.codes:
            copies = w[at]
            if total := int(copies.sum()):
                left = standing(code, copies, mine, cuts).astype(float)
                for q in queues:
                    sums = np.bincount(mine.stretches(q, width)[0], weights=left, minlength=STRETCHES).astype(np.int64)
                    yield code, q, replicate, np.append(sums, total)

    def find_stretch(key: tuple, t: pa.Table) -> pa.Table:
        sums = t["sums"].combine_chunks().flatten().to_numpy().reshape(-1, STRETCHES + 1).sum(axis=0)
        upto, total = np.cumsum(sums[:-1]), float(sums[-1])
        quota = min(int(min(total, max(0.0, np.rint(total * fraction)))), int(upto[-1]))
        end = int(np.searchsorted(upto, quota))
        row = [*[k.as_py() for k in key], end, quota - (int(upto[end - 1]) if end else 0)]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, ends)], schema=ends)

    def inside(replicate, w, columns, message):
        cuts, wanted = _cuts(message), {(c["code"], c["queue"]): c["end"] for c in message["ends"] or ()}
        for code, mine, at in columns.codes:
            left = standing(code, w[at], mine, cuts)
            for q in queues:
                if (code, q) in wanted:
                    _, order, starts = mine.stretches(q, width)
                    here = order[starts[wanted[code, q]]:starts[wanted[code, q] + 1]]
                    here = here[left[here] > 0]
                    if len(here):
                        yield code, q, replicate, mine[q][here], left[here]

    def find_place(key: tuple, t: pa.Table) -> pa.Table:
        place, w = (t[c].combine_chunks().flatten().to_numpy() for c in ("places", "w"))
        order, need = np.argsort(place), t["need"][0].as_py()
        upto = np.cumsum(w[order])
        at = int(np.searchsorted(upto, need))
        row = [*[k.as_py() for k in key], int(place[order[at]]), need - (int(upto[at - 1]) if at else 0)]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, found)], schema=found)

    keys, lead = ["domain", "code", "queue", "replicate"], "domain long, code long, queue string, replicate int"
    ends, found = pa_schema(f"{lead}, end long, need long"), pa_schema(f"{lead}, cut long, part long")
    sums = visit_blocks(messages, blocks, count, f"{lead}, sums array<long>")
    at = materialize(sums.groupBy(*keys).applyInArrow(find_stretch, f"{lead}, end long, need long").where("need > 0"))
    rows = visit_blocks(with_cuts(messages, at.drop("need"), "ends"), blocks, inside, f"{lead}, places array<long>, w array<long>")
    return materialize(rows.join(at.drop("end"), keys).groupBy(*keys).applyInArrow(find_place, f"{lead}, cut long, part long"))


def intervals(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, median, 95 % percentile interval and count over replicates (one value each, so few)."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n_values"), F.avg(v).alias("mean"),
        *[F.percentile(v, F.lit(q)).alias(n) for n, q in INTERVAL.items()],
        F.avg((v > 0).cast("double")).alias("share_positive"), F.avg((v < 0).cast("double")).alias("share_negative"))


def cluster_bootstrap(
    cases: DataFrame, entity: str, y_true: str, y_pred: str, reps: int, seed: int = 42, ranks: bool = True,
) -> DataFrame:
    """Regression metrics per replicate when whole entities are resampled.

    Errors are sums over entities, so replicates meet one row of an entity and not its cases.  ``ranks`` adds the rank
    correlation: cases have one order for all replicates, which only weight them.
    """
    numbered = materialize(ordered_scan(cases.select(entity).distinct(), [asc(F.col(entity).cast("string"))], rank="_i", total="_n"))
    d = F.col(y_pred) - F.col(y_true)
    sums = cases.groupBy(entity).agg(F.count("*").alias("_n"), F.count(d).alias("_known"), *[
        F.coalesce(F.sum(x), F.lit(0.0)).alias(n) for n, x in {"_ss": d * d, "_sa": F.abs(d), "_sd": d}.items()])
    domain = F.lit(0).cast("long").alias("domain")
    blocks = packed_blocks(sums.join(numbered.drop("_n"), entity).select(domain, "_i", "_n", "_known", "_ss", "_sa", "_sd"), reps)

    def add_up(replicate, w, columns, message):
        drawn = w > 0  # what was not drawn adds nothing, not even where it is infinite
        w = w[drawn]
        if len(w):
            known = (columns["_known"][drawn] > 0).any()
            yield replicate, int((w * columns["_n"][drawn]).sum()), *(float((w * columns[c][drawn]).sum()) if known else None for c in ("_ss", "_sa", "_sd"))
    messages = packed_draws(numbered.groupBy(domain).agg(F.max("_n").alias("_n")), reps, seed)
    found = visit_blocks(messages, blocks, add_up, "replicate int, n long, ss double, sa double, sd double")
    n = F.sum("n")
    errors = found.groupBy("replicate").agg(
        n.alias("n_rows"), F.sqrt(F.sum("ss") / n).alias("rmse"), (F.sum("sa") / n).alias("mae"), (F.sum("sd") / n).alias("bias"))
    if not ranks:
        return errors
    weights = materialize(weights_by_index(numbered, reps, seed).join(numbered.drop("_n"), "_i").select("replicate", entity, "w"))
    found = [replicate_spearman(cases, weights, entity, y_true, y_pred, range(lo, min(reps, lo + SIDE_BY_SIDE))) for lo in range(0, reps, SIDE_BY_SIDE)]
    correlations = found[0]
    for more in found[1:]:
        correlations = correlations.unionByName(more)
    return _join_panels([errors, correlations], ["replicate"])


def replicate_spearman(cases: DataFrame, weights: DataFrame, entity: str, a: str, b: str, wanted: Sequence[int]) -> DataFrame:
    """Rank correlation of ``a`` and ``b`` in each wanted replicate: distinct values are put in order once, with running weights of all."""
    names = {r: f"_w{r}" for r in wanted}
    side = weights.where(F.col("replicate").isin(*wanted)).groupBy(entity).agg(
        *[F.coalesce(F.sum(F.when(F.col("replicate") == r, F.col("w"))), F.lit(0)).alias(n) for r, n in names.items()])
    known = cases.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(entity, F.col(a).alias("_a"), F.col(b).alias("_b"))
    rows = materialize(known.join(side, entity).drop(entity))
    ranked = rows
    for value in ("_a", "_b"):
        distinct = rows.groupBy(value).agg(*[F.sum(n).alias(n) for n in names.values()])
        scan = ordered_scan(distinct, [asc(value)], sums={n: F.col(n) for n in names.values()})
        ranks = F.array(*[F.col(f"cum_{n}") - F.col(n) + (F.col(n) + 1) / 2 for n in names.values()])
        ranked = attach(ranked, scan.select(value, ranks.alias(f"_rank{value}")), [value])
    parts = []
    for i, (r, n) in enumerate(names.items()):
        w, x, y = F.col(n), F.col("_rank_a")[i], F.col("_rank_b")[i]
        drawn_x, drawn_y = F.when(w > 0, x), F.when(w > 0, y)
        sums = {"w": F.sum(w), "x": F.sum(w * x), "y": F.sum(w * y), "xx": F.sum(w * x * x), "yy": F.sum(w * y * y), "xy": F.sum(w * x * y),
                "varied": (F.min(drawn_x) < F.max(drawn_x)) & (F.min(drawn_y) < F.max(drawn_y))}
        parts.append(F.struct(F.lit(r).alias("replicate"), *[s.alias(k) for k, s in sums.items()]))
    found = ranked.agg(F.array(*parts).alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")
    return found.select("replicate", weighted_correlation({c: F.col(c) for c in found.columns}).alias("spearman"))


OMISSION_RATES = ("false_negative_capture", "high_concern_left_low_priority_fraction",
                  "lower_priority_false_omission_rate")


def _long_rates(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    return metrics.select(*keys, *OMISSION_RATES).unpivot(list(keys), list(OMISSION_RATES), "metric", "value")


def paired_differences(long: DataFrame, keys: Sequence[str], method: str, references: Sequence[str]) -> DataFrame:
    """Value minus each reference method's value within the same resample."""
    ref = long.where(F.col(method).isin(*references)).select(
        *keys, F.col(method).alias("reference"), F.col("value").alias("_ref"))
    return long.join(ref, list(keys)).where(F.col(method) != F.col("reference")).select(
        *keys, method, "reference", (F.col("value") - F.col("_ref")).alias("difference"))


def compared(long: DataFrame, keys: Sequence[str], method: str, comparisons: Sequence[tuple[str, str]]) -> DataFrame:
    """Value of the first minus value of the second method of each comparison, within the same resample."""
    pairs = long.sparkSession.createDataFrame([tuple(c) for c in comparisons], f"{method} string, reference string")
    ref = long.select(*keys, F.col(method).alias("reference"), F.col("value").alias("_ref"))
    return long.join(F.broadcast(pairs), method).join(ref, [*keys, "reference"]).select(
        *keys, method, "reference", (F.col("value") - F.col("_ref")).alias("difference"))


def replicate_rates(
    panel_df: DataFrame, scores: Mapping[str, str], fraction: float, reps: int, entity: str = "entity", seed: int = 42,
    policy: str = "low_concern_first", panel: Sequence[str] = (), random: str | None = "random_review",
) -> DataFrame:
    """(panel, replicate, method, metric, value): all methods reviewed on the same resamples, and the random review of each.

    The queue of a method has one order for all replicates; a replicate only weights its rows.
    """
    panel = list(panel)
    rows = panel_df.select(*panel, F.col(entity).cast("string").alias(entity), "true_high", "pred_high", *dict.fromkeys(scores.values()))
    numbered = materialize(ordered_scan(rows, [asc(entity)], panel, rank="_i", total="_n"))
    coded, codes = panel_codes(numbered, panel)
    placed = ordered_scan(melt_scores(coded.drop("_n"), scores), queue_order("score", entity, policy), ["code", "method"], rank="_place", total="_n")
    queues = {f"_place{i}": m for i, m in enumerate(scores)}
    size = numbered.agg(F.max("_n")).first()[0] or 0
    domain = F.col("code").alias("domain")
    blocks = packed_blocks(placed.groupBy("code", "_i").agg(
        *_flags(F.bool_or), *[F.max(F.when(F.col("method") == m, F.col("_place"))).alias(q) for q, m in queues.items()]).select(domain, "*"), reps)
    messages = materialize(packed_draws(coded.groupBy(domain).agg(F.max("_n").alias("_n")), reps, seed))
    cuts = quota_cuts(messages, blocks, list(queues), size, fraction)

    def tally(replicate, w, columns, message):
        cuts = _cuts(message)
        for code, mine, at in columns.codes:
            copies = w[at]
            if copies.any():
                sums = [int(x) for x in copies.astype(float) @ mine.flags]
                for q, m in queues.items():
                    # of the low rows those before the cut, and the copies of the row at it that are within
                    (low, places, miss), (cut, part) = mine.low_rows(q), cuts.get((code, q), (0, 0))
                    upto = int(np.searchsorted(places, cut))
                    seen, at_cut = copies[low[:upto]], upto < len(places) and places[upto] == cut
                    yield (code, m, replicate, *sums, int(seen.sum()) + (part if at_cut else 0),
                           int(seen[miss[:upto]].sum()) + (part if at_cut and miss[upto] else 0))
    counts = ["n", "high", "low", "miss", "low_seen", "miss_seen"]
    found = visit_blocks(with_cuts(messages, cuts), blocks, tally, "code long, method string, replicate int, " + ", ".join(f"{c} long" for c in counts))
    sums = found.groupBy("code", "method", "replicate").agg(*[F.sum(c).alias(c) for c in counts])
    sums = materialize(named_panels(sums, codes, panel))
    n = {c: F.col(c) for c in counts}
    keys = [*panel, "replicate"]
    out = _long_rates(sums.select(
        *keys, "method", safe_rate(n["miss_seen"], n["miss"]).alias("false_negative_capture"),
        safe_rate(n["miss"] - n["miss_seen"], n["high"]).alias("high_concern_left_low_priority_fraction"),
        safe_rate(n["miss"] - n["miss_seen"], n["low"] - n["low_seen"]).alias("lower_priority_false_omission_rate")), [*keys, "method"])
    if random is None:
        return out
    # expected rates of a random review of the same size, from the replicate's totals, which all methods share
    p = safe_rate(review_count(n["n"], fraction), n["n"])
    closed = sums.where(F.col("method") == next(iter(scores))).select(
        *keys, F.lit(random).alias("method"), F.when(n["miss"] > 0, p).alias("false_negative_capture"),
        safe_rate(n["miss"] * (1 - p), n["high"]).alias("high_concern_left_low_priority_fraction"),
        safe_rate(n["miss"], n["low"]).alias("lower_priority_false_omission_rate"))
    return out.unionByName(_long_rates(closed, [*keys, "method"]))


def panel_codes(rows: DataFrame, panel: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with a number ``code`` for their panel, and the numbers of the panels."""
    if not panel:
        return rows.withColumn("code", F.lit(0).cast("long")), None
    codes = materialize(ordered_scan(rows.select(*panel).distinct(), [asc(F.to_json(F.struct(*panel)))], rank="code", total="_n").drop("_n"))
    return attach_small(rows, codes, panel), codes


def named_panels(rows: DataFrame, codes: DataFrame | None, panel: Sequence[str]) -> DataFrame:
    return rows.drop("code") if codes is None else rows.join(codes, "code").select(*panel, *[c for c in rows.columns if c != "code"])


def _flags(of: Callable[[Column], Column] = lambda c: c) -> list[Column]:
    """The flags of a row, false where they are unknown."""
    flags = {"true_high": F.col("true_high"), "high_pred": F.col("pred_high"), "low": ~F.col("pred_high")}
    return [of(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()]


def paired_panel_bootstrap(
    panel_df: DataFrame, scores: Mapping[str, str], fraction: float, reps: int, references: Sequence[str],
    entity: str = "entity", seed: int = 42, policy: str = "low_concern_first", panel: Sequence[str] = (),
) -> DataFrame:
    """Differences between methods reviewed on the same resample, with intervals and sign shares."""
    rates = replicate_rates(panel_df, scores, fraction, reps, entity, seed, policy, panel)
    differences = paired_differences(rates, [*panel, "replicate", "metric"], "method", references)
    return intervals(differences, [*panel, "method", "reference", "metric"], "difference")


def support_increment(
    panel_df: DataFrame, scores: Mapping[str, str], comparisons: Sequence[tuple[str, str]], fraction: float = 0.25, reps: int = 2000,
    entity: str = "entity", seed: int = 42, policy: str = "low_concern_first", panel: Sequence[str] = (),
) -> DataFrame:
    """What support blocks add: the paired differences of a table of comparisons, with intervals and the share that improves."""
    missing = {m for pair in comparisons for m in pair} - set(scores)
    if missing:
        raise ValueError("comparisons name methods without a score: " + ", ".join(sorted(missing)))
    rates = replicate_rates(panel_df, scores, fraction, reps, entity, seed, policy, panel, random=None)
    found = intervals(compared(rates, [*panel, "replicate", "metric"], "method", comparisons), [*panel, "method", "reference", "metric"], "difference")
    captured = F.col("metric") == "false_negative_capture"
    return found.select(
        *panel, "method", "reference", "metric", "n_values", "mean", "median", "ci_lower", "ci_upper",
        F.when(captured, F.col("share_positive")).otherwise(F.col("share_negative")).alias("share_better"))


def seeded(text: str) -> np.random.Generator:
    """A generator that depends on a text only, so that any task on any machine draws the same."""
    return np.random.Generator(np.random.Philox(key=int(hashlib.sha256(text.encode()).hexdigest()[:32], 16)))


@F.pandas_udf(ArrayType(LongType()))
def multinomial(seed: pd.Series, total: pd.Series, sizes: pd.Series) -> pd.Series:
    """How many of ``total`` draws with replacement fall on each size: a chain of binomials, as long as there are sizes."""
    return pd.Series([seeded(s).multinomial(n, np.asarray(c, float) / np.sum(c)) for s, n, c in zip(seed, total, sizes)], dtype=object)


def take_without_replacement(rng: np.random.Generator, classes: np.ndarray, k: int) -> np.ndarray:
    """How many of ``k`` draws without replacement fall on each class, by binomials alone and so for any sizes.

    Given how many a round of binomials takes, every choice of so many is as likely; the next round adds or gives back the difference.
    """
    taken = np.zeros_like(classes)
    while (short := k - taken.sum()) != 0:
        pool = classes - taken if short > 0 else taken
        taken = taken + np.sign(short) * rng.binomial(pool, abs(short) / pool.sum())
    return taken


@F.pandas_udf(ArrayType(LongType()))
def hypergeometric(seed: pd.Series, quota: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([take_without_replacement(seeded(s), np.asarray(c, np.int64), int(k)) for s, k, c in zip(seed, quota, sizes)], dtype=object)


def flag_patterns(reviewed: DataFrame, seed_key: str, entity: str, group: Sequence[str], width: int = PATTERNS_PER_DRAW) -> DataFrame:
    """(seed key, block, patterns, sizes): all that an entity adds to the sums, in all groups, and how many entities add just that."""
    flags = F.struct(*group, "true_high", "pred_high", "reviewed")
    people = reviewed.groupBy(seed_key, entity).agg(F.sort_array(F.collect_list(flags)).alias("_pattern"))
    sizes = people.groupBy(seed_key, "_pattern").agg(F.count("*").alias("_size"))
    numbered = ordered_scan(sizes.withColumn("_text", F.to_json("_pattern")), [asc(F.col("_text"))], [seed_key], rank="_i")
    block = F.floor((F.col("_i") - 1) / width).alias("_block")
    blocks = numbered.groupBy(seed_key, block).agg(F.sort_array(F.collect_list(F.struct("_i", "_pattern", "_size"))).alias("_p"))
    return blocks.select(seed_key, "_block", F.col("_p._pattern").alias("_patterns"), F.col("_p._size").alias("_sizes"),
                         F.aggregate("_p._size", F.lit(0).cast("long"), lambda x, y: x + y).alias("_members"))


def pattern_draws(reviewed: DataFrame, seed_key: str, reps: int, seed: int, entity: str, group: Sequence[str], width: int = PATTERNS_PER_DRAW) -> DataFrame:
    """(replicate, slot, pattern, w): fits redrawn into slots, and in each slot how often a flag pattern occurs among as many redrawn entities.

    The work is replicates x slots x patterns, however many entities there are.
    """
    ship_package(reviewed.sparkSession)
    blocks = materialize(flag_patterns(reviewed, seed_key, entity, group, width))
    numbered = ordered_scan(blocks.select(seed_key).distinct(), [asc(F.col(seed_key).cast("string"))], rank="_i", total="_n")
    slots = replicates(numbered, reps).withColumn("slot", F.col("_i"))
    pick = (F.floor(unit_draw(F.lit(f"{seed}-fits"), F.col("replicate"), F.col("slot")) * F.col("_n")) + 1).alias("_i")
    drawn = slots.select("replicate", "slot", pick).join(numbered.select("_i", seed_key), "_i").drop("_i")
    tops = blocks.groupBy(seed_key).agg(F.sort_array(F.collect_list(F.struct("_block", "_members"))).alias("_t"), F.sum("_members").alias("_all"))
    name = [F.lit(str(seed)), F.col("replicate"), F.col("slot")]
    shares = multinomial(F.concat_ws("|", *name, F.lit("blocks")), F.col("_all"), F.col("_t._members"))
    parts = drawn.join(tops, seed_key).select("replicate", "slot", seed_key, F.explode(F.arrays_zip(F.col("_t._block").alias("_block"), shares.alias("_k"))).alias("_b"))
    parts = parts.select("replicate", "slot", seed_key, "_b.*").where("_k > 0").join(blocks, [seed_key, "_block"])
    counts = multinomial(F.concat_ws("|", *name, F.col("_block")), F.col("_k"), F.col("_sizes"))
    out = parts.select("replicate", "slot", F.explode(F.arrays_zip(F.col("_patterns").alias("pattern"), counts.alias("w"))).alias("_d"))
    return out.select("replicate", "slot", "_d.*").where("w > 0")


def hierarchical_bootstrap(
    reviewed: DataFrame, seed_key: str, reps: int, seed: int = 42, entity: str = "entity",
    group: Sequence[str] = ("method",), random: str | None = None, fraction: float = 0.25,
) -> DataFrame:
    """(replicate, group, metric, value): fits are redrawn first, then entities within each drawn fit.

    The review flags of a method are fixed, so every metric is additive and weights of flag patterns replace copies.  The same
    draws serve all groups, which keeps their differences paired.  With a name for ``random`` one more method reviews
    ``fraction`` of each slot's entities, chosen anew in every slot (a single group column is needed).
    """
    rows = pattern_draws(reviewed, seed_key, reps, seed, entity, group)
    rows = rows.select("replicate", "slot", "w", F.explode("pattern").alias("_f")).select("replicate", "slot", "w", "_f.*")
    th, low, rev, w = F.col("true_high"), ~F.col("pred_high"), F.col("reviewed"), F.col("w")
    def total(cond: Column) -> Column: return F.coalesce(F.sum(F.when(cond, w)), F.lit(0)).cast("long")
    keys = ["replicate", "slot", *group]
    sums = rows.groupBy(*keys).agg(
        F.sum("w").alias("n"), total(th).alias("high"), total(low).alias("low"), total(th & low).alias("miss"), total(rev).alias("reviews"),
        total(low & rev).alias("low_reviewed"), total(th & low & rev).alias("rescued"))
    if random is not None:
        (method,) = group
        sums = materialize(sums)
        # any method of a slot has the entities and predictions of all
        base = sums.groupBy("replicate", "slot").agg(F.min_by(F.struct("n", "high", "low", "miss"), method).alias("_s")).select("replicate", "slot", "_s.*")
        k = review_count(F.col("n"), fraction, True)
        got = hypergeometric(F.concat_ws("|", F.lit(f"{seed}-review"), "replicate", "slot"), k.cast("long"), F.array("miss", F.col("low") - F.col("miss"), F.col("n") - F.col("low")))
        chosen = base.select("*", k.cast("long").alias("reviews"), got.alias("_g"))
        chosen = chosen.select("*", F.lit(random).alias(method), (F.col("_g")[0] + F.col("_g")[1]).alias("low_reviewed"), F.col("_g")[0].alias("rescued"))
        sums = sums.unionByName(chosen.select(*sums.columns))
    n = {c: F.col(c) for c in ("high", "low", "miss", "reviews", "low_reviewed", "rescued")}
    per = sums.select(
        *keys, safe_rate(n["rescued"], n["miss"]).alias("false_negative_capture"),
        safe_rate(n["miss"] - n["rescued"], n["high"]).alias("high_concern_left_low_priority_fraction"),
        safe_rate(n["miss"] - n["rescued"], n["low"] - n["low_reviewed"]).alias("lower_priority_false_omission_rate"),
        (safe_rate(n["rescued"], n["reviews"]) * 100).alias("rescued_per_100_reviews"))
    metrics = ["false_negative_capture", "high_concern_left_low_priority_fraction", "lower_priority_false_omission_rate", "rescued_per_100_reviews"]
    return per.unpivot(keys, metrics, "metric", "value").groupBy("replicate", *group, "metric").agg(F.avg("value").alias("value"))


def hierarchical_deltas(values: DataFrame, reference: str, method: str = "method") -> DataFrame:
    """Paired differences of the hierarchical replicates against one method."""
    return intervals(paired_differences(values, ["replicate", "metric"], method, [reference]),
                     [method, "reference", "metric"], "difference")


def macro_bootstrap(
    panels: DataFrame, panel: Sequence[str], scores: Mapping[str, str], first: str, reps: int,
    reference: str, entity: str = "entity", seed: int = 42, fraction: float = 0.25,
) -> DataFrame:
    """Shared multiplicities across all panels: panels are averaged within a replicate before percentiles.

    In each panel the first score reviews its quota; every method reviews as much alone, and as much of the low queue that
    the first left.  A row may be reviewed in part, as some of its copies are.
    """
    rows = panels.select(*panel, F.col(entity).cast("string").alias(entity), "true_high", "pred_high", *dict.fromkeys([first, *scores.values()]))
    entities = materialize(ordered_scan(rows.select(entity).distinct(), [asc(entity)], rank="_i", total="_n"))
    numbered = materialize(rows.join(entities.drop("_n"), entity))
    places, names = {"_first": queue_order(first, entity, "low_concern_first")}, list(scores)
    for i, column in enumerate(scores.values()):
        places |= {f"_single{i}": queue_order(column, entity, "low_concern_first"), f"_second{i}": queue_order(column, entity)}
    for name, order in places.items():
        numbered = ordered_scan(numbered, order, panel, rank=name, total="_size")
        numbered = numbered.drop("_size") if name != list(places)[-1] else numbered
    placed = materialize(numbered.select(*panel, "_i", "true_high", "pred_high", "_size", *places))
    size = placed.agg(F.max("_size")).first()[0] or 0
    coded, codes = panel_codes(placed, panel)
    domain = F.lit(0).cast("long").alias("domain")
    blocks = packed_blocks(coded.select(domain, "_i", "code", *_flags(), *places), reps)
    messages = materialize(packed_draws(entities.groupBy(domain).agg(F.max("_n").alias("_n")), reps, seed))
    cuts = quota_cuts(messages, blocks, ["_first", *[f"_single{i}" for i in range(len(names))]], size, fraction)
    # as many again as the first stage had, of what it left in the low queue
    staged = with_cuts(messages, cuts.where("queue = '_first'"))
    cuts = cuts.unionByName(quota_cuts(staged, blocks, [f"_second{i}" for i in range(len(names))], size, fraction, "_first"))

    def tally(replicate, w, columns, message):
        cuts = _cuts(message)
        for code, mine, at in columns.codes:
            copies, low = w[at], mine["low"]
            miss = mine["true_high"] & low
            if copies.any():
                def taken(queue: str, of: np.ndarray) -> np.ndarray: return _taken(of, mine[queue], cuts.get((code, queue), (0, 0)))
                one = taken("_first", copies)
                left = np.where(mine["high_pred"], 0, copies - one)
                for i, m in enumerate(names):
                    alone, two = taken(f"_single{i}", copies), taken(f"_second{i}", left)
                    both = one + two
                    yield code, m, replicate, *(int(x.sum()) for x in (
                        copies[miss], copies[low], left[miss], alone[miss], alone[low], two[miss], both[miss], both[low]))
    counts = ["miss", "low", "left_miss", "alone_miss", "alone_low", "two_miss", "both_miss", "both_low"]
    found = visit_blocks(with_cuts(messages, cuts), blocks, tally, "code long, method string, replicate int, " + ", ".join(f"{c} long" for c in counts))
    sums = found.groupBy("code", "method", "replicate").agg(*[F.sum(c).alias(c) for c in counts])
    n, key = {c: F.col(c) for c in counts}, ["replicate", *panel, "method"]
    per = materialize(named_panels(sums, codes, panel)).select(
        *key, safe_rate(n["alone_miss"], n["miss"]).alias("single_capture"),
        safe_rate(n["miss"] - n["alone_miss"], n["low"] - n["alone_low"]).alias("single_for"),
        safe_rate(n["two_miss"], n["left_miss"]).alias("second_capture"),
        safe_rate(n["both_miss"], n["miss"]).alias("combined_capture"),
        safe_rate(n["miss"] - n["both_miss"], n["low"] - n["both_low"]).alias("combined_for"))
    measures = ["single_capture", "single_for", "second_capture", "combined_capture", "combined_for"]
    long = per.unpivot(key, measures, "metric", "value")
    macro = long.groupBy("replicate", "method", "metric").agg(F.avg("value").alias("value"))
    return intervals(paired_differences(macro, ["replicate", "metric"], "method", [reference]),
                     ["method", "reference", "metric"], "difference")


def replicate_logistic(
    rows: DataFrame, columns: Sequence[str], label: str, weight: str, key: str = "replicate",
    penalty: float = 1.0, steps: int = 30, tolerance: float = 1e-9,
) -> DataFrame:
    """L2 logistic fits of all replicates at once by Newton steps.

    One aggregation per step sums every replicate's gradient and Hessian where the
    rows are; the driver solves d x d systems and sends back one coefficient row per
    replicate, whose number is a parameter.
    """
    spark = rows.sparkSession
    d = len(columns)
    data = materialize(rows.select(key, F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w"),
                                   *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)],
                                   F.lit(1.0).alias(f"_x{d}")))
    names = [r[0] for r in data.select(key).distinct().collect()]
    beta = {r: np.zeros(d + 1) for r in names}
    ridge = np.diag([penalty] * d + [0.0])
    schema = f"{key} {dict(rows.dtypes)[key]}, _b array<double>"
    active = set(names)
    for _ in range(steps):
        table = spark.createDataFrame([(r, beta[r].tolist()) for r in active], schema)
        z = F.lit(0.0)
        for i in range(d + 1):
            z = z + F.col(f"_x{i}") * F.col("_b")[i]
        scored = data.join(F.broadcast(table), key).withColumn("_p", 1.0 / (1.0 + F.exp(-z)))
        h = F.col("_w") * F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-10))
        sums = scored.groupBy(key).agg(
            *[F.sum(F.col("_w") * (F.col("_y") - F.col("_p")) * F.col(f"_x{i}")).alias(f"g{i}") for i in range(d + 1)],
            *[F.sum(h * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"h{i}_{j}") for i in range(d + 1) for j in range(i + 1)])
        for row in sums.collect():
            r = row[key]
            hessian = np.array([[row[f"h{max(i, j)}_{min(i, j)}"] for j in range(d + 1)] for i in range(d + 1)]) + ridge
            gradient = np.array([row[f"g{i}"] for i in range(d + 1)]) - ridge @ beta[r]
            step = np.linalg.solve(hessian, gradient)
            beta[r] = beta[r] + step
            if np.max(np.abs(step)) < tolerance:
                active.discard(r)
        if not active:
            break
    return spark.createDataFrame([(r, beta[r].tolist(), r not in active) for r in names], f"{schema}, converged boolean")


def meta_bootstrap(
    calibration: DataFrame, components: Sequence[str], residual: str, entity: str, reps: int,
    level: float = 0.9, seed: int = 42, case_id: str = "case_id",
) -> DataFrame:
    """Stability of the error-risk scorer under entity resampling.

    Per replicate: sampled rows and positives, rank correlation of its scores with
    the unresampled fit, and its coefficients.
    """
    weights = multiplicities(calibration.select(entity).distinct(), entity, reps, seed)
    # replicate -1 is the unresampled reference fit
    base = calibration.select(entity).distinct().select(F.lit(-1).alias("replicate"), entity, F.lit(1).cast("long").alias("w"))
    # an entity's draws travel as one list: rows are copied for the replicates where they are used, and not before
    draws = weights.unionByName(base).groupBy(entity).agg(F.collect_list(F.struct("replicate", "w")).alias("_draws"))
    drawn = materialize(calibration.select(entity, residual, *components).join(draws, entity).drop(entity))
    rows = drawn.select(residual, *components, F.explode("_draws").alias("_d")).select(residual, *components, "_d.*")
    limits = quantiles(rows, residual, {"_limit": level}, ["replicate"], "w", written=True)
    ranges = rows.groupBy("replicate").agg(*[F.min(c).alias(f"_lo{i}") for i, c in enumerate(components)],
                                           *[F.max(c).alias(f"_hi{i}") for i, c in enumerate(components)])
    fitted_on = _join_panels([rows, limits, ranges], ["replicate"])

    def scaled(i: int, c: str, of: str = "") -> Column:
        span = F.col(f"{of}_hi{i}") - F.col(f"{of}_lo{i}")
        return F.when(span > 1e-12, (F.col(c) - F.col(f"{of}_lo{i}")) / span).otherwise(0.0)
    scaled_rows = fitted_on.select(
        "replicate", "w", (F.col(residual) >= F.col("_limit")).alias("_y"),
        *[scaled(i, c).alias(f"_s{i}") for i, c in enumerate(components)])
    scaled_rows = materialize(scaled_rows)
    coefs = replicate_logistic(scaled_rows, [f"_s{i}" for i in range(len(components))], "_y", "w")
    counts = scaled_rows.groupBy("replicate").agg(F.sum("w").alias("sampled_case_n"),
                                                  F.sum(F.when(F.col("_y"), F.col("w")).otherwise(0)).alias("sampled_positive_n"))
    # every fit scores the whole calibration table; cases meet by id once, not once for each replicate, and every fit is beside the reference fit
    model = materialize(coefs.join(ranges, "replicate"))
    first = model.where("replicate = -1").select(*[F.col(c).alias(f"_first{c}") for c in model.columns if c not in ("replicate", "converged")])
    fits = model.where("replicate >= 0").crossJoin(F.broadcast(first))
    pairs = calibration.select(case_id, *components).join(
        calibration.select(case_id, *[F.col(c).alias(f"_other{i}") for i, c in enumerate(components)]), case_id)
    pairs = pairs.select(*components, *[f"_other{i}" for i in range(len(components))], F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("replicate"))
    z, ref = F.col("_b")[len(components)], F.col("_first_b")[len(components)]
    for i, c in enumerate(components):
        z = z + F.col("_b")[i] * scaled(i, c)
        ref = ref + F.col("_first_b")[i] * scaled(i, f"_other{i}", "_first")
    scores = pairs.join(F.broadcast(fits), "replicate").select("replicate", z.alias("_z"), ref.alias("_ref"))
    scores = materialize(scores.groupBy("replicate", "_z", "_ref").agg(F.count("*").alias("_n")))
    corr = spearman(scores, "_z", "_ref", ["replicate"], "_n")
    out = _join_panels([counts, corr, coefs], ["replicate"]).where("replicate >= 0")
    return out.select("replicate", "sampled_case_n", "sampled_positive_n", F.col("spearman").alias("score_spearman"),
                      "converged", *[F.col("_b")[i].alias(f"coef_{c}") for i, c in enumerate(components)])


def selection_study(
    panel_df: DataFrame, candidates: Mapping[str, str], repeats: int, size: int, fixed: str,
    objective: str = "directional_underprediction_area", fraction: float = 0.25, entity: str = "entity",
    default: str | None = None, seed: int = 42,
) -> DataFrame:
    """Repeated signal choice: the chosen, a fixed, the best in hindsight and a random review, per repeat.

    All repeats are one plan keyed by ``repeat``: development and evaluation rows come
    from one draw, selection and evaluation are panel operators.  Only the entities are written, with the columns
    that are read; their copies are made where they are used.
    """
    from quotaloom.operators.routing import evaluate_signals, select_signal
    from quotaloom.operators.splits import repeated_draws

    default = default or fixed
    used = dict.fromkeys([entity, "true_high", "pred_high", "y_true", "y_pred", "loss", *candidates.values()])
    people = materialize(panel_df.select(*[c for c in used if c in panel_df.columns]))
    drawn = repeated_draws(spread(people), entity, repeats, size, seed)
    development, evaluation = materialize(drawn.where("role = 'development'")), drawn.where("role = 'evaluation'")
    chosen = select_signal(evaluate_signals(development, candidates, objective, fraction, panel=["repeat"]),
                           objective, default, ["repeat"])
    outcome = materialize(evaluate_signals(evaluation, candidates, "false_negative_capture", fraction, panel=["repeat"]))
    hindsight = select_signal(outcome, "false_negative_capture", default, ["repeat"])
    keep = ["repeat", "signal", *OMISSION_RATES]
    rates = outcome.select(*keep)

    def of(choice: DataFrame, name: str) -> DataFrame:
        picked = choice.select("repeat", F.col("selected_signal").alias("signal"), "selection_source")
        return rates.join(picked, ["repeat", "signal"]).withColumn("comparison", F.lit(name))
    random = random_reference(evaluation, fraction, ["repeat"]).select(
        "repeat", F.lit("random").alias("signal"), *OMISSION_RATES, F.lit("closed_form").alias("selection_source"),
        F.lit("random_review").alias("comparison"))
    out = of(chosen, "selected_measure")
    out = out.unionByName(rates.where(F.col("signal") == fixed).select(
        *keep, F.lit("fixed_comparator").alias("selection_source"), F.lit("fixed_measure").alias("comparison")))
    out = out.unionByName(of(hindsight.withColumn("selection_source", F.lit("evaluation_outcomes")), "post_hoc_best"))
    return out.unionByName(random)


def random_review_replicates(
    panel_df: DataFrame, fraction: float, reps: int, entity: str = "entity", seed: int = 42,
    panel: Sequence[str] = (), min_one: bool = True,
) -> DataFrame:
    """Simulated random reviews in hash order; the closed form in ``random_reference`` is the cheap route."""
    from quotaloom.operators.scan import hash_key

    rows = replicates(panel_df, reps)
    keys = [*panel, "replicate"]
    scan = ordered_scan(rows, [asc(hash_key(F.concat(F.lit(f"{seed}-"), F.col("replicate").cast("string")), entity)),
                               asc(F.col(entity).cast("string"))], keys, rank="_r", total="_n")
    scan = scan.withColumn("reviewed", F.col("_r") <= review_count(F.col("_n"), fraction, min_one))
    return omission_metrics(scan, keys)


