"""Skew-safe order statistics.

Every ordered operator of the package (ranks, quotas, running sums, exact
quantiles, order statistics) goes through :func:`ordered_scan`.  A window
partitioned by the panel key would send a whole panel to one task; here the rows are
range partitioned on (panel, order key), so one hot panel is spread over many tasks
and only one small summary row per (range, panel) is combined globally.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotaloom.session import materialize, shuffle_width

#: groups above this many rows take the range-partitioned path in exact medians
HOT_GROUP_ROWS = 1_000_000
#: rows that one task orders for exact medians, about; more rows go to more tasks
MEDIAN_TASK_ROWS = 250_000
#: hash values by which rows are counted before any group is counted by itself
COUNT_BUCKETS = 1 << 16


@dataclass(frozen=True)
class Key:
    """One ordering key; NULL always sorts last.  ``discrete`` keys have few values, each counted by itself."""

    expr: Column
    descending: bool = False
    discrete: bool = False

    def sort(self, name: str) -> Column:
        return self.on(F.col(name))

    def on(self, col: Column) -> Column:
        return col.desc_nulls_last() if self.descending else col.asc_nulls_last()


def asc(col: Column | str) -> Key:
    return Key(F.col(col) if isinstance(col, str) else col)


def desc(col: Column | str) -> Key:
    return Key(F.col(col) if isinstance(col, str) else col, True)


def hash_key(seed: int | str | Column, *key: Column | str) -> Column:
    """Deterministic shuffle order: sha-256 of ``seed|key``."""
    lead = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.sha2(F.concat_ws("|", lead.cast("string"), *[
        (F.col(k) if isinstance(k, str) else k).cast("string") for k in key]), 256)


def ordered_scan(
    df: DataFrame,
    order: Sequence[Key],
    panel: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    rank: str = "rank",
    total: str = "panel_rows",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add the 1-based ``rank`` in ``order`` within ``panel``, the panel size and running sums.

    For every entry ``name -> column`` of ``sums`` the result holds ``cum_<name>``
    (inclusive running sum) and ``total_<name>``.  ``order`` must be total, that is
    end with a unique tie-break.  Range partitioning samples its input and therefore
    may cut differently when evaluated twice, so its output is checkpointed once
    before the summary and the rows read it.  ``keep`` names the columns that are
    written and returned, where others are there for the order only; panels and sums are made of these.
    """
    sums, columns = dict(sums or {}), list(df.columns if keep is None else keep)
    names = [f"_o{i}" for i in range(len(order))]
    group = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(panel)]) if panel else F.lit(0)
    # rows are dealt by what the keys are, and carry no copies of them
    dealt = df.repartitionByRange(shuffle_width(df.sparkSession), *panel, *[k.on(k.expr) for k in order])
    placed = dealt.select("*", *[k.expr.alias(n) for n, k in zip(names, order)])
    placed = placed.sortWithinPartitions(*panel, *[k.sort(n) for n, k in zip(names, order)])
    # numbers rise along a range: a row's rank is how far its number lies from the first of its panel
    # what else the scan adds for itself is called _scan_*, so that it meets no column of a caller
    ranged = materialize(placed.select(*[F.col(c) for c in columns], F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_row_at")))
    rows = ranged.withColumn("_scan_panel", group)

    # written, so that their size is known: unless panels are many, rows without sums stay where they are
    parts = materialize(rows.groupBy("_range", "_scan_panel").agg(
        F.count("*").alias("_scan_n"), F.min("_row_at").alias("_scan_first"), *[F.sum(m).alias(f"s_{n}") for n, m in sums.items()]))
    # at most one row per range for any panel, however large the panel is
    whole = Window.partitionBy("_scan_panel")
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "_range", "_scan_panel", "_scan_first",
        F.coalesce(F.sum("_scan_n").over(before), F.lit(0)).alias("_scan_before"),
        F.sum("_scan_n").over(whole).cast("long").alias(f"_scan_of_{total}"),
        *[F.coalesce(F.sum(f"s_{n}").over(before), F.lit(0)).alias(f"_scan_b_{n}") for n in sums],
        *[F.sum(f"s_{n}").over(whole).alias(f"_scan_t_{n}") for n in sums],
    )
    # the first number of a panel in a range names both
    running = Window.partitionBy("_scan_first").orderBy("_row_at").rowsBetween(Window.unboundedPreceding, 0)
    measured = rows.select("*", *[m.alias(f"_scan_m_{n}") for n, m in sums.items()])
    return measured.join(offsets, ["_range", "_scan_panel"]).select(
        *[F.col(c) for c in columns],
        (F.col("_scan_before") + F.col("_row_at") - F.col("_scan_first") + 1).cast("long").alias(rank),
        F.col(f"_scan_of_{total}").alias(total),
        *[(F.col(f"_scan_b_{n}") + F.coalesce(F.sum(f"_scan_m_{n}").over(running), F.lit(0))).alias(f"cum_{n}") for n in sums],
        *[F.col(f"_scan_t_{n}").alias(f"total_{n}") for n in sums],
    )


#: cells of a number for each factor of e; a double spans about 1,450 such factors on either side of zero
CELLS = 4096
#: leading characters of a text key (of a digest in hexadecimal: 65,536 cells)
TEXT_CELL = 4


def _cell(key: Column, kind: str) -> Column:
    """A coarse value that never falls where the key rises; numbers of one cell differ by a 4,096th at most."""
    if kind == "string":
        return F.substring(key, 1, TEXT_CELL)
    if kind in ("boolean", "date", "timestamp") or kind.startswith(("array", "struct", "map", "binary")):
        return F.lit(0).cast("long")
    x = key.cast("double")
    size = F.lit(4_000_000) + F.floor(F.ln(F.least(F.abs(x), F.lit(1.7e308))) * CELLS)
    return F.when(x.isNull(), F.lit(None)).when(F.isnan(x), 1 << 40).when(x > 0, size).when(x < 0, -size).otherwise(0).cast("long")


def cut_offs(df: DataFrame, order: Sequence[Key], panel: Sequence[str], ranks: Mapping[str, Column],
             totals: Mapping[str, Column] | None = None, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """The row at each rank, as a struct of its order keys, one row per panel with the number of rows ``_n``.

    ``ranks`` are made of ``_n`` and of the sums over the panel named in ``totals``; rank 0 has no row.  Only order keys are read: a histogram of coarse keys finds the cell in
    which a rank lies, and only the rows of that cell are put in order.  ``order`` must be total.
    """
    names = [f"_key{i}" for i in range(len(order))]
    group = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(panel)]) if panel else F.lit(0)
    totals = dict(totals or {})
    keyed = materialize(df.select(group.alias("_p"), *[k.expr.alias(n) for n, k in zip(names, order)], *[c.alias(n) for n, c in totals.items()]))
    kinds, cells = dict(keyed.dtypes), {}
    for key, name in zip(order, names):
        cells[f"_cell{name[4:]}"] = (F.col(name) if key.discrete else _cell(F.col(name), kinds[name]), key)
        if not key.discrete:
            break
    placed = keyed.select("*", *[c.alias(n) for n, (c, _) in cells.items()])
    counts = placed.groupBy("_p", *cells).agg(F.count("*").alias("_rows"), *[F.sum(n).alias(n) for n in totals])
    whole = Window.partitionBy("_p")
    before = whole.orderBy(*[Key(F.col(n), k.descending).sort(n) for n, (_, k) in cells.items()]).rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.select("*", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("_n"),
                                       *[F.sum(n).over(whole).alias(f"_total{n}") for n in totals]).drop(*totals).withColumnsRenamed({f"_total{n}": n for n in totals}))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), r.cast("long").alias("rank")) for n, r in ranks.items()]))
    at = counts.select("*", wanted.alias("_w")).where((F.col("_w.rank") > F.col("_before")) & (F.col("_w.rank") <= F.col("_before") + F.col("_rows")))
    at = at.select(*[F.col(c).alias(f"_at{c}") for c in ("_p", *cells)], F.col("_w.name").alias("_name"), (F.col("_w.rank") - F.col("_before")).alias("_need"),
                   F.col("_rows").alias("_at_rows"))
    same = F.col("_p") == F.col("_at_p")
    for c in cells:
        same = same & F.col(c).eqNullSafe(F.col(f"_at{c}"))
    inside = placed.join(at, same).select("_p", "_name", "_need", *names)
    keys = [Key(F.col(n), k.descending) for n, k in zip(names, order)]
    if (at.agg(F.max("_at_rows")).first()[0] or 0) > hot_rows:  # a cell of ties or of very near values
        ranked = ordered_scan(inside, keys, ["_p", "_name"], rank="_rank", total="_inside")
    else:
        within = Window.partitionBy("_p", "_name").orderBy(*[k.sort(n) for n, k in zip(names, keys)])
        ranked = inside.withColumn("_rank", F.row_number().over(within))
    cut = F.struct(*names)
    found = ranked.where("_rank = _need").groupBy("_p").agg(*[F.max(F.when(F.col("_name") == n, cut)).alias(n) for n in ranks])
    sizes = counts.groupBy("_p").agg(F.max("_n").alias("_n"))
    return materialize(sizes.join(found, "_p", "left").select(*[F.col(f"_p.p{i}").alias(c) for i, c in enumerate(panel)], "_n", *ranks))


def not_after(order: Sequence[Key], cut: str) -> Column:
    """Whether a row stands at or before the row whose order keys are in the struct ``cut``; false without one."""
    out = F.lit(True)
    for i, key in reversed(list(enumerate(order))):
        at = F.col(f"{cut}._key{i}")
        ahead = F.when(key.expr.isNull(), False).when(at.isNull(), True).otherwise(key.expr > at if key.descending else key.expr < at)
        out = ahead | (key.expr.eqNullSafe(at) & out)
    return F.when(F.col(cut).isNull(), False).otherwise(out)


def flag_first(df: DataFrame, order: Sequence[Key], panel: Sequence[str], ranks: Mapping[str, Column],
               totals: Mapping[str, Column] | None = None) -> DataFrame:
    """For each entry of ``ranks`` whether a row is among the first so many of its panel.

    The rows themselves are neither sorted nor written, but read twice: write down what is dear to compute before.
    """
    cuts = cut_offs(df, order, panel, {f"_cut_{n}": r for n, r in ranks.items()}, totals)
    marked = attach_small(df, cuts, panel)
    return marked.select(*df.columns, *[not_after(order, f"_cut_{n}").alias(n) for n in ranks])


def quantiles(
    df: DataFrame, value: str, levels: Mapping[str, float], panel: Sequence[str] = (),
    weight: str | None = None, written: bool = False,
) -> DataFrame:
    """Exact linear-interpolated quantiles, one output column per entry of ``levels``.

    An integer ``weight`` stands for that many copies of the row.
    Panels, values and weights are written unless ``df`` is ``written`` already; a histogram of coarse values finds the cells in which the wanted places lie, and
    only the distinct values of these cells are put in order, so neither a hot panel nor a hot value lands in one task.
    """
    panel = list(panel)
    group = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(panel)]) if panel else F.lit(0)
    kept = df.where(F.col(value).isNotNull()).select(
        group.alias("_p"), F.col(value).alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    kept = kept if written else materialize(kept)
    placed = kept.withColumn("_cell", _cell(F.col("_v"), dict(kept.dtypes)["_v"]))
    places = {name: (F.col("_total") - 1) * F.lit(float(q)) for name, q in levels.items()}
    whole = Window.partitionBy("_p")
    upto = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    counts = placed.groupBy("_p", "_cell").agg(F.sum("_w").alias("_w"), F.count("*").alias("_rows")).select(
        "*", (F.sum("_w").over(upto) - F.col("_w")).alias("_before"), F.sum("_w").over(whole).alias("_total"))
    wanted = F.lit(False)
    for at in places.values():
        for place in (F.floor(at), F.ceil(at)):
            wanted = wanted | ((place >= F.col("_before")) & (place < F.col("_before") + F.col("_w")))
    cells = materialize(counts.where(wanted).select(
        F.col("_p").alias("_at_p"), F.col("_cell").alias("_at_cell"), "_before", "_total", "_rows"))
    inside = placed.join(cells, (F.col("_p") == F.col("_at_p")) & (F.col("_cell") == F.col("_at_cell")))
    distinct = inside.groupBy("_p", "_cell", "_v", "_before", "_total").agg(F.sum("_w").alias("_w"))
    if (cells.agg(F.max("_rows")).first()[0] or 0) > HOT_GROUP_ROWS:  # a cell of ties or of very near values
        scan = ordered_scan(distinct, [asc("_v")], ["_p", "_cell"], {"w": F.col("_w")})
    else:
        ahead = Window.partitionBy("_p", "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        scan = distinct.withColumn("cum_w", F.sum("_w").over(ahead))
    cum = F.col("_before") + F.col("cum_w")
    parts = []
    for name, at in places.items():
        lower, upper = F.floor(at), F.ceil(at)
        parts += [
            F.min(F.when(cum > lower, F.col("_v"))).alias(f"lo_{name}"),
            F.min(F.when(cum > upper, F.col("_v"))).alias(f"hi_{name}"),
            F.max(at - lower).alias(f"at_{name}"),
        ]
    picked = scan.groupBy("_p").agg(*parts)
    return picked.select(*[F.col(f"_p.p{i}").alias(c) for i, c in enumerate(panel)], *[
        (F.col(f"lo_{n}") + (F.col(f"hi_{n}") - F.col(f"lo_{n}")) * F.col(f"at_{n}")).alias(n)
        for n in levels
    ])


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_GROUP_ROWS) -> DataFrame | None:
    """Keys of groups too large for one task, or None when there are none."""
    return rows_and_hot_groups(df, keys, hot_rows)[1]


def rows_and_hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_GROUP_ROWS) -> tuple[int, DataFrame | None]:
    """The number of rows, and the keys of groups too large for one task, or None when there are none.

    Rows are counted by a hash of their keys: a task holds COUNT_BUCKETS sums at most, however many groups it reads.  Only
    groups of a hash value that has more than ``hot_rows`` rows can be hot, and only these are counted one by one.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(COUNT_BUCKETS)).alias("_bucket")
    sizes = materialize(df.groupBy(bucket).agg(F.count("*").alias("_rows")))
    rows = sizes.agg(F.sum("_rows")).first()[0] or 0
    full = sizes.where(F.col("_rows") > hot_rows).select("_bucket")
    if not full.limit(1).count():
        return rows, None
    within = df.select(*keys, bucket).join(F.broadcast(full), "_bucket", "left_semi")
    hot = materialize(within.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows).select(*keys))
    return rows, hot if hot.limit(1).count() else None


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def group_medians(
    df: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, str],
    extra: Sequence[Column] = (),
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Exact medians per group (``output -> input`` in ``columns``) plus decomposable aggregates.

    Ordinary groups need one shuffle: the rank windows and the final aggregate share
    its partitioning, and their sorts spill, where the built-in percentile serialises
    a hash map per group.  Groups that would not fit one task are split off and
    answered by :func:`quantiles`.
    """
    keys = list(keys)

    def plain(part: DataFrame) -> DataFrame:
        group = Window.partitionBy(*keys)
        ranks = [F.row_number().over(group.orderBy(F.col(src).asc_nulls_last())).alias(f"_r{i}")
                 for i, src in enumerate(columns.values())]
        sizes = [F.count(src).over(group).alias(f"_n{i}") for i, src in enumerate(columns.values())]
        middle = [
            F.avg(F.when(F.col(f"_r{i}").between(F.ceil(F.col(f"_n{i}") / 2), F.floor(F.col(f"_n{i}") / 2) + 1),
                         F.col(src).cast("double"))).alias(out)
            for i, (out, src) in enumerate(columns.items())]
        return part.select("*", *ranks, *sizes).groupBy(*keys).agg(*middle, *extra)

    rows, hot = rows_and_hot_groups(df, keys, hot_rows)
    # as many tasks as the rows need, so that what a task holds doesn't grow with the table
    tasks = max(shuffle_width(df.sparkSession), rows // MEDIAN_TASK_ROWS + 1)
    if hot is None:
        return plain(df.repartition(tasks, *keys))
    cold_rows = df.join(hot, _match(df, hot, keys), "left_anti")
    hot_rows_df = df.join(hot, _match(df, hot, keys), "left_semi")
    long = hot_rows_df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(out).alias("name"), F.col(src).cast("double").alias("value"))
        for out, src in columns.items()])).alias("_kv")).select(*keys, "_kv.name", "_kv.value")
    mid = quantiles(long, "value", {"m": 0.5}, [*keys, "name"])
    wide = mid.groupBy(*keys).agg(*[
        F.max(F.when(F.col("name") == out, F.col("m"))).alias(out) for out in columns])
    if extra:
        rest = hot_rows_df.groupBy(*keys).agg(*extra)
        wide = rest.join(wide, _match(rest, wide, keys), "left").select(
            *[rest[k] for k in keys], *columns, *[c for c in rest.columns if c not in keys])
    else:
        base = hot_rows_df.groupBy(*keys).agg(F.count("*").alias("_rows"))
        wide = base.join(wide, _match(base, wide, keys), "left").select(
            *[base[k] for k in keys], *columns)
    return plain(cold_rows.repartition(tasks, *keys)).unionByName(wide)


def attach(df: DataFrame, per_panel: DataFrame, panel: Sequence[str]) -> DataFrame:
    """Add per-panel columns to rows by a join whose strategy is left to Spark; NULL panel keys match."""
    renamed = per_panel.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(panel)],
        *[c for c in per_panel.columns if c not in panel])
    cond = F.lit(True)
    for i, c in enumerate(panel):
        cond = cond & df[c].eqNullSafe(renamed[f"_k{i}"])
    return df.join(renamed, cond, "left").drop(*[f"_k{i}" for i in range(len(panel))])


def attach_small(df: DataFrame, per_panel: DataFrame, panel: Sequence[str]) -> DataFrame:
    """Add per-panel columns to rows; NULL panel keys match.

    Without a panel the right side is a single aggregate row and becomes a scalar
    subquery; otherwise it is written down, so that its true size is known when the join is
    planned: a few panels are broadcast and the rows stay where they are, instead of meeting
    by panel in a few tasks.  The number of panels has no fixed bound.
    """
    if not panel:
        row = per_panel.select(F.struct(*per_panel.columns)).scalar()
        return df.select("*", row.alias("_row")).select(
            *df.columns, *[F.col(f"_row.{c}").alias(c) for c in per_panel.columns])
    return attach(df, materialize(per_panel), panel)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the smallest by ``order``; partial aggregation, so hot keys combine map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(
        *[o.alias(f"_o{i}") for i, o in enumerate(order)],
        *[F.col(c).alias(c) for c in rest])).alias("_best")
    return df.groupBy(*keys).agg(best).select(
        *[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])
