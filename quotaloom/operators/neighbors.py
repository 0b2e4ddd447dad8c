"""Exact nearest-neighbour joins through an index of cells.

Training rows are dealt to cells, each described by one box (see :mod:`quotaloom.operators.kernels`).  A query looks first into the
cells that seem nearest, as many as hold a few times k rows; the k-th distance found there is its radius.  Then it visits every other
cell whose lower bound is within that radius, and no more: what is left out can't be among the k nearest.  Cells are only as good as
the data: rows that lie in groups or vary in few ways are found in few cells, rows spread evenly over many dimensions in all.

Keys of up to ``LEAF`` rows are one cell.  Neighbouring cells are packed to about a tile, so that a query is sent once to each pack
with the list of cells to visit.  A pack and the queries sent to it are cut into tiles of ``TRAIN_TILE`` and ``QUERY_TILE`` rows; every
tile pair is one group of an Arrow co-group.  Only the k best of a query leave a task, never the pairs.  Pivots and boxes are tables,
sent to the tiles of their key, so nothing is collected on the driver.  The number of cells of a key is bounded, and so is what a task
holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotaloom.operators import kernels
from quotaloom.operators.kernels import Kernel
from quotaloom.operators.scan import first_rows
from quotaloom.session import materialize, shuffle_width

QUERY_TILE = 4096
TRAIN_TILE = 8192
#: distances, and distances to pivots and bounds of cells, that a task holds at once
STRIP_CELLS = 1 << 20
#: groups of tiles that are partitions of their own, in multiples of the shuffle's width
GROUPS_WIDTH = 16
#: pivots of one key: half the square root of its rows, up to this many
MAX_PIVOTS = 1024
#: rows of a key up to which it is one cell: their distances are measured faster than they are looked up
LEAF = 2048
#: rows, in multiples of k, that the cells hold in which a query looks first
FIRST_LOOK = 8
#: share of a distance and of the longest row by which rounding may err
SLACK = 1e-7

euclidean = kernels.Euclidean({"all": ["vector"]})
cosine = kernels.Cosine()
tanimoto = kernels.Tanimoto()
nan_euclidean = kernels.NanEuclidean()
gower = kernels.Gower()


def block_subsets(subsets: Mapping[str, Sequence[str]]) -> Kernel:
    """Squared distance is additive over blocks: each block once, every subset is a sum."""
    return kernels.Euclidean(subsets)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """List column to a row matrix, NULL elements as NaN."""
    rows = len(column)
    flat = column.combine_chunks()
    if isinstance(flat, (pa.ListArray, pa.LargeListArray)) and len(set(pa.compute.list_value_length(flat).to_pylist())) > 1:
        raise ValueError("vectors of different lengths can't be compared")
    flat = flat.flatten() if isinstance(flat, (pa.ListArray, pa.LargeListArray)) else flat
    values = flat.to_numpy(zero_copy_only=False)
    return values.reshape(rows, -1) if rows else values.reshape(0, 0)


def _arrays(table: pa.Table, columns: Sequence[str]) -> dict[str, np.ndarray]:
    return {c: _matrix(table.column(c)) for c in columns}


def _nullable(table: pa.Table) -> pa.Table:
    """List columns whose elements may be null, as a schema given as text has them."""
    return table.cast(pa.schema([(f.name, pa.list_(f.type.value_type) if pa.types.is_list(f.type) else f.type) for f in table.schema]))


def _tiles(rows: Column, tile: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / tile)).cast("int")


def _tile_of(key: str, tiles: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col(tiles)).cast("int")


@dataclass(frozen=True)
class Search:
    """Neighbours found, and what it took: for each key and cell the queries that visited it and the rows it holds."""

    found: DataFrame
    visits: DataFrame

    def compared(self) -> int:
        """Distances that were measured."""
        return self.visits.agg(F.coalesce(F.sum(F.col("queries") * F.col("rows")), F.lit(0)).cast("long")).first()[0]


def _deal(rows: DataFrame, sent: DataFrame, sizes: DataFrame, key: str, tile: int) -> tuple[DataFrame, DataFrame]:
    """Rows in tiles of their ``on``, of which ``sizes`` has the number of rows, and another table sent to each tile."""
    tiles = sizes.select("on", _tiles(F.col("n"), tile).alias("tiles"))
    cut = rows.join(tiles, "on").withColumn("tile", _tile_of(key, "tiles")).drop("tiles")
    sent = sent.join(tiles, "on").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    # names of its own for each side: both may come from the same table
    return tuple(df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (cut, sent))


def index(train: DataFrame, counted: DataFrame, kernel: Kernel, features: Sequence[str], train_tile: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Members (``train`` with its ``cell``) and cells (on, cell, rows, box, pack) of prepared rows (on, rid, tid, features).

    A pack is about a tile of rows in neighbouring cells: a query is sent to it once, whichever of its cells it visits.
    """
    columns = list(features)

    def together(rows: pa.Table) -> pa.Table:
        """Pivots next to the same one of a few get numbers in a row, so that their cells come into one pack."""
        rows = rows.sort_by("no")
        few = rows.slice(0, int(np.ceil(np.sqrt(rows.num_rows))))
        order = np.argsort(kernel.cells(_arrays(rows, columns), _arrays(few, columns)), kind="stable")
        return _nullable(rows.drop_columns(["no"]).take(pa.array(order))).append_column("no", pa.array(np.arange(1, len(order) + 1), pa.int32()))
    several = F.when(F.col("n") > leaf, F.ceil(F.sqrt("n") / 2)).otherwise(1)
    draw = Window.partitionBy("on").orderBy(F.xxhash64(F.lit("pivot"), "rid"), "rid")
    # at most MAX_PIVOTS rows of a key leave a task
    pivots = train.select("on", "rid", *columns).withColumn("no", F.row_number().over(draw)).where(F.col("no") <= MAX_PIVOTS)
    pivots = pivots.join(counted, "on").where(F.col("no") <= several).select("on", "no", *columns)
    cut, sent = _deal(train, pivots.groupBy("on").applyInArrow(together, ", ".join(f"{name} {kind}" for name, kind in pivots.dtypes)), counted, "rid", train_tile)
    schema = ", ".join(f"{name} {kind}" for name, kind in train.dtypes)

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.drop_columns(["tile"]), right.sort_by("no")
        cells, boxes = np.zeros(0, np.int64), [None] * left.num_rows
        if left.num_rows and right.num_rows:
            rows, known = _arrays(left, columns), _arrays(right, columns)
            strip = max(1, STRIP_CELLS // right.num_rows)
            cells = np.concatenate([kernel.cells({c: x[at:at + strip] for c, x in rows.items()}, known) for at in range(0, left.num_rows, strip)])
            # the first row of each cell in this tile carries the box of the cell's rows in it
            firsts = {c: i for i, c in reversed(list(enumerate(cells.tolist())))}
            for name, n, box in zip(*kernel.boxes(rows, cells, known)):
                boxes[firsts[int(name)]] = [int(n), *box.tolist()]
        return _nullable(left).append_column("cell", pa.array(cells, pa.int64())).append_column("box", pa.array(boxes, pa.list_(pa.int64())))

    placed = materialize(cut.groupBy("on", "tile").cogroup(sent.groupBy("on", "tile")).applyInArrow(place, f"{schema}, cell long, box array<long>"))

    def merged(parts: pa.Table) -> pa.Table:
        """One box a cell; a tile gives a cell one part at most."""
        boxes = _matrix(parts.column("box"))
        return pa.table({"on": parts.column("on").slice(0, 1), "cell": parts.column("cell").slice(0, 1),
                         "rows": pa.array([int(boxes[:, 0].sum())], pa.int64()),
                         "box": pa.array([kernel.merge(np.ascontiguousarray(boxes[:, 1:])).tolist()], pa.list_(pa.int64()))})
    boxes = placed.where("box is not null").select("on", "cell", "box").groupBy("on", "cell").applyInArrow(
        merged, "on string, cell long, rows long, box array<long>")
    upto = Window.partitionBy("on").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    pack = F.floor(F.coalesce(F.sum("rows").over(upto), F.lit(0)) / train_tile)
    return placed.drop("box"), materialize(boxes.withColumn("pack", pack))


def _first_k(at: np.ndarray, code: np.ndarray, d: np.ndarray, k: int, grouped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each row ``at``, smaller codes first where distances are equal; with ``grouped`` a code counts once."""
    if grouped:
        order = np.lexsort((d, code, at))
        at, code, d = at[order], code[order], d[order]
        once = np.ones(len(at), bool)
        once[1:] = (at[1:] != at[:-1]) | (code[1:] != code[:-1])
        at, code, d = at[once], code[once], d[once]
    order = np.lexsort((code, d, at))
    at, code, d = at[order], code[order], d[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    return at[keep], code[keep], d[keep]


def _visit(pairs: DataFrame, members: DataFrame, cells: DataFrame, k: int, kernel: Kernel, columns: list[str], grouped: bool,
           exclude_self: bool, query_tile: int, train_tile: int) -> tuple[DataFrame, DataFrame]:
    """The k best of each query in each tile of the packs it is sent to, and the visits of cells.

    A query is compared with the rows of the cells that it visits and no others.  Where it has k neighbours already, ``pairs`` says how far
    the last of them is (a column for each variant), and what is farther doesn't leave the task.
    """
    radii = [f"r{i}" for i in range(len(kernel.variants)) if f"r{i}" in pairs.columns]
    packs = cells.groupBy("on", "pack").agg(F.sum("rows").alias("rows"))
    met = pairs.groupBy("on", "pack").agg(F.count("*").alias("queries")).join(packs, ["on", "pack"])
    met = materialize(met.select("on", "pack", _tiles(F.col("queries"), query_tile).alias("qs"), _tiles(F.col("rows"), train_tile).alias("ts")))
    # a group is much work and few bytes: groups are dealt by their number, not put together by their size
    width = shuffle_width(pairs.sparkSession)
    parts = max(width, min(met.agg(F.sum(F.col("qs") * F.col("ts"))).first()[0] or 0, GROUPS_WIDTH * width))

    def every(tiles: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))
    q = pairs.join(met, ["on", "pack"]).select(
        "on", "pack", "qid", "cells", *columns, *radii, _tile_of("qid", "qs").alias("qt"), every("ts").alias("tt"))
    t = members.join(cells.select("on", "cell", "pack"), ["on", "cell"]).join(met, ["on", "pack"]).select(
        "on", "pack", "cell", "tid", "rid", *columns, _tile_of("rid", "ts").alias("tt"), every("qs").alias("qt"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"qid": [], "variant": [], "neighbor_id": [], "distance": []}
        if left.num_rows and right.num_rows:
            asked = left.column("cells").combine_chunks()
            who = np.repeat(np.arange(left.num_rows), pa.compute.list_value_length(asked).to_numpy())
            visited = asked.flatten().to_numpy()
            order = np.argsort(visited, kind="stable")
            who, visited = who[order], visited[order]
            tids = right.column("tid").combine_chunks().fill_null("None").dictionary_encode()
            names = np.array(tids.dictionary.to_pylist(), dtype=object).astype(str)
            rank = np.empty(len(names), np.int64)
            rank[np.argsort(names, kind="stable")] = np.arange(len(names))
            names = np.sort(names, kind="stable")
            code, holds = rank[tids.indices.to_numpy()], right.column("cell").to_numpy()
            order = np.lexsort((code, holds))  # rows of a cell are a run, in the order of their ids
            code, holds, b = code[order], holds[order], {c: x[order] for c, x in _arrays(right, columns).items()}
            a, nothing = _arrays(left, columns), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            if exclude_self:
                qids = np.array(left.column("qid").to_pylist(), dtype=object)
                rids = np.array(right.column("rid").to_pylist(), dtype=object)[order]
            reach = {v: np.full(left.num_rows, np.inf) for v in kernel.variants}
            for v, r in zip(kernel.variants, radii):
                known = left.column(r).to_numpy(zero_copy_only=False).astype(float)
                reach[v] = np.where(np.isnan(known), np.inf, known)
            best, pending = {v: [nothing] for v in kernel.variants}, 0
            for cell in np.intersect1d(visited, holds):
                i = who[slice(*np.searchsorted(visited, [cell, cell + 1]))]
                lo, hi = np.searchsorted(holds, [cell, cell + 1])
                inside, codes = {c: x[lo:hi] for c, x in b.items()}, code[lo:hi]
                starts = np.flatnonzero(np.diff(codes, prepend=-1))
                strip = max(1, STRIP_CELLS // (hi - lo))
                for s in range(0, len(i), strip):  # distances of a whole tile are never held
                    at = i[s:s + strip]
                    for v, d in kernel({c: x[at] for c, x in a.items()}, inside).items():
                        if exclude_self:
                            d[qids[at][:, None] == rids[None, lo:hi]] = np.inf
                        limit = reach[v][at]
                        free = np.flatnonzero(np.isinf(limit))
                        if len(free):  # the k-th of this cell bounds what the others may add
                            near = np.where(np.isfinite(d[free]), d[free], np.inf)
                            near = np.minimum.reduceat(near, starts, axis=1) if grouped else near
                            if near.shape[1] >= k:
                                limit[free] = reach[v][at[free]] = np.partition(near, k - 1, axis=1)[:, k - 1]
                        with np.errstate(invalid="ignore"):
                            row, col = np.nonzero(d <= limit[:, None])
                        near = d[row, col]
                        known = np.isfinite(near)
                        if known.any():
                            got = _first_k(row[known], codes[col[known]], near[known], k, grouped)
                            best[v].append((at[got[0]], *got[1:]))
                            pending += len(got[0])
                if pending > STRIP_CELLS:
                    best, pending = {v: [_first_k(*map(np.concatenate, zip(*x)), k, grouped)] for v, x in best.items()}, 0
            qid = left.column("qid").combine_chunks()
            for v, x in best.items():
                at, codes, d = _first_k(*map(np.concatenate, zip(*x)), k, grouped)
                found["qid"].append(qid.take(pa.array(at)).cast(pa.string()))
                found["variant"].append(pa.array([v], pa.string()).take(pa.array(np.zeros(len(at), np.int64))))
                found["neighbor_id"].append(pa.array(names, pa.string()).take(pa.array(codes)))
                found["distance"].append(pa.array(d, pa.float64()))
        kinds = {"qid": pa.string(), "variant": pa.string(), "neighbor_id": pa.string(), "distance": pa.float64()}
        return pa.table({c: pa.chunked_array(x, kinds[c]) for c, x in found.items()})

    keys = ["on", "pack", "qt", "tt"]
    q, t = (df.select(*[F.col(c).alias(c) for c in df.columns]).repartition(parts, *keys) for df in (q, t))
    best = q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInArrow(tile, "qid string, variant string, neighbor_id string, distance double")
    visits = pairs.select("on", F.explode("cells").alias("cell")).groupBy("on", "cell").agg(F.count("*").alias("queries"))
    return best, visits.join(cells.select("on", "cell", "rows"), ["on", "cell"])


def _best(found: DataFrame, k: int, grouped: bool) -> DataFrame:
    """A tile may drop every group beyond its own k best: one of the global k is among them where its closest row lies."""
    if grouped:
        found = found.groupBy("qid", "variant", "neighbor_id").agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("qid", "variant").orderBy("distance", "neighbor_id")
    return found.withColumn("neighbor_rank", F.row_number().over(w)).where(F.col("neighbor_rank") <= k)


def search(
    query: DataFrame, train: DataFrame, k: int, kernel: Kernel, features: Sequence[str],
    query_id: str = "case_id", train_id: str = "case_id", group: str | None = None, on: str | None = None,
    exclude_self: bool = False, query_tile: int = QUERY_TILE, train_tile: int = TRAIN_TILE, leaf: int = LEAF,
) -> Search:
    """(query_id, variant, neighbor_rank, neighbor_id, distance) of the k nearest training rows, and the cells visited.

    With ``group`` the neighbours are the k groups of smallest minimum distance.  ``on`` restricts neighbours to an equal
    key; rows without a key, and rows without a vector, have no neighbours and are none.  Ties go to the smaller neighbour id.
    """
    columns, grouped = list(features), group is not None
    label = F.col(group if group else train_id).cast("string")

    def prepared(df: DataFrame, *ids: Column) -> DataFrame:
        known = F.col(on).isNotNull() if on else F.lit(True)
        for name, kind in df.select(*features).dtypes:
            if kind.startswith("array"):
                known = known & F.col(name).isNotNull()
        # aliases give each side its own columns: both may come from the same table
        # without a key all rows share an empty one, made of their id: joins on a literal would be no equi-joins
        key = F.col(on).cast("string") if on else F.substring(ids[-1], 1, 0)
        return df.where(known).select(*ids, key.alias("on"), *[F.col(f).alias(f) for f in features])
    q = prepared(query, F.col(query_id).cast("string").alias("qid"))
    t = prepared(train, label.alias("tid"), F.col(train_id).cast("string").alias("rid"))
    counted = materialize(t.groupBy("on").agg(F.count("*").alias("n")))
    options = (k, kernel, columns, grouped, exclude_self, query_tile, train_tile)
    if (counted.agg(F.max("n")).first()[0] or 0) <= leaf:  # nothing to look up: each key is one cell
        one, pack = F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("pack")
        whole = counted.select("on", one, pack, F.col("n").alias("rows"))
        best, met = _visit(q.select("*", pack, F.array(F.lit(0).cast("long")).alias("cells")), t.select("*", one), whole, *options)
        return Search(_best(best, k, grouped).withColumnRenamed("qid", query_id), met)
    members, cells = index(t, counted, kernel, features, train_tile, leaf)
    asked = materialize(q.groupBy("on").agg(F.count("*").alias("n")))
    radii = [f"r{i}" for i in range(len(kernel.variants))]

    def looked_up(rows: DataFrame, choose: object) -> DataFrame:
        cut, sent = _deal(rows, cells, asked, "qid", query_tile)

        def choice(left: pa.Table, right: pa.Table) -> pa.Table:
            names = [c for c in left.column_names if c in ("qid", "on", *columns, *radii)]
            at, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            if left.num_rows and right.num_rows:
                right = right.sort_by("cell")
                rows, boxes, strip = _arrays(left, columns), _matrix(right.column("box")), max(1, STRIP_CELLS // right.num_rows)
                for start in range(0, left.num_rows, strip):
                    picked = choose(left.slice(start, strip), right, *kernel.bounds({c: x[start:start + strip] for c, x in rows.items()}, boxes))
                    who, where = np.nonzero(picked)
                    at.append(who + start)
                    cell.append(where)
            at, cell = np.concatenate(at), np.concatenate(cell)
            # cells come in the order of their packs, so the cells that a query visits in one pack are a run
            pack = right.column("pack").to_numpy()[cell] if right.num_rows else np.zeros(0, np.int64)
            starts = np.flatnonzero(np.diff(at, prepend=-1) | np.diff(pack, prepend=-1)) if len(at) else np.zeros(0, np.int64)
            visited = right.column("cell").to_numpy()[cell] if right.num_rows else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), pa.array(visited, pa.int64()))
            sent_once = _nullable(left.select(names).take(pa.array(at[starts], pa.int64())))
            return sent_once.append_column("pack", pa.array(pack[starts], pa.int64())).append_column("cells", lists)
        kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes if name in ("qid", "on", *columns, *radii))
        return materialize(cut.groupBy("on", "tile").cogroup(sent.groupBy("on", "tile")).applyInArrow(choice, f"{kinds}, pack long, cells array<long>"))

    def first_look(left: pa.Table, right: pa.Table, bounds: Mapping[str, np.ndarray], near: np.ndarray) -> np.ndarray:
        size = right.column("rows").to_numpy()
        order = np.argsort(np.where(np.isfinite(near), near, np.inf), axis=1, kind="stable")
        held = np.cumsum(size[order], axis=1)
        taken = (held - size[order]) < FIRST_LOOK * k
        picked = np.zeros_like(taken)
        np.put_along_axis(picked, order, taken, axis=1)
        return picked & np.isfinite(next(iter(bounds.values())))

    def within(left: pa.Table, right: pa.Table, bounds: Mapping[str, np.ndarray], near: np.ndarray) -> np.ndarray:
        picked = np.zeros(near.shape, bool)
        for name, r in zip(kernel.variants, radii):
            radius = np.array([np.inf if x is None else x for x in left.column(r).to_pylist()])[:, None]
            bound = bounds[name]
            picked |= np.isfinite(bound) & (bound * (1 - SLACK) - SLACK <= radius)
        cells_at = {c: j for j, c in enumerate(right.column("cell").to_pylist())}
        for i, seen in enumerate(left.column("seen").to_pylist()):
            picked[i, [cells_at[c] for c in seen or ()]] = False
        return picked

    pairs = looked_up(q, first_look)
    best, met = _visit(pairs, members, cells, *options)
    best = materialize(_best(best, k, grouped).drop("neighbor_rank"))
    # a variant that has no k neighbours yet has no radius
    reach = best.groupBy("qid").agg(*[
        F.when(F.count_if(F.col("variant") == v) >= k, F.max(F.when(F.col("variant") == v, F.col("distance")))).alias(r)
        for v, r in zip(kernel.variants, radii)])
    seen = pairs.groupBy("qid").agg(F.flatten(F.collect_list("cells")).alias("seen"))
    more = looked_up(q.join(reach, "qid", "left").join(seen, "qid", "left"), within)
    rest, also = _visit(more, members, cells, *options)
    ranked = _best(best.unionByName(rest), k, grouped).withColumnRenamed("qid", query_id)
    return Search(ranked, met.unionByName(also))


def nearest(query: DataFrame, train: DataFrame, k: int, kernel: Kernel, features: Sequence[str], *args: object, **options: object) -> DataFrame:
    """The rows that :func:`search` finds."""
    return search(query, train, k, kernel, features, *args, **options).found


def mean_distance(
    query: DataFrame, found: DataFrame, name: str, query_id: str = "case_id", default: float | None = None
) -> DataFrame:
    """Average distance of the found neighbours; ``default`` where none was comparable."""
    per = found.groupBy(query_id).agg(F.avg("distance").alias(name))
    out = query.select(F.col(query_id).cast("string").alias(query_id)).join(per, query_id, "left")
    return out if default is None else out.fillna({name: default})


def first_per_group(train: DataFrame, group: str, case_id: str) -> DataFrame:
    """One representative per group, the smallest case id; missing groups are one group."""
    keyed = train.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("__missing__")))
    return first_rows(keyed, [group], [F.col(case_id)])


def bit_words(positions: Column, n_bits: int) -> Column:
    """Sorted set-bit positions to 64-bit words."""
    def word(w: int) -> Column:
        inside = F.filter(positions, lambda p: (p >= 64 * w) & (p < 64 * (w + 1)))
        return F.aggregate(inside, F.lit(0).cast("long"),
                           lambda acc, p: acc.bitwiseOR(F.call_function(
                               "shiftleft", F.lit(1).cast("long"), (p - F.lit(64 * w)).cast("int"))))
    return F.array(*[word(w) for w in range(-(-n_bits // 64))])


def sign_words(vector: Column, n_bits: int) -> Column:
    """Bit i is set where component i is positive."""
    def word(w: int) -> Column:
        part = F.slice(vector, 64 * w + 1, min(64, n_bits - 64 * w))
        bits = F.transform(part, lambda x, i: F.when(
            x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))
    return F.array(*[word(w) for w in range(-(-n_bits // 64))])


def context_fields(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], ranges: Mapping[str, float]) -> DataFrame:
    """``vector`` of range-scaled numbers (NaN missing) and non-negative category ``codes`` (-1 missing)."""
    nan = F.lit(float("nan"))
    return df.select(
        "*", F.array(*[F.coalesce(F.col(c).cast("double") / F.lit(ranges[c]), nan) for c in numeric]).alias("vector"),
        F.array(*[F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c)).bitwiseAND(F.lit(2 ** 63 - 1)))
                  .otherwise(F.lit(-1)) for c in categorical] or [F.lit(-1).cast("long")]).alias("codes"))


def gower_ranges(train: DataFrame, numeric: Sequence[str]) -> dict[str, float]:
    """max - min of the training rows; degenerate ranges become 1."""
    row = train.agg(*[(F.max(c) - F.min(c)).cast("double").alias(c) for c in numeric]).first()
    return {c: float(row[c]) if row[c] is not None and row[c] > 1e-12 else 1.0 for c in numeric}


def gower_knn(
    query: DataFrame, train: DataFrame, endpoint: str, numeric: Sequence[str], categorical: Sequence[str],
    k: int = 5, case_id: str = "case_id",
) -> DataFrame:
    """Mean Gower distance to the k nearest rows of the same endpoint; 1 without a candidate."""
    ranges = gower_ranges(train, numeric)
    keep = [case_id, endpoint, *numeric, *categorical]
    fields = [context_fields(d.select(*keep), numeric, categorical, ranges) for d in (query, train)]
    found = nearest(*fields, k, gower, ["vector", "codes"], case_id, case_id, on=endpoint)
    missing = F.lit(0)
    for c in numeric:
        missing = missing + F.col(c).isNull().cast("int")
    share = query.select(F.col(case_id).cast("string").alias(case_id), (missing / max(1, len(numeric))).alias("context_missing_fraction"))
    return mean_distance(query, found, "context_distance", case_id, 1.0).join(share, case_id)


def nan_euclidean_knn(
    query: DataFrame, train: DataFrame, group: str, columns: Sequence[str], k: int = 5, case_id: str = "case_id"
) -> DataFrame:
    """Mean distance on standardised signals to k distinct groups, over jointly observed columns."""
    reps = first_per_group(train.select(case_id, group, *columns), group, case_id)
    stats = reps.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    nan = F.lit(float("nan"))

    def scaled(df: DataFrame) -> DataFrame:
        parts = []
        for c in columns:
            sd = stats[f"s_{c}"]
            parts.append(F.coalesce((F.col(c) - F.lit(float(stats[f"m_{c}"] or 0.0)))
                                    / F.lit(float(sd) if sd is not None and sd > 1e-12 else 1.0), nan))
        return df.select(case_id, F.array(*parts).alias("vector"))
    found = nearest(scaled(query), scaled(reps), k, nan_euclidean, ["vector"], case_id, case_id)
    return mean_distance(query, found, "signal_distance", case_id, 0.0)


def tanimoto_novelty(query: DataFrame, train: DataFrame, words: str = "words", case_id: str = "case_id") -> DataFrame:
    """1 - similarity to the most similar training fingerprint; 1 without training rows."""
    found = nearest(query.select(case_id, F.col(words).alias("words")), train.select(case_id, F.col(words).alias("words")),
                    1, tanimoto, ["words"], case_id, case_id)
    return mean_distance(query, found, "similarity_novelty", case_id, 1.0)


def evidence(found: DataFrame, train: DataFrame, train_id: str, columns: Mapping[str, str]) -> DataFrame:
    """Neighbour rows with the reference columns attached (``output -> column``)."""
    ref = train.select(F.col(train_id).cast("string").alias("neighbor_id"), *[F.col(c).alias(o) for o, c in columns.items()])
    return found.join(ref, "neighbor_id", "left")


def local_outlier_factor(
    query: DataFrame, train: DataFrame, vector: str = "vector", k: int = 35, case_id: str = "case_id"
) -> DataFrame:
    """LOF of new rows against the training rows: local density of the neighbours over one's own.

    Three joins on the neighbour lists; the pair table never exists.
    """
    size = min(k, max(1, train.count() - 1))
    t = train.select(F.col(case_id).cast("string").alias(case_id), F.col(vector).alias("vector"))
    q = query.select(F.col(case_id).cast("string").alias(case_id), F.col(vector).alias("vector"))
    inner = nearest(t, t, size, euclidean, ["vector"], case_id, case_id, exclude_self=True)
    outer = nearest(q, t, size, euclidean, ["vector"], case_id, case_id)
    kdist = inner.groupBy(F.col(case_id).alias("neighbor_id")).agg(F.max("distance").alias("_kdist"))

    def density(found: DataFrame) -> DataFrame:
        reach = F.greatest("distance", "_kdist")
        return found.join(kdist, "neighbor_id").groupBy(case_id).agg(
            (F.lit(1.0) / (F.avg(reach) + F.lit(1e-10))).alias("_lrd"))
    train_lrd = density(inner).select(F.col(case_id).alias("neighbor_id"), F.col("_lrd").alias("_nlrd"))
    own = density(outer)
    neighbours = outer.join(train_lrd, "neighbor_id").groupBy(case_id).agg(F.avg("_nlrd").alias("_mean"))
    return neighbours.join(own, case_id).select(case_id, (F.col("_mean") / F.col("_lrd")).alias("lof"))

