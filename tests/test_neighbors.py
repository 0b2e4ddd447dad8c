"""The index of cells: exact on every kernel, and few distances measured where the data have structure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotaloom.operators import kernels, neighbors


def frame(spark, ids, **columns):
    kinds = {"vector": "array<double>", "codes": "array<long>", "words": "array<long>", "b1": "array<double>", "b2": "array<double>", "g": "string", "e": "string"}
    schema = "case_id string, " + ", ".join(f"{c} {kinds[c]}" for c in columns)
    rows = zip(ids, *[v.tolist() if isinstance(v, np.ndarray) else v for v in columns.values()])
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def nearest_of(kernel, q, t, qids, tids, k, groups=None, exclude_self=False):
    """(query, variant) -> [(distance, neighbour)] by the full table of distances."""
    out = {}
    for variant, d in kernel(q, t).items():
        d = np.where(np.isfinite(d), d, np.inf)
        for i, qid in enumerate(qids):
            best = {}
            for j, tid in enumerate(tids):
                if np.isfinite(d[i, j]) and not (exclude_self and qid == tid):
                    name = tid if groups is None else groups[j]
                    best[name] = min(best.get(name, np.inf), d[i, j])
            if best:
                out[qid, variant] = sorted((x, n) for n, x in best.items())[:k]
    return out


def check(found, expected):
    got = {}
    for r in found.orderBy("neighbor_rank").collect():
        got.setdefault((r.case_id, r.variant), []).append((r.distance, r.neighbor_id))
    assert set(got) == set(expected)
    for key, best in expected.items():
        assert [x for x, _ in got[key]] == pytest.approx([x for x, _ in best], abs=2e-7), key
        clear = [n for (x, n) in best if abs(x - best[-1][0]) > 1e-6]
        assert set(clear) <= {n for _, n in got[key]}


def ids(prefix, n):
    return [f"{prefix}{i:04d}" for i in range(n)]


def clusters(rng, n, width, centers, spread):
    return centers[rng.integers(0, len(centers), n)] + rng.normal(scale=spread, size=(n, width))


@pytest.mark.parametrize(("kernel", "most"), [(neighbors.euclidean, 0.25), (neighbors.cosine, 0.25)])
def test_clusters_are_found_in_few_cells(spark, kernel, most):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 24))
    q, t = clusters(rng, 150, 24, centers, 0.02), clusters(rng, 2500, 24, centers, 0.02)
    s = neighbors.search(frame(spark, ids("q", 150), vector=q), frame(spark, ids("t", 2500), vector=t), 5, kernel, ["vector"])  # over LEAF rows
    check(s.found, nearest_of(kernel, {"vector": q}, {"vector": t}, ids("q", 150), ids("t", 2500), 5))
    assert s.compared() < most * 150 * 2500


@pytest.mark.parametrize("leaf", [0, 100, neighbors.LEAF])
def test_groups_keys_repeats_and_zero_rows(spark, leaf):
    rng = np.random.default_rng(2)
    t = rng.normal(size=(300, 3))
    t[:40] = t[0]
    t[40:60] = 0.0
    groups = [f"g{x}" for x in rng.integers(0, 30, 300)]
    keys = [f"e{x}" for x in rng.integers(0, 3, 300)]
    rows = frame(spark, ids("t", 300), vector=t, g=groups, e=keys)
    for kernel in (neighbors.euclidean, neighbors.cosine):
        s = neighbors.search(rows, rows, 4, kernel, ["vector"], group="g", query_tile=37, train_tile=11, leaf=leaf)
        check(s.found, nearest_of(kernel, {"vector": t}, {"vector": t}, ids("t", 300), ids("t", 300), 4, groups))
        s = neighbors.search(rows, rows, 4, kernel, ["vector"], on="e", exclude_self=True, leaf=leaf)
        expected = {}
        for e in set(keys):
            at = [i for i, x in enumerate(keys) if x == e]
            part = [ids("t", 300)[i] for i in at]
            expected |= nearest_of(kernel, {"vector": t[at]}, {"vector": t[at]}, part, part, 4, exclude_self=True)
        check(s.found, expected)


def test_block_subsets_of_unequal_width(spark):
    rng = np.random.default_rng(3)
    q = {"b1": rng.normal(size=(40, 2)), "b2": rng.normal(size=(40, 5))}
    t = {"b1": rng.normal(size=(400, 2)), "b2": rng.normal(size=(400, 5))}
    kernel = neighbors.block_subsets({"both": ("b1", "b2"), "first": ("b1",), "second": ("b2",)})
    s = neighbors.search(frame(spark, ids("q", 40), **q), frame(spark, ids("t", 400), **t), 6, kernel, ["b1", "b2"], leaf=0)
    check(s.found, nearest_of(kernel, q, t, ids("q", 40), ids("t", 400), 6))


def test_fields_that_are_not_known(spark):
    rng = np.random.default_rng(4)
    def draw(n):
        x = rng.random((n, 3)) * [1, 2, 1]
        x[rng.random((n, 3)) < 0.15] = np.nan
        return {"vector": x, "codes": rng.integers(-1, 5, (n, 2))}
    q, t = draw(60), draw(3000)
    for kernel, columns, most in ((neighbors.gower, ["vector", "codes"], 0.6), (neighbors.nan_euclidean, ["vector"], 0.3)):
        s = neighbors.search(frame(spark, ids("q", 60), **q), frame(spark, ids("t", 3000), **t), 5, kernel, columns)
        check(s.found, nearest_of(kernel, q, t, ids("q", 60), ids("t", 3000), 5))
        assert s.compared() < most * 60 * 3000


def test_sparse_bits(spark):
    rng = np.random.default_rng(5)
    kinds = rng.random((60, 256)) < 0.08
    def draw(n):
        bits = kinds[rng.integers(0, 60, n)] ^ (rng.random((n, 256)) < 0.004)
        bits[:3] = False
        return np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    q, t = {"words": draw(60)}, {"words": draw(2000)}
    s = neighbors.search(frame(spark, ids("q", 60), **q), frame(spark, ids("t", 2000), **t), 3, neighbors.tanimoto, ["words"], leaf=0)
    check(s.found, nearest_of(neighbors.tanimoto, q, t, ids("q", 60), ids("t", 2000), 3))
    assert s.compared() < 0.5 * 60 * 2000


def test_bounds_are_never_above_a_distance():
    rng = np.random.default_rng(6)
    t = {"vector": rng.normal(size=(500, 6)), "codes": rng.integers(-1, 4, (500, 2)), "words": rng.integers(-2 ** 62, 2 ** 62, (500, 2))}
    q = {"vector": rng.normal(size=(50, 6)), "codes": rng.integers(-1, 4, (50, 2)), "words": rng.integers(-2 ** 62, 2 ** 62, (50, 2))}
    t["vector"][rng.random((500, 6)) < 0.1] = np.nan
    whole = {"vector": rng.normal(size=(500, 6))}
    for kernel, rows in ((kernels.Gower(), t), (kernels.NanEuclidean(), t), (kernels.Tanimoto(), t), (neighbors.euclidean, whole), (neighbors.cosine, whole)):
        pivots = {c: v[:9] for c, v in rows.items()}
        cells = kernel.cells(rows, pivots)
        names, _, boxes = kernel.boxes(rows, cells, pivots)
        bound, d = kernel.bounds(q, boxes)[0]["all"], kernel(q, rows)["all"]
        d = np.where(np.isfinite(d), d, np.inf)
        for j, name in enumerate(names):
            assert (bound[:, j] <= d[:, cells == name].min(1) + 1e-9).all(), type(kernel)
        halves = [kernel.boxes({c: v[part] for c, v in rows.items()}, cells[part], pivots) for part in (slice(0, 250), slice(250, 500))]
        for j, name in enumerate(names):
            parts = [box for n, _, b in halves for m, box in zip(n, b) if m == name]
            assert (kernel.merge(np.stack(parts)) == boxes[j]).all()


def test_empty_sides_and_rows_without_a_vector(spark):
    rng = np.random.default_rng(7)
    t = frame(spark, ids("t", 20), vector=rng.normal(size=(20, 2)))
    assert neighbors.nearest(t.limit(0), t, 3, neighbors.euclidean, ["vector"]).count() == 0
    assert neighbors.nearest(t, t.limit(0), 3, neighbors.euclidean, ["vector"]).count() == 0
    holes = t.withColumn("vector", F.when(F.col("case_id") < "t0010", F.col("vector")))
    assert {r.neighbor_id for r in neighbors.nearest(t, holes, 30, neighbors.euclidean, ["vector"]).collect()} == set(ids("t", 10))
