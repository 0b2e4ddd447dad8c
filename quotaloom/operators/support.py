"""Support of a row by the training set: block scaling, moments, range, leverage, lineage, isolation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaloom.functions.text import taxon_value
from quotaloom.operators.scan import asc, hash_key, ordered_scan
from quotaloom.session import materialize


def squared_norm(vector: str) -> Column:
    return F.aggregate(F.col(vector), F.lit(0.0), lambda acc, x: acc + x * x)


def block_scales(train: DataFrame, blocks: Sequence[str]) -> dict[str, float]:
    """Root mean squared row norm per block, 1 where degenerate; one row reaches the driver."""
    row = train.agg(*[F.sqrt(F.avg(squared_norm(b))).alias(b) for b in blocks]).first()
    return {b: float(row[b]) if row[b] is not None and row[b] > 1e-12 else 1.0 for b in blocks}


def _divided(block: str, divisor: float) -> Column:
    return F.transform(F.col(block), lambda x: x / F.lit(divisor))


def scale_blocks(df: DataFrame, scales: Mapping[str, float], name: str = "vector") -> DataFrame:
    """Every block divided by its scale and sqrt(number of blocks), then concatenated."""
    root = float(np.sqrt(len(scales)))
    return df.withColumn(name, F.concat(*[_divided(b, s * root) for b, s in scales.items()]))


def scale_each_block(df: DataFrame, scales: Mapping[str, float]) -> DataFrame:
    """The scaled blocks kept apart, for distances over subsets of them."""
    root = float(np.sqrt(len(scales)))
    return df.withColumns({b: _divided(b, s * root) for b, s in scales.items()})


@dataclass(frozen=True)
class Moments:
    n: int
    total: np.ndarray
    gram: np.ndarray
    low: np.ndarray
    high: np.ndarray
    fourth: float

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n


def moments(df: DataFrame, vector: str, center: np.ndarray | None = None) -> Moments:
    """Row count, sums, Gram matrix, ranges and sum of fourth norms of a vector column.

    Every task folds its whole partition into one d x d matrix; the matrices are then
    summed element by element in a shuffle, so the driver receives d*d numbers
    however many partitions there are.
    """
    shift = None if center is None else np.asarray(center, dtype=float)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            if shift is not None:
                x = x - shift
            part = [float(len(x)), x.sum(0), x.T @ x, x.min(0), x.max(0), float(((x * x).sum(1) ** 2).sum())]
            acc = part if acc is None else [
                acc[0] + part[0], acc[1] + part[1], acc[2] + part[2], np.minimum(acc[3], part[3]),
                np.maximum(acc[4], part[4]), acc[5] + part[5]]
        if acc is not None:
            flat = {"n": [acc[0]], "s": acc[1], "g": acc[2].ravel(), "lo": acc[3], "hi": acc[4], "f": [acc[5]]}
            kinds = [k for k, v in flat.items() for _ in range(len(v))]
            places = [i for v in flat.values() for i in range(len(v))]
            values = [float(x) for v in flat.values() for x in v]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array(places, pa.int32()), pa.array(values, pa.float64())], names=["kind", "at", "value"])

    parts = df.select(F.col(vector)).where(F.col(vector).isNotNull()).mapInArrow(
        fold, "kind string, at int, value double")
    rows = parts.groupBy("kind", "at").agg(
        F.when(F.first("kind") == "lo", F.min("value")).when(F.first("kind") == "hi", F.max("value"))
        .otherwise(F.sum("value")).alias("value")).collect()
    got: dict[str, dict[int, float]] = {}
    for r in rows:
        got.setdefault(r["kind"], {})[r["at"]] = r["value"]
    if not got:
        raise ValueError("moments need at least one row")
    d = len(got["s"])
    vec = {k: np.array([got[k][i] for i in range(len(got[k]))]) for k in got}
    return Moments(int(vec["n"][0]), vec["s"], vec["g"].reshape(d, d), vec["lo"], vec["hi"], float(vec["f"][0]))


def quadratic_form(df: DataFrame, vector: str, center: np.ndarray, matrix: np.ndarray, name: str,
                   root: bool = True, intercept: bool = False) -> DataFrame:
    """(x - c)' A (x - c) in Arrow batches; A is d x d and travels with the task closure."""
    c, a = np.asarray(center, dtype=float), np.asarray(matrix, dtype=float)

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        x = np.stack(values.to_numpy()).astype(float) if len(values) else np.zeros((0, len(c)))
        x = x - c
        if intercept:
            x = np.hstack([np.ones((len(x), 1)), x])
        q = np.maximum(np.einsum("ij,jk,ik->i", x, a, x), 0.0)
        return pd.Series(np.sqrt(q) if root else q)

    return df.withColumn(name, score(F.col(vector)))


def covariance(m: Moments, ddof: int = 1) -> np.ndarray:
    mean = m.mean
    return (m.gram - m.n * np.outer(mean, mean)) / (m.n - ddof)


def mahalanobis(query: DataFrame, train: DataFrame, vector: str = "vector", name: str = "mahalanobis",
                ridge: float = 1e-6) -> DataFrame:
    m = moments(train, vector)
    cov = covariance(m) + np.eye(len(m.total)) * ridge
    return quadratic_form(query, vector, m.mean, np.linalg.pinv(cov), name)


def ledoit_wolf(train: DataFrame, vector: str = "vector") -> tuple[np.ndarray, np.ndarray, float]:
    """Location, precision and shrinkage intensity of the Ledoit-Wolf (2004) estimator."""
    mean = moments(train, vector).mean
    m = moments(train, vector, mean)
    n, p = m.n, len(mean)
    cov = m.gram / n
    mu = np.trace(cov) / p
    delta_sum = float((m.gram ** 2).sum()) / n ** 2
    beta = (m.fourth / n - delta_sum) / (p * n)
    delta = (delta_sum - 2.0 * mu * np.trace(cov) + p * mu ** 2) / p
    beta = min(beta, delta)
    shrinkage = 0.0 if beta == 0 else beta / delta
    shrunk = (1.0 - shrinkage) * cov + shrinkage * mu * np.eye(p)
    return mean, np.linalg.pinv(shrunk), float(shrinkage)


def shrinkage_mahalanobis(query: DataFrame, train: DataFrame, vector: str = "vector",
                          name: str = "shrinkage_mahalanobis") -> DataFrame:
    mean, precision, _ = ledoit_wolf(train, vector)
    return quadratic_form(query, vector, mean, precision, name)


def leverage(query: DataFrame, train: DataFrame, vector: str = "vector", name: str = "leverage",
             ridge: float = 1e-8) -> DataFrame:
    """h = x'(X'X + ridge I)^-1 x with an intercept column."""
    m = moments(train, vector)
    d = len(m.total)
    full = np.empty((d + 1, d + 1))
    full[0, 0], full[0, 1:], full[1:, 0], full[1:, 1:] = m.n, m.total, m.total, m.gram
    return quadratic_form(query, vector, np.zeros(d), np.linalg.pinv(full + ridge * np.eye(d + 1)), name, False, True)


def range_score(query: DataFrame, train: DataFrame, vector: str = "vector", name: str = "range_score") -> DataFrame:
    """Share of components outside the training minimum and maximum."""
    m = moments(train, vector)
    low, high = F.array(*[F.lit(float(v)) for v in m.low]), F.array(*[F.lit(float(v)) for v in m.high])
    outside = F.zip_with(F.zip_with(F.col(vector), low, lambda x, lo: F.when(x < lo, None).otherwise(x)), high,
                         lambda x, hi: F.when(x.isNull() | (x > hi), 1.0).otherwise(0.0))
    return query.withColumn(name, F.aggregate(outside, F.lit(0.0), lambda a, x: a + x) / float(len(m.total)))


def lineage_prefixes(levels: Sequence[str]) -> list[Column]:
    """One struct per depth; NULL from the first missing level downwards."""
    out, complete = [], F.lit(True)
    for depth in range(1, len(levels) + 1):
        complete = complete & taxon_value(F.col(levels[depth - 1])).isNotNull()
        parts = [taxon_value(F.col(c)).alias(f"l{i}") for i, c in enumerate(levels[:depth])]
        out.append(F.when(complete, F.to_json(F.struct(*parts))))
    return out


def taxonomy_novelty(query: DataFrame, train: DataFrame, levels: Sequence[str], case_id: str = "case_id",
                     name: str = "taxonomy_novelty") -> DataFrame:
    """1 - deepest lineage prefix seen in training / number of levels.

    A seen prefix implies its ancestors, so the deepest match is a maximum over an
    equality join; the training prefixes are distinct and left to AQE to broadcast.
    """
    def exploded(df: DataFrame, *keep: str) -> DataFrame:
        entries = [F.struct(F.lit(i + 1).alias("depth"), p.alias("prefix")) for i, p in enumerate(lineage_prefixes(levels))]
        return df.select(*keep, F.explode(F.array(*entries)).alias("_e")).select(*keep, "_e.*").where(
            F.col("prefix").isNotNull())
    seen = exploded(train).distinct()
    # distinct lineages are scored once, then attached to the rows that carry them
    lineage = F.to_json(F.struct(*[taxon_value(F.col(c)).alias(f"l{i}") for i, c in enumerate(levels)]))
    kinds = query.select(lineage.alias("_lineage"), *levels).dropDuplicates(["_lineage"])
    deepest = exploded(kinds, "_lineage").join(seen, ["depth", "prefix"], "left_semi").groupBy("_lineage").agg(
        F.max("depth").alias("_depth"))
    rows = query.withColumn("_lineage", lineage).join(deepest, "_lineage", "left")
    return rows.select(case_id, (1.0 - F.coalesce(F.col("_depth"), F.lit(0)) / float(len(levels))).alias(name))


def impute_and_standardise(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """(median, mean, population SD) after median imputation; an all-missing column imputes 0."""
    from quotaloom.operators.scan import quantiles

    long = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_e")).select("_e.*")
    mid = {r["name"]: float(r["m"]) for r in quantiles(long, "value", {"m": 0.5}, ["name"]).collect()}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(mid.get(c, 0.0))) for c in columns}
    row = train.agg(*[F.avg(v).alias(f"m_{c}") for c, v in filled.items()],
                    *[F.stddev_pop(v).alias(f"s_{c}") for c, v in filled.items()]).first()
    return {c: (mid.get(c, 0.0), float(row[f"m_{c}"]), float(row[f"s_{c}"]) if row[f"s_{c}"] > 1e-12 else 1.0)
            for c in columns}


def apply_standardise(df: DataFrame, fitted: Mapping[str, tuple[float, float, float]], name: str) -> DataFrame:
    return df.withColumn(name, F.array(*[
        (F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(mean)) / F.lit(sd) for c, (m, mean, sd) in fitted.items()]))


#: categories that a dense encoding may have; each row then holds one number for each
DENSE_CATEGORIES = 10_000


def index_categories(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The encoding as a table: name, value, slot (from 0, by column and value) and ``usual`` for a column's most frequent value."""
    pairs = train.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("at"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])).alias("_e"))
    counts = pairs.select("_e.*").where(F.col("value").isNotNull()).groupBy("at", "name", "value").agg(F.count("*").alias("n"))
    numbered = materialize(ordered_scan(counts, [asc("at"), asc("value")], rank="_slot", total="_width"))
    usual = numbered.groupBy("name").agg(F.min(F.struct(-F.col("n"), "value")).alias("_u")).select("name", F.col("_u.value").alias("_usual"))
    return materialize(numbered.join(usual, "name").select(
        "name", "value", (F.col("_slot") - 1).alias("slot"), (F.col("value") == F.col("_usual")).alias("usual")))


def one_hot_slots(df: DataFrame, categories: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """The slots that are 1, as an ascending array: a missing value has the usual category, an unknown one none.

    Categories are looked up by joins on their table, so neither the driver nor a row ever holds all of them.
    """
    out, slots = df, []
    usual = {r["name"]: r["value"] for r in categories.where("usual").select("name", "value").collect()}  # a row for each column
    for i, c in enumerate(columns):
        known = categories.where(F.col("name") == c).select(F.col("value").alias(f"_value{i}"), F.col("slot").alias(f"_slot{i}"))
        value = F.coalesce(F.col(c).cast("string"), F.lit(usual.get(c)).cast("string"))
        out = out.withColumn(f"_key{i}", value).join(known, F.col(f"_key{i}") == F.col(f"_value{i}"), "left")
        slots.append(F.col(f"_slot{i}"))
    return out.select(*[F.col(c) for c in df.columns], F.sort_array(F.array_compact(F.array(*slots))).alias(name))


def one_hot_categories(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str, list[str]]]:
    """(most frequent value, sorted categories) per column for a dense encoding of up to DENSE_CATEGORIES."""
    table = index_categories(train, columns)
    rows = table.orderBy("slot").limit(DENSE_CATEGORIES + 1).collect()
    if len(rows) > DENSE_CATEGORIES:
        raise ValueError(f"over {DENSE_CATEGORIES} categories: encode them sparsely, with index_categories and one_hot_slots")
    return {c: (next((r["value"] for r in rows if r["name"] == c and r["usual"]), ""), [r["value"] for r in rows if r["name"] == c]) for c in columns}


def apply_one_hot(df: DataFrame, fitted: Mapping[str, tuple[str, list[str]]], name: str) -> DataFrame:
    """0/1 array; a missing value takes the most frequent category, an unknown one is all zeros."""
    def hot(column: str, mode: str, cats: Sequence[str]) -> Column:
        value = F.coalesce(F.col(column).cast("string"), F.lit(mode))
        # one array literal, however many categories there are
        return F.transform(F.lit(list(cats)), lambda v: F.when(value == v, 1.0).otherwise(0.0))

    parts = [hot(c, mode, cats) for c, (mode, cats) in fitted.items() if cats]
    return df.withColumn(name, F.concat(*parts) if parts else F.array().cast("array<double>"))


# ------------------------------------------------------------------ isolation forest

def _average_path(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe))


def isolation_trees(train: DataFrame, vector: str, case_id: str, trees: int = 300, sample: int = 256,
                    seed: int = 42) -> tuple[list[np.ndarray], int]:
    """Random isolation trees, one per task group of at most ``sample`` rows.

    A sample is a run of consecutive rows in hash order, which is a draw without
    replacement; only trees * sample rows leave the training table.
    """
    scan = ordered_scan(train.select(case_id, F.col(vector).alias("vector")),
                        [asc(hash_key(seed, case_id)), asc(F.col(case_id).cast("string"))], rank="_r", total="_n")
    n = scan.select("_n").first()[0]
    size = int(min(sample, n))
    spark = train.sparkSession
    draws = spark.range(trees * size).select(
        (F.col("id") / size).cast("int").alias("tree"), F.pmod(F.col("id"), F.lit(size)).alias("_j"))
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("tree")), F.lit(n))
    picked = draws.withColumn("_r", F.pmod(start + F.col("_j"), F.lit(n)) + 1).join(scan, "_r").select("tree", "vector")
    limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(key, rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        rng = np.random.default_rng([seed, tree])
        x = np.stack(rows["vector"].to_numpy()).astype(float)
        nodes: list[list[float]] = []

        def build(index: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, -1, -1, depth + float(_average_path(len(index)))])
            spread = x[index].max(0) - x[index].min(0)
            usable = np.flatnonzero(spread > 0)
            if depth >= limit or len(index) <= 1 or len(usable) == 0:
                return me
            f = int(rng.choice(usable))
            cut = float(rng.uniform(x[index, f].min(), x[index, f].max()))
            left = index[x[index, f] <= cut]
            right = index[x[index, f] > cut]
            if len(left) == 0 or len(right) == 0:
                return me
            l, r = build(left, depth + 1), build(right, depth + 1)
            nodes[me][:4] = [f, cut, l, r]
            return me

        build(np.arange(len(x)), 0)
        return pd.DataFrame([(tree, i, *node) for i, node in enumerate(nodes)],
                            columns=["tree", "node", "feature", "cut", "left", "right", "path"])

    rows = picked.groupBy("tree").applyInPandas(
        grow, "tree int, node int, feature int, cut double, left int, right int, path double").toPandas()
    out = [g.sort_values("node")[["feature", "cut", "left", "right", "path"]].to_numpy() for _, g in rows.groupby("tree")]
    return out, size


def isolation_score(query: DataFrame, forest: tuple[list[np.ndarray], int], vector: str = "vector",
                    name: str = "isolation_forest") -> DataFrame:
    """2^(-mean path / expected path); the forest is bounded by trees * 2 * sample nodes."""
    trees, size = forest
    shared = query.sparkSession.sparkContext.broadcast(trees)
    norm = float(_average_path(size)) or 1.0

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=float)
        x = np.stack(values.to_numpy()).astype(float)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in shared.value:
            at = np.zeros(len(x), dtype=int)
            while True:
                feature = t[at, 0].astype(int)
                inner = feature >= 0
                if not inner.any():
                    break
                go_left = x[rows, np.where(inner, feature, 0)] <= t[at, 1]
                at = np.where(inner, np.where(go_left, t[at, 2], t[at, 3]).astype(int), at)
            total += t[at, 4]
        return pd.Series(2.0 ** (-(total / len(shared.value)) / norm))

    return query.withColumn(name, score(F.col(vector)))
