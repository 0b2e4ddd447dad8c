"""Leakage-free partitions in a deterministic hash order.

Every splitter adds ``partition`` (train / calibration / test) and keeps all rows.
Seeded shuffles are replaced by ordering on sha-256(seed|key), so a split is the
same on every cluster layout and can be recomputed in any SQL engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotaloom.operators.scan import Key, asc, attach_small, cut_offs, desc, flag_first, hash_key, not_after, ordered_scan

MISSING_GROUP = "__missing_group__"
#: drawn rows of a repeat up to which a task that looks for them keeps no others (Spark's windowGroupLimitThreshold)
FEW_DRAWN = 1000


def _at_least_one(share: Column) -> Column:
    return F.greatest(F.lit(1.0), F.rint(share))


def _hashed(seed: int | str, case_id: str) -> list[Key]:
    return [asc(hash_key(seed, case_id)), asc(F.col(case_id).cast("string"))]


def _calibrate(rest: DataFrame, case_id: str, seed: int, fraction: float) -> DataFrame:
    """Row-level calibration draw from the rows left after the test set."""
    first = flag_first(rest, _hashed(f"{seed}-calibration", case_id), (), {"_first": _at_least_one(F.col("_n") * fraction)})
    return first.withColumn("partition", F.when(F.col("_first"), "calibration").otherwise("train")).drop("_first")


def random_split(
    df: DataFrame, case_id: str, seed: int = 42, test: float = 0.2, calibration: float = 0.125
) -> DataFrame:
    """Exact-size row split: one hash order, its head is test, the next stretch calibration."""
    n_test = F.least(F.col("_n"), _at_least_one(F.col("_n") * test))
    n_cal = _at_least_one((F.col("_n") - n_test) * calibration)
    first = flag_first(df, _hashed(seed, case_id), (), {"_test": n_test, "_more": F.least(F.col("_n"), n_test + n_cal)})
    part = F.when(F.col("_test"), "test").when(F.col("_more"), "calibration").otherwise("train")
    return first.withColumn("partition", part).drop("_test", "_more")


def group_order(df: DataFrame, group: str, seed: int | str) -> DataFrame:
    """Groups in hash order with their size, rank, running and total rows; NULL is a group."""
    sizes = df.groupBy(F.coalesce(F.col(group).cast("string"), F.lit(MISSING_GROUP)).alias("_group")).agg(
        F.count("*").alias("_size"))
    return ordered_scan(sizes, [asc(hash_key(seed, "_group")), asc("_group")], (), {"rows": F.col("_size")},
                        rank="_rank", total="_groups")


def _label(df: DataFrame, groups: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    key = F.coalesce(F.col(group).cast("string"), F.lit(MISSING_GROUP))
    return df.withColumn("_group", key).join(groups.select("_group", *columns), "_group", "left").drop("_group")


def group_holdout_split(
    df: DataFrame, group: str, case_id: str, seed: int = 42, holdout: float = 0.2, calibration: float = 0.125
) -> DataFrame:
    """Whole groups enter the test set until it holds the target rows; calibration is row-level."""
    groups = group_order(df, group, seed)
    target = _at_least_one(F.col("total_rows") * holdout)
    held = (F.col("cum_rows") - F.col("_size")) < target
    rows = _label(df, groups.withColumn("_held", held), group, ["_held"])
    test = rows.where("_held").drop("_held").withColumn("partition", F.lit("test"))
    rest = _calibrate(rows.where(~F.col("_held")).drop("_held"), case_id, seed, calibration)
    return test.unionByName(rest)


def assign_groups(df: DataFrame, group: str, seed: int = 42, holdout: float = 0.2,
                  calibration: float = 0.125) -> DataFrame:
    """(group, partition) table of the three-way split; two groups are reserved after the test draw."""
    groups = group_order(df, group, seed)
    target = _at_least_one(F.col("total_rows") * holdout)
    before = F.col("cum_rows") - F.col("_size")
    enough = F.when(F.col("_groups") >= 3, F.lit(True)).otherwise(
        F.raise_error(F.lit("Three-way grouped splitting requires at least three groups.")).cast("boolean"))
    is_test = enough & (before < target) & (F.col("_rank") <= F.col("_groups") - 2)
    tested = groups.withColumn("_test", is_test)
    test_rows = tested.where("_test").agg(F.sum("_size").alias("_test_rows"), F.count("*").alias("_test_groups"))
    rest = attach_small(tested, test_rows, ())
    cal_target = _at_least_one((F.col("total_rows") - F.col("_test_rows")) * calibration)
    is_cal = ((before - F.col("_test_rows")) < cal_target) & (F.col("_rank") <= F.col("_groups") - 1)
    part = F.when(F.col("_test"), "test").when(is_cal, "calibration").otherwise("train")
    return rest.select("_group", part.alias("partition"), F.col("_size").alias("group_rows"))


def three_way_group_split(
    df: DataFrame, group: str, seed: int = 42, holdout: float = 0.2, calibration: float = 0.125
) -> DataFrame:
    """Every group lies wholly in train, calibration or test."""
    return _label(df, assign_groups(df, group, seed, holdout, calibration), group, ["partition"])


def group_calibration_split(df: DataFrame, group: str, seed: int = 42, fraction: float = 0.125) -> DataFrame:
    """Whole groups move to calibration until it holds the target rows; the rest trains."""
    groups = group_order(df, group, seed)
    held = ((F.col("cum_rows") - F.col("_size")) < _at_least_one(F.col("total_rows") * fraction)) & (
        F.col("_rank") < F.col("_groups"))
    part = F.when(held, "calibration").otherwise("train")
    return _label(df, groups.withColumn("partition", part), group, ["partition"])


def balanced_folds(df: DataFrame, group: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """(group, fold) table: groups by size descending dealt in a snake over the folds.

    The snake keeps fold sizes within the largest group of each other.
    """
    sizes = df.groupBy(F.coalesce(F.col(group).cast("string"), F.lit(MISSING_GROUP)).alias("_group")).agg(
        F.count("*").alias("group_rows"))
    scan = ordered_scan(sizes, [desc("group_rows"), asc(hash_key(seed, "_group")), asc("_group")],
                        rank="_r", total="_n")
    at = F.pmod(F.col("_r") - 1, F.lit(2 * folds))
    fold = F.when(at < folds, at).otherwise(2 * folds - 1 - at)
    enough = F.when(F.col("_n") >= folds, fold).otherwise(
        F.raise_error(F.lit("Fewer groups than folds.")).cast("long"))
    return scan.select(F.col("_group").alias(group), "group_rows", enough.cast("long").alias("fold"))


def fold_split(
    df: DataFrame, group: str, fold: int, folds: int = 5, seed: int = 42, calibration: float = 0.125
) -> DataFrame:
    """Test = one balanced fold; calibration = hash-order prefix of the other groups within its target."""
    assigned = balanced_folds(df, group, folds, seed).withColumnRenamed(group, "_group")
    rest = assigned.where(F.col("fold") != fold)
    order = ordered_scan(rest, [asc(hash_key(f"{seed}-calibration", "_group")), asc("_group")], (),
                         {"rows": F.col("group_rows")}, rank="_r", total="_n")
    fits = (F.col("_r") == 1) | (F.col("cum_rows") <= _at_least_one(F.col("total_rows") * calibration))
    parts = order.select("_group", F.when(fits & (F.col("_r") < F.col("_n")), "calibration")
                         .otherwise("train").alias("partition"))
    test = assigned.where(F.col("fold") == fold).select("_group", F.lit("test").alias("partition"))
    return _label(df, parts.unionByName(test), group, ["partition"])


def time_split(
    df: DataFrame, year: str, case_id: str, seed: int = 42, holdout: float = 0.2, calibration: float = 0.125
) -> DataFrame:
    """The last rows by year are the test set; rows without a year sort last."""
    order = [Key(F.col(year).cast("double")), asc(F.col(case_id).cast("string"))]
    early = flag_first(df, order, (), {"_early": F.col("_n") - _at_least_one(F.col("_n") * holdout)})
    rows = early.withColumn("_late", ~F.col("_early")).drop("_early")
    test = rows.where("_late").drop("_late").withColumn("partition", F.lit("test"))
    return test.unionByName(_calibrate(rows.where(~F.col("_late")).drop("_late"), case_id, seed, calibration))


def temporal_block(df: DataFrame, year: str, train_until: int = 2012, calibration_until: int = 2014) -> DataFrame:
    """Fixed year ranges; a missing year fails the job."""
    value = F.col(year).cast("int")
    part = (F.when(value <= train_until, "train").when(value <= calibration_until, "calibration")
            .when(value > calibration_until, "test")
            .otherwise(F.raise_error(F.lit("temporal block needs a year on every row"))))
    return df.withColumn("partition", part)


def class_tokens(column: Column) -> Column:
    """Trimmed tokens of a ``;``-joined class string, without the unclassified marker."""
    parts = F.transform(F.split(F.coalesce(column, F.lit("")), ";"), lambda t: F.trim(t))
    return F.filter(parts, lambda t: (t != "") & (F.lower(t) != "unclassified"))


def class_holdout_split(
    df: DataFrame, classes: str, held_out: str, case_id: str, seed: int = 42, calibration: float = 0.125
) -> DataFrame:
    """All rows carrying the class token are the test set, also those with further classes."""
    flagged = df.withColumn("_test", F.array_contains(class_tokens(F.col(classes)), held_out))
    test = flagged.where("_test").drop("_test").withColumn("partition", F.lit("test"))
    return test.unionByName(_calibrate(flagged.where(~F.col("_test")).drop("_test"), case_id, seed, calibration))


def named_class_for_seed(seed: int, classes: Sequence[str], offset: int = 40) -> str:
    return classes[(int(seed) - offset) % len(classes)]


def fallback_group(group: str, entity: str, prefix: str = "acyclic::") -> Column:
    """Group key where rows without a group become their own entity's group."""
    key = F.trim(F.col(group).cast("string"))
    return F.when(key.isNull() | (key == ""), F.concat(F.lit(prefix), F.col(entity).cast("string"))).otherwise(key)


def adaptation_draw(df: DataFrame, group: str, n_rows: int, seed: int = 42) -> DataFrame:
    """Whole groups in hash order until at least ``n_rows`` rows adapt; the rest evaluates."""
    groups = group_order(df, group, seed)
    adapt = ((F.col("cum_rows") - F.col("_size")) < n_rows) & (F.col("cum_rows") < F.col("total_rows"))
    role = F.when(adapt, "adaptation").otherwise("evaluation")
    return _label(df, groups.withColumn("role", role), group, ["role"])


def repeated_draws(entities: DataFrame, entity: str, repeats: int, size: int, seed: int = 42) -> DataFrame:
    """``size`` entities without replacement in every repeat; the others are its evaluation set."""
    numbers = F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")

    def order(text: Column) -> list[Key]:
        return [asc(hash_key(F.concat(F.lit(f"{seed}-"), F.col("repeat").cast("string")), text)), asc(text)]
    text = F.col(entity).cast("string")
    named = entities.select(text.alias("_text"), numbers)
    if size <= FEW_DRAWN:
        # each task keeps the first ``size`` rows of a repeat, so only they are moved
        keyed = named.select("repeat", *[k.expr.alias(f"_key{i}") for i, k in enumerate(order(F.col("_text")))])
        place = F.row_number().over(Window.partitionBy("repeat").orderBy(F.col("_key0").asc_nulls_last(), F.col("_key1").asc_nulls_last()))
        first = keyed.withColumn("_r", place).where(F.col("_r") <= size)
        cuts = first.groupBy("repeat").agg(F.max_by(F.struct("_key0", "_key1"), "_r").alias("_last"))
    else:
        cuts = cut_offs(named, order(F.col("_text")), ["repeat"], {"_last": F.least(F.col("_n"), F.lit(size))}).drop("_n")
    copies = attach_small(entities.select("*", numbers), cuts, ["repeat"])
    keys = [k.expr.alias(f"_own{i}") for i, k in enumerate(order(text))]
    drawn = not_after([asc("_own0"), asc("_own1")], "_last")
    return copies.select("*", *keys).withColumn("role", F.when(drawn, "development").otherwise("evaluation")).drop("_last", "_own0", "_own1")


def partition_purity(df: DataFrame, group: str) -> DataFrame:
    """Rows, groups and the number of groups straddling partitions, per partition."""
    per = df.groupBy(group, "partition").agg(F.count("*").alias("_rows"))
    spread = per.groupBy(group).agg(F.count("*").alias("_parts"))
    return per.join(spread, group, "left").groupBy("partition").agg(
        F.sum("_rows").alias("n_rows"), F.count("*").alias("n_groups"),
        F.count_if(F.col("_parts") > 1).alias("n_straddling_groups"))


def permute_target(df: DataFrame, target: str, case_id: str, seed: int = 42) -> DataFrame:
    """Negative control: the target column in another hash order, row by row.

    Case ids are there for the order of the values, which are written and joined without them.
    """
    rows = ordered_scan(df.drop(target), [asc(F.col(case_id).cast("string"))], rank="_r")
    values = ordered_scan(df.select(case_id, F.col(target)),
                          [asc(hash_key(seed, case_id)), asc(F.col(case_id).cast("string"))], rank="_r", keep=[target])
    return rows.drop("panel_rows").join(values.select("_r", target), "_r").drop("_r")
