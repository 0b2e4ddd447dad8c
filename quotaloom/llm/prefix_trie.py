"""The prefix trie of conversations, from whole sequences.

Identical conversations collapse into one sequence with a weight and a list of those that end in it; a sequence that is a proper
prefix of another is no leaf (an anti-join); every node is then a sum over the weighted sequences that pass through it.

A prefix is named by a hash that adds up: the sum, over its turns, of the digests of (place, role and text).  So the names of all
prefixes of a conversation are running sums, also of one that is spread over many tasks.  Texts never move, only their digests.

What a subtree holds is a sum over sequences too.  Each node is owned by the sequence with the smallest member passing through it;
a sequence owns the end of its path, from some depth on, so the texts of the nodes below a node, each counted once, are the
owned ends of the paths through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotaloom.operators.scan import HOT_GROUP_ROWS, asc, hot_groups, ordered_scan
from quotaloom.session import materialize

LIMBS = ("p0", "p1", "p2", "p3")
#: members listed in one row; the lists of a sequence are hashed one after the other
LIST_BITS = 16
#: a key that has more than one row in so many is common; there are fewer such keys than this
HOT_SHARE = 1000


def _limbs(digest: Column) -> list[Column]:
    """Four 32-bit numbers of a hexadecimal digest."""
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _placed(rows: DataFrame, hot_rows: int) -> DataFrame:
    """Turns of rebuilt conversations with their depth; a conversation without any keeps one row of depth 0.

    ``rows``: conv_id, hub (whether the turn comes from the hub), turn, digest, size and skip.
    """
    order = [asc(~F.col("hub")), asc(F.col("turn").isNotNull()), asc("turn"), asc("digest"), asc(F.monotonically_increasing_id())]
    hub = F.col("hub").cast("long")
    columns = ["conv_id", "hub", "digest", "size", "skip"]

    def numbered(part: DataFrame, hot: bool) -> DataFrame:
        if hot:
            return ordered_scan(part, order, ["conv_id"], {"hub": hub}, rank="at", total="n").select(*columns, "at", "n", "total_hub")
        one = Window.partitionBy("conv_id")
        within = one.orderBy(~F.col("hub"), F.col("turn").asc_nulls_first(), "digest")
        return part.select(*columns, F.row_number().over(within).alias("at"), F.count("*").over(one).alias("n"), F.sum(hub).over(one).alias("total_hub"))

    def summed(part: DataFrame, hot: bool) -> DataFrame:
        own = F.col("at") - F.col("total_hub")
        turns = F.col("total_hub") + F.greatest(F.col("n") - F.col("total_hub") - F.col("skip"), F.lit(0))
        depth = F.when(F.col("hub"), F.col("at")).when(own > F.col("skip"), F.col("at") - F.col("skip"))
        part = part.select("*", turns.cast("long").alias("n_turns"), depth.cast("long").alias("depth")).where(
            F.col("depth").isNotNull() | ((F.col("n_turns") == 0) & (F.col("at") == 1)))
        part = part.withColumn("depth", F.coalesce("depth", F.lit(0))).withColumn("size", F.when(F.col("depth") > 0, F.col("size")).otherwise(0))
        named = F.md5(F.concat_ws(":", F.col("depth").cast("string"), F.lower(F.hex("digest"))))
        part = part.select("conv_id", "depth", "n_turns", "size", *[
            F.when(F.col("depth") > 0, x).otherwise(0).alias(p) for p, x in zip(LIMBS, _limbs(named))])
        if hot:
            return ordered_scan(part, [asc("depth")], ["conv_id"], {c: F.col(c) for c in ("size", *LIMBS)}).select(
                "conv_id", "depth", "n_turns", "size", "cum_size", *[f"cum_{p}" for p in LIMBS])
        upto = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
        return part.select("conv_id", "depth", "n_turns", "size", *[F.sum(c).over(upto).alias(f"cum_{c}") for c in ("size", *LIMBS)])

    def paths(part: DataFrame, hot: bool) -> DataFrame:
        out = summed(numbered(part, hot), hot)
        return out.select("conv_id", "depth", "n_turns", (F.col("cum_size") - F.col("size")).alias("before"),
                          F.col("cum_size").alias("upto"), prefix_name("depth", *[f"cum_{p}" for p in LIMBS]).alias("prefix"))

    hot = hot_groups(rows, ["conv_id"], hot_rows)
    if hot is None:
        return paths(rows, False)
    return paths(rows.join(hot, "conv_id", "left_anti"), False).unionByName(paths(rows.join(hot, "conv_id", "left_semi"), True))


def prefix_name(*sums: str) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in sums])))


def rebuild(conversations: DataFrame, hub: Column, skip: Column, most: int, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """One row for each turn of each rebuilt conversation: conv_id, depth, n_turns, before, upto (sizes), prefix (its name).

    A conversation starts with the first ``skip`` (at most ``most``) original turns of the conversation ``hub`` and goes on with
    its own turns after its first ``skip``; both are columns made of conv_id.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = materialize(conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text))).alias("digest"), F.char_length(text).cast("long").alias("size")))
    first = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    # only so many rows of each hub leave a task, however long the hub is
    opening = narrow.where(F.col("conv_id") == hub).withColumn("no", F.row_number().over(first)).where(F.col("no") <= most)
    opening = opening.select(F.col("conv_id").alias("hub_id"), "no", "digest", "size")
    known = narrow.select("conv_id").distinct().select("conv_id", hub.alias("hub_id"), skip.alias("skip"))
    given = known.join(opening, "hub_id").where("no <= skip").select(
        "conv_id", F.lit(True).alias("hub"), F.col("no").cast("long").alias("turn"), "digest", "size", "skip")
    own = narrow.select("conv_id", F.lit(False).alias("hub"), "turn", "digest", "size", skip.alias("skip"))
    return _placed(own.unionByName(given), hot_rows)


def _ends(ends: DataFrame) -> DataFrame:
    """(prefix, ends_sha256): SHA-256 of the members that end in a sequence, ascending, joined by commas.

    Members are listed by stretches of 2^16 ids; a task reads the lists of a sequence in order and holds one at a time.
    """
    lists = ends.groupBy("prefix", F.shiftright("conv_id", LIST_BITS).alias("stretch")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            names, out = [], []
            for prefix, ids in zip(batch.column("prefix").to_pylist(), batch.column("ids").to_pylist()):
                if prefix == last:
                    state.update(b",")
                else:
                    if last is not None:
                        names.append(last)
                        out.append(state.hexdigest())
                    last, state = prefix, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(out, pa.string())], ["prefix", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["prefix", "ends_sha256"])

    sorted_lists = lists.repartition("prefix").sortWithinPartitions("prefix", "stretch").select("prefix", "ids")
    return sorted_lists.mapInArrow(digests, "prefix binary, ends_sha256 string")


def _owners(above: DataFrame, owners: DataFrame) -> DataFrame:
    """``above`` with the owner of each ``up``.  An ``up`` that more than a thousandth of all rows share is one of under
    HOT_SHARE, so these few owners are sent to the rows instead."""
    above = materialize(above)
    total = above.agg(F.count("*").alias("total")).select("total").scalar()
    common = above.groupBy("up").agg(F.count("*").alias("often")).where(F.col("often") * HOT_SHARE > total)
    sent = above.join(F.broadcast(materialize(owners.join(common.select("up"), "up"))), "up", "left")
    rest = sent.where("owner is null").drop("owner").join(owners, "up")
    return sent.where("owner is not null").unionByName(rest)


def trie(paths: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = materialize(paths)
    ends = paths.where("depth = n_turns")
    sequences = materialize(ends.groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.max("upto").alias("whole")))
    root = F.col("depth") == 1
    start = prefix_name("depth", *["before"] * len(LIMBS))

    def through(marked: DataFrame) -> DataFrame:
        """Paths of whole sequences, the root included, with what is known of the sequence."""
        steps = paths.join(marked, "conv_id")
        roots = steps.where(root).withColumn("depth", F.lit(0).cast("long")).withColumn("upto", F.col("before")).withColumn("prefix", start)
        return steps.unionByName(roots)

    nodes = materialize(through(sequences.select("conv_id")).groupBy("prefix").agg(
        F.min("conv_id").alias("owner"), F.min("depth").alias("depth"), F.min("before").alias("before"),
        F.max(F.col("depth") < F.col("n_turns")).alias("inner")))
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("owns_from"), F.min("before").alias("owns_before"))
    leaves = sequences.join(nodes.where("inner").select("prefix"), "prefix", "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    marked = materialize(sequences.drop("prefix").join(owned, "conv_id", "left").join(leaves, "conv_id", "left"))

    owns = F.col("owns_from").isNotNull()
    steps = through(marked)
    once = F.when(owns, F.col("whole") - F.greatest("before", "owns_before")).otherwise(0)
    child = owns & (F.col("depth") < F.col("n_turns")) & (F.col("depth") + 1 >= F.col("owns_from"))
    sums = steps.groupBy("prefix").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.sum("weight").alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"),
        (F.sum(F.col("weight") * (F.col("whole") - F.col("before"))) - F.sum(once)).alias("saved_tokens"))
    # where a path leaves another owner's: the first node that it owns, and the owner of the node above
    tops = steps.where("depth = owns_from").select("conv_id", "prefix")
    above = steps.where("depth = owns_from - 1").select("conv_id", F.col("prefix").alias("up"))
    joints = _owners(above, nodes.select(F.col("prefix").alias("up"), "owner")).join(tops, "conv_id").select("prefix", F.col("owner").alias("parent"))
    out = sums.join(joints, "prefix", "left").join(_ends(ends.select("prefix", "conv_id")), "prefix", "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))


def build(conversations: DataFrame, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """The trie of rebuilt conversations, see rebuild(): the hub of c is c - c % 100, and crc32(c) % 6 turns come from it.

    A null role or text is empty and null turns come first; rows of one turn are ordered by the digest of role and text, so repeated
    rows are turns of their own.  Rows without a conv_id belong to no conversation.  Conversations of more than ``hot_rows`` rows
    are numbered in ranges over many tasks.  Other columns, whatever their names, aren't read.  An empty table has no root.
    """
    named = conversations.select("conv_id", "turn", "role", "text")
    conv = F.col("conv_id").cast("long")
    return trie(rebuild(named, conv - conv % 100, (F.crc32(conv.cast("string")) % 6).cast("int"), 5, hot_rows))
