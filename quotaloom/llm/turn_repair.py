"""Repair of the turn structure of conversations by Knuth's lightest derivation.

Repaired roles have the form (s?(ua)+)?.  An item (i, state) stands for rows i and after being repaired when the output so far is in
``state``; edits are deductions of one item from another:

    Keep    (i, q) <- (i + 1, q')   0, or 3 for a truncated row
    Rerole  (i, q) <- (i + 1, q')   3, and 3 more for a truncated row
    Delete  (i, q) <- (i + 1, q)    4
    Insert  (i, q) <- (i, q')       3

where q' follows q by the role that is put out.  The agenda pops items by (cost, audit): audits are ordered by the rows that they
cover and then as text.  Each deduction raises that pair and none changes the order of two, so the first time an item is popped its
derivation is final.  From a state each edit leads to one state only, so the audit of an item is its edit before the audit of
another item and is kept as a link.

Rows are range partitioned by conversation and turn and read in order.  A conversation inside one partition is done there.  What may
go on in another partition, and every conversation of more than BLOCK_ROWS rows or BLOCK_BYTES, is cut into blocks: the lightest
derivations of a block between each pair of states are its edges in a hypergraph over blocks, in which costs are carried from the
last block to the first and audits and repaired texts from the first to the last.  So a task holds one block at a time.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotaloom.session import materialize, shuffle_width

#: rows and bytes of text that close a block (a longer text is a block of its own)
BLOCK_ROWS = 4096
BLOCK_BYTES = 8 << 20
SPACES = "\t\n\x0b\x0c\r "
#: states of the output: nothing, after s, after u, after a
START, S, U, A = range(4)
#: the role that may be put out by Rerole or Insert in a state, and the state after it
NEXT = {START: ("user", U), S: ("user", U), U: ("assistant", A), A: ("user", U)}
KEEPS = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
INFINITE = 1 << 60
#: where a conversation may end
GOAL = (0, INFINITE, INFINITE, 0)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ORDERED = {"su", "ua", "au"}


def lightest(rows: Sequence[tuple[str, str]], tail: Sequence[int]) -> tuple[list[list[int]], list[list[str]]]:
    """Cost and first edit of the lightest derivation of every item.

    ``rows`` are (role initial, fault) with the fault blank, duplicate, truncated or empty; ``tail`` gives for each state what
    the rest costs after these rows.
    """
    n = len(rows)
    cost = [[INFINITE] * 4 for _ in range(n + 1)]
    edit = [[""] * 4 for _ in range(n + 1)]
    done = [[False] * 4 for _ in range(n + 1)]
    agenda = [(c, 0, "", n, q) for q, c in enumerate(tail) if c < INFINITE]
    heapq.heapify(agenda)
    before = {q2: [q for q in NEXT if NEXT[q][1] == q2] for q2 in range(4)}
    kept_from = {(q2, role): [q for (q, r), t in KEEPS.items() if t == q2 and r == role] for q2 in range(4) for role in "sua"}
    while agenda:
        c, covered, letter, i, q = heapq.heappop(agenda)
        if done[i][q]:
            continue
        done[i][q], cost[i][q], edit[i][q] = True, c, letter
        for p in before[q]:
            if not done[i][p]:
                heapq.heappush(agenda, (c + INSERT, covered, "I", i, p))
        if i == 0:
            continue
        role, fault = rows[i - 1]
        if not done[i - 1][q]:
            heapq.heappush(agenda, (c + DELETE, covered + 1, "D", i - 1, q))
        if fault in ("blank", "duplicate"):
            continue
        more = TRUNCATED if fault == "truncated" else 0
        for p in before[q]:
            if not done[i - 1][p]:
                heapq.heappush(agenda, (c + REROLE + more, covered + 1, "R", i - 1, p))
        for p in kept_from.get((q, role), ()):
            if not done[i - 1][p]:
                heapq.heappush(agenda, (c + KEEP + more, covered + 1, "K", i - 1, p))
    return cost, edit


def follow(rows: Sequence[tuple[str, str]], edit: list[list[str]], state: int) -> tuple[str, int]:
    """The audit of rows entered in a state, and the state in which it leaves them."""
    audit, i = [], 0
    while letter := edit[i][state]:
        audit.append(letter)
        if letter in "RI":
            state = NEXT[state][1]
        elif letter == "K":
            state = KEEPS[state, rows[i][0]]
        i += letter != "I"
    return "".join(audit), state


def repaired(roles: Sequence[str], texts: Sequence[str], audit: str, state: int) -> Iterator[str]:
    """``role:text`` of the rows that an audit leaves."""
    i = 0
    for letter in audit:
        role, after = NEXT[state]
        if letter == "I":
            yield f"{role}:"
            state = after
            continue
        if letter == "R":
            yield f"{role}:{texts[i]}"
            state = after
        elif letter == "K":
            yield f"{roles[i]}:{texts[i]}"
            state = KEEPS[state, roles[i][:1]]
        i += 1


def faults(roles: Sequence[str], texts: Sequence[str], earlier: Iterable[bytes] = ()) -> list[tuple[str, str]]:
    """(role initial, fault) of each row; ``earlier`` are the digests of rows in blocks before."""
    seen, out = set(earlier), []
    for role, text in zip(roles, texts):
        key, words = digest_of(role, text), text.rstrip(SPACES)
        again = key in seen
        seen.add(key)
        out.append((role[:1], "blank" if not words else "duplicate" if again else "truncated" if words[-1] not in ".!?" else ""))
    return out


def digest_of(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULT_SCHEMA = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                           ("audit", pa.string()), ("repaired_sha256", pa.string())])
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("turns", pa.list_(pa.int64())),
                          ("digests", pa.list_(pa.binary()))])
READ = RESULT + ", block long, roles array<string>, texts array<string>, turns array<long>, digests array<binary>"
READ_SCHEMA = pa.schema([*RESULT_SCHEMA, *BLOCK_SCHEMA])


class Tally:
    """What is counted over the rows of one conversation, block by block."""

    def __init__(self) -> None:
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal, self.last_role = 0, None
        self.first_turn = self.last_turn = None
        self.turns, self.state, self.cost = 0, START, 0
        self.audit: list[str] = []
        self.text, self.any = hashlib.sha256(), False

    def add(self, rows: Sequence[tuple[str, str]], roles: Sequence[str], texts: Sequence[str], turns: Sequence[int | None], audit: str, leaves: int) -> None:
        for (role, fault) in rows:
            self.counts[fault] += 1
            if self.last_role is not None and self.last_role + role not in ORDERED:
                self.illegal += 1
            self.last_role = role
        for turn in turns:
            if turn is not None and turn != self.last_turn:
                self.turns, self.last_turn = self.turns + 1, turn
                self.first_turn = turn if self.first_turn is None else self.first_turn
        for line in repaired(roles, texts, audit, self.state):
            self.text.update((("\n" if self.any else "") + line).encode("utf-8", "surrogatepass"))
            self.any = True
        self.audit.append(audit)
        self.state = leaves

    def result(self, conv_id: int | None, cost: int) -> dict[str, Any]:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return {"conv_id": conv_id, "gaps": gaps, "blank": self.counts["blank"], "duplicate": self.counts["duplicate"],
                "truncated": self.counts["truncated"], "illegal": self.illegal, "cost": cost, "audit": "".join(self.audit),
                "repaired_sha256": self.text.hexdigest()}


def repair_whole(conv_id: int | None, roles: Sequence[str], texts: Sequence[str], turns: Sequence[int | None]) -> dict[str, Any]:
    rows, tally = faults(roles, texts), Tally()
    cost, edit = lightest(rows, GOAL)
    tally.add(rows, roles, texts, turns, *follow(rows, edit, START))
    return tally.result(conv_id, cost[0][START])


class Run:
    """Consecutive rows of one conversation while a partition is read."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.cut = conv_id, False
        self.clear()

    def clear(self) -> None:
        self.roles, self.texts, self.turns, self.bytes = [], [], [], 0

    def add(self, role: str, text: str, turn: int | None, copies: int) -> None:
        self.roles += [role] * copies
        self.texts += [text] * copies
        self.turns += [turn] * copies
        self.bytes += (len(text) + len(role)) * copies


def read_runs(block_rows: int, block_bytes: int) -> Any:
    """Reads a partition in order: results of conversations that lie inside it, blocks of all others."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        run, first, out, held = None, True, [], 0

        def block(run: Run) -> dict[str, Any]:
            nonlocal number
            number += 1
            row = {"conv_id": run.conv_id, "block": number, "roles": run.roles, "texts": run.texts, "turns": run.turns,
                   "digests": [digest_of(r, t) for r, t in zip(run.roles, run.texts)]}
            run.clear()
            return row

        def close(run: Run, edge: bool) -> dict[str, Any]:
            return block(run) if edge or run.cut else repair_whole(run.conv_id, run.roles, run.texts, run.turns)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "turn", "copies")]
            for conv_id, role, text, turn, copies in zip(*columns):
                if run is None or run.conv_id != conv_id:
                    if run is not None:
                        out.append(close(run, first))
                        first = False
                    run = Run(conv_id)
                if run.roles and (len(run.roles) + copies > block_rows or run.bytes + len(text) > block_bytes):
                    run.cut, held = True, held + run.bytes
                    out.append(block(run))
                run.add(role, text, turn, copies)
                if len(out) >= 1000 or held >= block_bytes:
                    yield pa.RecordBatch.from_pylist(out, schema=READ_SCHEMA)
                    out, held = [], 0
        if run is not None:
            out.append(close(run, True))
        yield pa.RecordBatch.from_pylist(out, schema=READ_SCHEMA)
    return read


def block_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, block, edges): the cost of a block from each state (rows) to each state (columns), row after row."""
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("edges", pa.list_(pa.int64()))])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            rows = faults(row["roles"], row["texts"], row["earlier"] or ())
            ends = [lightest(rows, [0 if q == end else INFINITE for q in range(4)])[0][0] for end in range(4)]
            out.append({"conv_id": row["conv_id"], "block": row["block"], "edges": [ends[e][q] for q in range(4) for e in range(4)]})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def carry_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, tail): what everything after a block costs for each state in which it is left; blocks come last to first."""
    schema = pa.schema([("block", pa.int64()), ("tail", pa.list_(pa.int64()))])
    conv, tail, known = None, list(GOAL), False
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if not known or row["conv_id"] != conv:
                conv, known = row["conv_id"], True
                # a conversation may also end after what is inserted behind its last row
                tail = lightest([], GOAL)[0][0]
            out.append({"block": row["block"], "tail": tail})
            edges = row["edges"]
            tail = [min(edges[4 * q + e] + tail[e] for e in range(4)) for q in range(4)]
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def carry_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that are made of blocks, which come first to last."""
    conv, tally, total = None, None, 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if tally is None or row["conv_id"] != conv:
                if tally is not None:
                    out.append(tally.result(conv, total))
                conv, tally, total = row["conv_id"], Tally(), None
            rows = faults(row["roles"], row["texts"], row["earlier"] or ())
            last = row["last"]
            cost, edit = lightest(rows, GOAL if last else row["tail"])
            total = cost[0][tally.state] if total is None else total
            tally.add(rows, row["roles"], row["texts"], row["turns"], *follow(rows, edit, tally.state))
        yield pa.RecordBatch.from_pylist(out, schema=RESULT_SCHEMA)
    if tally is not None:
        yield pa.RecordBatch.from_pylist([tally.result(conv, total)], schema=RESULT_SCHEMA)


def join_blocks(blocks: DataFrame) -> DataFrame:
    """Results of conversations cut into blocks."""
    width = shuffle_width(blocks.sparkSession)
    # a row is a duplicate also of one in a block before; each block names a digest once
    named = blocks.select("conv_id", "block", F.explode(F.array_distinct("digests")).alias("digest"))
    first = F.min("block").over(Window.partitionBy("conv_id", "digest"))
    again = named.withColumn("first", first).where("block > first").groupBy("block").agg(F.collect_set("digest").alias("earlier"))
    known = blocks.drop("digests").join(again, "block", "left")
    edges = materialize(known.select("conv_id", "block", "roles", "texts", "earlier").mapInArrow(block_edges, "conv_id long, block long, edges array<long>"))
    back = edges.repartition(width, "conv_id").sortWithinPartitions("conv_id", F.col("block").desc())
    tails = back.mapInArrow(carry_back, "block long, tail array<long>")
    ends = edges.groupBy("conv_id").agg(F.max("block").alias("block")).select("block", F.lit(True).alias("last"))
    on = known.join(tails, "block").join(ends, "block", "left").repartition(width, "conv_id").sortWithinPartitions("conv_id", "block")
    return on.select("conv_id", "block", "roles", "texts", "turns", "earlier", "tail", F.coalesce("last", F.lit(False)).alias("last")).mapInArrow(carry_on, RESULT)


def repair(rows: DataFrame, copies: Column | None = None, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id of ``rows``.

    ``rows`` has conv_id, turn, role and text; ``copies`` says how often a row occurs (once if not given), and a conversation of rows
    that don't occur has zeros and an empty audit.  Null turns come first; rows of one turn are ordered by role and by the SHA-256 of
    their text.  A null role or text is one space; a null conv_id is a conversation too.  A row whose role starts with none of
    s, u, a can't be kept.  Other columns, whatever their names, aren't read.  An empty table gives no rows.
    """
    space = F.lit(" ")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
                       F.coalesce("text", space).alias("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"))
    # the last key parts equal rows, which may stand in any order
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text_key"]
    rows = rows.withColumn("text_key", F.sha2("text", 256)).withColumn("row_key", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(shuffle_width(rows.sparkSession), *keys, "row_key").sortWithinPartitions(*keys)
    read = materialize(ranged.select("conv_id", "role", "text", "turn", "copies").mapInArrow(read_runs(block_rows, block_bytes), READ))
    result = [c.split()[0] for c in RESULT.split(", ")]
    whole = read.where("block is null").select(*result)
    return whole.unionByName(join_blocks(read.where("block is not null").select("conv_id", "block", "roles", "texts", "turns", "digests")))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, drawn by crc32(conv_id:turn) % 20, and how often each occurs (``copies``).

    0 drops a row, 1 empties its text, 2 takes its sentence marks, 3 repeats it, 4 makes it the user's; nulls are read as one space.
    """
    space = F.lit(" ")
    draw = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.coalesce("text", space)
    return conversations.select(
        "conv_id", "turn", F.when(draw == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(draw <= 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("copies"))
