"""Mixing, the conversation trie and turn repair against brute force; nulls, repeated rows, empty tables, hot conversations, clashes."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quotaloom.llm import mixing, prefix_trie, turn_repair

DOCS = "doc_id long, text string, source string, size string, target string, mix_key string, _panel string"
TURNS = "conv_id long, turn long, role string, text string, prefix string, depth string, copies string, block string"


def words(n):
    return " ".join("w" * (1 + k % 5) for k in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "x", "x", "x") for i, t, s in rows], DOCS)


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], TURNS)


# ------------------------------------------------------------------ op11

def poured(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """Targets by clamping and sharing out again until no source is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        if not free:
            return {s: epochs * sizes[s] for s in order}
        level = (total - sum(epochs * sizes[s] for s in full)) / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > epochs * sizes[s]}
        if not above:
            return {s: epochs * sizes[s] if s in full else level * weight[s] for s in order}
        full |= above


@pytest.mark.parametrize("seed", range(3))
def test_targets_are_poured_and_sources_come_near_them(spark, seed):
    rng = random.Random(seed)
    rows = [(k, words(rng.choice([0, 1, 3, 30, 80])), rng.choice(["a", "b", "Z", "é", "zz", "\U0001f600", "￮", None])) for k in range(400)]
    rows += [(1000 + k, words(3), f"tiny{k}") for k in range(9)]
    got = mixing.mix(docs(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    goal, taken = poured(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 40 for s in goal)
    assert sum(goal.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_of_null_empty_repeated_and_very_long_texts(spark):
    rows = [(1, None, "a"), (1, "", "a"), (None, " \t\x0b", None), (2, "x y \x85z\x1c", "b"), (3, words(200_000), "b"), (4, "a b", "c"), (4, "a b", "c"), (4, "a b", "c")]
    table = docs(spark, rows)
    got = sorted(map(tuple, mixing.mix(table).collect()), key=repr)
    assert got == sorted(map(tuple, mixing.mix(table.repartition(3)).collect()), key=repr)
    by = defaultdict(list)
    for r in mixing.mix(table).collect():
        by[r.doc_id].append(r)
    assert [r.size for r in by[2]] == [2] and [r.size for r in by[None]] == [0] and {r.taken for r in by[1]} == {0}
    assert all(r.target == 12 and r.taken == 4 for r in by[4])
    assert mixing.mix(docs(spark, [])).count() == 0
    assert {r.target for r in mixing.mix(docs(spark, [(1, None, None), (2, " ", "b")])).collect()} == {0.0}


def test_mix_rows_follow_the_counts(spark):
    table = docs(spark, [(k, words(k), "ab"[k % 2]) for k in range(40)])
    mixed = mixing.mix(table)
    assert mixing.repeated(table, mixed).count() == mixed.agg(F.sum("repeats")).first()[0]
    with pytest.raises(ValueError):
        mixing.mix(table, weights=(1, 0))


# ------------------------------------------------------------------ op12

def md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest()


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, md5(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(int(c / 100) * 100, [])[:h] + mine[h:]  # % of a negative id as in SQL
    return out


def brute_trie(rows):
    convs, nodes = rebuilt(rows), defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    kids = defaultdict(list)
    for node in nodes:
        if node:
            kids[node[:-1]].append(node)
    out = []
    for node, members in nodes.items():
        below, stack = [], [node]
        while stack:
            below.append(stack.pop())
            stack += kids[below[-1]]
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(node))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(kids[node]), sum(not kids[x] for x in below),
                    sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(rng, n, longest):
    rows = []
    for c in rng.sample(range(-300, 700), n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b.", "a", "", None, "\U0001f600é"])))
    return rows


@pytest.mark.parametrize(("seed", "hot_rows"), [(1, 1_000_000), (2, 1_000_000), (3, 4), (4, 0)])
def test_trie_is_brute_force(spark, seed, hot_rows):
    rows = conversations(random.Random(seed), 150, 9)
    rows += [(None, 1, "user", "nobody's")] + [(600 + k, t, "user", "same") for k in range(30) for t in range(1 + k % 3)]
    got = prefix_trie.build(turns(spark, rows), hot_rows).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)


def test_trie_lists_of_many_members_and_a_long_text(spark):
    rows = [(k << 15, 0, "user", "hello") for k in range(40)] + [(7, 0, "user", "x" * 300_000)]
    got = prefix_trie.build(turns(spark, rows)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)
    assert prefix_trie.build(turns(spark, [])).count() == 0


# ------------------------------------------------------------------ op13

def brute_repair(rows):
    """All edit sequences in order of cost and text, by rows already in order: (role, text)."""
    seen, kinds = set(), []
    for role, text in rows:
        body = text.strip("\t\n\x0b\x0c\r ")
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = (10 ** 9, "", [])

    def go(i, initials, cost, audit, out, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials) and (cost, audit) < best[:2]:
            best = (cost, audit, list(out))
        if inserted < 2:
            for role in ("user", "assistant"):
                if re.fullmatch("s?(ua)*u?", initials + role[0]):
                    go(i, initials + role[0], cost + 3, audit + "I", out + [f"{role}:"], inserted + 1)
        if i == len(rows):
            return
        role, text = rows[i]
        go(i + 1, initials, cost + 4, audit + "D", out, 0)
        if kinds[i] in ("blank", "duplicate"):
            return
        more = 3 * (kinds[i] == "truncated")
        if role and re.fullmatch("s?(ua)*u?", initials + role[0]):
            go(i + 1, initials + role[0], cost + more, audit + "K", out + [f"{role}:{text}"], 0)
        for other in ("user", "assistant"):
            if re.fullmatch("s?(ua)*u?", initials + other[0]):
                go(i + 1, initials + other[0], cost + 3 + more, audit + "R", out + [f"{other}:{text}"], 0)
    go(0, "", 0, "", [], 0)
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(rows)]
    return (kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1],
            hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


def brute_all(rows, copies=lambda r: 1):
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(r)
    out = {}
    for c, mine in convs.items():
        role, text = (lambda r: " " if r[2] is None else r[2]), (lambda r: " " if r[3] is None else r[3])
        mine = sorted(mine, key=lambda r: (r[1] is not None, r[1] or 0, role(r), hashlib.sha256(text(r).encode()).hexdigest()))
        mine = [r for r in mine for _ in range(copies(r))]
        known = [r[1] for r in mine if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[c] = (gaps, *brute_repair([(role(r), text(r)) for r in mine]))
    return out


def messy(rng, n, longest):
    return [(rng.choice([c, c, c, None]) if c == 0 else c, rng.choice([t, t, t + 3, None]),
             rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "agent"]),
             rng.choice(["a.", "b!", f"c{t}?", f"d{t}.\n", "cut", "  ", "", None, f"e{t} ; "])) for c in range(n) for t in range(rng.randrange(longest))]


@pytest.mark.parametrize(("seed", "block_rows"), [(1, 4096), (2, 4096), (3, 2), (4, 1), (5, 3)])
def test_repair_is_brute_force(spark, seed, block_rows):
    rows = messy(random.Random(seed), 60, 7)
    got = turn_repair.repair(turns(spark, rows), block_rows=block_rows)
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == brute_all(rows)


def test_block_joins_equal_one_agenda(spark):
    rng = random.Random(9)
    rows = [(5, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["x.", f"{t}!", "cut", "", f"{t % 50}?"])) for t in range(900)]
    rows += [(c, t, "ua"[t % 2], f"{t}.") for c in range(20) for t in range(4) if c != 5]
    whole = {r.conv_id: tuple(r) for r in turn_repair.repair(turns(spark, rows).coalesce(1)).collect()}
    cut = {r.conv_id: tuple(r) for r in turn_repair.repair(turns(spark, rows), block_rows=37, block_bytes=500).collect()}
    assert whole == cut and len(whole[5][7]) > 500


def test_repair_of_damaged_repeated_and_long_rows(spark):
    rng = random.Random(6)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{rng.choice('abc')} {t}.") for c in range(80) for t in range(rng.randrange(1, 6))]
    rows += [(900, 1, "user", "again.")] * 3 + [(901, None, None, None), (902, 0, "user", "y" * 300_000 + "!"), (902, 1, "assistant", "ok.")]

    def draw(r):
        return zlib.crc32(f"{' ' if r[0] is None else r[0]}:{' ' if r[1] is None else r[1]}".encode()) % 20

    def hurt(r):
        z, text = draw(r), " " if r[3] is None else r[3]
        return (r[0], r[1], "user" if z == 4 else r[2], "" if z <= 1 else re.sub("[.!?]", "", text) if z == 2 else text)
    got = turn_repair.repair(turn_repair.damage(turns(spark, rows)), F.col("copies"))
    copies = {(r[0], r[1]): {0: 0, 3: 2}.get(draw(r), 1) for r in rows}
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == brute_all([hurt(r) for r in rows], lambda r: copies[r[0], r[1]])
    assert turn_repair.repair(turns(spark, [])).count() == 0
