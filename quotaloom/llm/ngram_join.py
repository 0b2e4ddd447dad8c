"""Jaccard join of documents on word n-grams: a prefix-tree join behind a document-frequency prefix filter.

1. Every chunk numbers its words, builds each document's set of n-gram hashes (64 bits) and the set's digest; equal sets
   are one class from here on.
2. n-grams' frequencies are added up over all chunks, in packed messages of the leading 40 bits of their hashes (a clash
   only makes an n-gram seem more frequent).  That fixes one global order, rare n-grams first.
3. Two sets as similar as asked share an n-gram among the first |x| - ceil(t |x|) + 1 of each.  Of those n-grams the ones
   that a single class has lead nowhere; n-grams with equal lists of classes are kept once.
4. The classes that share such an n-gram meet in one group, with their whole sets.  A group stores its sets in a prefix
   tree and looks each of them up: a shared path is intersected once for all sets below it, and a subtree is left out
   when the overlap so far and what remains cannot reach the bound.  Sets that are connected already are not compared,
   so a group of copies gives links in proportion to its members and no pairs are listed.
5. There are two rounds.  In the first each class is in its largest group only; in the second groups that are connected by
   now are left out, and the others compare what is not in their main component with all they have, so that no link is
   lost.  Groups of more than BLOCK n-grams are dealt into blocks, which in the first round share a few pivots.
6. Components of the links, named by their smallest document.

Null and empty texts (and those without words) have an empty set, link with nothing and are their own component, with a
null id for a null id.  Texts of fewer words than n are one n-gram.  Repeated rows each give a row; rows with a null id
link like others but never name a component unless all of it is null.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaloom.llm import common
from quotaloom.operators.setops import components

#: n-grams of the sets that one task compares with each other at once
BLOCK = 1_000_000
PIVOTS = 8
KEY_BITS = 40
FOUND = "kind string, chunk long, place int, doc_id long, n long, digest binary, token long"
SETS = "part long, block int, digest binary, comp string, hashes binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly over 64 bits (xor-shift and multiply, one to one)."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; of all words together if there are fewer."""
    if not len(hashes):
        return hashes
    width = min(n, len(hashes))
    total = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + len(total)])
    return np.unique(total)


def digest_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sets_of(payload: bytes, sizes: list[int], n: int) -> Iterator[np.ndarray]:
    codes, words = common.unpack(payload)
    at = 0
    for size in sizes:
        yield ngrams(words[codes[at:at + size]], n)
        at += size


def keys_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's distinct n-gram keys in order, and in how many of the sets each stands."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(64 - KEY_BITS), return_counts=True)


def runs_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's run of the ordered keys ends; a bucket has an equal share of the key space."""
    edges = [(b + 1 << KEY_BITS) // buckets for b in range(buckets)]
    return np.searchsorted(keys, np.array(edges, np.uint64))


class Tree:
    """A compact prefix tree of sets, each in order; links() looks every set up in it.

    Nodes are arrays and a lookup goes down level by level, for all nodes of a level at once.  labels: sets with equal
    labels are connected already; pairs of those are left out.
    """

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, part: int, whole: int):
        self.part, self.whole, self.labels = part, whole, labels
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
        self.sets = [sets[k] for k in self.order]
        self.labels = labels[self.order]
        parent, start, stop, owner, self.end = [-1], [0], [0], [0], []
        path, before = [0], np.zeros(0, np.uint64)
        for k, own in enumerate(self.sets):
            length = min(len(before), len(own))
            differ = np.flatnonzero(before[:length] != own[:length])
            same, below = int(differ[0]) if len(differ) else length, -1
            while stop[path[-1]] > same:
                below = path.pop()
            if stop[path[-1]] < same:  # the beginning shared with the set before ends inside a node
                parent.append(path[-1]), start.append(stop[path[-1]]), stop.append(same), owner.append(owner[below])
                parent[below], start[below] = len(parent) - 1, same
                path.append(len(parent) - 1)
            if len(own) > same:
                parent.append(path[-1]), start.append(same), stop.append(len(own)), owner.append(k)
                path.append(len(parent) - 1)
            self.end.append(path[-1])
            before = own
        self.parent, self.depth = np.array(parent), np.array(stop)
        self.width = self.depth - np.array(start)
        flat = np.concatenate([np.zeros(0, np.uint64), *(self.sets[o][a:b] for o, a, b in zip(owner, start, stop))])
        names, self.tokens = np.unique(flat, return_inverse=True)
        self.numbers = [np.searchsorted(names, x) for x in self.sets]
        self.first = np.cumsum(self.width) - self.width
        self.last = np.where(self.width > 0, self.tokens[np.minimum(self.first + self.width - 1, max(len(flat) - 1, 0))] if len(flat) else 0, -1)
        level, self.levels = np.zeros(1, np.int64), []
        kids = defaultdict(list)
        for node, up in enumerate(parent):
            kids[up].append(node)
        while len(level):
            level = np.array([x for up in level.tolist() for x in kids[up]], np.int64)
            self.levels.append(level)
        self.low, self.high, self.latest = np.full(len(parent), 1 << 60), np.zeros(len(parent), np.int64), np.full(len(parent), -1)
        sizes = np.array([len(x) for x in self.sets], np.int64)
        self.at_end = defaultdict(list)
        for k, node in enumerate(self.end):
            self.at_end[node].append(k)
        for f, target, value in ((np.minimum, self.low, sizes), (np.maximum, self.high, sizes), (np.maximum, self.latest, np.arange(len(sizes)))):
            f.at(target, self.end, value)
            for level in reversed(self.levels):
                f.at(target, self.parent[level], target[level])
        #: the one set that a leaf ends, to leave out leaves that are connected already
        self.single = np.array([self.at_end[n][0] if len(self.at_end[n]) == 1 and not kids[n] else -1 for n in range(len(parent))])

    def reachable(self, nodes: np.ndarray, shared: np.ndarray, rest: np.ndarray, depth: np.ndarray, size: int) -> np.ndarray:
        """Whether a set below may still be similar: all that remains on either side could be shared."""
        most = shared + np.minimum(rest, self.high[nodes] - depth)
        return (self.part + self.whole) * most >= self.part * (size + self.low[nodes])

    def links(self) -> Iterator[tuple[int, int]]:
        """Pairs of places in sets, as given, that connect what wasn't connected."""
        mark = np.zeros(int(self.tokens.max()) + 1 if len(self.tokens) else 1, np.int64)
        shared = np.zeros(len(self.parent), np.int64)
        rest = np.zeros(len(self.parent), np.int64)
        for me, own in enumerate(self.numbers):
            if (self.labels == self.labels[0]).all():
                return
            size = len(own)
            mark[own] = 1
            rest[0] = size
            alive = np.zeros(len(self.parent), bool)
            alive[0] = True
            for level in self.levels:
                nodes = level[alive[self.parent[level]]]
                nodes = nodes[self.latest[nodes] > me]
                up = self.parent[nodes]
                nodes = nodes[self.reachable(nodes, shared[up], rest[up], self.depth[up], size)]
                alone = self.single[nodes]
                nodes = nodes[(alone < 0) | (self.labels[alone] != self.labels[me])]
                if not len(nodes):
                    break
                up = self.parent[nodes]
                hits = mark[self.tokens[common.spans(self.first[nodes], self.width[nodes])]]
                shared[nodes] = shared[up] + np.add.reduceat(hits, np.cumsum(self.width[nodes]) - self.width[nodes])
                rest[nodes] = size - np.searchsorted(own, self.last[nodes], "right")
                alive[nodes] = True
                # at a set's end, nothing of it remains: shared is what the two have in common
                for node in nodes[self.whole * shared[nodes] >= self.part * (size + self.depth[nodes] - shared[nodes])].tolist():
                    for other in self.at_end.get(node, ()):
                        if other > me and self.labels[other] != self.labels[me]:
                            self.labels[self.labels == self.labels[other]] = self.labels[me]
                            yield self.order[me], self.order[other]
            mark[own] = 0


def tree_links(batches: Iterator[pa.RecordBatch], part: int, whole: int) -> Iterator[pa.RecordBatch]:
    """Links within each run of rows with equal (part, block); the rows come in that order, and one run is held at a time."""
    def of(run: list[tuple]) -> pa.RecordBatch:
        known = common.Numbering()
        labels = np.array([known[comp or k] for k, (_, comp, _) in enumerate(run)], np.int64)
        found = list(Tree([np.frombuffer(x, np.uint64) for _, _, x in run], labels, part, whole).links())
        return pa.RecordBatch.from_arrays([pa.array([run[k][0].hex() for k in side], pa.string()) for side in (zip(*found) if found else ((), ()))], names=["a", "b"])

    key, run = None, []
    for batch in batches:
        for own_part, block, digest, comp, hashes in zip(*(c.to_pylist() for c in batch.columns)):
            if (own_part, block) != key:
                if run:
                    yield of(run)
                key, run = (own_part, block), []
            run.append((digest, comp, hashes))
    if run:
        yield of(run)


def join(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (80, 100), text: str = "text", doc_id: str = "doc_id",
         chunk_bytes: int = common.CHUNK_BYTES, block: int = BLOCK, buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.  Linked: similarity[1] * shared >= similarity[0] * united."""
    spark = docs.sparkSession
    part, whole = similarity
    buckets = buckets or common.shuffle_width(spark)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_chunk = common.chunk_ids()
        for rows in common.gather(batches, chunk_bytes):
            numbers = common.Numbering()
            codes = [np.array(list(map(numbers.__getitem__, common.fold(x).split())), np.uint32) for x in rows["text"].to_pylist()]
            flat, words, _ = common.ranked(list(numbers), np.concatenate(codes), 1)
            chunk, sizes = next(new_chunk), [len(x) for x in codes]
            payload = common.pack(flat, word_hashes(words))
            yield common.message("text", chunk, payload=payload, ids=rows["doc_id"].to_pylist(), sizes=sizes)
            sets = {digest_of(x): x for x in sets_of(payload, sizes, n)}
            keys, counts = keys_of(list(sets.values()))
            for bucket, a, b in common.split_at(runs_of(keys, buckets)):
                steps = np.diff(keys[a:b], prepend=np.uint64(0))
                yield common.message("keys", chunk, bucket, common.pack(steps, counts[a:b].astype(np.uint32)))

    def add_up(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        parts = [common.unpack(r["payload"]) for r in rows]
        keys = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        starts = np.flatnonzero(np.diff(every[order], prepend=np.uint64((1 << 64) - 1)))
        distinct = every[order][starts]
        totals = np.add.reduceat(np.concatenate([p[1] for p in parts])[order].astype(np.int64), starts)
        totals = np.minimum(totals, (1 << 32) - 1).astype(np.uint32)
        out = [r | {"kind": "counts", "payload": common.pack(totals[np.searchsorted(distinct, k)])} for r, k in zip(rows, keys)]
        return pa.Table.from_pylist(out, schema=common.MESSAGE_SCHEMA)

    def prefixes(texts: pa.Table, replies: pa.Table) -> pa.Table:
        """A row for every document, and one for every n-gram of a class's prefix that may be shared."""
        row = texts.to_pylist()[0]
        sets = list(sets_of(row["payload"], row["sizes"], n))
        digests = [digest_of(x) for x in sets]
        keys, _ = keys_of(list(dict(zip(digests, sets)).values()))
        counts = np.concatenate([np.zeros(0, np.uint32), *(common.unpack(r["payload"])[0] for r in sorted(replies.to_pylist(), key=lambda r: r["bucket"]))])
        tokens, owners, seen = [np.zeros(0, np.uint64)], [], set()
        for k, (own, digest) in enumerate(zip(sets, digests)):
            if not len(own) or digest in seen:
                continue
            seen.add(digest)
            length = len(own) - -(-part * len(own) // whole) + 1
            often = counts[np.searchsorted(keys, own >> np.uint64(64 - KEY_BITS))]
            single = int((often <= 1).sum())
            if single < length:
                first = own[np.lexsort((own, often))[single:length]]
                tokens.append(first)
                owners += [k] * len(first)
        size, flat = len(sets), np.concatenate(tokens)
        places = list(range(size)) + owners
        return pa.table({
            "kind": ["doc"] * size + ["token"] * len(owners), "chunk": np.full(len(places), row["chunk"], np.int64),
            "place": pa.array(places, pa.int32()), "doc_id": pa.array([row["ids"][k] for k in places], pa.int64()),
            "n": pa.array([len(sets[k]) for k in places], pa.int64()),
            "digest": pa.array([digests[k] if len(sets[k]) else None for k in places], pa.binary()),
            "token": pa.array(np.concatenate([np.zeros(size, np.int64), flat.view(np.int64)]))})

    def sets_for(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        codes, words = common.unpack(row["payload"])
        ends = np.cumsum(row["sizes"])
        made: dict[int, bytes] = {}
        for k in set(wanted["place"].to_pylist()):
            made[k] = ngrams(words[codes[ends[k] - row["sizes"][k]:ends[k]]], n).tobytes()
        return pa.table({"part": wanted["part"], "block": wanted["block"], "digest": wanted["digest"], "comp": wanted["comp"],
                         "hashes": pa.array([made[k] for k in wanted["place"].to_pylist()], pa.binary())})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    read = common.stored(rows.mapInArrow(number, common.MESSAGES))
    replies = read("keys").groupBy("bucket").applyInArrow(add_up, common.MESSAGES)
    found = common.materialize(read("text").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(prefixes, FOUND))

    def linked(wanted: DataFrame) -> DataFrame:
        """Links found in the groups (part, block) of the rows wanted: part, block, chunk, place, digest, comp."""
        sets = read("text").groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(
            lambda t, w: sets_for(t, w) if t.num_rows and w.num_rows else pa.table({k: pa.array([], v) for k, v in (
                ("part", pa.int64()), ("block", pa.int32()), ("digest", pa.binary()), ("comp", pa.string()), ("hashes", pa.binary()))}), SETS)
        dealt = sets.repartition(common.shuffle_width(spark), "part", "block").sortWithinPartitions("part", "block", "comp")
        return dealt.mapInArrow(lambda b: tree_links(b, part, whole), "a string, b string")

    members = found.where("kind = 'token'").groupBy("token", "digest", "n").agg(F.min(F.struct("chunk", "place")).alias("spot"))
    lists = members.groupBy("token").agg(F.count("*").alias("size"), F.sum("n").alias("mass"), F.bit_xor(F.xxhash64("digest")).alias("who"))
    lists = lists.where("size > 1").groupBy("size", "mass", "who").agg(F.min("token").alias("token"))
    groups = common.materialize(members.join(lists, "token").select(
        F.col("token").alias("part"), "size", F.ceil(F.col("mass") / block).cast("int").alias("blocks"), "digest", "spot.chunk", "spot.place"))
    columns = ["part", "block", "chunk", "place", "digest", "comp"]

    # first round: each class in the largest of its groups, which connects most of what there is to connect
    chosen = groups.groupBy("digest").agg(F.max_by(F.struct("part", "blocks", "chunk", "place"), F.struct("size", "part")).alias("to")).select("digest", "to.*")
    dealt = chosen.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")).withColumn("comp", F.lit(None).cast("string"))
    rank = F.row_number().over(common.window("part", order=F.xxhash64("digest", "part")))
    pivots = dealt.where("blocks > 1 and block = 0").withColumn("_rank", rank).where(F.col("_rank") <= PIVOTS).drop("_rank")
    copies = pivots.withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)))
    links = common.materialize(linked(dealt.select(*columns).unionByName(copies.select(*columns))))

    # second round: every group that still holds several components; its cell (i, j) compares block i of all its members
    # with block j of those outside its main component
    label = components(links, "a", "b").withColumnRenamed("component", "label")
    again = groups.withColumn("node", F.lower(F.hex("digest"))).join(label, "node", "left")
    again = common.materialize(again.withColumn("comp", F.coalesce("label", "node")).drop("node", "label"))
    sizes = again.groupBy("part", "comp").agg(F.count("*").alias("k")).groupBy("part").agg(
        F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("every"))
    again = again.join(sizes.where("most < every"), "part").withColumn("minor", F.col("comp") != F.col("main"))
    cells = F.greatest(F.ceil(F.col("blocks") * (F.col("every") - F.col("most")) / F.col("every")), F.lit(1)).cast("int")
    again = again.withColumn("cells", cells)
    i = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    j = F.pmod(F.xxhash64("digest", F.lit(1)), F.col("cells")).cast("int")
    across = again.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda c: i * F.col("cells") + c)))
    down = again.where("minor").withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda r: r * F.col("cells") + j)))
    links = common.materialize(links.unionByName(linked(across.select(*columns).unionByName(down.select(*columns)).distinct())))

    label = components(links, "a", "b").withColumnRenamed("node", "name").withColumnRenamed("component", "label")
    marks = found.where("kind = 'doc'").select("doc_id", F.col("n").alias("n_shingles"), "digest")
    classes = marks.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"))
    named = classes.join(label, F.lower(F.hex("digest")) == F.col("name"), "left").withColumn("label", F.coalesce("label", F.lower(F.hex("digest"))))
    named = common.materialize(named.select("digest", "label", "first"))
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    ends = named.join(lowest, "label").select("digest", "component_id")
    return marks.join(ends, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
