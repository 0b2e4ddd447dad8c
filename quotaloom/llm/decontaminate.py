"""Benchmark decontamination by the q-gram lemma.

An item of m characters that stands in a text with at most e edits shares at least m + 1 - q - q e of its q-grams with that
place, on at most 2 e + 1 neighbouring diagonals (text position less item position).  So shared q-grams are counted in
bands of diagonals that overlap by that much, bands that reach the bound become regions, and a banded alignment of the
item with its region decides.  e is RATE of the item's characters, less where the bound would fall under one shared q-gram;
items shorter than q take their length for q and no edits.  Texts are compared in lower case with runs of white space as
one space; spans refer to that form, and whole texts are read.

The items are indexed in blocks of at most BLOCK_CHARS characters (or one item); each block is a broadcast of bounded size
and one pass over the documents, so a benchmark of any size is held in full.

Null and empty texts and items match nothing.  Repeated rows of either table each give their rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaloom.llm import common

Q, RATE = 12, 0.05
BLOCK_CHARS = 1_000_000
#: bits of the table that passes over q-grams no item has
FILTER_BITS = 22
BASE = 0x9E3779B97F4A7C15
BREAK = 0x110000
FOUND = "doc_id long, item_id long, shared long, distance long, start long, end long"


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every run of q code points, from hashes of runs of 1, 2, 4, ... that are put behind each other."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    run, width, out, done = codes.astype(np.uint64) + np.uint64(1), 1, None, 0
    n = len(codes) - q + 1
    while True:
        if q & width:
            piece = run[done:done + n]
            out = piece.copy() if out is None else out * np.uint64(pow(BASE, width, 1 << 64)) + piece
            done += width
        if done == q:
            return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        run = run[:len(run) - width] * np.uint64(pow(BASE, width, 1 << 64)) + run[width:]
        width *= 2


class Index:
    """Items by q: their q-grams in order, and for each where it stands."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.items = [(i, t) for i, t in items if t]
        self.edits, by_q = [], defaultdict(list)
        for k, (_, text) in enumerate(self.items):
            own = min(q, len(text))
            self.edits.append(min(int(rate * len(text)), (len(text) - own) // own))
            by_q[own].append(k)
        self.parts = []
        for own, members in sorted(by_q.items()):
            grams = [qgrams(points(self.items[k][1]), own) for k in members]
            flat = np.concatenate(grams)
            owner = np.repeat(np.array(members, np.int64), [len(g) for g in grams])
            place = np.concatenate([np.arange(len(g)) for g in grams])
            order = np.argsort(flat, kind="stable")
            distinct, first, count = np.unique(flat[order], return_index=True, return_counts=True)
            near = np.zeros(1 << FILTER_BITS, bool)
            near[distinct >> np.uint64(64 - FILTER_BITS)] = True
            self.parts.append((own, np.packbits(near), distinct, first, count, owner[order], place[order]))


def aligned(item: np.ndarray, region: np.ndarray, edits: int, drift: int) -> tuple[int, int, int] | None:
    """Fewest edits between the item and a part of the region (at most edits), with that part's start and end, or None.

    drift: how far the part may start into the region.  Row i of the table holds the cells from region position i - edits
    on, as edits << 32 | start, so that a minimum also carries where its alignment starts.
    """
    width, m, n = drift + 2 * edits + 1, len(item), len(region)
    one, far = np.int64(1 << 32), np.int64(1 << 60)
    places = np.arange(width) - edits
    row = np.where((places >= 0) & (places <= min(n, drift)), np.clip(places, 0, None), far)
    climb = np.arange(width, dtype=np.int64) * one
    padded = np.concatenate([np.full(edits + 1, BREAK + 1, np.uint32), region, np.full(m + width, BREAK + 1, np.uint32)])
    for i in range(1, m + 1):
        # cell k now stands for region position i - edits + k; its diagonal neighbour is cell k, the one above is cell k + 1
        at = i - edits + np.arange(width)
        step = row + np.where(padded[i:i + width] == item[i - 1], np.int64(0), one)
        above = np.append(row[1:] + one, far)
        row = np.where((at < 0) | (at > n), far, np.minimum(step, above))
        row = np.minimum(np.minimum.accumulate(row - climb) + climb, far)
        row[(at < 0) | (at > n)] = far
    best = int(row.argmin())
    cost, start = int(row[best]) >> 32, int(row[best]) & 0xFFFFFFFF
    return (cost, start, m - edits + best) if cost <= edits else None


def matches(texts: list[str], index: Index, filters: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, item, shared, distance, start, end) of every item found in one of the texts."""
    codes = [points(t) for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    every = np.concatenate([x for c in codes for x in (c, np.array([BREAK], np.uint32))])
    edits = np.array(index.edits, np.int64)
    for (q, _, distinct, first, count, owner, place), near in zip(index.parts, filters):
        grams = qgrams(every, q)
        spots = np.flatnonzero(near[grams >> np.uint64(64 - FILTER_BITS)])
        hit = np.searchsorted(distinct, grams[spots])
        good = distinct[np.minimum(hit, len(distinct) - 1)] == grams[spots]
        spots, hit = spots[good], hit[good]
        entries = common.spans(first[hit], count[hit])
        at, item = np.repeat(spots, count[hit]), owner[entries]
        text = np.searchsorted(starts, at, "right") - 1
        diagonal = at - starts[text] - place[entries]
        step = 2 * edits[item] + 1
        band = diagonal // step
        keys = np.stack([np.concatenate([text, text]), np.concatenate([item, item]), np.concatenate([band, band - 1])])
        order = np.lexsort(keys)
        keys = keys[:, order]
        new = np.flatnonzero(np.any(np.diff(keys, axis=1, prepend=-(1 << 62)) != 0, axis=0))
        shared = np.diff(np.append(new, keys.shape[1]))
        text, item, band = keys[:, new]
        length = np.array([len(t) for _, t in index.items], np.int64)[item]
        enough = shared >= length + 1 - q - q * edits[item]
        best: dict[tuple[int, int], list[tuple[int, int, int, int]]] = defaultdict(list)
        for t, k, b, s in zip(*(x[enough].tolist() for x in (text, item, band, shared))):
            e, m = index.edits[k], len(index.items[k][1])
            low = max(0, b * (2 * e + 1))
            high = max(low, (b + 2) * (2 * e + 1))  # a band before the text starts at its start
            found = aligned_in(texts[t], codes[t], index.items[k][1], low, high, e, m)
            if found:
                best[t, k].append((found[0], low + found[1], low + found[2], s))
        for (t, k), places in best.items():
            last = -1
            for distance, start, end, s in sorted(places, key=lambda p: (p[1], p[0])):
                if start >= last:  # two bands may see one place
                    yield t, k, s, distance, start, end
                    last = end


def aligned_in(text: str, codes: np.ndarray, item: str, low: int, high: int, edits: int, size: int) -> tuple[int, int, int] | None:
    region = slice(low, high + size + edits)
    same = text[region].find(item)
    if same >= 0:
        return 0, same, same + size
    return aligned(points(item), codes[region], edits, high - low) if edits else None


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
               item_id: str = "item_id", q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, shared q-grams, edit distance, start and end of every place where an item stands in a text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text <> ''")
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text <> ''")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))

    def pass_over(block: int) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(Index([(r.item_id, plain(r.text)) for r in own.collect()], q, rate))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            filters = [np.unpackbits(p[1]).view(bool) for p in index.parts]
            for part in common.gather(batches, 2 << 20):
                ids = part["doc_id"].to_pylist()
                found = [(ids[t], index.items[k][0], *more) for t, k, *more in matches([plain(x) for x in part["text"].to_pylist()], index, filters)]
                columns = list(zip(*found)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 names=["doc_id", "item_id", "shared", "distance", "start", "end"])

        return rows.mapInArrow(look, FOUND)

    return reduce(DataFrame.unionByName, map(pass_over, range(blocks)))
