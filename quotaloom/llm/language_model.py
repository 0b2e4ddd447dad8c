"""A hierarchical Pitman-Yor bigram model of the corpus, and every text's log probability under it.

Each word that precedes another has a restaurant; its customers are the words that follow, its tables are customers of the
root restaurant that all of them share, and the root's tables draw from a uniform distribution over the training words and
one unknown word.  Tables are sampled by blocked Gibbs, a round at a time, and every sweep seats all customers anew:

* a restaurant with T tables draws g from Gamma(strength / discount + T); given g its dishes are independent, and a dish with
  n customers has t tables with weight S(n, t) (discount g p)^t, S the generalised Stirling numbers and p the root's mass of
  the word.  table_counts() draws t from just that, so a dish of a million customers takes no more moves than one of three;
* the tables of each word go up, the root draws its own table counts in the same way, then its masses: for each word a gamma
  draw for its tables and a tilted stable one for what the root has not seated (the root is a Pitman-Yor process).

The first round has one table for each dish.  The tables of each restaurant stay with its bucket from round to round.  After
the burn-in, each round's tables and root give one sample; the scores average the samples' predictive probabilities.  The last
rounds' draws are repeated with the same seeds instead of kept.

How it runs: chunks number their words; words meet in buckets for their training counts; each chunk then sends its distinct
word pairs, with training counts, to the bucket of the preceding word, where the restaurants are.  Pairs are kept by bucket,
so the rounds move only one number for each (bucket, word), and the last one returns a probability for each pair asked.
Restaurants with at least a HOT-th of all training tokens (fewer than HOT + 1) are spread over the buckets by dish, and only their
numbers of tables are shared.

Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, then one end, which is also what precedes a first word.  Null
and empty texts are an end alone.  Probabilities of single tokens are kept to 1/4096 in log10.  Without training rows every
token is the unknown word, with probability 1.  Repeated rows each count and each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaloom.llm import common

HOT = 1000
#: dishes of up to so many customers draw from a table of Stirling numbers, others from a contour integral of so many nodes
SMALL, NODES, BATCH = 256, 64, 1 << 14
END = b""
GRAIN = 4096
SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Settings:
    """What the buckets have to know of the whole corpus; all of it is a few numbers and at most HOT restaurants."""
    tokens: int = 0
    words: int = 0
    discount: float = 0.75
    strength: float = 1.0
    root_discount: float = 0.75
    root_strength: float = 1.0
    root_customers: int = 0
    root_tables: int = 0
    #: the root's auxiliary draw, and the sum of its masses
    root_gamma: float = 1.0
    root_mass: float = 1.0
    hot_tables: dict[int, int] | None = None
    #: sweeps of a restaurant within a round
    steps: int = 2
    samples: int = 3
    turn: int = 0
    seed: int = 11


def discount_of(ones: int, twos: int) -> float:
    """The usual estimate from how many counts are 1 and 2, kept inside (0, 1)."""
    return min(max(ones / max(1, ones + 2 * twos), 0.05), 0.95)


@lru_cache(4)
def stirling(discount: float) -> list[np.ndarray]:
    """For n = 0 ... SMALL the logarithms of S(n, t), t = 1 ... n."""
    out = [np.zeros(0), np.zeros(1)]
    for n in range(1, SMALL):
        row, t = out[-1], np.arange(1, n + 1)
        stay = np.append(row + np.log(n - discount * t), -np.inf)
        out.append(np.logaddexp(stay, np.append(-np.inf, row)))
    return out


def many_tables(n: np.ndarray, weight: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """table_counts() for large n.  S(n, t) is n! / t! times the n-th coefficient of ((1 - (1 - x)^d) / d)^t: a contour integral
    that passes the saddle point, whose nodes serve all t; t is drawn among those within 9 standard deviations."""
    n = n.astype(float)
    low, high = np.full(len(n), -600.0), np.full(len(n), -1e-12)
    for _ in range(60):  # log y with weight (1 - y) y^(d - 1) = n
        mid = (low + high) / 2
        above = np.log(weight) + np.log(-np.expm1(mid)) + (discount - 1) * mid > np.log(n)
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    y = np.exp((low + high) / 2)
    mean = np.maximum(weight / discount * -np.expm1(discount * (low + high) / 2), 1e-300)
    over = 1 + (1 - discount) * (1 - y) / y
    deviation = np.sqrt(np.maximum(mean - n / over, 0.0))
    saddle = -n * np.log1p(-y)
    bent = saddle < n / 20
    node = (np.arange(NODES) + 0.5) / NODES
    # near the branch point the path is a parabola around the cut, elsewhere a line as long as the integrand is wide
    scale = np.maximum(saddle, 2.0)[:, None]
    reach = np.minimum(np.sqrt(20 / ((1 - discount) * scale)), np.sqrt(1 + 40 / scale) + 1)
    u = 1 + 1j * node * reach
    wide = np.minimum(np.pi, 9 / np.sqrt(np.maximum(n * over - n * n / np.maximum(mean, 1.0), 1e-9)))[:, None]
    z = np.where(bent[:, None], -scale * u * u / n[:, None], np.log1p(-y)[:, None] + 1j * node * wide)
    step = np.where(bent[:, None], scale * u * reach, wide * np.ones_like(u))
    factor = 1 - np.exp(discount * np.log(-np.expm1(z)))
    first = np.clip(np.floor(mean - 9 * deviation - 2), 1, n)
    length = (np.clip(np.ceil(mean + 9 * deviation + 15), 1, n) - first).astype(np.int64) + 1
    at = np.clip(np.rint(mean), 1, n)
    log_ratio = np.log(weight / discount)[:, None] + np.log(factor)
    # logarithms of t! up to a constant, from the middle of the window
    steps_back = (at - first).astype(np.int64)
    back = np.zeros(len(n))
    k = np.arange(int(steps_back.max()) + 1)
    inside = k[None, :] < steps_back[:, None]
    back = np.where(inside, np.log(np.maximum(first[:, None] + 1 + k[None, :], 1.0)), 0.0).sum(axis=1)
    middle = at[:, None] * log_ratio - n[:, None] * z
    peak = np.max(middle.real, axis=1, keepdims=True)
    held = step * np.exp(middle - peak + back[:, None] - (at - first)[:, None] * log_ratio)
    move = np.exp(log_ratio)
    longest = int(length.max())
    mass = np.zeros((len(n), longest))
    for j in range(longest):
        mass[:, j] = np.where(j < length, np.maximum(held.real.sum(axis=1), 0.0), 0.0)
        held *= move / (first + j + 1)[:, None]
    upto = np.cumsum(mass, axis=1)
    return (first + (upto <= random.random((len(n), 1)) * upto[:, -1:]).sum(axis=1)).astype(np.int64)


def table_counts(n: np.ndarray, weight: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """For each dish of n customers a number of tables t, drawn with weight S(n, t) weight^t."""
    out = np.ones(len(n), np.int64)
    order = np.argsort(n, kind="stable")
    starts = np.searchsorted(n[order], np.arange(2, SMALL + 2))
    logs, ways = np.log(weight), stirling(discount)
    for size, a, b in zip(range(2, SMALL + 1), starts, starts[1:]):
        for c in range(a, b, BATCH):
            own = order[c:min(b, c + BATCH)]
            mass = ways[size] + logs[own, None] * np.arange(1, size + 1)
            upto = np.cumsum(np.exp(mass - mass.max(axis=1, keepdims=True)), axis=1)
            out[own] += (upto <= random.random((len(own), 1)) * upto[:, -1:]).sum(axis=1)
    large = order[starts[-1]:]
    large = large[np.argsort(weight[large], kind="stable")]  # windows of like length together
    for c in range(0, len(large), 256):
        own = large[c:c + 256]
        out[own] = many_tables(n[own], weight[own], discount, random)
    return np.minimum(out, n)


def unseated(share: float, discount: float, size: int, random: np.random.Generator) -> np.ndarray:
    """Draws with Laplace transform exp(-share ((1 + s)^discount - 1)): the root's mass of a word besides its tables."""
    parts = max(1, int(np.ceil(share)))  # a part is kept with probability exp(-share / parts)
    out = np.empty(size * parts)
    left = np.arange(size * parts)
    while len(left):
        v, e = np.pi * (1 - random.random(len(left))), random.standard_exponential(len(left))
        stable = np.sin(discount * v) / np.sin(v) ** (1 / discount) * (np.sin((1 - discount) * v) / e) ** (1 / discount - 1)
        stable *= (share / parts) ** (1 / discount)
        kept = random.random(len(left)) < np.exp(-stable)
        out[left[kept]] = stable[kept]
        left = left[~kept]
    return out.reshape(size, parts).sum(axis=1)


class Seating:
    """Tables of many dishes (customers each, restaurant each); step() is a Gibbs step of all dishes at once, one customer of
    each.  The plain chain, by whose long run the tests measure table_counts(); the model does not use it."""

    def __init__(self, customers: np.ndarray, restaurant: np.ndarray, prior: np.ndarray, outside: np.ndarray, discount: float, strength: float, seed: int):
        self.customers, self.restaurant, self.prior, self.outside = customers.astype(np.int64), restaurant, prior, outside
        self.discount, self.strength, self.random = discount, strength, np.random.default_rng(seed)
        self.tables = np.ones(len(customers), np.int64)
        #: dishes that one customer has cannot move
        self.moving = np.flatnonzero(self.customers > 1)
        self.dish, self.size = np.arange(len(self.moving)), self.customers[self.moving].copy()

    def totals(self) -> np.ndarray:
        return np.bincount(self.restaurant, self.tables, len(self.outside)).astype(np.int64) + self.outside

    def step(self) -> None:
        moving, n = self.moving, len(self.moving)
        if not n:
            return
        count = self.customers[moving]
        ends = np.cumsum(self.size)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        left = np.searchsorted(ends, first + (self.random.random(n) * count).astype(np.int64), "right")
        self.size[left] -= 1
        emptied = self.size[left] == 0
        tables = self.tables[moving] - emptied
        everywhere = self.totals()[self.restaurant[moving]] - emptied
        fresh = (self.strength + self.discount * everywhere) * self.prior[moving]
        weight = np.where(self.size > 0, self.size - self.discount, 0.0)
        upto = np.cumsum(weight)
        last = np.searchsorted(self.dish, np.arange(n), "right") - 1
        start = np.concatenate([[0.0], upto[last][:-1]])
        seated = np.maximum(upto[last] - start, 0.0)
        new = (self.random.random(n) * (fresh + seated) < fresh) | (tables == 0)
        goal = np.minimum(np.searchsorted(upto, start + self.random.random(n) * seated, "right"), last)
        back = self.size[goal] == 0  # rounding may point at the table just emptied
        goal = np.where(back, last, goal)
        new |= self.size[goal] == 0
        np.add.at(self.size, goal[~new], 1)
        self.tables[moving] = tables + new
        keep = self.size > 0
        dish = np.concatenate([self.dish[keep], np.flatnonzero(new)])
        size = np.concatenate([self.size[keep], np.ones(int(new.sum()), np.int64)])
        order = np.argsort(dish, kind="stable")
        self.dish, self.size = dish[order], size[order]


class Pairs:
    """The pairs asked of one bucket: contexts in order, the words after each, and the training counts."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        parts = [common.unpack(r["payload"]) for r in rows]
        before = [np.repeat(np.arange(len(p[0])), p[2]) for p in parts]
        contexts = np.concatenate([p[0] for p in parts])
        self.contexts, first, inverse = np.unique(contexts, return_index=True, return_inverse=True)
        self.held = np.concatenate([p[1] for p in parts])[first].astype(np.int64)
        starts = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
        context = np.concatenate([inverse[b + s] for b, s in zip(before, starts)])
        self.words, word = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
        key = context * np.int64(len(self.words)) + word
        distinct, self.asked = np.unique(key, return_inverse=True)
        self.context, self.word = distinct // len(self.words), distinct % len(self.words)
        self.count = np.bincount(self.asked, np.concatenate([p[4] for p in parts]), len(distinct)).astype(np.int64)
        self.sizes = [len(p[3]) for p in parts]

    def by_home(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the known words by the bucket that holds their root customers, and where each run ends."""
        known = np.flatnonzero(self.words > 0)
        home = (self.words[known] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        return known[order], np.cumsum(np.bincount(home, minlength=buckets))


def root_prior(customers: np.ndarray, tables: np.ndarray, s: Settings) -> np.ndarray:
    held = np.maximum(customers - s.root_discount * tables, 0.0)
    spare = (s.root_strength + s.root_discount * s.root_tables) / (s.words + 1)
    return (held + spare) / (s.root_strength + s.root_customers)


def train_and_score(docs: DataFrame, train: str, text: str = "text", doc_id: str = "doc_id", rounds: int = 2,
                    chunk_bytes: int = common.CHUNK_BYTES, buckets: int | None = None) -> DataFrame:
    """Scores of every row of docs under the model of the rows whose column train is true; base_score is add-one unigram."""
    spark = docs.sparkSession
    buckets = min(buckets or common.shuffle_width(spark), 1 << 16)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_chunk = common.chunk_ids()
        for rows in common.gather(batches, chunk_bytes):
            numbers = common.Numbering()
            codes = [np.array([*map(numbers.__getitem__, common.fold(x).split()), numbers[END]], np.uint32) for x in rows["text"].to_pylist()]
            sizes, learn = [len(x) for x in codes], rows["train"].to_numpy(zero_copy_only=False).astype(bool)
            flat, words, at = common.ranked(list(numbers), np.concatenate(codes), buckets)
            counts = np.bincount(flat[np.repeat(learn, sizes)], minlength=len(words)).astype(np.uint32)
            chunk = next(new_chunk)
            yield common.message("text", chunk, payload=common.pack(flat, at), ids=rows["doc_id"].to_pylist(), sizes=sizes, marks=learn.astype(int).tolist())
            order, ends = common.by_bucket(at, buckets)
            for bucket, a, b in common.split_at(ends):
                yield common.message("words", chunk, bucket, common.pack_words([words[i] for i in order[a:b].tolist()], counts[order[a:b]]))

    def vocabulary(asked: pa.Table) -> pa.Table:
        """Numbers (0: not in training) and training counts of the words asked; sorted first, so that a second run agrees."""
        rows = [(r, *common.unpack_words(r["payload"])) for r in asked.to_pylist()]
        total: dict[bytes, int] = {}
        for _, words, (counts,) in rows:
            for w, c in zip(words, counts.tolist()):
                total[w] = total.get(w, 0) + c
        bucket = rows[0][0]["bucket"]
        number = {w: k * buckets + bucket + 1 for k, w in enumerate(sorted(w for w, c in total.items() if c))}
        out = [r | {"kind": "vocab", "payload": common.pack(np.array([number.get(w, 0) for w in words], np.uint64), np.array([total[w] for w in words], np.uint32))}
               for r, words, _ in rows]
        counts = [c for c in total.values() if c]
        out.append({"kind": "total", "chunk": -1, "bucket": bucket, "payload": common.pack(np.array([sum(counts), len(counts), counts.count(1), counts.count(2)], np.int64))})
        return pa.Table.from_pylist(out, schema=common.MESSAGE_SCHEMA)

    def numbered(texts: pa.Table, replies: pa.Table):
        """The chunk's row, and for each token: number and count of its word, then its pair among the chunk's distinct pairs."""
        row = texts.to_pylist()[0]
        flat, at = common.unpack(row["payload"])
        parts = [common.unpack(r["payload"]) for r in sorted((r for r in replies.to_pylist() if r["kind"] == "vocab"), key=lambda r: r["bucket"])]
        place = common.in_rank(at)
        gid, count = np.concatenate([p[0] for p in parts])[place], np.concatenate([p[1] for p in parts])[place].astype(np.int64)
        own = np.where(gid > 0, np.arange(1, len(gid) + 1), 0)  # all unknown words are one
        sizes = np.array(row["sizes"], np.int64)
        after = own[flat]
        before = np.concatenate([[0], after[:-1]])
        before[np.cumsum(sizes) - sizes] = after[np.cumsum(sizes) - 1]  # an end precedes each first word
        distinct, pair = np.unique(before * np.int64(len(gid) + 1) + after, return_inverse=True)
        gid, held = np.concatenate([np.zeros(1, np.uint64), gid]), np.concatenate([[0], count])
        return row, flat, count, sizes, distinct // len(gid), distinct % len(gid), pair, gid, held

    def dealt(left: np.ndarray, right: np.ndarray, gid: np.ndarray, held: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the distinct pairs by bucket and context, and where each bucket's run ends."""
        spread = (held[left] * HOT >= max(tokens, 1)) | (left == 0)
        mixed = (gid[left] * np.uint64(0x9E3779B97F4A7C15)) ^ np.where(spread, gid[right] * np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0))
        bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((gid[right], gid[left], bucket))
        return order, np.cumsum(np.bincount(bucket, minlength=buckets))

    def pairs_of(s: Settings):
        def send(texts: pa.Table, replies: pa.Table) -> pa.Table:
            row, _, _, sizes, left, right, pair, gid, held = numbered(texts, replies)
            counts = np.bincount(pair[np.repeat(np.array(row["marks"], bool), sizes)], minlength=len(left)).astype(np.uint32)
            order, ends = dealt(left, right, gid, held, s.tokens)
            out = []
            for bucket, a, b in common.split_at(ends):
                own = order[a:b]
                context = left[own]
                new = np.flatnonzero(np.diff(context, prepend=-1))
                runs = np.diff(np.append(new, len(own))).astype(np.uint32)
                payload = common.pack(gid[context[new]], held[context[new]].astype(np.uint32), runs, gid[right[own]], counts[own])
                out.append({"kind": "pairs", "chunk": row["chunk"], "bucket": bucket, "payload": payload})
            return pa.Table.from_pylist(out, schema=common.MESSAGE_SCHEMA)
        return send

    def priors(pairs: Pairs, roots: list[dict], s: Settings) -> tuple[np.ndarray, np.ndarray]:
        """The root's predictive probability and its drawn mass of each word of the bucket."""
        prior, mass = np.full(len(pairs.words), root_prior(np.zeros(1), np.zeros(1), s)[0]), np.zeros(len(pairs.words))
        order, ends = pairs.by_home(buckets)
        got = {r["chunk"]: common.unpack(r["payload"]) for r in roots if r["kind"].startswith("root")}
        for home, a, b in common.split_at(ends):
            customers, tables, mass[order[a:b]] = got[home]
            prior[order[a:b]] = root_prior(customers.astype(float), tables.astype(float), s)
        return prior, mass

    def hot_of(pairs: Pairs, s: Settings) -> np.ndarray:
        return np.flatnonzero(pairs.held * HOT >= max(s.tokens, 1))

    def swept(pairs: Pairs, trained: np.ndarray, roots: list[dict], s: Settings) -> np.ndarray:
        """Tables of the trained pairs after a round's sweeps, from the restaurants' tables and the root of the round before."""
        random = np.random.default_rng([s.seed, s.turn, int(pairs.rows[0]["bucket"])])
        mass = priors(pairs, roots, s)[1][pairs.word[trained]] / s.root_mass
        within = next(common.unpack(r["payload"])[0] for r in roots if r["kind"].startswith("state")).astype(np.int64)
        context, hot = pairs.context[trained], hot_of(pairs, s)
        # a spread restaurant has the same draw in all buckets
        shared = [np.random.default_rng([s.seed, s.turn, int(c)]).standard_gamma(s.strength / s.discount + s.hot_tables[int(c)]) for c in pairs.contexts[hot]]
        tables = np.ones(len(trained), np.int64)
        free = np.ones(len(pairs.contexts), bool)
        for k in range(s.steps):
            gamma = random.standard_gamma(s.strength / s.discount + within)
            gamma[hot] = shared
            # one draw is all that a spread restaurant can do before its tables are counted again
            own = np.flatnonzero(free[context]) if k else np.arange(len(trained))
            tables[own] = table_counts(pairs.count[trained[own]], np.maximum(s.discount * gamma[context[own]] * mass[own], 1e-290), s.discount, random)
            within = np.bincount(context, tables, len(pairs.contexts)).astype(np.int64)
            free[hot] = False
        return tables

    def tables_up(s: Settings, first: bool):
        def up(asked: pa.Table, roots: pa.Table | None) -> pa.Table:
            pairs = Pairs(asked.sort_by("chunk").to_pylist())
            trained, hot = np.flatnonzero(pairs.count), hot_of(pairs, s)
            tables = np.ones(len(trained), np.int64) if first else swept(pairs, trained, roots.to_pylist(), s)
            sums = np.bincount(pairs.word[trained], tables, len(pairs.words)).astype(np.uint32)
            order, ends = pairs.by_home(buckets)
            bucket = int(pairs.rows[0]["bucket"])
            out = [{"kind": "tables", "chunk": bucket, "bucket": home, "payload": common.pack(pairs.words[order[a:b]], sums[order[a:b]])}
                   for home, a, b in common.split_at(ends)]
            within = np.bincount(pairs.context[trained], tables, len(pairs.contexts)).astype(np.int64)
            out.append({"kind": "state", "chunk": bucket, "bucket": bucket, "payload": common.pack(within.astype(np.uint32))})
            ones, twos = int((pairs.count == 1).sum()), int((pairs.count == 2).sum())
            out.append({"kind": "total", "chunk": bucket, "bucket": -1, "payload": common.pack(
                np.array([ones, twos], np.int64), pairs.contexts[hot].astype(np.int64), within[hot])})
            return pa.Table.from_pylist(out, schema=common.MESSAGE_SCHEMA)
        return up

    def first_up(s: Settings):
        up = tables_up(s, True)
        return lambda asked: up(asked, None)

    def seat_root(s: Settings):
        def seat(sent: pa.Table) -> pa.Table:
            rows = sent.sort_by("chunk").to_pylist()
            parts = [common.unpack(r["payload"]) for r in rows]
            words, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            customers = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
            random = np.random.default_rng([s.seed, s.turn, buckets + int(rows[0]["bucket"])])
            some, share = np.flatnonzero(customers), s.root_gamma / (s.words + 1)
            tables, mass = np.zeros(len(words), np.int64), np.zeros(len(words), np.float32)
            tables[some] = table_counts(customers[some], np.full(len(some), s.root_discount * share), s.root_discount, random)
            mass[some] = random.standard_gamma(customers[some] - s.root_discount * tables[some]) + unseated(share, s.root_discount, len(some), random)
            out, at = [], 0
            for r, p in zip(rows, parts):
                own = inverse[at:at + len(p[0])]
                at += len(p[0])
                # back to the bucket that sent: chunk and bucket change places
                out.append({"kind": "root", "chunk": r["bucket"], "bucket": r["chunk"], "payload": common.pack(customers[own].astype(np.uint32), tables[own].astype(np.uint32), mass[own])})
            out.append({"kind": "total", "chunk": -1, "bucket": -1, "payload": common.pack(np.array([customers.sum(), tables.sum()], np.int64), np.array([mass.sum(dtype=float)]))})
            return pa.Table.from_pylist(out, schema=common.MESSAGE_SCHEMA)
        return seat

    def predict(turns: list[tuple[Settings, Settings]]):
        def averaged(asked: pa.Table, roots: pa.Table) -> pa.Table:
            pairs = Pairs(asked.sort_by("chunk").to_pylist())
            trained, got = np.flatnonzero(pairs.count), roots.to_pylist()
            total, tables = np.zeros(len(pairs.context)), np.zeros(len(pairs.context))
            held = np.where(pairs.contexts > 0, pairs.held, 0)[pairs.context]
            for s, after in turns:
                tables[trained] = swept(pairs, trained, [r for r in got if r["kind"].endswith(f"-{s.turn - 1}")], s)
                prior = priors(pairs, [r for r in got if r["kind"] == f"root-{s.turn}"], after)[0]
                within = np.bincount(pairs.context[trained], tables[trained], len(pairs.contexts))
                hot = hot_of(pairs, s)
                within[hot] = [after.hot_tables[int(c)] for c in pairs.contexts[hot]]
                spare = s.strength + s.discount * np.where(pairs.contexts > 0, within, 0)[pairs.context]
                total += (np.maximum(pairs.count - s.discount * tables, 0.0) + spare * prior[pairs.word]) / (s.strength + held)
            logs = np.minimum(np.rint(-np.log10(total / len(turns)) * GRAIN), (1 << 16) - 1).astype(np.uint16)[pairs.asked]
            out, at = [], 0
            for r, size in zip(pairs.rows, pairs.sizes):
                out.append({"kind": "logs", "chunk": r["chunk"], "bucket": r["bucket"], "payload": common.pack(logs[at:at + size])})
                at += size
            return pa.Table.from_pylist(out, schema=common.MESSAGE_SCHEMA)
        return averaged

    def scores(s: Settings):
        def add(texts: pa.Table, replies: pa.Table) -> pa.Table:
            row, flat, count, sizes, left, right, pair, gid, held = numbered(texts, replies)
            order, _ = dealt(left, right, gid, held, s.tokens)
            logs = np.concatenate([common.unpack(r["payload"])[0] for r in sorted((r for r in replies.to_pylist() if r["kind"] == "logs"), key=lambda r: r["bucket"])])
            by_pair = np.empty(len(order))
            by_pair[order] = logs / -float(GRAIN)
            starts = np.cumsum(sizes) - sizes
            base = np.log10((count + 1.0) / (s.tokens + s.words + 1.0))
            return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_tokens": sizes, "n_known": np.add.reduceat((count > 0)[flat].astype(np.int64), starts),
                             "train_tokens": np.full(len(sizes), s.tokens, np.int64), "base_score": np.add.reduceat(base[flat], starts),
                             "score": np.add.reduceat(by_pair[pair], starts)})
        return add

    def totals(messages: DataFrame) -> list[list[np.ndarray]]:
        """One row of a few numbers for each bucket."""
        return [common.unpack(r.payload) for r in messages.where("kind = 'total'").select("payload").collect()]

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    read = common.stored(rows.mapInArrow(number, common.MESSAGES))
    vocab = common.materialize(read("words").groupBy("bucket").applyInArrow(vocabulary, common.MESSAGES))
    n, v, ones, twos = np.sum([np.zeros(4, np.int64), *(t[0] for t in totals(vocab))], axis=0).tolist()
    s = Settings(n, v, root_discount=discount_of(ones, twos), root_customers=0, root_tables=v)
    vocab = vocab.where("kind = 'vocab'")
    pairs = common.kept_by("bucket", read("text").groupBy("chunk").cogroup(vocab.groupBy("chunk")).applyInArrow(pairs_of(s), common.MESSAGES))
    roots, kept, turns = None, [], []
    for k in range(rounds + s.samples):
        s = replace(s, turn=k)
        asked = pairs.groupBy("bucket")
        sent = asked.applyInArrow(first_up(s), common.MESSAGES) if roots is None else asked.cogroup(roots.groupBy("bucket")).applyInArrow(tables_up(s, False), common.MESSAGES)
        sent, before = common.materialize(sent), s
        found = totals(sent)
        hot: dict[int, int] = {}
        for _, contexts, tables in found:
            for c, t in zip(contexts.tolist(), tables.tolist()):
                hot[c] = hot.get(c, 0) + t
        if roots is None:
            s.discount = discount_of(sum(int(t[0][0]) for t in found), sum(int(t[0][1]) for t in found))
        random = np.random.default_rng([s.seed, s.turn])
        s = replace(s, hot_tables=hot, root_gamma=float(random.standard_gamma(s.root_strength / s.root_discount + s.root_tables)))
        root = common.materialize(sent.where("kind = 'tables'").groupBy("bucket").applyInArrow(seat_root(s), common.MESSAGES))
        seats = totals(root)
        s.root_customers, s.root_tables = np.sum([np.zeros(2, np.int64), *(t[0] for t in seats)], axis=0).tolist()
        # the unknown word has a share too
        s.root_mass = sum(float(t[1][0]) for t in seats) + float(unseated(s.root_gamma / (s.words + 1), s.root_discount, 1, random)[0])
        roots = root.where("kind = 'root'").unionByName(sent.where("kind = 'state'"))
        kept.append(roots.withColumn("kind", F.concat_ws("-", "kind", F.lit(k))))
        turns.append((before, s))
    last = kept[rounds - 1]
    for more in kept[rounds:]:
        last = last.unionByName(more)
    logs = pairs.groupBy("bucket").cogroup(last.groupBy("bucket")).applyInArrow(predict(turns[rounds:]), common.MESSAGES)
    return read("text").groupBy("chunk").cogroup(vocab.unionByName(logs).groupBy("chunk")).applyInArrow(scores(s), SCORES)
