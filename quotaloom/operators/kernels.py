"""Distances between rows, and lower bounds between a row and a cell of rows.

A kernel knows four things: the distances of two matrices of rows, the cell in which a row belongs, a box that describes a
cell and can be merged, and a lower bound of the distances between a row and everything in a box.  The bounds are what the
index in :mod:`quotaloom.operators.neighbors` prunes by; they may be loose, never too high.

Boxes are int64 arrays of a fixed length for each kernel; floating-point numbers are kept bit by bit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

Arrays = Mapping[str, np.ndarray]
#: components up to which a box has its smallest and largest value; wider vectors have only a ball around their pivot
BOX_WIDTH = 256


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T, 0.0)


def _gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of one component: how far each row is outside each box."""
    return np.maximum(np.maximum(low[None, :] - x[:, None], x[:, None] - high[None, :]), 0.0)


def _grouped(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by cell, the cells, and where each starts in that order."""
    order = np.argsort(cells, kind="stable")
    names, starts = np.unique(cells[order], return_index=True)
    return order, names, starts


def _bits(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.float64).view(np.int64)


def _pattern(*parts: np.ndarray) -> np.ndarray:
    """A number for each set of known components."""
    known = np.concatenate(parts, axis=1).astype(np.uint64)
    out = np.zeros(len(known), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(known.shape[1]):
            out = (out + known[:, j] + np.uint64(1)) * np.uint64(6364136223846793005)
    return (out >> np.uint64(12)).astype(np.int64)


class Kernel:
    """``variants`` name the distances that are measured in one go."""

    variants: Sequence[str] = ("all",)

    def __call__(self, q: Arrays, t: Arrays) -> dict[str, np.ndarray]:
        raise NotImplementedError

    def cells(self, t: Arrays, pivots: Arrays) -> np.ndarray:
        """The number of the cell of each row."""
        raise NotImplementedError

    def boxes(self, t: Arrays, cells: np.ndarray, pivots: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells, rows in each, one box for each)."""
        raise NotImplementedError

    def merge(self, boxes: np.ndarray) -> np.ndarray:
        """One box around boxes of the same cell."""
        raise NotImplementedError

    def bounds(self, q: Arrays, boxes: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Lower bounds of each variant for (row, box), infinite where nothing can be compared; and what to look at first."""
        raise NotImplementedError


class Euclidean(Kernel):
    """Distances over subsets of blocks: squares add up over blocks, so each block is measured once.

    A cell is what lies next to a pivot.  Its box holds for each block the smallest and largest components, the pivot and the
    range of distances from it: by the triangle inequality a row is no closer than it is to that ball.
    """

    def __init__(self, subsets: Mapping[str, Sequence[str]]) -> None:
        self.subsets = {name: list(blocks) for name, blocks in subsets.items()}
        self.variants = tuple(self.subsets)
        self.blocks = list(dict.fromkeys(b for names in self.subsets.values() for b in names))

    def rows(self, x: Arrays) -> dict[str, np.ndarray]:
        """Blocks filled up with zeros to one width, which adds nothing to a distance."""
        width = max(x[b].shape[1] for b in self.blocks)
        return {b: np.pad(x[b].astype(float), ((0, 0), (0, width - x[b].shape[1]))) for b in self.blocks}

    def result(self, d2: np.ndarray) -> np.ndarray:
        return np.sqrt(d2)

    def __call__(self, q: Arrays, t: Arrays) -> dict[str, np.ndarray]:
        q, t = self.rows(q), self.rows(t)
        parts = {b: squared(q[b], t[b]) for b in self.blocks}
        return {name: self.result(sum(parts[b] for b in names)) for name, names in self.subsets.items()}

    def cells(self, t: Arrays, pivots: Arrays) -> np.ndarray:
        t, p = self.rows(t), self.rows(pivots)
        d2 = sum(squared(t[b], p[b]) for b in self.blocks)
        return np.where(np.isfinite(d2).any(1), np.argmin(np.where(np.isfinite(d2), d2, np.inf), axis=1), -1).astype(np.int64)

    def boxes(self, t: Arrays, cells: np.ndarray, pivots: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, p = self.rows(t), self.rows(pivots)
        order, names, starts = _grouped(cells)
        parts = []
        for b in self.blocks:
            center = p[b][np.maximum(names, 0)]
            away = np.sqrt(((t[b] - p[b][np.maximum(cells, 0)]) ** 2).sum(1))[order]
            parts += [np.minimum.reduceat(t[b][order], starts), np.maximum.reduceat(t[b][order], starts), center,
                      np.minimum.reduceat(away, starts)[:, None], np.maximum.reduceat(away, starts)[:, None]]
        return names, np.diff(np.append(starts, len(order))), _bits(np.concatenate(parts, axis=1))

    def split(self, boxes: np.ndarray) -> dict[str, list[np.ndarray]]:
        """Of each block the smallest and largest components, the pivot and the range of distances from it."""
        parts = np.split(boxes.view(np.float64), len(self.blocks), axis=1)
        width = (parts[0].shape[1] - 2) // 3
        return {b: np.split(x, [width, 2 * width, 3 * width, 3 * width + 1], axis=1) for b, x in zip(self.blocks, parts)}

    def merge(self, boxes: np.ndarray) -> np.ndarray:
        out = []
        for low, high, center, inner, outer in self.split(boxes).values():
            out += [low.min(0), high.max(0), center[0], inner.min(0), outer.max(0)]
        return _bits(np.concatenate(out))

    def bounds(self, q: Arrays, boxes: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        q, least, near = self.rows(q), {}, 0.0
        for b, (low, high, center, inner, outer) in self.split(boxes).items():
            away = squared(q[b], center)
            near = near + away
            away = np.sqrt(away)
            ball = np.maximum(np.maximum(away - outer[:, 0], inner[:, 0] - away), 0.0)
            box = np.zeros_like(away)
            if low.shape[1] <= BOX_WIDTH:
                for j in range(low.shape[1]):
                    box += _gaps(q[b][:, j], low[:, j], high[:, j]) ** 2
            least[b] = np.maximum(ball ** 2, box)
        return {name: self.result(sum(least[b] for b in names)) for name, names in self.subsets.items()}, near


class Cosine(Euclidean):
    """1 - cosine is half the squared distance of the rows scaled to length 1; a row of zeros is at 1 from all rows."""

    def __init__(self) -> None:
        super().__init__({"all": ["vector"]})

    def rows(self, x: Arrays) -> dict[str, np.ndarray]:
        v = x["vector"].astype(float)
        norms = np.linalg.norm(v, axis=1)[:, None]
        return {"vector": np.divide(v, norms, out=np.zeros_like(v), where=norms > 0)}

    def result(self, d2: np.ndarray) -> np.ndarray:
        return d2 / 2

    def __call__(self, q: Arrays, t: Arrays) -> dict[str, np.ndarray]:
        a, b = q["vector"].astype(float), t["vector"].astype(float)
        norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        return {"all": 1.0 - np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0)}


class Fields(Kernel):
    """Distances over the fields that both rows know: the cells never mix rows that know different fields."""

    def numbers(self, x: Arrays) -> np.ndarray:
        return x["vector"].astype(float)

    def codes(self, x: Arrays) -> np.ndarray:
        codes = x.get("codes")
        return codes if codes is not None and codes.size else np.full((len(x["vector"]), 0), -1, np.int64)

    def cells(self, t: Arrays, pivots: Arrays) -> np.ndarray:
        d = next(iter(self(t, pivots).values()))
        nearest = np.argmin(np.where(np.isfinite(d), d, np.inf), axis=1)
        pattern = _pattern(np.isfinite(self.numbers(t)), self.codes(t) >= 0)
        with np.errstate(over="ignore"):
            return (pattern << np.int64(10)) | (nearest & 1023)

    def boxes(self, t: Arrays, cells: np.ndarray, pivots: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order, names, starts = _grouped(cells)
        x, codes = self.numbers(t)[order], self.codes(t)[order]
        x = np.where(np.isfinite(x), x, np.nan)
        parts = [_bits(np.minimum.reduceat(x, starts)), _bits(np.maximum.reduceat(x, starts)),
                 np.minimum.reduceat(codes, starts), np.maximum.reduceat(codes, starts)]
        shape = np.tile(np.array([[x.shape[1], codes.shape[1]]], np.int64), (len(names), 1))
        return names, np.diff(np.append(starts, len(order))), np.concatenate([shape, *parts], axis=1)

    def split(self, boxes: np.ndarray) -> list[np.ndarray]:
        n, c = boxes[0, :2].tolist()
        low, high, code_low, code_high = np.split(boxes[:, 2:], [n, 2 * n, 2 * n + c], axis=1)
        return [np.ascontiguousarray(low).view(np.float64), np.ascontiguousarray(high).view(np.float64), code_low, code_high]

    def merge(self, boxes: np.ndarray) -> np.ndarray:
        low, high, code_low, code_high = self.split(boxes)
        return np.concatenate([boxes[0, :2], _bits(low.min(0)), _bits(high.max(0)), code_low.min(0), code_high.max(0)])

    def value(self, total: np.ndarray, seen: np.ndarray, fields: int) -> np.ndarray:
        raise NotImplementedError

    def gap(self, gap: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def bounds(self, q: Arrays, boxes: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        x, codes = self.numbers(q), self.codes(q)
        low, high, code_low, code_high = self.split(boxes)
        total, seen = np.zeros((len(x), len(boxes))), np.zeros((len(x), len(boxes)))
        for j in range(x.shape[1]):
            known = np.isfinite(x[:, j])[:, None] & np.isfinite(low[:, j])[None, :]
            with np.errstate(invalid="ignore"):
                total += np.where(known, self.gap(_gaps(x[:, j], low[:, j], high[:, j])), 0.0)
            seen += known
        for j in range(codes.shape[1]):
            known = (codes[:, j] >= 0)[:, None] & (code_low[:, j] >= 0)[None, :]
            outside = (codes[:, j][:, None] < code_low[:, j][None, :]) | (codes[:, j][:, None] > code_high[:, j][None, :])
            total += known & outside
            seen += known
        d = self.value(total, seen, x.shape[1])
        d = np.where(np.isfinite(d), d, np.inf)
        return {"all": d}, d


class NanEuclidean(Fields):
    """Distance over jointly observed columns, scaled up by the share observed."""

    def codes(self, x: Arrays) -> np.ndarray:
        return np.full((len(x["vector"]), 0), -1, np.int64)

    def __call__(self, q: Arrays, t: Arrays) -> dict[str, np.ndarray]:
        a, b = q["vector"].astype(float), t["vector"].astype(float)
        ma, mb = np.isfinite(a).astype(float), np.isfinite(b).astype(float)
        a, b = np.where(ma > 0, a, 0.0), np.where(mb > 0, b, 0.0)
        d2 = np.maximum((a * a) @ mb.T + ma @ (b * b).T - 2.0 * a @ b.T, 0.0)
        return {"all": self.value(d2, ma @ mb.T, a.shape[1])}

    def gap(self, gap: np.ndarray) -> np.ndarray:
        return gap ** 2

    def value(self, total: np.ndarray, seen: np.ndarray, fields: int) -> np.ndarray:
        return np.sqrt(np.divide(total * fields, seen, out=np.full_like(total, np.nan), where=seen > 0))


class Gower(Fields):
    """Mean over jointly observed fields of range-scaled gaps (capped at 1) and category mismatches."""

    def __call__(self, q: Arrays, t: Arrays) -> dict[str, np.ndarray]:
        shape = (len(q["vector"]), len(t["vector"]))
        total, seen = np.zeros(shape), np.zeros(shape)
        for j in range(q["vector"].shape[1]):
            gap = np.abs(q["vector"][:, j].astype(float)[:, None] - t["vector"][:, j].astype(float)[None, :])
            ok = np.isfinite(gap)
            total += np.where(ok, np.minimum(gap, 1.0), 0.0)
            seen += ok
        for j in range(q["codes"].shape[1] if q["codes"].size and t["codes"].size else 0):
            a, b = q["codes"][:, j][:, None], t["codes"][:, j][None, :]
            ok = (a >= 0) & (b >= 0)
            total += ok & (a != b)
            seen += ok
        return {"all": self.value(total, seen, 0)}

    def gap(self, gap: np.ndarray) -> np.ndarray:
        return np.minimum(gap, 1.0)

    def value(self, total: np.ndarray, seen: np.ndarray, fields: int) -> np.ndarray:
        return np.divide(total, seen, out=np.full_like(total, np.nan), where=seen > 0)


class Tanimoto(Kernel):
    """1 - |a and b| / |a or b| on 64-bit words; two empty sets are not similar.

    Rows are listed under their rarest bit (rarity by the pivots) and the size of their set, in steps of a quarter.  What lies in
    a cell has none but the bits that any of its rows has, all bits that each of its rows has, and a size in its range.
    """

    @staticmethod
    def unpack(words: np.ndarray) -> np.ndarray:
        raw = np.ascontiguousarray(words.astype(np.int64)).view(np.uint8).reshape(len(words), -1)
        return np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)

    def __call__(self, q: Arrays, t: Arrays) -> dict[str, np.ndarray]:
        a, b = self.unpack(q["words"]), self.unpack(t["words"])
        both = (a @ b.T).astype(float)
        either = a.sum(1).astype(float)[:, None] + b.sum(1).astype(float)[None, :] - both
        return {"all": 1.0 - np.divide(both, either, out=np.zeros_like(both), where=either > 0)}

    def cells(self, t: Arrays, pivots: Arrays) -> np.ndarray:
        often = self.unpack(pivots["words"]).sum(0)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        bits = self.unpack(t["words"])
        size = bits.sum(1)
        rarest = np.where(bits > 0, rank[None, :], len(rank)).min(1)
        band = np.floor(np.log(np.maximum(size, 1.0)) / np.log(1.25)).astype(np.int64)
        return rarest * 64 + np.minimum(band, 63)

    def boxes(self, t: Arrays, cells: np.ndarray, pivots: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order, names, starts = _grouped(cells)
        words = t["words"].astype(np.int64)[order]
        size = self.unpack(words).sum(1).astype(np.int64)
        parts = [np.bitwise_and.reduceat(words, starts), np.bitwise_or.reduceat(words, starts),
                 np.minimum.reduceat(size, starts)[:, None], np.maximum.reduceat(size, starts)[:, None]]
        return names, np.diff(np.append(starts, len(order))), np.concatenate(parts, axis=1)

    def merge(self, boxes: np.ndarray) -> np.ndarray:
        w = (boxes.shape[1] - 2) // 2
        return np.concatenate([np.bitwise_and.reduce(boxes[:, :w]), np.bitwise_or.reduce(boxes[:, w:2 * w]),
                               [boxes[:, 2 * w].min(), boxes[:, 2 * w + 1].max()]])

    def bounds(self, q: Arrays, boxes: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        w = (boxes.shape[1] - 2) // 2
        a = self.unpack(q["words"])
        size = a.sum(1).astype(float)[:, None]
        every, some = self.unpack(boxes[:, :w]), self.unpack(boxes[:, w:2 * w])
        smallest, largest = boxes[:, 2 * w][None, :].astype(float), boxes[:, 2 * w + 1][None, :].astype(float)
        shared = np.minimum((a @ some.T).astype(float), largest)
        either = np.maximum(size + every.sum(1)[None, :] - (a @ every.T), size + smallest - shared)
        d = 1.0 - np.divide(shared, either, out=np.zeros_like(shared), where=either > 0)
        return {"all": d}, d
