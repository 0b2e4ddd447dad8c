"""The draws of :func:`quotaloom.functions.numeric.unit_draw` for runs of numbers, in numpy.

Texts of a run differ in the digits at their end only, and each is one block of SHA-256.  The rounds are done for many texts
at once, and words that are the same in all of them stay plain numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np

Word = int | np.ndarray
MASK = 0xFFFFFFFF
#: texts hashed side by side; fewer than FEW are hashed one by one
CHUNK, FEW = 1 << 16, 4096


def _root(x: int, k: int) -> int:
    low, high = 0, 1 << (x.bit_length() // k + 2)
    while low < high - 1:
        mid = (low + high) // 2
        low, high = (mid, high) if mid ** k <= x else (low, mid)
    return low


PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, p))]
#: the constants of SHA-256: fractions of the cube roots of 64 primes, and of the square roots of eight
ROUNDS, START = [_root(p << 96, 3) & MASK for p in PRIMES], [_root(p << 64, 2) & MASK for p in PRIMES[:8]]


def _turn(x: Word, k: int) -> Word:
    return (x >> k | x << (32 - k)) & MASK if isinstance(x, int) else (x >> np.uint32(k)) | (x << np.uint32(32 - k))


def _pair(x: Word, y: Word) -> tuple[Word, Word]:
    if isinstance(x, int) != isinstance(y, int):
        return (np.uint32(x), y) if isinstance(x, int) else (x, np.uint32(y))
    return x, y


def _xor(x: Word, y: Word) -> Word:
    x, y = _pair(x, y)
    return x ^ y


def _and(x: Word, y: Word) -> Word:
    x, y = _pair(x, y)
    return x & y


def _add(*parts: Word) -> Word:
    fixed, arrays = sum(x for x in parts if isinstance(x, int)) & MASK, [x for x in parts if not isinstance(x, int)]
    if not arrays:
        return fixed
    out = arrays[0] + np.uint32(fixed)
    for x in arrays[1:]:
        out += x
    return out


def _mixed(x: Word, a: int, b: int, c: int) -> Word:
    """x turned by a, by b and by c (rising), added without carry."""
    return _turn(_xor(_turn(_xor(_turn(x, c - b), x), b - a), x), a)


def _spread(x: Word, a: int, b: int, shift: int) -> Word:
    return _xor(_xor(_turn(x, a), _turn(x, b)), x >> shift if isinstance(x, int) else x >> np.uint32(shift))


def _digest_start(words: Sequence[Word]) -> tuple[Word, Word]:
    """The first two words of the digest of one block."""
    w = list(words)
    a, b, c, d, e, f, g, h = START
    differ = _xor(b, c)
    for i, constant in enumerate(ROUNDS):
        if i >= 16:
            w[i % 16] = _add(w[i % 16], _spread(w[(i - 15) % 16], 7, 18, 3), w[(i - 7) % 16], _spread(w[(i - 2) % 16], 17, 19, 10))
        first = _add(h, _mixed(e, 6, 11, 25), _xor(g, _and(e, _xor(f, g))), constant, w[i % 16])
        now = _xor(a, b)
        most, differ = _xor(b, _and(now, differ)), now
        a, b, c, d, e, f, g, h = _add(first, _mixed(a, 2, 13, 22), most), a, b, c, _add(d, first), e, f, g
    return _add(a, START[0]), _add(b, START[1])


def _one_by_one(prefix: bytes, low: int, high: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.sha256(b"%b%d" % (prefix, i)).digest()[:7], "big") >> 4 for i in range(low, high)], np.float64)


def _side_by_side(prefix: bytes, digits: int, low: int, high: int) -> np.ndarray:
    """The first 52 bits of the digests of ``prefix`` and each number of ``low`` to ``high`` - 1, all of so many ``digits``."""
    size = len(prefix) + digits
    block = (prefix + bytes(digits) + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "big")
    words: list[Word] = [int.from_bytes(block[4 * j:4 * j + 4], "big") for j in range(16)]
    rest = np.arange(low, high, dtype=np.int64)
    for at in range(size - 1, len(prefix) - 1, -1):
        rest, digit = np.divmod(rest, 10)
        words[at // 4] = _add(words[at // 4], (digit + 48).astype(np.uint32) << np.uint32(8 * (3 - at % 4)))
    x, y = _digest_start(words)
    return x.astype(np.float64) * 2.0 ** 20 + (y >> np.uint32(12))


def unit_draws(prefix: str, low: int, high: int) -> np.ndarray:
    """Draws in [0, 1) of ``prefix`` followed by each number of ``low`` to ``high`` - 1."""
    lead, out, at = prefix.encode(), [np.zeros(0)], low
    while at < high:
        digits = len(str(at))
        end = min(high, 10 ** digits, at + CHUNK)
        one_block = len(lead) + digits <= 55
        out.append(_side_by_side(lead, digits, at, end) if one_block and end - at >= FEW else _one_by_one(lead, at, end))
        at = end
    return np.concatenate(out) / 2.0 ** 52
