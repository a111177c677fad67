"""The stream of the standard library's seeded generator, from any place in it.

The Mersenne Twister is linear over GF(2): its state after J outputs is a sum
of the states after the first few, chosen by the bits of x^J modulo the
generator's characteristic polynomial. So a task can begin anywhere in the
stream for the price of some thousand XORs, whatever J.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np

WORDS, MIDDLE, DEGREE = 624, 397, 19937
UPPER, LOWER, TWIST = np.uint32(0x80000000), np.uint32(0x7FFFFFFF), np.uint32(0x9908B0DF)
#: Outputs up to which drawing is quicker than jumping.
NEAR = 1 << 22


def _generator(key: np.ndarray) -> np.random.MT19937:
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": WORDS}}
    return bits


def seeded(seed: int) -> np.ndarray:
    """The words of random.Random(seed), which stands before its first output."""
    return np.array(random.Random(seed).getstate()[1][:WORDS], np.uint32)


@cache
def characteristic() -> int:
    """The characteristic polynomial, bit i for x^i: the shortest recurrence of one output bit (Berlekamp-Massey)."""
    bits = (_generator(seeded(1)).random_raw(2 * DEGREE) & np.uint64(1)).astype(np.uint8).tolist()
    now, before, length, gap, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits):
        seen = seen << 1 | bit
        if not (now & seen).bit_count() & 1:
            gap += 1
        elif 2 * length <= n:
            now, before, length, gap = now ^ before << gap, now, n + 1 - length, 1
        else:
            now, gap = now ^ before << gap, gap + 1
    return int(f"{now:0{length + 1}b}"[::-1], 2)


@cache
def _spread() -> np.ndarray:
    """Each byte's bits with zeros between them."""
    return np.array([int(f"{b:b}", 4) for b in range(256)], "<u2")


def _square(p: int) -> int:
    return int.from_bytes(_spread()[np.frombuffer(p.to_bytes(p.bit_length() // 8 + 1, "little"), np.uint8)].tobytes(), "little")


@cache
def _terms() -> list[int]:
    return [i for i in range(DEGREE) if characteristic() >> i & 1]


def _remainder(p: int) -> int:
    while high := p >> DEGREE:
        p ^= high << DEGREE
        for i in _terms():
            p ^= high << i
    return p


def power(j: int) -> int:
    """x^j modulo the characteristic polynomial."""
    p = 1
    for bit in f"{j:b}":
        p = _remainder(_square(p) << (bit == "1"))
    return p


def _states(key: np.ndarray, n: int) -> np.ndarray:
    """The first n words of the sequence that begins with a key."""
    x = np.empty(n, np.uint32)
    x[:WORDS] = key
    for a in range(WORDS, n, WORDS - MIDDLE):
        b = min(n, a + WORDS - MIDDLE)
        y = (x[a - WORDS : b - WORDS] & UPPER) | (x[a - WORDS + 1 : b - WORDS + 1] & LOWER)
        x[a:b] = x[a - WORDS + MIDDLE : b - WORDS + MIDDLE] ^ (y >> np.uint32(1)) ^ (y & np.uint32(1)) * TWIST
    return x


def jumped(key: np.ndarray, j: int) -> np.ndarray:
    """The words after j more outputs."""
    words, p, out = _states(key, DEGREE + WORDS), power(j), np.zeros(WORDS, np.uint32)
    for i in np.flatnonzero(np.unpackbits(np.frombuffer(p.to_bytes(DEGREE // 8 + 1, "little"), np.uint8), bitorder="little")).tolist():
        out ^= words[i : i + WORDS]
    return out


class Draws:
    """random.Random(seed).randrange(n) many at a time, from the output `at` on."""

    def __init__(self, seed: int, at: int = 0):
        self.bits = _generator(jumped(seeded(seed), at) if at > NEAR else seeded(seed))
        self.ahead, self.at = np.zeros(0, np.uint64), at
        for start in range(0, at if at <= NEAR else 0, 1 << 20):
            self.bits.random_raw(min(1 << 20, at - start), output=False)

    def _raw(self, n: int) -> np.ndarray:
        while len(self.ahead) < n:
            self.ahead = np.append(self.ahead, self.bits.random_raw(max(n, 65_536)))
        return self.ahead[:n]

    def _take(self, n: int) -> None:
        self.ahead = self.ahead[n:]
        self.at += n

    def below(self, n: int, count: int) -> np.ndarray:
        """count draws below n, with the same rejections as one by one."""
        shift, parts, have = np.uint64(32 - n.bit_length()), [], 0
        while have < count:
            want = count - have
            window = self._raw(want + want // 8 + 16) >> shift
            good = np.flatnonzero(window < n)[:want]
            self._take(int(good[-1]) + 1 if len(good) == want else len(window))
            parts.append(window[good].astype(np.int64))
            have += len(good)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def skip(self, n: int, count: int, most: int = 1 << 20) -> None:
        for a in range(0, count, most):
            self.below(n, min(most, count - a))

    def accepted(self, n: int, outputs: int, most: int = 1 << 20) -> int:
        """How many of the next outputs give a draw below n."""
        shift, found = np.uint64(32 - n.bit_length()), 0
        for a in range(0, outputs, most):
            some = min(most, outputs - a)
            found += int((self._raw(some) >> shift < n).sum())
            self._take(some)
        return found
