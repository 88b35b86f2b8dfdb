"""Elias-Fano sequences and a three-level n-gram trie over them, queried in bulk with numpy.

A sequence of n ascending numbers below u keeps the low log2(u / n) bits of each packed, and the rest as a bit vector with
a one for each number and a zero for each step of the high part: about 2 + log2(u / n) bits a number.
"""

from __future__ import annotations

import tempfile

import numpy as np

U = np.uint64
_ONE, _FULL = U(1), U(0xFFFFFFFFFFFFFFFF)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) of each word, by halving."""
    at = np.zeros(len(word), U)
    k = k.astype(np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        part = np.bitwise_count((word >> at) & U((1 << half) - 1)).astype(np.int64)
        up = k >= part
        k = np.where(up, k - part, k)
        at = np.where(up, at + U(half), at)
    return at.astype(np.int64)


class Sequence:
    """Arrays: ``high`` bit vector in words, ``ones`` before each word, ``low`` packed bits; ``bits`` low bits a number."""

    def __init__(self, n: int, bits: int, high: np.ndarray, ones: np.ndarray, low: np.ndarray) -> None:
        self.n, self.bits, self.high, self.ones, self.low = n, bits, high, ones, low
        self.zeros = 64 * np.arange(len(ones), dtype=np.int64) - ones

    @staticmethod
    def build(values: np.ndarray, universe: int) -> Sequence:
        values = values.astype(U)
        n = len(values)
        bits = min(63, max(0, (universe // max(n, 1)).bit_length() - 1))
        top = (values >> U(bits)).astype(np.int64)
        places = top + np.arange(n)
        size = (int(places[-1]) if n else 0) + 2
        words = -(-size // 64) + 1
        high = np.packbits(np.bincount(places, minlength=words * 64).astype(np.uint8), bitorder="little").view(U)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])[:-1]
        low = np.zeros(-(-n * bits // 64) + 2, U)
        if bits:
            part = values & U((1 << bits) - 1)
            start = np.arange(n, dtype=np.int64) * bits
            word, shift = start >> 6, (start & 63).astype(U)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero((start & 63) + bits > 64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U(64) - shift[over]))
        return Sequence(n, bits, high, ones, low)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        start = i * self.bits
        word, shift = start >> 6, (start & 63).astype(U)
        rest = np.where(shift > 0, self.low[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return (self.low[word] >> shift | rest) & U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        at = 64 * word + _select_in_word(self.high[word], i - self.ones[word])
        return (at - i).astype(U) << U(self.bits) | self._low(i)

    def _begin(self, h: np.ndarray) -> np.ndarray:
        """How many numbers have a high part under h: the ones before the (h - 1)-th zero."""
        k = np.maximum(h - 1, 0)
        word = np.searchsorted(self.zeros, k, side="right") - 1
        inside = word < len(self.high)
        word = np.minimum(word, len(self.high) - 1)
        at = 64 * word + _select_in_word(self.high[word] ^ _FULL, k - self.zeros[word])
        return np.where(h <= 0, 0, np.where(inside, np.minimum(at - k, self.n), self.n))

    def find(self, x: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """Place of each x within its range [low, high), by successor search; -1 where it isn't there."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        top = (x >> U(self.bits)).astype(np.int64)
        last = int(self.get(np.array([self.n - 1]))[0] >> U(self.bits))
        top = np.minimum(top, last + 1)
        a, b = self._begin(top), self._begin(np.minimum(top + 1, last + 1))
        b = np.where(top > last, a, np.where(top == last, self.n, b))
        if low is not None:
            a, b = np.maximum(a, low), np.minimum(b, high)
        want = x & U((1 << self.bits) - 1) if self.bits else np.zeros(len(x), U)
        end = b
        while True:
            open_ = a < b
            if not open_.any():
                break
            mid = (a + b) >> 1
            less = np.zeros(len(x), bool)
            less[open_] = self._low(mid[open_]) < want[open_]
            a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
        found = a < end
        found[found] = self._low(a[found]) == want[found]
        return np.where(found, a, -1)


#: Steps a decade of quantised probabilities, and decades: quotients of 64-bit counts stay over 1e-20, so that nothing that
#: was counted becomes zero.  Code 0 is zero, and codes round down, so that sums stay at 1 or less.
STEPS, DECADES = 36, 20


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        code = np.ceil(-np.log10(np.maximum(p, 1e-300)) * STEPS - 1e-9) + 1
    return np.where((p > 0) & (code < len(VALUES)), np.maximum(code, 1), 0).astype(np.uint16)


VALUES = np.concatenate([[0.0], 10.0 ** (-np.arange(STEPS * DECADES + 1) / STEPS)])


class Trie:
    """Levels of one, two and three words.  A level is a sequence of parent << 32 | word (of 64-bit words in the first),
    pointers to the children's first places, and codes; all arrays lie in one memory-mapped file that has no name and
    goes with the process."""

    def __init__(self, words: np.ndarray, second: np.ndarray, third: np.ndarray, begin: np.ndarray, begin2: np.ndarray, count: np.ndarray, codes: dict[str, np.ndarray]) -> None:
        """words ascending; second, third ascending (parent << 32 | word); begin, begin2: first child of each node, and the end."""
        self._arrays: list[np.ndarray] = []
        parts = [Sequence.build(words, 1 << 64), Sequence.build(begin, len(second) + 1), Sequence.build(second, max(1, len(words)) << 32), Sequence.build(begin2, len(third) + 1), Sequence.build(third, max(1, len(second)) << 32)]
        file = tempfile.TemporaryFile()
        kept = [a for s in parts for a in (s.high, s.ones, s.low)] + [count, *codes.values()]
        at = []
        for a in kept:
            at.append(file.tell())
            file.write(np.ascontiguousarray(a).tobytes())
            file.write(b"\0" * (-file.tell() % 8 + 8))
        file.flush()
        mapped = [np.memmap(file, a.dtype, "r", o, a.shape) if a.size else a for a, o in zip(kept, at, strict=True)]
        file.close()
        self.words, self.begin, self.second, self.begin2, self.third = (Sequence(s.n, s.bits, *mapped[3 * i : 3 * i + 3]) for i, s in enumerate(parts))
        self.count, self.codes = mapped[15], dict(zip(codes, mapped[16:], strict=True))

    def nodes(self, words: np.ndarray) -> np.ndarray:
        return self.words.find(words)

    def _below(self, level: Sequence, pointers: Sequence, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.full(len(parent), -1, np.int64)
        real = np.flatnonzero(parent >= 0)
        p = parent[real]
        out[real] = level.find(p.astype(U) << U(32) | word[real].astype(U), pointers.get(p).astype(np.int64), pointers.get(p + 1).astype(np.int64))
        return out

    def pairs(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._below(self.second, self.begin, node, word)

    def triples(self, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._below(self.third, self.begin2, pair, word)
