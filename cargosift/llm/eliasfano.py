"""Elias-Fano coding of rising sequences in plain arrays, read from memory maps many values at a time."""

from __future__ import annotations

import numpy as np

U = np.uint64
_ONE, _ALL = U(1), U(0xFFFFFFFFFFFFFFFF)


_TABLE = np.array([[([i for i in range(8) if byte >> i & 1] + [0] * 8)[rank] for rank in range(8)] for byte in range(256)], np.int64).ravel()
_EACH, _TOP = U(0x0101010101010101), U(0x8080808080808080)


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit number rank (from 0) of each word: its byte by running sums of set bits, then a table."""
    x = word - ((word >> U(1)) & U(0x5555555555555555))
    x = (x & U(0x3333333333333333)) + ((x >> U(2)) & U(0x3333333333333333))
    upto = ((x + (x >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _EACH
    r = rank.astype(U)
    at = np.bitwise_count((((r * _EACH) | _TOP) - upto) & _TOP).astype(U) << U(3)
    before = ((upto << U(8)) >> at) & U(255)
    return (at.astype(np.int64)) + _TABLE[((((word >> at) & U(255)) << U(3)) + r - before).astype(np.int64)]


class EliasFano:
    """n rising values below a universe: low bits packed, high bits in unary with a directory of ones and zeros by word."""

    FIELDS = ("meta", "lows", "high", "ones", "zeros")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.n, self.bits = int(arrays["meta"][0]), int(arrays["meta"][1])
        self.lows, self.high, self.ones, self.zeros = (arrays[k] for k in self.FIELDS[1:])
        self.mask = U((1 << self.bits) - 1)

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        v, n = values.astype(U), len(values)
        bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        lows = np.zeros(n * bits // 64 + 2, U)
        if bits:
            low, pos = v & U((1 << bits) - 1), np.arange(n, dtype=U) * U(bits)
            word, shift = (pos >> U(6)).astype(np.int64), pos & U(63)
            np.bitwise_or.at(lows, word, low << shift)
            over = (shift + U(bits)) > U(64)
            np.bitwise_or.at(lows, word[over] + 1, low[over] >> (U(64) - shift[over]))
        top = (max(universe, 1) - 1 >> bits) + 1
        size = n + top + 1
        high = np.zeros(size // 64 + 1, U)
        pos = (v >> U(bits)) + np.arange(n, dtype=U)
        np.bitwise_or.at(high, (pos >> U(6)).astype(np.int64), _ONE << (pos & U(63)))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        zeros = np.arange(len(high) + 1) * 64 - ones
        if len(high) < 1 << 25:
            ones, zeros = ones.astype(np.uint32), zeros.astype(np.uint32)
        return cls({"meta": np.array([n, bits], np.int64), "lows": lows, "high": high, "ones": ones, "zeros": zeros})

    def _select(self, k: np.ndarray, directory: np.ndarray, flip: bool) -> np.ndarray:
        w = np.searchsorted(directory, k.astype(directory.dtype), "right") - 1
        word = self.high[w]
        return w * 64 + _select_in_word(~word if flip else word, k - directory[w].astype(np.int64))

    def _next(self, pos: np.ndarray, directory: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        """Place of set bit number k, the one after the bit at pos: mostly in the same word."""
        word = self.high[pos >> 6]
        rest = ((~word if flip else word) >> (pos & 63).astype(U)) >> _ONE
        out = pos + 1 + np.bitwise_count((rest & (~rest + _ONE)) - _ONE).astype(np.int64)
        far = np.flatnonzero(rest == 0)
        if len(far):
            out[far] = self._select(k[far], directory, flip)
        return out

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        pos = i.astype(U) * U(self.bits)
        word, shift = (pos >> U(6)).astype(np.int64), pos & U(63)
        left = self.lows[word + 1] << ((U(64) - shift) & U(63))
        return ((self.lows[word] >> shift) | np.where(shift == 0, U(0), left)) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        return ((self._select(i, self.ones, False) - i).astype(U) << U(self.bits)) | self.low(i)

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places i and i + 1."""
        at = self._select(i, self.ones, False)
        then = self._next(at, self.ones, i + 1, False)
        return ((at - i).astype(U) << U(self.bits)) | self.low(i), ((then - i - 1).astype(U) << U(self.bits)) | self.low(i + 1)

    def find(self, x: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each value of x, between start and end if given; -1 where there is none."""
        if not self.n or not len(x):
            return np.full(len(x), -1)
        x = x.astype(U)
        h = (x >> U(self.bits)).astype(np.int64)
        inside = h < int(self.zeros[-1]) - 1
        hh = np.where(inside, h, 0)
        before = self._select(np.maximum(hh - 1, 0), self.zeros, True)
        lo = np.where(hh > 0, before - hh + 1, 0)
        hi = np.where(hh > 0, self._next(before, self.zeros, hh, True), before) - hh
        if start is not None:
            lo, hi = np.maximum(lo, start), np.minimum(hi, end)
        hi = np.where(inside, np.minimum(hi, self.n), lo)
        stop, target = hi.copy(), x & self.mask
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.low(mid) < target[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        at = np.full(len(x), -1)
        some = np.flatnonzero(lo < stop)
        at[some] = np.where(self.low(lo[some]) == target[some], lo[some], -1)
        return at
